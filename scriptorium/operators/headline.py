"""Fragments of a hit's text with its query terms marked, as expressions.

Tokens, the text between them and their analysed forms are parallel arrays of a row; the
positions of the query's terms decide which stretch is shown.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scriptorium.functions.text import SEPARATORS, Analyzer, query_words

SNIPPET_TOKENS = 32
# Words of a headline (fixed values).
HEADLINE_MAX, HEADLINE_MIN = 35, 20
MARK_OPEN, MARK_CLOSE, ELLIPSIS = "<mark>", "</mark>", "..."


def query_terms(queries: DataFrame, analyzer: Analyzer) -> DataFrame:
    """(query_id, singles, longer): the single terms and the phrases of each query."""
    words = queries.select("query_id", F.explode(query_words(F.col("query"))).alias("word"))
    terms = words.select("query_id", analyzer.terms(F.col("word")).alias("terms")).filter(F.size("terms") > 0)
    one = F.when(F.size("terms") == 1, F.col("terms")[0])
    return terms.groupBy("query_id").agg(
        F.collect_set(one).alias("singles"), F.collect_set(F.when(F.size("terms") > 1, F.col("terms"))).alias("longer")
    )


def _labels(words: str, singles: str, longer: str) -> Column:
    """Each token's term where the query asks for it, alone or inside a phrase; else null."""

    def in_phrase(at: Column) -> Column:
        def starts(phrase: Column) -> Column:
            size = F.size(phrase)
            return F.exists(
                F.sequence(F.lit(0), size - 1),
                lambda j: (at >= j) & (F.slice(F.col(words), F.greatest(at - j + 1, F.lit(1)), size) == phrase),
            )

        return F.exists(F.col(longer), starts)

    single = F.transform(F.col(words), lambda w: F.when(F.array_contains(F.col(singles), w), w))
    both = F.transform(F.col(words), lambda w, i: F.when(F.array_contains(F.col(singles), w) | in_phrase(i), w))
    return F.when(F.size(longer) == 0, single).otherwise(both)


def _found(labels: Column) -> Column:
    return F.filter(labels, lambda x: x.isNotNull())


def _inside(start: Column, size: int) -> Column:
    return _found(F.slice("labels", start + 1, F.lit(size)))


def tokenised(hits: DataFrame, queries: DataFrame, analyzer: Analyzer) -> DataFrame:
    """``hits`` with raw (tokens), before (the text that leads to each), tail, labels and
    matches (positions of the query's terms).  Rows whose analysis does not give one form for
    each token have null labels."""
    every_word = Analyzer(stem=analyzer.stem)
    # Few rows with much work each: spread them over all cores by number, since by size
    # they would be coalesced into one task.
    cores = hits.sparkSession.sparkContext.defaultParallelism
    spread = hits.join(query_terms(queries, analyzer), "query_id", "left").repartition(cores, "query_id", "rank")
    gaps = F.regexp_extract_all("content", F.lit(SEPARATORS), 0)
    lead = F.when(F.col("content").rlike("^" + SEPARATORS), gaps).otherwise(F.concat(F.array(F.lit("")), gaps))
    parts = spread.withColumns(
        {"raw": F.array_remove(F.split("content", SEPARATORS), ""), "before": lead, "words": every_word.terms(F.col("content"))}
    )
    fits = F.col("singles").isNotNull() & (F.size("raw") > 0) & (F.size("raw") == F.size("words"))
    parts = parts.withColumn("labels", F.when(fits, _labels("words", "singles", "longer"))).drop("words", "singles", "longer")
    at = F.transform("labels", lambda x, i: F.when(x.isNotNull(), i))
    return parts.withColumn("matches", _found(at))


def _marked(start: Column, stop: Column, joined: bool) -> Column:
    """The tokens from ``start`` to ``stop`` with marks round every match, or round every run
    of matches when ``joined``."""
    raw, labels, before = F.col("raw"), F.col("labels"), F.col("before")

    def hit(i: Column) -> Column:
        return F.get(labels, i).isNotNull()

    def piece(i: Column) -> Column:
        inner = i > start
        opens = hit(i) & (~inner | ~hit(i - 1)) if joined else hit(i)
        closes = inner & hit(i - 1) & ~hit(i) if joined else F.lit(False)
        ends = hit(i) & (i == stop - 1) if joined else hit(i)
        return F.concat(
            F.when(closes, MARK_CLOSE).otherwise(""),
            F.when(inner, F.get(before, i)).otherwise(""),
            F.when(opens, MARK_OPEN).otherwise(""),
            F.get(raw, i),
            F.when(ends, MARK_CLOSE).otherwise(""),
        )

    return F.array_join(F.transform(F.sequence(start, stop - 1), piece), "")


def snippets(hits: DataFrame, queries: DataFrame, analyzer: Analyzer, tokens: int = SNIPPET_TOKENS) -> DataFrame:
    """``hits`` with ``highlight``: the window of ``tokens`` tokens with the most distinct
    matches, then the most matches, then the earliest; windows begin at a match.

    The window keeps the text between its tokens; what is cut off before or after it
    becomes an ellipsis.
    """
    columns = hits.columns
    n = F.size("raw")
    latest = F.greatest(n - tokens, F.lit(0))
    starts = F.array_distinct(F.transform("matches", lambda m: F.least(m, latest)))
    scored = F.transform(
        starts, lambda s: F.struct(F.size(F.array_distinct(_inside(s, tokens))).alias("kinds"), F.size(_inside(s, tokens)).alias("all"), (-s).alias("order"))
    )
    rows = tokenised(hits, queries, analyzer).withColumn("first", F.coalesce(-F.array_max(scored)["order"], F.lit(0)))
    rows = rows.withColumn("stop", F.least(F.col("first") + tokens, n))
    first, stop = F.col("first"), F.col("stop")
    lead = F.when(first > 0, ELLIPSIS).otherwise(F.get("before", F.lit(0)))
    tail = F.when(stop < n, ELLIPSIS).otherwise(F.coalesce(F.get("before", stop), F.lit("")))
    text = F.concat(lead, _marked(first, stop, joined=True), tail)
    return rows.select(*columns, F.when(F.col("labels").isNotNull(), text).alias("highlight"))


def headlines(hits: DataFrame, queries: DataFrame, analyzer: Analyzer, longest: int = HEADLINE_MAX, shortest: int = HEADLINE_MIN) -> DataFrame:
    """``hits`` with ``headline``: the shortest stretch from a match to a match, of at most
    ``longest`` words, that holds the most distinct terms; of equal ones the earliest.

    A stretch under ``shortest`` words is widened to the right, at the end of the text to the
    left.  Every matching word is marked; a text without matches shows its beginning.
    """
    columns = hits.columns
    n = F.size("raw")
    rows = tokenised(hits, queries, analyzer)
    # How many distinct terms the window from each match holds; only the best go on.
    counted = F.transform("matches", lambda s: F.struct(F.size(F.array_distinct(_inside(s, longest))).alias("kinds"), s.alias("start")))
    rows = rows.withColumn("counted", counted).withColumn("most", F.array_max(F.transform("counted", lambda c: c["kinds"])))

    def cover(start: Column) -> Column:
        # The first token at which all of them have been seen.
        ends = F.filter(
            F.sequence(F.lit(0), F.lit(longest - 1)),
            lambda j: F.size(F.array_distinct(_found(F.slice("labels", start + 1, j + 1)))) == F.col("most"),
        )
        return F.struct((-F.array_min(ends)).alias("order"), (-start).alias("start"))

    full = F.filter("counted", lambda c: c["kinds"] == F.col("most"))
    rows = rows.withColumn("best", F.array_max(F.transform(full, lambda c: cover(c["start"]))))
    rows = rows.withColumn("first", F.coalesce(-F.col("best.start"), F.lit(0)))
    rows = rows.withColumn("stop", F.greatest(F.col("first") - F.coalesce(F.col("best.order"), F.lit(1)) + 1, F.least(F.col("first") + shortest, n)))
    rows = rows.withColumn("first", F.greatest(F.least(F.col("first"), F.col("stop") - shortest), F.lit(0)))
    text = _marked(F.col("first"), F.col("stop"), joined=False)
    return rows.select(*columns, F.when(F.col("labels").isNotNull(), text).alias("headline"))
