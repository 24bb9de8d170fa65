"""Substring lookups without a cross join: by a rare gram or a rare term.

A text that contains a needle contains every gram (or inner term) of it.  Each
needle is therefore joined through the one that occurs least, and only those
candidates are compared in full.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scriptorium.operators.ranking import in_wanted, top_k, wanted_categories

PATH_SCORE = 0.5
GRAM = 3


def _grams(text: Column, size: int) -> Column:
    last = F.length(text) - size + 1
    starts = F.when(last >= 1, F.sequence(F.lit(1), last)).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(F.transform(starts, lambda i: F.substring(text, i, F.lit(size))))


def _rarest(wanted: DataFrame, offered: DataFrame, needle: str) -> DataFrame:
    """Per needle its gram that the fewest texts offer."""
    counts = offered.join(wanted.select("gram").distinct(), "gram", "left_semi").groupBy("gram").agg(
        F.count(F.lit(1)).alias("n")
    )
    rated = wanted.join(counts, "gram", "left").fillna(0, ["n"])
    return top_k(rated, [needle], [F.col("n"), F.col("gram")], 1, "place").drop("n", "place")


def path_lookup(queries: DataFrame, chunks: DataFrame, k: int = 5) -> DataFrame:
    """Chunks whose path matches ``%query%``, ordered by path.

    ``%`` and ``_`` in the query are live.  The anchor gram comes from the
    longest literal part of the query; short literals use shorter grams.
    """
    literal = F.array_max(
        F.transform(F.split("query", "[%_]"), lambda part: F.struct(F.length(part).alias("n"), part.alias("part")))
    )["part"]
    asked = queries.select("query_id", "query", F.lower(literal).alias("literal"))
    wanted = asked.select("query_id", "query", F.explode(_literal_grams(F.col("literal"))).alias("gram"))
    limits = queries.select("query_id", wanted_categories(queries).alias("wanted"))
    wanted = wanted.join(limits, "query_id")
    path = F.lower("file_path")
    offered = chunks.select("file_path").distinct().select("file_path", F.explode(_offered_grams(path)).alias("gram"))
    offered = offered.join(wanted.select("gram").distinct(), "gram", "left_semi")
    paths = (
        _rarest(wanted, offered, "query_id")
        .join(offered, "gram")
        .filter(F.like(path, F.concat(F.lit("%"), F.lower("query"), F.lit("%"))))
        .select("query_id", "file_path", "wanted")
    )
    rows = chunks.join(paths, "file_path").filter(in_wanted())
    best = top_k(rows, ["query_id"], [F.col("file_path"), F.col("chunk_index")], k)
    return best.select(
        "query_id", "rank", F.lit(PATH_SCORE).alias("score"), "file_path", "chunk_index", "title", "content", "category"
    )


def _literal_grams(text: Column) -> Column:
    return F.when(F.length(text) >= GRAM, _grams(text, GRAM)).otherwise(F.array(text))


def _offered_grams(text: Column) -> Column:
    return F.concat(F.array(F.lit("")), *[_grams(text, n) for n in range(1, GRAM + 1)])


def containing_texts(needles: DataFrame, texts: DataFrame, words) -> DataFrame:
    """(needle_id, text_id) where the text contains the needle literally.

    ``words`` turns a text column into an array of words.  The first and last
    word of a needle may be parts of longer words, so only inner words are
    anchors; needles without any are anchored by character grams.
    """
    split = needles.select("needle_id", "needle", words(F.col("needle")).alias("needle_words"))
    inner = F.slice(F.col("needle_words"), 2, F.greatest(F.size("needle_words") - 2, F.lit(0)))

    def anchored(wanted: DataFrame, offered: DataFrame) -> DataFrame:
        useful = offered.join(wanted.select("gram").distinct(), "gram", "left_semi")
        return _rarest(wanted, useful, "needle_id").join(useful, "gram").select("needle_id", "needle", "text_id")

    by_word = anchored(
        split.filter(F.size("needle_words") > 2).select("needle_id", "needle", F.explode(F.array_distinct(inner)).alias("gram")),
        texts.select("text_id", F.explode(F.array_distinct(words(F.col("text")))).alias("gram")),
    )
    short = split.filter(F.size("needle_words") <= 2)
    by_gram = anchored(
        short.select("needle_id", "needle", F.explode(_literal_grams(F.col("needle"))).alias("gram")),
        texts.select("text_id", F.explode(_offered_grams(F.col("text"))).alias("gram")),
    )
    candidates = by_word if short.isEmpty() else by_word.unionByName(by_gram)
    return (
        candidates.join(texts, "text_id")
        .filter(F.contains(F.col("text"), F.col("needle")))
        .select("needle_id", "text_id")
    )
