"""Keyword search over the inverted index, for a whole frame of queries.

Every query word becomes a phrase of index terms (``a.b@c`` is the phrase
``a b c``); a query matches a chunk when at least one of its phrases occurs.
"""

from __future__ import annotations

import math
from itertools import accumulate
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scriptorium.config import EngineConfig
from scriptorium.operators.index import TextIndex, with_chunk_id
from scriptorium.operators.ranking import SCORE_DIGITS, in_wanted, score_order, top_k, wanted_categories
from scriptorium.session import pin_small

# Okapi BM25 parameters (fixed values).
K1, B = 1.2, 0.75
MIN_IDF = 1e-6
# ts_rank: weight of unlabelled positions and the limit of the sum of inverse
# squares (fixed values).
TS_WEIGHT, TS_NORM = 0.1, 1.64493406685
# Sums of inverse squares that are looked up; longer ones come from their tail.
SUMMED = 256

DEFAULTS = EngineConfig()


def query_phrases(queries: DataFrame, index: TextIndex) -> DataFrame:
    """(query_id, wanted, phrase, terms, qtf): the analysed words of each query."""
    from scriptorium.functions.text import query_words

    words = queries.select(
        "query_id", wanted_categories(queries).alias("wanted"), F.explode(query_words(F.col("query"))).alias("word")
    )
    phrases = words.select("query_id", "wanted", index.analyzer.terms(F.col("word")).alias("terms"))
    return (
        phrases.filter(F.size("terms") > 0)
        .groupBy("query_id", "wanted", F.array_join("terms", " ").alias("phrase"))
        .agg(F.count(F.lit(1)).alias("qtf"))
        .withColumn("terms", F.split("phrase", " "))
    )


# Beyond this many literals a filter in the plan costs more than it skips.
MAX_LITERAL_TERMS = 10_000


def _one_of(terms: list[str]) -> Column:
    # Terms hold letters and digits only, so they need no escaping.
    return F.expr("term IN (" + ", ".join(f"'{t}'" for t in terms) + ")") if terms else F.lit(False)


def _term_hits(index: TextIndex, few_terms: list[str] | None) -> DataFrame:
    """Postings as hits of single-term phrases; the join with the query
    phrases comes later, literal terms only let the scan skip other pages."""
    postings = index.postings
    if few_terms is not None and len(few_terms) <= MAX_LITERAL_TERMS:
        postings = postings.filter(_one_of(few_terms))
    return postings.withColumnRenamed("term", "phrase")


def _phrase_hits(index: TextIndex, phrases: DataFrame, chunks: DataFrame) -> DataFrame:
    """Occurrences of the multi-term phrases, one row per (phrase, chunk).

    Chunks that hold every term of a phrase come from the postings; only those
    are tokenised again to see whether the terms stand side by side.
    """
    multi = phrases.filter(F.size("terms") > 1).select("phrase", "terms").distinct()
    wanted = multi.select("phrase", F.explode(F.array_distinct("terms")).alias("term"))
    needed = multi.select("phrase", F.size(F.array_distinct("terms")).alias("n_terms"))
    candidates = (
        index.postings.join(wanted, "term")
        .groupBy("phrase", "chunk_id", "category", "doc_len", *index.location())
        .agg(F.count(F.lit(1)).alias("found"))
        .join(needed, "phrase")
        .filter(F.col("found") == F.col("n_terms"))
        .join(multi, "phrase")
        .drop("found", "n_terms")
    )
    # Each candidate chunk is tokenised once; every term stands between spaces,
    # so that a look-ahead counts phrase occurrences, overlapping ones too.
    def spaced(terms: Column) -> Column:
        return F.concat(F.lit(" "), F.array_join(terms, "  "), F.lit(" "))

    texts = with_chunk_id(chunks).join(candidates.select("chunk_id").distinct(), "chunk_id", "left_semi")
    tokenised = texts.select(
        "chunk_id",
        spaced(index.analyzer.terms(F.col("title"))).alias("spaced_title"),
        spaced(index.analyzer.terms(F.col("content"))).alias("spaced_content"),
    )
    at_phrase = F.concat(F.lit("(?="), spaced(F.col("terms")), F.lit(")"))
    return (
        tokenised.join(candidates, "chunk_id")
        .select(
            "phrase",
            "chunk_id",
            "category",
            *index.location(),
            "doc_len",
            F.regexp_count("spaced_title", at_phrase).cast("long").alias("tf_title"),
            F.regexp_count("spaced_content", at_phrase).cast("long").alias("tf_content"),
        )
        .filter(F.col("tf_title") + F.col("tf_content") > 0)
    )


class Matches(NamedTuple):
    """Analysed queries with their postings; ``small`` means the phrases are
    proven to fit a broadcast."""

    phrases: DataFrame
    hits: DataFrame
    singles: list[str] | None
    small: bool

    def asked(self, frame: DataFrame) -> DataFrame:
        """A frame of at most one row per query phrase, as a join side."""
        return F.broadcast(frame) if self.small else frame


def match_phrases(
    index: TextIndex, queries: DataFrame, chunks: DataFrame, config: EngineConfig = DEFAULTS
) -> Matches:
    phrases = query_phrases(queries, index)
    pinned = pin_small(phrases, config.small_rows, config.small_bytes)
    if pinned is None:
        hits = _term_hits(index, None).unionByName(_phrase_hits(index, phrases, chunks))
        return Matches(phrases, hits, None, False)
    singles = sorted({r["phrase"] for r in pinned.rows if len(r["terms"]) == 1})
    hits = _term_hits(index, singles)
    if any(len(r["terms"]) > 1 for r in pinned.rows):
        hits = hits.unionByName(_phrase_hits(index, pinned.frame, chunks))
    return Matches(pinned.frame, hits, singles, True)


def document_frequency(index: TextIndex, found: Matches) -> DataFrame:
    """(phrase, df): read for single terms, counted for longer phrases."""
    terms = index.terms.filter(F.col("term") != "")
    if found.singles is not None and len(found.singles) <= MAX_LITERAL_TERMS:
        terms = terms.filter(_one_of(found.singles))
    longer = found.phrases.filter(F.size("terms") > 1).select("phrase").distinct()
    counted = (
        found.hits.join(found.asked(longer), "phrase", "left_semi")
        .groupBy("phrase")
        .agg(F.count(F.lit(1)).alias("df"))
    )
    single = terms.groupBy(F.col("term").alias("phrase")).agg(F.sum("df").alias("df"))
    return single.unionByName(counted)


def bm25_scores(
    index: TextIndex,
    queries: DataFrame,
    chunks: DataFrame,
    config: EngineConfig = DEFAULTS,
) -> DataFrame:
    """(query_id, chunk_id, score) of every matching pair."""
    found = match_phrases(index, queries, chunks, config)
    corpus = index.corpus_size()
    n_chunks = corpus.select("n_chunks").scalar()
    mean_len = corpus.select("mean_len").scalar()
    idf = F.greatest(F.ln((n_chunks - F.col("df") + 0.5) / (F.col("df") + 0.5)), F.lit(MIN_IDF))
    weighted = (
        document_frequency(index, found)
        .join(found.asked(found.phrases), "phrase")
        .select("phrase", "query_id", "wanted", (F.col("qtf") * idf).alias("weight"))
    )
    tf = config.title_weight * F.col("tf_title") + config.content_weight * F.col("tf_content")
    saturation = tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("doc_len") / mean_len))
    # Saturation depends on the chunk alone, so it is computed before the join
    # that multiplies a posting by the queries that ask for it.
    return (
        found.hits.select("phrase", "chunk_id", "category", *index.location(), saturation.alias("saturation"))
        .join(found.asked(weighted), "phrase")
        .filter(in_wanted())
        .groupBy("query_id", "chunk_id", *index.location())
        .agg(F.round(F.sum(F.col("weight") * F.col("saturation")), SCORE_DIGITS).alias("score"))
    )


def inverse_squares(n: Column) -> Column:
    """The sum of 1/j^2 for j from 1 to n: looked up, and beyond SUMMED all of it less the
    tail, whose asymptotic series is exact to a double there."""
    sums = list(accumulate(1.0 / (j * j) for j in range(1, SUMMED + 1)))
    x = n.cast("double") + 1
    tail = 1 / x + 1 / (2 * x * x) + 1 / (6 * F.pow(x, F.lit(3.0)))
    looked_up = F.get(F.array([F.lit(s) for s in sums]), (n - 1).cast("int"))
    return F.when(n <= SUMMED, looked_up).otherwise(F.lit(math.pi**2 / 6) - tail)


def ts_rank_scores(
    index: TextIndex,
    queries: DataFrame,
    chunks: DataFrame,
    config: EngineConfig = DEFAULTS,
    max_positions: int | None = None,
) -> DataFrame:
    """(query_id, chunk_id, score) by the OR form of ts_rank.

    A term that occurs n times contributes the sum of 1/j^2 for j up to n; the
    total is divided by the number of distinct query terms.  All occurrences count unless
    ``max_positions`` bounds them.
    """
    found = match_phrases(index, queries, chunks, config)
    occurrences = F.col("tf_title") + F.col("tf_content")
    if max_positions is not None:
        occurrences = F.least(occurrences, F.lit(max_positions))
    per_term = inverse_squares(occurrences) * (TS_WEIGHT / TS_NORM)
    n_terms = found.phrases.groupBy("query_id").agg(F.count(F.lit(1)).alias("n_terms"))
    wanted = found.phrases.join(n_terms, "query_id").select(
        "phrase", "query_id", "wanted", "n_terms"
    )
    return (
        found.hits.select("phrase", "chunk_id", "category", *index.location(), per_term.alias("part"))
        .join(found.asked(wanted), "phrase")
        .filter(in_wanted())
        .groupBy("query_id", "chunk_id", *index.location())
        .agg(F.round(F.sum(F.col("part") / F.col("n_terms")), SCORE_DIGITS).alias("score"))
    )


def attach_chunks(hits: DataFrame, chunks: DataFrame, small: bool = False) -> DataFrame:
    """Add the stored columns to ranked hits; texts are read only here.

    Hits that carry the partition of their chunk prune the scan to it.
    """
    keys = ["chunk_id", *[c for c in ("bucket",) if c in hits.columns and c in chunks.columns]]
    stored = with_chunk_id(chunks).select(*keys, "file_path", "chunk_index", "title", "content", "category")
    return stored.join(F.broadcast(hits) if small else hits, keys).drop("bucket")


def bounded_queries(queries: DataFrame, k: int, config: EngineConfig) -> tuple[DataFrame, bool]:
    """The queries, local when small, and whether ``k`` hits of each stay small."""
    pinned = pin_small(queries, config.small_rows, config.small_bytes)
    if pinned is None:
        return queries, False
    return pinned.frame, len(pinned.rows) * k <= config.small_rows


def keyword_search(
    index: TextIndex,
    queries: DataFrame,
    chunks: DataFrame,
    k: int = 5,
    config: EngineConfig = DEFAULTS,
    ranker=bm25_scores,
    by_document: bool = False,
    within: DataFrame | None = None,
) -> DataFrame:
    """The first ``k`` hits of each query, best first.

    ``within`` limits the search to the chunks it lists by ``chunk_id``.  With
    ``by_document`` a document counts once, with its best chunk; all scored chunks
    take part, so ``k`` documents come out wherever so many match.
    """
    queries, small = bounded_queries(queries, k, config)
    scores = ranker(index, queries, chunks, config)
    if within is not None:
        scores = scores.join(within.select("chunk_id"), "chunk_id", "left_semi")
    if by_document:
        paths = with_chunk_id(chunks).select("chunk_id", F.col("file_path").alias("document")).where("document IS NOT NULL")
        scores = top_k(scores.join(paths, "chunk_id"), ["query_id", "document"], score_order(), 1).drop("rank", "document")
    best = top_k(scores, ["query_id"], score_order(), k)
    return attach_chunks(best, chunks, small)
