"""Retrieval quality: hit rate, MRR, precision, nDCG, recall."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scriptorium.operators.ranking import top_k

DIGITS = 6


def per_query_metrics(hits: DataFrame, qrels: DataFrame, k: int = 10) -> DataFrame:
    """Metrics of each judged query.

    ``hits`` is (query_id, doc, rank), ``qrels`` is (query_id, doc, gain) with
    positive gains.  Queries without any relevant document are not scored.
    """
    shown = hits.filter(F.col("rank") <= k).select("query_id", "doc", "rank")
    marked = shown.join(qrels.select("query_id", "doc", "gain"), ["query_id", "doc"], "left")
    found = marked.groupBy("query_id").agg(
        F.count(F.lit(1)).alias("n_returned"),
        F.count("gain").alias("n_found"),
        F.min(F.when(F.col("gain").isNotNull(), F.col("rank"))).alias("first_rank"),
        F.sum(F.col("gain") / F.log2(F.col("rank") + 1)).alias("dcg"),
    )
    # Only the k best gains of a query enter its ideal ranking.
    totals = qrels.groupBy("query_id").agg(F.count(F.lit(1)).alias("n_relevant"))
    best = top_k(qrels, ["query_id"], [F.col("gain").desc(), F.col("doc")], k, "place")
    ideal = best.groupBy("query_id").agg(F.sum(F.col("gain") / F.log2(F.col("place") + 1)).alias("ideal_dcg"))
    joined = totals.join(ideal, "query_id").join(found, "query_id", "left")

    def value(expr: Column) -> Column:
        return F.round(F.coalesce(expr, F.lit(0.0)), DIGITS)

    return joined.select(
        "query_id",
        F.coalesce((F.col("n_found") > 0).cast("int"), F.lit(0)).cast("double").alias("hit"),
        value(1.0 / F.col("first_rank")).alias("reciprocal_rank"),
        value(F.col("n_found") / F.col("n_returned")).alias("precision"),
        value(F.col("n_found") / F.col("n_relevant")).alias("recall"),
        value(F.col("dcg") / F.col("ideal_dcg")).alias("ndcg"),
    )


def summary(metrics: DataFrame) -> DataFrame:
    names = {"hit": "hit_rate", "reciprocal_rank": "mrr", "precision": "mean_precision", "recall": "recall", "ndcg": "ndcg"}
    return metrics.agg(
        F.count(F.lit(1)).alias("queries"),
        *[F.round(F.coalesce(F.avg(c), F.lit(0.0)), DIGITS).alias(n) for c, n in names.items()],
    )


def path_relevance(hits: DataFrame, cases: DataFrame, k: int = 5) -> DataFrame:
    """Per case metrics where a hit is relevant when its path contains one of
    the expected substrings, whatever the letter case."""
    shown = hits.filter(F.col("rank") <= k).join(cases.select("query_id", "expected_paths"), "query_id")
    relevant = F.exists("expected_paths", lambda p: F.contains(F.lower("file_path"), F.lower(p)))
    scored = shown.groupBy("query_id").agg(
        F.count(F.lit(1)).alias("n_returned"),
        F.count_if(relevant).alias("n_found"),
        F.min(F.when(relevant, F.col("rank"))).alias("first_rank"),
    )
    return cases.select("query_id").join(scored, "query_id", "left").select(
        "query_id",
        (F.coalesce("n_found", F.lit(0)) > 0).cast("double").alias("hit"),
        F.round(F.coalesce(1.0 / F.col("first_rank"), F.lit(0.0)), DIGITS).alias("reciprocal_rank"),
        F.round(F.coalesce(F.col("n_found") / F.col("n_returned"), F.lit(0.0)), DIGITS).alias("precision"),
    )


def latency_percentiles(latencies: DataFrame, points: tuple[float, ...] = (0.5, 0.95, 0.99)) -> DataFrame:
    """The value at index floor(p * n) of the sorted ``ms`` column, per point.

    Values are taken to the microsecond, which bounds how many distinct ones
    the percentile aggregate has to hold.
    """
    n = latencies.count()
    if n == 0:
        return latencies.select(*[F.lit(None).cast("double").alias(f"p{round(p * 100)}") for p in points]).limit(0)
    ms = F.round(F.col("ms"), 3)
    wanted = {f"p{round(p * 100)}": (min(int(p * n), n - 1) + 0.5) / n for p in points}
    ordered = latencies.select(ms.alias("ms"))
    return ordered.agg(*[F.expr(f"percentile_disc({q!r}) WITHIN GROUP (ORDER BY ms)").alias(c) for c, q in wanted.items()])
