"""Usage analytics over the access log.  ``as_of`` is always explicit."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scriptorium.functions.text import preview, token_estimate
from scriptorium.session import pin_small


def _moment(as_of: Column | datetime | str) -> Column:
    return as_of if isinstance(as_of, Column) else F.lit(as_of).cast("timestamp")


def since(log: DataFrame, as_of, days: int) -> DataFrame:
    return log.filter(F.col("accessed_at") >= _moment(as_of) - F.make_dt_interval(days=F.lit(days)))


def latest(log: DataFrame) -> Column:
    """The newest event of the log as a scalar."""
    return log.agg(F.max("accessed_at")).scalar()


def head_chunks(chunks: DataFrame) -> DataFrame:
    return chunks.filter(F.col("chunk_index") == 0)


def access_counts(log: DataFrame, as_of, days: int = 30) -> DataFrame:
    """(file_path, access_count, last_accessed) of every path in the window."""
    return since(log, as_of, days).groupBy("file_path").agg(
        F.count(F.lit(1)).alias("access_count"), F.max("accessed_at").alias("last_accessed")
    )


def top_accessed(
    log: DataFrame, chunks: DataFrame, as_of, limit: int = 10, days: int = 30, category: str | None = None
) -> DataFrame:
    """The most accessed paths of the window with their first chunk's title."""
    counts = access_counts(log, as_of, days)
    order = [F.col("access_count").desc(), F.col("file_path")]
    if category:
        # Counting comes first: it shrinks the log to one row per path before
        # the join, and spreads a path that holds most of the events.
        heads = head_chunks(chunks).filter(F.col("category") == category).select("file_path", "title", "category")
        return counts.join(heads, "file_path").orderBy(*order).limit(limit)
    return with_heads(counts.orderBy(*order).limit(limit), chunks, limit, ["title", "category"]).orderBy(*order)


# Paths that are written into a filter.
LITERAL_PATHS = 1000


def with_heads(top: DataFrame, chunks: DataFrame, limit: int, columns: list) -> DataFrame:
    """Add columns of the first chunk to at most ``limit`` rows by ``file_path``.

    A few paths become literals, so the scan of the chunks skips the rest; more are joined.
    """
    heads = head_chunks(chunks)
    small = pin_small(top, min(limit, LITERAL_PATHS), 2**24)
    if small is None:
        return top.join(heads.select("file_path", *columns), "file_path", "left")
    heads = heads.filter(F.col("file_path").isin([r["file_path"] for r in small.rows])).select("file_path", *columns)
    return small.frame.join(F.broadcast(heads), "file_path", "left")


def savings_total(log: DataFrame, as_of, days: int = 30) -> DataFrame:
    def total(column: str) -> Column:
        return F.coalesce(F.sum(column), F.lit(0)).cast("long")

    sums = since(log, as_of, days).agg(
        F.count(F.lit(1)).alias("calls"),
        total("tokens_returned").alias("tokens_returned"),
        total("tokens_baseline").alias("tokens_baseline"),
    )
    saved = F.greatest(F.lit(0).cast("long"), F.col("tokens_baseline") - F.col("tokens_returned"))
    return sums.withColumn("tokens_saved", saved)


def savings_by_tool(log: DataFrame, as_of, days: int = 30) -> DataFrame:
    saved = F.greatest(F.lit(0).cast("long"), F.col("tokens_baseline") - F.col("tokens_returned"))
    return (
        since(log, as_of, days)
        .filter(F.col("tokens_baseline").isNotNull() & F.col("tokens_returned").isNotNull())
        .groupBy("tool")
        .agg(F.count(F.lit(1)).alias("calls"), F.coalesce(F.sum(saved), F.lit(0)).cast("long").alias("tokens_saved"))
        .orderBy(F.col("calls").desc(), "tool")
    )


def purge(log: DataFrame, as_of, days: int = 90) -> DataFrame:
    """The log without the events older than ``days`` days."""
    return since(log, as_of, days)


def annotate_access(hits: DataFrame, counts: DataFrame, chars: int = 200) -> DataFrame:
    """Search hits in their order, each with its access count or zero."""
    counts = counts.select("file_path", "access_count")
    return hits.join(counts, "file_path", "left").select(
        "query_id",
        "rank",
        "file_path",
        "title",
        "category",
        preview(F.col("content"), chars).alias("summary"),
        F.coalesce("access_count", F.lit(0)).cast("long").alias("access_count"),
    )


def primer(log: DataFrame, chunks: DataFrame, as_of, limit: int = 10, category: str | None = None, chars: int = 200):
    """The most accessed documents of 30 days with a summary of their first chunk."""
    top = top_accessed(log, chunks, as_of, limit, 30, category)
    summary = preview(F.col("content"), chars).alias("summary")
    return with_heads(top, chunks, limit, [summary]).select(
        "file_path", "title", "category", F.coalesce("summary", F.lit("")).alias("summary"), "access_count"
    )


def access_events(hits: DataFrame, chunks: DataFrame, now, tool: str = "search_docs", top: int | None = None, chars: int = 200):
    """Log rows for the hits of each query, all or the ``top`` ones, with their token ledger."""
    shown = hits if top is None else hits.filter(F.col("rank") <= top)
    paths = shown.select("file_path").distinct()
    baseline = (
        chunks.join(paths, "file_path", "left_semi")
        .groupBy("file_path")
        .agg(F.sum(token_estimate(F.col("content"))).cast("long").alias("tokens_baseline"))
    )
    return shown.join(baseline, "file_path", "left").select(
        "file_path",
        "query",
        F.lit(tool).alias("tool"),
        token_estimate(preview(F.col("content"), chars)).alias("tokens_returned"),
        F.coalesce("tokens_baseline", F.lit(0)).cast("long").alias("tokens_baseline"),
        _moment(now).alias("accessed_at"),
    )
