"""The access log as a stream: its sink, and trailing-window usage."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def log_stream(events: DataFrame, target: str, checkpoint: str, once: bool = False) -> StreamingQuery:
    """Append access events to the day-partitioned log."""
    rows = events.withColumn("day", F.to_date("accessed_at"))
    writer = (
        rows.writeStream.format("parquet")
        .partitionBy("day")
        .option("path", target)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
    )
    return (writer.trigger(availableNow=True) if once else writer).start()


def trailing_savings(events: DataFrame, days: int = 7, every: str = "1 day", late: str = "1 day", chained: bool = True) -> DataFrame:
    """Savings per tool over the trailing ``days``, once per ``every``.

    Works on a batch and on a stream; on a stream a window is final when the
    watermark has passed it.  Events are first summed per tool and ``every``, where each
    counts once; the long windows add up these sums, so their state is one row per tool and
    ``every``, not a copy of an event for each window that it falls into.  Two aggregations
    in a row need the append mode of a stream; ``chained=False`` makes one of them, for the
    modes that show windows before they are final.
    """
    saved = F.greatest(F.lit(0).cast("long"), F.col("tokens_baseline") - F.col("tokens_returned"))
    known = events.filter(F.col("tokens_baseline").isNotNull() & F.col("tokens_returned").isNotNull())
    marked = known.withWatermark("accessed_at", late)
    sums = [F.count(F.lit(1)).alias("calls"), F.sum(saved).alias("saved")]
    if not chained:
        direct = marked.groupBy(F.window("accessed_at", f"{days} days", every), "tool").agg(*sums)
        return direct.select(F.col("window.end").alias("as_of"), "tool", "calls", F.col("saved").cast("long").alias("tokens_saved"))
    return (
        marked.groupBy(F.window("accessed_at", every), "tool")
        .agg(*sums)
        .groupBy(F.window(F.window_time("window"), f"{days} days", every), "tool")
        .agg(F.sum("calls").alias("calls"), F.sum("saved").cast("long").alias("tokens_saved"))
        .select(F.col("window.end").alias("as_of"), "tool", "calls", "tokens_saved")
    )
