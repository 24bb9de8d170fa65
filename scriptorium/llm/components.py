"""Connected components of an edge table, by alternating stars over joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptorium.llm.common import written

MAX_ROUNDS = 60


def _attach_least(edges: DataFrame) -> DataFrame:
    """(u, v, m): every row with the smallest of its u and all v of that u."""
    least = edges.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")).withColumnRenamed("u", "k")
    return edges.join(least, edges["u"] == least["k"]).select("u", "v", "m")


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return _attach_least(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    full = _attach_least(down)
    return full.select(F.col("v").alias("u"), F.col("m").alias("v")).union(full.select("u", F.col("m").alias("v")))


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b): root is the smallest node reachable.

    Large and small stars take turns until every edge points at its root.  A hub
    is never one task's list: its minimum is an aggregation with partial sums, and
    the rest are equi-joins, which adaptive execution splits.  Each round ends in a
    table in the shared folder, so a lost executor costs one round at most.
    Loops and repeated edges are harmless; nulls are dropped; no edges give no rows.
    """
    def tidy(frame: DataFrame) -> DataFrame:
        return frame.where("u <> v").distinct()

    current = written(tidy(edges.select(F.col("a").cast("long").alias("u"), F.col("b").cast("long").alias("v"))), "edges")

    def state(frame: DataFrame):
        return tuple(frame.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    before = None
    for _ in range(MAX_ROUNDS):
        now = state(current)
        if now == before or now[0] == 0:
            break
        before = now
        current = written(tidy(_small_star(tidy(_large_star(current)))), "edges")
    else:
        raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
    roots = current.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.union(current.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
