"""Per-query ranking shared by all search operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Scores are rounded before they are compared, so that equal scores stay equal
# whatever order their parts were summed in; the chunk key then breaks the tie.
SCORE_DIGITS = 6


def top_k(df: DataFrame, keys: list[str], order: list[Column], k: int | None, rank: str = "rank") -> DataFrame:
    """Number the rows of each key by ``order`` and keep the first ``k``, or all of them.

    The filter on the row number lets Spark cut every key to ``k`` rows before
    the shuffle as well, so one key with most of the rows costs no more.
    """
    window = Window.partitionBy(*keys).orderBy(*order)
    numbered = df.withColumn(rank, F.row_number().over(window))
    return numbered if k is None else numbered.filter(F.col(rank) <= k)


def score_order() -> list[Column]:
    return [F.col("score").desc(), F.col("chunk_id")]


def wanted_categories(queries: DataFrame) -> Column:
    """The categories a query is limited to, NULL for all: from an array column
    ``categories`` or a single ``category``."""
    if "categories" in queries.columns:
        return F.col("categories")
    if "category" in queries.columns:
        return F.when(F.col("category").isNotNull(), F.array("category"))
    return F.lit(None).cast("array<string>")


def in_wanted(category: str = "category", wanted: str = "wanted") -> Column:
    return F.col(wanted).isNull() | F.array_contains(F.col(wanted), F.col(category))
