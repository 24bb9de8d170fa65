"""What the operators of this folder share: text columns, folds and Arrow batches."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.session import written

__all__ = ["documents", "held_out", "learnable", "lower_ascii", "same", "small_batches", "text_of", "written"]

# Rows of one Arrow batch: whole texts travel in it, so it is kept far below Spark's default.
BATCH_ROWS = 500
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def documents(spark: SparkSession, sf_dir: str, name: str = "documents") -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def small_batches(df: DataFrame) -> DataFrame:
    """Bound the rows of the Arrow batches that the session's Python stages receive."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return df


def text_of(df: DataFrame) -> Column:
    """The whole text; null counts as empty."""
    return F.coalesce(df["text"].cast("string"), F.lit(""))


def lower_ascii(text: Column) -> Column:
    """Lower-case A-Z and nothing else."""
    return F.translate(text, UPPER, UPPER.lower())


def fold(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string")) % 3


def held_out(doc_id: Column) -> Column:
    """Rows whose labels must never be learned from; a null id is not one of them."""
    return F.coalesce(fold(doc_id) == 1, F.lit(False))


def learnable(doc_id: Column) -> Column:
    """Rows whose labels may be learned from; a null id is not one of them."""
    return F.coalesce(fold(doc_id) != 1, F.lit(False))


def same(left: Column, right: Column) -> Column:
    """Equality for which two nulls are equal; Spark joins on it by key."""
    return left.eqNullSafe(right)
