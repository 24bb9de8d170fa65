"""The inverted index as two tables: postings and terms.

``postings`` holds one row per (term, chunk) with its counts.  It is built
without a shuffle: counts are made row by row, and every task writes a file
sorted by term, so that a query skips the pages of other terms by their
min/max statistics.  A term that occurs in a third of all chunks is spread
over all files because chunks are.  Every chunk also has one posting for the
empty term; its row in ``terms`` therefore carries the number of chunks and
the total length, and the index comes from a single pass over the text.
"""

from __future__ import annotations

import os
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scriptorium.functions.stem import term_counts
from scriptorium.functions.text import PORTER, Analyzer, chunk_id
from scriptorium.session import scratch_table

POSTINGS = T.StructType(
    [
        T.StructField("term", T.StringType()),
        T.StructField("chunk_id", T.BinaryType()),
        T.StructField("category", T.StringType()),
        T.StructField("doc_len", T.IntegerType()),
        T.StructField("tf_title", T.LongType()),
        T.StructField("tf_content", T.LongType()),
    ]
)
TERMS = T.StructType(
    [
        T.StructField("term", T.StringType()),
        T.StructField("df", T.LongType()),
        T.StructField("total_len", T.LongType()),
    ]
)


@dataclass(frozen=True)
class TextIndex:
    """``terms`` may hold several partial rows per term; their sums count."""

    postings: DataFrame
    terms: DataFrame
    analyzer: Analyzer

    def location(self) -> list[str]:
        """Partition column of the stored chunks, where the postings carry it:
        a hit then leads to its partition instead of a scan of all texts."""
        return [c for c in ("bucket",) if c in self.postings.columns]

    def corpus_size(self) -> DataFrame:
        """One row: number of chunks and their mean length in tokens."""
        return self.terms.filter(F.col("term") == "").agg(
            F.sum("df").alias("n_chunks"), (F.sum("total_len") / F.sum("df")).alias("mean_len")
        )


def with_chunk_id(chunks: DataFrame) -> DataFrame:
    if "chunk_id" in chunks.columns:
        return chunks
    return chunks.withColumn("chunk_id", chunk_id(F.col("file_path"), F.col("chunk_index")))


def compute_postings(chunks: DataFrame, analyzer: Analyzer = PORTER, keep: tuple[str, ...] = ()) -> DataFrame:
    """Postings of ``chunks``; ``keep`` names columns to carry along."""
    # All words of a chunk sit in one row, so its term counts need no shuffle.
    tokenised = (
        with_chunk_id(chunks)
        .select(
            "chunk_id",
            "category",
            *keep,
            analyzer.words(F.col("title")).alias("title_words"),
            analyzer.words(F.col("content")).alias("content_words"),
        )
        .select(
            "chunk_id",
            "category",
            *keep,
            F.size("title_words").alias("n_title"),
            F.concat("title_words", "content_words").alias("words"),
        )
    )
    counted = tokenised.select(
        "chunk_id",
        "category",
        *keep,
        F.size("words").alias("doc_len"),
        term_counts(F.col("words"), F.col("n_title"), analyzer.stem).alias("counts"),
    )
    none = F.lit(0).cast("long")
    whole_chunk = F.array(F.struct(F.lit("").alias("term"), none.alias("tf_title"), none.alias("tf_content")))
    return counted.select(
        "chunk_id", "category", *keep, "doc_len", F.inline(F.concat(whole_chunk, "counts"))
    ).select(*[f.name for f in POSTINGS.fields], *keep)


def compute_terms(postings: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    return postings.groupBy("term", *keep).agg(
        F.count(F.lit(1)).alias("df"), F.sum("doc_len").cast("long").alias("total_len")
    )


def build_index(chunks: DataFrame, analyzer: Analyzer = PORTER, path: str | None = None) -> TextIndex:
    """Write the index tables (to the shared folder by default) and open them."""
    spark = chunks.sparkSession
    path = path or scratch_table(spark, "index")
    postings_path = os.path.join(path, "postings")
    compute_postings(chunks, analyzer).sortWithinPartitions("term").write.mode("overwrite").parquet(postings_path)
    postings = spark.read.schema(POSTINGS).parquet(postings_path)
    compute_terms(postings).sortWithinPartitions("term").write.mode("overwrite").parquet(os.path.join(path, "terms"))
    return open_index(spark, path, analyzer)


def open_index(spark: SparkSession, path: str, analyzer: Analyzer = PORTER) -> TextIndex:
    return TextIndex(
        spark.read.schema(POSTINGS).parquet(os.path.join(path, "postings")),
        spark.read.schema(TERMS).parquet(os.path.join(path, "terms")),
        analyzer,
    )
