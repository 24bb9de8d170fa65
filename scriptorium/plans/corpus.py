"""The given tables read as chunks, links, commits, access events and queries.

Every frame covers its whole table.  ``documents`` rows are one-chunk documents,
``conversations`` are documents whose turns are chunks, ``pages`` are crawled
pages, ``events`` are accesses to documents, and orders with their line items
are commits with the files they touch.
"""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.functions.text import Analyzer, content_hash
from scriptorium.operators.blockmax import BlockIndex, build_blocks, open_blocks
from scriptorium.operators.index import TextIndex, build_index, open_index
from scriptorium.session import scratch_table, table_exists


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def spread(df: DataFrame) -> DataFrame:
    """Use every core when a scan has fewer partitions than the cluster has cores.

    A large table never takes this path: its scan has more partitions already.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def document_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(
        F.concat("source", F.lit("/doc-"), "doc_id", F.lit(".md")).alias("file_path"),
        F.lit(0).alias("chunk_index"),
        F.substring_index("text", "\n", 1).alias("title"),
        F.col("text").alias("content"),
        F.col("source").alias("category"),
        F.col("lang").alias("audience"),
        content_hash(F.col("text")).alias("content_hash"),
    )


def conversation_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select(
        F.concat(F.lit("conversations/conv-"), "conv_id", F.lit(".md")).alias("file_path"),
        F.col("turn").cast("int").alias("chunk_index"),
        F.col("role").alias("title"),
        F.col("text").alias("content"),
        F.lit("conversations").alias("category"),
        F.lit("all").alias("audience"),
        content_hash(F.col("text")).alias("content_hash"),
    )


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and conversations as one multi-table scan."""
    return document_chunks(spark, sf_dir).unionByName(conversation_chunks(spark, sf_dir))


def page_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as plain text: title element, and the markup-free body."""
    html = F.col("html")
    visible = F.regexp_replace(html, r"(?s)<(script|style)[^>]*>.*?</(script|style)>|<!--.*?-->|<[^>]+>", " ")
    return table(spark, sf_dir, "pages").select(
        F.col("url").alias("file_path"),
        F.lit(0).alias("chunk_index"),
        F.regexp_extract(html, r"<title>([^<]*)</title>", 1).alias("title"),
        visible.alias("content"),
        F.lower(F.regexp_extract("url", r"^https?://([^/?#]+)", 1)).alias("category"),
        F.lit("all").alias("audience"),
        content_hash(html).alias("content_hash"),
    )


def document_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(file_path, chunk_index, category, embedding) of the embedded documents."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")
    return docs.join(vectors, "doc_id").select(
        F.concat("source", F.lit("/doc-"), "doc_id", F.lit(".md")).alias("file_path"),
        F.lit(0).alias("chunk_index"),
        F.col("source").alias("category"),
        "embedding",
    )


def text_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every benchmark passage as one query, with its whole text."""
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


def vector_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_embedding")
    )
    return text_queries(spark, sf_dir).join(vectors, "query_id")


def part_file(key: Column) -> Column:
    """The file that a part number stands for."""
    return F.concat(F.lit("parts/part-"), key, F.lit(".md"))


def commit_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(commit_id, file): every file an order-commit touches, once, by its part number.

    Numbers are exchanged, not names, and by commit alone: what is done by commit
    afterwards needs no further exchange.
    """
    touched = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey").repartition("l_orderkey").distinct()
    return touched.select(F.col("l_orderkey").alias("commit_id"), F.col("l_partkey").alias("file"))


def commit_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(commit_id, file): every file an order-commit touches, once."""
    return commit_parts(spark, sf_dir).withColumn("file", part_file(F.col("file")))


def commit_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with the names of their customers, by commit; heads are made of them."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_orderpriority", "o_orderstatus")
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    named = orders.join(customers, orders.o_custkey == customers.c_custkey, "left").drop("c_custkey")
    return named.withColumnRenamed("o_orderkey", "commit_id").repartition("commit_id")


def commit_columns() -> dict[str, Column]:
    """What a head says, out of the columns of ``commit_rows``."""
    return {
        "hash": F.sha2(F.col("commit_id").cast("string"), 256),
        "author": F.coalesce("c_name", F.lit("unknown")),
        "author_email": F.concat(F.lit("customer"), "o_custkey", F.lit("@example.com")),
        "date": F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss"),
        "subject": F.concat(F.lit("Order "), "commit_id", F.lit(" is "), "o_orderpriority"),
        "body": F.concat(F.lit("Status "), "o_orderstatus"),
    }


def commit_heads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return commit_rows(spark, sf_dir).select("commit_id", *(c.alias(name) for name, c in commit_columns().items()))


def access_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event as an access to the document its user id points to."""
    paths = table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("user_id"), F.concat("source", F.lit("/doc-"), "doc_id", F.lit(".md")).alias("file_path")
    )
    return (
        table(spark, sf_dir, "events")
        .join(paths, "user_id")
        .select(
            "file_path",
            F.lit(None).cast("string").alias("query"),
            F.col("event_type").alias("tool"),
            F.floor("value").cast("long").alias("tokens_returned"),
            (F.get_json_object("props", "$.k").cast("long") * 10).alias("tokens_baseline"),
            F.col("ts").alias("accessed_at"),
        )
    )


# Derived tables are written once per application and state of the input, then opened by
# every query that needs them.
_SHARED: dict[tuple, str] = {}
TABLES = ("documents", "conversations", "pages", "orders", "customer", "lineitem")


def input_state(spark: SparkSession, sf_dir: str) -> tuple:
    """Names, sizes and modification times of the files of the given tables."""
    out = []
    for name in TABLES:
        target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(os.path.join(sf_dir, f"{name}.parquet"))
        fs = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        if fs.exists(target):
            out += [(f.getPath().toString(), f.getLen(), f.getModificationTime()) for f in fs.listStatus(target)]
    return tuple(sorted(out))


def shared(spark: SparkSession, sf_dir: str, name: str, detail, build: Callable[[str], object]) -> str:
    """The folder of a derived table, which ``build`` writes when there is none yet."""
    key = (spark.sparkContext.applicationId, name, detail, sf_dir, input_state(spark, sf_dir))
    if key not in _SHARED or not table_exists(spark, _SHARED[key]):
        path = scratch_table(spark, f"shared-{name}")
        build(path)
        _SHARED[key] = path
    return _SHARED[key]


def shared_index(frame: DataFrame, name: str, sf_dir: str, analyzer: Analyzer) -> TextIndex:
    spark = frame.sparkSession
    path = shared(spark, sf_dir, f"index-{name}", analyzer, lambda path: build_index(frame, analyzer, path))
    return open_index(spark, path, analyzer)


def shared_blocks(frame: DataFrame, name: str, sf_dir: str, analyzer: Analyzer) -> BlockIndex:
    spark = frame.sparkSession
    path = shared(spark, sf_dir, f"blocks-{name}", analyzer, lambda path: build_blocks(frame, analyzer, path))
    return open_blocks(spark, path, analyzer)


def all_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(document_chunks(spark, sf_dir)).unionByName(spread(conversation_chunks(spark, sf_dir)))


def chunk_index(spark: SparkSession, sf_dir: str, analyzer: Analyzer) -> TextIndex:
    return shared_index(all_chunks(spark, sf_dir), "chunks", sf_dir, analyzer)


def chunk_blocks(spark: SparkSession, sf_dir: str, analyzer: Analyzer) -> BlockIndex:
    return shared_blocks(all_chunks(spark, sf_dir), "chunks", sf_dir, analyzer)
