"""Schemas of the stored tables and of the frames that operators exchange."""

from __future__ import annotations

from pyspark.sql import types as T

CHUNKS = T.StructType(
    [
        T.StructField("file_path", T.StringType()),
        T.StructField("chunk_index", T.IntegerType()),
        T.StructField("title", T.StringType()),
        T.StructField("content", T.StringType()),
        T.StructField("category", T.StringType()),
        T.StructField("audience", T.StringType()),
        T.StructField("tags", T.ArrayType(T.StringType())),
        T.StructField("content_hash", T.StringType()),
        T.StructField("embedding", T.ArrayType(T.FloatType())),
        T.StructField("created_at", T.TimestampType()),
        T.StructField("updated_at", T.TimestampType()),
    ]
)

LINKS = T.StructType(
    [
        T.StructField("source_path", T.StringType()),
        T.StructField("target_path", T.StringType()),
        T.StructField("relation_type", T.StringType()),
        T.StructField("created_at", T.TimestampType()),
    ]
)

ACCESS_LOG = T.StructType(
    [
        T.StructField("file_path", T.StringType()),
        T.StructField("query", T.StringType()),
        T.StructField("tool", T.StringType()),
        T.StructField("tokens_returned", T.LongType()),
        T.StructField("tokens_baseline", T.LongType()),
        T.StructField("accessed_at", T.TimestampType()),
    ]
)

CRAWL_CACHE = T.StructType(
    [
        T.StructField("url", T.StringType()),
        T.StructField("etag", T.StringType()),
        T.StructField("last_modified", T.StringType()),
        T.StructField("hash", T.StringType()),
        T.StructField("timestamp", T.DoubleType()),
    ]
)

QUERIES = T.StructType(
    [
        T.StructField("query_id", T.LongType()),
        T.StructField("query", T.StringType()),
        T.StructField("category", T.StringType()),
        T.StructField("query_embedding", T.ArrayType(T.FloatType())),
    ]
)

COMMITS = T.StructType(
    [
        T.StructField("hash", T.StringType()),
        T.StructField("author", T.StringType()),
        T.StructField("author_email", T.StringType()),
        T.StructField("date", T.StringType()),
        T.StructField("subject", T.StringType()),
        T.StructField("body", T.StringType()),
        T.StructField("files", T.ArrayType(T.StringType())),
    ]
)

# Relation types allowed in typed frontmatter (fixed values).
TYPED_RELATIONS = (
    "related",
    "prerequisite",
    "depends_on",
    "summarizes",
    "summarized_by",
    "extends",
    "extended_by",
    "replaces",
    "replaced_by",
    "audited_by",
    "audits",
    "implements",
    "implemented_by",
    "tests",
    "tested_by",
    "example_of",
    "references",
)


def with_missing_columns(df, schema: T.StructType):
    """Bring ``df`` to ``schema``: absent columns come in as typed NULLs."""
    from pyspark.sql import functions as F

    return df.select(
        *[
            (F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in schema.fields
        ]
    )
