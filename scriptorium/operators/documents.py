"""Documents as ordered chunks: lookup, reassembly, listings, totals, export."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptorium.functions.text import token_estimate


def union_tables(tables: list[DataFrame]) -> DataFrame:
    """One scan over several chunk tables; filters reach every branch."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)


def get_chunks(chunks: DataFrame, path: str) -> DataFrame:
    return chunks.filter(F.col("file_path") == path).orderBy("chunk_index")


def _ordered(column: str):
    pairs = F.array_sort(F.collect_list(F.struct("chunk_index", column)))
    return F.transform(pairs, lambda p: p[column])


def reassemble(chunks: DataFrame) -> DataFrame:
    """One row per document: its chunks in order, joined by blank lines.

    Title, category, audience come from the first chunk.  A document is bounded
    by its size limit, so its group is too.
    """
    first = [c for c in ("title", "category", "audience", "tags") if c in chunks.columns]
    return chunks.groupBy("file_path").agg(
        *[F.min_by(c, "chunk_index").alias(c) for c in first],
        F.array_join(_ordered("content"), "\n\n").alias("content"),
        F.count(F.lit(1)).alias("chunks"),
    )


def get_documents(chunks: DataFrame, paths: DataFrame, max_length: int | None = None) -> DataFrame:
    """Whole documents for a frame of paths, cut to ``max_length`` when asked."""
    docs = reassemble(chunks.join(paths.select("file_path").distinct(), "file_path", "left_semi"))
    cut = F.lit(False) if max_length is None else F.length("content") > max_length
    full = F.col("content")
    shown = F.when(cut, F.concat(F.substring(full, 1, max_length or 0), F.lit("..."))).otherwise(full)
    return docs.withColumns(
        {
            "content": shown,
            "truncated": cut,
            "tokens_returned": token_estimate(shown),
            "tokens_baseline": token_estimate(full),
        }
    )


def list_documents(chunks: DataFrame) -> DataFrame:
    """Per path the least title and category, and the number of chunks."""
    return (
        chunks.groupBy("file_path")
        .agg(F.min("title").alias("title"), F.min("category").alias("category"), F.count(F.lit(1)).alias("chunks"))
        .orderBy("category", "file_path")
    )


def list_categories(chunks: DataFrame) -> DataFrame:
    return (
        chunks.filter(F.col("category").isNotNull())
        .groupBy("category")
        .agg(F.countDistinct("file_path").alias("docs"))
        .orderBy("category")
    )


def corpus_totals(chunks: DataFrame, links: DataFrame) -> DataFrame:
    """One row: documents, chunks, embedded chunks, characters, links."""
    embedded = F.count("embedding") if "embedding" in chunks.columns else F.lit(0).cast("long")
    totals = chunks.agg(
        F.countDistinct("file_path").alias("docs"),
        F.count(F.lit(1)).alias("chunks"),
        embedded.alias("embedded_chunks"),
        F.coalesce(F.sum(F.length("content")), F.lit(0)).cast("long").alias("content_chars"),
    )
    n_links = links.agg(F.count(F.lit(1)).alias("links")).scalar()
    return totals.withColumn("links", n_links)


def category_totals(chunks: DataFrame) -> DataFrame:
    """Documents and chunks per category, chunks without one included."""
    return (
        chunks.groupBy("category")
        .agg(F.countDistinct("file_path").alias("docs"), F.count(F.lit(1)).alias("chunks"))
        .orderBy(F.col("docs").desc(), "category")
    )


def export_documents(chunks: DataFrame, category: str | None = None) -> DataFrame:
    """(file_path, title, category, content, chunks), content right-stripped."""
    if category:
        chunks = chunks.filter(F.col("category") == category)
    docs = reassemble(chunks)
    return docs.select(
        "file_path", "title", "category", F.regexp_replace("content", r"\s+$", "").alias("content"), "chunks"
    )


def as_markdown(docs: DataFrame) -> DataFrame:
    """Exported documents as one markdown text each."""
    def shown(column: str):
        return F.coalesce(F.col(column), F.lit("None"))

    head = F.concat(
        F.lit("---\nfile_path: "),
        "file_path",
        F.lit("\ntitle: "),
        shown("title"),
        F.lit("\ncategory: "),
        shown("category"),
        F.lit("\n---\n\n"),
    )
    return docs.select("file_path", F.concat(head, "content", F.lit("\n\n")).alias("value"))


def pending_embeddings(chunks: DataFrame) -> DataFrame:
    return chunks.filter(F.col("embedding").isNull())
