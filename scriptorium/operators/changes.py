"""Changes to the stored tables as frame-to-frame operators.

All of them take batches of keys: one row is the interactive case.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

URL_PREFIXES = ("http://", "https://")
HISTORY_PREFIX = "git-history/"


def _is_url(path: Column) -> Column:
    return path.startswith(URL_PREFIXES[0]) | path.startswith(URL_PREFIXES[1])


def replace_documents(chunks: DataFrame, new: DataFrame) -> DataFrame:
    """``new`` chunks take the place of all chunks of their paths."""
    paths = new.select("file_path").distinct()
    return chunks.join(paths, "file_path", "left_anti").unionByName(new, allowMissingColumns=True)


def delete_documents(chunks: DataFrame, links: DataFrame, paths: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Remaining chunks and links; a link goes with either of its ends."""
    gone = paths.select("file_path").distinct()
    kept = chunks.join(gone, "file_path", "left_anti")
    kept_links = links.join(gone.withColumnRenamed("file_path", "source_path"), "source_path", "left_anti").join(
        gone.withColumnRenamed("file_path", "target_path"), "target_path", "left_anti"
    )
    return kept, kept_links.select(links.columns)


def update_metadata(chunks: DataFrame, updates: DataFrame) -> DataFrame:
    """Set the non-null fields of ``updates`` on every chunk of their paths."""
    fields = [c for c in ("title", "category", "audience", "tags") if c in updates.columns and c in chunks.columns]
    new = updates.select("file_path", *[F.col(c).alias(f"new_{c}") for c in fields])
    joined = chunks.join(new, "file_path", "left")
    return joined.withColumns({c: F.coalesce(f"new_{c}", c) for c in fields}).select(chunks.columns)


def insert_links(links: DataFrame, new: DataFrame) -> DataFrame:
    """Replace the links of every (source, relation type) that ``new`` names."""
    keys = new.select("source_path", "relation_type").distinct()
    added = new.dropDuplicates(["source_path", "target_path", "relation_type"])
    return links.join(keys, ["source_path", "relation_type"], "left_anti").unionByName(added, allowMissingColumns=True)


def set_embeddings(chunks: DataFrame, vectors: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Store vectors by chunk; chunks without a new vector keep theirs."""
    keys = keys or ["file_path", "chunk_index"]
    new = vectors.select(*keys, F.col("embedding").alias("new_embedding"))
    return (
        chunks.join(new, keys, "left")
        .withColumn("embedding", F.coalesce("new_embedding", "embedding"))
        .select(chunks.columns)
    )


def stored_hashes(chunks: DataFrame) -> DataFrame:
    return chunks.groupBy("file_path").agg(F.min_by("content_hash", "chunk_index").alias("content_hash"))


def diff_documents(stored: DataFrame, disk: DataFrame) -> DataFrame:
    """(file_path, status): new, modified, deleted or unchanged.

    Both sides are (file_path, content_hash).  Crawled pages and commit
    histories never lie on disk and are left out.
    """
    ours = stored.filter(~_is_url(F.col("file_path")) & ~F.col("file_path").startswith(HISTORY_PREFIX)).select(
        "file_path", F.col("content_hash").alias("stored_hash"), F.lit(True).alias("is_stored")
    )
    theirs = disk.select("file_path", F.col("content_hash").alias("disk_hash"), F.lit(True).alias("on_disk"))
    status = (
        F.when(F.col("is_stored").isNull(), "new")
        .when(F.col("on_disk").isNull(), "deleted")
        .when(F.col("stored_hash").eqNullSafe(F.col("disk_hash")), "unchanged")
        .otherwise("modified")
    )
    return ours.join(theirs, "file_path", "full").select("file_path", status.alias("status"))


def stale_paths(stored: DataFrame, disk: DataFrame, include_crawled: bool = False) -> DataFrame:
    """Stored paths whose file is gone; absolute paths are never touched."""
    path = F.col("file_path")
    candidates = stored.select("file_path").distinct().filter(~path.startswith("/"))
    if not include_crawled:
        candidates = candidates.filter(~_is_url(path))
    return candidates.join(disk.select("file_path"), "file_path", "left_anti")


def snapshot_changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """(file_path, change) between two (file_path, mtime) snapshots."""
    before = old.select("file_path", F.col("mtime").alias("old_mtime"))
    after = new.select("file_path", F.col("mtime").alias("new_mtime"))
    change = F.when(F.col("new_mtime").isNull(), "deleted").when(
        F.col("old_mtime").isNull() | (F.col("old_mtime") != F.col("new_mtime")), "changed"
    )
    return (
        before.join(after, "file_path", "full")
        .select("file_path", change.alias("change"))
        .filter(F.col("change").isNotNull())
    )
