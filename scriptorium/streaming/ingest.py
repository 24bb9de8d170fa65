"""Continuous ingestion: new files and fetched pages as streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from scriptorium.config import EngineConfig
from scriptorium.functions.convert import supported_suffixes
from scriptorium.functions.text import file_suffix
from scriptorium.plans import ingest
from scriptorium.sources import files as file_source
from scriptorium.sources.store import DocStore

# Poll interval of the watcher (fixed value).
INTERVAL = "1 second"
# Files of one batch, so that a first look at a large folder is worked through in parts.
FILES_PER_BATCH = 1000


def file_stream(spark: SparkSession, root: str, files_per_batch: int = FILES_PER_BATCH) -> DataFrame:
    """(file_path, mtime, length, content) of files as they appear below ``root``."""
    full, _ = file_source._qualified(spark, root)
    schema = "path string, modificationTime timestamp, length long, content binary"
    rows = (
        spark.readStream.format("binaryFile")
        .schema(schema)
        .option("recursiveFileLookup", "true")
        .option("maxFilesPerTrigger", files_per_batch)
        .load(full)
    )
    relative = F.substring(F.col("path"), len(full) + 2, 2**31 - 1)
    named = rows.select(relative.alias("file_path"), F.col("modificationTime").alias("mtime"), "length", "content")
    return named.filter(file_suffix(F.col("file_path")).isin(*supported_suffixes()))


def _newest(batch: DataFrame) -> DataFrame:
    """One row per path: a file written twice within a batch counts once."""
    return batch.groupBy("file_path").agg(F.max_by(F.struct("mtime", "length", "content"), "mtime").alias("f")).select(
        "file_path", "f.*"
    )


def watch(
    store: DocStore,
    root: str,
    checkpoint: str,
    config: EngineConfig,
    once: bool = False,
    after=None,
) -> StreamingQuery:
    """Ingest files as they appear or change.

    A replayed batch is harmless: its files carry the stored hash and are
    skipped.  Deletions are left to ``prune``.  ``after(report)`` runs per
    batch, for instance to embed what is pending.
    """

    def process(batch: DataFrame, _: int) -> None:
        if batch.isEmpty():
            return
        report = ingest.ingest_files(store, _newest(batch), config)
        if after is not None:
            after(report)

    writer = file_stream(store.spark, root).writeStream.foreachBatch(process).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=INTERVAL)).start()


def crawl_stream(store: DocStore, pages: DataFrame, checkpoint: str, config: EngineConfig, once: bool = False, **options) -> StreamingQuery:
    """Ingest a stream of fetched (url, html) pages, batch by batch."""

    def process(batch: DataFrame, _: int) -> None:
        if not batch.isEmpty():
            ingest.crawl_pages(store, batch.dropDuplicates(["url"]), config, **options)

    writer = pages.writeStream.foreachBatch(process).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=INTERVAL)).start()
