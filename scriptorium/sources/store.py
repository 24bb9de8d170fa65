"""The stored tables: chunks with their index, links, access log, crawl cache.

Plain partitioned Parquet.  Chunks, postings and terms are partitioned by a
hash bucket of the document path, links by that of their source, the log by
day.  A change reads only the buckets it touches and writes them anew into a
generation of its own; a manifest says which generation each bucket is read
from.  The manifest of a change is published by one rename after all its tables
are written, so readers see all of a change or nothing of it, and a failed one
leaves the store as it was.  Generations pile up no further than
MAX_GENERATIONS, then the small ones are merged; ``vacuum`` removes files that
no manifest needs.  One writer at a time: a second one fails to publish.
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scriptorium import schema as S
from scriptorium.functions.text import PORTER, Analyzer
from scriptorium.operators import changes
from scriptorium.operators.index import POSTINGS, TERMS, TextIndex, compute_postings, compute_terms
from scriptorium.operators.ranking import top_k
from scriptorium.session import table_exists, written

BUCKET = T.StructField("bucket", T.IntegerType())
DAY = T.StructField("day", T.DateType())
DEFAULT_BUCKETS = 64
GENERATION = T.StructField("gen", T.StringType())
LAYOUT, MANIFEST = "layout", "manifest"
MAX_GENERATIONS = 32


BUCKETED = {"chunks": S.CHUNKS, "postings": POSTINGS, "terms": TERMS, "links": S.LINKS, "crawl_cache": S.CRAWL_CACHE}
# The column by which a bucket's files are sorted.
SORTED = {"chunks": "file_path", "postings": "term", "terms": "term", "links": "source_path"}


class DocStore:
    """``buckets`` is fixed when a store is made and kept in its layout file; opening it
    without a number takes that one, and opening it with another one fails."""

    def __init__(self, spark: SparkSession, root: str, buckets: int | None = None, analyzer: Analyzer = PORTER) -> None:
        self.spark, self.root, self.analyzer = spark, root, analyzer
        stored = self._stored_buckets()
        if stored and buckets and stored != buckets:
            raise ValueError(f"the store at {root} has {stored} buckets, not {buckets}")
        self.buckets = stored or buckets or DEFAULT_BUCKETS
        # Bucket to generation by table, while a change is under way.
        self._pending: dict[str, dict[int, str]] | None = None

    # -- layout ---------------------------------------------------------------

    def path(self, table: str) -> str:
        return os.path.join(self.root, table)

    def _stored_buckets(self) -> int | None:
        fs, target = self._fs(self.path(LAYOUT))
        if not fs.exists(target):
            return None
        stream = fs.open(target)
        try:
            return stream.readInt()
        finally:
            stream.close()

    def _keep_layout(self) -> None:
        fs, target = self._fs(self.path(LAYOUT))
        if not fs.exists(target):
            stream = fs.create(target, False)
            try:
                stream.writeInt(self.buckets)
            finally:
                stream.close()

    def _fs(self, path: str):
        jvm = self.spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        return target.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), target

    def exists(self, table: str) -> bool:
        return table_exists(self.spark, self.path(table))

    def bucket_of(self, path: Column) -> Column:
        return F.pmod(F.xxhash64(path), F.lit(self.buckets)).cast("int")

    # -- generations ------------------------------------------------------------

    def _manifests(self) -> list[int]:
        fs, target = self._fs(self.path(MANIFEST))
        if not fs.exists(target):
            return []
        names = [f.getPath().getName() for f in fs.listStatus(target)]
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and n[:1].isdigit())

    def _published(self) -> tuple[int, dict[str, dict[int, str]]]:
        """Number and content of the newest manifest."""
        known = self._manifests()
        if not known:
            return 0, {}
        fs, target = self._fs(os.path.join(self.path(MANIFEST), f"{known[-1]:020d}.json"))
        stream = fs.open(target)
        try:
            text = self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        tables = json.loads(text)
        return known[-1], {t: {b: g for g, buckets in gens.items() for b in buckets} for t, gens in tables.items()}

    def _publish(self, number: int, state: dict[str, dict[int, str]]) -> None:
        content = {table: self._by_generation(held) for table, held in state.items()}
        folder = self.path(MANIFEST)
        fs, draft = self._fs(os.path.join(folder, f".draft-{uuid.uuid4().hex}"))
        stream = fs.create(draft, False)
        try:
            stream.write(bytearray(json.dumps(content).encode()))
        finally:
            stream.close()
        _, target = self._fs(os.path.join(folder, f"{number:020d}.json"))
        if fs.exists(target) or not fs.rename(draft, target):
            raise RuntimeError(f"the store at {self.root} was changed by another writer")

    @staticmethod
    def _by_generation(held: dict[int, str]) -> dict[str, list[int]]:
        out: dict[str, list[int]] = {}
        for bucket, generation in sorted(held.items()):
            out.setdefault(generation, []).append(bucket)
        return out

    @contextmanager
    def change(self) -> Iterator[None]:
        """Everything that is written inside becomes visible together at the end, or not at all."""
        if self._pending is not None:
            yield
            return
        number, before = self._published()
        self._pending = {table: dict(held) for table, held in before.items()}
        try:
            yield
            for table, schema in BUCKETED.items():
                if len(set(self._pending.get(table, {}).values())) > MAX_GENERATIONS:
                    self._merge_small(table, schema)
            if self._pending != before:
                self._keep_layout()
                self._publish(number + 1, self._pending)
        finally:
            self._pending = None

    def _state(self) -> dict[str, dict[int, str]]:
        return self._published()[1] if self._pending is None else self._pending

    def _merge_small(self, table: str, schema: T.StructType) -> None:
        """One generation of all buckets but those of the largest generation."""
        held = self._by_generation(self._pending[table])
        largest = max(held, key=lambda g: len(held[g]))
        moved = sorted(b for g, buckets in held.items() if g != largest for b in buckets)
        rows = self._open(table, schema, BUCKET).filter(F.col("bucket").isin(moved))
        self._overwrite(table, schema, rows, moved, SORTED.get(table))

    def vacuum(self) -> int:
        """Delete the generations and manifests that the newest manifest does not need; returns
        how many.  Readers that opened an older state must have ended."""
        number, state = self._published()
        gone = 0
        for table in BUCKETED:
            used = set(state.get(table, {}).values())
            fs, target = self._fs(self.path(table))
            for entry in fs.listStatus(target) if fs.exists(target) else []:
                if entry.getPath().getName().removeprefix("gen=") not in used:
                    fs.delete(entry.getPath(), True)
                    gone += 1
        for old in self._manifests():
            if old < number:
                fs, target = self._fs(os.path.join(self.path(MANIFEST), f"{old:020d}.json"))
                fs.delete(target, False)
        return gone

    def _open(self, table: str, schema: T.StructType, partition: T.StructField) -> DataFrame:
        full = T.StructType([*schema.fields, partition])
        if partition != BUCKET:
            if not self.exists(table):
                return self.spark.createDataFrame([], full)
            return self.spark.read.schema(full).parquet(self.path(table))
        held = self._by_generation(self._state().get(table, {}))
        if not held:
            return self.spark.createDataFrame([], full)
        base = self.path(table)
        folders = [os.path.join(base, f"gen={g}") for g in held]
        rows = self.spark.read.schema(T.StructType([*full.fields, GENERATION])).option("basePath", base).parquet(*folders)
        current = F.lit(False)
        for generation, buckets in held.items():
            current = current | ((F.col("gen") == generation) & F.col("bucket").isin(buckets))
        return rows.filter(current).select(full.names)

    def init_schema(self) -> None:
        """Create every table that is missing, empty and typed."""
        self._keep_layout()
        for table, schema, partition in (
            ("chunks", S.CHUNKS, BUCKET),
            ("postings", POSTINGS, BUCKET),
            ("terms", TERMS, BUCKET),
            ("links", S.LINKS, BUCKET),
            ("crawl_cache", S.CRAWL_CACHE, BUCKET),
            ("access_log", S.ACCESS_LOG, DAY),
        ):
            if not self.exists(table):
                fs, target = self._fs(self.path(table))
                fs.mkdirs(target)

    # -- reads ------------------------------------------------------------------

    def _bucketed_chunks(self) -> DataFrame:
        return self._open("chunks", S.CHUNKS, BUCKET)

    def _bucketed_links(self) -> DataFrame:
        return self._open("links", S.LINKS, BUCKET)

    def chunks(self) -> DataFrame:
        return self._bucketed_chunks().drop("bucket")

    def chunks_near(self, paths: DataFrame, column: str = "file_path") -> DataFrame:
        """Chunks of the buckets in which ``paths`` lie: what a change to them can meet.

        Other partitions are not read, so a small change costs the same in a large store.
        """
        return self._in(self._touched(paths, column)).drop("bucket")

    def document_chunks(self, path: str) -> DataFrame:
        """Chunks of one document: only its bucket is read."""
        return self.in_bucket(self._bucketed_chunks(), path).drop("bucket").filter(F.col("file_path") == path)

    def in_bucket(self, bucketed: DataFrame, path: str) -> DataFrame:
        literal = self.spark.range(1).select(self.bucket_of(F.lit(path)).alias("b")).first()["b"]
        return bucketed.filter(F.col("bucket") == literal)

    def links(self) -> DataFrame:
        return self._bucketed_links().drop("bucket")

    def access_log(self) -> DataFrame:
        return self._open("access_log", S.ACCESS_LOG, DAY).drop("day")

    def crawl_cache(self) -> DataFrame:
        return self._open("crawl_cache", S.CRAWL_CACHE, BUCKET).drop("bucket")

    def index(self) -> TextIndex:
        terms = self._open("terms", TERMS, BUCKET)
        return TextIndex(self._open("postings", POSTINGS, BUCKET), terms.drop("bucket"), self.analyzer)

    def search_chunks(self) -> DataFrame:
        """Chunks with their bucket, by which search hits find their texts."""
        return self._bucketed_chunks()

    # -- bucket rewrites ----------------------------------------------------------

    def _touched(self, paths: DataFrame, column: str) -> list[int]:
        rows = paths.select(self.bucket_of(F.col(column)).alias("bucket")).distinct().collect()
        return sorted(r["bucket"] for r in rows)

    def _overwrite(self, table: str, schema: T.StructType, rows: DataFrame, touched: list[int], sort: str | None = None) -> None:
        """Write the touched buckets anew; inside ``change`` only."""
        full = T.StructType([*schema.fields, BUCKET])
        out = S.with_missing_columns(rows, full).hint("rebalance", "bucket")
        if sort:
            out = out.sortWithinPartitions("bucket", sort)
        generation = uuid.uuid4().hex
        out.write.partitionBy("bucket").parquet(os.path.join(self.path(table), f"gen={generation}"))
        self._pending.setdefault(table, {}).update(dict.fromkeys(touched, generation))

    def _rewrite_chunks(self, touched: list[int], change: Callable[[DataFrame], DataFrame]) -> None:
        if not touched:
            return
        with self.change():
            old = self._in(touched)
            new = change(old.drop("bucket")).withColumn("bucket", self.bucket_of(F.col("file_path")))
            self._overwrite("chunks", S.CHUNKS, new, touched, SORTED["chunks"])
            self._reindex(touched)

    def _reindex(self, touched: list[int]) -> None:
        """Bring postings and terms of the touched buckets up to date."""
        computed = compute_postings(self._in(touched), self.analyzer, ("bucket",))
        self._overwrite("postings", POSTINGS, computed, touched, SORTED["postings"])
        postings = self._open("postings", POSTINGS, BUCKET).filter(F.col("bucket").isin(touched))
        self._overwrite("terms", TERMS, compute_terms(postings, ("bucket",)), touched, SORTED["terms"])

    def _rewrite_links(self, touched: list[int], change: Callable[[DataFrame], DataFrame]) -> None:
        if not touched:
            return
        with self.change():
            old = self._bucketed_links().filter(F.col("bucket").isin(touched))
            new = change(old.drop("bucket")).withColumn("bucket", self.bucket_of(F.col("source_path")))
            self._overwrite("links", S.LINKS, new, touched, SORTED["links"])

    # -- document changes -----------------------------------------------------------

    def replace_documents(self, new: DataFrame) -> int:
        """Store ``new`` chunks in place of all chunks of their paths."""
        now = F.current_timestamp()
        full = S.with_missing_columns(new, S.CHUNKS).withColumns(
            {
                "audience": F.coalesce("audience", F.lit("all")),
                "created_at": F.coalesce("created_at", now),
                "updated_at": F.coalesce("updated_at", now),
            }
        )
        staged = written(full, "chunks")
        twice = staged.groupBy("file_path", "chunk_index").count().where("count > 1")
        if not twice.isEmpty():
            raise ValueError(f"more than one chunk has the key {tuple(twice.first())[:2]}")
        self._rewrite_chunks(self._touched(staged, "file_path"), lambda old: changes.replace_documents(old, staged))
        return staged.count()

    def delete_documents(self, paths: DataFrame) -> dict[str, int]:
        """Delete documents and every link that touches them."""
        gone = written(paths.select("file_path").distinct(), "paths")
        touched = self._touched(gone, "file_path")
        n_chunks = self._in(touched).join(gone, "file_path", "left_semi").count()
        with self.change():
            self._rewrite_chunks(touched, lambda old: old.join(gone, "file_path", "left_anti"))
            return {"chunks_deleted": n_chunks, "links_deleted": self._delete_links_of(gone)}

    def _delete_links_of(self, gone: DataFrame) -> int:
        edges = self.links().select("source_path", "target_path", "relation_type")
        ends = edges.withColumn("file_path", F.explode(F.array("source_path", "target_path")))
        cut = written(ends.join(gone, "file_path", "left_semi").drop("file_path").distinct(), "edges")
        self._rewrite_links(self._touched(cut, "source_path"), lambda old: changes.delete_documents(gone, old, gone)[1])
        return cut.count()

    def _in(self, touched: list[int]) -> DataFrame:
        return self._bucketed_chunks().filter(F.col("bucket").isin(touched))

    def update_metadata(self, updates: DataFrame) -> int:
        staged = written(updates, "updates")
        touched = self._touched(staged, "file_path")
        n_chunks = self._in(touched).join(staged, "file_path", "left_semi").count()
        self._rewrite_chunks(touched, lambda old: changes.update_metadata(old, staged))
        return n_chunks

    def insert_links(self, new: DataFrame) -> int:
        """Replace links per (source, type); returns how many were offered."""
        full = S.with_missing_columns(new, S.LINKS).withColumn("created_at", F.coalesce("created_at", F.current_timestamp()))
        staged = written(full, "links")
        self._rewrite_links(self._touched(staged, "source_path"), lambda old: changes.insert_links(old, staged))
        return staged.count()

    def replace_links_of(self, sources: DataFrame, new: DataFrame, kinds: list[str]) -> int:
        """All links of the given kinds from ``sources`` become ``new``; a
        source without any is left without."""
        full = S.with_missing_columns(new, S.LINKS).withColumn("created_at", F.current_timestamp())
        staged = written(full, "links")
        gone = written(sources.select(F.col("file_path").alias("source_path")).distinct(), "sources")

        def change(old: DataFrame) -> DataFrame:
            dropped = gone.select("source_path", F.explode(F.array(*[F.lit(k) for k in kinds])).alias("relation_type"))
            return old.join(dropped, ["source_path", "relation_type"], "left_anti").unionByName(
                staged.dropDuplicates(["source_path", "target_path", "relation_type"])
            )

        self._rewrite_links(self._touched(gone, "source_path"), change)
        return staged.count()

    def relabel_links(self) -> int:
        from scriptorium.operators.graph import relabel_history_links

        old = F.col("source_path").startswith(changes.HISTORY_PREFIX) & (F.col("relation_type") == "relates_to")
        affected = written(self.links().filter(old).select("source_path"), "sources")
        self._rewrite_links(
            self._touched(affected, "source_path"),
            lambda rows: relabel_history_links(rows).dropDuplicates(["source_path", "target_path", "relation_type"]),
        )
        return affected.count()

    def set_embeddings(self, vectors: DataFrame) -> int:
        staged = written(vectors.select("file_path", "chunk_index", "embedding"), "vectors")
        touched = self._touched(staged, "file_path")
        if touched:
            with self.change():
                old = self._in(touched)
                new = changes.set_embeddings(old.drop("bucket"), staged).withColumn("bucket", self.bucket_of(F.col("file_path")))
                self._overwrite("chunks", S.CHUNKS, new, touched, SORTED["chunks"])
        return staged.count()

    def wipe(self) -> int:
        """Remove all documents with their index and links."""
        n = self.chunks().select("file_path").distinct().count()
        with self.change():
            for table in ("chunks", "postings", "terms", "links"):
                self._pending.pop(table, None)
        return n

    # -- access log and crawl cache ---------------------------------------------------

    def log_access(self, events: DataFrame) -> None:
        full = S.with_missing_columns(events, S.ACCESS_LOG).withColumn("day", F.to_date("accessed_at"))
        full.write.mode("append").partitionBy("day").parquet(self.path("access_log"))

    def purge_access_log(self, as_of, days: int = 90) -> int:
        """Drop the days before the window whole and cut the day on its edge."""
        from scriptorium.operators.usage import _moment

        log = self._open("access_log", S.ACCESS_LOG, DAY)
        edge = _moment(as_of) - F.make_dt_interval(days=F.lit(days))
        cut = self.spark.range(1).select(edge.alias("t"), F.to_date(edge).alias("d")).first()
        old_days = [r["day"] for r in log.filter(F.col("day") <= cut["d"]).select("day").distinct().collect()]
        removed = log.filter((F.col("day") <= cut["d"]) & (F.col("accessed_at") < cut["t"])).count()
        if cut["d"] in old_days:
            kept = written(log.filter((F.col("day") == cut["d"]) & (F.col("accessed_at") >= cut["t"])), "log")
            if not kept.isEmpty():
                kept.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(
                    self.path("access_log")
                )
                old_days.remove(cut["d"])
        for day in old_days:
            fs, target = self._fs(os.path.join(self.path("access_log"), f"day={day}"))
            fs.delete(target, True)
        return removed

    def update_crawl_cache(self, entries: DataFrame) -> None:
        full = S.with_missing_columns(entries, S.CRAWL_CACHE)
        # Of rows for one address the newest counts, of equally new ones the greatest hash.
        newest = [F.col("timestamp").desc_nulls_last(), F.col("hash").desc_nulls_last(), F.col("etag").desc_nulls_last()]
        staged = written(top_k(full, ["url"], newest, 1).drop("rank"), "cache")
        touched = self._touched(staged, "url")
        if not touched:
            return
        with self.change():
            old = self._open("crawl_cache", S.CRAWL_CACHE, BUCKET).filter(F.col("bucket").isin(touched))
            new = old.drop("bucket").join(staged.select("url"), "url", "left_anti").unionByName(staged)
            self._overwrite("crawl_cache", S.CRAWL_CACHE, new.withColumn("bucket", self.bucket_of(F.col("url"))), touched)

    def health(self) -> dict:
        out: dict = {"backend": "spark", "path": self.root, "version": self.spark.version}
        for table in ("chunks", "links", "access_log", "postings"):
            out[f"{table}_table_exists"] = self.exists(table)
        chunks = self.chunks()
        row = chunks.agg(F.count(F.lit(1)).alias("n"), F.countDistinct("file_path").alias("d"), F.count("embedding").alias("v")).first()
        out.update(chunks_count=row["n"], docs_count=row["d"], vec_count=row["v"], links_count=self.links().count())
        return out
