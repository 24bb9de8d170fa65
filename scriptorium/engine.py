"""The engine: every tool as a method over one stored corpus."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.config import EngineConfig
from scriptorium.functions.markdown import packed_paragraphs
from scriptorium.functions.text import ENGLISH, PORTER, Analyzer, content_hash
from scriptorium.operators import documents, graph, history, rerank, usage
from scriptorium.operators.index import with_chunk_id
from scriptorium.plans import embed, ingest
from scriptorium.plans.search import Ranking, SearchTables, search
from scriptorium.session import written
from scriptorium.sources import files, gitlog
from scriptorium.sources.store import DocStore

__all__ = ["Engine", "ENGLISH", "PORTER"]


class Engine:
    def __init__(
        self,
        spark: SparkSession,
        root: str,
        config: EngineConfig | None = None,
        analyzer: Analyzer = PORTER,
        embedder: embed.Embedder | None = None,
        scorer: Callable | None = None,
        ranking: Ranking | None = None,
    ) -> None:
        self.spark = spark
        self.config = config or EngineConfig()
        self.store = DocStore(spark, root, self.config.store_buckets, analyzer)
        self.analyzer, self.embedder, self.scorer, self.ranking = analyzer, embedder, scorer, ranking
        self.store.init_schema()

    # -- search ---------------------------------------------------------------

    def tables(self) -> SearchTables:
        chunks = self.store.search_chunks()
        vectors = chunks.select("file_path", "chunk_index", "category", "embedding", "bucket")
        return SearchTables(chunks, vectors, self.store.index())

    def _queries(self, text: str, category: str | None, vector: list[float] | None) -> DataFrame:
        if not text.strip():
            raise ValueError("empty query")
        if self.config.max_query_chars is not None and len(text) > self.config.max_query_chars:
            raise ValueError(f"query exceeds {self.config.max_query_chars} characters")
        if vector is None and self.embedder is not None:
            vector = self.embedder([text])[0]
        columns = "query_id long, query string, category string"
        row: tuple = (0, text, category)
        if vector is not None:
            columns, row = columns + ", query_embedding array<float>", (*row, [float(x) for x in vector])
        return self.spark.createDataFrame([row], columns)

    def search_batch(self, queries: DataFrame, limit: int = 5, use_rerank: bool | None = None, highlights: bool = False) -> DataFrame:
        """Ranked hits for a frame of (query_id, query[, category, query_embedding])."""
        return search(
            self.tables(), queries, limit, self.config, self.scorer, use_rerank, self.ranking,
            self.analyzer if highlights else None,
        )

    def search_docs(self, query: str, category: str | None = None, limit: int = 5, query_embedding=None, use_rerank=None) -> DataFrame:
        asked = self._queries(query, category, query_embedding)
        hits = written(self.search_batch(asked, limit, use_rerank, highlights=True), "hits")
        if self.config.access_log:
            logged = hits.join(asked.select("query_id", "query"), "query_id")
            events = usage.access_events(
                logged, self.store.chunks(), F.current_timestamp(), "search_docs", self.config.log_top, self.config.content_preview_chars
            )
            self.store.log_access(events)
        return rerank.format_hits(hits, self.config.content_preview_chars).orderBy("rank")

    def search_git_history(self, query: str, author=None, since=None, until=None, file_path=None, limit: int = 5) -> DataFrame:
        limit = self.config.clamp_limit(limit)
        asked = self._queries(query, "git-history", None).drop("query_embedding")
        tables = self.tables()
        within = with_chunk_id(history.commit_sections(tables.chunks, author, since, until, file_path))
        hits = search(replace(tables, within=within), asked, limit, replace(self.config, collapse_by_doc=False), ranking=self.ranking)
        return rerank.format_hits(hits, self.config.content_preview_chars).orderBy("rank")

    def get_doc(self, path: str, max_length: int | None = None) -> DataFrame:
        paths = self.spark.createDataFrame([(path,)], "file_path string")
        doc = written(documents.get_documents(self.store.document_chunks(path), paths, max_length), "doc")
        if self.config.access_log:
            self.store.log_access(
                doc.select(
                    "file_path", F.lit(None).cast("string").alias("query"), F.lit("get_doc").alias("tool"),
                    "tokens_returned", "tokens_baseline", F.current_timestamp().alias("accessed_at"),
                )
            )
        return doc.drop("tokens_returned", "tokens_baseline")

    def get_related(self, path: str, depth: int = 1, relation_type: str | None = None, include_titles: bool = False, by_type: bool = False) -> DataFrame:
        starts = self.spark.createDataFrame([(path,)], "path string")
        chunks = self.store.chunks() if include_titles else None
        if by_type:
            return graph.related_by_type(self.store.links(), starts, depth, relation_type)
        return graph.related(self.store.links(), starts, depth, relation_type, chunks)

    def get_context(self, topic: str | None = None, limit: int = 10, category: str | None = None, as_of=None) -> DataFrame:
        limit = self.config.clamp_limit(limit)
        now = F.current_timestamp() if as_of is None else as_of
        log, chunks, chars = self.store.access_log(), self.store.chunks(), self.config.content_preview_chars
        if not topic:
            return usage.primer(log, chunks, now, limit, category, chars)
        hits = self.search_batch(self._queries(topic, category, None), limit)
        return usage.annotate_access(hits, usage.access_counts(log, now, 30), chars)

    def get_graph_stats(self, category: str | None = None) -> dict[str, DataFrame]:
        links, chunks = self.store.links(), self.store.chunks()
        return {
            "totals": graph.graph_totals(links, chunks),
            "relation_types": graph.relation_distribution(links),
            "hubs": graph.hubs(links, chunks),
            "orphans": graph.orphans(links, chunks, category),
        }

    # -- writes -----------------------------------------------------------------

    def _check_writable(self) -> None:
        if not self.config.writable:
            raise PermissionError("write operations are disabled; set writable=True")

    def upsert_doc(self, path: str, content: str, title=None, category=None, audience: str = "all", tags=None, embeddings=None) -> int:
        self._check_writable()
        if len(content.encode("utf-8")) > self.config.max_doc_bytes:
            raise ValueError(f"content exceeds {self.config.max_doc_bytes} bytes")
        if title is None:
            heads = (line.strip() for line in content.split("\n"))
            title = next((h[2:].strip() for h in heads if h.startswith("# ")), None)
        columns = "file_path string, text string, title string, category string, audience string, tags array<string>"
        doc = self.spark.createDataFrame([(path, content, title, category, audience, tags)], columns)
        pieces = doc.withColumn("parts", packed_paragraphs(F.col("text"), self.config.chunk_size))
        pieces = pieces.withColumn("content_hash", content_hash(F.array_join("parts", "\n")))
        chunks = pieces.select(
            "file_path", F.posexplode("parts").alias("chunk_index", "content"), "title", "category", "audience", "tags", "content_hash"
        )
        if embeddings is not None:
            if chunks.count() != len(embeddings):
                raise ValueError("one embedding per chunk is needed")
            vectors = [(i, [float(x) for x in v]) for i, v in enumerate(embeddings)]
            chunks = chunks.join(self.spark.createDataFrame(vectors, "chunk_index int, embedding array<float>"), "chunk_index")
        return self.store.replace_documents(chunks)

    def delete_doc(self, path: str) -> dict[str, int]:
        self._check_writable()
        return self.store.delete_documents(self.spark.createDataFrame([(path,)], "file_path string"))

    def update_metadata(self, path: str, title=None, category=None, audience=None, tags=None) -> int:
        self._check_writable()
        if title is None and category is None and audience is None and tags is None:
            raise ValueError("no fields to update")
        columns = "file_path string, title string, category string, audience string, tags array<string>"
        return self.store.update_metadata(self.spark.createDataFrame([(path, title, category, audience, tags)], columns))

    # -- ingestion ----------------------------------------------------------------

    def ingest_path(self, root: str, force: bool = False, dry_run: bool = False) -> DataFrame:
        return ingest.ingest_files(self.store, files.scan_files(self.spark, root), self.config, force, dry_run)

    def diff_path(self, root: str) -> DataFrame:
        return ingest.diff_files(self.store, files.scan_files(self.spark, root))

    def prune(self, root: str, dry_run: bool = False, include_crawled: bool = False) -> DataFrame:
        return ingest.prune(self.store, files.snapshot(self.spark, root), dry_run, include_crawled)

    def ingest_git_log(self, log_path: str, **options) -> DataFrame:
        heads, touched = gitlog.commit_tables(gitlog.read_log(self.spark, log_path))
        return ingest.ingest_history(self.store, heads, touched, self.config, **options)

    def crawl(self, pages: DataFrame, **options) -> DataFrame:
        return ingest.crawl_pages(self.store, pages, self.config, **options)

    def embed_pending(self, dry_run: bool = False) -> dict[str, int]:
        pending = documents.pending_embeddings(self.store.chunks())
        total = pending.count()
        if dry_run or not total or self.embedder is None:
            return {"embedded": 0, "total_null": total, "errors": 0}
        vectors = written(embed.embed_chunks(pending, self.embedder, self.config.embed_batch_size), "vectors")
        stored = self.store.set_embeddings(vectors.filter(~F.col("failed")))
        return {"embedded": stored, "total_null": total, "errors": total - stored}

    # -- listings, reports, upkeep --------------------------------------------------

    def list_docs(self) -> DataFrame:
        return documents.list_documents(self.store.chunks())

    def list_categories(self) -> DataFrame:
        return documents.list_categories(self.store.chunks())

    def stats(self) -> dict[str, DataFrame]:
        chunks = self.store.chunks()
        return {"totals": documents.corpus_totals(chunks, self.store.links()), "categories": documents.category_totals(chunks)}

    def export(self, target: str, fmt: str = "json", category: str | None = None) -> None:
        docs = documents.export_documents(self.store.chunks(), category)
        if fmt == "json":
            docs.select("file_path", "title", "category", "content").write.mode("overwrite").json(target)
        elif fmt == "csv":
            docs.select("file_path", "title", "category", "chunks").write.mode("overwrite").option("header", True).csv(target)
        elif fmt == "markdown":
            # The writer adds the last line end of each text itself.
            lines = documents.as_markdown(docs).select(F.regexp_replace("value", "\n$", "").alias("value"))
            lines.write.mode("overwrite").text(target)
        else:
            raise ValueError(f"unknown format {fmt!r}")

    def savings(self, days: int = 30, as_of=None) -> dict[str, DataFrame]:
        now, log = (F.current_timestamp() if as_of is None else as_of), self.store.access_log()
        return {"total": usage.savings_total(log, now, days), "by_tool": usage.savings_by_tool(log, now, days)}

    def cleanup(self, days: int = 90, as_of=None) -> int:
        return self.store.purge_access_log(F.current_timestamp() if as_of is None else as_of, days)

    def fix_link_types(self) -> int:
        return self.store.relabel_links()

    def check_health(self) -> dict:
        return self.store.health()
