"""The search path: retrieve, rerank, diversify, collapse, cut."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptorium.config import EngineConfig
from scriptorium.functions.text import Analyzer
from scriptorium.operators import blockmax, fusion, keyword, lookup, rerank
from scriptorium.operators.blockmax import BlockIndex
from scriptorium.operators.index import TextIndex, with_chunk_id
from scriptorium.session import written

# A custom ranking: (queries, chunks, limit) -> ranked hits.
Ranking = Callable[[DataFrame, DataFrame, int], DataFrame]


@dataclass(frozen=True)
class SearchTables:
    chunks: DataFrame
    vectors: DataFrame | None
    # Searches within given chunks take the row-wise index.
    index: TextIndex | BlockIndex
    # The chunks a keyword search is limited to, by chunk_id; all when None.
    within: DataFrame | None = None


def clean_queries(queries: DataFrame, config: EngineConfig) -> DataFrame:
    """Stripped queries without the empty ones; overlong ones fail where a length is set."""
    trimmed = queries.withColumn("query", F.btrim("query", F.lit(" \t\n\r\f\v")))
    asked = trimmed.filter(F.col("query") != "")
    if config.max_query_chars is None:
        return asked
    too_long = F.raise_error(F.lit(f"a query has more than {config.max_query_chars} characters"))
    return asked.withColumn("query", F.when(F.length("query") <= config.max_query_chars, F.col("query")).otherwise(too_long))


def retrieve(tables: SearchTables, queries: DataFrame, limit: int, config: EngineConfig, ranking: Ranking | None = None) -> DataFrame:
    """Hybrid where a query has a vector, keyword where not; keyword queries
    without a hit that look like a path are looked up among the paths."""
    if ranking is not None:
        return ranking(queries, tables.chunks, limit)
    if "query_embedding" in queries.columns and tables.vectors is not None:
        with_vector = queries.filter(F.col("query_embedding").isNotNull())
        plain = queries.filter(F.col("query_embedding").isNull()).drop("query_embedding")
        hybrid = fusion.hybrid_rrf(tables.index, with_vector, tables.chunks, tables.vectors, limit, config)
        return _shared(hybrid).unionByName(_shared(_keyword(tables, plain, limit, config)))
    return _shared(_keyword(tables, queries, limit, config))


def _shared(hits: DataFrame) -> DataFrame:
    return hits.select("query_id", "rank", "score", "file_path", "chunk_index", "title", "content", "category", "chunk_id")


def _keyword(tables: SearchTables, queries: DataFrame, limit: int, config: EngineConfig) -> DataFrame:
    if isinstance(tables.index, BlockIndex):
        if tables.within is not None:
            raise ValueError("a search within given chunks needs the row-wise index")
        queries, small = keyword.bounded_queries(queries, limit, config)
        found = blockmax.search(tables.index, queries, limit, config, by_document=config.collapse_by_doc)
        hits = keyword.attach_chunks(found.select("query_id", "chunk_id", "score", "rank"), tables.chunks, small)
    else:
        hits = keyword.keyword_search(tables.index, queries, tables.chunks, limit, config, by_document=config.collapse_by_doc, within=tables.within)
    like_path = queries.filter(F.contains("query", F.lit("/")) | F.contains("query", F.lit(".")))
    if like_path.isEmpty():
        return hits
    hits = written(_shared(hits), "hits")
    missed = like_path.join(hits.select("query_id").distinct(), "query_id", "left_anti")
    found = with_chunk_id(lookup.path_lookup(missed, tables.chunks, limit))
    return hits.unionByName(_shared(found))


def search(
    tables: SearchTables,
    queries: DataFrame,
    limit: int = 5,
    config: EngineConfig | None = None,
    scorer=None,
    use_rerank: bool | None = None,
    ranking: Ranking | None = None,
    highlights: Analyzer | None = None,
) -> DataFrame:
    config = config or EngineConfig()
    use_rerank = (config.rerank_enabled if use_rerank is None else use_rerank) and scorer is not None
    queries = clean_queries(queries, config)
    hits = retrieve(tables, queries, config.candidate_limit(limit, use_rerank), config, ranking)
    limit = config.clamp_limit(limit)
    if use_rerank:
        top = max(limit, config.rerank_pool) if config.collapse_by_doc else limit
        hits = rerank.rerank(hits, queries, scorer, top)
    if "query_embedding" in queries.columns and tables.vectors is not None:
        hits = rerank.diversify(hits, queries, with_chunk_id(tables.vectors), config.mmr_lambda)
    if config.collapse_by_doc:
        hits = rerank.collapse_by_document(hits)
    hits = rerank.truncate(hits, limit)
    return hits if highlights is None else rerank.highlight(hits, queries, highlights)
