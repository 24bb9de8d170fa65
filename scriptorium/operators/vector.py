"""Exact nearest neighbours by cosine, for a whole frame of query vectors."""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import arrow_udf

from scriptorium.config import EngineConfig
from scriptorium.operators.index import with_chunk_id
from scriptorium.operators.ranking import SCORE_DIGITS, score_order, top_k, wanted_categories
from scriptorium.session import pin_small

DEFAULTS = EngineConfig()
# Cells of one block of the distributed form: queries and chunks per task.
BLOCK_QUERIES, BLOCK_CHUNKS = 2_000, 50_000


def unit_rows(vectors: np.ndarray) -> np.ndarray:
    norms = np.linalg.norm(vectors, axis=1, keepdims=True)
    return vectors / np.where(norms == 0.0, 1.0, norms)


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def _objects(column: pa.Array) -> np.ndarray:
    return np.array(column.to_pylist(), dtype=object)


def _best(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k best scores, ties by id."""
    if len(scores) > k:
        kept = np.flatnonzero(scores >= np.partition(scores, -k)[-k])
    else:
        kept = np.arange(len(scores))
    order = heapq.nsmallest(k, kept, key=lambda i: (-scores[i], ids[i]))
    return np.array(order, dtype=np.int64)


def _scan(batches, query_ids: list, wanted: list, queries: np.ndarray, k: int) -> Iterator[tuple]:
    """Running top-k of every query over the batches of one task.

    A query with wanted categories only sees the vectors of those.
    """
    best_ids = [np.array([], dtype=object) for _ in query_ids]
    best_scores = [np.array([]) for _ in query_ids]
    for ids, categories, vectors in batches:
        scores = np.round(queries @ unit_rows(vectors).T, SCORE_DIGITS) + 0.0
        for q in range(len(query_ids)):
            own_ids, own = ids, scores[q]
            if wanted[q] is not None:
                inside = np.flatnonzero(pd.Series(categories).isin(list(wanted[q])))
                own_ids, own = ids[inside], own[inside]
            top = _best(own_ids, own, k)
            merged_ids = np.concatenate([best_ids[q], own_ids[top]])
            merged = np.concatenate([best_scores[q], own[top]])
            keep = _best(merged_ids, merged, k)
            best_ids[q], best_scores[q] = merged_ids[keep], merged[keep]
    for q, query_id in enumerate(query_ids):
        for cid, score in zip(best_ids[q], best_scores[q]):
            yield query_id, cid, float(score)


def _hit_schema(queries: DataFrame) -> T.StructType:
    return T.StructType(
        [
            T.StructField("query_id", queries.schema["query_id"].dataType),
            T.StructField("chunk_id", T.BinaryType()),
            T.StructField("score", T.DoubleType()),
        ]
    )


def _scan_with_all_queries(queries, vectors: DataFrame, schema: T.StructType, k: int) -> DataFrame:
    """Every task scans its vectors against the whole small query matrix."""
    ids = [r["query_id"] for r in queries]
    wanted = [r["wanted"] for r in queries]
    matrix = unit_rows(np.array([r["query_embedding"] for r in queries], dtype=np.float64))
    if not ids:
        return vectors.sparkSession.createDataFrame([], schema)
    shared = vectors.sparkSession.sparkContext.broadcast((ids, wanted, matrix))

    def scan(batches):
        query_ids, query_wanted, query_matrix = shared.value
        triples = (
            (_objects(b.column("chunk_id")), _objects(b.column("category")), _matrix(b.column("embedding")))
            for b in batches
            if b.num_rows
        )
        hits = pd.DataFrame(list(_scan(triples, query_ids, query_wanted, query_matrix, k)), columns=schema.names)
        if len(hits):
            yield pa.RecordBatch.from_pydict({c: hits[c].tolist() for c in schema.names})

    return vectors.mapInArrow(scan, schema)


def _scan_in_blocks(queries: DataFrame, vectors: DataFrame, schema: T.StructType, k: int, per_block) -> DataFrame:
    """Query blocks meet chunk blocks; no side is ever whole in one task."""
    block_queries, block_chunks = per_block
    n_query_blocks = max(1, math.ceil(queries.count() / block_queries))
    n_chunk_blocks = max(1, math.ceil(vectors.count() / block_chunks))

    def blocks(n: int) -> Column:
        return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))

    def block_of(key: str, n: int) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(n)).cast("int")

    left = queries.select(
        "query_id", "wanted", "query_embedding", block_of("query_id", n_query_blocks).alias("qb"), blocks(n_chunk_blocks).alias("cb")
    )
    right = vectors.select(
        "chunk_id", "category", "embedding", block_of("chunk_id", n_chunk_blocks).alias("cb"), blocks(n_query_blocks).alias("qb")
    )

    def meet(q: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        if q.empty or c.empty:
            return pd.DataFrame({name: [] for name in schema.names})
        ids = np.array([bytes(i) for i in c["chunk_id"]], dtype=object)
        matrix = unit_rows(np.vstack(q["query_embedding"]).astype(np.float64))
        triples = [(ids, c["category"].to_numpy(dtype=object), np.vstack(c["embedding"]).astype(np.float64))]
        hits = _scan(triples, q["query_id"].tolist(), q["wanted"].tolist(), matrix, k)
        return pd.DataFrame(list(hits), columns=schema.names)

    return left.groupBy("qb", "cb").cogroup(right.groupBy("qb", "cb")).applyInPandas(meet, schema)


def nearest_scores(
    queries: DataFrame,
    vectors: DataFrame,
    k: int,
    config: EngineConfig = DEFAULTS,
    within_category: bool = False,
    per_block: tuple[int, int] = (BLOCK_QUERIES, BLOCK_CHUNKS),
) -> DataFrame:
    """(query_id, chunk_id, score, rank): the ``k`` nearest chunks by cosine.

    ``vectors`` needs ``embedding`` and either ``chunk_id`` or the path columns.
    Each task returns at most ``k`` hits per query, so the ranking shuffle does
    not grow with the corpus.  ``within_category`` searches each query's own
    categories only.
    """
    schema = _hit_schema(queries)
    category = F.col("category") if within_category else F.lit(None).cast("string")
    wanted = wanted_categories(queries) if within_category else F.lit(None).cast("array<string>")
    stored = (
        with_chunk_id(vectors)
        .filter(F.col("embedding").isNotNull())
        .select("chunk_id", category.alias("category"), "embedding")
    )
    asked = queries.filter(F.col("query_embedding").isNotNull()).select(
        "query_id", wanted.alias("wanted"), "query_embedding"
    )
    pinned = pin_small(asked, min(config.small_rows, per_block[0]), config.small_bytes)
    if pinned is None:
        hits = _scan_in_blocks(asked, stored, schema, k, per_block)
    else:
        hits = _scan_with_all_queries(pinned.rows, stored, schema, k)
    return top_k(hits, ["query_id"], score_order(), k)


@arrow_udf(T.DoubleType())
def _cosine(left: pa.Array, right: pa.Array) -> pa.Array:
    known = pa.compute.and_(left.is_valid(), right.is_valid())
    at = np.flatnonzero(known.to_numpy(zero_copy_only=False))
    out = np.full(len(left), np.nan)
    if len(at):
        where = pa.array(at)
        out[at] = np.einsum("ij,ij->i", unit_rows(_matrix(left.take(where))), unit_rows(_matrix(right.take(where))))
    return pa.array(out, mask=np.isnan(out))


def cosine(left: Column, right: Column) -> Column:
    """Cosine of two array columns; NULL when either is NULL."""
    return _cosine(left, right)
