"""Inverted-file vectors: lists around centroids, and exact search that skips what is too far.

Vectors are unit vectors in blocks; a block holds vectors of one list, its centroid's number
and how far its farthest vector lies from the centroid.  On the unit sphere a cosine is a
distance, so by the triangle inequality no vector of a block is nearer to a query than the
centroid less that radius: a block whose bound is below a query's k-th score is skipped for
it.  The first thresholds come from each query's own list, the rest from one scan, in which
the query matrix is taken slice by slice.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.config import EngineConfig
from scriptorium.operators.index import with_chunk_id
from scriptorium.operators.ranking import SCORE_DIGITS, score_order, top_k, wanted_categories
from scriptorium.operators.vector import DEFAULTS, unit_rows
from scriptorium.session import pin_small, scratch_table, written

BLOCK_VECTORS = 4096
# Queries multiplied with a block at a time.
QUERY_SLICE = 512
# Queries of one scan, and cuts of a larger set.
QUERIES, MAX_SLICES = 20_000, 1 << 16
# Lists, and vectors of the sample from which their centroids are learned, for each list.
MAX_LISTS, SAMPLE_PER_LIST, ROUNDS = 1024, 64, 8
SEED = 7
# Scores are rounded before they are compared.
SLACK = 2 * 10.0**-SCORE_DIGITS

BLOCKS = "list int, n int, radius double, ids binary, category array<string>, matrix binary"
HITS = "asked int, chunk_id binary, score double"


@dataclass(frozen=True)
class VectorLists:
    blocks: DataFrame
    centroids: np.ndarray


def learn_centroids(sample: np.ndarray, lists: int, rounds: int = ROUNDS, seed: int = SEED) -> np.ndarray:
    """Spherical k-means on a sample of unit vectors."""
    draw = np.random.default_rng(seed)
    centroids = sample[draw.permutation(len(sample))[:lists]]
    for _ in range(rounds):
        nearest = (sample @ centroids.T).argmax(1)
        sums = np.zeros_like(centroids)
        np.add.at(sums, nearest, sample)
        held = np.bincount(nearest, minlength=len(centroids)) > 0
        centroids = np.where(held[:, None], unit_rows(sums), centroids)
    return centroids


def _vectors(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def build_lists(vectors: DataFrame, path: str | None = None, lists: int | None = None) -> VectorLists:
    """Write the lists of ``vectors`` (embedding, and chunk_id or the path columns) and open them.

    Centroids are learned from the vectors of smallest hash, at most SAMPLE_PER_LIST for each
    of at most MAX_LISTS lists; every vector is then put into a list.  Lists are dealt out by
    range of (list, chunk), so a list that holds most vectors spreads over many tasks.
    """
    spark = vectors.sparkSession
    path = path or scratch_table(spark, "lists")
    rows = with_chunk_id(vectors).where(F.col("embedding").isNotNull())
    rows = rows.select("chunk_id", "category", F.col("embedding").cast("array<double>").alias("embedding"))
    if lists is None:
        lists = int(min(MAX_LISTS, max(1, rows.count() ** 0.5)))
    # A bounded sample; all rows are indexed below.
    drawn = rows.orderBy(F.xxhash64("chunk_id"), "chunk_id").limit(lists * SAMPLE_PER_LIST).select("embedding").toArrow()
    sample = unit_rows(_vectors(drawn.column("embedding").combine_chunks())) if drawn.num_rows else np.zeros((0, 1))
    centroids = learn_centroids(sample, lists) if len(sample) else sample

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                unit = unit_rows(_vectors(batch.column("embedding")))
                nearest = pa.array((unit @ centroids.T).argmax(1), pa.int32())
                packed = pa.array([v.tobytes() for v in unit], pa.binary())
                yield pa.RecordBatch.from_arrays([nearest, batch.column("chunk_id"), batch.column("category"), packed], ["list", "chunk_id", "category", "unit"])

    def block(number: int, ids: list, categories: list, units: list) -> pa.RecordBatch:
        matrix = np.frombuffer(b"".join(units)).reshape(len(units), -1)
        radius = float(np.sqrt(np.square(matrix - centroids[number]).sum(1).max()))
        values = [[number], [len(units)], [radius], [b"".join(ids)], [categories], [matrix.tobytes()]]
        types = [pa.int32(), pa.int32(), pa.float64(), pa.binary(), pa.list_(pa.string()), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(values, types, strict=True)], [f.split()[0] for f in BLOCKS.split(", ")])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, ids, categories, units = None, [], [], []
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("list", "chunk_id", "category", "unit")), strict=True):
                if units and (row[0] != number or len(units) == BLOCK_VECTORS):
                    yield block(number, ids, categories, units)
                    ids, categories, units = [], [], []
                number = row[0]
                ids.append(row[1])
                categories.append(row[2])
                units.append(row[3])
        if units:
            yield block(number, ids, categories, units)

    placed = rows.mapInArrow(assign, "list int, chunk_id binary, category string, unit binary")
    dealt = placed.repartitionByRange("list", "chunk_id").sortWithinPartitions("list", "chunk_id")
    dealt.mapInArrow(pack, BLOCKS).write.parquet(os.path.join(path, "blocks"))
    table = pa.table({"list": pa.array(range(len(centroids)), pa.int32()), "centroid": pa.array(centroids.tolist(), pa.list_(pa.float64()))})
    spark.createDataFrame(table, schema="list int, centroid array<double>").coalesce(1).write.parquet(os.path.join(path, "centroids"))
    return open_lists(spark, path)


def open_lists(spark: SparkSession, path: str) -> VectorLists:
    # At most MAX_LISTS rows.
    found = spark.read.schema("list int, centroid array<double>").parquet(os.path.join(path, "centroids")).orderBy("list").collect()
    return VectorLists(spark.read.schema(BLOCKS).parquet(os.path.join(path, "blocks")), np.array([row["centroid"] for row in found]))


class _Nearest:
    """The best k of every query over the blocks of one task."""

    def __init__(self, queries: np.ndarray, wanted: list, k: int, floor: np.ndarray):
        self.queries, self.k = queries, k
        # A query's k-th score so far, or what is known of it beforehand.
        self.least = floor.copy()
        self.groups: dict = {}
        for i, categories in enumerate(wanted):
            self.groups.setdefault(None if categories is None else tuple(sorted(set(categories))), []).append(i)
        self.groups = {key: np.array(rows) for key, rows in self.groups.items()}
        self.query = np.empty(0, np.int64)
        self.score = np.empty(0)
        self.id = np.empty((0, 2), np.uint64)
        self.multiplied = 0

    def add(self, matrix: np.ndarray, ids: bytes, category: list, asks: np.ndarray) -> None:
        """Take in a block for the queries ``asks``."""
        keys = np.frombuffer(ids, ">u8").reshape(-1, 2).astype(np.uint64)
        labels = np.array([c if c is not None else "" for c in category], object)
        known = np.array([c is not None for c in category], bool)
        for key, members in self.groups.items():
            rows = members[np.isin(members, asks, assume_unique=True)]
            inside = np.arange(len(matrix)) if key is None else np.flatnonzero(np.isin(labels, key) & known)
            if not len(inside):
                continue
            part = matrix if key is None else matrix[inside]
            for at in range(0, len(rows), QUERY_SLICE):
                own = rows[at : at + QUERY_SLICE]
                self.multiplied += len(own) * len(part)
                scores = np.round(self.queries[own] @ part.T, SCORE_DIGITS) + 0.0
                if len(inside) >= self.k:
                    kth = np.partition(scores, -self.k, axis=1)[:, -self.k]
                    self.least[own] = np.maximum(self.least[own], kth)
                query, column = np.nonzero(scores >= self.least[own, None])
                self.query = np.concatenate([self.query, own[query]])
                self.score = np.concatenate([self.score, scores[query, column]])
                self.id = np.concatenate([self.id, keys[inside[column]]])
        self._cut()

    def _cut(self) -> None:
        order = np.lexsort((self.id[:, 1], self.id[:, 0], -self.score, self.query))
        query = self.query[order]
        begins = np.flatnonzero(np.append(True, query[1:] != query[:-1])) if len(query) else np.empty(0, np.int64)
        place = np.arange(len(query)) - np.repeat(begins, np.diff(np.append(begins, len(query))))
        order = order[place < self.k]
        self.query, self.score, self.id = self.query[order], self.score[order], self.id[order]
        full = np.flatnonzero(place[place < self.k] == self.k - 1)
        self.least[self.query[full]] = np.maximum(self.least[self.query[full]], self.score[full])

    def hits(self) -> pa.RecordBatch:
        ids = self.id.astype(">u8").tobytes()
        column = pa.array([ids[16 * i : 16 * i + 16] for i in range(len(self.query))], pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(self.query, pa.int32()), column, pa.array(self.score, pa.float64())], ["asked", "chunk_id", "score"])


def _scan(index: VectorLists, blocks: DataFrame, queries: np.ndarray, wanted: list, k: int, floor: np.ndarray, own: np.ndarray | None) -> DataFrame:
    """Hits over ``blocks``; with ``own`` a query looks into that list only."""
    far = np.sqrt(np.maximum(0.0, 2 - 2 * queries @ index.centroids.T))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = _Nearest(queries, wanted, k, floor)
        for batch in batches:
            for number, radius, ids, category, matrix in zip(
                *(batch.column(c).to_pylist() for c in ("list", "radius", "ids", "category")), batch.column("matrix"), strict=True
            ):
                if own is not None:
                    asks = np.flatnonzero(own == number)
                else:
                    bound = 1 - np.square(np.maximum(0.0, far[:, number] - radius)) / 2
                    asks = np.flatnonzero(bound + SLACK >= best.least)
                if len(asks):
                    best.add(np.frombuffer(matrix.as_buffer()).reshape(-1, queries.shape[1]), ids, category, asks)
        yield best.hits()

    return blocks.mapInArrow(run, HITS)


def _nearest_pinned(index: VectorLists, rows: list[dict], k: int) -> DataFrame:
    queries = unit_rows(np.array([row["query_embedding"] for row in rows], dtype=np.float64))
    wanted = [row["wanted"] for row in rows]
    own = (queries @ index.centroids.T).argmax(1)
    none = np.full(len(rows), -np.inf)
    lists = sorted(set(own.tolist()))
    first = _scan(index, index.blocks.where(F.col("list").isin(lists)), queries, wanted, k, none, own)
    # One number for each query.
    kth = F.get(F.sort_array(F.collect_list("score"), asc=False), F.lit(k - 1)).alias("kth")
    floor = none.copy()
    for row in top_k(first, ["asked"], score_order(), k).groupBy("asked").agg(kth).where("kth IS NOT NULL").collect():
        floor[row["asked"]] = row["kth"]
    return _scan(index, index.blocks, queries, wanted, k, floor, None)


def nearest(index: VectorLists, queries: DataFrame, k: int, config: EngineConfig = DEFAULTS, within_category: bool = False) -> DataFrame:
    """(query_id, chunk_id, score, rank): the ``k`` nearest chunks by cosine, exactly.

    Queries without a vector have no hits.  A set of queries that is not small is worked
    through in parts, each one scan.  ``within_category`` searches each query's own
    categories only.
    """
    spark = index.blocks.sparkSession
    id_type = queries.schema["query_id"].dataType.simpleString()
    wanted = wanted_categories(queries) if within_category else F.lit(None).cast("array<string>")
    asked = queries.where(F.col("query_embedding").isNotNull()).select("query_id", wanted.alias("wanted"), F.col("query_embedding").cast("array<double>").alias("query_embedding"))
    parts: list[DataFrame] = []
    slices = [(1, 0)]
    while slices:
        of, part = slices.pop()
        chosen = asked if of == 1 else asked.where(F.pmod(F.xxhash64("query_id"), F.lit(of)) == part)
        pinned = pin_small(chosen.orderBy("query_id"), min(QUERIES, config.small_rows), config.small_bytes)
        if pinned is None and of < MAX_SLICES:
            slices += [(2 * of, part), (2 * of, part + of)]
            continue
        rows = chosen.toArrow().to_pylist() if pinned is None else pinned.rows
        if not rows or not len(index.centroids):
            continue
        names = spark.createDataFrame([(i, row["query_id"]) for i, row in enumerate(rows)], f"number int, query_id {id_type}")
        hits = _nearest_pinned(index, rows, k)
        best = top_k(hits.join(F.broadcast(names), hits["asked"] == names["number"]), ["query_id"], score_order(), k)
        best = best.select("query_id", "chunk_id", "score", "rank")
        parts.append(best if of == 1 else written(best, "near"))
    if not parts:
        return spark.createDataFrame([], f"query_id {id_type}, chunk_id binary, score double, rank int")
    out = parts[0]
    for part in parts[1:]:
        out = out.union(part)
    return out
