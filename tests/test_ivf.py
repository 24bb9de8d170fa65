"""Inverted-file vectors against the plain scan."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from scriptorium.config import EngineConfig
from scriptorium.operators import ivf, vector


def stored(spark, vectors, dims):
    rows = [(f"d{i}", 0, "xyz"[i % 3] if i % 7 else None, None if v is None else [float(x) for x in v]) for i, v in enumerate(vectors)]
    return spark.createDataFrame(rows, "file_path string, chunk_index int, category string, embedding array<float>").repartition(4)


def asked(spark, vectors):
    rows = [(i, "xyz"[i % 3] if i % 2 else None, None if v is None else [float(x) for x in v]) for i, v in enumerate(vectors)]
    return spark.createDataFrame(rows, "query_id long, category string, query_embedding array<float>")


def rows(frame):
    return sorted((r.query_id, r["rank"], bytes(r.chunk_id), r.score) for r in frame.select("query_id", "rank", "chunk_id", "score").collect())


@pytest.fixture(scope="module")
def clustered(spark):
    draw = np.random.default_rng(1)
    centres = draw.standard_normal((12, 16)) * 3
    vectors = [centres[i % 12] + draw.standard_normal(16) for i in range(900)]
    vectors = vectors + vectors[:40] + [None, np.zeros(16)]
    frame = stored(spark, vectors, 16).cache()
    return frame, ivf.build_lists(frame, lists=12), centres, draw


@pytest.mark.parametrize("k", [1, 7, 60])
@pytest.mark.parametrize("within", [False, True])
def test_same_hits_as_the_plain_scan(spark, clustered, k, within):
    frame, index, centres, draw = clustered
    queries = asked(spark, [centres[i % 12] + draw.standard_normal(16) for i in range(30)] + [None, np.zeros(16)])
    want = rows(vector.nearest_scores(queries, frame, k, within_category=within))
    assert rows(ivf.nearest(index, queries, k, within_category=within)) == want


def test_five_thousand_queries(spark, clustered):
    frame, index, _, draw = clustered
    queries = asked(spark, draw.standard_normal((5000, 16))).cache()
    got = rows(ivf.nearest(index, queries, 3))
    assert len(got) == 15_000
    some = queries.where(F.col("query_id") % 50 == 0)
    assert rows(vector.nearest_scores(some, frame, 3)) == [r for r in got if r[0] % 50 == 0]


def test_queries_in_parts(spark, clustered):
    _, index, _, draw = clustered
    queries = asked(spark, draw.standard_normal((40, 16)))
    assert rows(ivf.nearest(index, queries, 4, EngineConfig(small_rows=9))) == rows(ivf.nearest(index, queries, 4))


def test_far_blocks_are_skipped(spark, clustered):
    _, index, centres, _ = clustered
    blocks = index.blocks.collect()
    best = ivf._Nearest(vector.unit_rows(centres), [None] * 12, 5, np.full(12, -np.inf))
    far = np.sqrt(np.maximum(0, 2 - 2 * best.queries @ index.centroids.T))
    for own in (True, False):
        for b in blocks:
            bound = 1 - np.square(np.maximum(0, far[:, b["list"]] - b.radius)) / 2
            asks = np.flatnonzero(far.argmin(1) == b["list"]) if own else np.flatnonzero(bound + ivf.SLACK >= best.least)
            if len(asks):
                best.add(np.frombuffer(bytes(b.matrix)).reshape(b.n, -1), bytes(b.ids), b.category, asks)
    assert best.multiplied < 0.7 * 12 * sum(b.n for b in blocks)


def test_nothing_to_search(spark, clustered):
    frame, index, _, _ = clustered
    assert ivf.nearest(index, asked(spark, [None]), 3).count() == 0
    empty = ivf.build_lists(frame.limit(0))
    assert ivf.nearest(empty, asked(spark, [np.ones(16)]), 3).count() == 0
