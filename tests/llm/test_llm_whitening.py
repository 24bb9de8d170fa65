"""Jacobi-Davidson against a dense solver, and the whitened table against numpy."""

import numpy as np
import pytest

from scriptorium.llm import whitening

SCHEMA = "vec_id long, embedding array<float>, label int, component string, n string, x string"


def table(spark, vectors, parts=3):
    rows = [(i, None if v is None else [None if c is None else float(c) for c in v], 0, "c", "n", "x") for i, v in enumerate(vectors)]
    return spark.createDataFrame(rows, SCHEMA).repartition(parts)


def dense(vectors, k=4):
    """Expected figures from the covariance as a whole."""
    c = np.array(vectors, np.float32).astype(float)
    x = np.floor(256 * c).astype(int)
    fit = np.unique(x, axis=0)
    n, sums = len(fit), fit.sum(0)
    centred = fit - sums / n
    values, axes = np.linalg.eigh(centred.T @ centred / n)
    values, axes = values[::-1][:k], axes[:, ::-1][:, :k]
    whitened = (x - sums / n) @ axes / np.sqrt(values)
    deviation = [sum(int(n * int(a) - int(s)) ** 2 for a, s in zip(row, sums, strict=True)) for row in x]
    return n, deviation, whitened, values / np.trace(centred.T @ centred / n)


def checked(spark, vectors, parts=3):
    n, deviation, whitened, explained = dense(vectors)
    rows = whitening.whiten(table(spark, vectors, parts)).collect()
    k = len(explained)
    assert len(rows) == len(vectors) * k
    got = np.full((len(vectors), k), np.nan)
    for r in rows:
        got[r["vec_id"], r["component"] - 1] = r["whitened"]
        assert (r["n"], r["deviation"]) == (n, deviation[r["vec_id"]])
        assert r["explained"] == pytest.approx(explained[r["component"] - 1], rel=1e-9)
        assert r["identity_error"] < 1e-8
    for j in range(k):
        sign = np.sign(got[:, j] @ whitened[:, j])
        assert np.allclose(got[:, j], sign * whitened[:, j], atol=1e-6)


@pytest.mark.parametrize(("size", "seed"), [(1, 0), (3, 1), (8, 2), (64, 3), (300, 4)])
def test_pairs_of_dense_matrices(size, seed):
    draw = np.random.default_rng(seed)
    a = draw.standard_normal((2 * size, size)) * np.linspace(1, 1.2, size)
    a = a.T @ a / len(a)
    values, vectors, _ = whitening.leading_pairs(lambda v: a @ v, size, 4)
    want = np.linalg.eigvalsh(a)[::-1][:4]
    assert np.allclose(values, want, rtol=1e-12)
    residual = np.linalg.norm(a @ vectors - vectors * values, axis=0)
    assert residual.max() <= 1e-12 * want[0]
    assert np.allclose(vectors.T @ vectors, np.eye(len(values)), atol=1e-12)


def test_equal_and_clustered_values():
    q = np.linalg.qr(np.random.default_rng(5).standard_normal((40, 40)))[0]
    for spectrum in ([2.0] * 5 + [1.0] * 35, [1.0] * 40, list(1 + np.linspace(0, 1e-7, 40)), [3.0, 1.0] + [0.0] * 38):
        a = q * np.array(spectrum) @ q.T
        a = (a + a.T) / 2
        values, vectors, _ = whitening.leading_pairs(lambda v, a=a: a @ v, 40, 4)
        assert np.allclose(values, sorted(spectrum)[::-1][:4], atol=1e-12)
        assert np.linalg.norm(a @ vectors - vectors * values, axis=0).max() <= 1e-12 * max(spectrum)


def test_restarts_in_many_dimensions():
    draw = np.random.default_rng(6)
    d = np.concatenate([[50, 49.9, 49.8, 49.7], draw.uniform(0, 49.5, 1996)])
    values, vectors, passes = whitening.leading_pairs(lambda v: d[:, None] * v, 2000, 4)
    assert np.allclose(values, d[:4], rtol=1e-12) and passes < 400


def test_correction_equation_is_solved():
    draw = np.random.default_rng(7)
    a = np.diag(np.arange(1.0, 31))
    ritz = np.linalg.qr(draw.standard_normal((30, 2)))[0]
    theta = np.diag(ritz.T @ a @ ritz)
    residual = a @ ritz - ritz * theta
    locked = np.empty((30, 0))
    t = whitening.corrections(lambda v: a @ v, theta, locked, ritz, residual, 60)
    project = np.eye(30) - ritz @ ritz.T
    for j in range(2):
        left = project @ (a @ (project @ t[:, j]) - theta[j] * (project @ t[:, j]))
        assert np.allclose(left, -project @ residual[:, j], atol=1e-8)


def test_whitened_rows(spark):
    draw = np.random.default_rng(8)
    vectors = (draw.standard_normal((300, 12)) * np.linspace(2, 0.5, 12)).tolist()
    checked(spark, vectors + vectors[:50] + [vectors[0]] * 200)


def test_many_partitions_are_added_up_first(spark, monkeypatch):
    monkeypatch.setattr(whitening, "PARTIALS", 1)
    draw = np.random.default_rng(9)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        checked(spark, draw.standard_normal((90, 6)).tolist(), 8)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_wide_entries(spark):
    draw = np.random.default_rng(10)
    checked(spark, (draw.standard_normal((40, 5)) * 3000).tolist())


def test_rows_left_out(spark):
    good = [[0.1 * i, 1.0 - 0.3 * i * i, float(i % 3)] for i in range(9)]
    bad = [None, [], [1.0, None, 2.0], [float("nan"), 1.0, 1.0], [float("inf"), 0.0, 0.0], [1.0, 2.0]]
    rows = whitening.whiten(table(spark, good + bad)).collect()
    assert {r["vec_id"] for r in rows} == set(range(9)) and len(rows) == 27


def test_nothing_to_whiten(spark):
    assert whitening.whiten(table(spark, [])).count() == 0
    assert whitening.whiten(table(spark, [[1.0, 2.0]] * 5)).count() == 0
    line = whitening.whiten(table(spark, [[1.0, 2.0], [2.0, 4.0], [2.0, 4.0]])).collect()
    assert [r["component"] for r in line] == [1, 1, 1]
    assert sorted(round(abs(r["whitened"]), 9) for r in line) == [1.0, 1.0, 1.0]


def test_deviations_beyond_a_long():
    x = np.array([[1, 2], [1 << 40, 0]])
    assert whitening.deviations(x, 1000, [5, 7]) == [(1000 - 5) ** 2 + (2000 - 7) ** 2, None]
    assert whitening.deviations(x, 1, [5, 7])[0] == 16 + 25
