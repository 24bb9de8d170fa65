"""Embedding whitening: leading covariance eigenpairs by Jacobi-Davidson, then projection.

The covariance is never formed.  Its products with a few vectors are one pass over the
distinct quantised vectors, which lie in a table as packed blocks; tasks return their sums.
The driver holds vectors of one embedding's width only: the search space, its products and
the converged pairs.  Each round takes the Ritz pairs of the space, locks those whose
residuals have reached double precision, solves the projected correction equations of the
next ones side by side with a few MINRES steps, and widens the space by the solutions.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptorium.llm.common import written

SCALE = 256
COMPONENTS = 4
# Vectors of one packed block.
BLOCK_VECTORS = 4096
# Pairs that are looked for beyond the wanted ones, so that close values do not stall.
GUARD = 2
# Correction steps a round, vectors of the search space before a restart and after it.
INNER_STEPS = 4
SPACE, RESTART = 80, 16
MAX_ROUNDS = 400
# Partial sums that come to the driver at once; more are added up on executors first.
PARTIALS = 64
# A residual counts as double precision at this many roundings of the largest value.
ROUNDINGS = 64
LIMIT = 1 << 62
# The largest double below 2^63.
FAR = float(np.nextafter(2.0**63, 0))

Product = Callable[[np.ndarray], np.ndarray]


class Whitening(NamedTuple):
    """What is fitted: how often and where the distinct vectors lie, and the components."""

    n: int
    sums: list[int]
    values: np.ndarray  # falling eigenvalues
    vectors: np.ndarray  # one component a row
    trace: float
    identity_error: float
    passes: int

    @property
    def mean(self) -> np.ndarray:
        # Whole numbers divided exactly, rounded once.
        return np.array([s / self.n for s in self.sums])


def quantised(embeddings: DataFrame) -> DataFrame:
    """(vec_id, x, size): the vectors as packed whole numbers floor(256 * c).

    Rows whose vector is null or empty or holds null or non-finite entries are left out;
    entries beyond a long are its ends.  ``x`` has two bytes an entry where all fit, else
    eight, so equal vectors have equal bytes.
    """
    entries = embeddings["embedding"].cast("array<double>")
    fine = ~F.exists(entries, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    rows = embeddings.where((F.size(entries) > 0) & fine).select(embeddings["vec_id"].cast("long").alias("vec_id"), entries.alias("c"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("c")
            offsets, flat = column.offsets.to_numpy(), column.values.to_numpy(zero_copy_only=False)
            x = np.clip(np.floor(SCALE * flat), -FAR, FAR).astype(np.int64)
            packed = []
            for start, end in zip(offsets[:-1], offsets[1:], strict=True):
                own = x[start:end]
                small = own.min() >= -(1 << 15) and own.max() < 1 << 15
                packed.append(own.astype("<i2" if small else "<i8").tobytes())
            sizes = pa.array(np.diff(offsets), pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(packed, pa.binary()), sizes], ["vec_id", "x", "size"])

    return rows.mapInArrow(run, "vec_id long, x binary, size int")


def unpacked(x: bytes, size: int) -> np.ndarray:
    """The whole numbers of one packed vector."""
    return np.frombuffer(x, "<i8" if len(x) == 8 * size else "<i2").astype(np.int64)


def packed_blocks(distinct: DataFrame) -> DataFrame:
    """(n, width, block): distinct packed vectors of one size, many to a row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[bytes]] = {2: [], 8: []}

        def row(width: int) -> pa.RecordBatch:
            values = held[width]
            held[width] = []
            block = pa.array([b"".join(values)], pa.binary())
            return pa.RecordBatch.from_arrays([pa.array([len(values)], pa.int32()), pa.array([width], pa.int32()), block], ["n", "width", "block"])

        for batch in batches:
            for x, size in zip(batch.column("x").to_pylist(), batch.column("size").to_pylist(), strict=True):
                width = len(x) // size
                held[width].append(x)
                if len(held[width]) == BLOCK_VECTORS:
                    yield row(width)
        yield from (row(width) for width in held if held[width])

    return distinct.mapInArrow(run, "n int, width int, block binary")


def _matrices(batch: pa.RecordBatch, size: int) -> Iterator[np.ndarray]:
    for width, block in zip(batch.column("width").to_pylist(), batch.column("block"), strict=True):
        yield np.frombuffer(block.as_buffer(), "<i2" if width == 2 else "<i8").reshape(-1, size)


def totals(blocks: DataFrame, size: int) -> tuple[int, list[int]]:
    """(n, sums by dimension), exact: vectors of two bytes an entry add up in a long, others
    in Python's whole numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums = 0, [0] * size
        for batch in batches:
            for x in _matrices(batch, size):
                own = x.sum(0, dtype=np.int64).tolist() if x.itemsize == 2 else x.astype(object).sum(0).tolist()
                n, sums = n + len(x), [a + int(b) for a, b in zip(sums, own, strict=True)]
        yield pa.RecordBatch.from_arrays(
            [pa.array(range(size + 1), pa.int32()), pa.array([*map(str, sums), str(n)], pa.string())], ["dim", "part"]
        )

    summed = blocks.mapInArrow(run, "dim int, part string").groupBy("dim").agg(F.sum(F.col("part").cast("decimal(38,0)")).alias("s"))
    # One row for each dimension.
    found = {row["dim"]: int(row["s"]) for row in summed.collect()}
    return found.get(size, 0), [found.get(i, 0) for i in range(size)]


class Centred(NamedTuple):
    """The distinct vectors less their mean, as far as sums over them go."""

    blocks: DataFrame
    tasks: int
    size: int
    mean: np.ndarray

    def summed(self, work: Callable[[np.ndarray], np.ndarray], shape: tuple[int, int]) -> np.ndarray:
        """The sum over all blocks of ``work(centred vectors)``, whose results have ``shape``."""
        size, mean = self.size, self.mean

        def packed(total: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["part"])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(shape)
            for batch in batches:
                for x in _matrices(batch, size):
                    total += work(x - mean)
            yield packed(total)

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(shape)
            for batch in batches:
                for part in batch.column("part"):
                    total += np.frombuffer(part.as_buffer()).reshape(shape)
            yield packed(total)

        parts = self.blocks.mapInArrow(run, "part binary")
        if self.tasks > PARTIALS:
            parts = parts.repartition(math.isqrt(self.tasks)).mapInArrow(add, "part binary")
        # One sum for each of at most PARTIALS tasks, or of the square root of their number.
        found = [np.frombuffer(bytes(row["part"])).reshape(shape) for row in parts.collect()]
        return np.sum(found, axis=0) if found else np.zeros(shape)


def _orthonormal(new: np.ndarray, *spaces: np.ndarray) -> np.ndarray:
    """Unit columns that span what ``new`` adds to the given orthonormal columns."""
    kept: list[np.ndarray] = []
    for v in new.T:
        before = np.linalg.norm(v)
        if not before > 0 or not np.isfinite(before):
            continue
        v = v / before
        for _ in range(3):
            for space in spaces:
                v = v - space @ (space.T @ v)
            for other in kept:
                v = v - other * (other @ v)
            size = np.linalg.norm(v)
            if size < 1e-10:
                break
            v = v / size
        else:
            kept.append(v)
    return np.array(kept).T if kept else np.empty((len(new), 0))


def corrections(product: Product, theta: np.ndarray, locked: np.ndarray, ritz: np.ndarray, residual: np.ndarray, steps: int) -> np.ndarray:
    """Approximate solutions t of (I - QQ')(A - theta I)(I - QQ') t = -r, one column each.

    Q holds the locked vectors and all Ritz vectors that are being improved.  All columns
    take their MINRES steps together, so a step is one product with all of them.
    """
    basis = np.concatenate([locked, ritz], axis=1)

    def projected(x: np.ndarray) -> np.ndarray:
        return x - basis @ (basis.T @ x)

    r = projected(-residual)
    k = r.shape[1]
    beta = np.linalg.norm(r, axis=0)
    live = beta > 0
    v = r / np.where(live, beta, 1)
    old_v, x = np.zeros_like(r), np.zeros_like(r)
    w, old_w = np.zeros_like(r), np.zeros_like(r)
    # Rotations of the last two steps, one of each column.
    c, s, old_c, old_s = np.ones(k), np.zeros(k), np.ones(k), np.zeros(k)
    eta, step_beta = beta.copy(), np.zeros(k)
    for _ in range(steps):
        p = projected(product(v) - theta * v)
        alpha = (v * p).sum(0)
        p -= alpha * v + step_beta * old_v
        p = projected(p)
        next_beta = np.linalg.norm(p, axis=0)
        epsilon = old_s * step_beta
        delta = c * old_c * step_beta + s * alpha
        gamma = c * alpha - s * old_c * step_beta
        rho = np.hypot(gamma, next_beta)
        live &= rho > 1e-300
        safe = np.where(live, rho, 1)
        new_w = np.where(live, (v - epsilon * old_w - delta * w) / safe, 0)
        old_w, w = w, new_w
        old_c, old_s, c, s = c, s, gamma / safe, next_beta / safe
        x += np.where(live, c * eta, 0) * w
        eta = -s * eta
        live &= next_beta > 1e-14 * np.maximum(beta, 1e-300)
        old_v, v = v, np.where(live, p / np.where(next_beta > 0, next_beta, 1), 0)
        step_beta = next_beta
        if not live.any():
            break
    return x


def leading_pairs(product: Product, size: int, wanted: int, seed: int = 12) -> tuple[np.ndarray, np.ndarray, int]:
    """(values, vectors as columns, passes): the ``wanted`` largest eigenpairs of a symmetric,
    positive semidefinite operator of dimension ``size``, to double precision.

    ``product`` is asked for a block of columns at a time.  A pair is locked, in falling
    order, when its residual is within ROUNDINGS roundings of the largest value.
    """
    wanted = min(wanted, size)
    look = min(size, wanted + GUARD)
    locked, values, passes = np.empty((size, 0)), [], 0

    def times(x: np.ndarray) -> np.ndarray:
        nonlocal passes
        passes += 1
        return product(x)

    space = _orthonormal(np.random.default_rng(seed).standard_normal((size, min(size, 2 * look))))
    images = times(space)
    for _ in range(MAX_ROUNDS):
        small = space.T @ images
        theta, y = np.linalg.eigh((small + small.T) / 2)
        theta, y = theta[::-1], y[:, ::-1]
        largest = max([*values, theta[0] if len(theta) else 0.0, 0.0])
        if largest == 0:
            # A zero operator: every vector is one of its own.
            ritz = space @ y
            locked = np.concatenate([locked, ritz[:, : wanted - len(values)]], axis=1)
            return np.zeros(locked.shape[1]), locked, passes
        k = min(look - len(values), len(theta))
        ritz, ritz_images = space @ y, images @ y
        residual = ritz_images[:, :k] - ritz[:, :k] * theta[:k]
        residual -= locked @ (locked.T @ residual)
        error = np.linalg.norm(residual, axis=0)
        enough = ROUNDINGS * np.finfo(float).eps * largest
        complete = space.shape[1] + locked.shape[1] == size
        done = 0
        # With the whole space searched, only rounding is left in the residuals.
        while done < k and len(values) < wanted and (error[done] <= enough or complete and error[done] <= 1e3 * enough):
            values.append(float(theta[done]))
            done += 1
        locked = np.concatenate([locked, ritz[:, :done]], axis=1)
        if len(values) == wanted:
            return np.array(values), locked, passes
        ritz, ritz_images, residual, theta = ritz[:, done:], ritz_images[:, done:], residual[:, done:], theta[done:]
        k -= done
        if ritz.shape[1] + k > SPACE:
            ritz, ritz_images = ritz[:, :RESTART], ritz_images[:, :RESTART]
        space, images = ritz, ritz_images
        if complete:
            # Products of the same vectors, made anew, to shed the rounding of old ones.
            space = _orthonormal(space, locked)
            images = times(space)
            continue
        t = corrections(times, theta[:k], locked, ritz[:, :k], residual[:, :k], INNER_STEPS)
        fresh = _orthonormal(t, locked, space)
        if not fresh.shape[1]:
            fresh = _orthonormal(np.random.default_rng(seed + passes).standard_normal((size, look)), locked, space)
        space = np.concatenate([space, fresh], axis=1)
        images = np.concatenate([images, times(fresh)], axis=1)
    raise RuntimeError(f"no convergence in {MAX_ROUNDS} rounds: {len(values)} of {wanted} pairs")


def fit(vectors: DataFrame, components: int = COMPONENTS) -> tuple[Whitening | None, int]:
    """The whitening of ``quantised`` vectors and their number of dimensions.

    Each distinct vector counts once.  The number of dimensions is the most frequent one
    of all rows, of equally frequent ones the largest.  Components whose value is rounding
    beside the first (constant vectors, or fewer vectors than components) are left out.
    Without vectors there is nothing to fit.
    """
    sizes = vectors.groupBy("size").count().orderBy(F.desc("count"), F.desc("size")).limit(1).collect()
    if not sizes:
        return None, 0
    size = sizes[0]["size"]
    blocks = written(packed_blocks(vectors.where(F.col("size") == size).select("x", "size").distinct()), "vectors")
    n, sums = totals(blocks, size)
    centred = Centred(blocks, blocks.rdd.getNumPartitions(), size, np.array([s / n for s in sums]))
    trace = float(centred.summed(lambda x: np.full((1, 1), np.square(x).sum()), (1, 1))[0, 0]) / n

    def product(v: np.ndarray) -> np.ndarray:
        return centred.summed(lambda x: x.T @ (x @ v), v.shape) / n

    values, vectors_found, passes = leading_pairs(product, size, components)
    real = values > size * np.finfo(float).eps * max(float(values.max(initial=0)), 0.0)
    values, vectors_found = values[real], vectors_found[:, real]
    k = len(values)
    scaled = vectors_found / np.sqrt(values)
    spread = centred.summed(lambda x: (x @ scaled).T @ (x @ scaled), (k, k)) / n if k else np.zeros((0, 0))
    error = float(np.abs(spread - np.eye(k)).max(initial=0))
    return Whitening(n, sums, values, vectors_found.T, trace, error, passes), size


COLUMNS = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int | None]:
    """The sum over dimensions of (n * x - sum)^2 of each row, exact; null beyond a long."""
    far = n * int(np.abs(x).max(initial=0)) + max(map(abs, sums))
    if far * far * x.shape[1] < LIMIT:
        return np.square(n * x - np.array(sums, np.int64)).sum(1).tolist()
    exact = np.square(n * x.astype(object) - np.array(sums, object)).sum(1)
    return [int(v) if v < 1 << 63 else None for v in exact]


def whiten(embeddings: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error): one row for
    each vector and component, numbered from 1 by falling value.

    Vectors that are null or empty or hold null or non-finite entries are left out, and so
    are those of another width than most.  Repeated rows come out each but are fitted once.
    ``deviation`` is null where it is beyond a long.  An empty table, or one with a single
    distinct vector, has no components and gives no rows.
    """
    spark = embeddings.sparkSession
    vectors = quantised(embeddings)
    fitted, size = fit(vectors, components)
    if fitted is None or not len(fitted.values):
        return spark.createDataFrame([], COLUMNS)
    n, sums, k = fitted.n, fitted.sums, len(fitted.values)
    mean, scaled = fitted.mean, (fitted.vectors.T / np.sqrt(fitted.values))
    explained, error = fitted.values / fitted.trace, fitted.identity_error

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = np.stack([unpacked(v, size) for v in batch.column("x").to_pylist()])
            rows = len(x)
            repeat = np.repeat(np.arange(rows), k)
            columns = [
                batch.column("vec_id").take(pa.array(repeat)),
                pa.array(np.tile(np.arange(1, k + 1), rows), pa.int32()),
                pa.array(np.full(rows * k, n), pa.int64()),
                pa.array(deviations(x, n, sums), pa.int64()).take(pa.array(repeat)),
                pa.array(((x - mean) @ scaled).ravel(), pa.float64()),
                pa.array(np.tile(explained, rows), pa.float64()),
                pa.array(np.full(rows * k, error), pa.float64()),
            ]
            yield pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in COLUMNS.split(", ")])

    return vectors.where(F.col("size") == size).mapInArrow(run, COLUMNS)
