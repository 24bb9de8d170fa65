"""Quality classification from positive and unlabelled text: non-negative risk, linear model."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptorium.llm.common import learnable, small_batches, text_of

# Bounds of the training sample: rows of each kind that the driver fits the model on.
POSITIVES = 3000
UNLABELLED = 4500
NEGATIVES = 1500
SEED = 7

# Character classes: 0-9 for kinds of characters, then one for each ASCII sign.
_SIGNS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
_KINDS = 6
CLASSES = _KINDS + len(_SIGNS)
EXTRA = 8
FEATURES = CLASSES * CLASSES + EXTRA


def _class_table() -> np.ndarray:
    table = np.full(256, 5, np.int64)  # control characters
    table[128:] = 4  # parts of other letters
    table[ord(" ")] = 0
    for c in "\t\n\r\x0b\x0c":
        table[ord(c)] = 1
    table[ord("a") : ord("z") + 1] = 2
    table[ord("A") : ord("Z") + 1] = 3
    table[ord("0") : ord("9") + 1] = 5
    for i, c in enumerate(_SIGNS):
        table[ord(c)] = _KINDS + i
    return table


_CLASS = _class_table()


def features(text: str) -> np.ndarray:
    """Square roots of the shares of pairs of neighbouring character classes, and how words
    and lines repeat.  An empty text has zeros."""
    out = np.zeros(FEATURES, np.float32)
    data = text.encode("utf-8", "surrogatepass")
    if not data:
        return out
    kinds = _CLASS[np.frombuffer(data, np.uint8)]
    pairs = np.bincount(kinds[:-1] * CLASSES + kinds[1:], minlength=CLASSES * CLASSES)
    out[: CLASSES * CLASSES] = np.sqrt(pairs / max(1, len(data) - 1))
    words = data.split()
    lines = [x for x in data.split(b"\n") if x.strip()]
    n = max(1, len(words))
    out[CLASSES * CLASSES :] = (
        len(set(words)) / n,
        min(1.0, len(words) / 1000),
        np.log1p(len(words)) / 10,
        len(set(lines)) / max(1, len(lines)),
        min(1.0, len(data) / n / 20),
        np.log1p(len(lines)) / 10,
        sum(w[-1:] in b".!?" for w in words) / n,
        np.log1p(len(data) / max(1, len(lines))) / 10,
    )
    return out


@dataclass(frozen=True)
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    bias: float

    def scores(self, x: np.ndarray) -> np.ndarray:
        z = ((x - self.mean) / self.scale) @ self.weights + self.bias
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit(positive: np.ndarray, unlabelled: np.ndarray, prior: float, epochs: int = 60, rate: float = 0.02, decay: float = 1e-3):
    """A linear model that minimises the non-negative unbiased risk.

    With the logistic loss l and class prior p the risk is
    p E+[l(z)] + max(0, Eu[l(-z)] - p E+[l(-z)]): the second part estimates the loss
    on negatives, which nobody has to label.  Where it turns negative the model
    overfits, and the step climbs out of it instead (gradient of its negation).
    """
    rng = np.random.default_rng(SEED)
    both = np.concatenate([positive, unlabelled])
    mean, scale = both.mean(0), both.std(0) + 1e-2
    xp, xu = (positive - mean) / scale, (unlabelled - mean) / scale
    w, b = np.zeros(both.shape[1]), 0.0
    m, v = np.zeros(len(w) + 1), np.zeros(len(w) + 1)
    step = 0

    def sigmoid(z):
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))

    for _ in range(epochs):
        order_p, order_u = rng.permutation(len(xp)), rng.permutation(len(xu))
        batches = max(1, min(len(xu), len(xp)) // 256)
        for p, u in zip(np.array_split(order_p, batches), np.array_split(order_u, batches), strict=True):
            a, c = xp[p], xu[u]
            za, zc = a @ w + b, c @ w + b
            # d/dz of l(z) is sigmoid(z) - 1, of l(-z) it is sigmoid(z).
            negative_risk = np.logaddexp(0, zc).mean() - prior * np.logaddexp(0, za).mean()
            ga, gc = prior * (sigmoid(za) - 1) / len(a), np.zeros(len(c))
            if negative_risk >= 0:
                ga = ga - prior * sigmoid(za) / len(a)
                gc = sigmoid(zc) / len(c)
            else:
                ga, gc = prior * sigmoid(za) / len(a), -sigmoid(zc) / len(c)
            gradient = np.append(a.T @ ga + c.T @ gc + decay * w, ga.sum() + gc.sum())
            step += 1
            m = 0.9 * m + 0.1 * gradient
            v = 0.999 * v + 0.001 * gradient**2
            move = rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
            w, b = w - move[:-1], b - move[-1]
    return Model(mean, scale, w, float(b))


def place_threshold(model: Model, positive: np.ndarray, negative: np.ndarray) -> Model:
    """Move the bias so that 0.5 parts labelled rows best (mean of both rates)."""
    if not len(positive) or not len(negative):
        return model
    z = np.concatenate([((x - model.mean) / model.scale) @ model.weights for x in (positive, negative)])
    good = np.concatenate([np.ones(len(positive), bool), np.zeros(len(negative), bool)])
    order = np.argsort(z, kind="stable")
    z, good = z[order], good[order]
    below = np.concatenate([[0], np.cumsum(~good)]) / len(negative)
    above = 1 - np.concatenate([[0], np.cumsum(good)]) / len(positive)
    balance = below + above
    best = np.flatnonzero(balance >= balance.max() - 1e-12)
    edges = np.concatenate([[z[0] - 1], (z[1:] + z[:-1]) / 2, [z[-1] + 1]])
    return Model(model.mean, model.scale, model.weights, -float(edges[best[len(best) // 2]]))


def _featured(rows: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [features(text.as_py()).tobytes() for text in batch.column("text")]
            columns = [batch.column("kind"), batch.column("id"), pa.array(found, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["kind", "id", "x"])

    return small_batches(rows).mapInArrow(run, "kind string, id long, x binary")


def train(docs: DataFrame, labels: DataFrame) -> Model | None:
    """The model from rows that may be learned from; None when there is no positive.

    Trusted positives are rows labelled 1; unlabelled text is rows without a label.
    The class prior is the share of 1 among labelled rows, or 0.5 if none is 0.  Rows
    labelled 0 only estimate that share and place the threshold.  At most POSITIVES,
    UNLABELLED and NEGATIVES rows are taken, those with the smallest hash of doc_id.
    """
    marks = labels.where(learnable(labels["doc_id"]) & labels["quality"].isNotNull())
    marks = marks.groupBy(F.col("doc_id").cast("long").alias("id")).agg(F.max("quality").alias("quality"))
    shares = {int(r["quality"]): r["n"] for r in marks.where("quality IN (0, 1)").groupBy("quality").agg(F.count("*").alias("n")).collect()}
    if not shares.get(1):
        return None
    prior = shares[1] / (shares[1] + shares[0]) if shares.get(0) else 0.5
    ids = docs.where(learnable(docs["doc_id"])).select(F.col("doc_id").cast("long").alias("doc_id"))
    known = ids.join(marks, ids["doc_id"] == marks["id"], "left").select("doc_id", "quality")

    def some(condition: str, kind: str, n: int) -> DataFrame:
        return known.where(condition).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n).select("doc_id", F.lit(kind).alias("kind"))

    chosen = some("quality = 1", "p", POSITIVES).union(some("quality IS NULL", "u", UNLABELLED)).union(some("quality = 0", "n", NEGATIVES))
    # Bounded by the three limits: 9 000 rows of a number and a letter.
    chosen = F.broadcast(chosen.distinct().withColumnRenamed("doc_id", "id"))
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), text_of(docs).alias("text"))
    found = _featured(rows.join(chosen, rows["doc_id"] == chosen["id"]).select("kind", "id", "text")).collect()
    # In a fixed order, so that the model does not depend on how the table is split.
    found.sort(key=lambda r: (r.kind, r.id, r.x))
    x = {k: np.array([np.frombuffer(r.x, np.float32) for r in found if r.kind == k], np.float32).reshape(-1, FEATURES) for k in "pun"}
    if not len(x["p"]):
        return None
    # Without unlabelled text the labelled rows stand in, each class by its share.
    unlabelled = x["u"] if len(x["u"]) else np.concatenate([x["p"], x["n"]])
    return place_threshold(fit(x["p"], unlabelled, prior), x["p"], x["n"])


def score_quality(docs: DataFrame, model: Model | None) -> DataFrame:
    """(doc_id, score): one row per row of ``docs``, whole texts, higher is better.

    Null text counts as empty; an empty text gets what the model says of zeros.
    Without a model (no trusted positive) every score is 0.5.
    """
    rows = small_batches(docs.select(docs["doc_id"].cast("long").alias("doc_id"), text_of(docs).alias("text")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = np.full(batch.num_rows, 0.5)
            if model is not None and batch.num_rows:
                scores = model.scores(np.stack([features(text.as_py()) for text in batch.column("text")]))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(scores, pa.float64())], ["doc_id", "score"])

    return rows.mapInArrow(run, "doc_id long, score double")
