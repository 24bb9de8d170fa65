"""Mixing sources to target weights: raking to margins, then calibrated sampling."""

from __future__ import annotations

import math
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scriptorium.llm.common import same, small_batches, text_of, written

MARGINS = ("source", "lang", "topic")
# A topic is the side of each of three fixed planes on which a text's word counts lie.
PLANES = 3
# Words are counted by hash class.
CLASSES = 4096
# ASCII other than letters parts words; a word keeps its letters beyond ASCII.
LETTERS = bytes(b if b > 127 or chr(b).isalpha() else 32 for b in range(256))
# A margin's target share is proportional to its token share to this power: below 1
# large parts shrink and small ones grow.
POWER = {"source": 0.8, "lang": 0.8, "topic": 0.9}
# Share of all tokens that the sample should hold.
KEEP = 0.7
# Raking ends when every margin is met to within TOLERANCE of its goal, when a round has not
# come nearer, or after ROUNDS.
ROUNDS = 40
TOLERANCE = 0.002
LEVELS = 60
SEED = 20


def tokens_of(text: Column) -> Column:
    """Weight of a document: a quarter of its UTF-8 bytes, one at least."""
    return F.greatest(F.ceil(F.octet_length(text) / 4), F.lit(1)).cast("long")


def word_counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(classes, counts): all words of a text, in lower case, by hash class."""
    words = text.lower().encode("utf-8", "surrogatepass").translate(LETTERS).split()
    counts = np.bincount(np.fromiter(map(crc32, words), np.int64, len(words)) % CLASSES, minlength=CLASSES)
    found = np.flatnonzero(counts)
    return found, counts[found]


def word_statistics(texts: DataFrame) -> tuple[np.ndarray, np.ndarray, int]:
    """(words, texts, total): how often each class occurs, in how many texts, and the
    texts with words, over the whole table.  Whole numbers, so the split does not matter."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, held = np.zeros(CLASSES, np.int64), np.zeros(CLASSES + 1, np.int64)
        for batch in batches:
            for value in batch.column("text"):
                found, counts = word_counts(value.as_py())
                words[found] += counts
                held[found] += 1
                held[CLASSES] += len(found) > 0
        some = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(np.append(words, 0)[some]), pa.array(held[some])], ["class", "words", "held"])

    parts = small_batches(texts).mapInArrow(run, "class long, words long, held long")
    words, held = np.zeros(CLASSES + 1, np.int64), np.zeros(CLASSES + 1, np.int64)
    # One row per class.
    for row in parts.groupBy("class").agg(F.sum("words").alias("words"), F.sum("held").alias("held")).collect():
        words[row["class"]], held[row["class"]] = row["words"], row["held"]
    return words[:CLASSES], held[:CLASSES], int(held[CLASSES])


def topic_planes(words: np.ndarray, held: np.ndarray, total: int) -> tuple[np.ndarray, np.ndarray]:
    """(planes, middle): for each class its side of each plane times its rarity, and where
    the words of all texts together lie.  Words that most texts have weigh next to nothing."""
    rarity = np.log(max(total, 1) / np.maximum(held, 1)) * (held > 0)
    planes = np.random.default_rng(SEED).choice([-1.0, 1.0], (CLASSES, PLANES)) * rarity[:, None]
    return planes, (planes * words[:, None]).sum(0) / max(int(words.sum()), 1)


def topic_of(text: str, planes: np.ndarray, middle: np.ndarray) -> str:
    """A coarse topic from all words of the text: the planes on whose upper side its mean lies."""
    found, counts = word_counts(text)
    mean = (planes[found] * counts[:, None]).sum(0) / max(counts.sum(), 1)
    return str(sum(1 << b for b in range(PLANES) if mean[b] > middle[b]))


def measured(docs: DataFrame) -> DataFrame:
    """(doc_id, source, lang, topic, text_key, tokens); null source or lang is the class ''."""
    text = text_of(docs)
    part = lambda name: F.coalesce(docs[name].cast("string"), F.lit(""))
    planes, middle = topic_planes(*word_statistics(docs.select(text.alias("text"))))
    rows = docs.select(
        docs["doc_id"].cast("long").alias("doc_id"),
        part("source").alias("source"),
        part("lang").alias("lang"),
        text.alias("text"),
        F.xxhash64(text).alias("text_key"),
        tokens_of(text).alias("tokens"),
    )
    names = ["doc_id", "source", "lang", "topic", "text_key", "tokens"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            topics = pa.array([topic_of(value.as_py(), planes, middle) for value in batch.column("text")], pa.string())
            yield pa.RecordBatch.from_arrays([topics if n == "topic" else batch.column(n) for n in names], names)

    return small_batches(rows).mapInArrow(run, "doc_id long, source string, lang string, topic string, text_key long, tokens long")


def targets(held: DataFrame, power: float, keep: float) -> DataFrame:
    """(value, goal) of one margin's (value, held): the tokens that the sample should hold.

    Goals are proportional to ``held`` to the ``power`` and together ``keep`` of all, but none
    is more than what there is: the level rises until what the full ones lack is shared
    out among the others.
    """
    raised = F.pow("held", F.lit(power))
    level = full = None
    for _ in range(LEVELS):
        open_ = F.lit(True) if level is None else raised * level < F.col("held")
        # Four numbers a step.
        row = held.agg(
            F.sum("held").alias("total"),
            F.sum(F.when(~open_, F.col("held")).otherwise(0.0)).alias("bound"),
            F.sum(F.when(open_, raised).otherwise(0.0)).alias("free"),
            F.count_if(~open_).alias("full"),
        ).first()
        if not row["free"] or row["full"] == full:
            break
        level, full = max(0.0, keep * row["total"] - row["bound"]) / row["free"], row["full"]
    return held.select("value", F.least(F.col("held"), raised * F.lit(level or 0.0)).alias("goal"))


def _with_goals(cells: DataFrame, power: dict[str, float], keep: float) -> DataFrame:
    """``cells`` with the goal of each margin's value, and a rate of 1.

    Tables are joined by a sort and merge: nothing is built on the driver, however many
    sources there are.
    """
    for margin in MARGINS:
        held = written(cells.groupBy(F.col(margin).alias("value")).agg(F.sum("mass").alias("held")), "held")
        goals = targets(held, power[margin], keep)
        cells = cells.join(goals.hint("merge"), cells[margin] == goals["value"]).drop("value").withColumnRenamed("goal", f"goal_{margin}")
    return cells.select(*MARGINS, *[f"goal_{m}" for m in MARGINS], "mass", F.lit(1.0).alias("rate"))


def _fitted(cells: DataFrame, margin: str) -> DataFrame:
    """``cells`` after one step of the fit: one aggregation and one join."""
    weight, full = F.col("mass") * F.col("rate"), F.col("rate") >= 1.0
    sums = cells.groupBy(F.col(margin).alias("value")).agg(
        F.sum(weight).alias("now"), F.sum(F.when(full, F.col("mass")).otherwise(0.0)).alias("bound"), F.first(f"goal_{margin}").alias("goal")
    )
    # Cells at the bound give nothing more: the free ones make up the rest.
    factor = sums.select(
        "value",
        F.when(F.col("goal") <= F.col("now"), F.col("goal") / F.col("now"))
        .when(F.col("now") > F.col("bound"), (F.col("goal") - F.col("bound")) / (F.col("now") - F.col("bound")))
        .otherwise(F.lit(1.0))
        .alias("factor"),
    )
    rate = F.least(F.lit(1.0), F.greatest(F.lit(1e-9), F.col("rate") * F.col("factor")))
    joined = cells.join(factor.hint("merge"), cells[margin] == factor["value"])
    return joined.select(*[rate.alias("rate") if c == "rate" else cells[c] for c in cells.columns])


def margin_error(cells: DataFrame) -> float:
    """The largest relative distance of a margin's tokens from its goal, over all margins."""
    sums = cells.groupingSets([[m] for m in MARGINS], *MARGINS).agg(
        F.grouping_id(*MARGINS).alias("of"),
        F.sum(F.col("mass") * F.col("rate")).alias("now"),
        *[F.first(f"goal_{m}").alias(f"goal_{m}") for m in MARGINS],
    )
    # A value's own bit is 0 in the set that groups by it.
    goal = F.coalesce(*[F.when(F.col("of").bitwiseAND(1 << (len(MARGINS) - 1 - i)) == 0, F.col(f"goal_{m}")) for i, m in enumerate(MARGINS)])
    return sums.agg(F.max(F.abs(F.col("now") / goal - 1)).alias("error")).first()["error"] or 0.0


def rake(cells: DataFrame, power: dict[str, float] | None = None, keep: float = KEEP, rounds: int = ROUNDS) -> tuple[DataFrame, float]:
    """``cells`` (source, lang, topic, mass) with ``rate``, by iterative proportional fitting,
    and the largest relative error of a margin that is left.

    Every step scales the rates of one margin so that its tokens meet its goals;
    rates are held at 1 at most, since a document is taken once.  The table has one
    row per combination that occurs, however many documents there are.  Margin sums
    are aggregations with partial sums; every step ends in a written table.
    Where rates of 1 do not reach a goal (a source whose only language is to shrink), the
    fit ends when the error no longer falls, and what is left is the second result.
    """
    current = written(_with_goals(cells, power or POWER, keep), "rates")
    error = math.inf
    for _ in range(rounds):
        for margin in MARGINS:
            current = written(_fitted(current, margin), "rates")
        before, error = error, margin_error(current)
        if error <= TOLERANCE or error > 0.98 * before:
            break
    return current.select(*MARGINS, "mass", "rate"), 0.0 if error is math.inf else error


def mix(docs: DataFrame, power: dict[str, float] | None = None, keep: float = KEEP, rounds: int = ROUNDS, seed: int = SEED) -> DataFrame:
    """(doc_id, text_key, source, lang, topic, tokens, weight, probability, sampled,
    margin_error): one row per row.

    ``probability`` is the raked rate of the document's source, language and topic;
    ``weight`` is its inverse, what a sampled document stands for; ``margin_error``, the
    same in all rows, how far the expected tokens of the worst margin are from its goal.
    A document is sampled when a hash of doc_id and text, read as a number below 1, is
    under its probability: the draw is the same on every run, and rows that repeat both
    are drawn alike.  Null text counts as empty, with weight of one token.  An empty
    table gives an empty result.
    """
    rows = written(measured(docs), "measured")
    cells = written(rows.groupBy(*MARGINS).agg(F.sum("tokens").cast("double").alias("mass")), "cells")
    raked, error = rake(cells, power, keep, rounds)
    rates = raked.select(*[F.col(m).alias(f"of_{m}") for m in MARGINS], "rate")
    met = rows.join(rates, [rows[m] == rates[f"of_{m}"] for m in MARGINS])
    draw = F.shiftrightunsigned(F.xxhash64("doc_id", "text_key", F.lit(seed)), 11) / float(1 << 53)
    return met.select(
        "doc_id",
        "text_key",
        *MARGINS,
        "tokens",
        (1 / F.col("rate")).alias("weight"),
        F.col("rate").alias("probability"),
        (draw < F.col("rate")).alias("sampled"),
        F.lit(error).alias("margin_error"),
    )


def keep_sampled(docs: DataFrame, **options) -> DataFrame:
    """The documents, all columns, that ``mix`` samples."""
    chosen = mix(docs, **options).where("sampled").select("doc_id", "text_key").distinct()
    match = same(docs["doc_id"].cast("long"), chosen["doc_id"]) & (F.xxhash64(text_of(docs)) == chosen["text_key"])
    return docs.join(chosen, match, "left_semi")
