"""Language identification by cross-parsing against suffix automata."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from math import log2

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scriptorium.llm.common import learnable, small_batches, text_of

# Bounds of the training sample: languages, texts of each, characters of each text,
# and characters of all automata together.
MAX_LANGUAGES = 256
TEXTS = 80
TEXT_CHARS = 800
TOTAL_CHARS = 400_000
LANGUAGE_CHARS = 48_000
UNKNOWN = "und"
SEGMENT = 512
LANES = 1 << 14


def _code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype="<u4")


@lru_cache(maxsize=1)
def _is_letter() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def suffix_automaton(symbols: list[int], size: int) -> np.ndarray:
    """Transitions (states, size) of the automaton that accepts every substring; -1 where none."""
    edges: list[dict[int, int]] = [{}]
    length, link = [0], [-1]
    last = 0
    for c in symbols:
        state = len(edges)
        edges.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p != -1 and c not in edges[p]:
            edges[p][c] = state
            p = link[p]
        if p != -1:
            q = edges[p][c]
            if length[p] + 1 == length[q]:
                link[state] = q
            else:
                clone = len(edges)
                edges.append(dict(edges[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                link[q] = link[state] = clone
                while p != -1 and edges[p].get(c) == q:
                    edges[p][c] = clone
                    p = link[p]
        last = state
    table = np.full((len(edges), size), -1, np.int32)
    for state, out in enumerate(edges):
        for c, to in out.items():
            table[state, c] = to
    return table


class CrossParser:
    """Parses a text into the longest phrases that a language's sample contains.

    Symbols are 0 for anything but letters (runs count once), 1 for letters that no
    sample has, and one number for every other letter.  Texts are parsed in segments
    of fixed length, all segments and languages of a batch in step.
    """

    def __init__(self, samples: tuple[tuple[str, str], ...]):
        self.languages = [language for language, _ in samples]
        points = [_code_points(text) for _, text in samples]
        letters = np.unique(np.concatenate([p for p in points] or [np.empty(0, np.uint32)]))
        letters = letters[_is_letter()[letters]]
        self.symbol = _is_letter().astype(np.int32)
        self.symbol[letters] = np.arange(2, 2 + len(letters))
        self.size = 2 + len(letters)
        tables, self.roots, self.scale = [], [], []
        at = 0
        for p in points:
            known = self._symbols(p)
            table = suffix_automaton(known.tolist(), self.size)
            tables.append(np.where(table < 0, -1, table + at))
            self.roots.append(at)
            self.scale.append(log2(max(2, len(known))))
            at += len(table)
        self.table = np.concatenate(tables).ravel() if tables else np.empty(0, np.int32)

    def _symbols(self, points: np.ndarray) -> np.ndarray:
        found = self.symbol[points]
        gap = found == 0
        return found[~(gap & np.concatenate([[True], gap[:-1]]))] if len(found) else found

    def costs(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(bits per symbol of every text in every language, whether the text has a letter)."""
        rows = [self._symbols(_code_points(text)) for text in texts]
        sizes = np.array([len(r) for r in rows], np.int64)
        lettered = np.array([bool(r.any()) for r in rows])
        flat = np.concatenate(rows) if rows else np.empty(0, np.int32)
        parts = -(-sizes // SEGMENT)
        owner = np.repeat(np.arange(len(rows)), parts)
        nth = np.arange(len(owner)) - np.repeat(np.cumsum(parts) - parts, parts)
        start = np.repeat(np.cumsum(sizes) - sizes, parts) + nth * SEGMENT
        length = np.minimum(SEGMENT, sizes[owner] - nth * SEGMENT)
        phrases = np.zeros((len(self.languages), len(rows)))
        order = np.argsort(-length, kind="stable")
        lanes = max(1, LANES // max(1, len(self.languages)))
        for at in range(0, len(order), lanes):
            chosen = order[at : at + lanes]
            found = self._parse(flat, start[chosen], length[chosen])
            for k in range(len(self.languages)):
                phrases[k] += np.bincount(owner[chosen], found[k], len(rows))
        bits = phrases * np.array(self.scale)[:, None] / np.maximum(1, sizes)
        return bits.T, lettered

    def _parse(self, flat: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
        roots = np.array(self.roots, np.int64)[:, None]
        state = np.repeat(roots, len(start), axis=1)
        count = np.zeros(state.shape, np.int32)
        live = np.searchsorted(-length, -np.arange(length.max(initial=0)), side="left")  # lengths fall
        for t, n in enumerate(live):
            symbol = flat[start[:n] + t]
            to = self.table[state[:, :n] * self.size + symbol]
            ended = to < 0
            again = self.table[roots * self.size + symbol]
            alone = ended & (again < 0)
            count[:, :n] += (ended & (state[:, :n] != roots)).astype(np.int32) + alone
            state[:, :n] = np.where(alone, roots, np.where(ended, again, to))
        return count + (state != roots)


@lru_cache(maxsize=1)
def _parser(samples: tuple[tuple[str, str], ...]) -> CrossParser:
    return CrossParser(samples)


def training_sample(docs: DataFrame) -> tuple[tuple[str, str], ...]:
    """(language, text) of the labelled sample, at most TOTAL_CHARS characters in all.

    Only rows that may be learned from count.  Of each of the MAX_LANGUAGES most
    frequent languages the TEXTS rows with the smallest hash of doc_id give up to
    TEXT_CHARS characters each.  The ids are chosen first, so that texts are read
    for the chosen rows alone.
    """
    labelled = docs.where(learnable(docs["doc_id"]) & docs["lang"].isNotNull() & docs["text"].isNotNull())
    labelled = labelled.select(F.col("lang").cast("string").alias("lang"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    ids = labelled.select("lang", "doc_id", F.xxhash64("doc_id").alias("h"))
    top = ids.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(MAX_LANGUAGES).select("lang")
    best = Window.partitionBy("lang").orderBy("h", "doc_id")
    chosen = ids.join(F.broadcast(top), "lang").withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= TEXTS)
    # At most MAX_LANGUAGES * TEXTS rows of two numbers.
    chosen = F.broadcast(chosen.select(F.col("lang").alias("of"), F.col("doc_id").alias("id"), "rank"))
    texts = labelled.join(chosen, (F.col("lang") == F.col("of")) & (F.col("doc_id") == F.col("id")))
    cut = F.substring("text", 1, TEXT_CHARS).alias("text")
    # Rows that repeat a doc_id share its ranks: the smallest text of each counts.
    found = texts.select("lang", "rank", cut).groupBy("lang", "rank").agg(F.min("text").alias("text")).collect()
    by_language: dict[str, list[tuple[int, str]]] = {}
    for row in found:
        by_language.setdefault(row.lang, []).append((row.rank, row.text))
    share = min(LANGUAGE_CHARS, TOTAL_CHARS // max(1, len(by_language)))
    joined = {language: "\n".join(t for _, t in sorted(rows))[:share] for language, rows in by_language.items()}
    return tuple(sorted((language, text) for language, text in joined.items() if any(map(str.isalpha, text))))


def identify(docs: DataFrame, samples: tuple[tuple[str, str], ...] | None = None) -> DataFrame:
    """(doc_id, lang_pred, score): one row per row of ``docs``.

    The language whose sample needs the fewest bits wins: phrases times the bits
    that point into its sample, for each symbol of the text.  Equal costs go to the
    first language by name.  ``score`` is 1 minus the best cost over the second
    best (1 with one language).  ``und`` with score 0 is given to null texts, texts
    without letters, and to all texts when there is nothing to learn from.
    """
    samples = training_sample(docs) if samples is None else samples
    rows = small_batches(docs.select(docs["doc_id"].cast("long").alias("doc_id"), text_of(docs).alias("text")))
    return rows.mapInArrow(_predictor(samples), "doc_id long, lang_pred string, score double")


def _predict(samples, texts: list[str]) -> tuple[list[str], list[float]]:
    if not samples:
        return [UNKNOWN] * len(texts), [0.0] * len(texts)
    bits, lettered = _parser(samples).costs(texts)
    first = bits.argmin(axis=1)
    best = bits[np.arange(len(texts)), first]
    second = np.partition(bits, 1, axis=1)[:, 1] if len(samples) > 1 else np.full(len(texts), np.inf)
    score = np.where(lettered & (second > 0), 1 - best / np.where(second > 0, second, 1), 0.0)
    names = [samples[i][0] if ok else UNKNOWN for i, ok in zip(first, lettered, strict=True)]
    return names, score.tolist()


def _predictor(samples):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, scores = _predict(samples, batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(names, pa.string()), pa.array(scores, pa.float64())],
                ["doc_id", "lang_pred", "score"],
            )

    return run


def keep_identified(docs: DataFrame) -> DataFrame:
    """The documents, all columns, whose language can be told; a null lang is filled in.

    Texts that are null or have no letter go.  Where no row has a language to learn from,
    texts with a letter stay and lang stays null.  The decision is a pandas UDF on the text
    alone, so rows stay where they are.
    """
    samples = training_sample(docs)
    if not samples:
        return docs.where(F.coalesce(text_of(docs).rlike(r"\p{L}"), F.lit(False)))
    small_batches(docs)

    def predicted(texts: pd.Series) -> pd.Series:
        return pd.Series(_predict(samples, texts.tolist())[0])

    # Not deterministic for the planner: the filter stays above, so a text is parsed once.
    predicted = F.pandas_udf(predicted, "string").asNondeterministic()
    name = "_predicted_language"
    found = docs.withColumn(name, predicted(text_of(docs))).where(F.col(name) != UNKNOWN)
    return found.withColumn("lang", F.coalesce("lang", F.col(name))).drop(name)
