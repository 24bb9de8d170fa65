"""Bounded-space online packing of tokenised documents into fixed windows."""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptorium.llm.common import small_batches, text_of, written
from scriptorium.llm.tokens import default_tokenizer, encoded, encoder

WINDOW = 1024
OPEN_WINDOWS = 32
END_ID = 0
# Partitions whose leftovers one task merges: each leaves less than one window.
MERGE_PARTITIONS = 256
MERGED = 1 << 62
COLUMNS = ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset", "leftover"]
SCHEMA = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long, leftover long"

Piece = tuple  # (doc_id, start, ids, doc_tokens): ids are 4 bytes each


def _cut(piece: Piece, n: int) -> tuple[Piece, Piece]:
    doc_id, start, ids, total = piece
    return (doc_id, start, ids[: 4 * n], total), (doc_id, start + n, ids[4 * n :], total)


class OpenWindows:
    """At most ``k`` open windows; full ones are handed out as lists of pieces."""

    def __init__(self, k: int = OPEN_WINDOWS, window: int = WINDOW):
        self.k, self.window = k, window
        self.open: list[tuple[int, list[Piece]]] = []  # (free tokens, pieces)

    def add(self, piece: Piece) -> Iterator[list[Piece]]:
        while (n := len(piece[2]) // 4) >= self.window:
            head, piece = _cut(piece, self.window)
            yield [head]
        if not n:
            return
        while True:
            fitting = [(free, i) for i, (free, _) in enumerate(self.open) if free >= n]
            if fitting:
                free, i = min(fitting)
                pieces = self.open[i][1]
                pieces.append(piece)
                if free == n:
                    del self.open[i]
                    yield pieces
                else:
                    self.open[i] = (free - n, pieces)
                return
            if len(self.open) < self.k:
                self.open.append((self.window - n, [piece]))
                return
            # None fits: the fullest goes out, filled up with the head of the piece.
            free, i = min((free, i) for i, (free, _) in enumerate(self.open))
            head, piece = _cut(piece, free)
            pieces = self.open.pop(i)[1]
            yield [*pieces, head]
            n -= free

    def close(self) -> tuple[list[list[Piece]], list[Piece]]:
        """The open windows poured into each other: full ones, and the last, partial one."""
        full: list[list[Piece]] = []
        current: list[Piece] = []
        used = 0
        for piece in itertools.chain.from_iterable(pieces for _, pieces in sorted(self.open, key=lambda x: x[0])):
            while used + len(piece[2]) // 4 >= self.window:
                head, piece = _cut(piece, self.window - used)
                full.append([*current, head])
                current, used = [], 0
            if piece[2]:
                current.append(piece)
                used += len(piece[2]) // 4
        self.open = []
        return full, current


def _rows(sequence: int, pieces: list[Piece], leftover: int | None = None) -> Iterator[tuple]:
    at = 0
    for doc_id, start, ids, total in pieces:
        yield doc_id, start, len(ids) // 4, ids, total, sequence, at, leftover
        at += len(ids) // 4


def powers(pieces: list[Piece]) -> Iterator[list[Piece]]:
    """A partial window as windows whose lengths are powers of two, which need no padding."""
    rest = list(pieces)
    total = sum(len(p[2]) // 4 for p in rest)
    for bit in reversed(range(total.bit_length())):
        if not total >> bit & 1:
            continue
        need, taken = 1 << bit, []
        while need:
            piece = rest.pop(0)
            n = len(piece[2]) // 4
            if n > need:
                piece, tail = _cut(piece, need)
                rest.insert(0, tail)
                n = need
            taken.append(piece)
            need -= n
        yield taken


def pack(docs: DataFrame, tokenizer: str | None = None, window: int = WINDOW, open_windows: int = OPEN_WINDOWS) -> DataFrame:
    """Pieces of documents in sequences: COLUMNS without ``leftover``.

    A document is its token ids and the end id.  Each partition streams its
    documents through a fixed number of open windows: a piece goes where it leaves
    the least room; when none fits, the fullest is filled with the head of the
    piece and emitted.  What is open at the end is poured together; the one partial
    window that a partition leaves is merged with those of 255 others, and the last
    partial one is cut into powers of two.  Memory is the open windows and one batch
    of texts.  Null text counts as empty and has the end id alone; repeated rows are
    packed each; ``ids`` are little-endian unsigned 32-bit.  An empty table gives no pieces.
    """
    path = tokenizer or default_tokenizer()
    rows = small_batches(docs.select(docs["doc_id"].cast("long").alias("doc_id"), text_of(docs).alias("text")))
    end = END_ID.to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        partition = TaskContext.get().partitionId()
        number = itertools.count(partition << 40)
        windows, own = OpenWindows(open_windows, window), encoder(path)
        types = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], COLUMNS)

        out: list[tuple] = []
        for batch in batches:
            ids = batch.column("doc_id").to_pylist()
            for doc_id, tokens in zip(ids, encoded(own, batch.column("text")), strict=True):
                tokens += end
                for pieces in windows.add((doc_id, 0, tokens, len(tokens) // 4)):
                    out += _rows(next(number), pieces)
                if len(out) >= 2000:
                    yield batch_of(out)
                    out = []
        full, partial = windows.close()
        for pieces in full:
            out += _rows(next(number), pieces)
        out += _rows(next(number), partial, partition)
        if out:
            yield batch_of(out)

    placed = written(rows.mapInArrow(run, SCHEMA), "packed")

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["leftover", "sequence_id", "offset"])
        windows = OpenWindows(open_windows, window)
        number = itertools.count(MERGED | int(pdf["leftover"].iloc[0]) // MERGE_PARTITIONS << 40)
        out: list[tuple] = []
        for row in pdf.itertuples(index=False):
            doc_id = None if pd.isna(row.doc_id) else int(row.doc_id)
            for pieces in windows.add((doc_id, int(row.start), bytes(row.ids), int(row.doc_tokens))):
                out += _rows(next(number), pieces)
        full, partial = windows.close()
        for pieces in itertools.chain(full, powers(partial)):
            out += _rows(next(number), pieces)
        return pd.DataFrame(out, columns=COLUMNS).astype({"doc_id": "Int64", "leftover": "Int64"})

    rest = placed.where("leftover IS NOT NULL").withColumn("heap", F.expr(f"leftover DIV {MERGE_PARTITIONS}"))
    merged = rest.groupBy("heap").applyInPandas(lambda key, pdf: merge(pdf.drop(columns="heap")), SCHEMA)
    return placed.where("leftover IS NULL").union(merged).drop("leftover")
