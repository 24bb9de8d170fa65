"""Token ids in files: canonical length-limited Huffman codes in independent blocks.

A folder of ids has three tables.  ``codebook`` (id, bits) holds the code lengths, from
which the canonical codes follow.  ``blocks`` holds one row per block of at most
BLOCK_IDS ids: ``part`` and ``block`` give its place, ``first`` the ids of its part
before it, ``n_ids`` its ids, ``payload`` the codes from the highest bit of the first byte
on, ``checkpoints`` the bit at which every STEP-th id starts, and one entry for each piece
of a document in it: ``doc_id``, ``doc_start`` (ids of its part before the document),
``doc_ids`` (ids of the whole document), ``piece_ids``.  ``parts`` (part, base, n_ids) says
how many ids the parts before hold.  Parts, blocks and pieces are in ascending doc_id order.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from functools import lru_cache
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.llm.common import small_batches, text_of, written
from scriptorium.llm.tokens import default_tokenizer, encoded, encoder
from scriptorium.session import scratch_table

BLOCK_IDS = 1 << 16
STEP = 64
# Longest code.  The decoder's table has two to this power entries, 1 MB.
MAX_BITS = 18
END_ID = 2

PIECES = "part int, doc_id long, doc_start long, doc_ids long, piece_start long, n_ids long, crc long"
BLOCKS = (
    "part int, block int, first long, n_ids int, payload binary, checkpoints array<int>, "
    "doc_id array<long>, doc_start array<long>, doc_ids array<long>, piece_ids array<int>"
)


def code_lengths(counts: np.ndarray, max_bits: int = MAX_BITS) -> np.ndarray:
    """Optimal code lengths of at most ``max_bits`` for positive counts, by package-merge.

    Every level merges the symbols with pairs of the level below; of the top level the
    2n - 2 lightest count, and each symbol's length is how often it is among them.
    """
    n = len(counts)
    if n <= 1:
        return np.ones(n, np.uint8)
    if n > 1 << max_bits:
        raise ValueError(f"{n} symbols do not fit codes of {max_bits} bits")
    order = np.argsort(counts, kind="stable")
    weights = counts[order].astype(np.int64)
    levels = []
    packages = np.empty(0, np.int64)
    for _ in range(max_bits):
        merged = np.concatenate([weights, packages])
        rank = np.argsort(merged, kind="stable")
        levels.append(rank < n)
        merged = merged[rank]
        even = len(merged) // 2 * 2
        packages = merged[0:even:2] + merged[1:even:2]
    bits = np.zeros(n, np.uint8)
    taken = 2 * n - 2
    for plain in reversed(levels):
        own = int(np.count_nonzero(plain[:taken]))
        bits[:own] += 1
        taken = 2 * (taken - own)
    out = np.empty(n, np.uint8)
    out[order] = bits
    return out


class Codebook:
    """Canonical codes: shorter first, of equal length the smaller id first."""

    def __init__(self, ids: np.ndarray, bits: np.ndarray):
        order = np.lexsort((ids, bits))
        self.ids, self.bits = ids[order].astype(np.int64), bits[order].astype(np.int64)
        step = np.left_shift(1, MAX_BITS - self.bits)
        aligned = np.cumsum(step) - step
        # Indexed by id, for writing.
        size = int(self.ids.max(initial=0)) + 1
        self.code, self.length = np.zeros(size, np.uint64), np.zeros(size, np.int64)
        self.code[self.ids] = (aligned >> (MAX_BITS - self.bits)).astype(np.uint64)
        self.length[self.ids] = self.bits
        # Indexed by the next MAX_BITS bits, for reading: an id and its length.
        self.table = np.zeros(1 << MAX_BITS, np.int64)
        filled = np.repeat(self.ids << 8 | self.bits, step)
        self.table[: len(filled)] = filled

    def encode(self, ids: np.ndarray) -> tuple[bytes, np.ndarray]:
        """(payload, checkpoints) of a block of ids."""
        length = self.length[ids]
        ends = np.cumsum(length)
        starts = ends - length
        # Each code lies in two neighbouring words of 32 bits; codes of one word are added.
        shifted = self.code[ids] << (64 - (starts & 31) - length).astype(np.uint64)
        word = starts >> 5
        cuts = np.flatnonzero(np.diff(word, prepend=-1))
        out = np.zeros((int(ends[-1]) >> 5) + 3 if len(ids) else 0, np.uint64)
        if len(ids):
            out[word[cuts]] += np.add.reduceat(shifted >> np.uint64(32), cuts)
            out[word[cuts] + 1] += np.add.reduceat(shifted & np.uint64(0xFFFFFFFF), cuts)
        size = (int(ends[-1]) + 7) // 8 if len(ids) else 0
        return out.astype(">u4").tobytes()[:size], starts[::STEP].astype(np.int32)

    def decode(self, payload: bytes, checkpoints: np.ndarray, n_ids: int) -> np.ndarray:
        """The ids of a block: all stretches between checkpoints are read side by side."""
        data = np.frombuffer(payload + bytes(8), np.uint8).astype(np.uint32)
        window = data[:-3] << 24 | data[1:-2] << 16 | data[2:-1] << 8 | data[3:]
        at = checkpoints.astype(np.int64)
        out = np.empty((len(at), STEP), np.uint32)
        last = len(window) - 1
        for i in range(STEP):
            # The last stretch may be short: beyond its end it reads what is cut off below.
            found = self.table[window[np.minimum(at >> 3, last)] >> (32 - MAX_BITS - (at & 7)).astype(np.uint32) & ((1 << MAX_BITS) - 1)]
            out[:, i] = found >> 8
            at += found & 0xFF
        return out.ravel()[:n_ids]


@lru_cache(maxsize=2)
def _codebook(ids: bytes, bits: bytes) -> Codebook:
    return Codebook(np.frombuffer(ids, "<i4"), np.frombuffer(bits, np.uint8))


def token_ids(docs: DataFrame, tokenizer: str | None = None, end_id: int = END_ID) -> DataFrame:
    """(doc_id, text_key, ids): the ids of every whole text and the end id.

    ``ids`` are little-endian, of two bytes each where the tokenizer has no more ids, else
    of four.
    """
    path = tokenizer or default_tokenizer()
    text = text_of(docs)
    rows = small_batches(docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.xxhash64(text).alias("text_key"), text.alias("text")))
    narrow = narrow_ids(path, end_id)
    end = np.array([end_id], "<u2" if narrow else "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path)
        for batch in batches:
            found = encoded(own, batch.column("text"))
            if narrow:
                found = (np.frombuffer(ids, "<u4").astype("<u2").tobytes() for ids in found)
            column = pa.array([ids + end for ids in found], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_key"), column], ["doc_id", "text_key", "ids"])

    return rows.mapInArrow(run, "doc_id long, text_key long, ids binary")


def narrow_ids(tokenizer: str, end_id: int = END_ID) -> bool:
    """Whether all ids of a tokenizer and the end id fit two bytes."""
    from tokenizers import Tokenizer

    return max(Tokenizer.from_file(tokenizer).get_vocab_size(with_added_tokens=True) - 1, end_id) < 1 << 16


def global_counts(tokens: DataFrame, narrow: bool) -> DataFrame:
    """(id, n) over all rows: counted within a task, then summed; one row per id."""
    dtype = "<u2" if narrow else "<u4"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            # The ids of a batch lie side by side.
            column = batch.column("ids").cast(pa.large_binary())
            _, offsets, data = column.buffers()
            ends = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
            ids = np.frombuffer(data, np.uint8)[ends[0] : ends[-1]].view(dtype)
            found = np.bincount(ids, minlength=len(total))
            found[: len(total)] += total
            total = found
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(total[some], pa.int64())], ["id", "n"])

    return tokens.select("ids").mapInArrow(run, "id int, n long").groupBy("id").agg(F.sum("n").alias("n"))


class _BlockWriter:
    """Deals the documents of one part out to blocks.

    A document that does not fit what is left of a block begins the next one; only one that
    is longer than a block is cut.
    """

    def __init__(self, part: int, codebook: Codebook, block_ids: int):
        self.part, self.codebook, self.block_ids = part, codebook, block_ids
        self.block = self.total = self.held = 0
        self.first = 0
        self.pieces: list[tuple] = []
        self.ids: list[np.ndarray] = []

    def add(self, doc_id: int | None, ids: np.ndarray) -> Iterator[tuple]:
        start, at = self.total, 0
        self.total += len(ids)
        if self.held and self.block_ids - self.held < len(ids) <= self.block_ids:
            yield self.close()
        while at < len(ids):
            piece = ids[at : at + self.block_ids - self.held]
            self.pieces.append((doc_id, start, len(ids), len(piece)))
            self.ids.append(piece)
            self.held += len(piece)
            at += len(piece)
            if self.held == self.block_ids:
                yield self.close()

    def close(self) -> tuple:
        payload, checkpoints = self.codebook.encode(np.concatenate(self.ids))
        row = (self.part, self.block, self.first, self.held, payload, checkpoints, *(list(c) for c in zip(*self.pieces, strict=True)))
        self.block, self.first, self.held = self.block + 1, self.first + self.held, 0
        self.pieces, self.ids = [], []
        return row


_BLOCK_TYPES = [pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.list_(pa.int32())]
_BLOCK_TYPES += [pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int32())]


def _batch(rows: list[tuple], schema: str, types: list[pa.DataType]) -> pa.RecordBatch:
    names = [field.split()[0] for field in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)


def write_tokens(docs: DataFrame, path: str, tokenizer: str | None = None, end_id: int = END_ID, block_ids: int = BLOCK_IDS) -> None:
    """Write the ids of all documents, each with the end id, to a folder in ascending doc_id order.

    Texts are tokenised once, into a scratch table.  Its counts give one codebook for all
    ids (a row for each id of the tokenizer, so its size is bounded by the vocabulary).
    Documents are range-partitioned and sorted by doc_id, equal ones by a hash of the
    text; each partition codes its ids block by block.  Null text has the end id alone, a
    null doc_id comes first, repeated rows are written each, an empty table has no blocks.
    """
    spark = docs.sparkSession
    source = tokenizer or default_tokenizer()
    narrow = narrow_ids(source, end_id)
    dtype = "<u2" if narrow else "<u4"
    tokens = written(token_ids(docs, source, end_id), "ids")
    # At most one row for each id of the tokenizer.
    counted = global_counts(tokens, narrow).orderBy("id").toPandas()
    ids = counted["id"].to_numpy(np.int32)
    bits = code_lengths(counted["n"].to_numpy(np.int64))
    book = pa.table({"id": pa.array(ids, pa.int32()), "bits": pa.array(bits, pa.uint8()).cast(pa.int32())})
    spark.createDataFrame(book, schema="id int, bits int").coalesce(1).write.parquet(os.path.join(path, "codebook"))
    ids_bytes, bits_bytes = ids.astype("<i4").tobytes(), bits.tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer = _BlockWriter(TaskContext.get().partitionId(), _codebook(ids_bytes, bits_bytes), block_ids)
        for batch in batches:
            rows: list[tuple] = []
            for doc_id, found in zip(batch.column("doc_id").to_pylist(), batch.column("ids"), strict=True):
                rows.extend(writer.add(doc_id, np.frombuffer(found.as_buffer(), dtype)))
            if rows:
                yield _batch(rows, BLOCKS, _BLOCK_TYPES)
        if writer.held:
            yield _batch([writer.close()], BLOCKS, _BLOCK_TYPES)

    placed = tokens.repartitionByRange("doc_id", "text_key").sortWithinPartitions("doc_id", "text_key").select("doc_id", "ids")
    blocks = os.path.join(path, "blocks")
    placed.mapInArrow(run, BLOCKS).write.parquet(blocks)
    # One row for each part, of which there are no more than shuffle partitions.
    sizes = spark.read.schema(BLOCKS).parquet(blocks).groupBy("part").agg(F.sum("n_ids").alias("n")).orderBy("part").collect()
    bases = np.cumsum([0] + [row["n"] for row in sizes]).tolist()
    parts = [(row["part"], base, row["n"]) for row, base in zip(sizes, bases, strict=False)]
    spark.createDataFrame(parts, "part int, base long, n_ids long").coalesce(1).write.parquet(os.path.join(path, "parts"))


def _read_codebook(spark: SparkSession, path: str) -> tuple[bytes, bytes]:
    book = spark.read.schema("id int, bits int").parquet(os.path.join(path, "codebook")).toPandas()
    return book["id"].to_numpy("<i4").tobytes(), book["bits"].to_numpy(np.uint8).tobytes()


def _parts(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("part int, base long, n_ids long").parquet(os.path.join(path, "parts"))


def read_pieces(spark: SparkSession, path: str) -> DataFrame:
    """One row per piece of a document: where it stands, its ids' number and their CRC-32 as
    little-endian unsigned 32-bit numbers.  Every block is decoded on its own."""
    ids_bytes, bits_bytes = _read_codebook(spark, path)
    types = [pa.int32()] + [pa.int64()] * 6

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        book = _codebook(ids_bytes, bits_bytes)
        for batch in batches:
            rows: list[tuple] = []
            names = ["part", "first", "n_ids", "doc_id", "doc_start", "doc_ids", "piece_ids"]
            plain = zip(*(batch.column(n).to_pylist() for n in names), strict=True)
            packed = zip(batch.column("payload"), batch.column("checkpoints"), strict=True)
            for (part, first, n_ids, *docs), (payload, checkpoints) in zip(plain, packed, strict=True):
                ids = book.decode(payload.as_py(), checkpoints.values.to_numpy(), n_ids).astype("<u4").tobytes()
                at = 0
                for doc_id, start, size, n in zip(*docs, strict=True):
                    rows.append((part, doc_id, start, size, first + at - start, n, crc32(ids[4 * at : 4 * (at + n)])))
                    at += n
            if rows:
                yield _batch(rows, PIECES, types)

    blocks = spark.read.schema(BLOCKS).parquet(os.path.join(path, "blocks"))
    return small_batches(blocks.drop("block")).mapInArrow(run, PIECES)


def _times(matrix: list[int], vector: int) -> int:
    out = 0
    for row in matrix:
        if vector & 1:
            out ^= row
        vector >>= 1
    return out


@lru_cache(maxsize=64)
def _zeros(power: int) -> list[int]:
    """What a CRC-32 becomes over 2^power zero bytes, as the images of its 32 bits."""
    if power == 0:
        # Over one zero bit; squared three times it is over one zero byte.
        step = [0xEDB88320] + [1 << i for i in range(31)]
        for _ in range(3):
            step = [_times(step, row) for row in step]
        return step
    half = _zeros(power - 1)
    return [_times(half, row) for row in half]


def joined_crc(pieces: list[tuple[int, int]]) -> int:
    """The CRC-32 of bytes given as (CRC-32, number of bytes) of their pieces in order."""
    total = 0
    for crc, size in pieces:
        for power in range(size.bit_length()):
            if size >> power & 1:
                total = _times(_zeros(power), total)
        total ^= crc
    return total


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document of a folder, from its blocks.

    Blocks are decoded once, into a table of a few numbers for each piece.  Documents that
    lie in one block need no shuffle; the pieces of longer ones are gathered by document and
    their checksums joined in order.
    """

    @F.udf("long")
    def joined(pieces):
        return joined_crc([(p["crc"], 4 * p["n_ids"]) for p in pieces])

    pieces = written(read_pieces(spark, path), "pieces")
    whole = pieces.where("n_ids = doc_ids").select("part", "doc_id", "doc_start", "doc_ids", "crc")
    cut = pieces.where("n_ids < doc_ids").groupBy("part", "doc_id", "doc_start", "doc_ids")
    cut = cut.agg(F.sort_array(F.collect_list(F.struct("piece_start", "n_ids", "crc"))).alias("pieces"))
    cut = cut.select("part", "doc_id", "doc_start", "doc_ids", joined("pieces").alias("crc"))
    parts = _parts(spark, path).select(F.col("part").alias("of"), "base")
    both = whole.union(cut)
    return both.join(parts, both["part"] == parts["of"]).select(
        "doc_id", (F.col("base") + F.col("doc_start")).alias("start"), F.col("doc_ids").alias("n_tokens"), F.col("crc").alias("ids_crc32")
    )


def read_range(spark: SparkSession, path: str, start: int, n: int) -> np.ndarray:
    """The ids number ``start`` to ``start + n`` of a folder, ``n`` at most what a driver holds.

    Only the blocks that hold them are read, and of each only the stretches between
    checkpoints that do."""
    ids_bytes, bits_bytes = _read_codebook(spark, path)
    parts = _parts(spark, path).select(F.col("part").alias("of"), "base")
    blocks = spark.read.schema(BLOCKS).parquet(os.path.join(path, "blocks")).select("part", "first", "n_ids", "payload", "checkpoints")
    placed = blocks.join(F.broadcast(parts), blocks["part"] == parts["of"]).withColumn("at", F.col("base") + F.col("first"))
    rows = placed.where((F.col("at") < start + n) & (F.col("at") + F.col("n_ids") > start)).orderBy("at").collect()
    book = _codebook(ids_bytes, bits_bytes)
    out = []
    for row in rows:
        low, high = max(0, start - row["at"]), min(row["n_ids"], start + n - row["at"])
        skip = low // STEP
        points = np.array(row["checkpoints"][skip : -(-high // STEP)], np.int64)
        base = int(points[0]) // 8
        found = book.decode(bytes(row["payload"])[base:], points - 8 * base, high - skip * STEP)
        out.append(found[low - skip * STEP :])
    return np.concatenate(out) if out else np.empty(0, np.uint32)


def written_tokens(docs: DataFrame, tokenizer: str | None = None, path: str | None = None, block_ids: int = BLOCK_IDS) -> DataFrame:
    """``read_documents`` of what ``write_tokens`` writes, in a folder of its own unless named."""
    path = path or scratch_table(docs.sparkSession, "tokens")
    write_tokens(docs, path, tokenizer, block_ids=block_ids)
    return read_documents(docs.sparkSession, path)
