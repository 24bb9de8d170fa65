"""SimHash near-duplicates: fingerprints, candidate blocks, bit-sliced comparison, components."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from scriptorium.llm.bitslice import linked
from scriptorium.llm.common import same, small_batches, text_of, written
from scriptorium.llm.components import connected_components

# Distinct fingerprints that one comparison holds at most (twice this in a split block).
BLOCK_LIMIT = 4096
# Candidate blocks for wide radii: pairs of minima of five-word shingles.
MINHASH_TABLES = 10
# Minima of which a byte each is kept to confirm a pair, and how many have to agree: at a
# similarity of 0.8 the mean is 205 and 190 is 2.3 deviations below.
SKETCH = 256
SKETCH_AGREE = 190
SEED = 42
# Bits in which texts of a similarity of 0.8 differ at most: 10 on average when one place is
# rewritten; by the binomial 0.03 % of such pairs differ in more.
NEAR_RADIUS = 20


def first_document() -> Column:
    """The document that stands for rows of one node; a null doc_id ranks last."""
    return F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_key")).alias("first")


def shingle_hashes(text: str, width: int = 3) -> np.ndarray:
    """XXH64 of every shingle of ``width`` words, repeats included.

    Words are runs of anything but ASCII white space, A-Z lower-cased.  A text
    with fewer words has one shingle, all of it; a text with none has no shingle.
    """
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    n = max(1, len(words) - width + 1)
    joined = map(b" ".join, zip(*(words[i:] for i in range(width)), strict=False)) if len(words) >= width else [b" ".join(words)]
    return np.fromiter(map(xxh64_intdigest, joined, repeat(SEED)), np.uint64, n)


def fingerprint(hashes: np.ndarray) -> int:
    """Bit b is 1 where more than half of the hashes have it; no hashes give zero."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = hashes[at : at + (1 << 16)].astype("<u8", copy=False)
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<i8")[0])


def minhash_blocks(hashes: np.ndarray, tables: int = MINHASH_TABLES) -> tuple[list[int], bytes]:
    """One block id per table: two minima over the five-word shingles, mixed; and the
    sketch, the low bytes of SKETCH minima.

    Words i..i+4 are covered by the three-word shingles i and i+2, so their
    hashes are mixed instead of hashing the text again.
    """
    if not len(hashes):
        # Texts without words are alike: they share a block of their own.
        return [0], bytes(SKETCH)
    x = hashes
    if len(x) > 2:
        x = (x[:-2] * np.uint64(0x9E3779B97F4A7C15)) ^ ((x[2:] << np.uint64(23)) | (x[2:] >> np.uint64(41)))
    x = np.unique(x)
    odd = np.random.default_rng(SEED).integers(1, 1 << 63, SKETCH, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    least = np.full(SKETCH, 0xFFFFFFFFFFFFFFFF, np.uint64)
    for at in range(0, len(x), 1 << 14):
        part = x[at : at + (1 << 14)]
        step = max(1, (1 << 14) // len(part))
        for k in range(0, SKETCH, step):
            y = part * odd[k : k + step, None]
            y ^= y >> np.uint64(32)
            least[k : k + step] = np.minimum(least[k : k + step], y.min(1))
    first, second = least[:tables], least[tables : 2 * tables]
    mixed = (first * odd[:tables]) ^ (second + np.arange(tables, dtype=np.uint64))
    return mixed.view(np.int64).tolist(), (least >> np.uint64(8)).astype(np.uint8).tobytes()


def fingerprints(docs: DataFrame, width: int = 3, blocks: bool = False) -> DataFrame:
    """(doc_id, text_key, fp, blocks, sketch): one row per document.

    ``fp`` is the fingerprint as a signed 64-bit number, ``text_key`` Spark's
    xxhash64 of the text, which tells rows of equal doc_id apart.  Null text
    counts as empty.  ``blocks`` and ``sketch`` are null unless asked for.
    """
    text = text_of(docs)
    rows = small_batches(docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.xxhash64(text).alias("text_key"), text.alias("text")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps, keys, sketches = [], [], []
            for value in batch.column("text"):
                hashes = shingle_hashes(value.as_py(), width)
                fps.append(fingerprint(hashes))
                key, sketch = minhash_blocks(hashes) if blocks else (None, None)
                keys.append(key)
                sketches.append(sketch)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("text_key"), pa.array(fps, pa.int64()), pa.array(keys, pa.list_(pa.int64())), pa.array(sketches, pa.binary())],
                ["doc_id", "text_key", "fp", "blocks", "sketch"],
            )

    return rows.mapInArrow(run, "doc_id long, text_key long, fp long, blocks array<long>, sketch binary")


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def block_masks(radius: int, equal: int = 2) -> list[int]:
    """Masks of which at least one leaves no difference between any two
    fingerprints within ``radius``: the 64 bits are cut into radius + equal parts,
    and ``radius`` differences touch at most ``radius`` of them."""
    parts = radius + equal
    edge = [64 * i // parts for i in range(parts + 1)]
    field = [((1 << edge[i + 1]) - 1) ^ ((1 << edge[i]) - 1) for i in range(parts)]
    return [_signed(sum(field[i] for i in chosen)) for chosen in combinations(range(parts), equal)]


def by_masks(fps: DataFrame, radius: int) -> DataFrame:
    """(k1, k2, fp): blocks that hold every pair within ``radius`` at least once."""
    masks = F.array(*[F.lit(m).cast("long") for m in block_masks(radius)])
    return fps.select("fp", F.explode(masks).alias("k1")).select("k1", F.col("fp").bitwiseAND(F.col("k1")).alias("k2"), "fp")


def distinct_texts(prints: DataFrame) -> DataFrame:
    """(node, text_key, fp, blocks, sketch, first): one row per distinct text.

    ``node`` is a number of its own, so that texts are never taken for equal because their
    fingerprints are; ``first`` is the document that stands for it.  The number is given
    while the table is written and does not change afterwards.
    """
    texts = prints.groupBy("text_key", "fp").agg(F.any_value("blocks").alias("blocks"), F.any_value("sketch").alias("sketch"), first_document())
    return written(texts.withColumn("node", F.monotonically_increasing_id()), "texts")


def by_minhash(texts: DataFrame) -> DataFrame:
    """(k1, k2, node, fp, sketch): blocks of texts that share two minima of one table."""
    rows = texts.select("node", "fp", "sketch", F.posexplode("blocks").alias("k1", "k2"))
    return rows.select(F.col("k1").cast("long").alias("k1"), "k2", "node", "fp", "sketch")


def near_edges(members: DataFrame, radius: int, limit: int = BLOCK_LIMIT) -> DataFrame:
    """(a, b) of fingerprints within ``radius`` that share a block of ``members``.

    The edges span each block's components.  A block with more than ``limit``
    fingerprints is cut into parts by hash, and every two parts are compared in a
    task of their own, so no task grows with a block and no pair is lost.  Where
    ``members`` has nodes and sketches, the edges are between nodes, equal fingerprints
    are compared like others, and the sketches have to confirm a pair.
    """
    carried = [c for c in ("node", "sketch") if c in members.columns]
    counts = members.groupBy("k1", "k2").agg(F.count("*").alias("n")).where("n > 1")
    counts = counts.select(F.col("k1").alias("c1"), F.col("k2").alias("c2"), F.ceil(F.col("n") / limit).cast("int").alias("parts"))
    sized = members.join(counts, (F.col("k1") == F.col("c1")) & (F.col("k2") == F.col("c2")))
    part = F.pmod(F.xxhash64("node" if carried else "fp"), F.col("parts")).cast("int")
    dealt = (
        sized.withColumn("part", part)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        .select("k1", "k2", F.least("part", "other").alias("p"), F.greatest("part", "other").alias("q"), "fp", *carried)
    )
    grouped = dealt.groupBy("k1", "k2", "p", "q").agg(F.collect_list(F.struct("fp", *carried)).alias("fps"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("fps")
            offsets, flat = column.offsets.to_numpy(), column.values.field("fp").to_numpy(zero_copy_only=False)
            cuts = list(zip(offsets[:-1], offsets[1:], strict=True))
            nodes = sketches = None
            if carried:
                own = column.values.field("node").to_numpy(zero_copy_only=False)
                nodes = [own[s:e] for s, e in cuts]
                marks = np.frombuffer(b"".join(column.values.field("sketch").to_pylist()), np.uint8).reshape(-1, SKETCH)
                sketches = [marks[s:e] for s, e in cuts]
            a, b = linked([flat[s:e] for s, e in cuts], radius, nodes, sketches, SKETCH_AGREE)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return small_batches(grouped.select("fps")).mapInArrow(run, "a long, b long").distinct()


def _owners(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, best) for every row of ``nodes`` (node, first): the first document of its component.

    Both tables are written, so that the join has no aggregation beside it and a component
    that holds most nodes can be split.
    """
    roots = connected_components(edges).withColumnRenamed("node", "of")
    linked_nodes = written(nodes.join(roots, nodes["node"] == roots["of"]).select("node", "first", "root"), "linked")
    best = written(linked_nodes.groupBy(F.col("root").alias("of")).agg(F.min("first").alias("best")), "best")
    owned = linked_nodes.join(best, linked_nodes["root"] == best["of"]).select("node", "best")
    alone = nodes.join(roots, nodes["node"] == roots["of"], "left_anti").select("node", F.col("first").alias("best"))
    return owned.union(alone)


def near_duplicates(docs: DataFrame, radius: int = 3, width: int = 3, blocking: str = "masks") -> DataFrame:
    """(doc_id, text_key, fp, component_id, keep): one row per document.

    With ``blocking="masks"`` fingerprints link when they differ in at most ``radius``
    bits, and every such pair is found; equal fingerprints are one node, however many rows
    have them.  ``"minhash"`` compares distinct texts that share two minima of their
    five-word shingles in one of ten tables: the bit-sliced comparison drops pairs beyond
    ``radius``, and of those within it 256 minima decide whether the similarity is about
    0.8.  ``component_id`` is the smallest doc_id reachable, itself included.  Of each
    component ``keep`` marks one document, the smallest (doc_id, text_key); rows that
    repeat both are marked alike.

    Null text counts as empty; texts without words have fingerprint zero and link
    like others.  A null doc_id is kept, never becomes a component_id while a number is at hand, and
    ranks last.  An empty table gives an empty result.
    """
    if blocking not in ("masks", "minhash"):
        raise ValueError(f"unknown blocking {blocking!r}")
    prints = written(fingerprints(docs, width, blocking == "minhash"), "simhash")
    if blocking == "masks":
        members = by_masks(prints.select("fp").distinct(), radius)
        nodes = prints.groupBy(F.col("fp").alias("node")).agg(first_document())
        owner = _owners(nodes, near_edges(members, radius))
        out = prints.join(owner, prints["fp"] == owner["node"])
    else:
        texts = distinct_texts(prints)
        owner = _owners(texts.select("node", "first"), near_edges(by_minhash(texts), radius)).withColumnRenamed("node", "of")
        named = texts.join(owner, texts["node"] == owner["of"]).select(F.col("text_key").alias("key"), F.col("fp").alias("print"), "best")
        out = prints.join(named, (prints["text_key"] == named["key"]) & (prints["fp"] == named["print"]))
    kept = same(F.col("doc_id"), F.col("best.doc_id")) & (F.col("text_key") == F.col("best.text_key"))
    return out.select("doc_id", "text_key", "fp", F.col("best.doc_id").alias("component_id"), kept.alias("keep"))


def hex_fingerprint(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def keep_one(docs: DataFrame, radius: int = NEAR_RADIUS, blocking: str = "minhash") -> DataFrame:
    """The documents, all columns, without the near-duplicates: one of each component stays.

    Rows that repeat both doc_id and text stay together; exact deduplication
    is the operator that parts them.
    """
    marks = near_duplicates(docs, radius, blocking=blocking).where("keep").select("doc_id", "text_key").distinct()
    match = same(docs["doc_id"].cast("long"), marks["doc_id"]) & (F.xxhash64(text_of(docs)) == marks["text_key"])
    return docs.join(marks, match, "left_semi")
