"""Codes, blocks and files against round trips, a plain Huffman tree and zlib."""

import heapq
import random
from zlib import crc32

import numpy as np
import pytest
from llm_cases import LONG

from scriptorium.llm import huffman
from scriptorium.llm.tokens import default_tokenizer
from scriptorium.session import scratch_table


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(default_tokenizer())


def ids_of(tokenizer, text):
    return [*tokenizer.encode(text or "", add_special_tokens=False).ids, 2]


def huffman_cost(counts):
    heap = list(counts)
    heapq.heapify(heap)
    cost = 0
    while len(heap) > 1:
        both = heapq.heappop(heap) + heapq.heappop(heap)
        cost += both
        heapq.heappush(heap, both)
    return cost


def limited_cost(counts, bits):
    """Least cost of codes of at most ``bits`` bits, by trying all Kraft-feasible lengths."""
    counts = sorted(counts, reverse=True)

    def best(i, low, room):
        if i == len(counts):
            return 0
        found = [best(i + 1, n, room - (1 << (bits - n))) for n in range(low, bits + 1) if room >= 1 << (bits - n)]
        costs = [counts[i] * n + c for n, c in zip([n for n in range(low, bits + 1) if room >= 1 << (bits - n)], found, strict=True) if c is not None]
        return min(costs, default=None)

    return best(0, 1, 1 << bits)


@pytest.mark.parametrize("seed", range(5))
def test_lengths_are_optimal(seed):
    draw = random.Random(seed)
    counts = [draw.randint(1, 10 ** draw.randint(0, 4)) for _ in range(draw.randint(2, 60))]
    bits = huffman.code_lengths(np.array(counts), 40)
    assert sum(c * int(b) for c, b in zip(counts, bits, strict=True)) == huffman_cost(counts)
    few = counts[:7]
    short = huffman.code_lengths(np.array(few), 3)
    assert short.max() <= 3 and sum(2.0**-b for b in short.astype(float)) <= 1
    assert sum(c * int(b) for c, b in zip(few, short, strict=True)) == limited_cost(few, 3)


def test_lengths_of_few_symbols():
    assert huffman.code_lengths(np.array([], int)).tolist() == []
    assert huffman.code_lengths(np.array([9])).tolist() == [1]
    with pytest.raises(ValueError):
        huffman.code_lengths(np.ones(9, int), 3)


@pytest.mark.parametrize("n", [1, 63, 64, 65, 5000])
def test_blocks_round_trip(n):
    draw = np.random.default_rng(n)
    ids = (draw.pareto(0.6, n) * 3).clip(0, 60000).astype(np.int64)
    symbols, counts = np.unique(ids, return_counts=True)
    book = huffman.Codebook(symbols, huffman.code_lengths(counts))
    payload, checkpoints = book.encode(ids)
    assert len(payload) == -(-int(book.length[ids].sum()) // 8)
    assert len(checkpoints) == -(-n // huffman.STEP)
    assert book.decode(payload, checkpoints, n).tolist() == ids.tolist()


def test_codes_are_canonical():
    book = huffman.Codebook(np.array([7, 3, 9, 1]), np.array([2, 1, 3, 3]))
    assert [(int(i), format(int(book.code[i]), f"0{book.length[i]}b")) for i in (3, 7, 1, 9)] == [(3, "0"), (7, "10"), (1, "110"), (9, "111")]


def test_joined_checksums():
    data = bytes(range(256)) * 40
    cuts = [0, 1, 5, 5, 900, 7000, len(data)]
    parts = [data[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]
    assert huffman.joined_crc([(crc32(p), len(p)) for p in parts]) == crc32(data)
    assert huffman.joined_crc([]) == 0


@pytest.mark.parametrize("block_ids", [huffman.BLOCK_IDS, 37])
def test_documents_come_back(spark, cases, tokenizer, block_ids):
    got = huffman.written_tokens(cases, block_ids=block_ids).orderBy("start").collect()
    rows = sorted(((r["doc_id"], r["text"]) for r in cases.collect()), key=lambda r: (r[0] is not None, r[0] or 0))
    assert [r["doc_id"] for r in got] == [doc_id for doc_id, _ in rows]
    at = 0
    for row, (_, text) in zip(got, rows, strict=True):
        ids = ids_of(tokenizer, text)
        assert (row["start"], row["n_tokens"]) == (at, len(ids))
        assert row["ids_crc32"] == crc32(np.array(ids, "<u4").tobytes())
        at += len(ids)


def test_any_stretch_can_be_read(spark, tokenizer):
    texts = [f"document {i} " + "some words and more " * i for i in range(40)]
    docs = spark.createDataFrame([(100 - i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(4)
    path = scratch_table(spark, "tokens")
    huffman.write_tokens(docs, path, block_ids=300)
    ids = [i for t in reversed(texts) for i in ids_of(tokenizer, t)]
    for start, n in [(0, 1), (299, 3), (63, 65), (1000, 700), (len(ids) - 5, 50), (0, len(ids)), (len(ids), 4)]:
        assert huffman.read_range(spark, path, start, n).tolist() == ids[start : start + n]
    book = spark.read.parquet(f"{path}/codebook").collect()
    assert {r["id"] for r in book} == set(ids)


def test_no_documents(spark, nothing):
    assert huffman.written_tokens(nothing).count() == 0


def test_long_text_over_many_blocks(spark, tokenizer):
    docs = spark.createDataFrame([(1, "a"), (2, LONG), (3, None)], "doc_id long, text string")
    got = {r["doc_id"]: r for r in huffman.written_tokens(docs, block_ids=1 << 10).collect()}
    ids = ids_of(tokenizer, LONG)
    assert got[2]["n_tokens"] == len(ids) and got[2]["ids_crc32"] == crc32(np.array(ids, "<u4").tobytes())
    assert got[3]["start"] == got[2]["start"] + len(ids)
