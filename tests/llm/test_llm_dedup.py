"""SimHash near-dedup, exact dedup, substring dedup and components."""

import random
import re

import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from llm_cases import CASES, LONG, frame
from oracle_check import compare, duck
from scriptorium.llm import exact, lines, queries, simhash
from scriptorium.llm.bitslice import linked
from scriptorium.llm.common import documents
from scriptorium.llm.components import connected_components

SF = "/root/testdata/sf0.001"


def simple_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def roots(nodes, edges):
    parent = {n: n for n in nodes}

    def find(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def within(values, radius):
    return [(a, b) for i, a in enumerate(values) for b in values[:i] if (a ^ b).bit_count() <= radius]


@pytest.mark.parametrize("radius", [0, 1, 3, 7, 10])
def test_bit_slices_against_all_pairs(radius):
    rng = random.Random(radius)
    values = set()
    for _ in range(60):
        base = rng.getrandbits(64)
        for _ in range(rng.randint(1, 6)):
            values.add(base)
            for bit in rng.sample(range(64), rng.randint(1, 4)):
                base ^= 1 << bit
    values = sorted(values)
    blocks = [values[:150], values[100:], values[:1], []]
    a, b = linked([np.array(x, np.uint64).view(np.int64) for x in blocks], radius)
    want = set()
    for block in blocks:
        want |= {(n, r) for n, r in roots(block, within(block, radius)).items() if n != r}
    assert set(zip(a.view(np.uint64).tolist(), b.view(np.uint64).tolist(), strict=True)) == want


def test_masks_leave_no_pair_out():
    masks = simhash.block_masks(3)
    rng = random.Random(1)
    for _ in range(500):
        difference = sum(1 << b for b in rng.sample(range(64), 3))
        assert any(not difference & m for m in masks)


def test_simhash_query_against_all_pairs(spark):
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in queries.op1_simhash_near_dedup(spark, SF).collect()}
    prints = {r.doc_id: simple_fingerprint(r.text) for r in documents(spark, SF).collect()}
    ids = sorted(prints)
    edges = [(a, b) for i, a in enumerate(ids) for b in ids[:i] if (prints[a] ^ prints[b]).bit_count() <= 3]
    root = roots(ids, edges)
    assert got == {i: (format(prints[i], "016x"), root[i]) for i in ids}


def test_split_blocks_find_the_same_links(spark):
    rng = random.Random(5)
    start = rng.getrandbits(62)
    prints = sorted({start ^ sum(1 << b for b in rng.sample(range(20), 2)) for _ in range(150)})
    rows = spark.createDataFrame([(p,) for p in prints], "fp long")
    members = simhash.by_masks(rows, 3)
    want = {n: r for n, r in roots(prints, within(prints, 3)).items()}
    for limit in (8, 4096):
        found = connected_components(simhash.near_edges(members, 3, limit)).collect()
        assert {**{p: p for p in prints}, **{r.node: r.root for r in found}} == want


def test_simhash_on_awkward_rows(cases, nothing):
    rows = simhash.near_duplicates(cases).collect()
    assert len(rows) == len(CASES)
    of = {}
    for r in rows:
        of.setdefault(r.doc_id, r)
    assert of[2].component_id == of[10].component_id == 1
    assert of[3].fp == of[4].fp == of[5].fp == 0 and of[5].component_id == 3
    assert of[9].component_id == of[None].component_id == 9
    assert simhash.near_duplicates(nothing).count() == 0
    assert simhash.keep_one(nothing).count() == 0
    left = simhash.keep_one(cases)
    assert left.columns == cases.columns
    assert sorted((r.doc_id for r in left.collect())) == [1, 3, 6, 7, 8, 9, 9]


def test_near_copies_go_and_clean_documents_stay(spark):
    rng = random.Random(2)
    vocabulary = ["".join(rng.choices("abcdefghij", k=6)) for _ in range(3000)]
    rows, near = [], set()
    for i in range(60):
        words = rng.choices(vocabulary, k=200)
        rows.append((2 * i, " ".join(words), "en", "s"))
        if i % 3 == 0:
            words[rng.randrange(200)] = "edited"
            rows.append((2 * i + 1, " ".join(words), "en", "s"))
            near.add(2 * i + 1)
    left = {r.doc_id for r in simhash.keep_one(frame(spark, rows)).collect()}
    assert left == {r[0] for r in rows} - near


def five_words(words):
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)}


def similarity(a, b):
    return len(five_words(a) & five_words(b)) / len(five_words(a) | five_words(b))


def test_copies_with_another_head_or_tail_go(spark):
    rng = random.Random(11)
    vocabulary = ["".join(rng.choices("abcdefghij", k=6)) for _ in range(5000)]
    rows, near, apart = [], set(), set()
    for i in range(240):
        words = rng.choices(vocabulary, k=300)
        # Words of the copy that are others: a similarity of 0.80 to 0.85, or of 0.60 to 0.65.
        cut = rng.randint(25, 32) if i < 160 else rng.randint(64, 73)
        fresh = rng.choices(vocabulary, k=cut)
        copy = fresh + words[cut:] if i % 2 else words[:-cut] + fresh
        s = similarity(words, copy)
        assert 0.8 <= s < 0.86 if i < 160 else 0.59 < s < 0.66
        rows += [(2 * i, " ".join(words), "en", "s"), (2 * i + 1, " ".join(copy), "en", "s")]
        (near if i < 160 else apart).add(2 * i + 1)
    left = {r.doc_id for r in simhash.keep_one(frame(spark, rows)).collect()}
    print("copies left", len(near & left), "of", len(near), "others gone", len(apart - left), "of", len(apart))
    assert len(near & left) <= 0.03 * len(near)
    assert len(apart - left) <= 0.02 * len(apart)
    assert {r[0] for r in rows} - near - apart <= left


def test_components_of_chains_stars_and_loops(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 60)] + [(7, 7), (200, 201), (201, 200)]
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    nodes = {n for e in edges for n in e}
    assert got == roots(nodes, edges)
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_exact_query_against_sql(spark):
    assert compare(spark, duck(SF), SF, queries.op4_exact_dedup, queries.OP4_SQL)["ok"]


@pytest.mark.parametrize("bits", [1, 4])
def test_exact_on_awkward_rows(cases, nothing, bits):
    rows = exact.exact_groups(cases, bits).collect()
    assert len(rows) == len(CASES) and sum(r.kept for r in rows) == 7
    by_id = {r.doc_id: r for r in rows}
    assert (by_id[1].keep_id, by_id[1].group_size, by_id[10].kept) == (10, 3, True)
    assert (by_id[3].keep_id, by_id[3].group_size) == (4, 2)
    assert sum(r.kept for r in rows if r.doc_id == 9) == 1 and by_id[None].keep_id == 9
    left = exact.keep_unique(cases, bits)
    assert left.columns == cases.columns
    assert sorted(r.doc_id for r in left.collect()) == [4, 5, 6, 7, 8, 9, 10]
    assert exact.exact_groups(nothing).count() == 0 and exact.keep_unique(nothing).count() == 0


def simple_repeats(docs, min_words=5):
    """Every unit that has an earlier equal, over (doc_id, text)."""
    seen, found = {}, set()
    for doc_id, text in sorted(docs):
        at = 0
        for m in [*re.finditer(r"\n+|(?<=[.!?]) +", text), None]:
            end = m.start() if m else len(text)
            words = text[at:end].lower().split()
            if len(words) >= min_words:
                first = seen.setdefault(" ".join(words), (doc_id, at))
                if first != (doc_id, at):
                    found.add((doc_id, at, end, *first))
            at = m.end() if m else at
    return found


def test_repeated_units_against_a_loop(spark):
    got = {tuple(r) for r in queries.op5_substring_dedup(spark, SF).collect()}
    docs = duckdb.sql(f"SELECT doc_id, text FROM '{SF}/documents.parquet'").fetchall()
    assert got == simple_repeats(docs) and got


def test_repeats_on_awkward_rows(spark, cases, nothing):
    got = {tuple(r) for r in lines.repeated_units(cases).collect()}
    n = len(CASES[0][1])
    assert got == {(2, 0, n, 1, 0), (10, 0, n, 1, 0)}
    cleaned = {r.doc_id: r for r in lines.remove_repeats(cases).collect()}
    assert cleaned[1].text == CASES[0][1] and cleaned[10].text == "" and cleaned[8].text == LONG
    assert [tuple(x) for x in cleaned[2].removed] == [(0, n)]
    assert lines.repeated_units(nothing).count() == 0
    passage = "This passage of many words is found in two places. It goes on. And so we come to the end of it all."
    docs = frame(spark, [(1, "Start é here. " + passage, None, None), (2, passage + "\nTail stays.", None, None)])
    texts = {r.doc_id: r.text for r in lines.remove_repeats(docs).collect()}
    assert texts == {1: "Start é here. " + passage, 2: " It goes on. \nTail stays."}


def test_all_columns_are_read_by_value(cases):
    assert exact.exact_groups(cases.withColumn("text", F.upper("text"))).count() == len(CASES)


def test_equal_fingerprints_are_not_taken_for_equal_texts(spark):
    """One repeated shingle in over half of a text decides all bits of its fingerprint."""
    rng = random.Random(4)
    rows = [(i, "ha " * 400 + " ".join(f"w{rng.randrange(10**9)}" for _ in range(300))) for i in range(2)]
    rows += [(2, rows[0][1] + " and one word more"), (3, rows[1][1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r["doc_id"]: r for r in simhash.near_duplicates(docs, simhash.NEAR_RADIUS, blocking="minhash").collect()}
    assert found[0]["fp"] == found[1]["fp"]
    assert [found[i]["component_id"] for i in range(4)] == [0, 1, 0, 1]
    assert {r["doc_id"] for r in simhash.keep_one(docs).collect()} == {0, 1}


def test_rewritten_ends_are_near(spark):
    """Texts of similarity 0.8 to 0.86 whose head or tail is another one; 0.6 and below stay."""
    rng = random.Random(6)

    def prose(n):
        return [f"w{rng.randrange(10**6)}" for _ in range(n)]

    rows, near = [], {}
    for i in range(30):
        words, cut = prose(300), rng.choice([24, 30])
        rows.append((10 * i, " ".join(words)))
        rows.append((10 * i + 1, " ".join(words[:-cut] + prose(cut) if i % 2 else prose(cut) + words[cut:])))
        rows.append((10 * i + 2, " ".join(words[:-90] + prose(90))))
        near[10 * i + 1] = 10 * i
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r["doc_id"]: r["component_id"] for r in simhash.near_duplicates(docs, simhash.NEAR_RADIUS, blocking="minhash").collect()}
    assert all(found[i] == near.get(i, i) for i in found)


def test_null_and_empty_rows_of_one_document_are_one(spark):
    docs = spark.createDataFrame([(1, None), (1, ""), (1, ""), (2, "x"), (2, "x")], "doc_id long, text string")
    assert sorted((r["doc_id"], r["text"] or "") for r in exact.keep_unique(docs).collect()) == [(1, ""), (2, "x")]
