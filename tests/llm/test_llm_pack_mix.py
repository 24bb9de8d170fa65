"""Packing, mixing and the corpus pipeline."""

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

import corpus_pipeline
from llm_cases import CASES, frame
from scriptorium.llm import language, mixing, packing, queries, simhash, tokens
from scriptorium.llm.common import documents

SF = "/root/testdata/sf0.001"


def check_pieces(rows, texts, window=1024):
    """Each id in one piece, sequences gapless; returns the share of padding."""
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(tokens.default_tokenizer())
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
    assert set(pieces) == set(texts)
    for doc_id, text in texts.items():
        ids, at = [*whole.encode(text, add_special_tokens=False).ids, 0], 0
        for r in sorted(pieces[doc_id], key=lambda r: r.start):
            part = np.array(ids[r.start : r.start + r.length], dtype="<u4").tobytes()
            assert (r.start, r.doc_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(part))
            at += r.length
        assert at == len(ids)
    padding = used = 0
    for parts in sequences.values():
        at = 0
        for r in sorted(parts, key=lambda r: r.offset):
            assert r.offset == at and r.length > 0
            at += r.length
        assert at <= window
        used += at
        padding += 0 if at & (at - 1) == 0 else window - at
    return padding / max(1, used)


def test_packing_query(spark):
    texts = {r.doc_id: r.text or "" for r in documents(spark, SF).collect()}
    assert check_pieces(queries.op10_packing(spark, SF).collect(), texts) < 0.02


def test_packing_of_awkward_rows(cases, nothing):
    rows = packing.pack(cases).collect()
    assert sum(r.length for r in rows if r.doc_id == 3) == 1
    assert sum(r.length for r in rows if r.doc_id == 9) == 2 * next(r.doc_tokens for r in rows if r.doc_id == 9)
    assert sum(r.length for r in rows if r.doc_id is None) == next(r.doc_tokens for r in rows if r.doc_id is None)
    assert {r.doc_id for r in rows} == {c[0] for c in CASES}
    assert all(len(r.ids) == 4 * r.length for r in rows)
    assert packing.pack(nothing).count() == 0


def test_open_windows_are_bounded_and_lose_nothing():
    rng = random.Random(8)
    windows = packing.OpenWindows(4, 64)
    given, out = 0, []
    for doc in range(500):
        n = rng.choice([1, 3, 20, 63, 64, 65, 200])
        given += n
        out += windows.add((doc, 0, bytes(4 * n), n))
        assert len(windows.open) <= 4
    assert all(sum(len(p[2]) // 4 for p in pieces) == 64 for pieces in out)
    full, partial = windows.close()
    rest = list(packing.powers(partial))
    assert all((n := sum(len(p[2]) // 4 for p in x)) & (n - 1) == 0 for x in rest)
    assert sum(len(p[2]) // 4 for x in [*out, *full, *rest] for p in x) == given


def test_mixing_meets_its_margins(spark):
    rows = queries.op7_mixing(spark, "/root/testdata/sf0.01").collect()
    total = sum(r.tokens for r in rows)
    for margin in mixing.MARGINS:
        held, expected = defaultdict(float), defaultdict(float)
        for r in rows:
            held[r[margin]] += r.tokens
            expected[r[margin]] += r.tokens * r.probability
        powers = {k: v ** mixing.POWER[margin] for k, v in held.items()}
        for k, v in powers.items():
            assert expected[k] == pytest.approx(mixing.KEEP * total * v / sum(powers.values()), rel=0.01)
    assert all(0 < r.probability <= 1 and r.weight == pytest.approx(1 / r.probability) for r in rows)
    kept = sum(r.tokens for r in rows if r.sampled)
    assert kept / total == pytest.approx(mixing.KEEP, abs=0.06)


def test_topics_rest_on_the_whole_text(spark):
    rng = random.Random(5)
    themes = [["".join(rng.choices("abcdefghij", k=6)) for _ in range(20)] for _ in range(2)]
    long = ["internationalization", "counterrevolutionary", "electroencephalogram", "uncharacteristically", "incomprehensibleness"]
    rows = []
    for i in range(40):
        half = [" ".join(rng.sample(themes[i % 2] * 10, k=200)) for _ in range(2)]
        rows += [(i * 10 + k, f"{w} {half[0]} {w} {half[1]} {w}", "en", "s") for k, w in enumerate(long)]
    topic = {r.doc_id: r.topic for r in mixing.mix(frame(spark, rows)).collect()}
    # Texts of one theme agree whatever their longest word, those of the other differ.
    (first, n), (second, m) = (Counter(t for d, t in topic.items() if d // 10 % 2 == theme).most_common(1)[0] for theme in (0, 1))
    assert first != second and min(n, m) >= 90


def test_mixing_on_awkward_rows(cases, nothing):
    rows = mixing.mix(cases).collect()
    assert len(rows) == len(CASES)
    again = {(r.doc_id, r.text_key): r.sampled for r in mixing.mix(cases).collect()}
    assert all(again[(r.doc_id, r.text_key)] == r.sampled for r in rows)
    assert {r.tokens for r in rows if r.doc_id == 3} == {1}
    left = mixing.keep_sampled(cases)
    assert left.columns == cases.columns and left.count() == sum(r.sampled for r in rows)
    assert mixing.mix(nothing).count() == 0 and mixing.keep_sampled(nothing).count() == 0


def brute_rake(cells, power, keep):
    """Rates by the same steps over a dense array in memory; goals by bisection."""
    names = [sorted({c[i] for c in cells}) for i in range(3)]
    mass = np.zeros([len(n) for n in names])
    for *at, m in cells:
        mass[tuple(names[i].index(v) for i, v in enumerate(at))] += m
    goals = []
    for i, margin in enumerate(mixing.MARGINS):
        held = mass.sum(axis=tuple(j for j in range(3) if j != i))
        low, high = 0.0, 1e9
        for _ in range(300):
            level = (low + high) / 2
            low, high = (level, high) if np.minimum(held, level * held ** power[margin]).sum() < keep * held.sum() else (low, level)
        goals.append(np.minimum(held, low * held ** power[margin]))
    rate = np.ones_like(mass)
    errors = []
    for _ in range(mixing.ROUNDS):
        for i, goal in enumerate(goals):
            axes = tuple(j for j in range(3) if j != i)
            now, bound = (mass * rate).sum(axis=axes), np.where(rate >= 1, mass, 0).sum(axis=axes)
            grown = np.where(now > bound, (goal - bound) / np.where(now > bound, now - bound, 1), 1.0)
            factor = np.where(goal <= now, goal / now, grown)
            rate = np.clip(rate * np.expand_dims(factor, axes), 1e-9, 1)
        errors.append(max(np.abs((mass * rate).sum(axis=tuple(j for j in range(3) if j != i)) / g - 1).max() for i, g in enumerate(goals)))
        if errors[-1] <= mixing.TOLERANCE or len(errors) > 1 and errors[-1] > 0.98 * errors[-2]:
            break
    found = {tuple(n[i] for n, i in zip(names, at, strict=True)): rate[at] for at in zip(*np.nonzero(mass), strict=True)}
    return found, errors[-1]


def test_raking_of_skewed_sources_against_numpy(spark):
    rng = random.Random(11)
    cells = [
        (f"s{i}", lang, str(topic), float(int(10 ** rng.uniform(1, 6))))
        for i in range(40)
        for lang in ("en", "de", "fr", "es")
        for topic in range(3)
        if rng.random() < 0.8
    ]
    want, error = brute_rake(cells, mixing.POWER, mixing.KEEP)
    rated, left = mixing.rake(spark.createDataFrame(cells, "source string, lang string, topic string, mass double"))
    got = {(r["source"], r["lang"], r["topic"]): r["rate"] for r in rated.collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-6 for k in got)
    assert abs(left - error) < 1e-6 and left < 0.01
    assert abs(sum(m * got[(a, b, c)] for a, b, c, m in cells) / sum(c[3] for c in cells) - mixing.KEEP) < 0.01


def test_goals_are_within_what_there_is(spark):
    held = spark.createDataFrame([("a", 1e6), ("b", 10.0), ("c", 1.0)], "value string, held double")
    goals = {r["value"]: r["goal"] for r in mixing.targets(held, 0.2, 0.7).collect()}
    assert goals["b"] == 10 and goals["c"] == 1 and abs(sum(goals.values()) - 0.7 * 1_000_011) < 1e-3


def test_goals_out_of_reach_are_reported(spark):
    # The only language of a small source is to shrink, so its source cannot keep its share.
    cells = [("big", "en", "0", 1e6), ("big", "de", "0", 1e3), ("small", "de", "0", 1e3)]
    _, left = mixing.rake(spark.createDataFrame(cells, "source string, lang string, topic string, mass double"))
    assert 0 <= left < 1


def test_pipeline_stages_one_by_one(spark):
    docs = documents(spark, SF)
    columns = docs.columns
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert names == ["language id", "exact dedup", "near dedup", "mixing", "packing"]
    seen = {r.doc_id: r for r in docs.collect()}

    stage = dict(corpus_pipeline.STAGES)
    named = stage["language id"](spark, docs, SF)
    assert named.columns == columns
    sample = language.training_sample(docs)
    letters = {i for i, r in seen.items() if any(map(str.isalpha, r.text or ""))}
    assert sample and {r.doc_id for r in named.collect()} == letters

    unique = stage["exact dedup"](spark, docs, SF)
    last = {}
    for i, r in seen.items():
        key = "".join(c.lower() if "A" <= c <= "Z" else c for c in r.text or "")
        last[key] = max(i, last.get(key, i))
    assert unique.columns == columns and {r.doc_id for r in unique.collect()} == set(last.values())

    apart = stage["near dedup"](spark, docs, SF)
    marks = simhash.near_duplicates(docs, simhash.NEAR_RADIUS, blocking="minhash").collect()
    assert apart.columns == columns
    assert {r.doc_id for r in apart.collect()} == {r.component_id for r in marks}

    mixed = stage["mixing"](spark, docs, SF)
    assert mixed.columns == columns and 0 < mixed.count() < len(seen)


def test_pipeline_runs_through(spark):
    rows = corpus_pipeline.run(spark, SF).collect()
    of = {r.doc_id: r.text or "" for r in documents(spark, SF).collect()}
    used = {r.doc_id for r in rows}
    assert used and used <= set(of)
    crc = [{**r.asDict(), "ids_crc32": zlib.crc32(r.ids)} for r in rows]
    from types import SimpleNamespace

    assert check_pieces([SimpleNamespace(**r) for r in crc], {i: of[i] for i in used}) < 0.02
