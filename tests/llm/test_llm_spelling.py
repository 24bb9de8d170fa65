"""Word counts, near words, forms and roots against brute force."""

import random
import re
from collections import Counter
from zlib import crc32

import numpy as np
import pytest
from llm_cases import LONG

from scriptorium.llm import spelling

RUNS = re.compile("[A-Za-zÀ-ÿ]+")
UPPER = {c: c + 32 for c in range(65, 91)}


def brute_vocabulary(rows, min_chars=5, min_count=3):
    total = Counter()
    for doc_id, text in rows:
        for run in RUNS.findall(text or ""):
            word = run.translate(UPPER)
            h = crc32(f"{'' if doc_id is None else doc_id}:{word}".encode())
            if h % 97 == 0:
                at = h % len(word)
                word = word[:at] + word[at + 1 :]
            total[word] += 1
    return {w: n for w, n in total.items() if n >= min_count and len(w) >= min_chars}


def one_apart(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    if len(a) > len(b):
        a, b = b, a
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute_variants(counts, dominance=2):
    near = {w: [v for v in counts if one_apart(w, v)] for w in counts}
    form = {}
    for word, found in near.items():
        best = min(found, key=lambda v: (-counts[v], v), default=None)
        if best is not None and counts[best] >= dominance * counts[word]:
            form[word] = best
    out = {}
    for word, n in counts.items():
        root = word
        while root in form:
            root = form[root]
        out[word] = (form.get(word), root, n, len(near[word]), counts[form[word]] if word in form else None)
    return out


def rows_of(frame):
    return {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in frame.collect()}


def random_texts(seed, count=60):
    draw = random.Random(seed)
    stems = ["".join(draw.choice("abéÿ") for _ in range(draw.randint(4, 8))) for _ in range(40)]
    rows = []
    for doc in range(count):
        words = []
        for _ in range(60):
            word = draw.choice(stems)
            if draw.random() < 0.3:
                at = draw.randrange(len(word))
                word = draw.choice([word[:at] + word[at + 1 :], word[:at] + draw.choice("abZ") + word[at:], word[:at] + "x" + word[at + 1 :]])
            words.append(draw.choice([word, word.upper() if word.isascii() else word]))
        rows.append((doc, draw.choice([" ", "-", "ă", "1"]).join(words)))
    return rows


def test_runs_of_bytes_are_those_of_characters():
    texts = ["", "Éa×b cĀd", "x", "", "yÿŸz 中a", "À"]
    data = [t.encode() for t in texts]
    offsets = np.concatenate([[0], np.cumsum([len(d) for d in data])])
    runs, text = spelling.letter_runs(np.frombuffer(b"".join(data), np.uint8), offsets)
    want = [(m.translate(UPPER), i) for i, t in enumerate(texts) for m in RUNS.findall(t)]
    assert list(zip([r.decode() for r in runs.to_pylist()], text.tolist(), strict=True)) == want


@pytest.mark.parametrize("limit", [4096, 7])
def test_variants_against_brute_force(spark, limit):
    rows = random_texts(3)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    counts = brute_vocabulary(rows)
    assert len(counts) > 100
    assert rows_of(spelling.spelling_variants(docs, limit=limit)) == brute_variants(counts)


@pytest.mark.parametrize("min_chars", [1, 2, 3])
def test_short_words_too(spark, min_chars):
    rows = [(i, "a b ab ba abc bc bcd a ab x") for i in range(4)] + [(9, "a a a ab ab")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute_variants(brute_vocabulary(rows, min_chars, 1))
    assert rows_of(spelling.spelling_variants(docs, min_chars=min_chars, min_count=1)) == want


def test_chain_of_forms_and_ties(spark):
    counts = [("aaaaa", 100), ("aaaab", 40), ("aaabb", 16), ("aabbb", 7), ("abbbb", 3), ("zaaaa", 40), ("ÿaaab", 3)]
    words = spark.createDataFrame(counts, "word string, n long")
    got = {r["word"]: (r["best"], r["n_near"]) for r in spelling.near_words(words).collect()}
    assert got["aaaaa"] == ("aaaab", 2)
    assert got["aaabb"] == ("aaaab", 2)
    forms = spark.createDataFrame([("abbbb", "aabbb"), ("aabbb", "aaabb"), ("aaabb", "aaaab"), ("aaaab", "aaaaa")], "word string, form string")
    assert {tuple(r) for r in spelling.roots(forms).collect()} == {(w, "aaaaa") for w in ("abbbb", "aabbb", "aaabb", "aaaab")}


def test_awkward_documents(spark, cases, nothing):
    rows = [(r["doc_id"], r["text"]) for r in cases.select("doc_id", "text").collect()]
    want = brute_variants(brute_vocabulary(rows))
    assert "lorem" in want
    assert rows_of(spelling.spelling_variants(cases)) == want
    assert spelling.spelling_variants(nothing).count() == 0


def test_words_of_many_letters(spark):
    long = "ab" * 700
    rows = [(i, f"{long} {long}x {'q' * 70} {LONG[:40]}") for i in range(4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert rows_of(spelling.spelling_variants(docs)) == brute_variants(brute_vocabulary(rows))


def test_no_circles(spark):
    with pytest.raises(ValueError):
        spelling.spelling_variants(spark.createDataFrame([], "doc_id long, text string"), dominance=1)
