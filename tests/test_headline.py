"""Headlines against a plain search over all stretches."""

import random

from scriptorium.functions.text import PLAIN
from scriptorium.operators.headline import headlines


def brute(words, terms, longest=35, shortest=20):
    n = len(words)
    best = None
    for s in range(n):
        if words[s] not in terms:
            continue
        for e in range(s, min(n, s + longest)):
            if words[e] in terms:
                kinds = len({w for w in words[s : e + 1] if w in terms})
                value = (kinds, s - e, -s)
                if best is None or value > best[0]:
                    best = (value, s, e + 1)
    s, e = (best[1], best[2]) if best else (0, 0)
    e = max(e, min(s + shortest, n))
    s = max(0, min(s, e - shortest))
    return " ".join(f"<mark>{w}</mark>" if w in terms else w for w in words[s:e])


def test_shortest_cover_of_most_terms(spark):
    draw = random.Random(2)
    texts = [[draw.choice("abcdefghijklmnop" * 3 + "xyz") for _ in range(draw.randint(1, 120))] for _ in range(40)]
    hits = spark.createDataFrame([(1, i + 1, " ".join(t)) for i, t in enumerate(texts)], "query_id long, rank int, content string")
    queries = spark.createDataFrame([(1, "x y z q")], "query_id long, query string")
    got = {r["rank"]: r["headline"] for r in headlines(hits, queries, PLAIN).collect()}
    assert got == {i + 1: brute(t, {"x", "y", "z", "q"}) for i, t in enumerate(texts)}


def test_odd_texts(spark):
    rows = [(1, 1, ""), (1, 2, None), (1, 3, "...x, y!"), (2, 4, "no query")]
    hits = spark.createDataFrame(rows, "query_id long, rank int, content string")
    queries = spark.createDataFrame([(1, "x y.z")], "query_id long, query string")
    got = {r["rank"]: r["headline"] for r in headlines(hits, queries, PLAIN).collect()}
    assert got == {1: None, 2: None, 3: "<mark>x</mark>, y", 4: None}
