"""Operators against brute force on small fixtures."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from scriptorium.config import EngineConfig
from scriptorium.functions.text import PLAIN, PORTER
from scriptorium.operators import evaluation, fusion, graph, keyword, lookup, rerank, vector
from scriptorium.operators.index import build_index, with_chunk_id
from scriptorium.plans import ingest

CHUNK_COLUMNS = "file_path string, chunk_index int, title string, content string, category string"


def make_chunks(spark, rows):
    return spark.createDataFrame(rows, CHUNK_COLUMNS)


@pytest.fixture(scope="module")
def corpus(spark):
    chunks = make_chunks(
        spark,
        [
            ("a.md", 0, "Payments", "How billing works for alice@example.com", "guides"),
            ("b.md", 0, "Billing", "How payments are routed", "guides"),
            ("c.md", 0, "Docker", "Compose files, example dot com and alice", "ops"),
            ("c.md", 1, "Docker", "Running docker containers: run, runs, running", "ops"),
        ],
    )
    return chunks, build_index(chunks, PORTER)


def found(spark, corpus, text, k=5, category=None, **kw):
    chunks, index = corpus
    queries = spark.createDataFrame([(1, text, category)], "query_id long, query string, category string")
    hits = keyword.keyword_search(index, queries, chunks, k, **kw)
    return [(r.file_path, r.chunk_index) for r in hits.orderBy("rank").collect()]


def test_keyword_semantics(spark, corpus):
    assert found(spark, corpus, "billing") == [("b.md", 0), ("a.md", 0)]  # the title outweighs the text
    assert set(found(spark, corpus, "payment docker")) == {("a.md", 0), ("b.md", 0), ("c.md", 0), ("c.md", 1)}
    assert found(spark, corpus, "payment", category="ops") == []
    several = spark.createDataFrame([(1, "payment docker", ["ops", "none"]), (2, "payment", None)], "query_id long, query string, categories array<string>")
    hits = keyword.keyword_search(corpus[1], several, corpus[0]).collect()
    assert {h.category for h in hits if h.query_id == 1} == {"ops"} and len([h for h in hits if h.query_id == 2]) == 2
    assert found(spark, corpus, '"*()') == [] and found(spark, corpus, "zebra") == []
    assert found(spark, corpus, "alice@example.com") == [("a.md", 0)]  # a phrase, in order
    assert found(spark, corpus, "ran") == [] and found(spark, corpus, "runs") == [("c.md", 1)]


def test_unbounded_queries_take_the_other_way(spark, corpus):
    tiny = EngineConfig(small_rows=0)
    for text in ("billing", "alice@example.com docker", "payment docker"):
        assert found(spark, corpus, text, config=tiny) == found(spark, corpus, text)


def test_bm25_by_hand(spark, corpus):
    import math

    chunks, index = corpus
    queries = spark.createDataFrame([(1, "docker docker")], "query_id long, query string")
    got = {(r.file_path, r.chunk_index): r.score for r in keyword.keyword_search(index, queries, chunks).collect()}
    lengths = [1 + 7, 1 + 4, 1 + 7, 1 + 6]
    idf = max(math.log((4 - 2 + 0.5) / 2.5), 1e-6)

    def score(tf, length):
        return 2 * idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / (sum(lengths) / 4)))

    assert got[("c.md", 0)] == pytest.approx(score(10, lengths[2]), abs=1e-6)
    assert got[("c.md", 1)] == pytest.approx(score(11, lengths[3]), abs=1e-6)


def test_overlapping_phrase_counts(spark):
    chunks = make_chunks(spark, [("x", 0, "", "a b a b a, c", None), ("y", 0, "", "a-b", None), ("z", 0, "", "b a", None)])
    index = build_index(chunks, PLAIN)
    queries = spark.createDataFrame([(1, "a.b.a"), (2, "a.b")], "query_id long, query string")
    phrases = keyword.match_phrases(index, queries, chunks).hits.join(with_chunk_id(chunks).select("chunk_id", "file_path"), "chunk_id")
    got = {(r.phrase, r.file_path): r.tf_content for r in phrases.filter("phrase like '% %'").collect()}
    assert got == {("a b a", "x"): 2, ("a b", "x"): 2, ("a b", "y"): 1}


def brute_nearest(queries, docs, k, categories=None, wanted=None):
    q = queries / np.linalg.norm(queries, axis=1, keepdims=True)
    d = docs / np.linalg.norm(docs, axis=1, keepdims=True)
    scores = np.round(q @ d.T, 6)
    out = {}
    for i in range(len(q)):
        allowed = [j for j in range(len(d)) if not wanted or wanted[i] is None or categories[j] == wanted[i]]
        out[i] = sorted((scores[i, j] for j in allowed), reverse=True)[:k]
    return out


@pytest.mark.parametrize("per_block", [(1000, 1000), (4, 16)])
@pytest.mark.parametrize("within", [False, True])
def test_nearest_both_ways(spark, per_block, within):
    rng = np.random.default_rng(3)
    docs, asked = rng.normal(size=(60, 5)), rng.normal(size=(9, 5))
    docs[40:] = docs[0]  # a third of all vectors are copies of one
    kinds = ["odd" if i % 2 else "even" for i in range(60)]
    wanted = [None, "odd", "even"] * 3
    vectors = spark.createDataFrame(
        [(f"d{i}", 0, kinds[i], [float(x) for x in v]) for i, v in enumerate(docs)],
        "file_path string, chunk_index int, category string, embedding array<double>",
    ).repartition(4)
    queries = spark.createDataFrame(
        [(i, wanted[i], [float(x) for x in v]) for i, v in enumerate(asked)], "query_id long, category string, query_embedding array<double>"
    )
    hits = vector.nearest_scores(queries, vectors, 25, within_category=within, per_block=per_block).collect()
    want = brute_nearest(asked, docs, 25, kinds, wanted if within else None)
    for i in range(9):
        assert sorted((h.score for h in hits if h.query_id == i), reverse=True) == pytest.approx(want[i], abs=2e-6)


def test_fusion_arithmetic(spark):
    def ranks(pairs):
        return spark.createDataFrame([(1, k, r) for k, r in pairs], "query_id long, key string, rank int")

    fused = fusion.fuse_ranks(ranks([("a", 1), ("b", 2), ("a", 5)]), ranks([("b", 1), ("c", 2)]), 10).orderBy("rank").collect()
    assert [r.key for r in fused] == ["b", "c", "a"]
    assert fused[0].score == pytest.approx(1 / 62 + 1 / 61) and fused[2].score == pytest.approx(1 / 65)
    tie = fusion.fuse_ranks(ranks([("x", 1)]), ranks([("y", 1)]), 1).first()
    assert tie.key == "y"


def brute_mmr(q, docs, lam):
    cos = lambda a, b: float(a @ b / (np.linalg.norm(a) * np.linalg.norm(b)))
    left, picked = list(range(len(docs))), []
    while left:
        best = max(left, key=lambda i: lam * cos(q, docs[i]) - (1 - lam) * max((cos(docs[i], docs[j]) for j in picked), default=0))
        if not picked:
            best = max(left, key=lambda i: cos(q, docs[i]))
        picked.append(best)
        left.remove(best)
    return picked


def test_mmr_against_brute_force(spark):
    rng = np.random.default_rng(5)
    q, docs = rng.normal(size=4), rng.normal(size=(12, 4))
    for lam in (0.1, 0.5, 0.9):
        assert rerank.mmr_order(q, docs, lam) == brute_mmr(q, docs, lam)
    assert rerank.mmr_order(q, docs, 1.0) == list(range(12)) and rerank.mmr_order(np.zeros(4), docs, 0.5) == list(range(12))


def hits_frame(spark, rows):
    return with_chunk_id(
        spark.createDataFrame(rows, "query_id long, rank int, score double, file_path string, chunk_index int, title string, content string")
    )


def test_diversify_collapse_rerank(spark):
    hits = hits_frame(spark, [(1, 1, 3.0, "a", 0, "", "x"), (1, 2, 2.0, "a", 1, "", "xxxx"), (1, 3, 1.0, "b", 0, "", "xx"), (1, 4, 0.5, None, 0, "", "y")])
    assert [(r.file_path, r.rank) for r in rerank.collapse_by_document(hits).orderBy("rank").collect()] == [("a", 1), ("b", 2)]
    queries = spark.createDataFrame([(1, "q", [1.0, 0.0])], "query_id long, query string, query_embedding array<double>")
    scored = rerank.rerank(hits, queries, lambda q, p: [float(len(x)) for x in p], 2).orderBy("rank").collect()
    assert [r.content for r in scored] == ["xxxx", "xx"] and scored[0].rerank_score == pytest.approx(0.982)
    vectors = with_chunk_id(
        spark.createDataFrame([("a", 0, [1.0, 0.1]), ("a", 1, [1.0, 0.11]), ("b", 0, [0.8, -0.6])], "file_path string, chunk_index int, embedding array<double>")
    )
    some = hits.filter("file_path is not null")
    order = [r.chunk_id for r in rerank.diversify(some, queries, vectors, 0.5).orderBy("rank").collect()]
    assert order[1] == [r.chunk_id for r in some.filter("file_path = 'b'").collect()][0]
    incomplete = rerank.diversify(hits, queries, vectors, 0.5).orderBy("rank").collect()
    assert [r.rank for r in incomplete] == [1, 2, 3, 4] and incomplete[0].file_path == "a"


def test_highlight(spark):
    body = " ".join(f"w{i}" for i in range(60)) + " Running payments, fast! end"
    hits = hits_frame(spark, [(1, 1, 1.0, "a", 0, "", body), (1, 2, 1.0, "b", 0, "", "(run) it"), (1, 3, 1.0, "c", 0, "", "nothing here")])
    queries = spark.createDataFrame([(1, "runs payment")], "query_id long, query string")
    marked = {r.file_path: r.highlight for r in rerank.highlight(hits, queries, PORTER).collect()}
    assert marked["a"].startswith("...") and marked["a"].endswith("<mark>Running payments</mark>, fast! end")
    assert len(marked["a"].split()) == 32
    assert marked["b"] == "(<mark>run</mark>) it" and marked["c"] == "nothing here"


def brute_related(edges, start, depth):
    seen, out, frontier = {start}, [], [start]
    for hop in range(1, depth + 1):
        fresh = []
        for node in frontier:
            steps = [(t, b, "outgoing") for a, b, t in edges if a == node] + [(t, a, "incoming") for a, b, t in edges if b == node and a != b]
            for t, b, d in sorted(steps, key=lambda s: (s[0], s[1], s[2])):
                if b not in seen:
                    seen.add(b)
                    out.append((b, t, d, hop))
                    fresh.append(b)
        frontier = fresh
    return out[:50]


def test_related_matches_breadth_first_search(spark):
    rng = np.random.default_rng(11)
    edges = sorted({(f"n{a}", f"n{b}", f"t{k}") for a, b, k in zip(rng.integers(0, 40, 90), rng.integers(0, 40, 90), rng.integers(0, 3, 90))})
    links = spark.createDataFrame(edges, "source_path string, target_path string, relation_type string")
    starts = spark.createDataFrame([("n1",), ("n2",), ("missing",)], "path string")
    for depth in (2, 3):
        rows = graph.related(links, starts, depth).orderBy("position").collect()
        for start in ("n1", "n2"):
            got = [(r.related_path, r.relation_type, r.direction, r.hops) for r in rows if r.path == start]
            assert got == brute_related(edges, start, depth)
    typed = {(r.related_path, r.relation_type): r.hops for r in graph.related_by_type(links, starts, 3).filter("path = 'n1'").collect()}
    assert all(h >= 1 for h in typed.values()) and "n1" not in {p for p, _ in typed}


def test_co_change_bounds(spark):
    rows = [("big", f"f{i}") for i in range(21)] + [("one", "f1"), ("two", "f1"), ("two", "f2")]
    files = spark.createDataFrame(rows, "commit_id string, file string")
    got = {(r.source_path, r.target_path) for r in graph.co_change_links(files).collect()}
    assert got == {("git-history/f1", "git-history/f2"), ("git-history/f2", "git-history/f1")}


def test_substring_lookups(spark):
    chunks = make_chunks(spark, [("src/a.py", 0, "", "", "x"), ("src/a.py", 1, "", "", "x"), ("docs/Readme.md", 0, "", "", "y"), ("q_z.txt", 0, "", "", "y")])
    asked = ["a.py", "readme", "%", "/", "s%a", "q_z", "zz.z", ".m"]
    queries = spark.createDataFrame([(q, q) for q in asked], "query_id string, query string")
    got = {}
    for r in lookup.path_lookup(queries, chunks, 10).collect():
        got.setdefault(r.query_id, set()).add((r.file_path, r.chunk_index))
    import re

    for q in asked:
        pattern = re.compile(".*" + "".join(".*" if c == "%" else "." if c == "_" else re.escape(c) for c in q.lower()) + ".*")
        want = {(r.file_path, r.chunk_index) for r in chunks.collect() if pattern.fullmatch(r.file_path.lower())}
        assert got.get(q, set()) == want, q
    needles = spark.createDataFrame([(1, "one two three"), (2, "wo"), (3, "x"), (4, "two three")], "needle_id long, needle string")
    texts = spark.createDataFrame([("t1", "zero one two three four"), ("t2", "one two  three"), ("t3", "tone two threes")], "text_id string, text string")
    pairs = {(r.needle_id, r.text_id) for r in lookup.containing_texts(needles, texts, lambda t: F.split(t, r"\s+")).collect()}
    assert pairs == {(n.needle_id, t.text_id) for n in needles.collect() for t in texts.collect() if n.needle in t.text}


def test_evaluation(spark):
    import math

    hits = spark.createDataFrame([(1, "a", 1), (1, "b", 2), (1, "c", 3), (2, "x", 1)], "query_id long, doc string, rank int")
    qrels = spark.createDataFrame([(1, "b", 1.0), (1, "z", 2.0), (3, "q", 1.0)], "query_id long, doc string, gain double")
    rows = {r.query_id: r for r in evaluation.per_query_metrics(hits, qrels, 10).collect()}
    ideal = 2.0 + 1.0 / math.log2(3)
    assert rows[1].reciprocal_rank == 0.5 and rows[1].recall == 0.5 and rows[1].precision == pytest.approx(1 / 3, abs=1e-6)
    assert rows[1].ndcg == pytest.approx((1 / math.log2(3)) / ideal, abs=1e-6)
    assert rows[3].hit == 0.0 and 2 not in rows
    cases = spark.createDataFrame([(1, ["B"]), (9, ["x"])], "query_id long, expected_paths array<string>")
    scored = {r.query_id: r for r in evaluation.path_relevance(hits.withColumnRenamed("doc", "file_path"), cases, 5).collect()}
    assert scored[1].hit == 1.0 and scored[1].reciprocal_rank == 0.5 and scored[9].hit == 0.0
    times = spark.createDataFrame([(float(i),) for i in range(100)], "ms double")
    row = evaluation.latency_percentiles(times).first()
    assert (row.p50, row.p95, row.p99) == (50.0, 95.0, 99.0)


def test_discovery(spark):
    page = "<a href='{}'>x</a>"
    pages = spark.createDataFrame(
        [("https://h/a", page.format("/b") + page.format("https://other/z")), ("https://h/b", page.format("/c")), ("https://h/c", page.format("/a"))],
        "url string, html string",
    )
    assert {(r.url, r.depth) for r in ingest.discover_by_links(pages, "https://H/a/", 2).collect()} == {("https://h/a", 0), ("https://h/b", 1), ("https://h/c", 2)}
    assert ingest.discover_by_links(pages, "https://h/a", 0).count() == 1
    maps = spark.createDataFrame(
        [
            ("https://h/sitemap.xml", "<sitemapindex><sitemap><loc>https://h/one.xml</loc></sitemap></sitemapindex>"),
            ("https://h/one.xml", "<urlset><url><loc>https://H/p/</loc></url><url><loc>https://x/q</loc></url></urlset>"),
        ],
        "url string, xml string",
    )
    assert [r.url for r in ingest.discover_from_sitemaps(maps, "h").collect()] == ["https://h/p"]
