"""What is exchanged between tasks by the queries over links and histories."""

import re

import numpy as np
import pytest

from scriptorium.operators import graph, history
from scriptorium.plans import corpus, ingest, registry

SF = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("walk", [graph.related, graph.related_by_type])
def test_walks_exchange_lists_by_start_only(spark, monkeypatch, walk):
    rng = np.random.default_rng(5)
    edges = sorted({(f"n{a}", f"n{b}", f"t{k}") for a, b, k in zip(rng.integers(0, 30, 200), rng.integers(0, 30, 200), rng.integers(0, 3, 200))})
    links = spark.createDataFrame(edges, "source_path string, target_path string, relation_type string")
    starts = spark.createDataFrame([("n1",), ("n2",), ("missing",)], "path string")
    found = walk(links, starts, 2)
    assert not re.search(r"Exchange hashpartitioning\(start#\d+L?, path#", plan(found))
    want = sorted(map(str, found.collect()))
    # Paths with more neighbours than a list holds have several lists.
    monkeypatch.setattr(graph, "LIST_SIZE", 2)
    assert sorted(map(str, walk(links, starts, 2).collect())) == want


def test_commits_are_exchanged_once_and_pairs_once(spark):
    pairs = graph.co_change_links(corpus.commit_files(spark, SF))
    assert len(re.findall(r"Exchange hashpartitioning", plan(pairs))) == 2


def test_chunking_computes_each_text_once(spark):
    """Expressions that name a text often hold it, and the search for its parts, once."""
    docs = spark.createDataFrame([("a.md", "x")], "file_path string, body string")
    chunked = ingest.chunk_documents(docs, 600)
    shown = chunked._jdf.queryExecution().optimizedPlan().toString()
    assert len(re.findall(r"\bbody#\d+", shown.split("LogicalRDD")[0])) <= 4


def test_titles_of_related_pages_need_no_commits(spark, monkeypatch):
    def no_commits(*_):
        raise AssertionError("commits read for page links")

    monkeypatch.setattr(corpus, "commit_files", no_commits)
    monkeypatch.setattr(corpus, "_SHARED", {})
    registry.QUERIES["related_titles"](spark, SF)


def test_pairs_of_files_are_exchanged_as_numbers_without_a_distinct_before(spark):
    shown = plan(registry.QUERIES["co_change_links"](spark, SF))
    assert len(re.findall(r"Exchange hashpartitioning", shown)) == 2
    # Read upwards: the pairs' exchange comes straight after they are made, names come last.
    below = shown.split("Exchange hashpartitioning(a#")[1]
    assert "keys=[a#" not in below and "parts/part-" not in below


def test_titles_of_related_pages_need_no_commit_numbers(spark, monkeypatch):
    def no_commits(*_):
        raise AssertionError("commits read for page links")

    monkeypatch.setattr(corpus, "commit_parts", no_commits)
    monkeypatch.setattr(corpus, "_SHARED", {})
    registry.QUERIES["related_titles"](spark, SF)


def test_hybrid_search_takes_its_keyword_hits_from_blocks(spark, monkeypatch):
    def no_postings(*_):
        raise AssertionError("postings joined with the queries")

    monkeypatch.setattr(corpus, "chunk_index", no_postings)
    assert registry.QUERIES["hybrid_rrf"](spark, SF).count() > 0


@pytest.mark.parametrize("name", ["hybrid_linear", "search_within"])
def test_blended_and_limited_searches_need_no_postings(spark, monkeypatch, name):
    def no_postings(*_):
        raise AssertionError("postings joined with the queries")

    monkeypatch.setattr(corpus, "chunk_index", no_postings)
    assert registry.QUERIES[name](spark, SF).count() > 0


def test_histories_exchange_a_row_once_by_commit_and_once_by_file(spark):
    shown = plan(registry.QUERIES["history_markdown"](spark, SF))
    exchanged = re.findall(r"Exchange hashpartitioning\((\w+)#", shown)
    assert exchanged.count("file") == 1 and len(exchanged) <= 4
    # What follows from the order's own columns is made behind the exchange by file.
    assert "sha2" not in shown.split("Exchange hashpartitioning(file#")[1]


def test_histories_of_some_files_and_of_the_newest_commits(spark):
    heads = [(i, f"h{i}", "ann", "", f"2026-01-{1 + i // 2:02d}T00:00:00", f"s{i}", "") for i in range(8)]
    heads = spark.createDataFrame(heads, "commit_id int, hash string, author string, author_email string, date string, subject string, body string")
    touched = [(i, f"f{j:02d}") for i in range(8) for j in range(14 if i == 7 else 3)]
    files = spark.createDataFrame(touched, "commit_id int, file string")
    found = {r.file: r for r in history.file_histories(heads, files, 3, "f0*", "f02").collect()}
    assert sorted(found) == [f"f{j:02d}" for j in range(10) if j != 2] and found["f00"].commits == 3
    assert re.findall(r"(?m)^## \S+ (\w+)", found["f00"].content) == ["s6", "s7", "s4"]
    shown = "Also changed: " + ", ".join(f"f{j:02d}" for j in range(11) if j != 5) + "\n  (+3 more files)"
    assert shown in found["f05"].content


def test_chunking_takes_no_value_from_a_transformed_array(spark):
    """Its type would be worked out for every row, through all that is nested in it."""
    docs = spark.createDataFrame([("a.md", "x")], "file_path string, body string")
    assert "transform(array(" not in ingest.chunk_documents(docs, 600)._jdf.queryExecution().optimizedPlan().toString()
