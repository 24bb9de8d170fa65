"""The engine end to end over a small tree of files."""

import pytest
from pyspark.sql import functions as F

from scriptorium.config import EngineConfig
from scriptorium.engine import Engine

GUIDE = """---
title: Ignored
category: guides
tags: [alpha, "beta"]
relates_to: ops/deploy.md, other/*.md
relations:
  - { path: "ops/billing.json", type: "prerequisite" }
  - path: notes.txt
    type: tested_by
  - path: x.md
    type: unknown_kind
---
# Setup guide

Preamble that is kept.

## Installing payments

Install the payment gateway before you deploy. See [deploy](ops/deploy.md).

## Running

Run the services and watch the running logs. Also [[notes]].
"""
DEPLOY = "# Deploy\n\n## Docker\n\nDeploy containers with docker compose and check health.\n"


@pytest.fixture(scope="module")
def tree(tmp_path_factory):
    root = tmp_path_factory.mktemp("tree")
    (root / "ops").mkdir()
    (root / "guide.md").write_text(GUIDE)
    (root / "ops" / "deploy.md").write_text(DEPLOY)
    (root / "ops" / "billing.json").write_text('{"billing": {"plan": "enterprise"}, "note": "invoices are sent monthly"}')
    (root / "notes.txt").write_text("Plain notes about the payments team and its weekly meetings.")
    (root / "tiny.md").write_text("too small")
    (root / "image.txt").write_bytes(b"\x89PNG\x00" + b"x" * 100)
    return root


@pytest.fixture(scope="module")
def engine(spark, tmp_path_factory, tree):
    engine = Engine(spark, str(tmp_path_factory.mktemp("store")), EngineConfig(writable=True, store_buckets=4))
    report = {r.path: (r.action, r.detail) for r in engine.ingest_path(str(tree)).collect()}
    assert report["tiny.md"] == ("skipped", "short")
    assert report["image.txt"] == ("skipped", "binary")
    assert report["guide.md"][0] == "ingested"
    return engine


def paths(df):
    return [r.file_path for r in df.collect()]


def test_ingest_is_incremental(engine, tree):
    again = {r.path: (r.action, r.chunks) for r in engine.ingest_path(str(tree)).collect()}
    assert again["guide.md"] == ("unchanged", 3)
    assert {a for a, _ in again.values()} == {"unchanged", "skipped"}


def test_metadata_and_sections(engine):
    rows = engine.store.document_chunks("guide.md").orderBy("chunk_index").collect()
    assert [r.title for r in rows] == ["Setup guide", "Installing payments", "Running"]
    assert rows[0].content == "# Setup guide\n\nPreamble that is kept."
    assert rows[0].category == "guides" and rows[0].tags == ["alpha", "beta"]
    assert rows[0].audience == "all" and len(rows[0].content_hash) == 16
    assert engine.store.document_chunks("ops/billing.json").first().category == "ops"


def test_links_from_all_writers(engine):
    links = {(r.target_path, r.relation_type) for r in engine.store.links().filter("source_path = 'guide.md'").collect()}
    assert links == {
        ("ops/deploy.md", "relates_to"),
        ("ops/billing.json", "prerequisite"),
        ("notes.txt", "tested_by"),
        ("ops/deploy.md", "content_link"),
        ("notes", "content_link"),
    }


def test_search_stems_and_prefers_titles(engine):
    hits = engine.search_docs("payment").collect()
    assert hits[0].file_path == "guide.md" and "notes.txt" in {h.file_path for h in hits}
    assert "<mark>" in hits[0].highlight
    assert paths(engine.search_docs("deploys", category="ops")) == ["ops/deploy.md"]
    assert engine.search_docs("zebra").count() == 0
    with pytest.raises(ValueError):
        engine.search_docs("   ")


def test_search_falls_back_to_paths(engine):
    assert set(paths(engine.search_docs("s/dep"))) == {"ops/deploy.md"}


def test_get_doc_and_log(engine):
    doc = engine.get_doc("guide.md", max_length=30).first()
    assert doc.truncated and len(doc.content) == 33 and doc.title == "Setup guide"
    assert engine.get_doc("nope.md").count() == 0
    assert engine.store.access_log().filter("tool = 'get_doc'").count() == 1
    saved = engine.savings()["by_tool"].filter("tool = 'get_doc'").first()
    assert saved.calls == 1 and saved.tokens_saved > 0
    assert "guide.md" in {r.file_path for r in engine.get_context().collect()}
    assert engine.get_context("payments").filter("access_count > 0").count() >= 1


def test_graph(engine):
    one = {(r.related_path, r.direction) for r in engine.get_related("ops/deploy.md").collect()}
    assert one == {("guide.md", "incoming")}
    two = engine.get_related("ops/deploy.md", depth=2, include_titles=True).orderBy("position").collect()
    assert two[0].related_path == "guide.md" and two[0].hops == 1
    assert {r.related_path for r in two if r.hops == 2} == {"notes", "notes.txt", "ops/billing.json"}
    stats = engine.get_graph_stats()
    assert stats["totals"].first().total_edges == 5
    assert stats["orphans"].count() == 0


def test_write_read_delete(engine):
    assert engine.upsert_doc("new/doc.md", "# New\n\nzebra stripes " + "word " * 10, category="new") == 1
    assert paths(engine.search_docs("zebra")) == ["new/doc.md"]
    assert engine.update_metadata("new/doc.md", category="moved", title="Renamed") == 1
    assert engine.search_docs("renamed", category="moved").count() == 1
    engine.store.insert_links(
        engine.spark.createDataFrame([("notes.txt", "new/doc.md", "related")], "source_path string, target_path string, relation_type string")
    )
    assert engine.delete_doc("new/doc.md") == {"chunks_deleted": 1, "links_deleted": 1}
    assert engine.search_docs("zebra").count() == 0
    assert engine.store.index().terms.filter("term = 'zebra'").count() == 0
    assert engine.delete_doc("new/doc.md")["chunks_deleted"] == 0


def test_write_gate(spark, tmp_path):
    closed = Engine(spark, str(tmp_path), EngineConfig(store_buckets=2))
    with pytest.raises(PermissionError):
        closed.upsert_doc("a.md", "text")


def test_embedding_backfill_and_hybrid(engine):
    def embedder(texts):
        return [[float(t.count("docker")), float(t.count("payment")), 1.0] for t in texts]

    engine.embedder = embedder
    try:
        done = engine.embed_pending()
        assert done["embedded"] == done["total_null"] > 0 and done["errors"] == 0
        assert engine.embed_pending()["total_null"] == 0
        assert engine.search_docs("docker").first().file_path == "ops/deploy.md"
    finally:
        engine.embedder = None


def test_diff_prune_export(engine, tree, tmp_path):
    (tree / "notes.txt").write_text("Plain notes about the payments team and its monthly meetings.")
    (tree / "fresh.md").write_text("# Fresh\n\n" + "fresh content " * 6)
    billing = tree / "ops" / "billing.json"
    moved = billing.read_text()
    billing.unlink()
    status = {r.file_path: r.status for r in engine.diff_path(str(tree)).collect()}
    assert status["notes.txt"] == "modified" and status["fresh.md"] == "new"
    assert status["ops/billing.json"] == "deleted" and status["guide.md"] == "unchanged"
    assert paths(engine.prune(str(tree), dry_run=True)) == ["ops/billing.json"]
    assert paths(engine.prune(str(tree))) == ["ops/billing.json"]
    assert engine.list_docs().filter("file_path = 'ops/billing.json'").count() == 0
    billing.write_text(moved)
    engine.export(str(tmp_path / "json"))
    assert engine.spark.read.json(str(tmp_path / "json")).count() == engine.list_docs().count()
    engine.export(str(tmp_path / "csv"), "csv")
    engine.export(str(tmp_path / "md"), "markdown", category="guides")
    text = engine.spark.read.text(str(tmp_path / "md"), wholetext=True).first().value
    assert text.startswith("---\nfile_path: guide.md\ntitle: Setup guide\n")


def test_history_and_cleanup(engine, tmp_path):
    from scriptorium.sources import gitlog as g

    def commit(n, day, author, subject, files, body=""):
        fields = [n * 40, author, f"{author.lower()}@x.io", f"2026-01-{day}T10:00:00+00:00", subject, body]
        return g.RECORD + "".join(f + g.UNIT for f in fields) + "\n" + "".join(f + g.NAME_END for f in files)

    log = tmp_path / "log.txt"
    log.write_text(
        commit("a", "03", "Alice", "Fix billing", ["src/billing.py", "src/app.py"], "Rounds totals.\n\nTwice.")
        + commit("b", "02", "Bob", "Add app", ["src/app.py"])
        + g.RECORD
        + "broken"
    )
    report = {r.path: r.action for r in engine.ingest_git_log(str(log)).collect()}
    assert report == {"git-history/src/billing.py": "ingested", "git-history/src/app.py": "ingested"}
    again = {r.action for r in engine.ingest_git_log(str(log)).collect()}
    assert again == {"unchanged"}
    text = "\n".join(r.content for r in engine.store.document_chunks("git-history/src/app.py").orderBy("chunk_index").collect())
    assert "## 2026-01-03: Fix billing (aaaaaaa)" in text and "Author: Alice <alice@x.io>" in text
    assert "Also changed: src/billing.py" in text and "Twice." in text
    kinds = {(r.source_path, r.relation_type) for r in engine.store.links().filter("source_path like 'git-history/%'").collect()}
    assert ("git-history/src/app.py", "git_co_change") in kinds and ("git-history/src/app.py", "git_ref") in kinds
    hits = engine.search_git_history("billing", author="alice").collect()
    assert hits and all(h.file_path.startswith("git-history/") for h in hits)
    assert engine.search_git_history("billing", since="2026-01-03", file_path="app.py").count() == 1
    assert engine.search_git_history("app", until="2026-01-01").count() == 0
    n = engine.store.access_log().count()
    assert n and engine.cleanup(days=30, as_of=F.lit("2999-01-01").cast("timestamp")) == n
    assert engine.store.access_log().count() == 0
    assert engine.check_health()["chunks_count"] > 0


def test_crawl(engine):
    html = "<html><body><nav><a href='/x'>x</a></nav><article><h1>Web page</h1><p>{}</p><a href='/b/#top'>next</a></article></body></html>"
    pages = engine.spark.createDataFrame(
        [
            ("https://Docs.Example.org/a/#frag", html.format("Crawled words about gateways. " * 4)),
            ("https://docs.example.org/secret/s", html.format("Hidden text. " * 10)),
            ("http://127.0.0.1/internal", html.format("Internal text. " * 10)),
            ("https://docs.example.org/empty", "<html></html>"),
            ("https://docs.example.org/a", html.format("Crawled words about gateways. " * 4)),
        ],
        "url string, html string",
    )
    rules = [("docs.example.org", "User-agent: *\nDisallow: /secret"), ("docs.example.org", "User-agent: *\nDisallow: /hidden")]
    robots = engine.spark.createDataFrame(rules, "host string, rules string")
    report = {r.path: (r.action, r.detail) for r in engine.crawl(pages, robots=robots).collect()}
    assert len(report) == 4 and report["https://docs.example.org/a"][0] == "crawled"
    keys = engine.store.chunks().filter("file_path LIKE 'https://%'").groupBy("file_path", "chunk_index").count()
    assert keys.filter("count > 1").count() == 0
    assert report["https://docs.example.org/secret/s"] == ("blocked", "robots")
    assert report["http://127.0.0.1/internal"][0] == "blocked"
    assert report["https://docs.example.org/empty"][0] == "skipped"
    assert engine.crawl(pages, robots=robots).filter("action = 'unchanged'").count() == 1
    links = {r.target_path for r in engine.store.links().filter("relation_type = 'links_to'").collect()}
    assert links == {"https://docs.example.org/x", "https://docs.example.org/b"}
    assert engine.store.crawl_cache().count() == 1
    assert engine.store.wipe() > 0 and engine.list_docs().count() == 0


def test_a_store_knows_its_buckets(spark, tmp_path):
    root = str(tmp_path / "s")
    Engine(spark, root, EngineConfig(writable=True, store_buckets=3)).upsert_doc("a.md", "# A\n\nSome words.")
    again = Engine(spark, root, EngineConfig(writable=True))
    assert again.store.buckets == 3 and again.store.document_chunks("a.md").count() == 1
    again.upsert_doc("a.md", "# A\n\nOther words.")
    assert again.store.chunks().count() == 1
    with pytest.raises(ValueError, match="3 buckets"):
        Engine(spark, root, EngineConfig(store_buckets=7))


def test_keys_of_chunks_are_unique(spark, tmp_path):
    store = Engine(spark, str(tmp_path / "u"), EngineConfig(writable=True, store_buckets=2)).store
    rows = [("a.md", 0, "t", "x"), ("a.md", 0, "t", "y")]
    with pytest.raises(ValueError, match="more than one chunk"):
        store.replace_documents(spark.createDataFrame(rows, "file_path string, chunk_index int, title string, content string"))
    assert store.chunks().count() == 0


def test_one_bad_file_leaves_the_others(spark, tmp_path):
    good = "# Good\n\n" + "Words enough to be kept by the size gate of the reader. " * 3
    files = {
        "good.md": good,
        "list.ipynb": "[1, 2, 3]" + " " * 60,
        "deep.json": "[" * 3000 + "]" * 3000,
        "wide.csv": "a,b\n" + "x" * 200_000 + ",1",
        "broken.json": "{" * 80,
    }
    for name, text in files.items():
        (tmp_path / name).write_text(text)
    engine = Engine(spark, str(tmp_path / "store"), EngineConfig(writable=True, store_buckets=2))
    report = {r.path: r.action for r in engine.ingest_path(str(tmp_path)).collect()}
    assert report["good.md"] == report["wide.csv"] == "ingested"
    assert set(report) == set(files)


def docs_of(spark, *names):
    rows = [(n, 0, n, f"words of {n}") for n in names]
    return spark.createDataFrame(rows, "file_path string, chunk_index int, title string, content string")


def test_a_failed_change_leaves_the_old_state(spark, tmp_path, monkeypatch):
    store = Engine(spark, str(tmp_path / "s"), EngineConfig(writable=True, store_buckets=3)).store
    store.replace_documents(docs_of(spark, "a.md", "b.md"))

    def fail(*_):
        raise OSError("lost between two writes")

    with monkeypatch.context() as patched:
        patched.setattr(store, "_reindex", fail)
        with pytest.raises(OSError):
            store.replace_documents(docs_of(spark, "a.md", "c.md"))
    again = Engine(spark, str(tmp_path / "s"), EngineConfig()).store
    for reader in (store, again):
        assert {r.file_path for r in reader.chunks().collect()} == {"a.md", "b.md"}
        assert reader.index().terms.filter("term = 'c'").count() == 0
    store.replace_documents(docs_of(spark, "c.md"))
    assert again.chunks().count() == 3 and again.index().terms.filter("term = 'c'").count() == 1


def test_a_change_of_several_tables_is_one(spark, tmp_path):
    store = Engine(spark, str(tmp_path / "s"), EngineConfig(writable=True, store_buckets=3)).store
    other = Engine(spark, str(tmp_path / "s"), EngineConfig()).store
    links = spark.createDataFrame([("a.md", "b.md", "tests")], "source_path string, target_path string, relation_type string")
    with store.change():
        store.replace_documents(docs_of(spark, "a.md"))
        store.insert_links(links)
        assert other.chunks().count() == other.links().count() == 0 and store.chunks().count() == 1
    assert other.chunks().count() == other.links().count() == 1


def test_a_small_change_writes_few_files_and_a_second_writer_fails(spark, tmp_path, monkeypatch):
    from scriptorium.sources import store as store_module

    root = tmp_path / "s"
    store = Engine(spark, str(root), EngineConfig(writable=True, store_buckets=8)).store
    store.replace_documents(docs_of(spark, *[f"d{i}.md" for i in range(40)]))
    before = {p for p in root.rglob("*.parquet")}
    store.replace_documents(docs_of(spark, "d7.md"))
    fresh = {p.relative_to(root).parts[0] for p in set(root.rglob("*.parquet")) - before}
    assert len(set(root.rglob("*.parquet")) - before) == 3 and fresh == {"chunks", "postings", "terms"}
    monkeypatch.setattr(store_module, "MAX_GENERATIONS", 3)
    for i in range(5):
        store.replace_documents(docs_of(spark, f"d{i}.md"))
    assert len(set(store._state()["chunks"].values())) <= 3 and store.chunks().count() == 40
    assert store.vacuum() > 0 and store.chunks().count() == 40 and store.index().terms.filter("term = 'word'").count() > 0
    rival = Engine(spark, str(root), EngineConfig(writable=True)).store
    with pytest.raises(RuntimeError, match="another writer"):
        with store.change():
            store.replace_documents(docs_of(spark, "mine.md"))
            rival.replace_documents(docs_of(spark, "theirs.md"))
    assert store.chunks().filter("file_path IN ('mine.md', 'theirs.md')").count() == 1


def test_the_newest_row_of_an_address_counts(spark, tmp_path):
    store = Engine(spark, str(tmp_path / "s"), EngineConfig(writable=True, store_buckets=2)).store
    rows = [("https://a", "old", 1.0), ("https://a", "new", 3.0), ("https://a", "mid", 2.0)]
    store.update_crawl_cache(spark.createDataFrame(rows, "url string, hash string, timestamp double"))
    assert [r.hash for r in store.crawl_cache().collect()] == ["new"]
