"""The command line over a small store."""

import json

from scriptorium.cli import run


def call(spark, capsys, store, *argv):
    run(["--store", store, "--buckets", "2", *argv], spark=spark)
    return [json.loads(line) for line in capsys.readouterr().out.splitlines()]


def test_commands(spark, tmp_path, capsys):
    tree, store = tmp_path / "tree", str(tmp_path / "store")
    tree.mkdir()
    (tree / "a.md").write_text("# Alpha\n\n## Payments\n\nPayment gateways and how they are billed.\n")
    (tree / "b.md").write_text("# Beta\n\n## Docker\n\nContainers, see [alpha](a.md) for payments.\n")
    assert call(spark, capsys, store, "init") == ["ready"]
    assert {r["action"] for r in call(spark, capsys, store, "ingest", str(tree))} == {"ingested"}
    hits = call(spark, capsys, store, "search", "payments", "--limit", "1")
    assert [h["file_path"] for h in hits] == ["a.md"]
    assert call(spark, capsys, store, "get", "b.md")[0]["title"] == "Docker"
    assert call(spark, capsys, store, "related", "a.md")[0]["related_path"] == "b.md"
    assert call(spark, capsys, store, "stats")[0]["docs"] == 2
    assert call(spark, capsys, store, "check")[0]["links_count"] == 1
    assert {r["status"] for r in call(spark, capsys, store, "diff", str(tree))} == {"unchanged"}
    cases = tmp_path / "cases.jsonl"
    cases.write_text('{"query": "payments", "expected_paths": ["A.md"]}\n{"query": "zebra", "expected_paths": ["b.md"]}\n')
    summary = call(spark, capsys, store, "eval", str(cases))[0]
    assert summary["queries"] == 2 and summary["hit_rate"] == 0.5 and summary["mrr"] == 0.5
    assert call(spark, capsys, store, "savings")[0]["calls"] == 2
    assert call(spark, capsys, store, "embed", "--dry-run")[0]["total_null"] == 2
    call(spark, capsys, store, "export", str(tmp_path / "out"), "--format", "csv")
    assert call(spark, capsys, store, "cleanup")[0]["purged"] == 0
    assert call(spark, capsys, store, "fix-link-types")[0]["relabeled"] == 0
