"""Command line: ``python -m scriptorium <command>``."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import functions as F

from scriptorium.config import EngineConfig
from scriptorium.engine import Engine
from scriptorium.session import build_session


def _parser() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="scriptorium")
    parser.add_argument("--store", required=True, help="folder of the stored tables")
    parser.add_argument("--buckets", type=int)
    parser.add_argument("--master", default=None, help="Spark master, when not set elsewhere")
    commands = parser.add_subparsers(dest="command", required=True)

    def command(name: str, *flags: tuple) -> None:
        sub = commands.add_parser(name)
        for names, options in flags:
            sub.add_argument(*names, **options)

    def flag(name: str) -> tuple:
        return (name,), {"action": "store_true"}

    def option(name: str, **options) -> tuple:
        return (name,), options

    command("init")
    command("check")
    command("ingest", option("path"), flag("--force"), flag("--dry-run"), flag("--wipe"), flag("--prune"))
    command("watch", option("path"), option("--checkpoint", required=True), flag("--once"))
    command(
        "ingest-git", option("log"), option("--repo"), option("--since"), option("--until"), option("--author"), flag("--merges"),
        option("--include"), option("--exclude"), option("--max-commits", type=int), flag("--force"), flag("--dry-run"),
    )
    command("crawl", option("pages", help="Parquet of url, html"), option("--include"), option("--exclude"), flag("--force"), flag("--dry-run"))
    command("search", option("query"), option("--category"), option("--limit", type=int, default=5))
    command("get", option("path"), option("--max-length", type=int))
    command("related", option("path"), option("--depth", type=int, default=1), option("--type"))
    command("context", option("--topic"), option("--limit", type=int, default=10), option("--category"))
    command("graph", option("--category"))
    command("embed", flag("--dry-run"), option("--provider"), option("--model", default=""), option("--url"), option("--api-key"))
    command("stats")
    command("export", option("target"), option("--format", default="json", choices=["json", "markdown", "csv"]), option("--category"))
    command("diff", option("path"))
    command("prune", option("path"), flag("--dry-run"), flag("--include-crawled"))
    command("cleanup", option("--days", type=int, default=90))
    command("fix-link-types")
    command("eval", option("cases", help="JSON lines of query and expected_paths"), option("--k", type=int, default=5))
    command("savings", option("--days", type=int, default=30))
    return parser


def _show(frame) -> None:
    """Print a bounded result as JSON lines."""
    for line in frame.toJSON().toLocalIterator():
        sys.stdout.write(line + "\n")


def _print(value) -> None:
    sys.stdout.write(json.dumps(value, default=str) + "\n")


def evaluate(engine: Engine, cases_path: str, k: int):
    """Hit rate, MRR and precision over a file of (query, expected_paths)."""
    from scriptorium.operators.evaluation import path_relevance

    cases = engine.spark.read.schema("query string, expected_paths array<string>, category string").json(cases_path)
    cases = cases.withColumn("query_id", F.xxhash64("query", F.coalesce("category", F.lit(""))))
    hits = engine.search_batch(cases.select("query_id", "query", "category"), k)
    scored = path_relevance(hits, cases, k)
    return scored.agg(
        F.count(F.lit(1)).alias("queries"),
        F.avg("hit").alias("hit_rate"),
        F.avg("reciprocal_rank").alias("mrr"),
        F.avg("precision").alias("mean_precision"),
    )


def run(argv: list[str] | None = None, spark=None) -> None:
    args = _parser().parse_args(argv)
    if spark is None:
        spark = build_session(**({"spark.master": args.master} if args.master else {}))
    engine = Engine(spark, args.store, EngineConfig(writable=True, store_buckets=args.buckets))
    name = args.command
    if name == "init":
        _print("ready")
    elif name == "check":
        _print(engine.check_health())
    elif name == "ingest":
        if args.wipe:
            engine.store.wipe()
        _show(engine.ingest_path(args.path, args.force, args.dry_run))
        if args.prune:
            _show(engine.prune(args.path, args.dry_run))
    elif name == "watch":
        from scriptorium.streaming.ingest import watch

        watch(engine.store, args.path, args.checkpoint, engine.config, args.once).awaitTermination()
    elif name == "ingest-git":
        if args.repo:
            from scriptorium.sources.gitlog import write_log

            write_log(spark, args.repo, args.log, args.merges, since=args.since, until=args.until, author=args.author)
        _show(
            engine.ingest_git_log(
                args.log, include=args.include, exclude=args.exclude, max_commits=args.max_commits, force=args.force, dry_run=args.dry_run
            )
        )
    elif name == "crawl":
        pages = spark.read.parquet(args.pages)
        _show(engine.crawl(pages, include=args.include, exclude=args.exclude, force=args.force, dry_run=args.dry_run))
    elif name == "search":
        _show(engine.search_docs(args.query, args.category, args.limit))
    elif name == "get":
        _show(engine.get_doc(args.path, args.max_length))
    elif name == "related":
        _show(engine.get_related(args.path, args.depth, args.type, include_titles=True))
    elif name == "context":
        _show(engine.get_context(args.topic, args.limit, args.category))
    elif name == "graph":
        for part in engine.get_graph_stats(args.category).values():
            _show(part)
    elif name == "embed":
        if args.provider:
            from scriptorium.plans.embed import http_embedder, onnx_embedder

            local = args.provider == "local"
            engine.embedder = onnx_embedder(args.model) if local else http_embedder(args.provider, args.model, args.api_key, args.url)
        _print(engine.embed_pending(args.dry_run))
    elif name == "stats":
        for part in engine.stats().values():
            _show(part)
    elif name == "export":
        engine.export(args.target, args.format, args.category)
    elif name == "diff":
        _show(engine.diff_path(args.path))
    elif name == "prune":
        _show(engine.prune(args.path, args.dry_run, args.include_crawled))
    elif name == "cleanup":
        _print({"purged": engine.cleanup(args.days)})
    elif name == "fix-link-types":
        _print({"relabeled": engine.fix_link_types()})
    elif name == "eval":
        _show(evaluate(engine, args.cases, args.k))
    elif name == "savings":
        for part in engine.savings(args.days).values():
            _show(part)


