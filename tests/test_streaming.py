"""Streams driven to completion with availableNow."""

from datetime import datetime

from pyspark.sql import functions as F

from scriptorium import schema as S
from scriptorium.config import EngineConfig
from scriptorium.sources.store import DocStore
from scriptorium.streaming.ingest import crawl_stream, watch
from scriptorium.streaming.usage import log_stream, trailing_savings

BODY = "words that make this file long enough to be ingested. "


def test_watch_ingests_new_and_changed_files(spark, tmp_path):
    root, store = tmp_path / "tree", DocStore(spark, str(tmp_path / "store"), 2)
    root.mkdir()
    store.init_schema()
    (root / "a.md").write_text("# A\n\n" + BODY)
    run = lambda: watch(store, str(root), str(tmp_path / "cp"), EngineConfig(), once=True).awaitTermination()
    run()
    assert [r.file_path for r in store.chunks().collect()] == ["a.md"]
    (root / "b.md").write_text("# B\n\n" + BODY)
    run()
    assert {r.file_path for r in store.chunks().collect()} == {"a.md", "b.md"}
    assert store.index().corpus_size().first().n_chunks == 2


def test_pages_stream(spark, tmp_path):
    store = DocStore(spark, str(tmp_path / "store"), 2)
    store.init_schema()
    rows = [("https://h.org/a", f"<article><p>{BODY}</p><a href='/b'>b</a></article>")]
    spark.createDataFrame(rows, "url string, html string").write.parquet(str(tmp_path / "pages"))
    pages = spark.readStream.schema("url string, html string").parquet(str(tmp_path / "pages"))
    crawl_stream(store, pages, str(tmp_path / "cp"), EngineConfig(), once=True).awaitTermination()
    assert store.chunks().count() == 1 and store.links().first().target_path == "https://h.org/b"


def test_log_stream_and_trailing_windows(spark, tmp_path):
    rows = [("a", None, "search_docs", 10, 100, datetime(2024, 1, d, 12)) for d in (1, 2, 5)]
    rows += [("a", None, "get_doc", 50, 20, datetime(2024, 1, 5, 13)), ("a", None, "get_doc", None, 20, datetime(2024, 1, 20))]
    spark.createDataFrame(rows, S.ACCESS_LOG).write.parquet(str(tmp_path / "in"))
    events = spark.readStream.schema(S.ACCESS_LOG).parquet(str(tmp_path / "in"))
    log_stream(events, str(tmp_path / "log"), str(tmp_path / "cp1"), once=True).awaitTermination()
    stored = spark.read.parquet(str(tmp_path / "log"))
    assert stored.count() == 5 and "day" in stored.columns
    batch = {(r.as_of, r.tool): (r.calls, r.tokens_saved) for r in trailing_savings(stored.drop("day"), 3).collect()}
    assert batch[(datetime(2024, 1, 3), "search_docs")] == (2, 180)
    assert batch[(datetime(2024, 1, 6), "get_doc")] == (1, 0)

    def streamed(mode, **options):
        writer = trailing_savings(events, 3, **options).writeStream.outputMode(mode).format("memory").queryName(f"trailing_{mode}")
        writer.trigger(availableNow=True).start().awaitTermination()
        return {(r.as_of, r.tool): (r.calls, r.tokens_saved) for r in spark.table(f"trailing_{mode}").collect()}

    assert streamed("complete", chained=False) == batch
    # The last event is of a day that is not final; all windows of the others are.
    final = streamed("append")
    assert final and final.items() <= batch.items() and max(final)[0] < datetime(2024, 1, 20)
