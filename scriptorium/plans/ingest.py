"""From files, commit logs and pages to stored chunks, links and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scriptorium.config import EngineConfig
from scriptorium.functions import convert, markdown, web
from scriptorium.functions.text import content_hash, file_stem, file_suffix, first_h1, matches_globs, parse_tags
from scriptorium.operators import changes, graph, history
from scriptorium.operators.ranking import top_k
from scriptorium.schema import TYPED_RELATIONS
from scriptorium.session import written
from scriptorium.sources.store import DocStore

WHITESPACE = " \t\n\r\f\v"
FILE_LINKS = ["relates_to", "content_link", *TYPED_RELATIONS]


def _visible(text: Column) -> Column:
    return F.length(F.btrim(F.coalesce(text, F.lit("")), F.lit(WHITESPACE)))


# -- files --------------------------------------------------------------------


def read_files(files: DataFrame) -> DataFrame:
    """(file_path, content, text, content_hash, detail): decoded and gated.

    ``detail`` says why a file is skipped before conversion.
    """
    sniffed = files.select("file_path", "content", convert.looks_binary(F.col("content")).alias("binary"))
    plain = F.when(~F.col("binary"), F.col("content"))
    decoded = sniffed.withColumn("text", convert.decode(F.coalesce(plain, F.lit(bytearray()))))
    detail = F.when(F.col("binary"), "binary").when(_visible(F.col("text")) < convert.MIN_CHARS, "short")
    return decoded.select("file_path", "content", "text", content_hash(F.col("text")).alias("content_hash"), detail.alias("detail"))


def convert_files(files: DataFrame) -> DataFrame:
    """Add ``markdown`` to the rows marked ``fresh``, and ``detail`` where
    nothing useful came out.  Other rows reach the converters as NULL."""
    converted = convert.to_markdown(F.when(F.col("fresh"), F.col("text")), F.col("file_path"))
    small = F.col("fresh") & (_visible(F.col("markdown")) < convert.MIN_CHARS)
    return files.withColumn("markdown", converted).withColumn("detail", F.coalesce("detail", F.when(small, "no text in it")))


def document_metadata(docs: DataFrame) -> DataFrame:
    """Title, category, audience, tags of (file_path, markdown) rows."""
    text = F.col("markdown")
    body = markdown.body(text)
    parts = F.split("file_path", "/")
    folder = F.when(F.size(parts) > 1, F.element_at(parts, -2)).otherwise("general")

    def front(key: str) -> Column:
        value = markdown.front_value(text, key)
        return F.when(value != "", value)

    return docs.withColumns(
        {
            "body": body,
            "doc_title": F.coalesce(first_h1(body), front("title"), file_stem(F.col("file_path"))),
            "category": F.coalesce(front("category"), folder),
            "audience": F.coalesce(markdown.front_value(text, "audience"), F.lit("all")),
            "tags": F.when(front("tags").isNotNull(), parse_tags(front("tags"))),
        }
    )


def chunk_documents(docs: DataFrame, max_size: int, config: EngineConfig | None = None) -> DataFrame:
    """One row per chunk; each chunk carries its own section's title."""
    config = config or EngineConfig()
    sections = markdown.heading_chunks(F.col("body"), F.col("file_path"), max_size, config.keep_preamble, config.min_section)
    carried = [c for c in ("category", "audience", "tags", "content_hash") if c in docs.columns]
    exploded = docs.select(
        "file_path",
        *carried,
        F.posexplode(sections).alias("chunk_index", "chunk"),
    )
    return exploded.select("file_path", "chunk_index", "chunk.title", "chunk.content", "chunk.section_path", *carried)


def _report(rows: DataFrame, action: str, chunks: Column | None = None, detail: Column | None = None) -> DataFrame:
    return rows.select(
        F.col("file_path").alias("path"),
        (F.lit(0) if chunks is None else chunks).cast("long").alias("chunks"),
        F.lit(action).alias("action"),
        F.coalesce(F.lit("") if detail is None else detail, F.lit("")).alias("detail"),
    )


def chunk_counts(chunks: DataFrame) -> DataFrame:
    return chunks.groupBy("file_path").agg(F.count(F.lit(1)).alias("n"))


def ingest_files(
    store: DocStore, files: DataFrame, config: EngineConfig, force: bool = False, dry_run: bool = False
) -> DataFrame:
    """Ingest changed files and report on every file.

    The stored hash is compared before conversion and chunking, so unchanged
    files cost one read.
    """
    near = store.chunks_near(files)
    stored = changes.stored_hashes(near).select("file_path", F.col("content_hash").alias("stored_hash"))
    same = F.col("content_hash").eqNullSafe(F.col("stored_hash")) & ~F.lit(force or dry_run)
    known = read_files(files).join(stored, "file_path", "left").withColumns(
        {"same": F.col("detail").isNull() & same, "fresh": F.col("detail").isNull() & ~same}
    )
    # Files are read once; everything below starts from this table.
    seen = written(convert_files(known).select("file_path", "content_hash", "markdown", "detail", "same"), "files")
    skipped = _report(seen.filter(F.col("detail").isNotNull()), "skipped", detail=F.col("detail"))
    unchanged = seen.filter("same").select("file_path").join(chunk_counts(near), "file_path", "left")
    docs = seen.filter("detail IS NULL AND NOT same")
    chunks = written(chunk_documents(document_metadata(docs), config.chunk_size, config), "chunks")
    done = _report(chunk_counts(chunks), "dry-run" if dry_run else "ingested", F.col("n"))
    # The report is fixed before the store changes under its plans.
    report = written(
        skipped.unionByName(_report(unchanged, "unchanged", F.coalesce("n", F.lit(0)))).unionByName(done), "report"
    )
    if not dry_run:
        texts = docs.select("file_path", F.col("markdown").alias("text"))
        with store.change():
            store.replace_documents(chunks.drop("section_path"))
            store.replace_links_of(texts, markdown.document_links(texts), FILE_LINKS)
    return report


def diff_files(store: DocStore, files: DataFrame) -> DataFrame:
    read = read_files(files).select("file_path", "content_hash")
    return changes.diff_documents(changes.stored_hashes(store.chunks()), read)


def prune(store: DocStore, files: DataFrame, dry_run: bool = False, include_crawled: bool = False) -> DataFrame:
    """Delete documents whose file is gone; returns their paths."""
    stale = written(changes.stale_paths(store.chunks(), files.select("file_path"), include_crawled), "stale")
    if not dry_run:
        store.delete_documents(stale)
    return stale


# -- commit logs --------------------------------------------------------------


def ingest_history(
    store: DocStore,
    heads: DataFrame,
    commit_files: DataFrame,
    config: EngineConfig,
    include: str | None = None,
    exclude: str | None = None,
    max_commits: int | None = None,
    force: bool = False,
    dry_run: bool = False,
) -> DataFrame:
    """One history document per file, with its links; reports per document."""
    rendered = written(history.file_histories(heads, commit_files, max_commits, include, exclude), "rendered")
    hashed = rendered.withColumn("content_hash", content_hash(F.col("content")))
    near = store.chunks_near(rendered)
    stored = changes.stored_hashes(near).select("file_path", F.col("content_hash").alias("stored_hash"))
    same = F.col("content_hash").eqNullSafe(F.col("stored_hash")) & ~F.lit(force or dry_run)
    docs = written(hashed.join(stored, "file_path", "left").withColumn("same", same), "histories")
    fresh = docs.filter(~F.col("same"))
    bodies = fresh.select(
        "file_path",
        F.col("content").alias("body"),
        F.lit("git-history").alias("category"),
        F.lit("developer").alias("audience"),
        "content_hash",
    )
    chunks = written(chunk_documents(bodies, config.chunk_size, config), "chunks")
    counted = fresh.join(chunk_counts(chunks), "file_path", "left")
    kept = docs.filter("same").join(chunk_counts(near), "file_path", "left")
    report = written(
        _report(counted, "dry-run" if dry_run else "ingested", F.coalesce("n", F.lit(0))).unionByName(
            _report(kept, "unchanged", F.coalesce("n", F.lit(0)))
        ),
        "report",
    )
    if not dry_run:
        in_scope = commit_files.filter(matches_globs(F.col("file"), include, exclude))
        pairs = graph.co_change_links(in_scope)
        ingested = fresh.select("file_path")
        both = pairs.join(ingested.withColumnRenamed("file_path", "source_path"), "source_path", "left_semi").join(
            ingested.withColumnRenamed("file_path", "target_path"), "target_path", "left_semi"
        )
        with store.change():
            store.replace_documents(chunks.drop("section_path"))
            store.insert_links(history.history_refs(fresh))
            store.insert_links(both)
    return report


# -- pages --------------------------------------------------------------------


def crawl_pages(
    store: DocStore,
    pages: DataFrame,
    config: EngineConfig,
    robots: DataFrame | None = None,
    agent: str = "scriptorium",
    include: str | None = None,
    exclude: str | None = None,
    force: bool = False,
    allow_private: bool = False,
    dry_run: bool = False,
    page_links: int | None = None,
) -> DataFrame:
    """Ingest fetched pages: (url, html) with optional etag, last_modified,
    is_plain_text, and ``robots`` as (host, rules).  All links of a page are kept unless
    ``page_links`` bounds them.

    Returns (path, chunks, action, detail), one row per page.
    """
    url = F.col("url")
    extras = [c for c in ("etag", "last_modified", "is_plain_text") if c in pages.columns]
    normal = pages.select(web.normalize_url(url).alias("url"), url.alias("given"), "html", *extras).withColumn("host", web.url_host(url))
    # Spellings of one address are one page: the first by its spelling.
    normal = top_k(normal, ["url"], [F.col("given"), F.xxhash64("html")], 1, "spelling").drop("spelling", "given")
    if include:
        normal = normal.filter(web.matches_path(url, include))
    if exclude:
        normal = normal.filter(~web.matches_path(url, exclude))
    if dry_run:
        return _report(normal.withColumnRenamed("url", "file_path"), "dry-run")
    if robots is not None:
        # A page stays one row; the texts of its host add up.
        passed = web.robots_verdicts(normal.select("url"), web.robots_rules(robots), agent)
        normal = normal.join(passed.withColumnRenamed("allowed", "passed"), "url", "left")
        allowed = F.coalesce("passed", F.lit(True))
    else:
        allowed = F.lit(True)
    private = F.lit(False) if allow_private else web.private_host(F.col("host"))
    judged = normal.withColumns({"allowed": allowed, "private": private})
    plain = F.coalesce(F.col("is_plain_text"), F.lit(False)) if "is_plain_text" in extras else F.lit(False)
    open_ = F.col("allowed") & ~F.col("private")
    rich = web.page_markdown(F.when(open_ & ~plain, F.col("html")))
    text = F.coalesce(F.when(open_ & plain, F.btrim("html", F.lit(WHITESPACE))), rich)
    stored = changes.stored_hashes(store.chunks_near(normal, "url")).select(
        F.col("file_path").alias("url"), F.col("content_hash").alias("stored_hash")
    )
    hashed = judged.withColumn("body", F.when(text != "", text)).withColumn("content_hash", content_hash(F.col("body")))
    same = F.col("content_hash").eqNullSafe(F.col("stored_hash")) & ~F.lit(force)
    state = (
        F.when(~open_, "blocked").when(F.col("body").isNull(), "skipped").when(same, "unchanged").otherwise("crawled")
    )
    detail = (
        F.when(F.col("private"), "private host")
        .when(~F.col("allowed"), "robots")
        .when((F.col("state") == "skipped") & (F.length("html") > web.MAX_PAGE), "too large to parse")
        .when(F.col("state") == "skipped", "no text in it")
        .when(F.col("state") == "unchanged", "same hash")
    )
    # Pages are parsed once; everything below starts from this table.
    seen = written(
        hashed.join(stored, "url", "left").withColumn("state", state).withColumn("detail", detail).withColumnRenamed("url", "file_path"),
        "pages",
    )
    fresh = seen.filter("state = 'crawled'")
    docs = fresh.select("file_path", "body", F.col("host").alias("category"), F.lit("all").alias("audience"), "content_hash")
    chunks = written(chunk_documents(docs, config.chunk_size, config), "chunks")
    report = written(
        seen.join(chunk_counts(chunks), "file_path", "left").select(
            F.col("file_path").alias("path"),
            F.coalesce("n", F.lit(0)).cast("long").alias("chunks"),
            F.col("state").alias("action"),
            F.coalesce("detail", F.lit("")).alias("detail"),
        ),
        "report",
    )
    links = web.page_links(fresh.select(F.col("file_path").alias("url"), "html"), limit=page_links)
    edges = links.select(
        F.col("url").alias("source_path"), F.col("link").alias("target_path"), F.lit("links_to").alias("relation_type")
    )
    cached = seen.filter("state IN ('crawled', 'unchanged')").select(
        F.col("file_path").alias("url"),
        *[c for c in extras if c != "is_plain_text"],
        F.col("content_hash").alias("hash"),
        F.unix_timestamp().cast("double").alias("timestamp"),
    )
    with store.change():
        store.replace_documents(chunks.drop("section_path"))
        store.replace_links_of(fresh, edges, ["links_to"])
        store.update_crawl_cache(cached)
    return report


def conditional_headers(urls: DataFrame, cache: DataFrame, force: bool = False) -> DataFrame:
    """The urls to fetch with the validators a conditional request sends."""
    if force:
        return urls.withColumns({"if_none_match": F.lit(None).cast("string"), "if_modified_since": F.lit(None).cast("string")})
    known = cache.select("url", F.col("etag").alias("if_none_match"), F.col("last_modified").alias("if_modified_since"))
    return urls.join(known, "url", "left")


def discover_from_sitemaps(sitemaps: DataFrame, base_host: str) -> DataFrame:
    """Page urls of one host from (url, xml) sitemaps.

    When every location of a sitemap is itself a sitemap, the pages of those
    that were fetched take its place.
    """
    parsed = sitemaps.select("url", web.sitemap_urls(F.col("xml")).alias("locations"))
    marked = parsed.withColumn("is_index", web.is_sitemap_index(F.col("locations")))
    nested = marked.filter("is_index").select(F.explode("locations").alias("url")).distinct()
    tops = marked.filter("NOT is_index").join(
        marked.filter("is_index").select(F.explode("locations").alias("url")), "url", "left_anti"
    )
    below = marked.filter("NOT is_index").join(nested, "url", "left_semi")
    found = tops.unionByName(below).select(F.explode("locations").alias("location"))
    return (
        found.filter(web.url_host(F.col("location")) == base_host.lower())
        .select(web.normalize_url(F.col("location")).alias("url"))
        .distinct()
    )


def discover_by_links(
    pages: DataFrame,
    base_url: str | DataFrame,
    depth: int = 1,
    max_urls: int | None = None,
    robots: DataFrame | None = None,
    agent: str = "scriptorium",
) -> DataFrame:
    """(url, depth) reachable from ``base_url``, or from a frame of them, over the links of
    fetched pages.

    ``robots`` (host, rules) keeps forbidden addresses out of every level, so nothing behind
    them is found through them; the base address is given and stays.  The walk ends at
    ``depth`` or where a level brings nothing new; ``max_urls`` cuts the result if given.
    """
    spark = pages.sparkSession
    edges = web.page_links(pages.withColumn("url", web.normalize_url(F.col("url")))).select("url", "link")
    if robots is not None:
        passed = web.robots_verdicts(edges.select(F.col("link").alias("url")).distinct(), web.robots_rules(robots), agent)
        edges = edges.join(passed.filter("NOT allowed").select(F.col("url").alias("link")), "link", "left_anti").select("url", "link")
    edges = written(edges, "edges")
    bases = spark.createDataFrame([(base_url,)], "url string") if isinstance(base_url, str) else base_url
    frontier = written(bases.select(web.normalize_url(F.col("url")).alias("url")).distinct(), "level")
    found = frontier.withColumn("depth", F.lit(0))
    for level in range(1, depth + 1):
        step = frontier.join(edges, "url").select(F.col("link").alias("url")).distinct()
        frontier = written(step.join(found.select("url"), "url", "left_anti"), "level")
        if frontier.isEmpty():
            break
        found = found.unionByName(frontier.withColumn("depth", F.lit(level)))
    ordered = found.orderBy("depth", "url")
    return ordered if max_urls is None else ordered.limit(max_urls)
