"""Pure functions and column expressions on small inputs."""

import json
import random
import re

import plain_chunker
import pytest
from pyspark.sql import functions as F

from scriptorium.config import EngineConfig
from scriptorium.functions import convert, markdown, text, web
from scriptorium.functions.stem import stem_word


@pytest.mark.parametrize(
    "word, stem",
    [
        # examples of the published algorithm
        ("caresses", "caress"), ("ponies", "poni"), ("ties", "ti"), ("cats", "cat"), ("feed", "feed"), ("agreed", "agre"),
        ("plastered", "plaster"), ("bled", "bled"), ("motoring", "motor"), ("sing", "sing"), ("conflated", "conflat"),
        ("troubled", "troubl"), ("sized", "size"), ("hopping", "hop"), ("falling", "fall"), ("hissing", "hiss"), ("failing", "fail"),
        ("filing", "file"), ("happy", "happi"), ("sky", "sky"), ("relational", "relat"), ("conditional", "condit"),
        ("vietnamization", "vietnam"), ("triplicate", "triplic"), ("hopefulness", "hope"), ("electrical", "electr"),
        ("revival", "reviv"), ("adoption", "adopt"), ("effective", "effect"), ("probate", "probat"), ("rate", "rate"),
        ("controll", "control"), ("roll", "roll"), ("as", "as"),
    ],
)
def test_stems(word, stem):
    assert stem_word(word) == stem


def one(spark, expr, **values):
    row = spark.createDataFrame([tuple(values.values())], list(values))
    return row.select(expr.alias("x")).first()["x"]


def test_text_expressions(spark):
    assert one(spark, text.PLAIN.words(F.col("a")), a="Éà Über_x a.b@c-7") == ["ea", "uber", "x", "a", "b", "c", "7"]
    assert one(spark, text.query_words(F.col("a")), a='  a-b "x" (y:z)* -- ') == ["ab", "x", "yz"]
    assert one(spark, text.query_words(F.col("a")), a=" *** ") == []
    assert one(spark, text.token_estimate(F.col("a")), a="") == 0
    assert one(spark, text.token_estimate(F.col("a")), a="abc") == 1
    assert one(spark, text.token_estimate(F.col("a")), a="a" * 9) == 2
    assert one(spark, text.preview(F.col("a"), 3), a="abcd") == "abc..."
    assert one(spark, text.preview(F.col("a"), 4), a="abcd") == "abcd"
    assert one(spark, text.parse_tags(F.col("a")), a=" [a, 'b' , ,\"c\"] ") == ["a", "b", "c"]
    assert one(spark, text.first_h1(F.col("a")), a="x\n# One \n# Two") == "One"
    assert one(spark, text.file_stem(F.col("a")), a="d/x.tar.md") == "x.tar"
    assert one(spark, text.contextual_header(F.col("a"), F.col("b")), a="p", b="t") == "Document: p | Section: t\n\n"


def test_globs(spark):
    def match(path, include=None, exclude=None):
        return one(spark, text.matches_globs(F.col("a"), include, exclude), a=path)

    assert match("src/a/b.py", "src/*") and match("a.md", "*.py, *.md")
    assert not match("a.md", "*.py") and not match("src/x.py", "src/*", "*x.py")
    assert match("a1", "a[0-9]") and not match("a1", "a[!0-9]") and match("anything")


def test_front_and_links(spark):
    doc = "---\ntitle: 'A'\ntitle: B\nx : 1\n---\n\nbody [l](a.md) [[w]] [h](https://x/y.md) [[a.md]] [g](*.md)"
    assert one(spark, markdown.front_value(F.col("a"), "title"), a=doc) == "B"
    assert one(spark, markdown.front_value(F.col("a"), "x"), a=doc) == "1"
    assert one(spark, markdown.front_value(F.col("a"), "none"), a=doc) is None
    assert one(spark, markdown.body(F.col("a")), a=doc).startswith("body")
    assert one(spark, markdown.body(F.col("a")), a="--- open") == "--- open"
    assert one(spark, markdown.content_links(F.col("a")), a=doc) == ["a.md", "w"]
    def related(doc):
        return one(spark, markdown.related_paths(F.col("a")), a=doc)

    def typed(doc):
        return [tuple(r) for r in one(spark, markdown.typed_relations(F.col("a")), a=doc)]

    assert related("---\nrelates_to: a.md, 'b.md', c*.md\n---") == ["a.md", "b.md"]
    assert related("---\nrelates_to:\n  - a.md\n\n  - \"b.md\"\nother: x\n  - c.md\n---") == ["a.md", "b.md"]
    assert related("relates_to: a.md") == []
    block = "---\nrelations:\n  - {path: a.md, type: extends}\n  - path: b.md\n    type: tests\n  - type: tests\nend: 1\n  - path: c.md\n---"
    assert typed(block) == [("a.md", "extends"), ("b.md", "tests")]
    assert typed("---\nrelations:\n - {path: 'x*.md', type: tests}\n---") == []


def chunked(spark, docs, size=4000, **kw):
    rows = spark.createDataFrame([(i, d, "d/file.md") for i, d in enumerate(docs)], "i int, a string, p string")
    got = rows.select("i", markdown.heading_chunks(F.col("a"), F.col("p"), size, **kw).alias("c")).orderBy("i").collect()
    return [[c.asDict() for c in r.c] for r in got]


def test_heading_chunks(spark):
    def titles(md, size=4000, **kw):
        return [c["title"] for c in chunked(spark, [md], size, **kw)[0]]

    cut = {"keep_preamble": False, "min_section": 20}
    assert titles("# Title\n\nNo sections here.") == ["Title"]
    assert titles("## Empty\n\n## Real\n\nThis section has real content.", **cut) == ["Real"]
    assert titles("## Empty\n\n## Real\n\nThis section has real content.") == ["Empty", "Real"]
    assert chunked(spark, ["## S\n\nlong enough content"])[0][0]["section_path"] == "file > S"
    big = "# D\n\n## Big\n\nlost\n\n### A\n\n" + "A " * 100 + "\n\n### B\n\n" + "B " * 100
    assert titles(big, 300, **cut) == ["A", "B"]
    assert titles(big, 300) == ["Big", "A", "B"] and chunked(spark, [big], 300)[0][0]["content"] == "## Big\n\nlost"
    deep = "## S\n\n### T\n\n#### X\n\n" + "x " * 100 + "\n\n#### Y\n\n" + "y " * 100
    assert titles(deep, 250) == ["X", "Y"]
    paragraphs = "# D\n\n" + "\n\n".join(f"P{i} " + "x" * 80 for i in range(6))
    assert titles(paragraphs, 200)[:2] == ["D", "D (cont.)"]
    assert titles("intro text long enough\n\n## S\n\nsection body long enough") == ["file", "S"]
    assert titles("") == ["file"] and titles(None) == ["file"]


def pack(spark, texts, size):
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "i int, a string")
    return [r.p for r in rows.select("i", markdown.packed_paragraphs(F.col("a"), size).alias("p")).orderBy("i").collect()]


def test_packing_keeps_fences_and_tables_whole(spark):
    code = "```python\n" + "\n\n".join(f"line {i}" for i in range(30)) + "\n```"
    table = "| a | b |\n| --- | --- |\n" + "\n".join(f"| {i} | {i} |" for i in range(30))
    tall = "| a |\n" * 20_000
    parts, long, rows = pack(spark, [f"before\n\n{code}\n\nmiddle\n\n{table}\n\nafter", "A" * 200, tall], 60)
    # The blank line right after a table still belongs to it.
    assert code in parts and any(p.startswith(table) for p in parts)
    assert long == ["A" * 200] and rows == [tall.strip()]


def random_markdown(draw):
    lines = ["", "", "", "a b", "x" * 30, "| a | b |", "  |c|", "|", "```", "```py", "~~~", "~~~~ x", "# One", "## Two", "### Three", "#### Four", "##no", "text | x |", "\u00a0"]
    return "\n".join(draw.choice(lines) for _ in range(draw.randint(0, 40)))


@pytest.mark.parametrize("size", [5, 40, 90])
def test_chunking_against_the_plain_chunker(spark, size):
    draw = random.Random(size)
    docs = [random_markdown(draw) for _ in range(400)]
    for doc, got in zip(docs, pack(spark, docs, size), strict=True):
        assert got == plain_chunker.pack_paragraphs(doc, size), repr(doc)
    for doc, got in zip(docs, chunked(spark, docs, size, keep_preamble=False, min_section=20), strict=True):
        assert got == plain_chunker.chunk_markdown(doc, "d/file.md", size), repr(doc)


def test_chunking_loses_nothing(spark):
    draw = random.Random(1)
    docs = [random_markdown(draw) for _ in range(300)]
    for doc, got in zip(docs, chunked(spark, docs, 40), strict=True):
        bare = [c for c in "".join(doc.split()) if c != "#"]
        kept = [c for c in "".join("".join(x["content"].split()) for x in got) if c != "#"]
        # Heading lines without text of their own may go; nothing else does.
        heads = len([c for line in doc.split("\n") if re.match("#{1,4} ", line) for c in "".join(line.split()) if c != "#"])
        assert len(bare) - heads <= len(kept) <= len(bare)


def test_converters(spark):
    cells = [{"cell_type": "markdown", "source": ["# H\n", "x"]}, {"cell_type": "code", "source": "x"}, {"cell_type": "raw", "source": " "}]
    book = json.dumps({"cells": cells, "metadata": {"kernelspec": {"language": "python"}}})
    flat = '{"a": {"b": 1}, "c": 2, "d": true, "e": null, "f": "s"}'
    wanted = [
        ("d/my-file_a.txt", "x", "# My File A\n\nx"),
        ("a.md", "x", "x"),
        ("t.csv", "a,b\n1\n1,2,3", "# t\n\n| a | b |\n| --- | --- |\n| 1 |  |\n| 1 | 2 |"),
        ("t.csv", 'a,"b, ""q"""\n1,', '# t\n\n| a | b, "q" |\n| --- | --- |\n| 1 |  |'),
        ("t.csv", "a,b", "a,b"),
        ("t.csv", "a\n" + "x" * 200_000, "# t\n\n| a |\n| --- |\n| " + "x" * 200_000 + " |"),
        ("j.json", flat, '# j.json\n\n## a\n\n```json\n{\n  "b": 1\n}\n```\n\n- **c**: 2\n\n- **d**: True\n\n- **e**: None\n\n- **f**: s'),
        ("j.json", "[1]", "# j.json\n\n```json\n[\n  1\n]\n```"),
        ("j.json", "{bad", "{bad"),
        ("j.json", "[" * 3000 + "]" * 3000, "[" * 3000 + "]" * 3000),
        ("n.ipynb", book, "# H\nx\n\n```python\nx\n```"),
        ("n.ipynb", '{"cells": []}', ""),
        ("n.ipynb", "[1, 2]", "[1, 2]"),
        ("x.json", None, None),
    ]
    rows = spark.createDataFrame([w[:2] for w in wanted], "path string, text string")
    got = rows.select(convert.to_markdown(F.col("text"), F.col("path")).alias("m")).collect()
    for (path, text, want), row in zip(wanted, got, strict=True):
        assert row.m == want, (path, text)


@pytest.mark.parametrize(
    "url, want",
    [
        ("HTTPS://Ex.COM/A/b/#x", "https://ex.com/A/b"),
        ("https://ex.com/", "https://ex.com/"),
        ("https://ex.com", "https://ex.com"),
        ("https://ex.com/a/?q=1#f", "https://ex.com/a?q=1"),
        ("http://ex.com:8080/p//", "http://ex.com:8080/p"),
    ],
)
def test_normalize_url(spark, url, want):
    assert one(spark, web.normalize_url(F.col("a")), a=url) == want
    assert one(spark, web.normalize_url(F.col("a")), a=want) == want


def test_page_links(spark):
    html = """<a href="/a/">A</a><a class='x' href='b#t'>B</a><a href="#top">t</a><a href="javascript:x()">j</a>
      <a href="mailto:x@y">m</a><a href="https://other.org/z">o</a><a href="/a">dup</a><a href="../up/c?q=1">c</a>"""
    pages = spark.createDataFrame([("https://Ex.com/dir/page", html)], "url string, html string")
    links = [r.link for r in web.page_links(pages).orderBy("at").collect()]
    assert links == ["https://ex.com/a", "https://ex.com/dir/b", "https://ex.com/up/c?q=1"]
    assert "https://other.org/z" in {r.link for r in web.page_links(pages, same_host=False).collect()}
    assert web.page_links(pages, limit=2).count() == 2


def test_sitemaps_robots_hosts(spark):
    def locations(xml):
        return one(spark, web.sitemap_urls(F.col("a")), a=xml)

    ns = '<urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9"><url><loc> https://a/1?x=1&amp;y </loc></url><url></url></urlset>'
    assert locations(ns) == ["https://a/1?x=1&y"]
    assert locations("<sitemapindex><sitemap><loc>u.xml</loc></sitemap><!-- <sitemap><loc>no</loc></sitemap> --></sitemapindex>") == ["u.xml"]
    assert locations("<broken") == [] and locations("") == []
    extended = "<sm:urlset><sm:url><image:image><image:loc>https://a/i.png</image:loc></image:image><sm:loc>https://a/p</sm:loc></sm:url></sm:urlset>"
    assert locations(extended) == ["https://a/p"]
    hosts = {
        **dict.fromkeys(["localhost", "10.0.0.1", "x.internal", "127.0.0.1:80", "", "[::1]", "[::1]:80", "user@127.0.0.1"], True),
        **dict.fromkeys(["a:b@192.168.1.9:8080", "172.31.0.1", "[fe80::1]", "[fd00::2]", "[::ffff:10.0.0.1]", "2001:db8::1", "::"], True),
        **dict.fromkeys(["example.org", "8.8.8.8", "172.32.0.1", "[2606:4700::1111]:443", "10.example.org", "300.0.0.1"], False),
    }
    rows = spark.createDataFrame([(h,) for h in hosts], "a string").select("a", web.private_host(F.col("a")).alias("p"))
    assert {r.a: r.p for r in rows.collect()} == hosts


def test_page_markdown():
    html = "<head><title>t</title></head><body><nav>menu</nav><article><h2>Head</h2><p>Some <a href='/x'>linked</a> text that is long enough.</p><ul><li>item</li></ul><table><tr><th>a</th></tr><tr><td>1</td></tr></table><pre>code\n  here</pre></article><footer>foot</footer></body>"
    assert web.html_to_markdown(html).split("\n\n") == [
        "## Head", "Some [linked](/x) text that is long enough.", "- item", "| a |\n| --- |\n| 1 |", "```\ncode\n  here\n```"
    ]
    assert web.html_to_markdown("<p>short</p>") is None


def test_config_ranges():
    for bad in ({"chunk_size": 10}, {"mmr_lambda": 2.0}, {"search_limit_max": 0}, {"content_preview_chars": 10}):
        with pytest.raises(ValueError):
            EngineConfig(**bad)
    config = EngineConfig(collapse_by_doc=True)
    assert config.candidate_limit(3, False) == 15 and config.candidate_limit(20, True) == 100 and config.clamp_limit(99) == 99
    capped = EngineConfig(collapse_by_doc=True, search_limit_max=20)
    assert capped.candidate_limit(20, True) == 20 and capped.clamp_limit(99) == 20


def test_robots_rules_as_rows(spark):
    texts = {
        "a.org": "# head\nUser-agent: *\nDisallow: /x # all\nAllow: /x/open\nDisallow: /*.pdf$\nDisallow:\n\nUser-Agent: Bot/2.1\nUser-agent: other\nDisallow: /bot\n",
        "b.org": "User-agent: bot\nDisallow: /\nAllow: /a+b\r\nAllow: /?q=\n",
        "c.org": "Disallow: /lost\nnonsense",
    }
    rules = web.robots_rules(spark.createDataFrame(list(texts.items()), "host string, rules string"))
    asked = {
        "https://a.org/x": False, "https://a.org/x/open/1": True, "https://a.org/y": True, "https://a.org/f.pdf": False,
        "https://a.org/f.pdf?x": True, "https://a.org/bot": True, "https://b.org/": True, "https://c.org/lost": True,
        "https://none.org/x": True, "https://a.org": True,
    }
    urls = spark.createDataFrame([(u,) for u in asked], "url string")
    assert {r.url: r.allowed for r in web.robots_verdicts(urls, rules, "someone").collect()} == asked
    bot = {r.url: r.allowed for r in web.robots_verdicts(urls, rules, "MyBot").collect()}
    assert bot["https://a.org/x"] and not bot["https://a.org/bot"] and not bot["https://b.org/"]
    more = spark.createDataFrame([("https://b.org/a+b/c",), ("https://b.org/aab",), ("https://b.org/?q=1",)], "url string")
    assert [r.allowed for r in web.robots_verdicts(more, rules, "bot").orderBy("url").collect()] == [True, True, False]


def test_pages_are_converted_one_at_a_time(monkeypatch):
    import pyarrow as pa

    pages = pa.array([f"<html><body><p>{'word ' * 60}{i}</p></body></html>" for i in range(50)] + [None])
    alive = []

    class Text(str):
        def __del__(self):
            alive.remove(id(self))

    def once(html):
        alive.append(id(text := Text(html)))
        assert len(alive) == 1
        return text[:5]

    monkeypatch.setattr(web, "extract_page", once)
    assert web._extract.func(pages).to_pylist() == ["<html"] * 50 + [None]
