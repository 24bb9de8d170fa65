"""URLs, page links, sitemaps, robots rules and page text."""

from __future__ import annotations

import re
from html.parser import HTMLParser
from urllib.parse import urljoin, urlsplit

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import arrow_udf, pandas_udf

from scriptorium.functions.text import glob_regex

# Link pattern, skipped prefixes, size limits.
HREF = r"""(?i)<a\s[^>]*href=["']([^"']+)["']"""
SKIPPED = ("#", "javascript:", "mailto:", "tel:")
MAX_PAGE = 50 * 1024 * 1024
MIN_TEXT = 50
# Beginning of a path by which robots rules and addresses are joined.
PREFIX_CHARS = 3
LOCAL_HOSTS = ("localhost", "localhost.localdomain", "")
LOCAL_SUFFIXES = (".local", ".internal")
# The IPv4 blocks that are not public (IANA special-purpose registry).
PRIVATE_BLOCKS = (
    "0.0.0.0/8",
    "10.0.0.0/8",
    "127.0.0.0/8",
    "169.254.0.0/16",
    "172.16.0.0/12",
    "192.0.0.0/29",
    "192.0.2.0/24",
    "192.168.0.0/16",
    "198.18.0.0/15",
    "198.51.100.0/24",
    "203.0.113.0/24",
    "240.0.0.0/4",
)
# The named entities of XML; the ampersand last, so that nothing is read twice.
XML_ENTITIES = {"&lt;": "<", "&gt;": ">", "&quot;": '"', "&apos;": "'", "&amp;": "&"}

# RFC 3986, appendix B.
_URL = r"^(?:([A-Za-z][A-Za-z0-9+.\-]*):)?(?://([^/?#]*))?([^?#]*)(\?[^#]*)?(#.*)?$"


def _part(url: Column, group: int) -> Column:
    return F.regexp_extract(url, _URL, group)


def url_host(url: Column) -> Column:
    return F.lower(_part(url, 2))


def url_path(url: Column) -> Column:
    return _part(url, 3)


def normalize_url(url: Column) -> Column:
    """Lower-case scheme and host, no fragment, no trailing slash but the root's."""
    path = url_path(url)
    scheme, host, query = F.lower(_part(url, 1)), url_host(url), _part(url, 4)
    return F.concat(
        F.when(scheme != "", F.concat(scheme, F.lit(":"))).otherwise(""),
        F.when(host != "", F.concat(F.lit("//"), host)).otherwise(""),
        F.when(path == "/", path).otherwise(F.regexp_replace(path, "/+$", "")),
        F.when(query == "?", "").otherwise(query),
    )


def page_hrefs(html: Column) -> Column:
    """Raw link targets in page order, without in-page and script links."""
    found = F.transform(F.regexp_extract_all(html, F.lit(HREF), 1), lambda h: F.regexp_replace(h, r"^\s+|\s+$", ""))

    def kept(h: Column) -> Column:
        ok = h != ""
        for prefix in SKIPPED:
            ok = ok & ~h.startswith(prefix)
        return ok

    return F.filter(found, kept)


@pandas_udf(T.StringType())
def _join(base: pd.Series, href: pd.Series) -> pd.Series:
    return pd.Series([_safe_join(b, h) for b, h in zip(base, href)])


def _safe_join(base: str, href: str) -> str | None:
    try:
        return urljoin(base, href)
    except ValueError:
        return None


def absolute_url(base: Column, href: Column) -> Column:
    """Resolve a link; rooted and complete links stay inside the JVM."""
    origin = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*)", 1)
    plain_root = href.rlike(r"^/(?!/)") & ~href.rlike(r"(^|/)\.\.?(/|$|[?#])") & (origin != "")
    return F.when(plain_root, F.concat(origin, href)).otherwise(_join(base, href))


def page_links(pages, same_host: bool = True, limit: int | None = None):
    """(url, link, position) of a (url, html) frame: normalised, each link once."""
    hrefs = pages.select("url", F.posexplode(page_hrefs(F.col("html"))).alias("at", "href"))
    resolved = hrefs.select("url", "at", absolute_url(F.col("url"), F.col("href")).alias("absolute"))
    kept = resolved.filter(F.lower(_part(F.col("absolute"), 1)).isin("http", "https"))
    if same_host:
        kept = kept.filter(url_host(F.col("absolute")) == url_host(F.col("url")))
    links = kept.groupBy("url", normalize_url(F.col("absolute")).alias("link")).agg(F.min("at").alias("at"))
    if limit is None:
        return links
    from scriptorium.operators.ranking import top_k

    return top_k(links, ["url"], [F.col("at")], limit, "position").drop("position")


def matches_path(url: Column, pattern: str) -> Column:
    return url_path(url).rlike(glob_regex(pattern))


# -- hosts and robots -------------------------------------------------------


def _bare_host(authority: Column) -> Column:
    """The host of an authority, without user, port and brackets."""
    host = F.regexp_replace(F.lower(authority), r"^.*@", "")
    inner = F.regexp_extract(host, r"^\[([^\]]*)\]", 1)
    single = F.regexp_replace(host, r":[0-9]*$", "")
    # More than one colon is a bare IPv6 address, which has no port.
    return F.when(inner != "", inner).when(F.length(F.regexp_replace(host, "[^:]", "")) > 1, host).otherwise(single)


def private_host(authority: Column) -> Column:
    """Whether an authority names this machine or a network that is not public.

    Names: LOCAL_HOSTS and LOCAL_SUFFIXES.  IPv4: the blocks of PRIVATE_BLOCKS.
    IPv6: everything outside the allocated 2000::/3 (and multicast), and its
    documentation and protocol blocks; an address that carries an IPv4 address
    counts as that one.
    """
    host = _bare_host(F.coalesce(authority, F.lit("")))
    dotted = F.regexp_extract(host, r"^(?:::ffff:)?(\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3})$", 1)
    octets = F.transform(F.split(dotted, r"\."), lambda o: o.try_cast("long"))
    is_v4 = (dotted != "") & F.forall(octets, lambda o: o <= 255)
    address = F.aggregate(octets, F.lit(0).cast("long"), lambda n, o: n * 256 + o)
    in_block = F.lit(False)
    for block in PRIVATE_BLOCKS:
        base, bits = block.split("/")
        first = sum(int(o) << shift for o, shift in zip(base.split("."), (24, 16, 8, 0), strict=True))
        in_block = in_block | address.between(first, first + (1 << 32 - int(bits)) - 1)
    is_v6 = F.contains(host, F.lit(":"))
    public_v6 = host.rlike("^[23][0-9a-f]{3}:") & ~host.rlike("^2001:(0?db8|0?1[0-9a-f]{2}|0{0,2}[0-9a-f]{1,2})?:") | host.rlike("^ff[0-9a-f]{2}:")
    named = host.isin(*LOCAL_HOSTS)
    for suffix in LOCAL_SUFFIXES:
        named = named | host.endswith(suffix)
    return F.when(dotted != "", is_v4 & in_block).when(is_v6, ~public_v6).otherwise(named)


# A rule's agent, in lower case, without version.
ANY_AGENT = "*"


def robots_rules(robots):
    """(host, agent, pattern, allow) of (host, rules): one row per rule and agent of its group.

    Lines are told apart in the JVM.  A group is a run of agent lines and the rules after it;
    it begins with an agent line that follows a rule.  Comments go, and rules without a path
    say nothing.  Several texts of a host add up.
    """
    from pyspark.sql import Window

    line = F.regexp_replace(F.col("line"), r"\s*#.*$|^\s+|\s+$", "")
    field = F.lower(F.btrim(F.regexp_extract(line, r"^([A-Za-z\-]+)\s*:", 1)))
    value = F.btrim(F.regexp_extract(line, r"^[A-Za-z\-]+\s*:(.*)$", 1))
    texts = robots.select("host", F.xxhash64("rules").alias("text"), F.split("rules", r"\r?\n|\r").alias("lines")).distinct()
    lines = texts.select("host", "text", F.posexplode("lines").alias("at", "line")).select("host", "text", "at", field.alias("field"), value.alias("value"))
    lines = lines.filter(F.col("field").isin("user-agent", "allow", "disallow"))
    order = Window.partitionBy("host", "text").orderBy("at")
    opens = (F.col("field") == "user-agent") & (F.coalesce(F.lag("field").over(order), F.lit("")) != "user-agent")
    grouped = lines.withColumn("opens", opens.cast("int")).withColumn("group", F.sum("opens").over(order))
    agents = grouped.filter("field = 'user-agent'").select("host", "text", "group", F.lower(F.split("value", "/")[0]).alias("agent"))
    rules = grouped.filter("field <> 'user-agent' AND value <> ''").select(
        "host", "text", "group", F.col("value").alias("pattern"), (F.col("field") == "allow").alias("allow")
    )
    return rules.join(agents, ["host", "text", "group"]).select("host", "agent", "pattern", "allow").distinct()


def _path_regex(pattern: Column) -> Column:
    """A rule's path as a regular expression: ``*`` is any run, a last ``$`` the end."""
    ends = pattern.endswith("$")
    body = F.when(ends, F.expr("left(pattern, length(pattern) - 1)")).otherwise(pattern)
    quoted = F.regexp_replace(body, r"([\\.\[\]{}()+?^$|])", r"\\$1")
    return F.concat(F.lit("^"), F.replace(quoted, F.lit("*"), F.lit(".*")), F.when(ends, "$").otherwise(""))


def robots_verdicts(urls, rules, agent: str):
    """(url, allowed): the longest matching rule of the url's host decides, allow on a tie.

    Rules of groups that name the agent count alone where a host has any, else those for
    every agent.  Rules with a fixed beginning of PREFIX_CHARS or more meet only addresses
    that begin alike, by an equi-join on host and beginning; the few others meet their host's
    addresses.  An address that no rule meets is allowed.
    """
    named = rules.filter(F.lit(agent.lower()).contains(F.col("agent")) & (F.col("agent") != ""))
    general = rules.filter(F.col("agent") == ANY_AGENT).join(named.select("host").distinct(), "host", "left_anti")
    own = named.unionByName(general).select("host", "pattern", "allow").distinct()
    literal = F.regexp_extract("pattern", r"^[^*$]*", 0)
    own = own.select(
        "host", F.when(F.length(literal) >= PREFIX_CHARS, F.left(literal, F.lit(PREFIX_CHARS))).otherwise("").alias("begin"), "pattern", "allow"
    ).withColumn("regex", _path_regex(F.col("pattern")))
    asked = urls.select("url", url_host(F.col("url")).alias("host"), F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*([^#]*)", 1).alias("path"))
    asked = asked.withColumn("path", F.when(F.col("path").startswith("/"), F.col("path")).otherwise(F.concat(F.lit("/"), "path")))
    keyed = asked.select("url", "host", "path", F.explode(F.array_distinct(F.array(F.lit(""), F.left("path", F.lit(PREFIX_CHARS))))).alias("begin"))
    met = keyed.join(own, ["host", "begin"]).filter(F.call_function("regexp_like", "path", "regex"))
    best = met.groupBy("url").agg(F.max(F.struct(F.length("pattern").alias("size"), "allow")).alias("best"))
    return asked.select("url").join(best, "url", "left").select("url", F.coalesce(F.col("best.allow"), F.lit(True)).alias("allowed"))


# -- sitemaps ---------------------------------------------------------------


PREFIX = r"((?:[\w.\-]+:)?)"


def _elements(xml: Column, tag: str) -> Column:
    """Every element ``tag``, whatever the prefix of its namespace; the closing tag has the same."""
    return F.regexp_extract_all(xml, F.lit(rf"(?s)<{PREFIX}{tag}(?:\s[^>]*+)?>.*?</\1{tag}\s*>"), 0)


def _location(element: Column) -> Column:
    """The element's own ``loc``, which has its prefix: extensions inside it have another."""
    prefix = F.regexp_replace(F.regexp_extract(element, f"^<{PREFIX}", 1), r"\.", r"\\.")
    own = F.concat(F.lit("(?s)<"), prefix, F.lit(r"loc(?:\s[^>]*+)?>(.*?)</"), prefix, F.lit(r"loc\s*>"))
    return F.call_function("regexp_extract", element, own, F.lit(1))


def sitemap_urls(xml: Column) -> Column:
    """``<loc>`` of index entries, then of pages.

    The text is searched, not parsed, so broken files give what can be read of
    them and size does not matter.  The namespace may have any prefix or none.  NULL gives
    no location.
    """
    plain = F.regexp_replace(F.coalesce(xml, F.lit("")), r"(?s)<!--.*?-->", "")
    found = F.transform(F.concat(_elements(plain, "sitemap"), _elements(plain, "url")), _location)

    def text(loc: Column) -> Column:
        loc = F.btrim(F.regexp_replace(loc, r"(?s)<!\[CDATA\[(.*?)\]\]>", "$1"), F.lit(" \t\n\r"))
        for entity, char in XML_ENTITIES.items():
            loc = F.replace(loc, F.lit(entity), F.lit(char))
        return loc

    return F.filter(F.transform(found, text), lambda u: u != "")


def is_sitemap_index(locations: Column) -> Column:
    """An index only when every location looks like a sitemap."""
    return (F.size(locations) > 0) & F.forall(
        locations, lambda u: u.endswith(".xml") | F.contains(F.lower(u), F.lit("sitemap"))
    )


# -- page text --------------------------------------------------------------

_DROPPED = {"script", "style", "nav", "footer", "header", "aside", "noscript", "template", "form", "head"}
_BREAKING = {"p", "div", "section", "article", "main", "ul", "ol", "table", "blockquote", "figure", "body", "html"}


class _Markdown(HTMLParser):
    """Visible text of the main part of a page as markdown blocks."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.blocks: list[tuple[bool, str]] = []
        self.line: list[str] = []
        self.hidden = 0
        self.main = 0
        self.prefix = ""
        self.href: list[str | None] = []
        self.cells: list[str] | None = None
        self.rows = 0
        self.pre = False

    def flush(self) -> None:
        raw = "".join(self.line)
        text = raw.strip("\n") if self.pre else re.sub(r"\s+", " ", raw).strip()
        if text.strip():
            self.blocks.append((self.main > 0, self.prefix + text))
        self.line, self.prefix = [], ""

    def handle_starttag(self, tag, attrs) -> None:
        if tag in _DROPPED:
            self.hidden += 1
        if self.hidden:
            return
        if tag in ("article", "main"):
            self.flush()
            self.main += 1
        elif tag in ("h1", "h2", "h3", "h4", "h5", "h6"):
            self.flush()
            self.prefix = "#" * int(tag[1]) + " "
        elif tag == "li":
            self.flush()
            self.prefix = "- "
        elif tag == "pre":
            self.flush()
            self.pre = True
        elif tag == "tr":
            self.flush()
            self.cells = []
        elif tag == "table":
            self.flush()
            self.rows = 0
        elif tag == "a":
            self.href.append(dict(attrs).get("href"))
            if self.href[-1]:
                self.line.append("[")
        elif tag == "br":
            self.line.append(" ")
        elif tag in _BREAKING:
            self.flush()

    def handle_endtag(self, tag) -> None:
        if tag in _DROPPED:
            self.hidden = max(0, self.hidden - 1)
            return
        if self.hidden:
            return
        if tag in ("article", "main"):
            self.flush()
            self.main = max(0, self.main - 1)
        elif tag == "a" and self.href:
            target = self.href.pop()
            if target:
                self.line.append(f"]({target})")
        elif tag == "pre":
            body = "".join(self.line).strip("\n")
            self.line = []
            self.pre = False
            if body.strip():
                self.blocks.append((self.main > 0, f"```\n{body}\n```"))
        elif tag in ("td", "th") and self.cells is not None:
            self.cells.append(re.sub(r"\s+", " ", "".join(self.line)).strip())
            self.line = []
        elif tag == "tr" and self.cells is not None:
            if self.cells:
                row = "| " + " | ".join(self.cells) + " |"
                if self.rows == 0:
                    row += "\n| " + " | ".join("---" for _ in self.cells) + " |"
                self.rows += 1
                if self.rows > 1 and self.blocks:
                    main, table = self.blocks.pop()
                    row = table + "\n" + row
                self.blocks.append((self.main > 0, row))
            self.cells = None
            self.line = []
        elif tag in _BREAKING or tag == "li" or re.fullmatch("h[1-6]", tag):
            self.flush()

    def handle_data(self, data: str) -> None:
        if not self.hidden:
            self.line.append(data)


def html_to_markdown(html: str) -> str | None:
    """Main content as markdown, or nothing below the minimum length."""
    parser = _Markdown()
    parser.feed(html or "")
    parser.close()
    parser.flush()
    inside = [text for main, text in parser.blocks if main]
    text = "\n\n".join(inside or [text for _, text in parser.blocks]).strip()
    return text if len(text) >= MIN_TEXT else None


def extract_page(html: str) -> str | None:
    """Content of one page; markup that cannot be parsed gives none, like a page without text."""
    try:
        return html_to_markdown(html)
    except (AssertionError, ValueError, RecursionError):
        return None


@arrow_udf(T.StringType())
def _extract(htmls: pa.Array) -> pa.Array:
    # One page after the other becomes a Python text, not the whole batch.
    texts = []
    for value in htmls:
        html = value.as_py()
        texts.append(None if html is None or len(html) > MAX_PAGE else extract_page(html))
    return pa.array(texts, pa.string())


def page_markdown(html: Column) -> Column:
    return _extract(html)
