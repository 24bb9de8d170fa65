"""DuckDB statements that state the registered queries independently."""

from __future__ import annotations

# Fixed values, written out here so that a wrong one in the operators does not stay green:
# the constants of BM25 and ts_rank, and the suffix tables of Porter's stemmer.
K1, B, MIN_IDF = 1.2, 0.75, 1e-6
TS_WEIGHT, TS_NORM = 0.1, 1.64493406685
STEP2 = {'ational': 'ate',
 'tional': 'tion',
 'enci': 'ence',
 'anci': 'ance',
 'izer': 'ize',
 'bli': 'ble',
 'alli': 'al',
 'entli': 'ent',
 'eli': 'e',
 'ousli': 'ous',
 'ization': 'ize',
 'ation': 'ate',
 'ator': 'ate',
 'alism': 'al',
 'iveness': 'ive',
 'fulness': 'ful',
 'ousness': 'ous',
 'aliti': 'al',
 'iviti': 'ive',
 'biliti': 'ble',
 'logi': 'log'}
STEP3 = {'icate': 'ic', 'ative': '', 'alize': 'al', 'iciti': 'ic', 'ical': 'ic', 'ful': '', 'ness': ''}
STEP4 = ('al', 'ance', 'ence', 'er', 'ic', 'able', 'ible', 'ant', 'ement', 'ment', 'ent', 'ion', 'ou', 'ism', 'ate',
 'iti', 'ous', 'ive', 'ize')

DOCS = """SELECT source || '/doc-' || doc_id || '.md' AS file_path, 0 AS chunk_index,
  split_part(text, chr(10), 1) AS title, text AS content, source AS category, lang AS audience,
  substr(sha256(text), 1, 16) AS content_hash FROM documents"""
CONVERSATIONS = """SELECT 'conversations/conv-' || conv_id || '.md' AS file_path, CAST(turn AS INTEGER) AS chunk_index,
  role AS title, text AS content, 'conversations' AS category, 'all' AS audience,
  substr(sha256(text), 1, 16) AS content_hash FROM conversations"""
CHUNKS = f"{DOCS} UNION ALL {CONVERSATIONS}"
PAGE_CHUNKS = r"""SELECT url AS file_path, 0 AS chunk_index, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title,
  regexp_replace(html, '(?s)<(script|style)[^>]*>.*?</(script|style)>|<!--.*?-->|<[^>]+>', ' ', 'g') AS content,
  lower(regexp_extract(url, '^https?://([^/?#]+)', 1)) AS category FROM pages"""
QUERIES = "SELECT item_id AS query_id, text AS query FROM benchmark"
VECTORS = """SELECT source || '/doc-' || doc_id || '.md' AS file_path, 0 AS chunk_index, source AS category,
  list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS embedding
  FROM documents JOIN embeddings ON vec_id = doc_id"""
VECTOR_QUERIES = """SELECT item_id AS query_id, text AS query,
  list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS query_embedding
  FROM benchmark JOIN embeddings ON vec_id = item_id"""
ACCESS = """SELECT source || '/doc-' || doc_id || '.md' AS file_path, event_type AS tool,
  CAST(floor(value) AS BIGINT) AS tokens_returned,
  CAST(json_extract_string(props, '$.k') AS BIGINT) * 10 AS tokens_baseline, ts AS accessed_at
  FROM events JOIN documents ON doc_id = user_id"""
COMMIT_FILES = "SELECT DISTINCT l_orderkey AS commit_id, 'parts/part-' || l_partkey || '.md' AS file FROM lineitem"
COMMITS = """SELECT o_orderkey AS commit_id, sha256(CAST(o_orderkey AS VARCHAR)) AS hash,
  coalesce(c_name, 'unknown') AS author, 'customer' || o_custkey || '@example.com' AS author_email,
  strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') AS date, 'Order ' || o_orderkey || ' is ' || o_orderpriority AS subject,
  'Status ' || o_orderstatus AS body FROM orders LEFT JOIN customer ON c_custkey = o_custkey"""


def words(text: str) -> str:
    return (
        f"list_filter(string_split_regex(strip_accents(lower({text})), '[^\\p{{L}}\\p{{N}}\\p{{Co}}]+'), lambda t: t <> '')"
    )


def query_words(text: str) -> str:
    return (
        rf"""list_filter(string_split_regex(regexp_replace({text}, '["*()\-+^:]', '', 'g'), '\s+'), lambda t: t <> '')"""
    )


# -- Porter's algorithm over a vocabulary, by regular expressions ------------

_C, _V = "[^aeiou][^aeiouy]*", "[aeiouy][aeiou]*"
_MORE_THAN_0 = f"^({_C})?{_V}{_C}"
_EXACTLY_1 = f"^({_C})?{_V}{_C}({_V})?$"
_MORE_THAN_1 = f"^({_C})?{_V}{_C}{_V}{_C}"
_VOWEL = f"^({_C})?{_V}"
_CVC = f"^{_C}[aeiouy][^aeiouwxy]$"


def _has(text: str, pattern: str) -> str:
    return f"regexp_matches({text}, '{pattern}')"


def _cut(n: int | str) -> str:
    return f"left(x, CAST(length(x) - {n} AS BIGINT))"


def _suffix_step(suffixes, replacement: str, condition) -> str:
    found = f"regexp_extract(x, '({'|'.join(suffixes)})$')"
    base = f"left(x, CAST(length(x) - length({found}) AS BIGINT))"
    return f"CASE WHEN {found} <> '' AND {condition(base, found)} THEN {base} || {replacement.format(found=found)} ELSE x END"


def _mapping(rules: dict[str, str]) -> str:
    cases = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in rules.items())
    return "CASE {found} " + cases + " ELSE '' END"


def stems(source: str) -> str:
    """(w, x): every word of ``source`` (a statement with column w) and its stem."""
    repair = (
        "CASE WHEN regexp_matches(b, '(at|bl|iz)$') THEN b || 'e' "
        "WHEN length(b) > 1 AND right(b, 1) = substr(b, length(b) - 1, 1) "
        "AND NOT regexp_matches(b, '[aeioulsz]$') AND (right(b, 1) <> 'y' OR regexp_matches(b, '[^aeiouy]yy$')) "
        "THEN left(b, length(b) - 1) "
        f"WHEN {_has('b', _CVC)} THEN b || 'e' ELSE b END"
    )
    plural = (
        f"CASE WHEN regexp_matches(x, '(sses|ies)$') THEN {_cut(2)} WHEN x LIKE '%ss' THEN x "
        f"WHEN x LIKE '%s' THEN {_cut(1)} ELSE x END"
    )
    base = (
        f"CASE WHEN x LIKE '%eed' THEN NULL WHEN x LIKE '%ed' AND {_has(_cut(2), _VOWEL)} THEN {_cut(2)} "
        f"WHEN x LIKE '%ing' AND {_has(_cut(3), _VOWEL)} THEN {_cut(3)} END"
    )
    after = (
        f"CASE WHEN b IS NOT NULL THEN {repair} "
        f"WHEN x LIKE '%eed' AND {_has(_cut(3), _MORE_THAN_0)} THEN {_cut(1)} ELSE x END"
    )
    to_i = f"CASE WHEN x LIKE '%y' AND {_has(_cut(1), _VOWEL)} THEN {_cut(1)} || 'i' ELSE x END"
    positive = lambda b, f: _has(b, _MORE_THAN_0)
    strong = lambda b, f: f"{_has(b, _MORE_THAN_1)} AND ({f} <> 'ion' OR regexp_matches({b}, '[st]$'))"
    drop_e = (
        f"CASE WHEN x LIKE '%e' AND ({_has(_cut(1), _MORE_THAN_1)} OR ({_has(_cut(1), _EXACTLY_1)} "
        f"AND NOT {_has(_cut(1), _CVC)})) THEN {_cut(1)} ELSE x END"
    )
    drop_l = f"CASE WHEN x LIKE '%ll' AND {_has('x', _MORE_THAN_1)} THEN {_cut(1)} ELSE x END"
    sql = f"SELECT w, {plural} AS x FROM (SELECT w, w AS x FROM ({source}) WHERE length(w) BETWEEN 3 AND 64)"
    sql = f"SELECT w, {after} AS x FROM (SELECT w, x, {base} AS b FROM ({sql}))"
    for step in (
        to_i,
        _suffix_step(STEP2, _mapping(STEP2), positive),
        _suffix_step(STEP3, _mapping(STEP3), positive),
        _suffix_step(STEP4, "''", strong),
        drop_e,
        drop_l,
    ):
        sql = f"SELECT w, {step} AS x FROM ({sql})"
    return f"{sql} UNION ALL SELECT w, w FROM ({source}) WHERE length(w) NOT BETWEEN 3 AND 64"


# -- search -----------------------------------------------------------------


def _stopped(text: str) -> str:
    stop = ", ".join(f"'{w}'" for w in STOP_WORDS.split())
    return f"list_filter({words(text)}, lambda t: t NOT IN ({stop}))"


def _occurrences(chunks: str, queries: str, stemmed: bool, words=words) -> str:
    """CTEs c (chunks), occ (term counts), ql (query terms), stats."""
    vocab = "SELECT DISTINCT w FROM (SELECT w FROM tok UNION ALL SELECT w FROM qtok)"
    stem = stems(vocab) if stemmed else f"SELECT w, w AS x FROM ({vocab})"
    return f"""c AS (SELECT *, md5(chunk_index || '#' || file_path) AS cid, {words('title')} AS tw, {words('content')} AS cw
    FROM ({chunks})),
  q AS ({queries}),
  tok AS (SELECT cid, 1 AS in_title, unnest(tw) AS w FROM c UNION ALL SELECT cid, 0, unnest(cw) FROM c),
  qtok AS (SELECT query_id, unnest({words('word')}) AS w FROM (SELECT query_id, unnest({query_words('query')}) AS word FROM q)),
  st AS ({stem}),
  occ AS (SELECT cid, x AS term, sum(in_title) AS tf_title, sum(1 - in_title) AS tf_content
    FROM tok JOIN st USING (w) GROUP BY cid, x),
  ql AS (SELECT query_id, x AS term, count(*) AS qtf FROM qtok JOIN st USING (w) GROUP BY query_id, x),
  stats AS (SELECT count(*) AS n, avg(len(tw) + len(cw)) AS mean_len FROM c),
  df AS (SELECT term, count(*) AS df FROM occ GROUP BY term)"""


def _bm25_scored(title: float = 10.0, category: bool = False) -> str:
    tf = f"({title} * tf_title + 1.0 * tf_content)"
    keep = "WHERE q.category IS NULL OR q.category = c.category" if category else ""
    return f"""scored AS (SELECT ql.query_id, cid, round(sum(qtf * greatest(ln((n - df + 0.5) / (df + 0.5)), {MIN_IDF})
      * {tf} * {K1 + 1} / ({tf} + {K1} * ({1 - B} + {B} * (len(tw) + len(cw)) / mean_len))), 6) AS score
    FROM ql JOIN occ USING (term) JOIN df USING (term) JOIN c USING (cid) JOIN q USING (query_id), stats {keep}
    GROUP BY ql.query_id, cid)"""


def _ranked(scored: str, k: int) -> str:
    return f"""SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, cid) AS rank FROM {scored})
    WHERE rank <= {k}"""


_HIT = "query_id, rank, file_path, chunk_index, c.category AS category, score"


def bm25(k: int = 5, chunks: str = CHUNKS, queries: str = QUERIES, stemmed: bool = True, title: float = 10.0, category=False) -> str:
    return f"""WITH {_occurrences(chunks, queries, stemmed)}, {_bm25_scored(title, category)}
  SELECT {_HIT} FROM ({_ranked('scored', k)}) r JOIN c USING (cid)"""


def alternating(k: int = 20) -> str:
    return f"""SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY turn, rank) AS rank, file_path, chunk_index, category, score
  FROM (SELECT *, row_number() OVER (PARTITION BY query_id, category ORDER BY rank) AS turn FROM ({bm25(k)}))"""


def _ts_scored() -> str:
    return f"""nt AS (SELECT query_id, count(*) AS n_terms FROM ql GROUP BY query_id),
  ts AS (SELECT query_id, cid, round(sum(list_sum(list_transform(range(1, CAST(tf_title + tf_content AS BIGINT) + 1),
      lambda j: 1.0 / (j * j))) * {TS_WEIGHT / TS_NORM!r} / n_terms), 6) AS score
    FROM ql JOIN occ USING (term) JOIN nt USING (query_id) GROUP BY query_id, cid)"""


def ts_rank(k: int = 5, stopped: bool = False) -> str:
    return f"""WITH {_occurrences(CHUNKS, QUERIES, True, _stopped if stopped else words)}, {_ts_scored()}
  SELECT {_HIT} FROM ({_ranked('ts', k)}) r JOIN c USING (cid)"""


# The stop words of the English analyzer (fixed values).
STOP_WORDS = """i me my myself we our ours ourselves you your yours yourself yourselves he him his himself
    she her hers herself it its itself they them their theirs themselves what which who whom this
    that these those am is are was were be been being have has had having do does did doing a an
    the and but if or because as until while of at by for with about against between into through
    during before after above below to from up down in out on off over under again further then
    once here there when where why how all any both each few more most other some such no nor not
    only own same so than too very s t can will just don should now"""
# Of the first words of a passage: alternative, whether excluded, first word, number of words.
_LITERALS = ((0, 0, 1, 2), (1, 0, 3, 1), (1, 0, 4, 1), (1, 1, 5, 1), (2, 0, 6, 1), (2, 1, 7, 2), (2, 0, 9, 2), (3, 1, 11, 1), (3, 0, 12, 1))


def websearch(k: int = 10) -> str:
    stop = ", ".join(f"'{w}'" for w in STOP_WORDS.split())
    stopped = _stopped
    literals = " UNION ALL ".join(
        f"SELECT query_id, {alt} AS alt, {neg} AS neg, w[{at}:{at + n - 1}] AS lw FROM q" for alt, neg, at, n in _LITERALS
    )
    vocab = "SELECT DISTINCT w FROM (SELECT w FROM pos UNION ALL SELECT w FROM lw)"
    return f"""WITH c AS (SELECT *, md5(chunk_index || '#' || file_path) AS cid, {stopped('title')} AS tw, {stopped('content')} AS cw FROM ({CHUNKS})),
  q AS (SELECT item_id AS query_id, {words('text')} AS w FROM benchmark WHERE len({words('text')}) >= 12),
  pos AS (SELECT cid, unnest(range(len(tw))) AS i, unnest(tw) AS w FROM c
    UNION ALL SELECT cid, len(tw) + 1 + unnest(range(len(cw))), unnest(cw) FROM c),
  lit AS (SELECT query_id, alt, neg, list_filter(lw, lambda t: t NOT IN ({stop})) AS lw FROM ({literals})),
  lw AS (SELECT DISTINCT unnest(lw) AS w FROM lit),
  st AS ({stems(vocab)}),
  p AS (SELECT cid, i, x FROM pos JOIN st USING (w)),
  l AS (SELECT DISTINCT query_id, alt, neg, a.x AS x1, b.x AS x2 FROM lit JOIN st a ON a.w = lw[1] LEFT JOIN st b ON b.w = lw[2]),
  one AS (SELECT cid, x AS x1, NULL::VARCHAR AS x2, count(*) AS tf FROM p WHERE x IN (SELECT x1 FROM l) GROUP BY ALL),
  two AS (SELECT p.cid, l2.x1, l2.x2, count(*) AS tf FROM (SELECT DISTINCT x1, x2 FROM l WHERE x2 IS NOT NULL) l2
    JOIN p ON p.x = l2.x1 JOIN p r ON r.cid = p.cid AND r.i = p.i + 1 AND r.x = l2.x2 GROUP BY ALL),
  occ AS (SELECT * FROM one UNION ALL SELECT * FROM two),
  g AS (SELECT query_id, alt, count(*) FILTER (neg = 0) AS need FROM l GROUP BY ALL),
  f AS (SELECT query_id, alt, cid, count(*) FILTER (neg = 0) AS has, count(*) FILTER (neg = 1) AS bad
    FROM l JOIN occ ON occ.x1 = l.x1 AND occ.x2 IS NOT DISTINCT FROM l.x2 GROUP BY ALL),
  hit AS (SELECT DISTINCT g.query_id, c.cid FROM g CROSS JOIN c LEFT JOIN f ON f.query_id = g.query_id AND f.alt = g.alt AND f.cid = c.cid
    WHERE coalesce(f.has, 0) = need AND coalesce(f.bad, 0) = 0),
  t AS (SELECT DISTINCT query_id, x1, x2 FROM l WHERE neg = 0),
  n AS (SELECT query_id, count(*) AS n_terms FROM t GROUP BY query_id),
  part AS (SELECT t.query_id, cid, list_sum(list_transform(range(1, tf + 1), lambda j: 1.0 / (j * j))) * {TS_WEIGHT / TS_NORM!r} / n_terms AS s
    FROM t JOIN n USING (query_id) JOIN occ ON occ.x1 = t.x1 AND occ.x2 IS NOT DISTINCT FROM t.x2),
  scored AS (SELECT hit.query_id, hit.cid, round(coalesce(sum(s), 0), 6) AS score FROM hit
    LEFT JOIN part ON part.query_id = hit.query_id AND part.cid = hit.cid GROUP BY ALL)
  SELECT {_HIT} FROM ({_ranked('scored', k)}) r JOIN c USING (cid)"""


def _shown(k: int = 5) -> str:
    """CTEs h (hits with raw tokens, the text before each, and their number), m (matches)."""
    separators = r"[^\p{L}\p{N}\p{Co}]+"
    return f"""{_occurrences(CHUNKS, QUERIES, True)}, {_bm25_scored()},
  r AS (SELECT r.query_id, r.rank, c.* FROM ({_ranked('scored', k)}) r JOIN c USING (cid)),
  h AS (SELECT query_id, rank, cid, file_path, chunk_index, cw, list_filter(string_split_regex(content, '{separators}'), lambda t: t <> '') AS raw,
    CASE WHEN regexp_matches(content, '^{separators}') THEN regexp_extract_all(content, '{separators}')
      ELSE list_concat([''], regexp_extract_all(content, '{separators}')) END AS before, CAST(len(cw) AS BIGINT) AS n FROM r),
  w AS (SELECT query_id, rank, unnest(range(n)) AS i, unnest(cw) AS w FROM h),
  m AS (SELECT query_id, rank, i, x FROM w JOIN st USING (w) WHERE (query_id, x) IN (SELECT (query_id, term) FROM ql))"""


def snippet(size: int = 32) -> str:
    return f"""WITH {_shown()},
  s AS (SELECT DISTINCT query_id, rank, least(i, greatest(0, n - {size})) AS s FROM m JOIN h USING (query_id, rank)),
  v AS (SELECT query_id, rank, s, count(DISTINCT x) AS kinds, count(*) AS total FROM s JOIN m USING (query_id, rank) WHERE i >= s AND i < s + {size} GROUP BY ALL),
  b AS (SELECT query_id, rank, arg_max(s, struct_pack(kinds := kinds, total := total, s := -s)) AS s FROM v GROUP BY ALL),
  a AS (SELECT query_id, rank, list(i) AS spots FROM m GROUP BY ALL),
  d AS (SELECT h.*, coalesce(b.s, 0) AS a0, least(coalesce(b.s, 0) + {size}, n) AS a1, coalesce(spots, []) AS spots
    FROM h LEFT JOIN b USING (query_id, rank) LEFT JOIN a USING (query_id, rank))
  SELECT query_id, rank, file_path, chunk_index, CASE WHEN n > 0 AND len(raw) = n THEN
    (CASE WHEN a0 > 0 THEN '...' ELSE before[1] END) || array_to_string(list_transform(range(a0, a1), lambda i:
      (CASE WHEN i > a0 AND list_contains(spots, i - 1) AND NOT list_contains(spots, i) THEN '</mark>' ELSE '' END)
      || (CASE WHEN i > a0 THEN before[i + 1] ELSE '' END)
      || (CASE WHEN list_contains(spots, i) AND (i = a0 OR NOT list_contains(spots, i - 1)) THEN '<mark>' ELSE '' END) || raw[i + 1]
      || (CASE WHEN i = a1 - 1 AND list_contains(spots, i) THEN '</mark>' ELSE '' END)), '')
    || (CASE WHEN a1 < n THEN '...' ELSE coalesce(before[a1 + 1], '') END) END AS highlight FROM d"""


def headline(longest: int = 35, shortest: int = 20) -> str:
    return f"""WITH {_shown()},
  pair AS (SELECT a.query_id, a.rank, a.i AS s, b.i AS e, b.x FROM m a JOIN m b ON b.query_id = a.query_id AND b.rank = a.rank AND b.i >= a.i AND b.i < a.i + {longest}),
  kind AS (SELECT query_id, rank, s, x, min(e) AS e FROM pair GROUP BY ALL),
  cover AS (SELECT query_id, rank, s, count(*) AS kinds, max(e) AS e FROM kind GROUP BY ALL),
  b AS (SELECT query_id, rank, arg_max(struct_pack(s := s, e := e), struct_pack(kinds := kinds, size := s - e, s := -s)) AS c FROM cover GROUP BY ALL),
  a AS (SELECT query_id, rank, list(i) AS spots FROM m GROUP BY ALL),
  d AS (SELECT h.*, coalesce(c.s, 0) AS s0, greatest(coalesce(c.e + 1, 0), least(coalesce(c.s, 0) + {shortest}, n)) AS a1, coalesce(spots, []) AS spots
    FROM h LEFT JOIN b USING (query_id, rank) LEFT JOIN a USING (query_id, rank)),
  e AS (SELECT *, greatest(least(s0, a1 - {shortest}), 0) AS a0 FROM d)
  SELECT query_id, rank, file_path, chunk_index, CASE WHEN n > 0 AND len(raw) = n THEN array_to_string(list_transform(range(a0, a1), lambda i:
    (CASE WHEN i > a0 THEN before[i + 1] ELSE '' END) || (CASE WHEN list_contains(spots, i) THEN '<mark>' || raw[i + 1] || '</mark>' ELSE raw[i + 1] END)), '')
    END AS headline FROM e"""


EVERY_20TH_VECTOR = """SELECT vec_id AS query_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS query_embedding
  FROM embeddings WHERE vec_id % 20 = 0"""


def _near(queries: str = VECTOR_QUERIES) -> str:
    return f"""v AS (SELECT *, md5(chunk_index || '#' || file_path) AS cid FROM ({VECTORS})),
  vq AS ({queries}),
  cosines AS (SELECT query_id, cid, round(list_cosine_similarity(query_embedding, embedding), 6) AS score FROM vq CROSS JOIN v)"""


def knn(k: int = 10, queries: str = VECTOR_QUERIES) -> str:
    return f"""WITH {_near(queries)} SELECT query_id, rank, file_path, chunk_index, category, score
  FROM ({_ranked('cosines', k)}) r JOIN v USING (cid)"""


def mmr(pool: int = 20, share: float = 0.6) -> str:
    return f"""WITH RECURSIVE {_near()},
  pool AS (SELECT r.query_id, r.rank, r.score, v.*, list_cosine_similarity(query_embedding, embedding) AS rel
    FROM ({_ranked('cosines', pool)}) r JOIN v USING (cid) JOIN vq ON vq.query_id = r.query_id),
  sims AS (SELECT a.query_id, a.rank AS i, b.rank AS j, list_cosine_similarity(a.embedding, b.embedding) AS s FROM pool a JOIN pool b USING (query_id)),
  walk(query_id, n, picked) AS (
    SELECT query_id, 1, [arg_max(rank, struct_pack(rel := rel, t := -rank))] FROM pool GROUP BY query_id
    UNION ALL
    SELECT query_id, n + 1, list_append(picked, arg_max(i, struct_pack(v := v, t := -i))) FROM (
      SELECT walk.query_id, n, picked, s.i, {share} * any_value(p.rel) - {round(1 - share, 9)} * max(s.s) AS v
      FROM walk JOIN sims s ON s.query_id = walk.query_id AND list_contains(picked, s.j) AND NOT list_contains(picked, s.i)
      JOIN pool p ON p.query_id = s.query_id AND p.rank = s.i GROUP BY walk.query_id, n, picked, s.i) GROUP BY query_id, n, picked),
  last AS (SELECT query_id, arg_max(picked, n) AS picked FROM walk GROUP BY query_id)
  SELECT pool.query_id, CAST(list_position(picked, pool.rank) AS BIGINT) AS rank, file_path, chunk_index, category, score FROM pool JOIN last USING (query_id)"""


def hybrid_rrf(k: int = 5, arm: int = 20) -> str:
    return f"""WITH {_occurrences(CHUNKS, VECTOR_QUERIES, True)}, {_bm25_scored()}, {_near()},
  kw AS (SELECT query_id, cid, rank, file_path || ':' || lpad(CAST(chunk_index AS VARCHAR), 10, '0') AS key FROM ({_ranked('scored', arm)}) r JOIN c USING (cid)),
  sem AS (SELECT query_id, cid, rank, file_path || ':' || lpad(CAST(chunk_index AS VARCHAR), 10, '0') AS key FROM ({_ranked('cosines', arm)}) r JOIN c USING (cid)),
  k1 AS (SELECT query_id, key, max(rank) AS kr FROM kw GROUP BY ALL),
  s1 AS (SELECT query_id, key, max(rank) AS sr FROM sem GROUP BY ALL),
  fused AS (SELECT query_id, key, coalesce(1.0 / (60 + CAST(kr AS DOUBLE)), 0.0) + coalesce(1.0 / (60 + CAST(sr AS DOUBLE)), 0.0) AS score
    FROM k1 FULL JOIN s1 USING (query_id, key)),
  best AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, key DESC) AS rank FROM fused),
  data AS (SELECT query_id, key, cid FROM (SELECT *, row_number() OVER (PARTITION BY query_id, key ORDER BY arm, rank DESC) AS first
    FROM (SELECT query_id, key, cid, rank, 0 AS arm FROM kw UNION ALL SELECT query_id, key, cid, rank, 1 FROM sem)) WHERE first = 1)
  SELECT query_id, rank, file_path, chunk_index, c.category AS category, round(score, 6) AS score
  FROM best JOIN data USING (query_id, key) JOIN c USING (cid) WHERE rank <= {k}"""


def hybrid_linear(k: int = 5) -> str:
    return f"""WITH {_occurrences(CHUNKS, VECTOR_QUERIES, True)}, {_ts_scored()}, {_near()},
  pairs AS (SELECT query_id, cid, ts.score AS t, cosines.score AS s FROM ts FULL JOIN cosines USING (query_id, cid)),
  linear AS (SELECT query_id, cid, round(CASE WHEN s IS NOT NULL THEN 0.4 * coalesce(t, 0) + 0.6 * s ELSE t END, 6) AS score
    FROM pairs WHERE t IS NOT NULL OR 1.0 - s < 0.8)
  SELECT {_HIT} FROM ({_ranked('linear', k)}) r JOIN c USING (cid)"""


def collapse(k: int = 20) -> str:
    return f"""WITH {_occurrences(CHUNKS, QUERIES, True)}, {_bm25_scored()},
  hits AS (SELECT query_id, cid, file_path, chunk_index, c.category AS category, score FROM scored JOIN c USING (cid)),
  first AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, file_path ORDER BY score DESC, cid) AS place FROM hits) WHERE place = 1)
  SELECT query_id, rank, file_path, chunk_index, category, score
  FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, cid) AS rank FROM first) WHERE rank <= {k}"""


def preview(k: int = 5) -> str:
    return f"""WITH {_occurrences(CHUNKS, QUERIES, True)}, {_bm25_scored()}
  SELECT query_id, rank, file_path, title, CASE WHEN length(content) > 200 THEN left(content, 200) || '...' ELSE content END AS content_preview,
    round(score, 4) AS score FROM ({_ranked('scored', k)}) r JOIN c USING (cid)"""


_HOSTS = "SELECT DISTINCT lower(regexp_extract(url, '^https?://([^/?#]+)', 1)) AS query FROM pages"


def phrases(k: int = 5) -> str:
    tf = "(10.0 * tf_title + 1.0 * tf_content)"
    starts = (
        "CAST(len(list_filter(range(1, greatest(len({w}) - len(ph) + 2, 1)), "
        "lambda i: list_slice({w}, i, i + len(ph) - 1) = ph)) AS DOUBLE)"
    )
    return f"""WITH c AS (SELECT *, md5(chunk_index || '#' || file_path) AS cid, {words('title')} AS tw, {words('content')} AS cw FROM ({PAGE_CHUNKS})),
  q AS ({_HOSTS}),
  p AS (SELECT query, {words('regexp_replace(query, $r$["*()\\-+^:]$r$, $r$$r$, $r$g$r$)')} AS ph FROM q),
  occ AS (SELECT query, cid, len(tw) + len(cw) AS doc_len, {starts.format(w='tw')} AS tf_title, {starts.format(w='cw')} AS tf_content FROM p JOIN c ON list_has_all(list_concat(tw, cw), ph)),
  hit AS (SELECT * FROM occ WHERE tf_title + tf_content > 0),
  df AS (SELECT query, count(*) AS df FROM hit GROUP BY query),
  stats AS (SELECT count(*) AS n, avg(len(tw) + len(cw)) AS mean_len FROM c),
  scored AS (SELECT query AS query_id, cid, round(greatest(ln((n - df + 0.5) / (df + 0.5)), {MIN_IDF}) * {tf} * {K1 + 1}
     / ({tf} + {K1} * ({1 - B} + {B} * doc_len / mean_len)), 6) AS score FROM hit JOIN df USING (query), stats)
  SELECT {_HIT} FROM ({_ranked('scored', k)}) r JOIN c USING (cid)"""


# -- documents, usage ---------------------------------------------------------

_TOKENS = "CASE WHEN length({t}) = 0 THEN 0 ELSE greatest(1, length({t}) // 4) END"

REASSEMBLED = f"""SELECT file_path, arg_min(title, chunk_index) AS title, arg_min(category, chunk_index) AS category,
  string_agg(content, chr(10) || chr(10) ORDER BY chunk_index) AS content, count(*) AS chunks FROM ({CHUNKS}) GROUP BY file_path"""

GET_DOC = f"""SELECT file_path, title, CASE WHEN length(content) > 1000 THEN left(content, 1000) || '...' ELSE content END AS content,
  category, length(content) > 1000 AS truncated,
  CAST({_TOKENS.format(t="(CASE WHEN length(content) > 1000 THEN left(content, 1000) || '...' ELSE content END)")} AS BIGINT) AS tokens_returned,
  CAST({_TOKENS.format(t="content")} AS BIGINT) AS tokens_baseline FROM ({REASSEMBLED})"""

EXPORT = f"SELECT file_path, title, category, regexp_replace(content, '\\s+$', '') AS content, chunks FROM ({REASSEMBLED})"

EXPORT_MARKDOWN = f"""SELECT file_path, '---' || chr(10) || 'file_path: ' || file_path || chr(10) || 'title: ' || title || chr(10)
  || 'category: ' || category || chr(10) || '---' || chr(10) || chr(10) || content || chr(10) || chr(10) AS value FROM ({EXPORT})"""

LIST_DOCS = f"SELECT file_path, min(title) AS title, min(category) AS category, count(*) AS chunks FROM ({CHUNKS}) GROUP BY file_path"
LIST_CATEGORIES = f"SELECT category, count(DISTINCT file_path) AS docs FROM ({CHUNKS}) WHERE category IS NOT NULL GROUP BY category"
CATEGORY_TOTALS = f"SELECT category, count(DISTINCT file_path) AS docs, count(*) AS chunks FROM ({CHUNKS}) GROUP BY category"
TOKEN_ESTIMATE = f"SELECT file_path, chunk_index, CAST({_TOKENS.format(t='content')} AS BIGINT) AS tokens FROM ({CHUNKS})"
CONTENT_HASH = f"SELECT file_path, chunk_index, content_hash FROM ({CHUNKS})"
CONTEXT_HEADER = f"SELECT file_path, chunk_index, 'Document: ' || file_path || ' | Section: ' || title || chr(10) || chr(10) AS header FROM ({CHUNKS})"
PENDING = f"""SELECT file_path, chunk_index FROM ({CHUNKS}) WHERE file_path NOT IN (SELECT file_path FROM ({VECTORS}))"""

_RECENT = "accessed_at >= (SELECT max(accessed_at) FROM a) - INTERVAL {days} DAY"


def top_accessed(limit: int = 10, days: int = 30) -> str:
    return f"""WITH a AS ({ACCESS}), c AS ({CHUNKS})
  SELECT n.file_path, access_count, last_accessed, title, category FROM
  (SELECT file_path, count(*) AS access_count, max(accessed_at) AS last_accessed FROM a WHERE {_RECENT.format(days=days)} GROUP BY file_path) n
  LEFT JOIN c ON c.file_path = n.file_path AND c.chunk_index = 0 ORDER BY access_count DESC, n.file_path LIMIT {limit}"""


def savings_total(days: int = 7) -> str:
    return f"""WITH a AS ({ACCESS}) SELECT calls, tokens_returned, tokens_baseline, greatest(0, tokens_baseline - tokens_returned) AS tokens_saved
  FROM (SELECT count(*) AS calls, CAST(coalesce(sum(tokens_returned), 0) AS BIGINT) AS tokens_returned,
  CAST(coalesce(sum(tokens_baseline), 0) AS BIGINT) AS tokens_baseline FROM a WHERE {_RECENT.format(days=days)})"""


def savings_by_tool(days: int = 7) -> str:
    return f"""WITH a AS ({ACCESS}) SELECT tool, count(*) AS calls, CAST(sum(greatest(tokens_baseline - tokens_returned, 0)) AS BIGINT) AS tokens_saved
  FROM a WHERE {_RECENT.format(days=days)} AND tokens_baseline IS NOT NULL AND tokens_returned IS NOT NULL GROUP BY tool"""


def purge(days: int = 14) -> str:
    return f"WITH a AS ({ACCESS}) SELECT file_path, tool, tokens_returned, tokens_baseline, accessed_at FROM a WHERE {_RECENT.format(days=days)}"


def primer(limit: int = 10) -> str:
    return f"""WITH t AS ({top_accessed(limit, 30)}), c AS ({CHUNKS})
  SELECT t.file_path, t.title, t.category, coalesce(CASE WHEN length(content) > 200 THEN left(content, 200) || '...' ELSE content END, '') AS summary,
  access_count FROM t LEFT JOIN c ON c.file_path = t.file_path AND chunk_index = 0"""


def topic_context(k: int = 10) -> str:
    return f"""WITH {_occurrences(CHUNKS, QUERIES, True)}, {_bm25_scored()}, t AS ({top_accessed(10**9, 30)})
  SELECT query_id, rank, c.file_path AS file_path, c.title AS title, c.category AS category,
    CASE WHEN length(content) > 200 THEN left(content, 200) || '...' ELSE content END AS summary, coalesce(access_count, 0) AS access_count
  FROM ({_ranked('scored', k)}) r JOIN c USING (cid) LEFT JOIN t ON t.file_path = c.file_path"""


SEARCH_LOG = f"""WITH {_occurrences(CHUNKS, QUERIES, True)}, {_bm25_scored()},
  base AS (SELECT file_path, CAST(sum({_TOKENS.format(t='content')}) AS BIGINT) AS tokens_baseline FROM c GROUP BY file_path)
  SELECT file_path, query, 'search_docs' AS tool, CAST({_TOKENS.format(t="(CASE WHEN length(content) > 200 THEN left(content, 200) || '...' ELSE content END)")} AS BIGINT) AS tokens_returned,
  tokens_baseline FROM ({_ranked('scored', 5)}) r JOIN c USING (cid) JOIN base USING (file_path) JOIN q USING (query_id)"""

# -- links and graph ----------------------------------------------------------

_NORMAL = r"""regexp_extract(lower({u}), '^https?://[^/?#]*') ||
  CASE WHEN regexp_extract({u}, '^https?://[^/?#]*([^?#]*)', 1, 'i') = '/' THEN '/' ELSE regexp_replace(regexp_extract({u}, '^https?://[^/?#]*([^?#]*)', 1, 'i'), '/+$', '') END
  || regexp_extract({u}, '^[^?#]*(\?[^#]+)', 1)"""
NORMALIZED = f"SELECT page_id, url, {_NORMAL.format(u='url')} AS normalized FROM pages"
_HREFS = r"""SELECT url, trim(unnest(regexp_extract_all(html, '(?i)<a\s[^>]*href=["'']([^"'']+)["'']', 1))) AS href FROM pages"""
PAGE_LINKS = f"""SELECT DISTINCT url, {_NORMAL.format(u="(regexp_extract(url, '^https?://[^/?#]*') || href)")} AS link
  FROM ({_HREFS}) WHERE href LIKE '/%'"""
CO_CHANGE = f"""WITH f AS ({COMMIT_FILES}), s AS (SELECT commit_id FROM f GROUP BY commit_id HAVING count(*) BETWEEN 2 AND 20)
  SELECT DISTINCT 'git-history/' || a.file AS source_path, 'git-history/' || b.file AS target_path, 'git_co_change' AS relation_type
  FROM f a JOIN f b USING (commit_id) JOIN s USING (commit_id) WHERE a.file <> b.file"""
GIT_REFS = f"SELECT DISTINCT 'git-history/' || file AS source_path, file AS target_path, 'git_ref' AS relation_type FROM ({COMMIT_FILES})"
WEB_LINKS = f"SELECT {_NORMAL.format(u='url')} AS source_path, link AS target_path, 'links_to' AS relation_type FROM ({PAGE_LINKS})"
LINKS = f"SELECT * FROM ({CO_CHANGE}) UNION ALL SELECT * FROM ({GIT_REFS}) UNION ALL SELECT DISTINCT * FROM ({WEB_LINKS})"
_ADJACENT = """adj AS (SELECT source_path AS path, target_path AS related_path, relation_type, 'outgoing' AS direction FROM l
  UNION ALL SELECT target_path, source_path, relation_type, 'incoming' FROM l WHERE source_path <> target_path)"""
_HUBS = """h AS (SELECT path, count(*) AS connections FROM (SELECT source_path AS path FROM l UNION ALL SELECT target_path FROM l)
  GROUP BY path ORDER BY connections DESC, path LIMIT {n})"""
HUBS = f"""WITH l AS ({LINKS}), {_HUBS.format(n=10)}, c AS ({CHUNKS})
  SELECT path, connections, title, category FROM h LEFT JOIN c ON c.file_path = path AND chunk_index = 0"""
RELATIONS = f"SELECT relation_type, count(*) AS count FROM ({LINKS}) GROUP BY relation_type"
GRAPH_TOTALS = f"""SELECT (SELECT count(*) FROM ({LINKS})) AS total_edges, (SELECT count(DISTINCT relation_type) FROM ({LINKS})) AS relation_kinds,
  (SELECT count(DISTINCT file_path) FROM ({CHUNKS})) AS total_docs"""
ORPHANS = f"""WITH l AS (SELECT * FROM ({LINKS})), c AS ({CHUNKS}) SELECT file_path AS path, title, category FROM c
  WHERE chunk_index = 0 AND NOT starts_with(file_path, 'git-history/')
  AND file_path NOT IN (SELECT source_path FROM l UNION SELECT target_path FROM l) ORDER BY category, path"""
ONE_HOP = f"""WITH l AS ({WEB_LINKS}), {_ADJACENT}, c AS ({CHUNKS})
  SELECT path, related_path, relation_type, direction, title, category FROM adj
  LEFT JOIN c ON c.file_path = related_path AND chunk_index = 0 WHERE path IN (SELECT source_path FROM l)"""
# Every part and page whose id is divisible by 20.
_STARTS = """h AS (SELECT 'git-history/parts/part-' || p_partkey || '.md' AS path FROM part WHERE p_partkey % 20 = 0
  UNION SELECT normalized FROM ({normalized}) WHERE page_id % 20 = 0)"""
MULTI_HOP = f"""WITH RECURSIVE l AS ({LINKS}), {_ADJACENT}, {_STARTS.format(normalized=NORMALIZED)},
  h1 AS (SELECT start, path, min(struct_pack(walk := walk, direction := direction, relation_type := relation_type)) AS seen FROM
    (SELECT h.path AS start, related_path AS path, [relation_type, related_path] AS walk, direction, relation_type FROM h JOIN adj ON adj.path = h.path)
    WHERE path <> start GROUP BY start, path),
  h2 AS (SELECT start, path, min(struct_pack(walk := walk, direction := direction, relation_type := relation_type)) AS seen FROM
    (SELECT h1.start, related_path AS path, list_concat(seen.walk, [adj.relation_type, related_path]) AS walk, adj.direction, adj.relation_type
     FROM h1 JOIN adj ON adj.path = h1.path) s
    WHERE path <> start AND NOT EXISTS (SELECT 1 FROM h1 v WHERE v.start = s.start AND v.path = s.path) GROUP BY start, path),
  u AS (SELECT *, 1 AS hops FROM h1 UNION ALL SELECT *, 2 FROM h2)
  SELECT start AS path, path AS related_path, seen.relation_type AS relation_type, seen.direction AS direction, hops, position
  FROM (SELECT *, row_number() OVER (PARTITION BY start ORDER BY hops, seen.walk) AS position FROM u)"""
RELATED_TITLES = f"""WITH t AS (SELECT normalized, min(title) AS title, min(category) AS category FROM ({PAGE_CHUNKS})
    JOIN ({NORMALIZED}) ON url = file_path GROUP BY normalized),
  r AS ({MULTI_HOP.replace(LINKS, f"SELECT DISTINCT * FROM ({WEB_LINKS})").replace("SELECT 'git-history/parts/part-' || p_partkey || '.md' AS path FROM part WHERE p_partkey % 20 = 0", "SELECT CAST(NULL AS VARCHAR) AS path WHERE false")})
  SELECT r.path, related_path, relation_type, direction, hops, position, title, category FROM r LEFT JOIN t ON normalized = related_path"""
BY_TYPE = f"""WITH RECURSIVE l AS ({LINKS}), {_ADJACENT}, {_STARTS.format(normalized=NORMALIZED)},
  g(start, path, relation_type, hop) AS (SELECT h.path, related_path, relation_type, 1 FROM h JOIN adj ON adj.path = h.path
    UNION SELECT g.start, adj.related_path, adj.relation_type, hop + 1 FROM g JOIN adj ON adj.path = g.path WHERE hop < 2 AND adj.related_path <> g.start),
  m AS (SELECT start, path, relation_type, min(hop) AS hops FROM g WHERE path <> start GROUP BY ALL)
  SELECT start AS path, path AS related_path, relation_type, hops FROM
  (SELECT *, row_number() OVER (PARTITION BY start ORDER BY hops, path, relation_type) AS n FROM m)"""
RELABELED = f"""SELECT source_path, target_path, CASE WHEN starts_with(source_path, 'git-history/') AND starts_with(target_path, 'git-history/') THEN 'git_co_change'
  WHEN starts_with(source_path, 'git-history/') THEN 'git_ref' ELSE 'relates_to' END AS relation_type FROM ({LINKS})"""

# -- histories ------------------------------------------------------------------

_PICKED = """picked AS (SELECT * FROM (SELECT file, commit_id, hash, date, row_number() OVER (PARTITION BY file ORDER BY date DESC, hash) AS position
  FROM f JOIN m USING (commit_id)))"""
COMMITS_PER_FILE = f"WITH f AS ({COMMIT_FILES}), m AS ({COMMITS}), {_PICKED} SELECT file, hash, date, position FROM picked"
GLOB = rf"""WITH f AS ({COMMIT_FILES}) SELECT DISTINCT file FROM f
  WHERE (regexp_full_match(file, 'parts/part-1.*\.md') OR regexp_full_match(file, '.*7\.md')) AND NOT regexp_full_match(file, '.*0\.md')"""
HISTORIES = f"""WITH f AS ({COMMIT_FILES}), m AS ({COMMITS}), {_PICKED},
  g AS (SELECT commit_id, list(file ORDER BY file) AS files FROM f GROUP BY commit_id),
  s AS (SELECT picked.file, position, list_filter(files, lambda x: x <> picked.file) AS others, m.* FROM picked JOIN m USING (commit_id) JOIN g USING (commit_id)),
  t AS (SELECT file, position, '## ' || left(date, 10) || ': ' || subject || ' (' || left(hash, 7) || ')' || chr(10)
    || 'Author: ' || author || ' <' || author_email || '>' || chr(10) || chr(10) || body || chr(10)
    || CASE WHEN len(others) > 0 THEN 'Also changed: ' || array_to_string(others[1:10], ', ') || chr(10) ELSE '' END
    || CASE WHEN len(others) > 10 THEN '  (+' || (len(others) - 10) || ' more files)' || chr(10) ELSE '' END AS section FROM s)
  SELECT 'git-history/' || file AS file_path, file, count(*) AS commits,
    regexp_replace('# ' || file || ' — Change History' || chr(10) || chr(10) || string_agg(section, chr(10) ORDER BY position), '\\s+$', '') AS content
  FROM t GROUP BY file"""

# -- changes ----------------------------------------------------------------------

# Labelled documents stand for the files on disk; the toxic ones were edited there.
DISK = """SELECT source || '/doc-' || d.doc_id || '.md' AS file_path,
  substr(sha256(CASE WHEN toxic = 1 THEN text || ' edited' ELSE text END), 1, 16) AS content_hash FROM documents d JOIN labels l ON l.doc_id = d.doc_id
  UNION ALL SELECT 'pages/' || page_id || '.md', substr(sha256(html), 1, 16) FROM pages"""
_HEADS = f"SELECT file_path, content_hash FROM ({DOCS})"
DIFF = f"""SELECT coalesce(s.file_path, d.file_path) AS file_path, CASE WHEN s.file_path IS NULL THEN 'new' WHEN d.file_path IS NULL THEN 'deleted'
  WHEN s.content_hash = d.content_hash THEN 'unchanged' ELSE 'modified' END AS status FROM ({_HEADS}) s FULL JOIN ({DISK}) d USING (file_path)"""
PRUNE = f"SELECT DISTINCT file_path FROM ({CHUNKS}) WHERE file_path NOT IN (SELECT file_path FROM ({DISK}))"
_LABELLED = "SELECT source || '/doc-' || d.doc_id || '.md' AS file_path, quality, toxic FROM documents d JOIN labels USING (doc_id)"
REPLACE = f"""WITH e AS (SELECT file_path FROM ({_LABELLED}) WHERE toxic = 1)
  SELECT file_path, chunk_index, content_hash FROM ({CHUNKS}) WHERE file_path NOT IN (SELECT file_path FROM e)
  UNION ALL SELECT file_path, 0, content_hash FROM ({DISK}) WHERE file_path IN (SELECT file_path FROM e)"""
DELETE_CHUNKS = f"SELECT file_path, chunk_index FROM ({CHUNKS}) WHERE file_path NOT IN (SELECT file_path FROM ({_LABELLED}) WHERE quality = 0)"
DELETE_LINKS = f"""WITH p AS (SELECT 'parts/part-' || ps.p_partkey || '.md' AS file_path FROM part ps WHERE p_size > 25)
  SELECT source_path, target_path, relation_type FROM ({LINKS}) WHERE source_path NOT IN (SELECT file_path FROM p) AND target_path NOT IN (SELECT file_path FROM p)"""
UPDATE = f"""SELECT c.file_path, chunk_index, title, CASE WHEN toxic = 1 THEN 'quarantine' ELSE category END AS category,
  CASE WHEN toxic IS NOT NULL THEN 'reviewed' ELSE audience END AS audience FROM ({CHUNKS}) c LEFT JOIN ({_LABELLED}) l ON l.file_path = c.file_path"""
INSERT_LINKS = f"""WITH l AS ({WEB_LINKS}), n AS (SELECT DISTINCT source_path, regexp_replace(source_path, '^https?://', 'archive/') AS target_path, 'links_to' AS relation_type FROM l
    WHERE source_path LIKE 'https://%')
  SELECT source_path, target_path, relation_type FROM l WHERE source_path NOT IN (SELECT source_path FROM n) UNION ALL SELECT * FROM n"""

# -- chunking -----------------------------------------------------------------------


def packed(max_size: int = 2000) -> str:
    """Greedy packing of the lines of every document, each line a paragraph."""
    return f"""WITH RECURSIVE s AS (SELECT doc_id, string_split(text, chr(10)) AS lines, length(text) + len(string_split(text, chr(10))) - 1 AS total FROM documents),
  p AS (SELECT doc_id, total, generate_subscripts(lines, 1) AS i, unnest(lines) AS line, len(lines) AS n FROM s),
  seg AS (SELECT doc_id, total, i, CASE WHEN i < n THEN line || chr(10) || chr(10) ELSE line END AS seg, n FROM p),
  pack(doc_id, i, size, chunk) AS (
    SELECT doc_id, 1::BIGINT, length(seg), 1 FROM seg WHERE i = 1
    UNION ALL SELECT pack.doc_id, seg.i, CASE WHEN total > {max_size} AND size + length(seg) > {max_size} THEN length(seg) ELSE size + length(seg) END,
      CASE WHEN total > {max_size} AND size + length(seg) > {max_size} THEN chunk + 1 ELSE chunk END
    FROM pack JOIN seg ON seg.doc_id = pack.doc_id AND seg.i = pack.i + 1),
  grouped AS (SELECT doc_id, chunk, regexp_replace(regexp_replace(string_agg(seg, '' ORDER BY i), '^\\s+', ''), '\\s+$', '') AS content,
      string_agg(seg, '' ORDER BY i) AS raw, max(total) AS total FROM pack JOIN seg USING (doc_id, i) GROUP BY doc_id, chunk)
  SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY chunk) - 1 AS INTEGER) AS chunk_index,
    CASE WHEN total <= {max_size} THEN raw ELSE content END AS content FROM grouped WHERE content <> ''"""


# Each turn is a second-level section of its conversation's markdown.
HEADING_CHUNKS = """WITH s AS (SELECT conv_id, turn, role || ' ' || turn AS title,
    regexp_replace('## ' || role || ' ' || turn || chr(10) || chr(10) || text, '\\s+$', '') AS section FROM conversations),
  k AS (SELECT * FROM s),
  parts AS (SELECT conv_id, turn, 0 AS part, title, title AS head, CASE WHEN length(section) > 1000 THEN '## ' || title ELSE section END AS content FROM k
    UNION ALL SELECT conv_id, turn, 1, title || ' (cont.)', title, trim(substr(section, length('## ' || title) + 3)) FROM k WHERE length(section) > 1000)
  SELECT 'conversations/conv-' || conv_id || '.md' AS file_path, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn, part) - 1 AS INTEGER) AS chunk_index,
    title, content, 'Conversation ' || conv_id || ' > ' || head AS section_path FROM parts"""

STRUCTURED = r"""WITH a AS (SELECT doc_id, lang, source,
    regexp_replace(regexp_replace(regexp_replace(text, '[#`|~]', '', 'g'), '\n\s*', chr(10), 'g'), '^\s+|\s+$', '', 'g') AS b FROM documents),
  n AS (SELECT *, '### One\n\n' || b AS one, '#### Deep\n\n' || b AS deep, '#### Open\n\n```\n' || replace(b, '\n', '\n\n') AS open FROM
    (SELECT * FROM a)),
  t AS (SELECT *, '### Two\n\n' || deep || '\n\n' || open AS two FROM n),
  w AS (SELECT *, '## Nested\n\ntop ' || doc_id || '\n\n' || one || '\n\n' || two AS nested FROM t),
  p AS (
    SELECT doc_id, 0 AS k, 'Doc ' || doc_id AS title, '# Doc ' || doc_id || '\n\nLead ' || lang AS content, NULL AS head FROM w
    UNION ALL SELECT doc_id, 1, 'Table', '## Table\n\n| a | b |\n| --- | --- |\n| ' || doc_id || ' | ' || source || ' |', 'Table' FROM w
    UNION ALL SELECT doc_id, 2, 'Nested', CASE WHEN length(nested) <= 600 THEN nested ELSE '## Nested\n\ntop ' || doc_id END, 'Nested' FROM w
    UNION ALL SELECT doc_id, 3, 'One', CASE WHEN length(one) <= 600 THEN one ELSE '### One' END, 'One' FROM w WHERE length(nested) > 600
    UNION ALL SELECT doc_id, 4, 'One (cont.)', b, 'One' FROM w WHERE length(nested) > 600 AND length(one) > 600
    UNION ALL SELECT doc_id, 5, 'Two', two, 'Two' FROM w WHERE length(nested) > 600 AND length(two) <= 600
    UNION ALL SELECT doc_id, 6, 'Deep', CASE WHEN length(deep) <= 600 THEN deep ELSE '#### Deep' END, 'Deep' FROM w WHERE length(two) > 600
    UNION ALL SELECT doc_id, 7, 'Deep (cont.)', b, 'Deep' FROM w WHERE length(two) > 600 AND length(deep) > 600
    UNION ALL SELECT doc_id, 8, 'Open', CASE WHEN length(open) <= 600 THEN open ELSE '#### Open' END, 'Open' FROM w WHERE length(two) > 600
    UNION ALL SELECT doc_id, 9, 'Open (cont.)', substr(open, length('#### Open') + 3), 'Open' FROM w WHERE length(two) > 600 AND length(open) > 600)
  SELECT 'd/' || doc_id || '.md' AS file_path, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY k) - 1 AS INTEGER) AS chunk_index, title, content,
    'Doc ' || doc_id || coalesce(' > ' || head, '') AS section_path FROM p""".replace(r"\n\s", "<>").replace(r"\n", "' || chr(10) || '").replace("<>", r"\n\s")

# -- evaluation ---------------------------------------------------------------------

QRELS = "SELECT item_id AS query_id, source || '/doc-' || doc_id || '.md' AS doc FROM benchmark b JOIN documents d ON contains(d.text, b.text)"


def evaluation(k: int = 10) -> str:
    return f"""WITH {_occurrences(DOCS, QUERIES, True)}, {_bm25_scored()}, qrels AS ({QRELS}),
  hits AS (SELECT query_id, rank, file_path AS doc FROM ({_ranked('scored', k)}) r JOIN c USING (cid)),
  judged AS (SELECT query_id, count(*) AS n_relevant FROM qrels GROUP BY query_id),
  found AS (SELECT query_id, count(*) AS n_found, min(rank) AS first_rank, sum(1.0 / log2(rank + 1)) AS dcg FROM hits JOIN qrels USING (query_id, doc) GROUP BY query_id),
  returned AS (SELECT query_id, count(*) AS n_returned FROM hits GROUP BY query_id)
  SELECT query_id, CAST(coalesce(n_found > 0, false) AS DOUBLE) AS hit, round(coalesce(1.0 / first_rank, 0), 6) AS reciprocal_rank,
    round(coalesce(CAST(n_found AS DOUBLE) / n_returned, 0), 6) AS precision, round(coalesce(CAST(n_found AS DOUBLE) / n_relevant, 0), 6) AS recall,
    round(coalesce(dcg / list_sum(list_transform(range(1, least(n_relevant, {k}) + 1), lambda i: 1.0 / log2(i + 1))), 0), 6) AS ndcg
  FROM judged LEFT JOIN found USING (query_id) LEFT JOIN returned USING (query_id)"""


def evaluation_summary(k: int = 10) -> str:
    return f"""SELECT count(*) AS queries, round(avg(hit), 6) AS hit_rate, round(avg(reciprocal_rank), 6) AS mrr, round(avg(precision), 6) AS mean_precision,
  round(avg(recall), 6) AS recall, round(avg(ndcg), 6) AS ndcg FROM ({evaluation(k)})"""


PATH_LOOKUP = f"""WITH q AS (SELECT DISTINCT source || '/' AS query FROM documents UNION ALL SELECT 'conv-' || conv_id || '.md' FROM (SELECT DISTINCT conv_id FROM conversations)),
  c AS ({CHUNKS})
  SELECT query AS query_id, rank, CAST(0.5 AS DOUBLE) AS score, file_path, chunk_index, category FROM
  (SELECT query, file_path, chunk_index, category, row_number() OVER (PARTITION BY query ORDER BY file_path, chunk_index) AS rank
   FROM q JOIN c ON lower(c.file_path) LIKE '%' || lower(query) || '%') WHERE rank <= 5"""


# -- trailing windows, hosts ---------------------------------------------

TRAILING = f"""WITH a AS ({ACCESS}), d AS (SELECT *, unnest(range(1, 8)) AS n FROM a)
  SELECT date_trunc('day', accessed_at) + n * INTERVAL 1 DAY AS as_of, tool, count(*) AS calls,
    CAST(sum(greatest(tokens_baseline - tokens_returned, 0)) AS BIGINT) AS tokens_saved FROM d
  WHERE tokens_baseline IS NOT NULL AND tokens_returned IS NOT NULL GROUP BY ALL"""

PAGE_HOSTS = f"""SELECT {_NORMAL.format(u='url')} AS url, CAST(count(*) AS BIGINT) AS pages, lower(regexp_extract(url, '^https?://([^/?#]*)', 1)) AS host
  FROM pages GROUP BY ALL"""

RERANKED = f"""WITH {_occurrences(CHUNKS, QUERIES, True)}, {_bm25_scored()},
  h AS (SELECT query_id, rank AS found, file_path, chunk_index, score,
    list_distinct(list_filter(string_split_regex(lower(query), '\\s+'), lambda w: w <> '')) AS qs,
    list_distinct(list_filter(string_split_regex(lower(content), '\\s+'), lambda w: w <> '')) AS ps
    FROM ({_ranked('scored', 20)}) r JOIN c USING (cid) JOIN q USING (query_id)),
  l AS (SELECT *, CAST(len(list_intersect(qs, ps)) AS DOUBLE) / len(qs) AS logit FROM h)
  SELECT query_id, rank, file_path, chunk_index, score, round(1.0 / (1.0 + exp(-logit)), 4) AS rerank_score
  FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY logit DESC, found) AS rank FROM l) WHERE rank <= 5"""

RERANKED_DOCUMENTS = f"""WITH {_occurrences(CHUNKS, QUERIES, True)}, {_bm25_scored()},
  first AS (SELECT * FROM (SELECT scored.query_id, scored.cid, score, row_number() OVER (PARTITION BY scored.query_id, file_path ORDER BY score DESC, cid) AS place
    FROM scored JOIN c USING (cid)) WHERE place = 1),
  h AS (SELECT query_id, rank AS found, file_path, chunk_index, score,
    list_distinct(list_filter(string_split_regex(lower(query), '\\s+'), lambda w: w <> '')) AS qs,
    list_distinct(list_filter(string_split_regex(lower(content), '\\s+'), lambda w: w <> '')) AS ps
    FROM ({_ranked('first', 25)}) r JOIN c USING (cid) JOIN q USING (query_id)),
  l AS (SELECT *, CAST(len(list_intersect(qs, ps)) AS DOUBLE) / len(qs) AS logit FROM h)
  SELECT query_id, rank, file_path, chunk_index, score, round(1.0 / (1.0 + exp(-logit)), 4) AS rerank_score
  FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY logit DESC, found) AS rank FROM l) WHERE rank <= 5"""

HISTORY_CHUNKS = HISTORIES.split("SELECT 'git-history/' || file AS file_path")[0] + """SELECT 'git-history/' || file AS file_path,
  CAST(position - 1 AS INTEGER) AS chunk_index, substr(split_part(section, chr(10), 1), 4) AS title,
  regexp_replace(section, '\\s+$', '') AS content, file || ' — Change History > ' || substr(split_part(section, chr(10), 1), 4) AS section_path FROM t"""

CONVERTED = """SELECT 'orders/' || o_orderkey || '.json' AS file_path, '# ' || o_orderkey || '.json' || chr(10) || chr(10) || concat_ws(chr(10) || chr(10),
    '- **o_orderkey**: ' || o_orderkey, '- **o_custkey**: ' || o_custkey, '- **o_orderstatus**: ' || o_orderstatus,
    '- **o_totalprice**: ' || o_totalprice, '- **o_orderdate**: ' || strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S.000'),
    '- **o_orderpriority**: ' || o_orderpriority) AS markdown FROM orders
  UNION ALL SELECT source || '/doc-' || doc_id || '.txt', '# Doc ' || doc_id || chr(10) || chr(10) || text FROM documents
  UNION ALL SELECT 'customers/' || c_custkey || '.csv', '# ' || c_custkey || chr(10) || chr(10) || '| key | name | segment |' || chr(10) || '| --- | --- | --- |'
    || chr(10) || '| ' || c_custkey || ' | ' || c_name || ' |  |' || chr(10) || '| ' || c_custkey || ' |  |  |' FROM customer
  UNION ALL SELECT 'conv/' || conv_id || '.ipynb', string_agg(CASE WHEN role = 'user' THEN 'turn ' || turn || chr(10) || role
    ELSE '```python' || chr(10) || 'turn ' || turn || chr(10) || role || chr(10) || '```' END, chr(10) || chr(10) ORDER BY turn) FROM conversations GROUP BY conv_id"""

PRIVATE = """SELECT page_id, host, host IN ('localhost', 'localhost.localdomain', '') OR host LIKE '%.local' OR host LIKE '%.internal'
  OR regexp_matches(host, '^(10|127|192[.]168|169[.]254|172[.](1[6-9]|2[0-9]|3[01]))[.]') AS private
  FROM (SELECT page_id, lower(regexp_extract(url, '^https?://([^/?#]*)', 1)) AS host FROM pages)"""

# The longest rule decides: a path to .html that is to end there, then the exception, then its base.
_ALLOWED = """CASE WHEN regexp_matches(regexp_extract({u}, '^https?://[^/?#]*([^#]*)', 1), '^/.*\\.html$') THEN false
  WHEN starts_with(regexp_extract({u}, '^https?://[^/?#]*([^#]*)', 1), '/de/1') THEN true
  ELSE NOT starts_with(regexp_extract({u}, '^https?://[^/?#]*([^#]*)', 1), '/de/') END"""
ROBOTS = f"SELECT page_id, url, {_ALLOWED.format(u='url')} AS allowed FROM pages"
DISCOVERED = f"""WITH e AS (SELECT DISTINCT source_path AS a, target_path AS b FROM ({WEB_LINKS}) WHERE {_ALLOWED.format(u='target_path')}),
  l0 AS (SELECT DISTINCT normalized AS url FROM ({NORMALIZED}) WHERE page_id % 20 = 0),
  l1 AS (SELECT DISTINCT b AS url FROM e JOIN l0 ON a = url WHERE b NOT IN (SELECT url FROM l0)),
  l2 AS (SELECT DISTINCT b AS url FROM e JOIN l1 ON a = url WHERE b NOT IN (SELECT url FROM l0 UNION ALL SELECT url FROM l1))
  SELECT url, 0 AS depth FROM l0 UNION ALL SELECT url, 1 FROM l1 UNION ALL SELECT url, 2 FROM l2"""

SITEMAP = f"SELECT url, link AS location FROM ({PAGE_LINKS})"

# -- ingest, the whole search path, reports ---------------------------------------

FRONT_METADATA = """SELECT source || '/doc-' || doc_id || '.md' AS file_path,
  CASE WHEN doc_id % 3 = 0 THEN 'Head ' || doc_id ELSE 'Front ' || doc_id END AS title,
  CASE WHEN doc_id % 2 = 0 THEN lang ELSE source END AS category, 'all' AS audience, lang || '|' || source AS tags FROM documents"""
DOCUMENT_LINKS = """WITH k(n, relation_type) AS (VALUES (1, 'relates_to'), (2, 'extends'), (3, 'tests'), (5, 'content_link'))
  SELECT source || '/doc-' || doc_id || '.md' AS source_path, 'doc-' || (doc_id + n) || '.md' AS target_path, relation_type FROM documents, k
  UNION ALL SELECT source || '/doc-' || doc_id || '.md', 'wiki' || (doc_id % 7), 'content_link' FROM documents"""
SEARCH_WITHIN = f"""WITH {_occurrences(CHUNKS, QUERIES, True)}, {_bm25_scored()},
  part AS (SELECT scored.* FROM scored JOIN c USING (cid) WHERE c.audience IN ('de', 'fr'))
  SELECT {_HIT} FROM ({_ranked('part', 5)}) r JOIN c USING (cid)"""
GIT_LOG = f"""WITH f AS ({COMMIT_FILES}), m AS ({COMMITS}),
  g AS (SELECT commit_id, string_agg(file, '|' ORDER BY file) AS files FROM f GROUP BY commit_id)
  SELECT hash, author, author_email, date, subject, body, coalesce(files, '') AS files FROM m LEFT JOIN g USING (commit_id)"""
SNAPSHOTS = """WITH e AS (SELECT CAST(user_id AS VARCHAR) AS file_path, ts, (SELECT max(ts) FROM events) AS newest FROM events),
  a AS (SELECT file_path, max(ts) AS t FROM e WHERE ts > newest - INTERVAL 3 DAY AND ts <= newest - INTERVAL 1 DAY GROUP BY file_path),
  b AS (SELECT file_path, max(ts) AS t FROM e WHERE ts > newest - INTERVAL 2 DAY AND ts <= newest GROUP BY file_path)
  SELECT coalesce(a.file_path, b.file_path) AS file_path, CASE WHEN b.t IS NULL THEN 'deleted' ELSE 'changed' END AS change
  FROM a FULL JOIN b USING (file_path) WHERE a.t IS DISTINCT FROM b.t"""
LATENCY = """WITH s AS (SELECT round(value, 3) AS ms, row_number() OVER (ORDER BY round(value, 3)) - 1 AS i, count(*) OVER () AS n FROM events WHERE value IS NOT NULL)
  SELECT max(CASE WHEN i = least(CAST(floor(0.5 * n) AS BIGINT), n - 1) THEN ms END) AS p50,
    max(CASE WHEN i = least(CAST(floor(0.95 * n) AS BIGINT), n - 1) THEN ms END) AS p95,
    max(CASE WHEN i = least(CAST(floor(0.99 * n) AS BIGINT), n - 1) THEN ms END) AS p99 FROM s"""
