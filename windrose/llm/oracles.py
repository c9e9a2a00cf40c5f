"""DuckDB SQL for the queries that SQL can express."""

import re

from .chat_tree import CONTROL, END, SEPARATOR, START
from .queries import URL_RULES

_ASCII_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP4 = rf"""
WITH dw AS (SELECT doc_id, regexp_extract_all({_ASCII_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w FROM documents),
iw AS (SELECT item_id, regexp_extract_all({_ASCII_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w FROM benchmark),
win AS (SELECT DISTINCT item_id, least(len(w), 13) n, list_slice(w, i, i + least(len(w), 13) - 1) g
  FROM (SELECT item_id, w, unnest(range(1, len(w) - least(len(w), 13) + 2)) i FROM iw WHERE len(w) > 0)),
lens AS (SELECT DISTINCT n FROM win),
dg AS (SELECT doc_id, n, i, list_slice(w, i, i + n - 1) g
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) i FROM dw, lens WHERE len(w) >= n)),
met AS (SELECT dg.doc_id, dg.i, dg.n, win.item_id FROM dg JOIN win ON dg.n = win.n AND dg.g = win.g),
hit AS (SELECT doc_id, count(DISTINCT j) n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) j FROM met) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) n_items, string_agg(item, ',' ORDER BY item) l
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) item FROM met) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) n_words, CAST(coalesce(n_hit, 0) AS BIGINT) n_hit, CAST(coalesce(n_items, 0) AS BIGINT) n_items,
  sha256(coalesce(l, '')) items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) contaminated
FROM dw LEFT JOIN hit USING (doc_id) LEFT JOIN items USING (doc_id)"""

OP6 = """
WITH p AS (SELECT page_id, coalesce(html, '') h, octet_length(encode(coalesce(html, ''))) n FROM pages),
last AS (SELECT h, max(page_id) top FROM p GROUP BY h),
hexed AS (SELECT page_id, CAST(n AS BIGINT) n, top, sha1(p.h) s FROM p JOIN last ON p.h = last.h),
bits AS (SELECT page_id, string_agg(lpad(bin(CAST(strpos('0123456789abcdef', substr(s, CAST(i AS INT), 1)) - 1 AS INT)), 4, '0'), '' ORDER BY i) b
  FROM (SELECT page_id, s, unnest(range(1, 41)) i FROM hexed) GROUP BY page_id),
digest AS (SELECT page_id, string_agg(substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((
    16 * (ascii(substr(b, k * 5 + 1, 1)) - 48) + 8 * (ascii(substr(b, k * 5 + 2, 1)) - 48) + 4 * (ascii(substr(b, k * 5 + 3, 1)) - 48)
    + 2 * (ascii(substr(b, k * 5 + 4, 1)) - 48) + (ascii(substr(b, k * 5 + 5, 1)) - 48)) + 1 AS INT), 1), '' ORDER BY k) d
  FROM (SELECT page_id, b, CAST(unnest(range(0, 32)) AS INT) k FROM bits) GROUP BY page_id)
SELECT page_id, n payload_bytes, d payload_digest, CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END record_type,
  CASE WHEN page_id = top THEN NULL ELSE top END refers_to
FROM hexed JOIN digest USING (page_id)"""

OP9 = """
WITH n AS (SELECT source, count(*) n FROM documents GROUP BY source),
r AS (SELECT source, (SELECT sum(n) FROM n) * 1.0 / (SELECT count(*) FROM n) / n rate FROM n),
p AS (SELECT source, CAST(greatest(1, ceil(rate / 16)) AS INT) parts, rate / greatest(1, ceil(rate / 16)) l FROM r),
pmf AS (SELECT source, parts, k, exp(-l + k * ln(l) - CASE WHEN k > 0 THEN lgamma(k + 1) ELSE 0 END) q FROM (SELECT *, unnest(range(0, 89)) k FROM p)),
cdf AS (SELECT source, parts, k, sum(q) OVER (PARTITION BY source ORDER BY k) c FROM pmf),
u AS (SELECT d.doc_id, d.source, j, (CAST('0x' || substr(md5('17|#' || doc_id || '|' || md5(coalesce(text, '')) || '|' || j), 1, 13) AS BIGINT) + 0.5::DOUBLE) / 4503599627370496::DOUBLE u
  FROM (SELECT doc_id, source, text, unnest(range(1, parts + 1)) j FROM documents JOIN p USING (source)) d),
m AS (SELECT doc_id, CAST(sum(x) AS BIGINT) n_copies FROM (SELECT u.doc_id, u.j, count(*) FILTER (WHERE c < u.u) x FROM u JOIN cdf USING (source) GROUP BY u.doc_id, u.j) GROUP BY doc_id)
SELECT doc_id, text, lang, source, n_chars, n_copies, copy, md5('17|place|#' || doc_id || '|' || md5(coalesce(text, '')) || '|' || copy) place
FROM (SELECT d.*, n_copies, CAST(unnest(range(1, n_copies + 1)) AS BIGINT) copy FROM documents d JOIN m USING (doc_id) WHERE n_copies > 0)"""

# backslashes doubled, and one behind the first character of a control string
_MARKS = "|".join(re.escape(c[1:]).replace("/", r"\/").replace("<", r"\<").replace(">", r"\>") for c in CONTROL)
_ESCAPED = rf"regexp_replace(replace({{}}, '\', '\\'), '([<\[])({_MARKS})', '\1\\\2', 'g')"

OP3 = f"""
WITH c AS (SELECT conv_id, turn, role, coalesce(text, '') t FROM conversations
  UNION ALL SELECT -1, i, r, '</s>[INST] ok [/INST]' FROM (VALUES (0, 'user'), (1, 'assistant')) x(i, r))
SELECT conv_id, count(*) n_turns, sha256(string_agg(role || chr(10) || t || chr(10), '' ORDER BY turn NULLS FIRST, role, t)) turns_sha256,
  CAST(coalesce(sum(length(t)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) loss_chars,
  sha256(coalesce(string_agg(t, '' ORDER BY turn NULLS FIRST, role, t) FILTER (WHERE role = 'assistant'), '')) loss_sha256,
  CAST(sum({len(START + SEPARATOR + END)} + length({_ESCAPED.format("role")}) + length({_ESCAPED.format("t")})) AS BIGINT) formatted_chars
FROM c GROUP BY conv_id"""

# least id reachable over links a, b
_REACHED = """e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l), r AS (SELECT a i, a x FROM e UNION SELECT r.i, e.b FROM r JOIN e ON e.a = r.x),
root AS (SELECT i, min(x) root FROM r GROUP BY i)"""

OP10 = rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({_ASCII_LOWER}, '[^\x20\x09-\x0D]+') w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(list_slice(w, i, i + 3), ' ') g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) n FROM s GROUP BY doc_id),
p AS (SELECT x.doc_id a, y.doc_id b, count(*) c FROM s x JOIN s y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)), {_REACHED}
SELECT d.doc_id, CAST(coalesce(n, 0) AS BIGINT) n_shingles, coalesce(root, d.doc_id) component_id
FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN root ON root.i = d.doc_id"""

OP7 = f"""
WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) e FROM embeddings WHERE len(embedding) > 0
  AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS (SELECT x.vec_id a, y.vec_id b FROM v x JOIN v y ON x.vec_id < y.vec_id AND len(x.e) = len(y.e) AND list_cosine_similarity(x.e, y.e) >= 0.9), {_REACHED},
k AS (SELECT a i, count(*) n FROM e GROUP BY a)
SELECT vec_id, coalesce(n, 0) n_links, coalesce(root, vec_id) component_id, coalesce(root, vec_id) = vec_id kept
FROM embeddings LEFT JOIN k ON k.i = vec_id LEFT JOIN root ON root.i = vec_id"""

OP11 = """
WITH v AS (SELECT vec_id id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END l, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) e
  FROM embeddings WHERE label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.id a, b.id b, a.l = b.l same, CAST(list_inner_product(a.e, b.e) AS BIGINT) s FROM v a JOIN v b ON a.id % 50 = 0 AND a.id <> b.id AND len(a.e) = len(b.e)),
p AS (SELECT * FROM (SELECT a, b, s, row_number() OVER (PARTITION BY a ORDER BY s DESC, b) r FROM s WHERE same) WHERE r <= 5),
n AS (SELECT p.a, p.b, p.s ps, s.b n, s.s ns, row_number() OVER (PARTITION BY p.a, p.b ORDER BY s.s DESC, s.b) r
  FROM p JOIN s ON s.a = p.a AND NOT s.same AND 50 * p.s <= 100 * s.s AND 100 * s.s <= 95 * p.s)
SELECT a anchor_id, b positive_id, CAST(r AS INT) rank, n negative_id, ps positive_score, ns negative_score FROM n WHERE r <= 3"""


def _url_part(url: str, i: int) -> str:
    got = rf"coalesce(regexp_extract({url}, '(?s)^(.*?)://([^/?#]*)([^?#]*)(\??[^#]*)', {i}), '')"
    return f"translate({got}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')" if i < 3 else got


def _node(url: str) -> str:
    one, two, three, four = (_url_part(url, i) for i in (1, 2, 3, 4))
    return f"CASE WHEN contains({url}, '://') THEN {one} || '://' || {two} || CASE WHEN {three} = '' THEN '/' ELSE {three} END || {four} END"


def _attribute(name: str) -> str:
    return "(" + " || ".join(rf"""regexp_extract(tag, '(?is)[\s"''/]{name}\s*=\s*(?:"([^"]*)"|''([^'']*)''|([^\s"''>]+))', {i})""" for i in (1, 2, 3)) + ")"


def _fits(table: str) -> str:
    """The longest rule of each row (k, host, path) of a table."""
    return f"""SELECT k, rule, verdict FROM (SELECT k, rule, verdict, row_number() OVER (PARTITION BY k ORDER BY length(rule) DESC, verdict, rule) i FROM {table}
  JOIN rules ON (host = split_part(rule, '/', 1) OR ends_with(host, '.' || split_part(rule, '/', 1))) AND starts_with(path, substr(rule, length(split_part(rule, '/', 1)) + 1))) WHERE i = 1"""


OP13 = rf"""
WITH RECURSIVE rules(verdict, rule) AS (VALUES {", ".join(map(str, URL_RULES))}),
tags AS (SELECT url u, unnest(regexp_extract_all(regexp_replace(html, '(?is)<!--.*?(?:-->|$)|<script\b.*?(?:</script\s*>|$)', ' ', 'g'), '(?is)<(?:link|meta)\b[^>]*>')) tag
  FROM pages WHERE contains(url, '://') AND regexp_matches(html, '(?i)canonical|refresh')),
refs AS (SELECT u, trim(replace(CASE WHEN regexp_matches(tag, '(?i)^<link') AND regexp_matches(lower({_attribute("rel")}), '(^|\s)canonical(\s|$)') THEN {_attribute("href")}
  WHEN regexp_matches(tag, '(?i)^<meta') AND lower(trim({_attribute("http-equiv")})) = 'refresh'
  THEN regexp_extract({_attribute("content")}, '(?is)^\s*[0-9.]*\s*[;,]?\s*url\s*=\s*["'']?(.*?)["'']?\s*$', 1) END, '&amp;', '&')) t FROM tags),
whole AS (SELECT u, CASE WHEN t = '' THEN NULL WHEN regexp_matches(t, '^[A-Za-z][A-Za-z0-9+.-]*://') THEN t WHEN regexp_matches(t, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN NULL
  WHEN starts_with(t, '//') THEN {_url_part("u", 1)} || ':' || t WHEN starts_with(t, '/') THEN {_url_part("u", 1)} || '://' || {_url_part("u", 2)} || t
  WHEN starts_with(t, '?') THEN {_url_part("u", 1)} || '://' || {_url_part("u", 2)} || {_url_part("u", 3)} || t WHEN starts_with(t, '#') THEN u
  ELSE {_url_part("u", 1)} || '://' || {_url_part("u", 2)} || CASE WHEN contains({_url_part("u", 3)}, '/') THEN regexp_extract({_url_part("u", 3)}, '(?s)^(.*/)', 1) ELSE '/' END || t END t FROM refs),
l AS (SELECT DISTINCT {_node("u")} a, {_node("t")} b FROM whole WHERE t IS NOT NULL), {_REACHED},
place AS (SELECT i k, {_url_part("i", 2)} host, {_url_part("i", 3)} path FROM root),
fit AS ({_fits("place")}),
bad AS (SELECT root FROM root LEFT JOIN fit ON k = i GROUP BY root HAVING bool_or(coalesce(verdict = 'block', false)) AND NOT bool_or(coalesce(verdict = 'allow', false))),
tainted AS (SELECT i node FROM root JOIN bad USING (root)),
page AS (SELECT row_number() OVER () k, page_id, {_url_part("url", 2)} host, {_url_part("url", 3)} path, {_node("url")} node FROM pages),
own AS ({_fits("page")})
SELECT page_id, host, path, rule, coalesce(verdict, CASE WHEN node IN (SELECT node FROM tainted) THEN 'block' END, 'allow') verdict
FROM page LEFT JOIN own USING (k)"""

ORACLES = {"op3_chat_tree": OP3, "op7_sorted_projection": OP7, "op10_parity_join": OP10, "op4_winnowing": OP4, "op6_warc_zstd": OP6, "op9_poisson_mix": OP9, "op11_bit_planes": OP11, "op13_redirects": OP13}
