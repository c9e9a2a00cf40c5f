"""Hard negatives, runs of words and URL rules against plain Python, as operators and as registered queries."""

import hashlib
import math
import random
import re
import zlib
from collections import defaultdict

import brute
import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from windrose.llm import bit_planes, oracles, periodic_runs, queries, redirects

SEED = "/root/testdata/sf0.01"


def ordered(rows):
    return sorted(map(tuple, rows), key=repr)


def sql(folder, name, tables):
    """The query's SQL over a folder of tables."""
    with duckdb.connect() as db:
        for t in tables:
            db.sql(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet/*.parquet'")
        return db.sql(oracles.ORACLES[name]).fetchall()


# hard negatives


def mined(rows, is_anchor, positives=5, negatives=3):
    """rows: (id, vector, label)."""
    good = [(i, [math.floor(256 * float(x)) for x in v], y) for i, v, y in rows if y is not None and v and all(x is not None and math.isfinite(x) and abs(256 * x) < (1 << 20) - 1 for x in v)]
    by = lambda p: (-p[1], p[0] is None, p[0] or 0)
    out = []
    for k, (a, v, label) in enumerate(good):
        if not is_anchor(a):
            continue
        scores = [(i, sum(x * y for x, y in zip(v, w, strict=True)), y) for j, (i, w, y) in enumerate(good) if j != k and len(w) == len(v)]
        for p, s, _ in sorted((x for x in scores if x[2] == label), key=by)[:positives]:
            near = sorted((x for x in scores if x[2] != label and 50 * s <= 100 * x[1] <= 95 * s), key=by)[:negatives]
            out += [(a, p, r + 1, n, s, t) for r, (n, t, _) in enumerate(near)]
    return out


def test_bit_planes(spark, monkeypatch):
    monkeypatch.setattr(bit_planes, "BLOCK_ROWS", 60)
    monkeypatch.setattr(bit_planes, "BLOCK_ANCHORS", 7)
    rng = random.Random(3)
    base = [[rng.gauss(0, 1) for _ in range(6)] for _ in range(5)]
    rows = [(i, [round(x + rng.gauss(0, 0.2), 1) for x in rng.choice(base)], rng.choice(["a", "b", "c", "a", "a"])) for i in range(300)]  # rounded, so that scores tie
    rows += [(400, None, "a"), (450, [1.0] * 6, None), (500, [1.0, None, 1.0, 1.0, 1.0, 1.0], "a"), (550, [math.inf] * 6, "b"), (600, [], "a"), (650, [1e9] * 6, "a"), (700, [0.0] * 6, "a"), (None, base[0], "b"), (None, base[0], "a"), (750, [1.0, 2.0], "a"), (751, [1.0, 2.0], "a"), (752, [0.9, 1.0], "b")]
    rows += rows[:3] * 2  # an anchor that repeats, and copies of its neighbours
    df = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<double>, label string, anchors int")
    got = bit_planes.hard_negatives(df, F.col("vec_id") % 10 == 0)
    want = mined(rows, lambda i: i is not None and i % 10 == 0)
    assert ordered(got.collect()) == ordered(want) and len(want) > 200
    assert bit_planes.hard_negatives(df.limit(0), F.col("vec_id") % 10 == 0).count() == 0
    assert bit_planes.hard_negatives(df, F.lit(False)).count() == 0


def test_scores_drop_none_that_count():
    rng = np.random.default_rng(4)
    for scale in (3, 200, 30000):
        x, y = rng.integers(-scale, scale, (20, 5)), rng.integers(-scale, scale, (200, 5))
        full = x @ y.T
        a, r, s = bit_planes.best(x, y, 4)
        assert (full[a, r] == s).all()
        for k in range(20):
            assert set(np.flatnonzero(full[k] >= np.sort(full[k])[-4])) <= set(r[a == k])
        apart = rng.random((20, 200)) < 0.3
        low, high = np.sort(rng.integers(0, scale * scale, (2, 20, 3)), 0)
        low[0, 0], high[0, 0] = 1, 0
        a, band, r, s = bit_planes.within(x, y, 4, low.astype(float), high.astype(float), apart)
        assert (full[a, r] == s).all() and not apart[a, r].any()
        for k in range(20):
            for b in range(3):
                there = np.flatnonzero(~apart[k] & (full[k] >= low[k, b]) & (full[k] <= high[k, b]))
                first = there[np.argsort(-full[k][there], kind="stable")][:4]
                assert set(first) <= set(r[(a == k) & (band == b)])


def test_op11(spark, tmp_path):
    e = spark.read.parquet(f"{SEED}/embeddings.parquet")
    extra = [(9100, None, 1), (9150, [float("nan")] * 64, 1), (9200, [0.5] * 64, None)]
    e.unionByName(spark.createDataFrame(extra, e.schema)).write.parquet(f"{tmp_path}/embeddings.parquet")
    rows = [(r["vec_id"], r["embedding"], r["label"]) for r in spark.read.parquet(f"{tmp_path}/embeddings.parquet").collect()]
    rows = [(i, v, y if y is None or i % 7 else (y + 1) % 10) for i, v, y in rows]
    want = mined(rows, lambda i: i % 50 == 0)
    assert ordered(queries.op11_bit_planes(spark, str(tmp_path)).collect()) == ordered(want) == ordered(sql(tmp_path, "op11_bit_planes", ["embeddings"])) and len(want) > 50


# runs


def slow_runs(w, least=12):
    n, out = len(w), []
    for p in range(1, n // 2 + 1):
        i = 0
        while i + p < n:
            j = i
            while j + p < n and w[j] == w[j + p]:
                j += 1
            size = j - i + p
            if size >= max(least, 2 * p) and not any(all(w[i + x] == w[i + x + q] for x in range(size - q)) for q in range(1, p)):
                out.append((i, size, p))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def kept_words(w, found):
    gone = {x for s, n, p in found for x in range(s + p, s + n)}
    return [x for k, x in enumerate(w) if k not in gone]


def test_runs():
    rng = random.Random(5)
    for _ in range(400):
        docs = []
        for _ in range(rng.randint(1, 5)):
            n, k = rng.choice([0, 1, 2, 5, 13, 30, 60]), rng.choice([1, 2, 3, 8])
            w = [rng.randrange(k) for _ in range(n)]
            if rng.random() < 0.4 and n > 4:
                a = rng.randrange(n)
                p = rng.randint(1, max(1, (n - a) // 2))
                w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
            docs.append(w)
        least = rng.choice([2, 4, 12])
        got = list(zip(*[x.tolist() for x in periodic_runs.runs([np.array(d, np.int64) for d in docs], least)], strict=True))
        assert got == [(k, *r) for k, d in enumerate(docs) for r in slow_runs(d, least)]


def test_next_smaller(monkeypatch):
    monkeypatch.setattr(periodic_runs, "HOPS", 1)
    rng = np.random.default_rng(1)
    for values in (np.append(rng.permutation(200) + 1, 0), np.array([1, *range(100, 1, -1), 0]), np.array([5, 0])):
        places = np.arange(len(values) - 1)
        assert periodic_runs.next_smaller(values, places).tolist() == [next(j for j in range(i + 1, len(values)) if values[j] < values[i]) for i in places]


def test_repeats(spark):
    texts = ["", None, " \n", "a " * 40, "x a b c\ta b c a\nb c a b c a b é", "É é " * 9, "word", "a b " * 30000, "lone " + " ".join(map(str, range(3000))) * 2]
    df = spark.createDataFrame([(k if k != 3 else None, t, 0, "clash") for k, t in enumerate(texts)] + [(0, "", 0, ""), (0, "", 0, "")], "doc_id long, text string, runs int, collapsed string")
    got = {r["doc_id"]: r for r in periodic_runs.repeats(df).collect()}
    assert periodic_runs.repeats(df).count() == len(texts) + 2 and periodic_runs.repeats(df.limit(0)).count() == 0
    for k, t in enumerate(texts):
        r = got[k if k != 3 else None]
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        found = slow_runs(w) if len(w) < 10000 else [(0, 60000, 2)]
        assert (r["n_words"], [tuple(x) for x in r["runs"]], r["collapsed"]) == (len(w), found, " ".join(kept_words(w, found)))
    assert got[4]["collapsed"] == "x a b c é" and got[7]["collapsed"] == "a b"


def test_op12(spark, tmp_path):
    docs = spark.read.parquet(f"{SEED}/documents.parquet").where("length(text) < 3000").limit(300)
    extra = spark.createDataFrame([(None, "a b " * 20, "en", "s", 80), (700001, None, "en", "s", None), (700002, "", "en", "s", 0), (700003, "q w e " * 9, None, None, 54), (700003, "q w e " * 9, None, None, 54)], docs.schema)
    docs.unionByName(extra).write.parquet(f"{tmp_path}/documents.parquet")
    want = []
    for r in spark.read.parquet(f"{tmp_path}/documents.parquet").collect():
        w = re.findall(r"[^\x20\x09-\x0D]+", r["text"] or "")
        n, h = len(w), zlib.crc32(str(r["doc_id"]).encode()) if r["doc_id"] is not None else 1
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
        found = slow_runs(w)
        start, size, period = min(found, key=lambda x: (-x[1], x[0], x[2]), default=(None,) * 3)
        sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
        want.append((r["doc_id"], len(found), start, size, period, None if not found else 1000 * size // period, sha("".join(f"{s},{x},{q}\n" for s, x, q in found)), sha(" ".join(kept_words(w, found)))))
    got = queries.op12_periodic_runs(spark, str(tmp_path))
    assert [t for _, t in got.dtypes] == ["bigint"] * 6 + ["string"] * 2
    assert ordered(got.collect()) == ordered(want) and sum(x[1] > 0 for x in want) > 20


# URLs


def place(url):
    m = re.match(r"(?s)^.*?://([^/?#]*)([^?#]*)", url or "")
    return (re.sub("[A-Z]", lambda c: c[0].lower(), m[1]), m[2]) if m else ("", "")


def fit(url, rules):
    host, path = place(url)
    there = [r for r in rules for own, slash, below in [r[1].partition("/")] if (host == own or host.endswith("." + own)) and path.startswith(slash + below)]
    return min(there, key=lambda r: (-len(r[1]), r[0] != "allow", r[1]), default=None)


def node(url):
    m = re.match(r"(?s)^(.*?)://([^/?#]*)([^?#]*)(\??[^#]*)", url or "")
    return f"{m[1].lower()}://{m[2].lower()}{m[3] or '/'}{m[4]}" if m else None


def verdicts(pages, rules, links):
    """pages: (id, url); links: pairs of nodes."""
    roots = brute.components({x for e in links for x in e}, [tuple(sorted(e)) for e in links])
    said = defaultdict(set)
    for n, root in roots.items():
        if f := fit(n, rules):
            said[root].add(f[0])
    out = []
    for i, url in pages:
        f = fit(url, rules)
        passed = said.get(roots.get(node(url)), set()) == {"block"}
        out.append((i, *place(url), f and f[1], f[0] if f else "block" if passed else "allow"))
    return out


LINKED = [
    ("http://A.example.net/de/1?x=1#frag", '<LINK href="http://www.example.com/de/9" rel="nofollow Canonical">', "http://www.example.com/de/9"),  # blocked by its target
    ("http://b.example.net/en/2", "<meta http-equiv=refresh content='0; URL=http://a.example.net/de/1?x=1'>", "http://a.example.net/de/1?x=1"),  # and by an alias of it
    ("http://c.example.net/en/3", "<link rel=canonical href=//b.example.net/en/2>", "http://b.example.net/en/2"),
    ("http://d.example.net/x/y", '<link rel="canonical" href="z?a=1&amp;b=2">', "http://d.example.net/x/z?a=1&b=2"),
    ("http://e.example.net", "<link rel='canonical' href='/only'>", "http://e.example.net/only"),
    ("http://f.example.net/q", '<link rel="canonical" href="http://example.com/de/7"><link rel="canonical" href="http://example.com/fr/7">', "http://example.com/de/7"),  # an allow among its aliases
    ("http://g.example.net/q", '<!-- <link rel="canonical" href="http://example.com/de/8"> --><script>"<link rel=canonical href=http://example.com/de/8>"</script>', None),
    ("http://h.example.net/q", '<link rel="canonical" href="mailto:x@y"><link rel="canonical" href=""><link rel="alternate" href="http://example.com/de/8">', None),
    ("no url", '<link rel="canonical" href="http://example.com/de/8">', None),
    (None, '<link rel="canonical" href="http://example.com/de/8">', None),
    ("http://example.com/fr/ruled", '<link rel="canonical" href="http://example.com/de/10">', "http://example.com/de/10"),  # its own rule goes first
]


@pytest.fixture(scope="module")
def pages(spark, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("pages"))
    there = spark.read.parquet(f"{SEED}/pages.parquet")
    more = [(8000 + k, u, h) for k, (u, h, _) in enumerate(LINKED)] + [(None, "http://A.example.net/de/1?x=1", None), (8000, "HTTP://a.EXAMPLE.net/de/1?x=1", ""), (8100, "http://x.org", "refresh"), (8101, "http://x.org/", ""), (8102, "http://example.org/ES/", ""), (8103, "://example.org/es/1", "")]
    there.unionByName(spark.createDataFrame(more, there.schema)).write.parquet(f"{root}/pages.parquet")
    return root


def test_op13(spark, pages):
    rows = [tuple(r) for r in spark.read.parquet(f"{pages}/pages.parquet").select("page_id", "url").collect()]
    links = {(node(u), node(to)) for u, _, to in LINKED if to} | {(node("http://f.example.net/q"), node("http://example.com/fr/7"))}
    want = verdicts(rows, queries.URL_RULES, links)
    got = queries.op13_redirects(spark, pages).collect()
    assert ordered(got) == ordered(want) == ordered(sql(pages, "op13_redirects", ["pages"]))
    said = {r["page_id"]: (r["rule"], r["verdict"]) for r in got}
    assert [said[8000 + k] for k in (1, 2, 3, 5, 10)] == [(None, "block"), (None, "block"), (None, "allow"), (None, "allow"), ("com/fr/", "allow")]


def test_links_and_rules(spark, pages):
    got = redirects.links_of(spark.read.parquet(f"{pages}/pages.parquet"))
    assert {tuple(r) for r in got.collect()} == {(node(u), node(to)) for u, _, to in LINKED if to} | {(node("http://f.example.net/q"), node("http://example.com/fr/7"))}
    df = spark.createDataFrame([(k, f"http://{h}/{p}") for k, (h, p) in enumerate((h, p) for h in ("a.b.c", "b.c", "c", "xb.c", "") for p in ("", "q/1", "q/2"))], "page_id long, url string")
    rules = [("block", "b.c/"), ("allow", "a.b.c/q/"), ("block", "c/q/1"), ("allow", "c/q/1"), ("block", "c/q/")]
    want = [(r["page_id"], *place(r["url"]), f and f[1], f[0] if f else "allow") for r in df.collect() for f in [fit(r["url"], rules)]]
    none = spark.createDataFrame([], "a string, b string")
    table = spark.createDataFrame([*rules, (None, "x"), ("block", None)], "verdict string, rule string")
    for given in (rules, table):
        assert ordered(redirects.judged(df, given, none).select("page_id", "host", "path", "rule", "verdict").collect()) == ordered(want)
    assert redirects.judged(df.limit(0), rules, none).count() == 0 and redirects.judged(df, [], none).where("verdict <> 'allow'").count() == 0


def test_equivalent(spark):
    """Long paths, a hub with most of the edges, cycles, repeats and nulls."""
    rng = random.Random(8)
    edges = [(f"p{i:04}", f"p{i + 1:04}") for i in range(300)] + [("hub", f"h{i}") for i in range(2000)] + [("z1", "z2"), ("z2", "z3"), ("z3", "z1"), ("z1", "z1"), (None, "z1"), ("q", None)] * 2
    rng.shuffle(edges)
    nodes, _ = redirects.equivalent(spark.createDataFrame(edges, "a string, b string").repartition(4))
    got = {r["node"]: r["root"] for r in nodes.collect()}
    good = [e for e in edges if None not in e and e[0] != e[1]]
    assert got == brute.components({x for e in good for x in e}, good) and nodes.count() == len(got)
