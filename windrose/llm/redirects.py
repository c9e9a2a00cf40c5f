"""URL filters over redirect equivalence (operator 13).

Rules allow or block a host with its subdomains below a path; of those that fit a URL the longest decides. URLs that no
rule fits follow what they are aliases of: redirects and canonical links are edges between URLs, and a block of any URL
of a connected component reaches all its members that no rule fits, unless a rule allows one of them (an explicit allow
goes before a block that has only been passed on). Components are found by alternating large-star and small-star joins,
each round written to the shared folder. Only DataFrame operations are used.

A node is a URL with its scheme and host in lower case, ``/`` for an empty path and without its fragment, as whole text:
nothing is told apart by a hash alone. A node with many edges is never gathered: its least neighbour is added up where
the edges are and joined back.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

ALLOW, BLOCK = "allow", "block"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_PARTS = r"(?s)^(.*?)://([^/?#]*)([^?#]*)(\??[^#]*)"
#: A tag's attribute with its value in double, single or no quotes.
_VALUE = r"""(?is)[\s"'/]{0}\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))"""


def host_of(url: Column) -> Column:
    """What stands behind the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in lower case; else empty."""
    return F.translate(F.coalesce(F.regexp_extract(url, _PARTS, 2), F.lit("")), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    """What follows the host, up to ``?``, ``#`` or the end; empty without ``://``."""
    return F.coalesce(F.regexp_extract(url, _PARTS, 3), F.lit(""))


def node_of(url: Column) -> Column:
    """The URL as a node; null without ``://``."""
    part = lambda i: F.regexp_extract(url, _PARTS, i)
    path = F.when(part(3) == "", "/").otherwise(part(3))
    whole = F.concat(F.translate(part(1), _UPPER, _LOWER), F.lit("://"), F.translate(part(2), _UPPER, _LOWER), path, part(4))
    return F.when(url.contains("://"), whole)


def fitting(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """Struct of rule and verdict of the longest rule that fits, null without one; of equally long ones an allow goes first.

    A rule is (verdict, host and path), as ("block", "example.org/es/"). A list of rules is part of the plan; for block
    lists too long for that pass a table to judged().
    """
    out = None
    for verdict, rule in sorted(set(rules), key=lambda r: (-len(r[1]), r[0] != ALLOW, r[1])):
        own, slash, below = rule.partition("/")
        fits = ((host == own) | host.endswith("." + own)) & path.startswith(slash + below)
        found = F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))
        out = F.when(fits, found) if out is None else out.when(fits, found)
    return F.lit(None).cast("struct<rule:string,verdict:string>") if out is None else out


def _fitted(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """(host, path, fit) of the distinct (host, path) that a rule of a table (verdict, rule) fits: each suffix of the host
    is looked up among the rules' hosts."""
    known = rules.where("verdict IS NOT NULL AND rule IS NOT NULL").select(
        F.substring_index("rule", "/", 1).alias("own"), F.expr("substring(rule, length(substring_index(rule, '/', 1)) + 1)").alias("below"), "rule", "verdict"
    )
    known, _ = common.saved(known.distinct(), "url-rules")
    size = known.agg(F.sum(F.octet_length("rule") * 2 + 64)).first()[0] or 0
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    wide = urls.select("host", "path").distinct().withColumn("own", F.explode(suffixes))
    met = wide.join(common.maybe_broadcast(known, size, 1), "own").where(F.col("path").startswith(F.col("below")))
    rank = F.struct((-F.length("rule")).alias("n"), (F.col("verdict") != ALLOW).alias("forbids"), F.col("rule"), F.col("verdict"))
    return met.groupBy("host", "path").agg(F.min(rank).alias("x")).select("host", "path", F.struct("x.rule", "x.verdict").alias("fit"))


def _attribute(tag: Column, name: str) -> Column:
    value = lambda i: F.regexp_extract(tag, _VALUE.replace("{0}", name), i)
    return F.concat(value(1), value(2), value(3))


def _resolved(base: Column, to: Column) -> Column:
    """A reference as a URL: absolute, or relative to the scheme, host or folder of ``base``."""
    scheme, host, path = (F.regexp_extract(base, _PARTS, i) for i in (1, 2, 3))
    root = F.concat(scheme, F.lit("://"), host)
    folder = F.when(path.contains("/"), F.regexp_extract(path, "(?s)^(.*/)", 1)).otherwise("/")
    return (
        F.when(to == "", None)
        .when(to.rlike("^[A-Za-z][A-Za-z0-9+.-]*://"), to)
        .when(to.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), None)
        .when(~base.contains("://"), None)
        .when(to.startswith("//"), F.concat(scheme, F.lit(":"), to))
        .when(to.startswith("/"), F.concat(root, to))
        .when(to.startswith("?"), F.concat(root, path, to))
        .when(to.startswith("#"), base)
        .otherwise(F.concat(root, folder, to))
    )


def links_of(pages: DataFrame, *, url: str = "url", html: str = "html") -> DataFrame:
    """Edges (a, b) between nodes: of each page its canonical links and the targets of its refreshing meta tags.

    Tags in comments and scripts don't count. References that are no URL (mailto:, empty ones) give no edge, nor do
    pages without a URL.
    """
    u = F.col("u")
    page = pages.select(F.col(url).alias("u"), F.col(html).alias("h")).where(F.col("u").contains("://") & F.col("h").rlike("(?i)canonical|refresh"))
    plain = F.regexp_replace("h", r"(?is)<!--.*?(?:-->|$)|<script\b.*?(?:</script\s*>|$)", " ")

    def target(tag: Column) -> Column:
        canonical = tag.rlike("(?i)^<link") & F.lower(_attribute(tag, "rel")).rlike(r"(^|\s)canonical(\s|$)")
        refresh = tag.rlike("(?i)^<meta") & (F.lower(F.trim(_attribute(tag, "http-equiv"))) == "refresh")
        content = F.regexp_extract(_attribute(tag, "content"), r"(?is)^\s*[0-9.]*\s*[;,]?\s*url\s*=\s*[\"']?(.*?)[\"']?\s*$", 1)
        return F.when(canonical, _attribute(tag, "href")).when(refresh, content)

    # within functions of arrays each value is computed once, and no filter is moved below what it tests
    tags = F.regexp_extract_all(plain, F.lit(r"(?is)<(?:link|meta)\b[^>]*>"), F.lit(0))
    ends = lambda to: F.struct(node_of(u).alias("a"), node_of(to).alias("b"))
    steps = F.transform(tags, lambda tag: common.let(F.trim(F.replace(target(tag), F.lit("&amp;"), F.lit("&"))), lambda to: common.let(_resolved(u, to), ends)))
    return page.select(F.explode(F.filter(steps, lambda e: e["b"].isNotNull())).alias("e")).select("e.a", "e.b")


def _round(now: DataFrame) -> DataFrame:
    """Large-star, then small-star; moved says whether a row's nodes have found lesser ones."""
    end = lambda u, v: F.struct(F.col(u).alias("u"), F.col(v).alias("v"))
    both = now.select(F.explode(F.array(end("a", "b"), end("b", "a"))).alias("x")).select("x.u", "x.v")
    least = both.groupBy("u").agg(F.min("v").alias("first"))
    near = both.join(least, "u").select("u", "v", F.least("u", "first").alias("m")).where("v > u")
    large = near.groupBy(F.col("v").alias("a"), F.col("m").alias("b")).agg(F.max(F.col("m") != F.col("u")).alias("moved"))
    own = large.groupBy("a").agg(F.min("b").alias("m"), F.max("moved").alias("moved"))
    parents = large.select("a", "b").join(own.select("a", "m"), "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"), F.lit(True).alias("moved"))
    return own.select("a", F.col("m").alias("b"), "moved").unionByName(parents).groupBy("a", "b").agg(F.max("moved").alias("moved"))


def equivalent(links: DataFrame) -> tuple[DataFrame, str]:
    """(node, root) for every node of ``links`` (a, b strings): root is the least node reachable; and the path to remove().

    Links may repeat or point at themselves; null ends link nothing. An empty table gives an empty one.
    """
    spark = links.sparkSession
    once = links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct().withColumn("moved", F.lit(True))
    now, path = common.saved(once, "url-links")
    while now.agg(F.max(F.col("moved").cast("int"))).first()[0]:
        following, new = common.saved(_round(now), "url-star")
        common.remove(spark, path)
        now, path = following, new
    nodes = now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return nodes.unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()), path


def judged(pages: DataFrame, rules: Sequence[tuple[str, str]] | DataFrame, links: DataFrame, *, page_id: str = "page_id", url: str = "url", default: str = ALLOW) -> DataFrame:
    """One row per page: page_id, host, path, rule (null without one), verdict and inherited (whether it was passed on).

    ``rules`` are (verdict, rule) pairs, or a table of them of any size (verdict, rule strings; null ones are left out).
    ``links`` are edges (a, b) between nodes, as of links_of() or a crawl's redirects. A null URL, or one without
    ``://``, has no host and path and is no alias. Rows that repeat each get a row, ids may be null, other columns are
    ignored. Empty tables give an empty one; without rules or links every verdict is ``default``.
    """
    spark = pages.sparkSession
    place = lambda df, u: df.withColumns({"host": host_of(u), "path": path_of(u)})

    def ruled(df: DataFrame) -> DataFrame:
        if not isinstance(rules, DataFrame):
            return df.withColumn("fit", fitting(F.col("host"), F.col("path"), rules))
        return df.join(_fitted(df, rules), ["host", "path"], "left")

    nodes, path = equivalent(links)
    said = ruled(place(nodes, F.col("node"))).select("node", "root", F.col("fit.verdict").alias("said"))
    has = lambda v: F.max(F.coalesce(F.col("said") == v, F.lit(False)))
    bad = said.groupBy("root").agg(has(BLOCK).alias("blocked"), has(ALLOW).alias("allowed")).where("blocked AND NOT allowed").select("root")
    tainted, _ = common.saved(nodes.join(bad, "root").select(F.col("node").alias("alias")), "url-blocked")
    common.remove(spark, path)
    size = tainted.agg(F.sum(F.octet_length("alias") + 32)).first()[0] or 0
    row = ruled(place(pages.select(F.col(page_id).alias("id"), F.col(url).alias("u")), F.col("u")))
    # a page without a node looks up itself: nothing is in the table under it
    met = row.withColumn("node", F.coalesce(node_of(F.col("u")), F.lit(""))).join(common.maybe_broadcast(tainted, size, 1), F.col("node") == F.col("alias"), "left")
    inherited = F.col("fit").isNull() & F.col("alias").isNotNull()
    verdict = F.coalesce(F.col("fit.verdict"), F.when(inherited, BLOCK), F.lit(default))
    return met.select(F.col("id").alias(page_id), "host", "path", F.col("fit.rule").alias("rule"), verdict.alias("verdict"), inherited.alias("inherited"))
