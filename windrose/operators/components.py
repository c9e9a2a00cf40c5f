"""Connected components of a table of links: trees by union-find in tasks, joined by large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .lineage import cut

#: Links that one union-find holds at most.
RUN_ROWS = 200_000


def _key(node):
    """A node as Python orders it like Spark: numbers, strings, and structs of them by their fields."""
    return tuple(node.values()) if isinstance(node, dict) else node


def _trees(batches):
    """Links of each run of rows as trees of depth one, every node below the least of its tree."""
    import pyarrow as pa

    held, kind = [], None

    def trees():
        values: dict = {}
        parent: dict = {}

        def find(x):
            while (up := parent[x]) != x:
                parent[x] = x = parent[up]
            return x

        for a, b in held:
            ends = []
            for node in (a, b):
                name = _key(node)
                if name not in parent:
                    parent[name], values[name] = name, node
                ends.append(find(name))
            if ends[0] != ends[1]:
                parent[max(ends)] = min(ends)
        below = [(n, find(n)) for n in list(parent)]
        below = [(n, r) for n, r in below if n != r]
        return pa.RecordBatch.from_arrays([pa.array([values[x[i]] for x in below], kind) for i in (0, 1)], names=["a", "b"])

    for batch in batches:
        kind = batch.schema.field(0).type
        held.extend(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True))
        if len(held) >= RUN_ROWS:
            yield trees()
            held = []
    if held:
        yield trees()


def _round(now: DataFrame) -> DataFrame:
    """Points every node at the least node it has met; moved says whether a row's nodes have found lesser ones. A node's
    least neighbour is added up where its links are and joined back, so a node with many is never gathered."""
    end = lambda u, v: F.struct(F.col(u).alias("u"), F.col(v).alias("v"))
    both = now.select(F.explode(F.array(end("a", "b"), end("b", "a"))).alias("x")).select("x.u", "x.v")
    least = both.groupBy("u").agg(F.min("v").alias("first"))
    near = both.join(least, "u").select("u", "v", F.least("u", "first").alias("m")).where("v > u")
    large = near.groupBy(F.col("v").alias("a"), F.col("m").alias("b")).agg(F.max(F.col("m") != F.col("u")).alias("moved"))
    own = large.groupBy("a").agg(F.min("b").alias("m"), F.max("moved").alias("moved"))
    parents = large.select("a", "b").join(own.select("a", "m"), "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"), F.lit(True).alias("moved"))
    return own.select("a", F.col("m").alias("b"), "moved").unionByName(parents).groupBy("a", "b").agg(F.max("moved").alias("moved"))


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of ``links`` (a, b of one type: numbers, strings or structs of them): root is the least
    node reachable.

    Links may repeat or point at themselves; null ends link nothing. Tasks first join their own links into trees, and again
    after these have been dealt by node; a round of joins then points nodes at lesser ones over the whole table, until
    none moves. Their number grows with the logarithm of the longest path; each is cut off from the ones before.
    """
    kind = links.select("a", "b").schema.simpleString()[len("struct<") : -1]
    once = links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).mapInArrow(_trees, kind)
    now = cut(once.repartition("a").mapInArrow(_trees, kind))
    while True:
        now = cut(_round(now))
        if not now.agg(F.max(F.col("moved").cast("int"))).first()[0]:
            break
    nodes = now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return nodes.unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
