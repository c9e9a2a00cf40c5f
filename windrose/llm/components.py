"""Connected components of a table of links, by alternating large-star and small-star steps.

Tasks first join their links into trees of depth one by union-find over bounded runs of rows, and so after each round,
which shortens paths and leaves a node few parents. A round points nodes at the least node they have met, over the whole
table: the number of rounds grows with the logarithm of the longest path. Every round is written to the shared folder;
the last is the one in which no node moved.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import common

#: Links that one union-find holds at most.
RUN_ROWS = 500_000


def joined(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each node but the least of a component of the links, and that least node."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    parent = list(range(len(nodes)))
    for x, y in zip(at[: len(a)].tolist(), at[len(a) :].tolist(), strict=True):
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        while parent[y] != y:
            parent[y] = y = parent[parent[y]]
        if x < y:
            parent[y] = x
        elif y < x:
            parent[x] = y
    for i in range(len(parent)):  # a parent is less than its child, so its own root is known
        parent[i] = parent[parent[i]]
    root = np.array(parent, np.int64)
    child = np.flatnonzero(root != np.arange(len(root)))
    return nodes[child], nodes[root[child]]


def _contract(batches):
    """Trees of the links of each run of rows; moved is true for all of a run if it is for any row."""
    held: list[pa.RecordBatch] = []
    rows = 0

    def trees():
        a, b, moved = (np.concatenate([x.column(i).to_numpy(zero_copy_only=False) for x in held]) for i in range(3))
        child, root = joined(a, b)
        return pa.RecordBatch.from_arrays([pa.array(child), pa.array(root), pa.array(np.full(len(child), bool(moved.any())))], names=["a", "b", "moved"])

    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            rows += batch.num_rows
        if rows >= RUN_ROWS:
            yield trees()
            held, rows = [], 0
    if held:
        yield trees()


_TREES = "a long, b long, moved boolean"


def _round(links: DataFrame) -> DataFrame:
    """Large-star, then small-star; moved says whether a row's nodes have found lesser ones."""
    end = lambda u, v: F.struct(F.col(u).alias("u"), F.col(v).alias("v"))
    both = links.select(F.explode(F.array(end("a", "b"), end("b", "a"))).alias("x")).select("x.u", "x.v")
    # a node's least neighbour is added up where its links are and joined back, so a node with many is split between tasks
    least = common.narrow(both.groupBy("u").agg(F.min("v").alias("first")))
    near = both.join(least, "u").select("u", "v", F.least("u", "first").alias("m"))
    large = common.narrow(near.where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"), (F.col("m") != F.col("u")).alias("moved")))
    own = Window.partitionBy("a").orderBy("b", F.desc("moved"))
    small = large.select("a", "b", "moved", F.first("b").over(own).alias("m"), F.row_number().over(own).alias("i"))
    to = lambda a, b, moved: F.struct(F.col(a).alias("a"), F.col(b).alias("b"), moved.alias("moved"))
    child, parent = F.when(F.col("i") == 1, to("a", "m", F.col("moved"))), F.when(F.col("b") != F.col("m"), to("b", "m", F.lit(True)))
    out = small.select(F.explode(F.filter(F.array(child, parent), lambda x: x.isNotNull())).alias("x")).select("x.a", "x.b", "x.moved")
    return common.narrow(out).mapInArrow(_contract, _TREES)


def components(links: DataFrame) -> tuple[DataFrame, str]:
    """(node, root) for every node of ``links`` (a, b long): root is the least node reachable, and the path to remove().

    Links may repeat or point at themselves; a null end links nothing. An empty table gives an empty one.
    """
    common.ship(links.sparkSession)
    plain = links.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b"), F.lit(True).alias("moved")).where("a <> b")
    # a task's trees hold a node once at most; dealt by node, what all tasks know of one meets, and is contracted again
    trees = common.narrow(plain).mapInArrow(_contract, _TREES).repartition("a")
    now, path = common.saved(common.narrow(trees).mapInArrow(_contract, _TREES), "links")
    spark = links.sparkSession
    while True:
        following, new = common.saved(_round(now), "star")
        common.remove(spark, path)
        now, path = following, new
        if not following.agg(F.max(F.col("moved").cast("int"))).first()[0]:
            break
    nodes = now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return nodes.unionByName(common.narrow(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())), path
