"""Embedding near-duplicates by sorted projection passes (operator 7).

In each pass vectors get a code of random hyperplane signs, are range-partitioned and sorted by it, and are compared
with a bounded number of neighbours in that order; like vectors share a long prefix of their codes and so stand close.
Equal codes are ordered by node, so that a group of near copies with one code is split between tasks like any other.
Verified pairs of all passes are united into components.

A window bounds what a pass compares, so a dense group's links are only partly seen in the passes. They are counted
exactly afterwards: the members of each component are dealt into blocks of bounded size, and every block meets every
block of its component in a group of its own that returns counts, never pairs. Equal vectors are one member that counts
as many times as it occurs, so copies are not compared with one another.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .components import components

CODE_BITS = 62
#: Bytes of a block of vectors, and rows of it that are multiplied with all of another one at once.
BLOCK_BYTES, STRIP = 2 << 20, 256
#: Share of isolated pairs at a cosine of exactly ``least`` that the passes are to find, however many vectors there are.
RECALL = 0.97
LEAST_PASSES = 10


def passes_for(n_rows: int, least: float, width: int) -> int:
    """Passes that find such a pair among evenly spread vectors with a chance of RECALL.

    A pass brings two vectors within ``width`` places if about log2(n_rows / width) leading signs agree, and each agrees
    with a chance of 1 - angle / pi.
    """
    agree = 1 - math.acos(max(0.0, min(1.0, least))) / math.pi
    once = agree ** math.log2(max(2.0, n_rows / width))
    return LEAST_PASSES if once >= 1 else max(LEAST_PASSES, math.ceil(math.log(1 - RECALL) / math.log1p(-once)))


def _unit(vectors: np.ndarray) -> np.ndarray:
    x = vectors.astype(np.float64)
    x /= np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _codes(passes: int, seed: int):
    """Of each row its id, and of a valid vector its dimension, bytes (null for others) and a code for each pass."""

    def run(batches):
        planes: dict[int, np.ndarray] = {}
        for batch in batches:
            ids, lists = batch.column(0), batch.column(1)
            n_rows = len(lists)
            flat = lists.flatten()
            values = flat.cast(pa.float64()).to_numpy(zero_copy_only=False)
            size = np.nan_to_num(pa.compute.list_value_length(lists).to_numpy(zero_copy_only=False).astype(float)).astype(np.int64)
            start = np.concatenate([[0], np.cumsum(size)])
            good = np.concatenate([[0], np.cumsum(np.isfinite(values))])
            some = np.concatenate([[0], np.cumsum(np.nan_to_num(values) != 0)])
            valid = (size > 0) & (np.diff(good[start]) == size) & (np.diff(some[start]) > 0)
            for d in np.unique(size[valid]):
                rows = np.flatnonzero(valid & (size == d))
                if d not in planes:
                    planes[d] = np.random.Generator(np.random.PCG64([seed, int(d)])).standard_normal((d, passes * CODE_BITS))
                x = values[start[rows][:, None] + np.arange(d)]
                unit, codes = _unit(x), np.empty((len(rows), passes), np.int64)
                for p in range(passes):  # one at a time: a batch's memory doesn't grow with the passes
                    bits = unit @ planes[d][:, p * CODE_BITS : (p + 1) * CODE_BITS] > 0
                    codes[:, p] = (bits.astype(np.int64) << np.arange(CODE_BITS - 1, -1, -1)).sum(1)
                raw = x.astype("<f8").tobytes()
                step = 8 * int(d)
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.take(pa.array(rows)),
                        pa.array(np.full(len(rows), d, np.int32)),
                        pa.array([raw[i * step : (i + 1) * step] for i in range(len(rows))], pa.binary()),
                        pa.ListArray.from_arrays(pa.array(np.arange(0, len(rows) * passes + 1, passes, dtype=np.int32)), pa.array(codes.ravel())),
                    ],
                    names=["id", "dim", "vector", "codes"],
                )
            bad = np.flatnonzero(~valid)
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(bad)), pa.array(np.zeros(len(bad), np.int32)), pa.nulls(len(bad), pa.binary()), pa.array([[]] * len(bad), pa.list_(pa.int64()))], names=["id", "dim", "vector", "codes"])

    return run


def _neighbours(width: int, least: float):
    """Links that join more than has been joined, of sorted vectors with the ``width`` before them."""

    def run(batches):
        ids = np.zeros(0, np.int64)
        rows: list[bytes] = []
        for batch in batches:
            new = batch.column(0).to_numpy()
            raw = batch.column(1).to_pylist()
            ids, rows = np.concatenate([ids, new]), rows + raw
            fresh = len(ids) - len(new)
            size = np.array([len(r) for r in rows])
            links = []
            for d in np.unique(size):
                own = np.flatnonzero(size == d)
                parent: dict[int, int] = {}

                def find(i, parent=parent):
                    while (up := parent.get(i, i)) != i:
                        parent[i] = up = parent.get(up, up)
                        i = up
                    return i

                x = _unit(np.frombuffer(b"".join([rows[i] for i in own]), "<f8").reshape(len(own), -1))
                if not width or len(own) < 2:
                    continue
                # runs of vectors close to the next one are one label from the start, so that few pairs are left to join
                near = np.einsum("ij,ij->i", x[1:], x[:-1]) >= least
                links.extend((own[i], own[i + 1]) for i in np.flatnonzero(near & (own[1:] >= fresh)))
                label = int(own[0]) + np.concatenate([[0], np.cumsum(~near)])
                for o in range(2, min(width, len(own) - 1) + 1):
                    close = np.flatnonzero((label[o:] != label[:-o]) & (np.einsum("ij,ij->i", x[o:], x[:-o]) >= least))
                    for i in close:
                        a, b = find(int(label[i])), find(int(label[i + o]))
                        if a != b:
                            parent[b] = a
                            if own[i + o] >= fresh:  # what stood here before has been joined before
                                links.append((own[i], own[i + o]))
            if links:
                at = np.array(links)
                yield pa.RecordBatch.from_arrays([pa.array(ids[at[:, 0]]), pa.array(ids[at[:, 1]])], names=["a", "b"])
            ids, rows = ids[-width:], rows[-width:]

    return run


def _sorted(members: DataFrame, p: int) -> DataFrame:
    """(node, vector) in the order of pass ``p``."""
    order = ("dim", "code", "node")
    return members.select("node", "vector", "dim", F.col("codes")[p].alias("code")).repartitionByRange(*order).sortWithinPartitions(*order).select("node", "vector")


def _counts(least: float):
    """For a group of one or two blocks: each member's linked members in the other, with their copies."""

    def run(group: pa.Table) -> pa.Table:
        ids, roots = group["node"].to_numpy(), group["root"].to_numpy()
        copies, side = group["copies"].to_numpy(), group["side"].to_numpy()
        raw = group["vector"].to_pylist()
        size = np.array([len(r) for r in raw])
        across = group["i"][0].as_py() != group["j"][0].as_py()
        found = np.zeros(len(ids), np.int64)
        for d in np.unique(size):
            own = np.flatnonzero(size == d)
            x = _unit(np.frombuffer(b"".join([raw[i] for i in own]), "<f8").reshape(len(own), -1))
            for at in range(0, len(own), STRIP):
                part = own[at : at + STRIP]
                close = (x[at : at + STRIP] @ x.T >= least) & (roots[part][:, None] == roots[own][None, :])
                if across:
                    close &= side[part][:, None] != side[own][None, :]
                else:
                    close &= ids[part][:, None] != ids[own][None, :]
                found[part] += close @ copies[own]
        return pa.table({"node": ids, "links": found})

    return run


def similar_vectors(vectors: DataFrame, *, vec_id: str = "vec_id", vector: str = "embedding", least: float = 0.9, passes: int | None = None, width: int = 48, seed: int = 11) -> DataFrame:
    """One row per row of ``vectors``: vec_id, n_links, component_id (least id reachable by links) and kept.

    Vectors link when their cosine in double precision is at least ``least``. Those that are null, empty, zero, or hold a
    null or non-finite number link with nothing, nor do vectors of different lengths. Rows that repeat an id each get
    a row and link by their own vectors. Ids are integers; a row with a null id links like any other, and a component
    without any id has a null component_id. Other columns are ignored. An empty table gives an empty one. No link found
    is below ``least``; a component that no pass joins stays apart (see the README for the recall measured). Without
    ``passes``, their number follows from the counted rows (passes_for). Equal vectors are told by 64-bit hashes.
    """
    spark = vectors.sparkSession
    common.ship(spark)
    plain = vectors.select(F.col(vec_id).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"))
    if passes is None:
        passes = passes_for(vectors.count(), least, width)
    coded, coded_path = common.saved(plain.mapInArrow(_codes(passes, seed), "id long, dim int, vector binary, codes array<long>"), "projection-codes")
    rows = coded.withColumn("node", F.xxhash64("vector"))
    first = [F.first(c).alias(c) for c in ("dim", "vector", "codes")]
    members, members_path = common.saved(rows.where("vector IS NOT NULL").groupBy("node").agg(*first, F.min("id").alias("rep"), F.count("*").alias("copies")), "projection-members")
    done = [coded_path, members_path]
    found = []
    for p in range(passes):
        _, path = common.saved(_sorted(members, p).mapInArrow(_neighbours(width, least), "a long, b long"), "projection-links")
        found.append(path)
    done += found
    links = spark.read.schema("a long, b long").parquet(*found)
    roots, roots_path = components(links.distinct())
    roots = roots.select("node", "root")
    done.append(roots_path)
    grouped, path = common.saved(members.join(common.narrow(roots), "node").select("node", "rep", "root", "vector", "copies"), "projection-grouped")
    done.append(path)
    totals = _compared(grouped, least).groupBy("node").agg(F.sum("links").alias("links"))
    ids = grouped.groupBy("root").agg(F.min("rep").alias("component_id"))
    linked = common.narrow(grouped.select("node", "root", "copies").join(common.narrow(ids), "root").join(common.narrow(totals), "node"))
    single = members.select("node", F.col("rep").alias("component_id"), (F.col("copies") - 1).alias("n_links")).join(linked.select("node"), "node", "left_anti")
    named = linked.select("node", "component_id", (F.col("copies") - 1 + F.col("links")).alias("n_links")).unionByName(single.select("node", "component_id", "n_links"))
    alone = rows.where("vector IS NULL").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    out = rows.where("vector IS NOT NULL").select("id", "node").join(common.narrow(named), "node").select("id", "n_links", "component_id").unionByName(alone)
    result, _ = common.saved(out.select(F.col("id").alias(vec_id), "n_links", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept")), "projection-result")
    common.remove(spark, *done)
    return result


def _compared(grouped: DataFrame, least: float) -> DataFrame:
    """(node, links) of the members of components: how many rows each links with in each pair of blocks."""
    size_of = F.sum(F.octet_length("vector").cast("long"))
    total = grouped.agg(size_of).first()[0] or 0
    sized = grouped.join(common.narrow(grouped.groupBy("root").agg(size_of.alias("size"))), "root")
    bin_of = F.pmod(F.xxhash64("root"), F.lit(max(1, total // BLOCK_BYTES)))
    columns = ("node", "root", "copies", "vector")
    small = sized.where(F.col("size") <= BLOCK_BYTES).select(F.lit(-1).cast("long").alias("whole"), bin_of.alias("i"), bin_of.alias("j"), F.lit(0).alias("side"), *columns)
    blocks = F.ceil(F.col("size") / BLOCK_BYTES)
    dealt = sized.where(F.col("size") > BLOCK_BYTES).withColumns({"blocks": blocks, "own": F.pmod(F.xxhash64("node"), blocks)}).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    large = dealt.select(F.col("root").alias("whole"), F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), (F.col("own") > F.col("other")).cast("int").alias("side"), *columns)
    return small.unionByName(large).groupBy("whole", "i", "j").applyInArrow(_counts(least), "node long, links long")
