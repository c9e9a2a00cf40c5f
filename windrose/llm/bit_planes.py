"""Hard-negative mining by bit-sliced integer products (operator 11).

Vectors become integers. Their products with the anchors are added up from the bit-planes of the components, the most
significant first: after each plane a product is known to lie in an interval, which the planes that are left can widen by
no more than their weight times the anchor's absolute sum. A candidate is dropped as soon as its interval can't qualify:
it ends below the least score wanted, begins above the greatest, or ends below what as many others as are wanted are sure
to reach. While most candidates are left a plane is one matrix product; then each one that is left adds its own bits.

Anchors are a stated part of the rows and meet all of them: anchors and rows are dealt into blocks of bounded size, and
each pair of blocks is a group of its own, which returns a bounded number of rows for each anchor. The first round
finds positives (the best of the same label), the second the negatives that score within a band under each positive.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import common

#: Rows of a block, and anchors of one.
BLOCK_ROWS, BLOCK_ANCHORS = 4096, 1024
#: Anchors of a block that are multiplied at once.
STRIP = 128
#: Components are less than this, so that sums of products are exact in double precision up to 8,192 components.
LIMIT = 1 << 20
#: Share of a matrix's candidates from which on those left add their own bits.
SPARSE = 1 / 16
#: Numbers that the bits of candidates may take at once.
GATHER = 1 << 21


class Scores:
    """Intervals of the products of anchors (a x d) and rows (n x d, from 0), plane by plane."""

    def __init__(self, anchors: np.ndarray, rows: np.ndarray):
        low = int(rows.min())
        self.shifted = rows - low  # not negative: every plane adds
        self.plane = int(self.shifted.max()).bit_length()
        self.anchors = anchors
        self.kind = np.float32 if int(np.abs(anchors).max()) * (self.shifted.max() + abs(low) + 1) * anchors.shape[1] < 1 << 23 else np.float64
        self.typed = anchors.astype(self.kind)
        self.known = np.repeat((anchors.sum(1) * low).astype(self.kind)[:, None], len(rows), 1)
        self.more, self.less = np.maximum(anchors, 0).sum(1), np.minimum(anchors, 0).sum(1)
        self.at = None  # anchors and rows of the candidates, once they are few

    def step(self) -> None:
        """Adds the next plane."""
        self.plane -= 1
        weight = self.kind(1 << self.plane)
        bits = (self.shifted >> self.plane) & 1
        if self.at is None:
            self.known += self.typed @ (bits.astype(self.kind) * weight).T
            return
        a, r = self.at
        size = max(1, GATHER // self.anchors.shape[1])
        for k in range(0, len(a), size):
            part = slice(k, k + size)
            self.known[part] += weight * np.einsum("ij,ij->i", self.typed[a[part]], bits[r[part]].astype(self.kind))

    def rest(self) -> tuple[np.ndarray, np.ndarray]:
        """What the planes left add to each anchor's products, at least and at most."""
        top = (1 << self.plane) - 1
        return self.less * top, self.more * top

    def narrow(self, keep: np.ndarray) -> None:
        """Leaves those candidates in (a mask of what ``known`` holds)."""
        if self.at is None:
            if keep.mean() > SPARSE:
                self.known[~keep] = -np.inf
                return
            self.at = np.nonzero(keep)
            self.known = self.known[keep]
        else:
            self.at = (self.at[0][keep], self.at[1][keep])
            self.known = self.known[keep]

    def ended(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Anchor, row and score of the candidates left; all planes are in."""
        if self.at is None:
            self.at = np.nonzero(np.isfinite(self.known))
            self.known = self.known[self.at]
        return *self.at, self.known.astype(np.int64)

    def by_anchor(self):
        """Each anchor with the place of its candidates in ``known`` (an index or a slice)."""
        if self.at is None:
            for a in range(len(self.anchors)):
                yield a, (a, slice(None)), self.known[a]
        else:
            edge = np.searchsorted(self.at[0], np.arange(len(self.anchors) + 1))
            for a in np.flatnonzero(np.diff(edge)):
                own = slice(edge[a], edge[a + 1])
                yield a, own, self.known[own]


def best(anchors: np.ndarray, rows: np.ndarray, wanted: int, apart: np.ndarray | None = None):
    """(anchor, row, score) of at least the ``wanted`` highest scores of each anchor, ties with the last of them included.

    ``apart`` is a mask of pairs that don't count.
    """
    s = Scores(anchors, rows)
    if apart is not None:
        s.known[apart] = -np.inf
    while s.plane:
        s.step()
        low, high = s.rest()
        keep = np.isfinite(s.known)
        for a, own, known in s.by_anchor():
            if len(known) > wanted:
                sure = np.partition(known, -wanted)[-wanted] + low[a]  # so many reach this
                keep[own] &= known + high[a] >= sure
        s.narrow(keep)
    return s.ended()


def within(anchors: np.ndarray, rows: np.ndarray, wanted: int, low: np.ndarray, high: np.ndarray, apart: np.ndarray):
    """(anchor, band, row, score) of at least the ``wanted`` highest scores in each band of each anchor, ties included.

    ``low`` and ``high`` (anchors x bands) are the least and greatest score of each band, low > high for none. ``apart``
    is a mask of pairs that don't count.
    """
    s = Scores(anchors, rows)
    s.known[apart] = -np.inf
    least, most = np.where(low > high, np.inf, low).min(1), np.where(low > high, -np.inf, high).max(1)
    spread = s.more - s.less
    while s.plane:
        s.step()
        below, above = s.rest()
        if s.at is None and s.plane and (spread << s.plane).min() > 4 * max(1, np.abs(np.where(low > high, 0, high)).max()):
            continue  # no interval can be outside yet
        by = s.at[0] if s.at is not None else None
        of = (lambda x: x[:, None]) if by is None else (lambda x, by=by: x[by])
        keep = (s.known + of(above) >= of(least)) & (s.known + of(below) <= of(most))
        s.narrow(keep)
        if s.at is None:
            continue
        keep = np.zeros(len(s.known), bool)
        for a, own, known in s.by_anchor():
            for lo, hi in {(x, y) for x, y in zip(low[a], high[a], strict=True) if x <= y}:
                sure = known[(known + below[a] >= lo) & (known + above[a] <= hi)]
                floor = max(lo, np.partition(sure, -wanted)[-wanted] + below[a]) if len(sure) >= wanted else lo
                keep[own] |= (known + above[a] >= floor) & (known + below[a] <= hi)
        s.narrow(keep)
    a, r, score = s.ended()
    out = [[x[m] for x in (a, np.full(len(a), k), r, score)] for k in range(low.shape[1]) for m in [(score >= low[a, k]) & (score <= high[a, k])]]
    return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.zeros(0, np.int64),) * 4


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    flat = column.combine_chunks()
    return flat.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(flat), -1)


def _topmost(by: tuple[np.ndarray, ...], score: np.ndarray, ids: np.ndarray, rows: np.ndarray, wanted: int) -> np.ndarray:
    """Places of the first ``wanted`` of each group, by score, id and row."""
    order = np.lexsort((rows, ids, -score, *by[::-1]))
    key = np.stack([x[order] for x in by])
    new = np.concatenate([[True], (key[:, 1:] != key[:, :-1]).any(0)])
    at = np.arange(len(order))
    return order[at - np.maximum.accumulate(np.where(new, at, 0)) < wanted]


_FOUND = "anchor long, band int, other long, other_id long, score long"
#: A null id comes after all others among equal scores.
_LAST = np.iinfo(np.int64).max


def _meet(wanted: int, positives: bool):
    """A block of anchors with a block of rows: for each anchor (and band) the first ``wanted`` that count."""

    def run(group: pa.Table) -> pa.Table:
        side = group["anchors"].to_numpy()
        anchors, rows = group.filter(pa.array(side)), group.filter(pa.array(~side))
        found = []
        if len(anchors) and len(rows):
            x, y = _matrix(anchors["parts"]), _matrix(rows["parts"])
            own, row = anchors["row"].to_numpy(), rows["row"].to_numpy()
            label, other = anchors["label"].to_pylist(), rows["label"].to_pylist()
            names = {v: k for k, v in enumerate(dict.fromkeys(label + other))}
            label, other = (np.array([names[v] for v in z]) for z in (label, other))
            ids = rows["id"].fill_null(_LAST).to_numpy() if rows["id"].null_count else rows["id"].to_numpy()
            if positives:
                parts = [(np.flatnonzero(label == k), np.flatnonzero(other == k)) for k in np.unique(label)]
            else:
                parts = [(np.arange(len(own)), np.arange(len(row)))]
                bands = [(np.array(c.to_pylist(), float).reshape(len(own), -1)) for c in (anchors["low"], anchors["high"])]
            for mine, theirs in parts:
                for at in range(0, len(mine), STRIP):
                    m = mine[at : at + STRIP]
                    if not len(theirs):
                        continue
                    if positives:
                        a, r, score = best(x[m], y[theirs], wanted, own[m][:, None] == row[theirs][None, :])
                        band = np.zeros(len(a), np.int64)
                    else:
                        a, band, r, score = within(x[m], y, wanted, bands[0][m], bands[1][m], label[m][:, None] == other[None, :])
                    if len(a):
                        a, r = m[a], theirs[r]
                        first = _topmost((a, band), score, ids[r], row[r], wanted)
                        found.append((own[a[first]], band[first], row[r[first]], r[first], score[first]))
        anchor, band, other_row, r, score = (np.concatenate(z) for z in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 5
        return pa.table({"anchor": anchor, "band": band.astype(np.int32), "other": other_row, "other_id": rows["id"].take(pa.array(r)), "score": score})

    return run


def _blocks(rows: DataFrame, anchors: DataFrame, n_rows: int, n_anchors: int) -> DataFrame:
    """Rows and anchors, each copied to the blocks of the other side."""
    of_rows, of_anchors = max(1, math.ceil(n_rows / BLOCK_ROWS)), max(1, math.ceil(n_anchors / BLOCK_ANCHORS))
    number = lambda n: F.pmod(F.xxhash64("row"), F.lit(n))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    left = rows.select("dim", number(of_rows).alias("j"), every(of_anchors).alias("i"), F.lit(False).alias("anchors"), "row", "id", "label", "parts", F.lit(None).cast("array<long>").alias("low"), F.lit(None).cast("array<long>").alias("high"))
    right = anchors.select("dim", every(of_rows).alias("j"), number(of_anchors).alias("i"), F.lit(True).alias("anchors"), "row", "id", "label", "parts", "low", "high")
    return left.unionByName(right).groupBy("dim", "i", "j")


def _first(found: DataFrame, wanted: int) -> DataFrame:
    """The first ``wanted`` of each anchor and band, numbered from 1."""
    order = Window.partitionBy("anchor", "band").orderBy(F.desc("score"), F.asc_nulls_last("other_id"), "other")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= wanted)


def hard_negatives(
    vectors: DataFrame, anchors: Column, *, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label", scale: int = 256, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of rows of ``vectors``.

    A component x becomes floor(scale * x), with x as double; a score is the integer inner product with the anchor, higher
    ones come first, ties by the smaller id (null ids last, then in an arbitrary fixed order). Anchors are the rows for
    which ``anchors``, a condition on the columns of ``vectors``, holds. An anchor's positives are the first ``positives``
    other rows of its label; for each of them the first ``negatives`` rows of another label come back that score from
    ``low`` to ``high`` percent of the positive's score, both included (for a negative score there are none).

    Rows with a null label, a null or empty vector, or a component that is null, not finite or, scaled, 2 ** 20 or more
    in size take no part; vectors of different lengths don't meet. Ids are integers; rows that repeat are rows of their
    own, as anchors too. Other columns are ignored. Empty tables, or no anchors, give an empty result.
    """
    spark = vectors.sparkSession
    common.ship(spark)
    parts = F.transform(F.col(vector), lambda x: F.floor(F.lit(float(scale)) * x.cast("double")))
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x * F.lit(float(scale))) < F.lit(float(LIMIT - 1)))
    usable = F.col(label).isNotNull() & (F.size(vector) > 0) & F.forall(F.col(vector), lambda x: fine(x.cast("double")))
    plain = vectors.where(usable).select(F.monotonically_increasing_id().alias("row"), F.col(vec_id).cast("long").alias("id"), F.col(label).alias("label"), F.size(vector).alias("dim"), parts.cast("array<int>").alias("parts"), F.coalesce(anchors, F.lit(False)).alias("asks"))
    rows, path = common.saved(plain, "mining-rows")  # a row keeps its number from here on
    n_rows, n_anchors = rows.agg(F.count("*"), F.count_if("asks")).first()
    asking = rows.where("asks")
    nothing = F.lit(None).cast("array<long>")
    met = _blocks(rows, asking.withColumns({"low": nothing, "high": nothing}), n_rows, n_anchors).applyInArrow(_meet(positives, True), _FOUND)
    best_of, best_path = common.saved(_first(met, positives), "mining-positives")
    exact = F.struct("rank", F.expr(f"({low} * score + 99) div 100").alias("low"), F.expr(f"({high} * score) div 100").alias("high"))
    bands = best_of.where("score >= 0").groupBy("anchor").agg(F.array_sort(F.collect_list(exact)).alias("bands"))
    filled = F.transform(F.sequence(F.lit(1), F.lit(positives)), lambda k: F.filter("bands", lambda b: b["rank"] == k))
    side = lambda name, none: F.transform(filled, lambda b: F.coalesce(F.try_element_at(b, F.lit(1))[name], F.lit(none).cast("long")))
    banded, band_path = common.saved(asking.join(bands, asking["row"] == bands["anchor"]).select("row", "id", "label", "dim", "parts", side("low", 1).alias("low"), side("high", 0).alias("high")), "mining-bands")
    near = _blocks(rows, banded, n_rows, max(1, n_anchors)).applyInArrow(_meet(negatives, False), _FOUND)
    chosen = _first(near, negatives).select("anchor", F.col("band") + 1, "rank", "other_id", "score").toDF("anchor", "positive", "rank", "negative_id", "negative_score")
    named = best_of.select("anchor", F.col("rank").alias("positive"), F.col("other_id").alias("positive_id"), F.col("score").alias("positive_score"))
    ids = asking.select(F.col("row").alias("anchor"), F.col("id").alias("anchor_id"))
    out = chosen.join(named, ["anchor", "positive"]).join(ids, "anchor").select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
    result, _ = common.saved(out, "mining-result")
    common.remove(spark, path, best_path, band_path)
    return result
