"""Mixing sources to target weights by Poisson replication (operator 9).

A source's rate is its share of the target size over the documents it has: the mean number of times that each of its
documents is repeated. A document's count is the Poisson distribution with that rate, inverted at a uniform number
hashed from a seed, its id and its text; rates over 16 are split into equal parts, each with its own number, and added
up. The document is exploded into that many copies, each of which is dealt to a place by a hash of seed, id, text and
copy: counts and order depend on nothing else, so lost tasks repeat them. Rows that repeat an id and a text are told
apart by their place in the input besides, so that they are drawn and dealt independently and no task gets them all; as
such rows differ in other columns at most, give the operator a written table where they do. Only DataFrame operations
are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

#: The largest rate that is inverted at once; above 88 repetitions its distribution has nothing left in double precision.
PART_RATE, PART_LENGTH = 16.0, 88


def _uniform(*parts: Column) -> Column:
    """In (0, 1), from the first 52 bits of an MD5 hash."""
    return (F.conv(F.substring(F.md5(F.concat_ws("|", *parts)), 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)


def _cumulative(rate: Column) -> Column:
    """Array of P(X <= k) for k from 0 to PART_LENGTH."""
    start = F.struct(F.array(F.exp(-rate)).alias("cdf"), F.exp(-rate).alias("p"))
    step = lambda acc, k: F.struct(F.array_append(acc["cdf"], F.element_at(acc["cdf"], -1) + acc["p"] * rate / k).alias("cdf"), (acc["p"] * rate / k).alias("p"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(PART_LENGTH)), start, step, lambda acc: acc["cdf"])


def rates(docs: DataFrame, weights: dict[str, float] | None = None, *, source: str = "source", target_rows: int | None = None) -> DataFrame:
    """One row per source: source, n, rate, parts, cdf.

    ``weights`` gives each source's share of the mix, in any unit; a source it doesn't name gets none, and without it all
    sources weigh the same. A null source is a source of its own, named by None. ``target_rows`` is the expected size of
    the mix, by default that of ``docs``.
    """
    counts = docs.groupBy(F.col(source).alias("source")).agg(F.count("*").alias("n"))
    if weights is None:
        weighed = counts.withColumn("weight", F.lit(1.0))
    else:
        if any(not w >= 0 for w in weights.values()):
            raise ValueError("a weight is negative or not a number")
        weight = F.lit(0.0)
        for name, value in weights.items():
            weight = F.when(F.col("source").eqNullSafe(F.lit(name)), F.lit(float(value))).otherwise(weight)
        weighed = counts.withColumn("weight", weight)
    all_weight, all_rows = weighed.agg(F.sum("weight"), F.sum("n")).first()
    goal = (all_rows or 0) if target_rows is None else target_rows
    rate = goal * F.col("weight") / (all_weight or 1.0) / F.col("n")
    rated = weighed.withColumn("rate", rate.cast("double")).withColumn("parts", F.greatest(F.lit(1), F.ceil(F.col("rate") / PART_RATE).cast("int")))
    return rated.select("source", "n", "rate", "parts", _cumulative(F.col("rate") / F.col("parts")).alias("cdf"))


def mixed(docs: DataFrame, weights: dict[str, float] | None = None, *, seed: int = 17, doc_id: str = "doc_id", text: str = "text", source: str = "source", target_rows: int | None = None) -> DataFrame:
    """The columns of ``docs`` and n_copies, copy (from 1) and place, in random order.

    Columns of ``docs`` with those names are replaced; other names are free. Every row is drawn by itself, also those that
    repeat an id, an id and a text, or have a null id. A null text is replicated as it is and counts as an empty one; texts
    of any length are hashed whole; a table without that column is told by its ids. An empty table, or weights of 0 only, give an empty mix.
    """
    found, _ = common.saved(rates(docs, weights, source=source, target_rows=target_rows), "mix-rates")
    there = common.maybe_broadcast(found.select(F.col("source").alias("whose"), "rate", "parts", "cdf"), found.count(), 1000)
    own = [c for c in docs.columns if c not in ("n_copies", "copy", "place")]
    # the row is one column, so that no name of docs can clash with one of ours
    said = F.col(text).cast("string") if text in docs.columns else F.lit("")
    plain = F.concat(F.coalesce(F.concat(F.lit("#"), F.col(doc_id).cast("string")), F.lit("")), F.lit("|"), F.md5(F.coalesce(said, F.lit("")).cast("binary")))
    again, _ = common.saved(docs.groupBy(F.xxhash64(plain).alias("again")).agg(F.count("*").alias("n")).where("n > 1").select("again"), "mix-repeats")
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in own]).alias("row"), plain.alias("plain"), F.monotonically_increasing_id().alias("nth"), F.col(source).alias("source"))
    told = packed.join(common.maybe_broadcast(again, again.count(), 16), F.xxhash64("plain") == F.col("again"), "left")
    packed = told.select("row", "source", F.concat(F.col("plain"), F.when(F.col("again").isNull(), "").otherwise(F.concat(F.lit("|"), F.col("nth")))).alias("key"))
    drawn = F.transform(F.sequence(F.lit(1), F.col("parts")), lambda j: _uniform(F.lit(str(seed)), F.col("key"), j.cast("string")))
    count = F.when(F.col("rate") <= 0, 0).otherwise(F.aggregate(drawn, F.lit(0), lambda acc, u: acc + F.size(F.filter("cdf", lambda c: c < u))))
    counted = packed.join(there, F.col("source").eqNullSafe(F.col("whose"))).select("row", "key", count.cast("long").alias("n_copies")).where("n_copies > 0")
    copies = counted.select("row", "key", "n_copies", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n_copies"))).alias("copy"))
    placed = copies.select("row.*", "n_copies", "copy", F.md5(F.concat_ws("|", F.lit(f"{seed}|place"), F.col("key"), F.col("copy").cast("string"))).alias("place"))
    return placed.repartition("place").sortWithinPartitions("place")
