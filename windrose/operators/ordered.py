"""Running totals, ranks and quantiles over a whole table or its groups, and greedy selection, without one task that holds
a whole group: rows are range-partitioned in order, and each partition starts from the totals of those before it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .lineage import cut


def running(df: DataFrame, order: list[Column], totals: dict[str, Column], *, by: list[str] | None = None) -> DataFrame:
    """Adds for each name the total of its column up to and including a row, in ``order`` within ``by``, and as ``all_``
    and the name that of the whole group. A range partition adds its own rows up; what stands before it is a table of
    one row for each partition and group."""
    by = by or []
    keys = [F.col(c) for c in by]
    valued = df.withColumns({f"_v_{n}": c for n, c in totals.items()})
    dealt = cut(valued.repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order).withColumn("_p", F.spark_partition_id()))
    parts = dealt.groupBy(*by, "_p").agg(*[F.sum(f"_v_{n}").alias(f"_t_{n}") for n in totals])
    group = Window.partitionBy(*(by or [F.lit(0)]))
    before = group.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select(*[F.col(c).alias(f"_k_{c}") for c in by], F.col("_p").alias("_q"), *[F.coalesce(F.sum(f"_t_{n}").over(before), F.lit(0)).alias(f"_b_{n}") for n in totals], *[F.sum(f"_t_{n}").over(group).alias(f"all_{n}") for n in totals])
    same = F.col("_p") == F.col("_q")
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"_k_{c}"))
    own = Window.partitionBy(*by, "_p").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    out = dealt.join(parts, same).withColumns({n: F.sum(f"_v_{n}").over(own) + F.col(f"_b_{n}") for n in totals})
    return out.drop("_p", "_q", *[f"_k_{c}" for c in by], *[f"_{x}_{n}" for n in totals for x in "vb"])


def quantiles(df: DataFrame, value: str, shares: dict[str, float], *, by: list[str] | None = None) -> DataFrame:
    """(by, names of ``shares``): exact quantiles, interpolated between neighbours; nulls are left out. Values are counted
    and ranked, so neither a frequent value nor a large group comes into one task."""
    by = by or []
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("_n"))
    ranked = running(counts, [F.col(value)], {"_upto": F.col("_n")}, by=by).withColumn("_first", F.col("_upto") - F.col("_n"))
    at = lambda q: q * (F.col("all__upto") - 1)
    # the value at a place is the one whose run of equal values the place is in
    here = lambda place: F.max(F.when((F.col("_first") <= place) & (place < F.col("_upto")), F.col(value).cast("double")))
    out = ranked.groupBy(*by).agg(*[x for n, q in shares.items() for x in (here(F.floor(at(q))).alias(f"_l_{n}"), here(F.ceil(at(q))).alias(f"_h_{n}"), F.first(at(q) - F.floor(at(q))).alias(f"_s_{n}"))])
    return out.select(*by, *[(F.col(f"_l_{n}") + F.col(f"_s_{n}") * (F.col(f"_h_{n}") - F.col(f"_l_{n}"))).alias(n) for n in shares])


def first_kept(nodes: DataFrame, conflicts: DataFrame, key: list[str]) -> DataFrame:
    """Keys of the nodes that a greedy pass keeps, of ``conflicts`` from an earlier node (key columns) to a later one
    (the same with ``_after``): a node stays if no earlier one that stays conflicts with it.

    Nodes without an earlier conflict stay, what they conflict with goes, and so on round by round; as many rounds as the
    longest chain of conflicts has, each cut off from the ones before.
    """
    after = [f"_after_{k}" for k in key]
    later = lambda df: df.select(*[F.col(a).alias(k) for k, a in zip(key, after, strict=True)]).distinct()
    left, edges, kept = nodes.select(*key), cut(conflicts.select(*key, *after)), None
    while True:
        free = cut(left.join(later(edges), key, "left_anti"))
        kept = free if kept is None else kept.unionByName(free)
        if edges.isEmpty():
            return kept
        gone = cut(later(edges.join(free, key, "left_semi")))
        left = cut(left.join(free.unionByName(gone), key, "left_anti"))
        met = edges.join(left, key, "left_semi")
        edges = cut(met.join(left.select(*[F.col(k).alias(a) for k, a in zip(key, after, strict=True)]), after, "left_semi"))
