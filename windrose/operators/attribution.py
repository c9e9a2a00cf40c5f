"""Attribution: aggregation of saliency over channels, and permutation importance."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import metrics, ordered


def shares(df: DataFrame, *, by: list[str], variable: str, value: str) -> DataFrame:
    """Of each group (detection) and variable: mean and sum of absolute attribution as shares of the group, and whether
    the variable is the top driver (ties: least name). Groups without attribution have shares 0."""
    g = df.groupBy(*by, variable).agg(F.avg(F.abs(value)).alias("m"), F.sum(F.abs(value)).alias("s"))
    w = Window.partitionBy(*by)
    zero = lambda x: F.coalesce(x, F.lit(0.0))
    out = g.select(*by, variable, zero(F.try_divide("m", F.sum("m").over(w))).alias("mean_share"), zero(F.try_divide("s", F.sum("s").over(w))).alias("column_share"))
    return out.withColumn("is_top", F.row_number().over(w.orderBy(F.desc("mean_share"), variable)) == 1)


def importance(df: DataFrame, *, variable: str, level: str, value: str) -> DataFrame:
    """Percent of all absolute attribution by variable and by level, in one scan."""
    g = df.withColumn("_a", F.abs(value)).groupingSets([[F.col(variable)], [F.col(level)]], variable, level).agg(F.sum("_a").alias("total"), F.grouping_id().alias("_g"))
    share = 100 * F.col("total") / F.sum("total").over(Window.partitionBy("_g"))
    return g.select(F.when(F.col("_g") == 1, "variable").otherwise("level").alias("kind"), F.coalesce(F.col(variable).cast("string"), F.col(level).cast("string")).alias("name"), share.alias("percent"))


def permuted(df: DataFrame, column: str, *, key: str, seed: int = 0) -> DataFrame:
    """The column's values dealt to other rows in a seeded order, all rows kept: rows and values are ranked by two hashes
    of the key, over range partitions (ordered.running), and joined by rank."""
    def ranked(frame: DataFrame, order: Column) -> DataFrame:
        return ordered.running(frame.withColumn("_o", order), [F.col("_o"), F.col(key)], {"_at": F.lit(1)}).drop("_o", "all__at")

    deal = lambda name: F.md5(F.concat_ws("|", F.lit(str(name)), F.col(key).cast("string")))
    return ranked(df.drop(column), deal("own")).join(ranked(df.select(key, column), deal(seed)).drop(key), "_at").drop("_at")


def permutation_importance(df: DataFrame, columns: list[str], label: str, score: Callable[[DataFrame], Column], *, key: str, seed: int = 0) -> dict[str, float]:
    """By column, how much ROC-AUC falls (at least 0) when its values are permuted."""
    auc = lambda frame: metrics.roc_auc(frame, F.col(label), score(frame)).first()[0] or 0.0
    base = auc(df)
    return {c: max(0.0, base - auc(permuted(df, c, key=key, seed=seed))) for c in columns}


def flattened(attributions: Column, prefix: str) -> Column:
    """Map keys with a prefix."""
    return F.transform_keys(attributions, lambda k, _: F.concat(F.lit(prefix), k))


def by_prefix(properties: Column, prefix: str) -> Column:
    """(name, value) of a map's entries under a prefix, largest first (ties by name)."""
    found = F.map_filter(properties, lambda k, v: k.startswith(prefix) & v.isNotNull())
    rows = F.transform(F.map_entries(found), lambda e: F.struct((-e["value"]).alias("v"), F.substring(e["key"], len(prefix) + 1, 1000).alias("name")))
    return F.transform(F.array_sort(rows), lambda e: F.struct(e["name"].alias("name"), (-e["v"]).alias("value")))


def top_drivers(df: DataFrame, attributions: str, k: int = 7) -> DataFrame:
    """Mean attribution over the rows that have any, by name: the ``k`` largest."""
    some = df.where(F.size(attributions) > 0)
    n = some.agg(F.count("*").alias("rows"))
    summed = some.select(F.explode(attributions).alias("name", "value")).groupBy("name").agg(F.sum("value").alias("total"))
    one = lambda df: df.withColumn("_one", F.lit(1))  # noqa: E731  the count is a single row
    return one(summed).join(F.broadcast(one(n)), "_one").select("name", (F.col("total") / F.col("rows")).alias("mean")).orderBy(F.desc("mean"), "name").limit(k)


def second_derivative_extremes(df: DataFrame, *, by: list[str], at: str, value: str) -> DataFrame:
    """Where a series bends up and down most: the last point's second derivative doesn't count."""
    from .grid import gradient

    w = Window.partitionBy(*by).orderBy(at)
    first = df.withColumn("_d1", gradient(F.col(value), F.col(at), w))
    second = first.withColumns({"_d2": gradient(F.col("_d1"), F.col(at), w), "_last": F.lead(at).over(w).isNull()}).where("NOT _last")
    return second.groupBy(*by).agg(F.max_by(at, F.struct("_d2", -F.col(at))).alias("steepest_at"), F.min_by(at, F.struct("_d2", at)).alias("flattest_at"))
