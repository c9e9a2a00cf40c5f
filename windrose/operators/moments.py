"""Channel statistics kept by file: mergeable moments, so that files come and go without a rescan of the others."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import physics


def by_file(df: DataFrame, *, file: str, by: list[str], value: str) -> DataFrame:
    """(file, by, n, mean, m2) of the finite values: their number, mean, and squared distance from the mean."""
    x = physics.finite(F.col(value))
    g = df.groupBy(F.col(file).alias("file"), *by).agg(F.count(x).alias("n"), F.avg(x).alias("mean"), F.var_pop(x).alias("_v"))
    return g.where("n > 0").select("file", *by, "n", "mean", (F.col("_v") * F.col("n")).alias("m2"))


def changed(kept: DataFrame, added: DataFrame, removed: DataFrame | None = None) -> DataFrame:
    """The moments of the files that are left: those of ``removed`` (file) go, and of a file that is in ``added`` the new
    ones stand. Only moments are read, one row for each file and channel."""
    gone = added.select("file") if removed is None else added.select("file").unionByName(removed.select("file"))
    return kept.join(gone.distinct(), "file", "left_anti").unionByName(added)


def merged(moments: DataFrame, *, by: list[str], epsilon: float = 1e-6, floor: float | None = None) -> DataFrame:
    """(by, n, mean, std) over all files: std is the population deviation plus ``epsilon``, or, with ``floor``, the root of
    the variance held at ``floor`` at least.

    The whole's squared distance is the sum of the files' own and of each mean's distance from the whole's mean times its
    number; it is added up from the means' variance, weighed by numbers, without the differences of large squares.
    """
    n, mean = F.sum("n"), F.sum(F.col("n") * F.col("mean")) / F.sum("n")
    whole = moments.groupBy(*by).agg(n.alias("_n"), mean.alias("_mean"))
    far = moments.join(whole, by).groupBy(*by).agg(F.first("_n").alias("n"), F.first("_mean").alias("mean"), (F.sum(F.col("m2") + F.col("n") * (F.col("mean") - F.col("_mean")) ** 2)).alias("m2"))
    variance = F.col("m2") / F.col("n")
    std = F.sqrt(variance) + epsilon if floor is None else F.sqrt(F.greatest(variance, F.lit(floor)))
    return far.select(*by, "n", "mean", std.alias("std"))


def statistics_text(stats: DataFrame, order: list[tuple[int, str, float | None]], *, name: str = "channel") -> tuple[list[float], list[float]]:
    """Means and deviations in channel order, as they are stored; ValueError if a channel has none. ``stats`` has a row for
    each channel's index (``name``); a land mask without statistics is left as it is (mean 0, deviation 1)."""
    rows = {r[name]: (r["mean"], r["std"]) for r in stats.select(name, "mean", "std").collect()}  # one row for each channel
    lacking = [variable for i, variable, _ in order if i not in rows and variable != "landmask"]
    if lacking:
        raise ValueError(f"no statistics of {lacking[:10]}")
    both = [rows.get(i, (0.0, 1.0)) for i, _, _ in order]
    return [m for m, _ in both], [s for _, s in both]
