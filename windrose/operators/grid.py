"""Gridded fields in long form (cycle, row, column, value): windows, differences, interpolation, patches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import ordered
from .lineage import cut, small

# The channel order, variable by variable, of the 19 levels and the surface fields.
PRESSURE_VARIABLES = ["ugrdprs", "vgrdprs", "vvelprs", "tmpprs", "rhprs", "hgtprs", "absvprs"]
SURFACE_VARIABLES = ["pressfc", "capesfc", "tmpsfc", "landmask"]
LEVELS = [1000, 975, 950, 925, 900, 850, 800, 750, 700, 650, 600, 550, 500, 450, 400, 350, 300, 250, 200]


def channels() -> list[tuple[int, str, float | None]]:
    """(index, variable, level) of the 137 channels."""
    pairs = [(v, float(level)) for v in PRESSURE_VARIABLES for level in LEVELS] + [(v, None) for v in SURFACE_VARIABLES]
    return [(i, v, level) for i, (v, level) in enumerate(pairs)]


def standard_axes(df: DataFrame, *, cell: list[str], lon: str, position: str) -> DataFrame:
    """Longitudes in [0, 360); of cells that then coincide the first by position stays."""
    moved = df.withColumn(lon, F.pmod(F.col(lon), F.lit(360.0)))
    return moved.withColumn("_n", F.row_number().over(Window.partitionBy(*cell).orderBy(position))).where("_n = 1").drop("_n")


def validate_grid(df: DataFrame, *, variables: list[str] | None = None) -> None:
    """ValueError unless lat is within 90 degrees, lon in [0, 360), values are finite and all variables are there."""
    wanted = set(variables or PRESSURE_VARIABLES + SURFACE_VARIABLES)
    bad = lambda c: F.count_if(~F.coalesce(c, F.lit(False)))
    r = df.agg(F.collect_set("variable").alias("v"), bad(F.col("lat").between(-90, 90)).alias("lat"), bad((F.col("lon") >= 0) & (F.col("lon") < 360)).alias("lon"), bad(~F.isnan("value") & (F.abs("value") < float("inf"))).alias("value")).first()
    missing = sorted(wanted - set(r["v"]))
    if missing or r["lat"] or r["lon"] or r["value"]:
        raise ValueError(f"missing variables {missing}; bad lat {r['lat']}, lon {r['lon']}, value {r['value']}")


def first_available(df: DataFrame, wanted: dict[str, list[str]], *, by: list[str], variable: str = "variable") -> DataFrame:
    """The rows of each field's first candidate that a group (a cycle or file) has, under the field's name.

    ``wanted``: field to its candidates, best first. Rows of other variables are left out. What a group has is found from
    its distinct variables, so each row is looked at once; groups that lack a field have no rows of it (lacking()).
    """
    kinds = [F.struct(F.lit(field).alias("_field"), F.lit(name).alias(variable), F.lit(i).alias("_rank")) for field, names in wanted.items() for i, name in enumerate(names)]
    listed = df.sparkSession.range(1).select(F.explode(F.array(*kinds)).alias("k")).select("k.*")  # of fixed size
    there = df.select(*by, variable).distinct().join(F.broadcast(listed), variable)
    best = there.groupBy(*by, "_field").agg(F.min(F.struct("_rank", variable)).alias("_best")).select(*by, "_field", F.col(f"_best.{variable}").alias(variable))
    return df.join(best, [*by, variable]).withColumn(variable, F.col("_field")).drop("_field").select(*df.columns)


def lacking(df: DataFrame, wanted: list[str], *, by: list[str], variable: str = "variable") -> DataFrame:
    """(by, missing): groups that lack a variable, and which, sorted."""
    names = F.array(*[F.lit(w) for w in sorted(wanted)])
    return df.groupBy(*by).agg(F.array_except(names, F.collect_set(variable)).alias("missing")).where(F.size("missing") > 0)


def observed(df: DataFrame, *, levels: list[int] = LEVELS, name: str = "grid") -> tuple[DataFrame, Observation]:
    """The table, and what a run over it sees: counts of what is wrong and the variables there are, without a scan of its
    own. ``lev_i``, the place of a level in its file, is compared with ``levels`` where the table has it."""
    bad = lambda c: F.count_if(~F.coalesce(c, F.lit(False)))
    order = F.count_if(F.lit(False))
    if "lev_i" in df.columns:
        wanted = F.get(F.array(*[F.lit(float(x)) for x in levels]), F.col("lev_i").cast("int"))
        order = F.count_if(F.col("lev").isNotNull() & ~F.coalesce(wanted == F.col("lev"), F.lit(False)))
    seen = Observation(name)
    checks = [
        F.count(F.lit(1)).alias("rows"),
        F.collect_set("variable").alias("variables"),
        bad(F.col("lat").between(-90, 90)).alias("lat"),
        bad((F.col("lon") >= 0) & (F.col("lon") < 360)).alias("lon"),
        bad(~F.isnan("value") & (F.abs("value") < float("inf"))).alias("value"),
        order.alias("level_order"),
    ]
    return df.observe(seen, *checks), seen


def passed(seen: Observation, variables: list[str] | None = None) -> dict:
    """What an action on an observed() table has seen; ValueError if anything is wrong or a variable is missing."""
    got = seen.get
    missing = sorted(set(variables or PRESSURE_VARIABLES + SURFACE_VARIABLES) - set(got["variables"] or []))
    wrong = {k: got[k] for k in ("lat", "lon", "value", "level_order") if got[k]}
    if missing or wrong:
        raise ValueError(f"missing variables {missing}; wrong values {wrong}")
    return got


def axis_faults(df: DataFrame, *, by: list[str], index: str, at: str) -> DataFrame:
    """(by, index, reason) where an axis doesn't strictly ascend with its index, or an index has several positions. What is
    shuffled is a row for each position and task; an axis is as long as a grid is high or wide."""
    axis = df.groupBy(*by, index).agg(F.min(at).alias("_low"), F.max(at).alias("_high"))
    before = F.lag("_high").over(Window.partitionBy(*by).orderBy(index))
    reason = F.when(F.col("_low") != F.col("_high"), "several positions").when(F.col("_low") <= before, "not ascending").when(F.col("_low").isNull(), "no position")
    return axis.withColumn("reason", reason).where("reason IS NOT NULL").select(*by, index, "reason")


def complete_levels(df: DataFrame, levels: list[int] = LEVELS) -> DataFrame:
    """(cycle, variable) pairs whose levels are all there."""
    return df.groupBy("cycle", "variable").agg(F.collect_set("lev").alias("l")).where(F.size(F.array_except(F.array(*[F.lit(float(x)) for x in levels]), F.col("l"))) == 0).select("cycle", "variable")


def box_mean(df: DataFrame, radius: int, *, by: list[str], row: str, column: str, value: str, columns: int) -> DataFrame:
    """Mean over the square of side 2 * radius + 1 around each cell, columns around the date line, rows at the edge
    repeated. The square is summed by columns and then by rows, so each cell is shuffled once for either."""
    edge = df.select(*by, row, F.explode(F.array(*[F.lit(s * columns) for s in (-1, 0, 1)])).alias("_turn"), (F.col(column) + F.col("_turn")).alias("_c"), value, column)
    edge = edge.where(F.col("_c").between(-radius, columns - 1 + radius))
    across = Window.partitionBy(*by, row).orderBy("_c").rangeBetween(-radius, radius)
    summed = edge.withColumn("_s", F.sum(value).over(across)).where("_turn = 0").select(*by, row, column, value, "_s")
    along = Window.partitionBy(*by, column).orderBy(row)
    first, last = F.min(row).over(Window.partitionBy(*by, column)), F.max(row).over(Window.partitionBy(*by, column))
    window = along.rangeBetween(-radius, radius)
    out = summed.withColumns({"_t": F.sum("_s").over(window), "_lo": first, "_hi": last, "_first": F.first("_s").over(along), "_last": F.last("_s").over(along.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))})
    below = F.greatest(F.lit(0), F.col("_lo") - (F.col(row) - radius))
    above = F.greatest(F.lit(0), F.col(row) + radius - F.col("_hi"))
    total = F.col("_t") + below * F.col("_first") + above * F.col("_last")
    return out.select(*by, row, column, value, (total / float((2 * radius + 1) ** 2)).alias("box_mean"))


def anomaly(df: DataFrame, radius: int = 3, **at) -> DataFrame:
    """Value less its box mean."""
    return box_mean(df, radius, **at).withColumn("anomaly", F.col(at["value"]) - F.col("box_mean"))


def clipped_box_mean(df: DataFrame, radius: int, *, by: list[str], row: str, column: str, value: str, columns: int) -> DataFrame:
    """As box_mean, but over the rows there are."""
    edge = df.select(*by, row, F.explode(F.array(*[F.lit(s * columns) for s in (-1, 0, 1)])).alias("_turn"), (F.col(column) + F.col("_turn")).alias("_c"), value, column).where(F.col("_c").between(-radius, columns - 1 + radius))
    across = Window.partitionBy(*by, row).orderBy("_c").rangeBetween(-radius, radius)
    summed = edge.withColumns({"_s": F.sum(value).over(across), "_n": F.count(value).over(across)}).where("_turn = 0")
    along = Window.partitionBy(*by, column).orderBy(row).rangeBetween(-radius, radius)
    return summed.select(*by, row, column, value, (F.sum("_s").over(along) / F.sum("_n").over(along)).alias("box_mean"))


def gradient(value: Column, at: Column, order: Window) -> Column:
    """Finite difference along an ordered window: central inside, one-sided at the ends."""
    last, following = F.lag(value).over(order), F.lead(value).over(order)
    last_at, following_at = F.lag(at).over(order), F.lead(at).over(order)
    return (F.coalesce(following, value) - F.coalesce(last, value)) / (F.coalesce(following_at, at) - F.coalesce(last_at, at))


def divergence(df: DataFrame, *, by: list[str], lat: str, lon: str, u: str, v: str, radius_m: float = 6371008.8, floor: float = 0.10) -> DataFrame:
    """du/dx + dv/dy, the cosine of latitude held at ``floor`` at least."""
    dudl = gradient(F.col(u), F.radians(F.col(lon)), Window.partitionBy(*by, lat).orderBy(lon))
    dvdp = gradient(F.col(v), F.radians(F.col(lat)), Window.partitionBy(*by, lon).orderBy(lat))
    return df.withColumn("divergence", dudl / (radius_m * F.greatest(F.cos(F.radians(F.col(lat))), F.lit(floor))) + dvdp / radius_m)


def bilinear(points: DataFrame, grid: DataFrame, *, by: list[str], row: Column, column: Column, value: str = "value", key: str) -> DataFrame:
    """Values between cells (row, col) of a unit lattice; null where one of the four neighbours with weight is missing."""
    p = points.withColumns({"_r": row, "_c": column}).withColumns({"_r0": F.floor("_r"), "_c0": F.floor("_c")})
    corner = p.withColumn("_k", F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (0, 1) for j in (0, 1)])))
    side = lambda x, x0, k: F.when(k == 1, x - x0).otherwise(1 - (x - x0))
    corner = corner.withColumns({"_w": side(F.col("_r"), F.col("_r0"), F.col("_k.i")) * side(F.col("_c"), F.col("_c0"), F.col("_k.j")), "row": F.col("_r0") + F.col("_k.i"), "col": F.col("_c0") + F.col("_k.j")}).where("_w > 0")
    met = corner.join(grid.select(*by, F.col("row").cast("long").alias("row"), F.col("col").cast("long").alias("col"), F.col(value).alias("_v")), [*by, "row", "col"], "left")
    return met.groupBy(*by, key).agg(F.when(F.count("_v") == F.count("*"), F.sum(F.col("_w") * F.col("_v"))).alias(value))


def channel_stats(df: DataFrame, *, by: list[str], value: str, epsilon: float = 1e-6) -> DataFrame:
    """count, mean and standard deviation + ``epsilon`` of finite values."""
    return df.where(~F.isnan(value) & (F.abs(value) < float("inf"))).groupBy(*by).agg(F.count("*").alias("n"), F.avg(value).alias("mean"), (F.stddev_pop(value) + epsilon).alias("std"))


def sampled_stats(df: DataFrame, *, files: str, by: list[str], value: str, wanted: int = 400, floor: float = 1e-8) -> DataFrame:
    """Statistics by variable over every n-th file, about ``wanted`` of them; the variance is held at ``floor`` at least."""
    names = df.select(files).distinct()
    stride = max(1, names.count() // wanted)
    chosen = ordered.running(names, [F.col(files)], {"_n": F.lit(1)}).where((F.col("_n") - 1) % stride == 0).select(files)
    return df.join(chosen, files, "left_semi").groupBy(*by).agg(F.avg(value).alias("mean"), F.sqrt(F.greatest(F.var_pop(value), F.lit(floor))).alias("std"))


def normalised(df: DataFrame, stats: DataFrame, *, by: list[str], value: str) -> DataFrame:
    """(value - mean) / std, by the statistics of its key; these are counted and broadcast if they are few, as one row per
    channel is, so that the values aren't shuffled by channel."""
    return df.join(small(cut(stats.select(*by, "mean", "std"))), by).withColumn("z", (F.col(value) - F.col("mean")) / F.col("std")).drop("mean", "std")


def normalised_patch(patch: Column, mean: Column, std: Column, last: int = 136) -> Column:
    """Array by channel; channels from ``last`` on are left as they are."""
    z = F.transform(patch, lambda x, i: F.when(i < last, (x - F.element_at(mean, i + 1)) / F.element_at(std, i + 1)).otherwise(x))
    return F.transform(z, lambda x: F.when(F.isnan(x) | (F.abs(x) == float("inf")) | x.isNull(), 0.0).otherwise(x))


def stacked(df: DataFrame, *, by: list[str], index: str, value: str) -> DataFrame:
    """Arrays of channel values in the order of their index."""
    return df.groupBy(*by).agg(F.transform(F.sort_array(F.collect_list(F.struct(index, value))), lambda x: x[value]).alias("stack"))


def harmonised(df: DataFrame) -> DataFrame:
    """Units of a grid table (cycle, variable, units, value) made alike: humidity in %, pressure in Pa, geopotential as
    height, the land mask within 0 and 1."""
    from ..functions import physics

    top = F.max("value").over(Window.partitionBy("cycle", "variable"))
    v, u = F.col("value"), F.col("units")
    return df.withColumn("value", F.when(F.col("variable") == "rhprs", physics.relative_humidity_percent(v, u, top)).when(F.col("variable") == "pressfc", F.coalesce(physics.pressure_pa(v, u), v)).when(F.col("variable") == "hgtprs", F.coalesce(physics.geopotential_height(v, u), v)).when(F.col("variable") == "landmask", physics.clip01(v)).otherwise(v))


def environment(df: DataFrame, *, by: list[str]) -> DataFrame:
    """From the long form of a patch (variable, lev, value, is_center): land fraction, pressure anomaly, mid-level
    humidity, shear between 850 and 200 hPa, vorticity and surface temperature."""
    pick = lambda variable, *levels: F.avg(F.when((F.col("variable") == variable) & (F.col("lev").isin(*levels) if levels else F.lit(True)), F.col("value")))
    center = F.avg(F.when((F.col("variable") == "pressfc") & F.col("is_center"), F.col("value")))
    means = df.groupBy(*by).agg(pick("landmask").alias("land_fraction"), (center - pick("pressfc")).alias("pressure_anomaly_pa"), pick("rhprs", 700.0, 600.0, 500.0).alias("midlevel_rh_percent"), *[pick(f"{c}grdprs", lev).alias(f"_{c}{int(lev)}") for c in "uv" for lev in (850.0, 200.0)], pick("absvprs", 850.0).alias("vorticity_850_s1"), pick("tmpsfc").alias("surface_temperature_k"))
    return means.withColumn("shear_200_850_ms", F.hypot(F.col("_u200") - F.col("_u850"), F.col("_v200") - F.col("_v850"))).drop("_u850", "_u200", "_v850", "_v200")


def patches(cells: DataFrame, radius: int, columns: int) -> DataFrame:
    """Arrays (row by row) of the ``stack`` of the cells around each candidate cell of a cycle, columns around the date
    line; candidates with a missing cell around them are left out. A task holds a tile with its halo (tiles.patches)."""
    from . import tiles

    return tiles.patches(cells, radius, columns)


def scored(patch: DataFrame, scorer: Callable, columns: list[str], batch: int = 256) -> DataFrame:
    """Patches with a score column for each of ``columns``: ``scorer`` maps an array (n, ...) to (n, len(columns)). It
    travels to the workers once, as a broadcast; patches are views of Arrow's own values, all of one length."""
    import numpy as np
    import pyarrow as pa
    from pyspark.sql.types import DoubleType, StructType

    from .held import Held

    held = Held(patch.sparkSession, scorer)
    names, at = patch.columns, patch.columns.index("patch")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, batch):
                part = whole.slice(start, batch)
                x = part.column(at).flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, -1)
                got = np.asarray(held.value(x), float).reshape(part.num_rows, len(columns))
                yield pa.RecordBatch.from_arrays([*part.columns, *[pa.array(got[:, i]) for i in range(len(columns))]], names=[*names, *columns])

    schema = StructType(list(patch.schema.fields))
    for c in columns:
        schema = schema.add(c, DoubleType())
    return patch.mapInArrow(run, schema)
