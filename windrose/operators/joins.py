"""Joins in time and space.

Distance joins are equi-joins on grid cells: one side is copied into the cells that a circle can reach, so each pair
meets once and no cross join is made. Interval joins bucket time the same way. Skew is left to adaptive execution.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import geo, when
from .lineage import cut

#: Pairs of a group that one fold may hold; larger groups are matched in rounds.
FOLD_ROWS = 2000

KM_PER_DEGREE = math.pi * geo.EARTH_KM / 180


def _cells(df: DataFrame, lat: str, lon: str, size: float) -> DataFrame:
    return df.withColumns({"_row": geo.lat_cell(F.col(lat), size), "_col": geo.lon_cell(F.col(lon), size)})


def _reached(df: DataFrame, lat: str, lon: str, km: float, size: float) -> DataFrame:
    """Copies each row into all cells that a circle of ``km`` around it can touch, across the date line and the poles."""
    ring = int(round(360 / size))
    dlat = km / KM_PER_DEGREE
    low, high = F.col(lat) - dlat, F.col(lat) + dlat
    rows = F.sequence(geo.lat_cell(F.greatest(low, F.lit(-90.0)), size), geo.lat_cell(F.least(high, F.lit(90.0)), size))
    sine = F.sin(F.lit(min(km / geo.EARTH_KM, math.pi / 2))) / F.greatest(F.cos(F.radians(F.col(lat))), F.lit(1e-12))
    dlon = F.when((low <= -90) | (high >= 90) | (sine >= 1), 180.0).otherwise(F.degrees(F.asin(F.least(sine, F.lit(1.0)))) + 1e-9)
    first, last = F.floor((F.col(lon) - dlon) / size), F.floor((F.col(lon) + dlon) / size)
    columns = F.array_distinct(F.transform(F.sequence(first, F.least(last, first + ring - 1)), lambda c: F.pmod(c, F.lit(ring))))
    return df.withColumn("_row", F.explode(rows)).withColumn("_col", F.explode(columns))


def distance_join(left: DataFrame, right: DataFrame, km: float, *, left_at: tuple[str, str], right_at: tuple[str, str], on: list[str] | None = None, strict: bool = False, how: str = "inner", cell: float | None = None) -> DataFrame:
    """Pairs within ``km`` (under it, if ``strict``), with distance_km; or, for semi and anti joins, rows of ``left``.

    Column names of the two sides must differ but for those in ``on``. A null coordinate is near nothing. Cells are about
    as wide as the radius, from 1 to 30 degrees, unless ``cell`` (a divisor of 360) says otherwise.
    """
    if cell is None:
        cell = next(c for c in (1.0, 1.5, 2.0, 3.0, 5.0, 7.5, 10.0, 15.0, 30.0) if c >= min(30.0, km / KM_PER_DEGREE))
    distance = geo.haversine_km(F.col(left_at[0]), F.col(left_at[1]), F.col(right_at[0]), F.col(right_at[1]))
    close = distance < km if strict else distance <= km
    r = _reached(right.where(F.col(right_at[0]).isNotNull() & F.col(right_at[1]).isNotNull()), *right_at, km, cell)
    l = _cells(left, *left_at, cell)  # noqa: E741
    keys = ["_row", "_col", *(on or [])]
    r = r.withColumnsRenamed({k: f"_r_{k}" for k in keys})
    met = F.lit(True)
    for k in keys:
        met = met & (F.col(k) == F.col(f"_r_{k}"))
    joined = l.join(r, met & close, how)
    if how == "inner":
        joined = joined.withColumn("distance_km", distance)
    return joined.drop("_row", "_col", *[f"_r_{k}" for k in keys])


#: Keys of a position that travel as one array, and pairs of rows that one task writes out, about.
ARRAY_KEYS, TASK_PAIRS = 256, 4_000_000


def pairs_within(points: DataFrame, km: float, *, key: str, lat: str, lon: str, digits: int | None = None) -> DataFrame:
    """(key_a, key_b, distance_km, rounded to ``digits``) of all pairs of rows within ``km``, the lesser key first; keys are
    distinct.

    Positions are paired, so that a distance is computed once however many rows stand there; arrays of the rows' keys are
    then written out. As many tasks do that as the counted pairs ask for, so that none grows with the table.
    """
    plain = points.where(F.col(lat).isNotNull() & F.col(lon).isNotNull()).select(F.col(key).alias("_k"), F.col(lat).cast("double").alias("_lat"), F.col(lon).cast("double").alias("_lon"))
    spot = cut(plain.groupBy("_lat", "_lon").agg(F.count("*").alias("_n"), F.min("_k").alias("_s")))
    part = F.pmod(F.xxhash64("_k"), F.ceil(F.col("_n") / ARRAY_KEYS))
    arrays = cut(plain.join(spot, ["_lat", "_lon"]).groupBy("_s", part.alias("_p")).agg(F.collect_list("_k").alias("_keys")))
    other = spot.select(F.col("_s").alias("_t"), F.col("_n").alias("_m"), F.col("_lat").alias("_lat2"), F.col("_lon").alias("_lon2"))
    near = distance_join(spot, other, km, left_at=("_lat", "_lon"), right_at=("_lat2", "_lon2")).where("_s <= _t")
    shown = F.col("distance_km") if digits is None else F.round("distance_km", digits).alias("distance_km")
    near = cut(near.select("_s", "_t", shown, (F.col("_n") * F.col("_m")).alias("_pairs")))
    pairs = near.agg(F.coalesce(F.sum("_pairs"), F.lit(0))).first()[0]
    side = lambda name: arrays.select(F.col("_s").alias(name), F.col("_p").alias(f"{name}p"), F.col("_keys").alias(f"{name}k"))
    met = near.drop("_pairs").join(side("_s"), "_s").join(side("_t"), "_t")
    met = met.repartition(int(max(1, min(20_000, -(-pairs // TASK_PAIRS)))), "_s", "_t", "_sp", "_tp")
    written = met.select("_s", "_t", "distance_km", "_tk", F.explode("_sk").alias("_a")).select("_s", "_t", "distance_km", "_a", F.explode("_tk").alias("_b"))
    # a position with itself has each pair twice and each row with itself
    whole = written.where((F.col("_s") < F.col("_t")) | (F.col("_a") < F.col("_b")))
    return whole.select(F.least("_a", "_b").alias("key_a"), F.greatest("_a", "_b").alias("key_b"), "distance_km")


def interval_join(left: DataFrame, right: DataFrame, *, left_time: str, right_time: str, low_hours: float, high_hours: float, on: list[str] | None = None, bucket_hours: int = 24) -> DataFrame:
    """Pairs whose right time is from ``low_hours`` to ``high_hours`` after the left time; adds lead_hours."""
    bucket = lambda c: F.floor(F.unix_seconds(c.cast("timestamp")) / (bucket_hours * 3600))
    l = left.withColumn("_b", F.explode(F.sequence(bucket(F.col(left_time) + F.expr(f"interval '{low_hours * 3600:.6f}' second")), bucket(F.col(left_time) + F.expr(f"interval '{high_hours * 3600:.6f}' second")))))  # noqa: E741
    r = right.withColumn("_rb", bucket(F.col(right_time))).withColumnsRenamed({k: f"_r_{k}" for k in on or []})
    met = F.col("_b") == F.col("_rb")
    for k in on or []:
        met = met & (F.col(k) == F.col(f"_r_{k}"))
    lead = when.hours_between(F.col(right_time), F.col(left_time))
    return l.join(r, met & (lead >= low_hours) & (lead <= high_hours)).withColumn("lead_hours", lead).drop("_b", "_rb", *[f"_r_{k}" for k in on or []])


def lead_time_join(files: DataFrame, genesis: DataFrame, *, file_time: str, genesis_time: str, hours: int) -> DataFrame:
    """Files with the events that happen exactly ``hours`` later; files without any stay."""
    return files.join(genesis, when.plus_hours(F.col(file_time), hours) == F.col(genesis_time), "left")


def active_at(files: DataFrame, fixes: DataFrame, *, file_time: str, fix_time: str, lat: str, lon: str, storm: str) -> DataFrame:
    """Files with the positions (sorted by storm) of all storms that have a fix at their time."""
    gathered = fixes.groupBy(F.col(fix_time).alias("_t")).agg(F.sort_array(F.collect_list(F.struct(F.col(storm).alias("storm"), F.col(lat).alias("lat"), F.col(lon).alias("lon")))).alias("active"))
    return files.join(gathered, F.col(file_time) == F.col("_t"), "left").drop("_t").withColumn("is_active", F.col("active").isNotNull())


def exclusion(left: DataFrame, right: DataFrame, km: float, **options) -> DataFrame:
    """Rows of ``left`` with nothing of ``right`` closer than ``km``."""
    return distance_join(left, right, km, how="left_anti", strict=True, **options)


def box_exclusion(patches: DataFrame, fixes: DataFrame, *, time: str, fix_time: str, lat: str, lon: str, half: float) -> DataFrame:
    """Patches without a fix at their time inside their box; the box may cross the date line. A fix is copied into the
    cells that boxes around it reach, so a patch meets the fixes of its time nearby only."""
    size = 360.0 / max(1, int(360 // max(half, 1.0)))
    ring = int(round(360 / size))
    f = fixes.select(F.col(fix_time).alias("_t"), F.col(lat).alias("_lat"), F.col(lon).alias("_lon")).where("_lat IS NOT NULL AND _lon IS NOT NULL")
    rows = F.sequence(geo.lat_cell(F.col("_lat") - half, size), geo.lat_cell(F.col("_lat") + half, size))
    first, last = F.floor((geo.lon_360(F.col("_lon")) - half) / size) - 1, F.floor((geo.lon_360(F.col("_lon")) + half) / size) + 1
    columns = F.array_distinct(F.transform(F.sequence(first, F.least(last, first + ring - 1)), lambda c: F.pmod(c, F.lit(ring))))
    f = f.withColumn("_fr", F.explode(rows)).withColumn("_fc", F.explode(columns))
    p = patches.withColumns({"_row": geo.lat_cell(F.col(lat), size), "_col": F.pmod(geo.lon_cell(F.col(lon), size), F.lit(ring))})
    off = F.abs(geo.lon_180(F.col("_lon") - F.col(lon)))
    met = (F.col(time) == F.col("_t")) & (F.col("_row") == F.col("_fr")) & (F.col("_col") == F.col("_fc"))
    return p.join(f, met & (F.abs(F.col("_lat") - F.col(lat)) <= half) & (off <= half), "left_anti").drop("_row", "_col")


def nearest_with_age(left: DataFrame, systems: DataFrame, *, left_at: tuple[str, str], left_time: str, key: str, system_at: tuple[str, str], system_time: str, km_per_hour: float = 5.0, on: list[str] | None = None, most: int = 64) -> DataFrame:
    """Left rows with the system that is least in distance + ``km_per_hour`` * age (ties: least ``key``): its key,
    distance_km and age_hours, null without systems. A row or a system without a position or a time has none.

    All systems (of the same ``on``) count for a row. Groups of ``most`` systems at most travel as an array: a cycle's
    active storms are a few dozen. Of more, a row meets those within a radius first. Who has a system that isn't worse than
    the radius is done, as all others are farther away; the rest looks on with the radius doubled.
    """
    on = on or []
    item = F.struct(F.col(key).alias("key"), F.col(system_at[0]).alias("lat"), F.col(system_at[1]).alias("lon"), F.col(system_time).alias("time"))
    known = lambda at, time: F.col(at[0]).isNotNull() & F.col(at[1]).isNotNull() & F.col(time).isNotNull()
    keyed = systems.where(known(system_at, system_time))
    keyed = keyed if on else keyed.withColumn("_all", F.lit(0))
    names = on or ["_all"]
    sizes = keyed.groupBy(*names).agg(F.count("*").alias("_many"))
    large = cut(sizes.where(F.col("_many") > most))
    rows = left if on else left.withColumn("_all", F.lit(0))
    rated = F.when(known(left_at, left_time), F.array_min(F.transform("_systems", lambda s: F.struct(*_rating(s, left_at, left_time, km_per_hour)))))
    chosen = {key: F.col("_b.key"), "distance_km": F.col("_b.km"), "age_hours": F.col("_b.hours")}
    few = keyed.join(large, names, "left_anti").groupBy(*names).agg(F.collect_list(item).alias("_systems"))
    if large.isEmpty():
        best = rows.join(few, names, "left").withColumn("_b", rated)
    else:
        held = cut(rows.withColumn("_id", F.monotonically_increasing_id()))
        densest = large.agg(F.max("_many")).first()[0]
        place = [F.col(c).alias(f"_l_{c}") for c in dict.fromkeys([*left_at, left_time])]
        wanted = held.where(known(left_at, left_time)).join(large, names, "left_semi").select("_id", *names, *place)
        met = _nearest_by_rings(wanted, keyed.join(large, names, "left_semi").select(*names, item.alias("_s")), tuple(f"_l_{c}" for c in left_at), f"_l_{left_time}", km_per_hour, names, densest)
        best = held.join(met, "_id", "left").join(few, names, "left").withColumn("_b", F.coalesce("_b", rated)).drop("_id")
    return best.withColumns(chosen).drop("_systems", "_b", "_all")


#: Systems that the first radius around a row should hold, were they even over the globe.
RING_ROWS = 8


def _nearest_by_rings(rows: DataFrame, systems: DataFrame, left_at: tuple[str, str], left_time: str, km_per_hour: float, on: list[str], densest: int) -> DataFrame:
    """(_id, _b): the best system (_s) of each row. Rows whose best is within the radius are done."""
    half_turn = math.pi * geo.EARTH_KM
    km, out, left = min(half_turn, 2 * geo.EARTH_KM * math.sqrt(RING_ROWS / densest)), None, rows
    flat = systems.select(*on, "_s", F.col("_s.lat").alias("_slat"), F.col("_s.lon").alias("_slon"))
    while True:
        last = km >= half_turn
        reach = km * (1 + 1e-9) if last else km  # two ends of a diameter may be that little farther by rounding
        near = distance_join(left, flat, reach, left_at=left_at, right_at=("_slat", "_slon"), on=on)
        best = cut(near.groupBy("_id").agg(F.min(F.struct(*_rating(F.col("_s"), left_at, left_time, km_per_hour))).alias("_b")))
        done = best if last else best.where(F.col("_b.score") <= km)
        out = done if out is None else out.unionByName(done)
        if last:
            return out
        left = cut(left.join(done.select("_id"), "_id", "left_anti"))
        if left.isEmpty():
            return out
        km = min(2 * km, half_turn)


def _rating(s: Column, left_at: tuple[str, str], left_time: str, km_per_hour: float) -> list[Column]:
    km = geo.haversine_km(F.col(left_at[0]), F.col(left_at[1]), s["lat"], s["lon"])
    hours = F.abs(when.hours_between(F.col(left_time), s["time"]))
    return [(km + km_per_hour * hours).alias("score"), s["key"].alias("key"), km.alias("km"), hours.alias("hours")]


def greedy_match(pairs: DataFrame, *, group: list[str], left: str, right: str, distance: str) -> DataFrame:
    """One-to-one matches by ascending (distance, left, right), within each group.

    Groups of FOLD_ROWS pairs at most are folded as one array. In larger ones, a pair that comes first for both its ends
    is a match; its ends' other pairs go, and so on until no pair is left: the same matches, in few rounds.
    """
    plain = pairs.select(*group, left, right, distance)
    large = plain.groupBy(*group).agg(F.count("*").alias("_n")).where(F.col("_n") > FOLD_ROWS).select(*group)
    if large.isEmpty():
        return _folded_match(plain, group, left, right, distance)
    large = cut(large)
    out, rest = _folded_match(plain.join(large, group, "left_anti"), group, left, right, distance), cut(plain.join(large, group, "left_semi"))
    row = F.struct(F.col(distance).alias("d"), F.col(left).alias("l"), F.col(right).alias("r"))
    while not rest.isEmpty():
        firsts = lambda end: rest.groupBy(*group, end).agg(F.min(row).alias("m")).select(*group, "m.*")
        found = cut(firsts(left).join(firsts(right), [*group, "d", "l", "r"]).select(*group, F.col("l").alias(left), F.col("r").alias(right), F.col("d").alias(distance)))
        out = out.unionByName(found)
        rest = cut(rest.join(found.select(*group, left), [*group, left], "left_anti").join(found.select(*group, right), [*group, right], "left_anti").select(*group, left, right, distance))
    return out


#: Pairs that one band of distances should hold, for each row of the two sides, were positions even over the globe.
BAND_PAIRS = 4


def match_within(left: DataFrame, right: DataFrame, km: float, *, group: list[str], left_key: str, right_key: str, left_at: tuple[str, str], right_at: tuple[str, str], digits: int = 6) -> DataFrame:
    """What greedy_match makes of all pairs within ``km``, without these: (group, left_key, right_key, distance_km).

    Pairs come band by band, the nearest first, of what is still without a match; a longer pair can't take an end that a
    shorter one wants. Distances are compared as rounded to ``digits``. A band's radius follows from the numbers of rows
    that are left, so that it holds a few pairs for each row, and the last is ``km``.
    """
    at = lambda df, key, place: cut(df.where(F.col(place[0]).isNotNull() & F.col(place[1]).isNotNull()).select(*group, key, *place))
    l, r = at(left, left_key, left_at), at(right, right_key, right_at)  # noqa: E741
    number = lambda df, name: df.groupBy(*group).agg(F.count("*").alias(name))
    rows, out, near = l.count() + r.count(), None, 0.0
    while True:
        possible = number(l, "_l").join(number(r, "_r"), group).agg(F.sum(F.col("_l").cast("double") * F.col("_r"))).first()[0] or 0.0
        fits = 2 * geo.EARTH_KM * math.sqrt(BAND_PAIRS * rows / possible) if possible else km
        near = min(km, max(2 * near, fits, 1.0))
        pairs = distance_join(l, r, min(km, near + 10.0**-digits), left_at=left_at, right_at=right_at, on=group)
        pairs = pairs.select(*group, left_key, right_key, F.round("distance_km", digits).alias("distance_km"))
        if near < km:
            pairs = pairs.where(F.col("distance_km") <= near)
        found = cut(greedy_match(cut(pairs), group=group, left=left_key, right=right_key, distance="distance_km"))
        out = found if out is None else out.unionByName(found)
        if near >= km or not possible:
            return out
        l = cut(l.join(found.select(*group, left_key), [*group, left_key], "left_anti"))  # noqa: E741
        r = cut(r.join(found.select(*group, right_key), [*group, right_key], "left_anti"))


def _folded_match(pairs: DataFrame, group: list[str], left: str, right: str, distance: str) -> DataFrame:
    row = F.struct(F.col(distance).alias("d"), F.col(left).alias("l"), F.col(right).alias("r"))
    kind = pairs.select(row.alias("x")).schema["x"].dataType.simpleString()
    step = lambda acc, x: F.when(F.exists(acc, lambda m: (m["l"] == x["l"]) | (m["r"] == x["r"])), acc).otherwise(F.array_append(acc, x))
    matched = F.aggregate(F.array_sort(F.collect_list(row)), F.array().cast(f"array<{kind}>"), step)
    return pairs.groupBy(*group).agg(matched.alias("p")).select(*group, F.explode("p").alias("m")).select(*group, F.col("m.l").alias(left), F.col("m.r").alias(right), F.col("m.d").alias(distance))


def match_status(predictions: DataFrame, events: DataFrame, matches: DataFrame, *, prediction: str, event: str) -> tuple[DataFrame, DataFrame]:
    """Predictions marked HIT or FALSE_ALARM, events HIT or MISS, each with its match."""
    p = predictions.join(matches, prediction, "left").withColumn("verification_status", F.when(F.col(event).isNotNull(), "HIT").otherwise("FALSE_ALARM"))
    e = events.join(matches, event, "left").withColumn("verification_status", F.when(F.col(prediction).isNotNull(), "HIT").otherwise("MISS"))
    return p, e


def merge_exact(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """Inner join of two grids that must cover the same cells; ValueError if either lacks one."""
    both = left.select(*on).withColumn("_l", F.lit(1)).join(right.select(*on).withColumn("_r", F.lit(1)), on, "full").where("_l IS NULL OR _r IS NULL")
    if not both.isEmpty():
        raise ValueError("the grids differ in their coordinates")
    return left.join(right, on)


def reuse_cached(rows: DataFrame, cache: DataFrame, keys: list[str], values: list[str]) -> tuple[DataFrame, DataFrame]:
    """Rows that a cache has any of the values for, with these, and rows still to be computed."""
    found = rows.drop(*values).join(cache.select(*keys, *values), keys, "left")
    any_value = F.coalesce(*[F.col(v) for v in values]).isNotNull()
    return found.where(any_value), found.where(~any_value).drop(*values)


def keep_last(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The last row of each key in the order given."""
    reverse = [c.desc() for c in order]
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*reverse))).where("_n = 1").drop("_n")
