"""Training samples from fields: hard negatives by tries or by weights, and pairs of positive and negative patches."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import draws, geo
from .lineage import cut, shuffled, small

# The directions in which negatives are looked for, in degrees counted from east against the clock.
DIRECTIONS = list(range(0, 360, 45))


def _excluded(places: DataFrame, storms: DataFrame, km: float, on: list[str], keys: list[str]) -> DataFrame:
    """Keys of the places that have a storm of their file nearer than ``km``."""
    far = geo.haversine_km(F.col("latitude"), F.col("longitude"), F.col("storm_latitude"), F.col("storm_longitude"))
    near = storms.select(*on, F.col("latitude").alias("storm_latitude"), geo.lon_360(F.col("longitude")).alias("storm_longitude"))
    return places.join(near, on).where(far < km).select(*on, *keys).distinct()


def tried_negatives(
    files: DataFrame,
    fields: DataFrame,
    storms: DataFrame,
    *,
    key: str,
    field: str,
    band: tuple[int, int],
    columns: int,
    latitude: Callable[[Column], Column],
    longitude: Callable[[Column], Column],
    half: int = 10,
    tries: int = 15,
    share: float = 0.70,
    least_vorticity: float = 1e-5,
    most_land: float = 0.3,
    km: float = 1000.0,
    seed: int = 0,
) -> DataFrame:
    """(key, nth, prefers_hard, row, col, latitude, longitude, land_fraction): for each file the first of up to ``tries``
    places drawn that will do; files without one are left out.

    ``files``: key and field; ``fields``: field, row, col, vorticity, landmask; ``storms``: key, latitude, longitude. A
    place lies in the rows of ``band`` (both included), ``half`` columns from either end at least. A ``share`` of the files
    wants a vorticity of ``least_vorticity`` or more in size. Land may take ``most_land`` of the patch, which ends at the
    field's edges; no storm of the file may be nearer than ``km``. Draws are hashes of seed, key and number of the try.

    Tries are rows: vorticity is one look-up for each, storms meet the tries of their own file, and patches are summed up
    for those that are left. Cells with no value don't count for land; a place without vorticity isn't hard.
    """
    drawn = files.select(key, field, F.explode(F.sequence(F.lit(0), F.lit(tries - 1))).alias("nth"))
    draw = lambda name, low, beyond: draws.whole(seed, low, beyond, F.lit(name), F.col(key), F.col("nth"))
    drawn = drawn.select(
        "*", (draws.uniform(seed, F.lit("hard"), F.col(key)) < share).alias("prefers_hard"), draw("row", band[0], band[1] + 1).alias("row"), draw("col", half, columns - half).alias("col")
    ).withColumns({"latitude": latitude(F.col("row")), "longitude": geo.lon_360(longitude(F.col("col")))})
    cell = fields.select(field, F.col("row").cast("int").alias("row"), F.col("col").cast("int").alias("col"), "vorticity", "landmask")
    spun = drawn.join(cell.select(field, "row", "col", "vorticity"), [field, "row", "col"], "left")
    spun = cut(spun.where(~F.col("prefers_hard") | F.coalesce(F.abs("vorticity") >= least_vorticity, F.lit(False))).drop("vorticity"))
    free = spun.join(_excluded(spun, storms, km, [key], ["nth"]), [key, "nth"], "left_anti")
    # of a file's tries the patches of those that are left are read, at most ``tries`` of them
    around = lambda c: F.explode(F.sequence(F.col(c) - half, F.col(c) + half)).alias(c)
    at = free.select(field, key, "nth", around("row"), "col").select(field, key, "nth", "row", around("col"))
    land = at.join(cell.select(field, "row", "col", "landmask"), [field, "row", "col"]).groupBy(key, "nth").agg(F.avg("landmask").alias("land_fraction"))
    good = free.join(land, [key, "nth"]).where(F.col("land_fraction") <= most_land)
    names = ["nth", "prefers_hard", "row", "col", "latitude", "longitude", "land_fraction"]
    return good.groupBy(key).agg(F.min(F.struct(*names)).alias("x")).select(key, *[F.col(f"x.{n}").alias(n) for n in names])


def weighted_negatives(candidates: DataFrame, *, key: str, cell: list[str], weight: str, count: int, share: float = 0.70, seed: int = 0) -> DataFrame:
    """``count`` candidates for each file at most, none twice: adds hard (whether it was drawn by weight) and rank.

    Each of a file's ``count`` draws is by ``weight`` with the chance ``share``, else even. Those by weight come first, the
    least of -ln(u) / w of a hashed u for each candidate (drawing without replacement); the even ones are the least
    hashes of the rest. A weight that is null, not finite, zero or negative can't be drawn by weight. Two rankings within
    a file, both with a limit that Spark applies before it shuffles; no row is counted over the whole table.
    """
    draw = lambda name: draws.uniform(seed, F.lit(name), F.col(key), *[F.col(c) for c in cell])
    w = F.col(weight).cast("double")
    able = w.isNotNull() & ~F.isnan(w) & (w > 0) & (w < float("inf"))
    wanted = F.aggregate(F.sequence(F.lit(1), F.lit(count)), F.lit(0), lambda acc, i: acc + (draws.uniform(seed, F.lit("kind"), F.col(key), i) < share).cast("int"))
    first = Window.partitionBy(key).orderBy("_by", *cell)
    # a file's number of draws by weight is drawn once, not with each of its candidates
    quota = candidates.select(key).distinct().select(F.col(key).alias("_file"), wanted.alias("_wanted"))
    rows = candidates.join(quota, F.col(key).eqNullSafe(F.col("_file"))).drop("_file").withColumn("_even", draw("even"))
    heavy = rows.where(able & (F.col("_wanted") > 0)).withColumn("_by", -F.ln(draw("weight")) / w)
    ranked = heavy.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= count).where("rank <= _wanted")
    chosen = cut(ranked.withColumn("hard", F.lit(True)).drop("_by", "_even"))
    taken = chosen.groupBy(F.col(key).alias("_file")).agg(F.count("*").cast("int").alias("_taken"))
    same = F.lit(True)
    for c in (key, *cell):
        same = same & F.col(c).eqNullSafe(F.col(f"_chosen_{c}"))
    rest = rows.join(chosen.select(*[F.col(c).alias(f"_chosen_{c}") for c in (key, *cell)]), same, "left_anti").withColumn("_by", F.col("_even"))
    even = rest.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= count)
    even = even.join(taken, F.col(key).eqNullSafe(F.col("_file")), "left").drop("_file").where(F.col("rank") <= count - F.col("_wanted")).withColumns({"rank": F.col("rank") + F.coalesce("_taken", F.lit(0)), "hard": F.lit(False)})
    return chosen.drop("_wanted").unionByName(even.drop("_by", "_even", "_wanted", "_taken"))


def patch_box(latitude: Column, longitude: Column, size: float, domain: tuple[float, float, float, float]) -> dict[str, Column]:
    """South, north, west and east of a patch of ``size`` degrees, moved back into the domain where it sticks out."""

    def moved(at: Column, low: float, high: float) -> tuple[Column, Column]:
        first, last = at - size / 2, at + size / 2
        shift = F.when(first < low, low - first).when(last > high, high - last).otherwise(0.0)
        # the far side follows from the near one, so that a patch moved to the domain's edge holds the cells on its other side
        return first + shift, first + shift + size

    south, north = moved(latitude, domain[0], domain[1])
    west, east = moved(longitude, domain[2], domain[3])
    return {"south": south, "north": north, "west": west, "east": east}


def pair_plan(
    positives: DataFrame,
    fixes: DataFrame,
    *,
    size: float,
    distances: list[float],
    domain: tuple[float, float, float, float],
    ocean: Callable[[DataFrame], DataFrame] | None = None,
    cells: DataFrame | None = None,
    least_cells: int = 1,
) -> DataFrame:
    """One row for each patch of each pair: path, sid, kind (positive or negative), latitude, longitude, south, north,
    west, east, and of a negative its shift and angle.

    ``positives``: path, time, sid, latitude, longitude; ``fixes``: time, latitude, longitude. Longitudes that aren't
    positive have 360 added. A positive must lie strictly inside ``domain`` (south, north, west, east); its negative is
    the first of the centres shifted by ``distances``, the largest first, in DIRECTIONS that lies strictly inside, for which
    ``ocean`` keeps the row (a function of a table with latitude and longitude), whose patch holds no fix of that time
    (bounds included) and, where ``cells`` (path, latitude, longitude) are given, at least ``least_cells`` of them. A
    positive without such a centre stays alone.

    Rows of one path, time and position share their centres, so that these are made once for a position. Centres are rows;
    fixes and cells in their patches are counted (patch_cells), not met one by one. Equal positives of a path and sid are
    one.
    """
    south, north, west, east = domain
    lon = lambda c: F.when(c > 0, c).otherwise(c + 360.0)
    inside = (F.col("latitude") > south) & (F.col("latitude") < north) & (F.col("longitude") > west) & (F.col("longitude") < east)
    place = positives.select("path", "time", "sid", F.col("latitude").cast("double").alias("latitude"), lon(F.col("longitude").cast("double")).alias("longitude"))
    place = cut(place.where(inside).dropDuplicates(["path", "sid"]))
    here = F.struct("path", "time", "latitude", "longitude").alias("_at")  # equal for nulls too
    spot = cut(place.select(here).distinct().withColumn("_spot", F.monotonically_increasing_id()))
    tries = spot.select("_spot", "_at.*", F.explode(F.array(*[F.struct(F.lit(i * len(DIRECTIONS) + j).alias("nth"), F.lit(float(d)).alias("shift"), F.lit(a).alias("angle")) for i, d in enumerate(sorted(distances, reverse=True)) for j, a in enumerate(DIRECTIONS)])).alias("t"))
    turn = F.radians(F.col("t.angle"))
    shifted = tries.select("path", "time", "_spot", "t.*", (F.col("latitude") + F.col("t.shift") * F.sin(turn)).alias("latitude"), F.pmod(F.col("longitude") + F.col("t.shift") * F.cos(turn), F.lit(360.0)).alias("longitude")).where(inside)
    if ocean is not None:
        shifted = ocean(shifted)
    boxed = cut(shifted.withColumns(patch_box(F.col("latitude"), F.col("longitude"), size, domain)))
    name, edges = ["_spot", "nth"], ["south", "north", "west", "east"]
    fix = fixes.select(F.col("time").alias("path"), "latitude", geo.lon_360(F.col("longitude")).alias("longitude"))
    held = patch_cells(boxed.select(F.col("time").alias("path"), *name, *edges), fix, size=size, keys=["path", *name])
    free = boxed.join(shuffled(held.select(*name)), name, "left_anti")
    if cells is not None:
        free = cut(free)
        enough = patch_cells(free, cells, size=size, keys=["path", *name]).where(F.col("cells") >= least_cells)
        free = free.join(shuffled(enough.select(*name)), name, "left_semi")
    box = ["latitude", "longitude", *edges]
    best = cut(free.groupBy("_spot").agg(F.min(F.struct("nth", "shift", "angle", *box)).alias("x")))
    negative = place.select("path", "sid", here).join(shuffled(spot.join(shuffled(best), "_spot")), "_at").select("path", "sid", F.lit("negative").alias("kind"), *[F.col(f"x.{c}").alias(c) for c in [*box, "shift", "angle"]])
    nothing = {"shift": F.lit(None).cast("double"), "angle": F.lit(None).cast("int")}
    positive = place.withColumns(patch_box(F.col("latitude"), F.col("longitude"), size, domain)).select("path", "sid", F.lit("positive").alias("kind"), *box).withColumns(nothing)
    return positive.unionByName(negative)


def in_patches(plan: DataFrame, cells: DataFrame, *, size: float, keys: list[str]) -> DataFrame:
    """Cells with the keys of every patch that holds them (bounds included): all patches of a tile of a file are one row,
    so that a cell is read and shuffled once, however many patches it is in. ``keys`` have path first."""
    number = lambda c: F.floor(c / F.lit(float(size)))
    over = lambda low, high: F.explode(F.sequence(number(F.col(low)), number(F.col(high))))
    rest = keys[1:]
    tiles = plan.select(*keys, "south", "north", "west", "east", over("south", "north").alias("_i")).withColumn("_j", over("west", "east"))
    boxes = tiles.groupBy("path", "_i", "_j").agg(F.collect_list(F.struct(*rest, "south", "north", "west", "east")).alias("_boxes"))
    placed = cells.withColumns({"_i": number(F.col("latitude")), "_j": number(F.col("longitude"))})
    inside = lambda b: F.col("latitude").between(b["south"], b["north"]) & F.col("longitude").between(b["west"], b["east"])
    met = placed.join(boxes, ["path", "_i", "_j"]).withColumn("_box", F.explode(F.filter("_boxes", inside)))
    return met.select(*[F.col(f"_box.{k}").alias(k) for k in rest], *cells.columns)


#: Patches and positions of cells of a tile that one task counts at a time.
TILE_PATCHES, TILE_POSITIONS = 200_000, 200_000


def patch_cells(plan: DataFrame, cells: DataFrame, *, size: float, keys: list[str]) -> DataFrame:
    """(keys, cells): how many cells each patch holds (bounds included); patches without any are left out. ``keys`` have
    path first.

    Equal patches of a file are counted once, cells of a position are one with their number, and patches meet the
    positions of their tiles in sorted arrays (_sums_within): a patch takes steps as the logarithm of a tile's positions,
    however many it holds. Tiles with more than TILE_PATCHES or TILE_POSITIONS are cut into as many parts as it takes.
    """
    number = lambda c: F.floor(c / F.lit(float(size)))
    over = lambda low, high: F.explode(F.sequence(number(F.col(low)), number(F.col(high))))
    box, tile = ["path", "south", "north", "west", "east"], ["path", "_i", "_j"]
    boxes = cut(plan.select(*box).distinct().withColumn("_box", F.monotonically_increasing_id()))
    tiles = boxes.select("*", over("south", "north").alias("_i")).withColumn("_j", over("west", "east"))
    place = [F.col(c).cast("double").alias(c) for c in ("latitude", "longitude")]
    there = cells.select("path", *place).where("path IS NOT NULL AND latitude IS NOT NULL AND longitude IS NOT NULL AND NOT isnan(latitude) AND NOT isnan(longitude)")
    spots = cut(there.groupBy("path", "latitude", "longitude").agg(F.count("*").alias("_n")).withColumns({"_i": number(F.col("latitude")), "_j": number(F.col("longitude"))}))
    parts = lambda df, most, name: df.groupBy(*tile).agg(F.ceil(F.count("*") / most).alias(name))
    sizes = small(cut(shuffled(parts(tiles, TILE_PATCHES, "_ps")).join(parts(spots, TILE_POSITIONS, "_qs"), tile)))
    part = lambda name, *of: F.pmod(F.xxhash64(*of), F.col(f"{name}s")).alias(name)
    each = lambda name: F.explode(F.sequence(F.lit(0).cast("long"), F.col(f"{name}s") - 1)).alias(name)
    left = tiles.join(sizes, tile).select(*tile, "_box", *box[1:], part("_p", "_box"), each("_q"))
    right = spots.join(sizes, tile).select(*tile, "latitude", "longitude", "_n", each("_p"), part("_q", "latitude", "longitude"))
    met = [*tile, "_p", "_q"]
    counted = left.groupBy(*met).cogroup(right.groupBy(*met)).applyInArrow(_counted, "_box long, _n long")
    sums = counted.groupBy("_box").agg(F.sum("_n").alias("cells")).where("cells > 0")
    return plan.select(*keys, *box[1:]).join(shuffled(boxes.join(shuffled(sums), "_box")), box).select(*keys, "cells")


def _counted(boxes: pa.Table, cells: pa.Table) -> pa.Table:
    column = lambda table, names: (table[c].to_numpy() for c in names)
    n = np.zeros(len(boxes), np.int64)
    if len(boxes) and len(cells):
        n = _sums_within(*column(cells, ("latitude", "longitude", "_n")), *column(boxes, ("south", "north", "west", "east")))
    return pa.table({"_box": boxes["_box"].combine_chunks().filter(pa.array(n > 0)), "_n": n[n > 0]})


def _sums_within(lat: np.ndarray, lon: np.ndarray, n: np.ndarray, south: np.ndarray, north: np.ndarray, west: np.ndarray, east: np.ndarray) -> np.ndarray:
    """For each box the sum of ``n`` of the points in it, bounds included. Points are sorted by latitude, so that a box takes
    a range of them; the ranks of their longitudes are then split bit by bit from the top, each split stable, and of the
    range what is below the box's bounds is added up (a wavelet matrix)."""
    order = np.argsort(lat, kind="stable")
    lat, n = lat[order], n[order]
    values, rank = np.unique(lon[order], return_inverse=True)
    first, last = np.searchsorted(lat, south, "left"), np.searchsorted(lat, north, "right")
    low, high = np.searchsorted(values, west, "left"), np.searchsorted(values, east, "right")
    levels = []
    for bit in reversed(range(len(values).bit_length())):
        one = (rank >> bit & 1).astype(bool)
        levels.append((bit, np.append(0, np.cumsum(~one)), np.append(0, np.cumsum(np.where(one, 0, n)))))
        rank, n = np.concatenate([rank[~one], rank[one]]), np.concatenate([n[~one], n[one]])

    def below(bound: np.ndarray) -> np.ndarray:
        total, a, b = np.zeros(len(bound), np.int64), first, np.maximum(first, last)
        for bit, zeros, sums in levels:
            up = (bound >> bit & 1).astype(bool)
            total += np.where(up, sums[b] - sums[a], 0)
            a, b = (np.where(up, zeros[-1] + x - zeros[x], zeros[x]) for x in (a, b))
        return total

    return below(np.maximum(low, high)) - below(low)
