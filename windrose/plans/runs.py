"""Whole runs as queries over the driver's tables: fields to hotspots, training samples, accumulation, kept statistics.

Parts are the cells of fields of 20 rows and 50 columns, a thousand to a cycle; suppliers and customers are storms.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import when
from ..operators import compositions, grid, learn, moments, polygons, training
from ..operators.lineage import shared_folder, shuffled
from ..sources.readers import table
from ..streaming import ledger
from .queries import customers, measures, scores, suppliers, verification

Q: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f):
    Q[f.__name__] = f
    return f


ROWS, COLUMNS = 20, 50
#: Channels of the fields: variable, mean, deviation, weight in the linear scorer of its mean and of its centre.
CHANNELS = [
    ("pressfc", 90000.0, 20000.0, -0.8, 0.0),
    ("landmask", 0.0, 1.0, 0.1, 0.0),
    ("rhprs", 65.0, 15.0, 1.2, 0.5),
    ("ugrdprs", 3.0, 2.0, 0.2, 0.0),
    ("vgrdprs", 2.0, 1.5, 0.1, 0.0),
    ("ugrdprs", 5.0, 3.0, 0.1, 0.0),
    ("vgrdprs", 6.0, 4.0, 0.1, 0.0),
    ("absvprs", 0.0, 1.5e-5, 0.7, 0.4),
    ("tmpsfc", 300.0, 2.5, 0.6, 0.0),
]
PLACES = {"pressfc": 0, "landmask": 1, "rhprs": 2, "u850": 3, "v850": 4, "u200": 5, "v200": 6, "absvprs": 7, "tmpsfc": 8}
BIAS = 0.3


def field_latitude(row: Column) -> Column:
    return (row - 10) * 3.0


def field_longitude(col: Column) -> Column:
    return col * 7.2


def fields(spark: SparkSession, d: str) -> DataFrame:
    """Cells (cycle, row, col, land, vorticity, stack) of the parts' fields."""
    k, size = F.col("p_partkey"), F.col("p_size")
    land, vorticity = (size % 10 == 0).cast("double"), (size - 25) * 1e-6
    values = [F.col("p_retailprice") * 60, land, size + 40.0, size % 7, size % 5, size % 11, size % 13, vorticity, 296 + size / 6]
    stack = F.array(*[v.cast("double") for v in values])
    return table(spark, d, "part").select(F.floor(k / 1000).cast("int").alias("cycle"), F.floor(k % 1000 / COLUMNS).cast("int").alias("row"), (k % COLUMNS).cast("int").alias("col"), land.alias("landmask"), vorticity.alias("vorticity"), (296 + size / 6).alias("warmth"), stack.alias("stack"))


def linear_scorer(x: np.ndarray) -> np.ndarray:
    """Confidence and two experts' scores of windows (n, side, side, channels); the first expert is missing over land."""
    mean, center = x.mean((1, 2)), x[:, x.shape[1] // 2, x.shape[2] // 2]
    squash = lambda z: 1 / (1 + np.exp(-z))
    whole = squash(BIAS + mean @ np.array([c[3] for c in CHANNELS]) + center @ np.array([c[4] for c in CHANNELS]))
    first = np.where(mean[:, 1] >= 0.18, np.nan, squash(0.5 + 0.9 * center[:, 2]))
    return np.stack([whole, first, squash(0.4 - 0.8 * mean[:, 0])], 1)


def linear_reasons(x: np.ndarray) -> np.ndarray:
    """Mean absolute input of each channel times its weight."""
    return np.abs(x).mean((1, 2)) * np.abs([c[3] for c in CHANNELS])


@query
def field_hotspots(spark: SparkSession, d: str) -> DataFrame:
    start = F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")
    k = F.col("skey")
    status = F.when(k % 5 == 0, "TS").when(k % 5 == 1, "DB").when(k % 5 == 2, "EX").when(k % 5 == 3, "INVEST").otherwise("HU")
    storms = suppliers(spark, d).select((k % 3).cast("int").alias("cycle"), k.cast("string").alias("storm_id"), status.alias("status"), F.col("slat").alias("system_latitude"), F.col("slon").alias("system_longitude"), when.plus_hours(start, (k % 48).cast("int")).alias("system_time"))
    cells = fields(spark, d)
    cells = cells.withColumn("candidate", F.abs(field_latitude(F.col("row"))).between(0, 25) & (F.col("landmask") <= 0.5) & (F.col("warmth") >= 298))
    found = compositions.field_scan(
        cells,
        storms,
        linear_scorer,
        channel=PLACES,
        variables=[c[0] for c in CHANNELS],
        columns=COLUMNS,
        radius=2,
        latitude=field_latitude,
        longitude=field_longitude,
        time=lambda cycle: when.plus_hours(start, 24 + 6 * cycle),
        learned=lambda c: F.when(c["key"] % 4 == 0, c["confidence"] * 0.7),
        at=0.6,
        least_expert=0.4,
        explain=linear_reasons,
        means=[c[1] for c in CHANNELS],
        stds=[c[2] for c in CHANNELS],
        km=900.0,
        match_km=700.0,
        top=20,
    )
    rounded = {c: F.round(c, 6).alias(c) for c in ("confidence", "distance_km", "land_fraction", "pressure_anomaly_pa", "shear_200_850_ms")}
    return found.select("cycle", F.col("rank").cast("long").alias("rank"), "key", "storm_id", *rounded.values(), F.round("hybrid_support", 9).alias("hybrid_support"), "system_class", F.round("class_confidence", 9).alias("class_confidence"))


@query
def tried_negatives(spark: SparkSession, d: str) -> DataFrame:
    """Each supplier is a file of one of the cycles' fields; the suppliers of its nation are its storms."""
    s = suppliers(spark, d)
    files = s.select(F.col("skey").alias("path"), (F.col("skey") % 2).cast("int").alias("cycle"))
    storms = s.select(F.col("skey").alias("path"), "nation").join(s.select("nation", F.col("slat").alias("latitude"), F.col("slon").alias("longitude")), "nation").select("path", "latitude", "longitude")
    found = training.tried_negatives(files, fields(spark, d), storms, key="path", field="cycle", band=(4, 15), columns=COLUMNS, latitude=field_latitude, longitude=field_longitude, half=2, most_land=0.12, km=600.0)
    return found.select("path", "nth", "prefers_hard", "row", "col", F.round("latitude", 6).alias("latitude"), F.round("longitude", 6).alias("longitude"), F.round("land_fraction", 6).alias("land_fraction"))


@query
def weighted_negatives(spark: SparkSession, d: str) -> DataFrame:
    cells = fields(spark, d).where("landmask = 0").select("cycle", "row", "col", F.abs("vorticity").alias("weight"))
    found = training.weighted_negatives(cells, key="cycle", cell=["row", "col"], weight="weight", count=60)
    return found.select("cycle", "row", "col", F.col("rank").cast("long").alias("rank"), "hard")


@query
def patch_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Customers are storms of their nation's file, suppliers the fixes of its time; cells are parts dealt to 25 files."""
    path = lambda n: F.concat(F.lit("f"), n.cast("string"))
    c, s = customers(spark, d), suppliers(spark, d)
    positives = c.select(path(F.col("nation")).alias("path"), F.col("nation").alias("time"), F.col("key").alias("sid"), F.col("lat").alias("latitude"), F.col("lon").alias("longitude"))
    fixes = s.select(F.col("nation").alias("time"), F.col("slat").alias("latitude"), F.col("slon").alias("longitude"))
    k = F.col("p_partkey")
    cells = table(spark, d, "part").select(path(k % 25).alias("path"), (((k * 7919) % 141 - 70).cast("double") / 2).alias("latitude"), ((k * 104729) % 360).cast("double").alias("longitude"))
    plan = training.pair_plan(positives, fixes, size=30.0, distances=[20.0, 30.0, 40.0], domain=(-35.0, 35.0, 5.0, 355.0), cells=cells, least_cells=2)
    counts = training.patch_cells(plan, cells, size=30.0, keys=["path", "sid", "kind"])
    whole = plan.join(shuffled(counts), ["path", "sid", "kind"], "left").withColumn("cells", F.coalesce("cells", F.lit(0).cast("long")))
    return whole.select("path", "sid", "kind", "shift", "angle", "cells", *[F.round(x, 6).alias(x) for x in ("latitude", "longitude", "south", "north", "west", "east")])


@query
def monthly_accumulation(spark: SparkSession, d: str) -> DataFrame:
    """Quarters of orders until three tenths of all are there, by two runs: the second goes on where the first stopped."""
    o = table(spark, d, "orders").select(F.concat(F.year("o_orderdate"), F.lit("-"), F.quarter("o_orderdate")).alias("part"), "o_orderkey", (F.col("o_orderstatus") == "F").alias("hit"))
    all_rows = o.count()
    names = [r[0] for r in o.select("part").distinct().orderBy("part").collect()]  # calendar quarters
    folder = shared_folder(spark, "accumulation")
    totals = {"rows": F.count("*"), "hits": F.count_if("hit")}
    for share in (1, 3):
        ledger.accumulate(spark, folder, names, lambda part: o.where(F.col("part") == part), totals=totals, enough=lambda t, share=share: 10 * t["rows"] >= share * all_rows)
    return ledger.Ledger(spark, folder).rows(o.schema).groupBy("part").agg(F.count("*").alias("rows"), F.count_if("hit").alias("hits"))


@query
def points_in_rings(spark: SparkSession, d: str) -> DataFrame:
    """Customers in the outline of each nation: twelve corners about a centre, less a hole of six."""
    n = F.col("n_nationkey")
    corner = lambda ring, count, v, radius: F.struct(F.lit(ring).alias("ring"), F.lit(v).alias("nth"), F.lit(2 * np.pi * v / count).alias("turn"), F.lit(float(radius)).alias("radius"))
    corners = F.explode(F.array(*[corner(0, 12, v, 14 + 7 * v % 5) for v in range(12)], *[corner(1, 6, v, 5) for v in range(6)])).alias("v")
    at = table(spark, d, "nation").select(n.alias("polygon"), (((n * 7919) % 61 - 30) + 0.25).alias("lat"), ((n * 104729) % 360 + 0.125).alias("lon"), corners)
    vertices = at.select("polygon", "v.ring", "v.nth", (F.col("lat") + F.col("v.radius") * F.sin("v.turn")).alias("latitude"), F.pmod(F.col("lon") + F.col("v.radius") * F.cos("v.turn"), F.lit(360.0)).alias("longitude"))
    return polygons.inside(customers(spark, d), polygons.edges(vertices, band=5.0), key=["key"], latitude="lat", longitude="lon", band=5.0)


@query
def kept_statistics(spark: SparkSession, d: str) -> DataFrame:
    """Moments of 97 files of line items, of which a tenth is revised and a tenth taken back, against a rescan."""
    m = measures(spark, d).withColumn("file", F.col("l_orderkey") % 97)
    kept = moments.by_file(m, file="file", by=["variable"], value="value")
    revised = moments.by_file(m.where("file % 10 = 3").withColumn("value", F.col("value") * 2 + 1), file="file", by=["variable"], value="value")
    left = moments.changed(kept, revised, m.where("file % 10 = 7").select("file").distinct())
    s = moments.merged(left, by=["variable"])
    return s.select("variable", "n", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"))


@query
def fold_numbers(spark: SparkSession, d: str) -> DataFrame:
    """Stratified folds of the labelled documents."""
    docs = scores(spark, d)
    return learn.folds(docs, "y", "doc_id", 5, seed=3).select("doc_id", "y", "fold")


@query
def axis_order(spark: SparkSession, d: str) -> DataFrame:
    """Where the mean price of the parts of a size doesn't ascend with the size, by brand."""
    p = table(spark, d, "part").select("p_brand", "p_size", F.round("p_retailprice").alias("price"))
    return grid.axis_faults(p, by=["p_brand"], index="p_size", at="price")


@query
def surface_candidates(spark: SparkSession, d: str) -> DataFrame:
    """Orders by month as fields of which the first candidate that a month has is taken."""
    o = table(spark, d, "orders").select(F.date_format("o_orderdate", "yyyy-MM-dd").alias("cycle"), F.concat_ws("-", "o_orderstatus", F.substring("o_orderpriority", 1, 1)).alias("variable"), F.col("o_totalprice").alias("value"))
    wanted = {"pressfc": ["P-1", "P-2", "O-1"], "tmpsfc": ["F-1", "F-2", "F-3"], "landmask": ["P-5"]}
    found = grid.first_available(o, wanted, by=["cycle"])
    counts = found.groupBy("cycle", "variable").agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total"))
    short = grid.lacking(found, list(wanted), by=["cycle"]).select("cycle", F.array_join("missing", ",").alias("missing"))
    return counts.join(short, "cycle", "left")


@query
def verified_sides(spark: SparkSession, d: str) -> DataFrame:
    """Both annotated sides of the verification of cycles: predictions with what they hit, events with what hit them."""
    p, e, _ = verification(spark, d)
    left = p.select("cycle", F.lit("prediction").alias("side"), F.col("cluster").alias("id"), F.col("event_id").alias("other"), "verification_status", F.col("matched_name").alias("name"), "cluster_support", F.round("confidence", 9).alias("confidence"))
    right = e.select("cycle", F.lit("event").alias("side"), F.col("event_id").alias("id"), F.col("cluster").alias("other"), "verification_status", F.col("event_name").alias("name"), F.lit(None).cast("long").alias("cluster_support"), F.lit(None).cast("double").alias("confidence"))
    return left.unionByName(right)


@query
def training_rows(spark: SparkSession, d: str) -> DataFrame:
    """Every row of an epoch: which candidates were drawn, how often, and in which batch."""
    c = customers(spark, d).select("key", "conf")
    return compositions.training_epoch(c.where("conf >= 9000").select("key"), c.where("conf < 9000").select("key"), key="key", ratio=3, epoch=1, batch=64).select("key", "label", "draw", "batch")
