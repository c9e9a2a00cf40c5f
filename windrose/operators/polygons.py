"""Points in polygons by crossings: edges are tabled by bands of latitude, and a point meets the edges of its own band."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .lineage import SMALL_ROWS, cut


def edges(vertices: DataFrame, *, band: float = 1.0) -> DataFrame:
    """(polygon, band, y1, x1, y2, x2) of the edges of rings, each in every band it reaches and on every turn of the globe
    that a longitude in [0, 360) can meet.

    ``vertices``: polygon, ring, nth, latitude, longitude; the last vertex of a ring joins the first, whether it repeats
    it or not. An edge takes the shorter way around, so rings may cross the date line; a ring around a pole must be
    closed along a meridian. Holes are rings of their own. Vertices without a position are left out; an edge along a
    parallel crosses nothing and is left out too.
    """
    ring = Window.partitionBy("polygon", "ring")
    ordered = ring.orderBy("nth")
    plain = vertices.where("latitude IS NOT NULL AND longitude IS NOT NULL")
    x, before = F.col("longitude"), F.lag("longitude").over(ordered)
    step = F.pmod(x - before + 180, F.lit(360.0)) - 180  # the shorter way from the vertex before
    unrolled = plain.withColumn("_x", F.sum(F.coalesce(step, F.pmod(x, F.lit(360.0)))).over(ordered.rowsBetween(Window.unboundedPreceding, 0)))
    whole = ordered.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    following = F.coalesce(F.lead(F.struct("latitude", "_x")).over(ordered), F.first(F.struct("latitude", "_x")).over(whole))
    ends = {"low": F.min("_x").over(ring), "high": F.max("_x").over(ring)}
    sides = unrolled.withColumns({"_n": following, **ends}).select("polygon", "low", "high", F.col("latitude").alias("y1"), F.col("_x").alias("x1"), F.col("_n.latitude").alias("y2"), F.col("_n._x").alias("x2")).where("y1 <> y2")
    # a turn is made of all edges of a ring or of none: an incomplete ring would count wrong
    turns = sides.withColumn("_turn", F.explode(F.sequence(F.ceil(-F.col("high") / 360).cast("int"), (F.ceil((360 - F.col("low")) / 360) - 1).cast("int"))))
    turned = turns.withColumns({"x1": F.col("x1") + 360.0 * F.col("_turn"), "x2": F.col("x2") + 360.0 * F.col("_turn")}).where(F.greatest("x1", "x2") >= 0)
    number = lambda c: F.floor(c / F.lit(float(band)))
    bands = F.explode(F.sequence(number(F.least("y1", "y2")), number(F.greatest("y1", "y2"))))
    return turned.select("polygon", bands.alias("band"), "y1", "x1", "y2", "x2")


def crosses(latitude: Column, longitude: Column, edge: Column) -> Column:
    """Whether the way east from a point meets an edge; an edge holds its lower end, not its upper one."""
    y1, x1, y2, x2 = (edge[c] for c in ("y1", "x1", "y2", "x2"))
    return ((y1 > latitude) != (y2 > latitude)) & (longitude < x1 + (latitude - y1) * (x2 - x1) / (y2 - y1))


def inside(points: DataFrame, sides: DataFrame, *, key: list[str], latitude: str = "latitude", longitude: str = "longitude", band: float = 1.0) -> DataFrame:
    """(key, polygon) of the points in each polygon: an odd number of edges stands east of them. ``sides`` are of edges()
    with the same ``band``. Points without a position are in none; points on an edge count as the rule of crosses() has it.

    A polygon's edges in a band are one array, and crossings are counted where a point meets it: points aren't grouped.
    """
    x, y = "_longitude", "_latitude"
    place = points.where(F.col(latitude).isNotNull() & F.col(longitude).isNotNull()).select(*key, F.col(latitude).cast("double").alias(y), F.pmod(F.col(longitude).cast("double"), F.lit(360.0)).alias(x))
    held = cut(sides.select("polygon", "band", "y1", "x1", "y2", "x2"))
    arrays = held.groupBy("polygon", "band").agg(F.collect_list(F.struct("y1", "x1", "y2", "x2")).alias("_edges"))
    if held.count() <= SMALL_ROWS:
        arrays = F.broadcast(arrays)
    crossed = F.size(F.filter("_edges", lambda e: crosses(F.col(y), F.col(x), e)))
    return place.withColumn("band", F.floor(F.col(y) / F.lit(float(band)))).join(arrays, "band").where(crossed % 2 == 1).select(*key, "polygon")


def on_ocean(points: DataFrame, sides: DataFrame, *, key: list[str], band: float = 1.0, land: bool = False, **at) -> DataFrame:
    """The points in any polygon of an ocean, or, with ``land``, those in none of the polygons of land."""
    found = inside(points, sides, key=key, band=band, **at).select(*key).distinct()
    return points.join(found, key, "left_anti" if land else "left_semi")
