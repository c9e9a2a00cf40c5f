"""Detections: gates, suppression, density clustering, representatives, top-k."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import geo, physics
from .components import components
from .lineage import cut, small

#: Detections of a group that one fold may hold; larger groups are decided in rounds.
FOLD_ROWS = 2000


def score_gate(ensemble: Column, cnn: Column, vit: Column, at: float, least_expert: float) -> Column:
    """Ensemble at its threshold and both experts at theirs."""
    return (ensemble >= at) & (cnn >= least_expert) & (vit >= least_expert)


def available_gate(ensemble: Column, cnn: Column, vit: Column, at: float, least_expert: float) -> Column:
    """As score_gate, but a missing expert doesn't count against a row."""
    return (ensemble >= at) & F.coalesce(F.least(cnn, vit) >= least_expert, F.lit(True))


def suppress(df: DataFrame, km: float, *, by: list[str], lat: str, lon: str, confidence: str, key: str, top: int | None = None) -> DataFrame:
    """Greedy non-maximum suppression by group: by falling confidence (ties: least key), a row stays if it is farther
    than ``km`` from all that stay; rows without a position are near nothing. At most ``top`` stay.

    Of rows at one position only the first can stay, so that the others go at once. Groups of FOLD_ROWS rows at most are
    folded as one array; of larger ones the first FOLD_ROWS are, then what lies within ``km`` of those that stay goes, and
    so on (_in_turns), with the same result."""
    plain = df.select(*by, key, lat, lon, confidence)
    placed = F.col(lat).isNotNull() & F.col(lon).isNotNull()
    first = plain.where(placed).groupBy(*by, lat, lon).agg(F.min(F.struct((-F.col(confidence)).alias("c"), F.col(key).alias("k"))).alias("x"))
    rows = cut(first.select(*by, F.col("x.k").alias(key), lat, lon, (-F.col("x.c")).alias(confidence)).unionByName(plain.where(~placed)))
    large = rows.groupBy(*by).agg(F.count("*").alias("_n")).where(F.col("_n") > FOLD_ROWS).select(*by)
    if large.isEmpty():
        kept = _folded(rows, km, by, lat, lon, confidence, key)
    else:
        large = cut(large)
        kept = _folded(_without(rows, large, by), km, by, lat, lon, confidence, key).unionByName(_in_turns(_without(rows, large, by, "left_semi"), km, by, lat, lon, confidence, key, top))
    ranked = kept.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc(confidence), key)))
    return (ranked if top is None else ranked.where(F.col("rank") <= top)).select(*by, "rank", key, lat, lon, confidence)


def _without(df: DataFrame, other: DataFrame, keys: list[str], how: str = "left_anti") -> DataFrame:
    """Rows of ``df`` whose keys, nulls among them, aren't (or, left_semi, are) in ``other``."""
    same = F.lit(True)
    for c in keys:
        same = same & F.col(c).eqNullSafe(F.col(f"_o_{c}"))
    return df.join(other.select(*[F.col(c).alias(f"_o_{c}") for c in keys]), same, how)


def _in_turns(rows: DataFrame, km: float, by: list[str], lat: str, lon: str, confidence: str, key: str, top: int | None) -> DataFrame:
    """What suppression keeps of large groups. The first FOLD_ROWS rows of a group are decided as one array; then they and
    the rows near those that stay go, and groups with ``top`` rows are done. Where a turn leaves more than half of the rows,
    few are near the first ones: the rest is decided in cells (_by_pairs). What no longer fills an array is folded at once."""
    from .joins import distance_join

    order = Window.partitionBy(*by).orderBy(F.desc(confidence), key)
    names, kept, rest = [*by, key], None, cut(rows)
    sizes = lambda: rest.groupBy(*by).agg(F.count("*").alias("_n")).agg(F.coalesce(F.sum("_n"), F.lit(0)), F.coalesce(F.max("_n"), F.lit(0))).first()
    left, most = sizes()
    while most > FOLD_ROWS:
        head = cut(rest.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= FOLD_ROWS).drop("_n"))
        found = cut(_folded(head, km, by, lat, lon, confidence, key))
        kept = found if kept is None else kept.unionByName(found)
        rest = _without(rest, head, names)
        if top is not None:
            rest = _without(rest, kept.groupBy(*by).agg(F.count("*").alias("_n")).where(F.col("_n") >= top), by)
        group = F.struct(*by).alias("_g")  # equal for nulls too
        stay = small(found.select(group, F.col(lat).alias("_lat"), F.col(lon).alias("_lon")))
        rest = cut(distance_join(rest.select("*", group), stay, km, left_at=(lat, lon), right_at=("_lat", "_lon"), on=["_g"], how="left_anti").drop("_g"))
        before, (left, most) = left, sizes()
        if left > before / 2 and most > FOLD_ROWS:
            return kept.unionByName(_by_pairs(rest, km, by, lat, lon, confidence, key))
    last = _folded(rest, km, by, lat, lon, confidence, key)
    return last if kept is None else kept.unionByName(last)


def _by_pairs(rows: DataFrame, km: float, by: list[str], lat: str, lon: str, confidence: str, key: str) -> DataFrame:
    """What suppression keeps, by pairs of the first rows of cells (_celled), a bounded number for each cell however dense.

    All rows of a cell are within ``km`` of its first row. So that one stays if no earlier first row is within ``km`` of it,
    nor within twice that if its cell has more rows; then what lies near those that stay goes, and so on until no group
    has more than FOLD_ROWS rows."""
    from .joins import distance_join

    placed = F.col(lat).isNotNull() & F.col(lon).isNotNull()
    names, kept = rows.columns, rows.where(~placed)
    rest = cut(_celled(rows.where(placed), max(km, 1e-6), lat, lon).select(*names, F.struct(*by).alias("_g"), "_i", "_j"))
    while not rest.groupBy("_g").count().where(F.col("count") > FOLD_ROWS).isEmpty():
        row = F.struct((-F.col(confidence)).alias("c"), F.col(key).alias("k"), F.col(lat).alias("lat"), F.col(lon).alias("lon"))
        first = cut(rest.groupBy("_g", "_i", "_j").agg(F.min(row).alias("_x"), F.count("*").alias("_n")).select("_g", "_x", F.col("_x.lat").alias("_lat"), F.col("_x.lon").alias("_lon"), "_n"))
        other = first.select("_g", F.col("_x").alias("_x2"), F.col("_lat").alias("_lat2"), F.col("_lon").alias("_lon2"), F.col("_n").alias("_n2"))
        met = distance_join(first, other, 2 * km * (1 + 1e-9), left_at=("_lat", "_lon"), right_at=("_lat2", "_lon2"), on=["_g"])
        after = met.where((F.col("_x2") < F.col("_x")) & ((F.col("distance_km") <= km) | (F.col("_n2") > 1))).select("_g", "_x")
        stay = small(cut(first.join(after, ["_g", "_x"], "left_anti").select("_g", "_x", "_lat", "_lon")))
        kept = kept.unionByName(stay.select(*[F.col(f"_g.{c}").alias(c) for c in by], F.col("_x.k").alias(key), F.col("_lat").alias(lat), F.col("_lon").alias(lon), (-F.col("_x.c")).alias(confidence)))
        rest = cut(distance_join(rest, stay, km, left_at=(lat, lon), right_at=("_lat", "_lon"), on=["_g"], how="left_anti"))
    return kept.unionByName(_folded(rest.select(*names), km, by, lat, lon, confidence, key))


def _folded(df: DataFrame, km: float, by: list[str], lat: str, lon: str, confidence: str, key: str) -> DataFrame:
    """What suppression keeps of groups that fit in an array. They are dealt to as many tasks as their rows ask for: their
    bytes are few, so that Spark alone would fold all of them in one."""
    dealt = df.repartition(int(max(1, min(20_000, -(-df.count() // FOLD_ROWS)))), *by)
    p, q = F.radians(F.col(lat)), F.radians(F.col(lon))
    place = [(F.cos(p) * F.cos(q)).alias("x"), (F.cos(p) * F.sin(q)).alias("y"), F.sin(p).alias("z")]
    row = F.struct((-F.col(confidence)).alias("c"), F.col(key).alias("k"), F.col(lat).alias("lat"), F.col(lon).alias("lon"), *place)
    kind = df.select(row.alias("x")).schema["x"].dataType.simpleString()
    # most rows are that far by their unit vectors already, well beyond what these round
    beyond = math.cos(min(km / geo.EARTH_KM, math.pi)) - 1e-9
    surely = lambda m, x: m["x"] * x["x"] + m["y"] * x["y"] + m["z"] * x["z"] < beyond
    far = lambda acc, x: F.forall(acc, lambda m: surely(m, x) | F.coalesce(geo.haversine_km(m["lat"], m["lon"], x["lat"], x["lon"]) > km, F.lit(True)))
    step = lambda acc, x: F.when(far(acc, x), F.array_append(acc, x)).otherwise(acc)
    kept = dealt.groupBy(*by).agg(F.aggregate(F.sort_array(F.collect_list(row)), F.array().cast(f"array<{kind}>"), step).alias("kept")).select(*by, F.explode("kept").alias("m"))
    return kept.select(*by, F.col("m.k").alias(key), F.col("m.lat").alias(lat), F.col("m.lon").alias(lon), (-F.col("m.c")).alias(confidence))


def _celled(df: DataFrame, km: float, lat: str, lon: str) -> DataFrame:
    """Adds the cell (_i, _j) of a position and the cell's centre; any two positions of a cell are within ``km``."""
    tall = math.degrees(math.sqrt(2.0) * math.sin(min(km / (2 * geo.EARTH_KM), 1.0)))
    i = F.floor(F.col(lat) / tall)
    edge = F.least(F.abs(i * tall), F.abs((i + 1) * tall))  # the latitude of a band that lies nearest to the equator
    widest = F.when(i * tall * (i + 1) * tall <= 0, 1.0).otherwise(F.cos(F.radians(F.least(edge, F.lit(90.0)))))
    around = F.greatest(F.lit(1), F.ceil(360.0 * widest / tall))
    wide = 360.0 / around
    j = F.floor(geo.lon_360(F.col(lon)) / wide)
    center = F.greatest(F.lit(-90.0), F.least(F.lit(90.0), (i + 0.5) * tall))
    return df.withColumns({"_i": i, "_j": j, "_clat": center, "_clon": geo.lon_180((j + 0.5) * wide)})


def density_clusters(points: DataFrame, km: float, least: int, *, key: str, lat: str, lon: str, on: list[str] | None = None) -> DataFrame:
    """(on, key, cluster): points with ``least`` points (themselves counted) within ``km`` are cores; cores within reach
    share a cluster, named by its least core; other points near a core join the least cluster near them; the rest is
    left out, as are points without a position.

    Points at one position are one row with their number. A cell is so small that its points are all within reach: one
    with ``least`` of them is core as a whole and one unit. Only the positions of other cells, fewer than ``least`` in each,
    are paired with what is around them. Units of two cells are linked if the members nearest to each other's centre are
    within reach; what then still lies in different clusters side by side is compared member by member.
    """
    on = on or []
    spot = points.where(F.col(lat).isNotNull() & F.col(lon).isNotNull()).groupBy(*on, lat, lon).agg(F.min(key).alias("_k"), F.count("*").alias("_n"))
    spot = _celled(spot, km, lat, lon)
    cell = [*on, "_i", "_j"]
    full = spot.groupBy(*cell).agg(F.sum("_n").alias("_m"), F.min("_k").alias("_unit")).where(F.col("_m") >= least).drop("_m")
    spot = cut(spot.join(full, cell, "left"))
    other = spot.select(*on, F.col("_k").alias("_k2"), F.col("_n").alias("_n2"), F.col("_unit").alias("_unit2"), F.col(lat).alias("_lat2"), F.col(lon).alias("_lon2"))
    from .joins import distance_join

    alone = spot.where("_unit IS NULL").select(*on, "_k", lat, lon)
    near = cut(distance_join(alone, other, km, left_at=(lat, lon), right_at=("_lat2", "_lon2"), on=on).select(*on, "_k", "_k2", "_n2", "_unit2"))
    cores = cut(near.groupBy(*on, "_k").agg(F.sum("_n2").alias("n")).where(F.col("n") >= least).select(*on, "_k"))
    cores = small(cores)
    core2 = cores.withColumnRenamed("_k", "_k2").withColumn("_core2", F.lit(True))
    around = cut(near.join(core2, [*on, "_k2"], "left").select(*on, "_k", F.coalesce("_unit2", F.when(F.col("_core2"), F.col("_k2"))).alias("_unit2")).where("_unit2 IS NOT NULL"))
    end = lambda unit: F.struct(*on, F.col(unit).alias("unit"))
    links = around.join(cores, [*on, "_k"], "left_semi").select(end("_k").alias("a"), end("_unit2").alias("b"))
    dense = spot.where("_unit IS NOT NULL")
    hub = small(cut(dense.groupBy(*on, "_unit").agg(F.first("_clat").alias("_clat"), F.first("_clon").alias("_clon"))))
    second = hub.withColumnsRenamed({"_unit": "_unit2", "_clat": "_clat2", "_clon": "_clon2"})
    # members of a cell are within half of km of its centre
    beside = cut(distance_join(hub, second, 2.0 * km + 1e-6, left_at=("_clat", "_clon"), right_at=("_clat2", "_clon2"), on=on).where("_unit <> _unit2").drop("distance_km"))
    away = geo.haversine_km(F.col(lat), F.col(lon), F.col("_clat2"), F.col("_clon2"))
    member = dense.select(*on, "_unit", lat, lon)
    probe = beside.select(*on, "_unit", "_unit2", "_clat2", "_clon2").join(member, [*on, "_unit"]).groupBy(*on, "_unit", "_unit2").agg(F.min(F.struct(away.alias("d"), F.col(lat).alias("lat"), F.col(lon).alias("lon"))).alias("p"))
    facing = probe.select(*on, F.col("_unit").alias("_unit2"), F.col("_unit2").alias("_unit"), F.col("p").alias("q"))
    tested = probe.join(facing, [*on, "_unit", "_unit2"]).where("_unit < _unit2").where(geo.haversine_km(F.col("p.lat"), F.col("p.lon"), F.col("q.lat"), F.col("q.lon")) <= km)
    links = cut(links.unionByName(tested.select(end("_unit").alias("a"), end("_unit2").alias("b"))))
    roots = small(components(links))
    named = lambda df, unit, name: df.join(roots.select(*[F.col(f"node.{c}").alias(c) for c in on], F.col("node.unit").alias(unit), F.col("root.unit").alias(f"_r{name}")), [*on, unit], "left").withColumn(name, F.coalesce(f"_r{name}", unit)).drop(f"_r{name}")
    open_pairs = cut(named(named(beside.where("_unit < _unit2"), "_unit", "_a"), "_unit2", "_b").where("_a <> _b"))
    if not open_pairs.isEmpty():
        first = open_pairs.join(member, [*on, "_unit"]).where(away <= 1.5 * km + 1e-6).select(*on, "_unit", "_unit2", F.col(lat).alias("_lat1"), F.col(lon).alias("_lon1"))
        last = member.withColumnRenamed("_unit", "_unit2")
        met = first.join(last, [*on, "_unit2"]).where(geo.haversine_km(F.col("_lat1"), F.col("_lon1"), F.col(lat), F.col(lon)) <= km)
        more = cut(met.select(*on, "_unit", "_unit2").distinct().select(end("_unit").alias("a"), end("_unit2").alias("b")))
        if not more.isEmpty():
            roots = small(components(links.unionByName(more)))
    whole = named(dense.select(*on, "_k", "_unit"), "_unit", "cluster").select(*on, "_k", "cluster")
    single = named(cores.withColumn("_unit", F.col("_k")), "_unit", "cluster").select(*on, "_k", "cluster")
    edge = named(around.join(cores, [*on, "_k"], "left_anti"), "_unit2", "cluster").groupBy(*on, "_k").agg(F.min("cluster").alias("cluster"))
    placed = spot.select(*on, lat, lon, "_k").join(whole.unionByName(single).unionByName(edge), [*on, "_k"])
    return points.join(placed.select(*on, lat, lon, "cluster"), [*on, lat, lon]).select(*on, key, "cluster")


def rank_score(support: Column, d: dict[str, Column]) -> Column:
    """Weighed evidence of a cluster; each term is held within 0 and 1."""
    up = lambda x: F.least(F.lit(1.0), F.greatest(F.lit(0.0), x))
    # Weights of the terms.
    terms = [
        (0.44, d["confidence"]),
        (0.14, d["cnn_confidence"]),
        (0.14, d["vit_confidence"]),
        (0.08, F.least(F.lit(1.0), F.log1p(support.cast("double")) / math.log(11.0))),
        (0.06, up(d["vorticity_850_s1"] / 5.0e-5)),
        (0.04, up((d["midlevel_rh_percent"] - 50) / 30)),
        (0.04, up(-d["pressure_anomaly_pa"] / 500)),
        (0.03, up(-d["lowlevel_divergence_s1"] / 5.0e-6)),
        (0.03, up((20 - d["shear_200_850_ms"]) / 20)),
    ]
    return sum((w * x for w, x in terms), F.lit(0.0))


def representatives(members: DataFrame, *, by: list[str], key: str, lat: str = "latitude", lon: str = "longitude", confidence: str = "confidence", extra: list[str] | None = None, top: int | None = None) -> DataFrame:
    """One row per cluster: its best member's columns, confidence-weighted centre (circular in longitude), support, mean
    and greatest confidence, and cluster_rank_score if the members have all its terms; the ``top`` best of each group
    (``by`` without its last column)."""
    extra = extra or []
    w = F.greatest(F.col(confidence), F.lit(1e-6))
    best = F.max_by(F.struct(F.col(lat).alias("representative_grid_latitude"), F.col(lon).alias("representative_grid_longitude"), F.col(confidence).alias(confidence), *extra), F.struct(F.col(confidence), -F.col(key)))
    g = members.groupBy(*by).agg(best.alias("b"), (F.sum(w * F.col(lat)) / F.sum(w)).alias(lat), geo.circular_mean_lon(w, F.col(lon)).alias(lon), F.count("*").alias("cluster_support"), F.avg(confidence).alias("cluster_mean_confidence"), F.max(confidence).alias("cluster_max_confidence"))
    out = g.select(*by, lat, lon, "cluster_support", "cluster_mean_confidence", "cluster_max_confidence", "b.*")
    terms = ["confidence", "cnn_confidence", "vit_confidence", "vorticity_850_s1", "midlevel_rh_percent", "pressure_anomaly_pa", "lowlevel_divergence_s1", "shear_200_850_ms"]
    order = confidence
    if set(terms) <= set(out.columns):
        out, order = out.withColumn("cluster_rank_score", rank_score(F.col("cluster_support"), {t: F.col(t) for t in terms})), "cluster_rank_score"
    if top is not None:
        out = top_k(out, top, by=by[:-1], order=[F.desc(order), F.col(by[-1])])
    return out


def top_k(df: DataFrame, k: int, *, by: list[str], order: list[Column]) -> DataFrame:
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*(by or [F.lit(0)])).orderBy(*order))).where(F.col("rank") <= k) if by else df.orderBy(*order).limit(k)


def one_per_system(df: DataFrame, *, by: list[str], system: str, confidence: str, key: str, generic: list[str]) -> DataFrame:
    """The most confident detection of each matched system; unmatched and generic names all stay."""
    named = F.col(system).isNotNull() & ~F.upper(F.trim(F.coalesce(F.col(system), F.lit("")))).isin(*generic)
    alone = df.where(~named)
    kept = df.where(named).withColumn("_n", F.row_number().over(Window.partitionBy(*by, system).orderBy(F.desc(confidence), key))).where("_n = 1").drop("_n")
    return kept.unionByName(alone)


def physical_screen(lat: Column, land: Column, sst: Column, rh: Column, vorticity: Column, anomaly: Column, shear: Column, divergence: Column, *, band: float = 35.0, max_land: float = 0.10, min_sst: float = 299.15, min_rh: float = 55.0, min_vorticity: float = 1e-5, max_anomaly: float = -100.0, max_shear: float = 15.0, max_divergence: float = -1e-6) -> Column:
    """The conjunction that makes a grid cell a candidate; cheap tests first, a missing value fails."""
    return (lat.between(-band, band)) & (land <= max_land) & (sst >= min_sst) & (rh >= min_rh) & (physics.cyclonic(lat, vorticity) >= min_vorticity) & (anomaly <= max_anomaly) & (shear <= max_shear) & (divergence <= max_divergence)
