"""The screening engine's operators as queries over the driver's tables.

Points are derived from integer keys, times come from events, labels from documents; doubles that depend on the order of
summation are rounded.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import geo, physics, text, when
from ..operators import attribution, classify, compositions, detect, grid, joins, learn, metrics, summary, systems, tracks
from ..sources import writers
from ..sources.readers import table
from ..streaming import cycles

Q: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f):
    Q[f.__name__] = f
    return f


def _lat(k: Column) -> Column:
    return ((k * 7919) % 141 - 70).cast("double") / 2


def _lon(k: Column) -> Column:
    return ((k * 104729) % 360).cast("double") - 180


def customers(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    return table(spark, d, "customer").select(k.alias("key"), F.col("c_nationkey").alias("nation"), F.col("c_acctbal").alias("conf"), _lat(k).alias("lat"), _lon(k).alias("lon"))


def suppliers(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("s_suppkey")
    return table(spark, d, "supplier").select(k.alias("skey"), F.col("s_nationkey").alias("nation"), F.col("s_acctbal").alias("sconf"), _lat(k * 3 + 1).alias("slat"), _lon(k * 3 + 1).alias("slon"))


def scores(spark: SparkSession, d: str) -> DataFrame:
    """Documents with a label and a score squashed into (0, 1)."""
    docs = table(spark, d, "documents").select("doc_id", "n_chars")
    score = F.round(F.col("n_chars") / (F.col("n_chars") + 2000.0), 6)
    return docs.join(table(spark, d, "labels"), "doc_id").select("doc_id", F.col("quality").alias("y"), score.alias("p"), "n_chars")


def measures(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax")
    return m.unpivot(["l_orderkey", "l_linenumber"], ["l_quantity", "l_extendedprice", "l_discount", "l_tax"], "variable", "value")


def events(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events")


def lattice(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part")
    return p.select(F.lit(0).alias("cycle"), F.floor(F.col("p_partkey") / 50).cast("int").alias("row"), (F.col("p_partkey") % 50).cast("int").alias("col"), F.col("p_retailprice").alias("value"), F.col("p_size").cast("double").alias("other"))


# --- joins -------------------------------------------------------------------------------------------------------------


@query
def geo_pairs_within(spark: SparkSession, d: str) -> DataFrame:
    return joins.pairs_within(customers(spark, d), 1000.0, key="key", lat="lat", lon="lon", digits=6)


@query
def exclusion_anti(spark: SparkSession, d: str) -> DataFrame:
    return joins.exclusion(customers(spark, d), suppliers(spark, d).drop("nation"), 550.0, left_at=("lat", "lon"), right_at=("slat", "slon")).select("key")


@query
def nearest_with_age(spark: SparkSession, d: str) -> DataFrame:
    start = F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")
    c = customers(spark, d).select("key", "nation", "lat", "lon", when.plus_hours(start, (F.col("key") % 72).cast("int")).alias("t"))
    s = suppliers(spark, d).select("nation", "skey", "slat", "slon", when.plus_hours(start, (F.col("skey") % 48).cast("int")).alias("st"))
    found = joins.nearest_with_age(c, s, left_at=("lat", "lon"), left_time="t", key="skey", system_at=("slat", "slon"), system_time="st", on=["nation"])
    return found.select("key", "skey", F.round("distance_km", 6).alias("distance_km"), F.round("age_hours", 6).alias("age_hours"))


@query
def nearest_grid_cell(spark: SparkSession, d: str) -> DataFrame:
    c = customers(spark, d)
    return c.select("key", geo.grid_row(F.col("lat") + 0.25).alias("row"), geo.grid_column(F.col("lon") + 0.3).alias("col"))


@query
def lead_window_join(spark: SparkSession, d: str) -> DataFrame:
    e = events(spark, d)
    first = e.groupBy("user_id").agg(F.min("ts").alias("first_ts"))
    found = joins.interval_join(first, e.select("user_id", "event_id", "ts"), left_time="first_ts", right_time="ts", low_hours=18, high_hours=30, on=["user_id"])
    return found.select("user_id", "event_id", F.round("lead_hours", 6).alias("lead_hours"))


@query
def exact_lead_join(spark: SparkSession, d: str) -> DataFrame:
    e = events(spark, d)
    cycles = e.select(when.floor_cycle(F.col("ts")).alias("cycle")).distinct()
    first = e.groupBy("user_id").agg(when.floor_cycle(F.min("ts")).alias("genesis"))
    found = joins.lead_time_join(cycles, first, file_time="cycle", genesis_time="genesis", hours=24)
    return found.groupBy("cycle").agg(F.count("user_id").alias("n"), (F.count("user_id") > 0).alias("is_genesis"))


@query
def active_at_time(spark: SparkSession, d: str) -> DataFrame:
    e = events(spark, d).select(when.floor_cycle(F.col("ts")).alias("cycle"), "user_id", _lat(F.col("user_id")).alias("lat"), _lon(F.col("user_id")).alias("lon")).distinct()
    # the first hour of a month's cycle table to the last of its fixes, every six hours
    ends = e.agg(F.date_trunc("month", F.min("cycle")).cast("timestamp_ntz").alias("low"), F.max("cycle").alias("high"))
    files = ends.select(F.explode(F.sequence("low", "high", F.expr("INTERVAL 6 HOURS"))).alias("file_ts"))
    found = joins.active_at(files, e, file_time="file_ts", fix_time="cycle", lat="lat", lon="lon", storm="user_id")
    return found.select("file_ts", "is_active", F.when(F.col("active").isNull(), 0).otherwise(F.size("active")).cast("long").alias("n"), F.array_join(F.transform("active", lambda x: x["storm"].cast("string")), ",").alias("storms"))


@query
def box_exclusion(spark: SparkSession, d: str) -> DataFrame:
    c = customers(spark, d).withColumn("t", F.col("key") % 10)
    s = suppliers(spark, d).select((F.col("skey") % 10).alias("st"), F.col("slat").alias("lat"), F.col("slon").alias("lon"))
    return joins.box_exclusion(c, s, time="t", fix_time="st", lat="lat", lon="lon", half=20.0).select("key")


def _matches(spark: SparkSession, d: str) -> DataFrame:
    return joins.match_within(customers(spark, d), suppliers(spark, d), 2500.0, group=["nation"], left_key="key", right_key="skey", left_at=("lat", "lon"), right_at=("slat", "slon"))


@query
def greedy_match(spark: SparkSession, d: str) -> DataFrame:
    return _matches(spark, d).withColumnRenamed("distance_km", "km")


@query
def match_metrics(spark: SparkSession, d: str) -> DataFrame:
    matches = _matches(spark, d).select("key", "skey", "distance_km")
    p, e = joins.match_status(customers(spark, d).select("key"), suppliers(spark, d).select("skey"), matches, prediction="key", event="skey")
    m = metrics.event_metrics(p.withColumn("event_name", F.col("skey").cast("string")), e)
    return m.select("hits", "misses", "false_alarms", *[F.round(c, 9).alias(c) for c in ("pod", "precision", "far", "csi", "mean_km", "median_km")])


@query
def cache_reuse(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("key"))
    cache = customers(spark, d).where("key % 3 = 0").select("key", F.when(F.col("key") % 2 == 0, F.col("conf")).alias("v1"), F.when(F.col("key") % 5 == 0, F.col("lat")).alias("v2"))
    reused, pending = joins.reuse_cached(o, cache, ["key"], ["v1", "v2"])
    return reused.select(F.lit("reused").alias("kind"), "key").unionByName(pending.select(F.lit("pending").alias("kind"), "key")).groupBy("kind").agg(F.count("*").alias("n"), F.sum("key").alias("keys"))


# --- tracks and aggregates ---------------------------------------------------------------------------------------------


@query
def genesis_first_event(spark: SparkSession, d: str) -> DataFrame:
    return tracks.first_rows(events(spark, d).select("user_id", "ts", "event_id", "event_type"), "user_id", ["ts"], ["ts", "event_id", "event_type"])


@query
def genesis_first_values(spark: SparkSession, d: str) -> DataFrame:
    e = events(spark, d).select("user_id", "ts", "event_id", F.when(F.col("event_type") == "purchase", F.col("value")).alias("bought"), "event_type")
    return tracks.first_values(e, "user_id", ["ts"], ["bought", "event_type"])


@query
def prior_samples(spark: SparkSession, d: str) -> DataFrame:
    e = events(spark, d).select(F.col("user_id").cast("string").alias("sid"), "ts", _lat(F.col("event_id")).alias("lat"), _lon(F.col("event_id")).alias("lon"), F.col("value").alias("wind"))
    return tracks.prior_samples(e)


@query
def label_table(spark: SparkSession, d: str) -> DataFrame:
    e = events(spark, d).select(F.col("user_id").cast("string").alias("sid"), when.floor_cycle(F.col("ts")).alias("ts"), _lat(F.col("user_id")).alias("lat"), _lon(F.col("user_id")).alias("lon"), F.lit("n").alias("name"), F.lit("b").alias("basin"), F.lit("TS").alias("nature")).distinct()
    files = e.select("ts").distinct().withColumn("path", F.date_format("ts", "yyyyMMddHH"))
    out = tracks.labels(files, e)
    return out.select("path", "is_genesis", F.col("genesis_count").cast("long").alias("genesis_count"), "is_active", F.array_join("genesis.sid", ",").alias("genesis_sids"), F.size("active").cast("long").alias("n_active"))


@query
def chrono_split(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    split = tracks.chronological_split(F.col("o_orderdate"), (1995, 1998), (1999, 1999), (2000, 2001))
    return o.select(split.alias("split"), "o_totalprice").groupBy("split").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query
def synoptic_filter(spark: SparkSession, d: str) -> DataFrame:
    e = events(spark, d).withColumn("hour_ts", F.date_trunc("hour", "ts").cast("timestamp_ntz"))
    return e.where(when.is_synoptic(F.col("hour_ts"))).where("ts >= timestamp_ntz '2024-01-05' AND ts < timestamp_ntz '2024-01-20'").groupBy(when.floor_cycle(F.col("ts")).alias("cycle")).agg(F.count("*").alias("n"))


@query
def negative_centers(spark: SparkSession, d: str) -> DataFrame:
    found = tracks.negative_centers(customers(spark, d).select("key", "lat", "lon"), key="key", distances=[8.0, 12.0, 16.0], box=(-30.0, 30.0, 10.0, 350.0))
    return found.select("key", "shift", "angle", F.round("new_lat", 6).alias("new_lat"), F.round("new_lon", 6).alias("new_lon"))


@query
def patch_centers(spark: SparkSession, d: str) -> DataFrame:
    lat, lon = tracks.patch_center(F.col("lat"), F.col("lon"), 10.0, (-35.0, 35.0, -180.0, 180.0))
    return customers(spark, d).select("key", lat.alias("center_lat"), lon.alias("center_lon"))


@query
def balanced_negatives(spark: SparkSession, d: str) -> DataFrame:
    return tracks.balanced_negatives(customers(spark, d).where("conf < 0").select("key"), 300, key="key")


@query
def dedupe_keep_last(spark: SparkSession, d: str) -> DataFrame:
    return joins.keep_last(events(spark, d).select("user_id", "event_type", "ts", "event_id", "value"), ["user_id", "event_type"], [F.col("ts"), F.col("event_id")])


@query
def newest_per_key(spark: SparkSession, d: str) -> DataFrame:
    return events(spark, d).groupBy("user_id").agg(F.max(F.struct("ts", "event_id", "event_type")).alias("x")).select("user_id", "x.*")


@query
def unique_any_hit(spark: SparkSession, d: str) -> DataFrame:
    e = events(spark, d).select(F.col("user_id").alias("sid"), F.when(F.col("value") > 100, "HIT").otherwise("MISS").alias("verification_status"))
    return metrics.unique_storms(e).select("storms", "storms_hit", F.round("storm_pod", 9).alias("storm_pod"))


@query
def file_summary(spark: SparkSession, d: str) -> DataFrame:
    """Purchases and errors as the predictions and events of a day's file."""
    e = events(spark, d).withColumn("day", F.date_trunc("day", "ts").cast("timestamp_ntz"))
    predictions = e.where("event_type IN ('purchase', 'click')").select("day", F.when(F.col("event_type") == "purchase", "HIT").otherwise("FALSE_ALARM").alias("verification_status"), F.when(F.col("value") > 20, F.col("user_id")).alias("matched_name"))
    observed = e.where("event_type IN ('purchase', 'error')").select("day", F.when(F.col("event_type") == "error", "MISS").otherwise("HIT").alias("verification_status"), F.when(F.col("value") > 60, F.col("user_id")).alias("event_name"))
    return summary.by_file(predictions, observed, file=["day"])


@query
def union_by_name(spark: SparkSession, d: str) -> DataFrame:
    c, s = customers(spark, d).select("key", "nation", "lat"), suppliers(spark, d).select(F.col("skey").alias("key"), F.col("nation"), F.col("sconf").alias("wind"))
    return c.unionByName(s, allowMissingColumns=True).groupBy("nation").agg(F.count("*").alias("n"), F.count("lat").alias("with_lat"), F.round(F.sum("wind"), 2).alias("wind"))


@query
def distinct_classes(spark: SparkSession, d: str) -> DataFrame:
    return summary.classes(table(spark, d, "part"), F.col("p_type"))


def _shown(spark: SparkSession, d: str) -> DataFrame:
    """Customers as published detections."""
    named = F.when(F.col("conf") > 9000, "NEW_GENESIS_CANDIDATE").when(F.col("conf") > 5000, "MODEL_GENESIS_CANDIDATE").when(F.col("nation") < 5, "ACTIVE_CYCLONE").otherwise("UNCLASSIFIED_DISTURBANCE")
    return customers(spark, d).withColumns({"class": named, "score": F.when(F.col("key") % 11 > 0, F.col("conf") / 100)})


@query
def dashboard_counters(spark: SparkSession, d: str) -> DataFrame:
    c = summary.visible(_shown(spark, d), system_class=F.col("class"), score=F.col("score"))
    got = summary.counters(c, system_class=F.col("class"), score=F.col("score"))
    return got.select("visible", "genesis", "active", F.round("mean_score", 6).alias("mean_score"))


@query
def dashboard_filter(spark: SparkSession, d: str) -> DataFrame:
    """Counters by nation of one class over a score, of those above a half."""
    c = summary.visible(_shown(spark, d), system_class=F.col("class"), score=F.col("score"), chosen="NEW_GENESIS_CANDIDATE", least=92.5)
    got = summary.counters(summary.confident(c, F.col("score") / 100), system_class=F.col("class"), score=F.col("score"), by=["nation"])
    return got.select("nation", "visible", "genesis", "active", F.round("mean_score", 6).alias("mean_score"))


# --- detection ---------------------------------------------------------------------------------------------------------


@query
def nms_top_k(spark: SparkSession, d: str) -> DataFrame:
    kept = detect.suppress(customers(spark, d), 2500.0, by=["nation"], lat="lat", lon="lon", confidence="conf", key="key", top=5)
    return kept.select("nation", F.col("rank").cast("long").alias("rank"), "key", "conf")


def _clusters(spark: SparkSession, d: str, least: int) -> DataFrame:
    return detect.density_clusters(customers(spark, d), 900.0, least, key="key", lat="lat", lon="lon")


@query
def dbscan_cluster(spark: SparkSession, d: str) -> DataFrame:
    return _clusters(spark, d, 2)


@query
def dbscan_dense(spark: SparkSession, d: str) -> DataFrame:
    return _clusters(spark, d, 4)


@query
def cluster_representatives(spark: SparkSession, d: str) -> DataFrame:
    members = customers(spark, d).join(_clusters(spark, d, 2), "key").select("cluster", "key", F.col("lat").alias("latitude"), F.col("lon").alias("longitude"), (F.col("conf") + 1000).alias("confidence"))
    r = detect.representatives(members, by=["cluster"], key="key")
    return r.select("cluster", F.round("latitude", 6).alias("latitude"), F.round("longitude", 6).alias("longitude"), "cluster_support", F.round("cluster_mean_confidence", 6).alias("mean_confidence"), F.col("cluster_max_confidence").alias("max_confidence"), "representative_grid_latitude", "representative_grid_longitude")


@query
def cluster_rank_score(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem")
    c = {"confidence": F.col("l_discount") * 10, "cnn_confidence": F.col("l_tax") * 10, "vit_confidence": F.col("l_discount") + F.col("l_tax"), "vorticity_850_s1": (F.col("l_quantity") - 10) * 1e-6, "midlevel_rh_percent": F.col("l_quantity") + 40, "pressure_anomaly_pa": F.col("l_quantity") * -20 + 300, "lowlevel_divergence_s1": (F.col("l_quantity") - 25) * 1e-7, "shear_200_850_ms": F.col("l_quantity") / 2}
    return li.select("l_orderkey", "l_linenumber", F.round(detect.rank_score(F.col("l_linenumber"), c), 9).alias("rank_score")).groupBy("l_linenumber").agg(F.round(F.sum("rank_score"), 4).alias("total"), F.max("rank_score").alias("top"))


@query
def score_gates(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem")
    e, c, v = F.col("l_discount") * 10, F.when(F.col("l_linenumber") > 2, F.col("l_tax") * 12), F.when(F.col("l_linenumber") != 4, F.col("l_quantity") / 50)
    return li.agg(F.count_if(detect.score_gate(e, c, v, 0.75, 0.45)).alias("strict"), F.count_if(detect.available_gate(e, c, v, 0.75, 0.45)).alias("available"))


@query
def one_per_system(spark: SparkSession, d: str) -> DataFrame:
    c = customers(spark, d).withColumn("system", F.when(F.col("key") % 7 == 0, "UNKNOWN").when(F.col("key") % 3 == 0, F.concat(F.lit("S"), (F.col("key") % 11).cast("string"))))
    return detect.one_per_system(c, by=["nation"], system="system", confidence="conf", key="key", generic=text.GENERIC_NAMES).groupBy("nation").agg(F.count("*").alias("n"), F.sum("key").alias("keys"))


@query
def physical_screen(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem")
    q = F.col("l_quantity")
    ok = detect.physical_screen((q - 25) * 2, F.col("l_tax"), 295 + F.col("l_discount") * 100, q + 40, (q - 20) * 1e-6, q * -10, F.lit(50) - q, (q - 40) * -1e-6)
    return li.agg(F.count_if(ok).alias("candidates"), F.count("*").alias("cells"))


@query
def top_k_per_group(spark: SparkSession, d: str) -> DataFrame:
    return detect.top_k(customers(spark, d), 3, by=["nation"], order=[F.desc("conf"), F.col("key")]).select("nation", F.col("rank").cast("long").alias("rank"), "key", "conf")


# --- grids -------------------------------------------------------------------------------------------------------------


@query
def box_anomaly(spark: SparkSession, d: str) -> DataFrame:
    a = grid.anomaly(lattice(spark, d), 3, by=["cycle"], row="row", column="col", value="value", columns=50)
    return a.select("row", "col", (F.round("anomaly", 6) + 0.0).alias("anomaly"))


@query
def clipped_box_mean(spark: SparkSession, d: str) -> DataFrame:
    a = grid.clipped_box_mean(lattice(spark, d), 2, by=["cycle"], row="row", column="col", value="value", columns=50)
    return a.select("row", "col", F.round("box_mean", 6).alias("box_mean"))


@query
def gradient(spark: SparkSession, d: str) -> DataFrame:
    h = events(spark, d).groupBy("event_type", F.hour("ts").alias("h")).agg(F.count("*").cast("double").alias("n"))
    w = Window.partitionBy("event_type").orderBy("h")
    return h.withColumn("slope", F.round(grid.gradient(F.col("n"), F.col("h"), w), 9))


@query
def divergence(spark: SparkSession, d: str) -> DataFrame:
    g = lattice(spark, d).select("cycle", (F.col("row") - 20.0).alias("lat"), F.col("col").cast("double").alias("lon"), F.col("value").alias("u"), F.col("other").alias("v"))
    return grid.divergence(g, by=["cycle"], lat="lat", lon="lon", u="u", v="v").select("lat", "lon", F.round(F.col("divergence") * 1e6, 6).alias("divergence"))


@query
def bilinear(spark: SparkSession, d: str) -> DataFrame:
    p = lattice(spark, d).select("cycle", (F.col("row") * 50 + F.col("col")).alias("k"), (F.col("row") + 0.25).alias("r"), (F.col("col") + 0.5).alias("c"))
    return grid.bilinear(p, lattice(spark, d).select("cycle", "row", "col", "value"), by=["cycle"], row=F.col("r"), column=F.col("c"), key="k").select("k", F.round("value", 6).alias("value"))


@query
def channel_stats(spark: SparkSession, d: str) -> DataFrame:
    s = grid.channel_stats(measures(spark, d), by=["variable"], value="value")
    return s.select("variable", "n", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"))


@query
def zscore_project(spark: SparkSession, d: str) -> DataFrame:
    m = measures(spark, d)
    z = grid.normalised(m, grid.channel_stats(m, by=["variable"], value="value"), by=["variable"], value="value")
    return z.groupBy("variable").agg(F.round(F.min("z"), 6).alias("low"), F.round(F.max("z"), 6).alias("high"), F.round(F.avg(F.abs("z")), 6).alias("mean_abs"))


@query
def sampled_stats(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "lineitem").select((F.col("l_orderkey") % 1000).alias("file"), F.col("l_returnflag").alias("variable"), F.col("l_quantity").alias("value"))
    s = grid.sampled_stats(m, files="file", by=["variable"], value="value", wanted=100)
    return s.select("variable", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"))


@query
def channel_stack(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.max("l_quantity").alias("q"))
    return grid.stacked(m, by=["l_orderkey"], index="l_linenumber", value="q").select("l_orderkey", F.array_join(F.transform("stack", lambda x: x.cast("int").cast("string")), ",").alias("stack"))


@query
def unit_harmony(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part")
    i = F.col("p_partkey") % 4
    g = p.select((F.col("p_partkey") % 9).alias("cycle"), F.when(i == 0, "rhprs").when(i == 1, "pressfc").when(i == 2, "hgtprs").otherwise("landmask").alias("variable"), F.when(i == 0, "fraction").when(i == 1, "hPa").when(i == 2, "m**2 s**-2").otherwise("1").alias("units"), (F.col("p_size") / 20.0).alias("value"))
    return grid.harmonised(g).groupBy("variable").agg(F.round(F.sum("value"), 4).alias("total"), F.round(F.max("value"), 6).alias("top"))


@query
def standard_axes(spark: SparkSession, d: str) -> DataFrame:
    g = customers(spark, d).select("lat", (F.floor(F.col("lon") / 10) * 10).cast("double").alias("lon"), "key", "conf")
    return grid.standard_axes(g, cell=["lat", "lon"], lon="lon", position="key").select("lat", "lon", "key")


@query
def environment_metrics(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "lineitem")
    i = F.col("l_linenumber")
    g = m.select((F.col("l_orderkey") % 500).alias("det"), F.when(i == 1, "landmask").when(i == 2, "pressfc").when(i == 3, "rhprs").when(i == 4, "ugrdprs").when(i == 5, "vgrdprs").when(i == 6, "absvprs").otherwise("tmpsfc").alias("variable"), F.when(i == 3, 600.0).when(i.isin(4, 5), F.when(F.col("l_returnflag") == "A", 200.0).otherwise(850.0)).when(i == 6, 850.0).alias("lev"), F.col("l_quantity").alias("value"), (F.col("l_linestatus") == "O").alias("is_center"))
    e = grid.environment(g, by=["det"])
    return e.select("det", *[F.round(c, 6).alias(c) for c in e.columns if c != "det"])


# --- metrics -----------------------------------------------------------------------------------------------------------


@query
def contingency(spark: SparkSession, d: str) -> DataFrame:
    c = metrics.confusion(scores(spark, d), F.col("y"), F.col("p"), 0.5)
    return c.select("tp", "fp", "fn", "tn", *[F.round(x, 9).alias(x) for x in ("accuracy", "precision", "recall", "f1", "csi")])


@query
def model_table(spark: SparkSession, d: str) -> DataFrame:
    s = scores(spark, d)
    both = s.withColumn("model", F.lit("a")).unionByName(s.withColumn("p", 1 - F.col("p")).withColumn("model", F.lit("b")))
    c = metrics.confusion(both, F.col("y"), F.col("p"), 0.5, by=["model"]).join(metrics.roc_auc(both, F.col("y"), F.col("p"), by=["model"]), "model")
    return c.select("model", *[F.round(x, 9).alias(x) for x in ("accuracy", "roc_auc", "precision", "recall", "f1")])


@query
def classification_report(spark: SparkSession, d: str) -> DataFrame:
    s = scores(spark, d).select("y", (F.col("p") >= 0.5).cast("int").alias("pred"))
    r = metrics.classification_report(s, "y", "pred")
    return r.select("class", *[F.round(c, 9).alias(c) for c in ("precision", "recall", "f1")], F.col("support").cast("long").alias("support"))


@query
def roc_auc(spark: SparkSession, d: str) -> DataFrame:
    return metrics.roc_auc(scores(spark, d), F.col("y"), F.col("p")).select(F.round("roc_auc", 9).alias("roc_auc"))


@query
def pr_auc(spark: SparkSession, d: str) -> DataFrame:
    return metrics.pr_auc(scores(spark, d), F.col("y"), F.col("p")).select(F.round("pr_auc", 9).alias("pr_auc"))


@query
def average_precision(spark: SparkSession, d: str) -> DataFrame:
    return metrics.average_precision(scores(spark, d), F.col("y"), F.col("p")).select(F.round("average_precision", 9).alias("average_precision"))


@query
def brier_log_loss(spark: SparkSession, d: str) -> DataFrame:
    m = metrics.brier_and_log_loss(F.col("y"), F.col("p"))
    return scores(spark, d).agg(*[F.round(v, 9).alias(k) for k, v in m.items()])


@query
def calibration_error(spark: SparkSession, d: str) -> DataFrame:
    return metrics.expected_calibration_error(scores(spark, d), F.col("y"), F.col("p")).select(F.round("ece", 9).alias("ece"))


@query
def threshold_pick(spark: SparkSession, d: str) -> DataFrame:
    t = metrics.pick_threshold(scores(spark, d), F.col("y"), F.col("p"))
    return t.select(*[F.round(c, 9).alias(c) for c in t.columns])


@query
def threshold_recall(spark: SparkSession, d: str) -> DataFrame:
    t = metrics.pick_threshold(scores(spark, d), F.col("y"), F.col("p"), least_recall=0.9)
    return t.select(*[F.round(c, 9).alias(c) for c in t.columns])


@query
def threshold_sweep(spark: SparkSession, d: str) -> DataFrame:
    t = metrics.sweep(scores(spark, d), F.col("y"), F.col("p"))
    return t.select(*[F.round(c, 9).alias(c) for c in ("threshold", "precision", "recall", "csi")])


@query
def distribution(spark: SparkSession, d: str) -> DataFrame:
    r = metrics.distribution(table(spark, d, "lineitem"), "l_extendedprice", by=["l_returnflag"])
    return r.select("l_returnflag", *[F.round(c, 6).alias(c) for c in ("min", "mean", "median", "p95", "p99", "max")])


@query
def outcome_counts(spark: SparkSession, d: str) -> DataFrame:
    s = scores(spark, d)
    return s.groupBy(metrics.outcome(F.col("y"), (F.col("p") >= 0.6).cast("int")).alias("outcome")).agg(F.count("*").alias("n"))


# --- scalar functions and classification -------------------------------------------------------------------------------


@query
def weighted_circular_mean(spark: SparkSession, d: str) -> DataFrame:
    return customers(spark, d).groupBy("nation").agg(F.round(geo.circular_mean_lon(F.col("conf") + 1000, F.col("lon")), 6).alias("lon"))


@query
def haversine_forms(spark: SparkSession, d: str) -> DataFrame:
    c = customers(spark, d)
    return c.select("key", F.round(geo.haversine_km(F.col("lat"), F.col("lon"), F.lit(10.0), F.lit(170.0)), 6).alias("km"), F.round(geo.haversine_atan2_km(F.col("lat"), F.col("lon"), F.lit(10.0), F.lit(170.0)), 6).alias("km_atan2"))


@query
def longitudes(spark: SparkSession, d: str) -> DataFrame:
    x = F.col("lon") * 3 + 0.5
    return customers(spark, d).select("key", geo.lon_180(x).alias("lon180"), geo.lon_360(x).alias("lon360"))


@query
def logistic_score(spark: SparkSession, d: str) -> DataFrame:
    model = classify.PostClassifier({"model_type": "logistic_regression", "feature_names": ["q", "dsc"], "coefficients": {"q": 0.7, "dsc": -0.4}, "intercept": -0.2, "means": {"q": 25.0, "dsc": 0.05}, "scales": {"q": 14.0, "dsc": 0.03}, "imputation_medians": {"q": 25.0, "dsc": 0.05}})
    c = {"q": F.col("l_quantity"), "dsc": F.when(F.col("l_linenumber") != 3, F.col("l_discount"))}
    return table(spark, d, "lineitem").select("l_returnflag", model.probability(c).alias("p"), model.in_distribution(c).alias("ok")).groupBy("l_returnflag").agg(F.count("*").alias("n"), F.round(F.avg("p"), 9).alias("mean_p"), F.round(F.max("p"), 9).alias("max_p"), F.count_if("ok").alias("in_distribution"))


def _conditions() -> dict[str, Column]:
    q = F.col("l_quantity")
    return {"land_fraction": F.col("l_tax") * 3, "midlevel_rh_percent": q + 30, "shear_200_850_ms": q * 0.7, "cyclonic_vorticity_850_s1": (q - 15) * 1e-6, "pressure_anomaly_pa": (25 - q) * 10, "surface_temperature_k": 295 + F.col("l_discount") * 80}


@query
def soft_support(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem").select("l_returnflag", classify.environment_support(_conditions()).alias("s"))
    return li.groupBy("l_returnflag").agg(F.round(F.avg("s"), 9).alias("mean"), F.round(F.max("s"), 9).alias("top"))


@query
def six_rules(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").groupBy(classify.favourable_count(_conditions()).cast("long").alias("checks")).agg(F.count("*").alias("n"))


@query
def hybrid_support(spark: SparkSession, d: str) -> DataFrame:
    shares = F.create_map(F.lit("rhprs"), F.col("l_tax"), F.lit("hgtprs"), F.col("l_discount"), F.lit("tmpsfc"), F.lit(0.01))
    h = classify.hybrid_support(classify.environment_support(_conditions()), classify.attribution_support(shares), F.col("l_discount") * 10, F.col("l_tax") * 12, F.col("l_quantity") / 50)
    return table(spark, d, "lineitem").groupBy("l_linestatus").agg(F.round(F.avg(h), 9).alias("mean"), F.round(F.min(h), 9).alias("low"))


@query
def rule_cascade(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem")
    n, q, c = F.col("l_linenumber"), F.col("l_quantity"), _conditions()
    status = F.when(n == 1, "TS").when(n == 2, "DB").when(n == 3, "EX").when(n == 4, "INVEST")
    p = F.when((n == 5) | (F.col("l_discount") > 0.06), F.col("l_tax") * 12)
    r = classify.cascade(distance=F.when(n <= 4, q * 20), age=F.when(n <= 4, q), status=status, land=c["land_fraction"], rh=c["midlevel_rh_percent"], shear=c["shear_200_850_ms"], vorticity=c["cyclonic_vorticity_850_s1"], checks=classify.favourable_count(c), hybrid=F.col("l_discount") * 9, learned=p)
    return li.select(r.alias("r")).groupBy(F.col("r.system_class").alias("system_class")).agg(F.count("*").alias("n"), F.round(F.sum("r.confidence"), 4).alias("confidence"))


@query
def text_fields(spark: SparkSession, d: str) -> DataFrame:
    c = customers(spark, d)
    k = F.col("key")
    lat_text = F.concat(F.abs("lat").cast("string"), F.when(F.col("lat") < 0, "S").otherwise("N"))
    body = F.concat(F.lit("F. T"), ((k % 16) / 2.0).cast("string"), F.lit("/"), ((k % 16) / 2.0).cast("string"))
    code = F.element_at(F.array(*map(F.lit, ["wpac", "nind", "xx", "atl"])), (k % 4 + 1).cast("int"))
    return c.select("key", text.coordinate(lat_text).alias("lat"), text.dvorak_status(body, systems.DVORAK).alias("status"), text.coded(code, text.OSPO_BASIN).alias("basin"), text.clean_name(F.when(k % 3 == 0, "NOT_NAMED").when(k % 3 == 1, F.concat(F.lit(" a"), k.cast("string")))).alias("name"), text.optional_float(F.when(k % 2 == 0, "null").otherwise(k.cast("string"))).alias("number"))


@query
def name_times(spark: SparkSession, d: str) -> DataFrame:
    e = events(spark, d)
    name = F.when(F.col("event_id") % 3 == 0, F.date_format("ts", "'fnl_'yyyyMMdd'_'HH'_00.grib2'")).when(F.col("event_id") % 3 == 1, F.date_format("ts", "'gfs.'yyyyMMddHH'.nc'")).otherwise(F.lit("unnamed.nc"))
    return e.select("event_id", when.analysis_time(name).alias("t"), when.archive_name(when.floor_cycle(F.col("ts"))).alias("archive"))


@query
def bulletin_times(spark: SparkSession, d: str) -> DataFrame:
    e = events(spark, d)
    moved = when.plus_hours(F.col("ts"), F.lit(-40) + (F.col("event_id") % 80).cast("int"))
    return e.select("event_id", when.bulletin_time(F.dayofmonth(moved), F.date_format(moved, "HHmm"), F.col("ts")).alias("t"))


@query
def physics_scalars(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem")
    q, x = F.col("l_quantity"), F.col("l_discount")
    return li.groupBy("l_linenumber").agg(F.round(F.sum(physics.logit(x * 10)), 4).alias("logit"), F.round(F.sum(physics.wind_shear(q, x, F.lit(10.0), F.lit(2.0))), 4).alias("shear"), F.round(F.sum(physics.cyclonic(q - 25, q)), 4).alias("cyclonic"), F.round(F.sum(physics.clamp(q, 10.0, 30.0)), 4).alias("clamped"), F.round(F.sum(physics.clip01(q / 25 - 0.5)), 4).alias("clipped"), F.round(F.sum(F.bround(x * 1000, 1)), 2).alias("rounded"))


# --- attribution, documents, streams -----------------------------------------------------------------------------------


@query
def attribution_share(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem").select((F.col("l_orderkey") % 300).alias("det"), F.concat(F.lit("v"), F.col("l_linenumber").cast("string")).alias("variable"), (F.col("l_quantity") - 25).alias("value"))
    s = attribution.shares(li, by=["det"], variable="variable", value="value")
    return s.select("det", "variable", F.round("mean_share", 9).alias("mean_share"), F.round("column_share", 9).alias("column_share"))


@query
def importance(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem")
    r = attribution.importance(li, variable="l_returnflag", level="l_linenumber", value="l_quantity")
    return r.select("kind", "name", F.round("percent", 9).alias("percent"))


@query
def top_drivers(spark: SparkSession, d: str) -> DataFrame:
    e = events(spark, d).withColumn("m", F.when(F.col("event_id") % 2 == 0, F.create_map(F.col("event_type"), F.col("value"), F.lit("base"), F.lit(1.0))))
    return attribution.top_drivers(e, "m", 4).select("name", F.round("mean", 6).alias("mean"))


@query
def bend_points(spark: SparkSession, d: str) -> DataFrame:
    h = events(spark, d).groupBy("event_type", F.hour("ts").alias("h")).agg(F.round(F.sum("value"), 2).alias("v"))
    return attribution.second_derivative_extremes(h, by=["event_type"], at="h", value="v")


@query
def json_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    e = events(spark, d).select("event_type", F.from_json("props", "map<string,double>").alias("m"))
    flat = attribution.flattened(F.col("m"), "xai_")
    return e.select("event_type", F.try_element_at(flat, F.lit("xai_k")).alias("k")).groupBy("event_type").agg(F.count("k").alias("n"), F.sum("k").alias("total"))


@query
def geojson_feature(spark: SparkSession, d: str) -> DataFrame:
    c = customers(spark, d).select("key", F.col("lat").alias("latitude"), F.col("lon").alias("longitude"), "nation")
    return writers.feature_lines(c)


@query
def six_hour_tumbling(spark: SparkSession, d: str) -> DataFrame:
    e = cycles.six_hour_counts(events(spark, d).select(F.col("ts").cast("timestamp").alias("ts"), "event_type"), ts="ts", by=["event_type"])
    return e.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n")


@query
def system_dedup(spark: SparkSession, d: str) -> DataFrame:
    start = F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")
    s = suppliers(spark, d).select(F.concat(F.lit("S"), (F.col("skey") % 60).cast("string")).alias("storm_id"), F.col("slat").alias("latitude"), (F.col("slon")).alias("longitude"), when.plus_hours(start, (F.col("skey") % 30).cast("int")).alias("time"))
    return systems.deduplicated(s, km=1500.0)


# --- whole runs --------------------------------------------------------------------------------------------------------


def _candidates(spark: SparkSession, d: str) -> DataFrame:
    """Customers as detections of one cycle for each nation."""
    score = (F.col("conf") + 1000) / 11000
    fixed = {"land_fraction": 0.05, "midlevel_rh_percent": 70.0, "shear_200_850_ms": 10.0, "cyclonic_vorticity_850_s1": 2e-5, "pressure_anomaly_pa": -100.0, "surface_temperature_k": 301.0}
    c = customers(spark, d).select(F.col("nation").alias("cycle"), "key", F.col("lat").alias("latitude"), F.col("lon").alias("longitude"), score.alias("confidence"), F.lit(0.8).alias("vit_confidence"), F.when(F.col("key") % 5 != 0, 0.9).alias("cnn_confidence"))
    shares = F.create_map(F.lit("rhprs"), F.lit(0.3), F.lit("hgtprs"), F.lit(0.1))
    return c.withColumns({**{k: F.lit(v) for k, v in fixed.items()}, "shares": shares, "learned": F.lit(None).cast("double"), "time": F.lit("2024-01-02 00:00:00").cast("timestamp_ntz")})


@query
def operational_scan(spark: SparkSession, d: str) -> DataFrame:
    start = F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")
    k = F.col("skey")
    status = F.when(k % 4 == 0, "TS").when(k % 4 == 1, "DB").when(k % 4 == 2, "EX").otherwise("INVEST")
    s = suppliers(spark, d).select(F.col("nation").alias("cycle"), k.cast("string").alias("storm_id"), status.alias("status"), F.col("slat").alias("system_latitude"), F.col("slon").alias("system_longitude"), when.plus_hours(start, (k % 48).cast("int")).alias("system_time"))
    found = compositions.operational_scan(_candidates(spark, d), s, at=0.3, km=1500.0, match_km=3000.0, top=10)
    return found.select("cycle", F.col("rank").cast("long").alias("rank"), "key", "storm_id", F.round("distance_km", 6).alias("distance_km"), "system_class", F.round("class_confidence", 9).alias("class_confidence"))


def verification(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    start = F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")
    c = _candidates(spark, d).withColumn("analysis_time", when.plus_hours(start, F.col("cycle").cast("int")))
    k = F.col("skey")
    e = suppliers(spark, d).select(k.alias("event_id"), F.concat(F.lit("E"), (k % 9).cast("string")).alias("event_name"), when.plus_hours(start, (k % 60).cast("int")).alias("event_time"), F.col("slat").alias("event_latitude"), F.col("slon").alias("event_longitude"))
    return compositions.verified_cycles(c, e, lead=24.0, tolerance=6.0, match_km=1200.0, at=0.4, least_expert=0.45, cluster_km=900.0)


@query
def cycle_verification(spark: SparkSession, d: str) -> DataFrame:
    return verification(spark, d)[2]


@query
def training_batches(spark: SparkSession, d: str) -> DataFrame:
    c = customers(spark, d).select("key", "conf")
    rows = compositions.training_epoch(c.where("conf >= 9000").select("key"), c.where("conf < 9000").select("key"), key="key", ratio=3, epoch=1, batch=64)
    return rows.groupBy("batch").agg(F.count("*").alias("n")).select("batch", "n")


@query
def display_fields(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("key")
    score = compositions.display_score(F.when(k % 3 == 0, k % 100 + 0.5), F.when(k % 3 == 1, F.lit(float("nan"))), F.when(k % 2 == 0, (k % 50) / 50.0))
    return customers(spark, d).select("key", F.round(score, 6).alias("score"), F.round(compositions.marker_radius(score), 6).alias("radius"), compositions.impact_profile(-(k % 80)).alias("profile"))


# --- fits --------------------------------------------------------------------------------------------------------------


@query
def median_impute_scale(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem").select("l_linenumber", F.when(F.col("l_quantity") > 5, F.col("l_quantity")).alias("q"), F.col("l_extendedprice").alias("x"))
    z, _ = learn.imputed_scaled(li, ["q", "x"])
    return z.groupBy("l_linenumber").agg(F.round(F.avg("q"), 6).alias("q"), F.round(F.max("x"), 6).alias("x"))


@query
def platt_calibration(spark: SparkSession, d: str) -> DataFrame:
    return learn.platt(scores(spark, d).select("doc_id", "y", "p"), "y", "p", "doc_id").select("doc_id", "y", "fold", "calibrated")


@query
def permutation_importance(spark: SparkSession, d: str) -> DataFrame:
    s = scores(spark, d).select("doc_id", "y", "p", (F.col("doc_id") % 10 / 10.0).alias("noise"))
    found = attribution.permutation_importance(s, ["p", "noise"], "y", lambda f: F.col("p") + 0.1 * F.col("noise"), key="doc_id")
    return spark.createDataFrame([(k, round(float(v), 9)) for k, v in found.items()], "feature string, importance double")
