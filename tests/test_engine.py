"""The screening engine: fixtures with known answers, and properties."""

import datetime as dt
import json
import math
import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from windrose.functions import geo, physics, text, when
from windrose.operators import attribution, classify, compositions, detect, grid, joins, learn, metrics, ordered, polygons, systems, tracks
from windrose.sources import checks, grid_source, readers, writers
from windrose.streaming import cycles


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def kilometres(a, b):
    p, q, r, s = map(math.radians, (*a, *b))
    return 2 * geo.EARTH_KM * math.asin(min(1, math.sqrt(math.sin((r - p) / 2) ** 2 + math.cos(p) * math.cos(r) * math.sin((s - q) / 2) ** 2)))


TRACKS = """SID,SEASON,BASIN,SUBBASIN,NAME,ISO_TIME,NATURE,LAT,LON,USA_WIND
 ,Year, , , , , ,degrees_north,degrees_east,kts
S1,2021,NA,MM,ALPHA,2021-06-01 06:00:00,DS,12.0,-40.0,20
S1,2021,NA,MM,ALPHA,2021-06-01 12:00:00,TS,12.5,-41.0,35
S2,2021,WP,MM,NOT_NAMED,2021-06-02 00:00:00,TS,10.0,179.5,30
S3,2021,WP,MM,,2021-06-02 00:00:00,TS,bad,180.5,30
"""


@pytest.fixture(scope="module")
def fixes(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("tracks") / "tracks.csv"
    path.write_text(TRACKS)
    return readers.track_csv(spark, str(path), seasons=None)


def test_track_reading_and_catalog(fixes):
    got = {r["sid"]: r for r in tracks.genesis_catalog(fixes).collect()}
    assert set(got) == {"S1", "S2"}
    assert (got["S1"]["ts"], got["S1"]["lat"], got["S1"]["lon"], got["S1"]["basin"]) == (dt.datetime(2021, 6, 1, 6), 12.0, 320.0, "NA")
    assert got["S2"]["name"] == "UNNAMED"
    tropical = {r["sid"]: r["ts"] for r in tracks.genesis_catalog(fixes, definition="first-tropical", tropical=("TS",)).collect()}
    assert tropical["S1"] == dt.datetime(2021, 6, 1, 12)


def test_labels(spark, fixes):
    files = spark.createDataFrame([("a", dt.datetime(2021, 5, 31, 6)), ("b", dt.datetime(2021, 6, 1, 6))], "path string, ts timestamp_ntz")
    got = {r["path"]: r for r in tracks.labels(files, fixes).collect()}
    assert got["a"]["is_genesis"] and got["a"]["genesis"][0]["sid"] == "S1" and got["a"]["genesis"][0]["lon"] == 320.0 and not got["a"]["is_active"]
    assert not got["b"]["is_genesis"] and (got["b"]["active"][0]["lat"], got["b"]["active"][0]["lon"]) == (12.0, 320.0)


def test_suppression_fixture(spark):
    points = [(1, 0.0, 0.0, 0.9), (2, 0.0, 2.0, 0.8), (3, 0.0, 10.0, 0.7), (4, 0.0, 12.0, 0.6)]
    df = spark.createDataFrame([(1, *p) for p in points], "cycle int, key long, lat double, lon double, conf double")
    kept = detect.suppress(df, 500.0, by=["cycle"], lat="lat", lon="lon", confidence="conf", key="key").collect()
    assert sorted(r["conf"] for r in kept) == [0.7, 0.9]


def test_matching_fixture(spark):
    pairs = spark.createDataFrame([("c", 1, 7, 50.0), ("c", 2, 7, 90.0)], "cycle string, p long, e long, km double")
    matched = joins.greedy_match(pairs, group=["cycle"], left="p", right="e", distance="km")
    assert [(r["p"], r["e"]) for r in matched.collect()] == [(1, 7)]
    p, e = joins.match_status(spark.createDataFrame([(1,), (2,)], "p long"), spark.createDataFrame([(7,), (8,)], "e long"), matched.select("p", "e", F.col("km").alias("distance_km")), prediction="p", event="e")
    m = metrics.event_metrics(p.withColumn("event_name", F.lit("x")), e).first()
    assert (m["pod"], m["precision"], m["far"], m["csi"]) == (0.5, 0.5, 0.5, pytest.approx(1 / 3))


def test_metric_fixture(spark):
    df = spark.createDataFrame([(1, 0.9), (0, 0.8), (1, 0.7), (0, 0.1)], "y int, p double")
    assert metrics.roc_auc(df, F.col("y"), F.col("p")).first()[0] == 0.75
    assert metrics.average_precision(df, F.col("y"), F.col("p")).first()[0] == pytest.approx(5 / 6)


def test_published_metrics(spark):
    rows = [(1, 1.0)] * 121 + [(0, 1.0)] * 4 + [(1, 0.0)] * 15 + [(0, 0.0)] * 132
    m = metrics.confusion(spark.createDataFrame(rows, "y int, p double"), F.col("y"), F.col("p"), 0.5).first()
    assert (m["precision"], m["recall"]) == (pytest.approx(0.9679999922560001, abs=1e-12), pytest.approx(0.8897058758109863, abs=1e-12))
    assert m["f1"] == pytest.approx(0.9272030615815975, abs=1e-6)


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.floats(-89.9, 89.9), st.floats(-180, 180)), min_size=1, max_size=25), st.sampled_from([100.0, 900.0, 5000.0]))
def test_distance_join_is_exact(spark, points, km):
    points = [*points, (89.5, 10.0), (89.5, -170.0), (0.0, 179.9), (0.0, -179.9), (-90.0, 0.0)]
    rows = [(i, float(a), float(b)) for i, (a, b) in enumerate(points)]
    left = spark.createDataFrame(rows, "i long, a double, b double")
    right = spark.createDataFrame(rows, "j long, c double, d double")
    got = sorted((r["i"], r["j"]) for r in joins.distance_join(left, right, km, left_at=("a", "b"), right_at=("c", "d")).collect())
    sure = [(x[0], y[0]) for x in rows for y in rows if kilometres(x[1:], y[1:]) <= km - 1e-6]
    maybe = [(x[0], y[0]) for x in rows for y in rows if kilometres(x[1:], y[1:]) <= km + 1e-6]
    assert len(got) == len(set(got)) and set(sure) <= set(got) <= set(maybe)


def test_density_clusters(spark):
    rows = [(1, 0.0, 0.0), (2, 0.0, 1.0), (3, 0.0, 2.0), (4, 0.0, 3.0), (9, 0.0, 50.0)]
    df = spark.createDataFrame(rows, "key long, lat double, lon double")
    got = {r["key"]: r["cluster"] for r in detect.density_clusters(df, 120.0, 3, key="key", lat="lat", lon="lon").collect()}
    assert got == {1: 2, 2: 2, 3: 2, 4: 2}


def test_text_and_time(spark):
    assert one(spark, text.coordinate(F.lit("13.4N"))) == 13.4 and one(spark, text.coordinate(F.lit("20W"))) == -20 and one(spark, text.coordinate(F.lit("x"))) is None
    assert one(spark, geo.lon_180(F.lit(-180.0))) == 180 and one(spark, geo.lon_360(F.lit(-1.0))) == 359
    assert one(spark, when.analysis_time(F.lit("fnl_20240102_06_00.grib2"))) == dt.datetime(2024, 1, 2, 6)
    assert one(spark, when.underscore_time(F.lit("merra2_20240102_06_00.nc"))) == dt.datetime(2024, 1, 2, 6)
    near = F.lit("2024-03-01 02:00:00").cast("timestamp_ntz")
    assert one(spark, when.bulletin_time(F.lit(29), F.lit("2330"), near)) == dt.datetime(2024, 2, 29, 23, 30)
    assert one(spark, when.parse_iso(F.lit("2024-01-02T03:04:05Z"))) == dt.datetime(2024, 1, 2, 3, 4, 5)
    assert one(spark, when.month_starts(F.lit("2023-11-15").cast("date"), 3)) == [dt.date(2023, 11, 1), dt.date(2023, 12, 1), dt.date(2024, 1, 1)]
    assert one(spark, physics.safe_float(F.lit("nan"), 7.0)) == 7.0


def test_bulletin(spark):
    body = "A.  12W (NONAME)\nB.  27/0530Z\nC.  13.4N\nD.  177.0E\nF.  T2.5/2.5\n"
    got = systems.bulletins(spark.createDataFrame([(body, "http://x/wpac/20260727053012W.html")], "body string, url string")).first()
    assert (got["storm_id"], got["name"], got["time"], got["latitude"], got["longitude"], got["status"], got["basin"]) == ("12W", "12W", dt.datetime(2026, 7, 27, 5, 30), 13.4, 177.0, "TD", "Western Pacific")
    links = systems.bulletin_links(spark.createDataFrame([('<a href="/wpac/20260727053012W.html">x</a>',)], "html string")).first()
    assert (links["basin_code"], links["storm_id"]) == ("wpac", "12W")


def test_feeds_and_dedup(spark):
    doc = json.dumps({"activeStorms": [{"id": "al01", "name": "", "classification": "PT", "lastUpdate": "2024-01-02T00:00:00Z", "latitude": "12.0N", "longitude": "40.0W", "intensity": "35", "pressure": "null"}, {"id": "al02", "name": "B", "classification": "TS", "lastUpdate": "2023-01-02T00:00:00Z", "latitudeNumeric": 1.0, "longitudeNumeric": 2.0}]})
    now = F.lit("2024-01-02 06:00:00").cast("timestamp_ntz")
    got = systems.nhc_systems(spark.createDataFrame([(doc,)], "json string"), now).collect()
    assert [(r["storm_id"], r["name"], r["status"], r["longitude"], r["intensity_kt"], r["pressure_hpa"], r["basin"]) for r in got] == [("AL01", "al01", "PTC", -40.0, 35.0, None, "North Atlantic")]
    t = dt.datetime(2024, 1, 1)
    rows = [("A", 10.0, 20.0, t), ("A", 11.0, 21.0, t + dt.timedelta(hours=6)), ("B", 11.1, 21.1, t + dt.timedelta(hours=5)), ("UNKNOWN", 50.0, 0.0, t), ("UNKNOWN", -50.0, 0.0, t)]
    kept = systems.deduplicated(spark.createDataFrame(rows, "storm_id string, latitude double, longitude double, time timestamp_ntz")).collect()
    assert sorted((r["storm_id"], r["latitude"]) for r in kept) == [("A", 11.0), ("UNKNOWN", -50.0), ("UNKNOWN", 50.0)]


def test_cascade_order(spark):
    def classified(**given):
        base = dict(distance=None, age=None, status=None, land=0.0, rh=70.0, shear=5.0, vorticity=1e-5, checks=6, hybrid=0.99, learned=None)
        c = {k: F.lit(v).cast("string" if k == "status" else "double") for k, v in {**base, **given}.items()}
        r = one(spark, classify.cascade(**c))
        return r["system_class"], r["confidence"]

    assert classified(distance=600, age=36, status="ts") == ("ACTIVE_CYCLONE", 0.95)
    assert classified(distance=600.1, age=36, status="TS", land=0.3, learned=0.9) == ("MONSOON_OR_LAND_LOW", 0.72)
    assert classified(distance=640, age=40, status="DB", learned=0.4) == ("INVEST_OR_DEVELOPING_SYSTEM", 0.6)
    assert classified(learned=0.4) == ("HIGH_PRIORITY_MODEL_GENESIS_CANDIDATE", 0.95)
    assert classified(checks=0, vorticity=0.0, learned=None) == ("UNCLASSIFIED_DISTURBANCE", 0.40)


def test_logistic_gates():
    model = classify.PostClassifier({"model_type": "logistic_regression", "feature_names": ["a"], "coefficients": {"a": 1}, "intercept": 0, "training_samples": 110, "validation_metrics": {"precision": 0.29, "csi": 0.284, "rules_precision": 0.269, "rules_csi": 0.264}})
    assert model.usable()
    with pytest.raises(ValueError):
        classify.PostClassifier({"model_type": "tree"})


def test_box_and_patches(spark):
    rows = [(0, r, c, float(r * 10 + c)) for r in range(5) for c in range(6)]
    df = spark.createDataFrame(rows, "cycle int, row int, col int, value double")
    got = {(r["row"], r["col"]): r["box_mean"] for r in grid.box_mean(df, 1, by=["cycle"], row="row", column="col", value="value", columns=6).collect()}
    for (r, c), mean in got.items():
        cells = [min(max(r + i, 0), 4) * 10 + (c + j) % 6 for i in (-1, 0, 1) for j in (-1, 0, 1)]
        assert mean == pytest.approx(sum(cells) / 9)
    cells = df.select("cycle", "row", "col", F.array(F.col("value").cast("float")).alias("stack"), F.lit(True).alias("candidate"))
    patches = {(r["row"], r["col"]): r["patch"] for r in grid.patches(cells, 1, 6).collect()}
    assert len(patches) == 18 and patches[1, 0] == [5.0, 0.0, 1.0, 15.0, 10.0, 11.0, 25.0, 20.0, 21.0]
    scored = grid.scored(grid.patches(cells, 1, 6), lambda x: x.mean(1, keepdims=True), ["score"])
    assert scored.where("row = 1 AND col = 0").first()["score"] == pytest.approx(12.0)
    assert len(grid.channels()) == 137 and grid.channels()[136] == (136, "landmask", None)


def test_grid_validation(spark):
    good = [("tmpsfc", 0.0, 0.0, 1.0)]
    schema = "variable string, lat double, lon double, value double"
    grid.validate_grid(spark.createDataFrame(good, schema), variables=["tmpsfc"])
    for bad in [("tmpsfc", 91.0, 0.0, 1.0), ("tmpsfc", 0.0, 360.0, 1.0), ("tmpsfc", 0.0, 0.0, float("nan")), ("x", 0.0, 0.0, 1.0)]:
        with pytest.raises(ValueError):
            grid.validate_grid(spark.createDataFrame([bad], schema), variables=["tmpsfc"])
    with pytest.raises(ValueError):
        joins.merge_exact(spark.createDataFrame([(1, 2)], "k int, a int"), spark.createDataFrame([(2, 2)], "k int, b int"), ["k"])


def test_learning_separates(spark):
    rows = [(i, i % 2, (i % 2) * 2.0 + (i * 7919 % 100) / 50.0, None if i % 9 == 0 else float(i % 5)) for i in range(200)]
    df = spark.createDataFrame(rows, "key long, y int, a double, b double")
    model = learn.post_classifier(df, ["a", "b"], "y", "key", rules=F.col("a") > 3.5)
    assert model["coefficients"]["a"] > 0 and model["validation_metrics"]["csi"] > 0.6
    assert sorted(r["fold"] for r in learn.folds(df, "y", "key").groupBy("fold").count().collect()) == [0, 1, 2, 3, 4]
    with pytest.raises(ValueError):
        learn.usable_features(df, ["a", "missing"], [])


def test_permutation_keeps_all_values(spark):
    df = spark.range(100).select(F.col("id").alias("key"), (F.col("id") * 2).alias("v"))
    got = attribution.permuted(df, "v", key="key").collect()
    assert sorted(r["v"] for r in got) == [2 * i for i in range(100)] and sorted(r["key"] for r in got) == list(range(100))
    assert any(r["v"] != 2 * r["key"] for r in got)


def test_writers_and_readers(spark, tmp_path):
    path = f"file://{tmp_path}/config.json"
    writers.upsert_json(spark, path, "a", 0.5)
    writers.upsert_json(spark, path, "b", 0.25)
    assert readers.thresholds(spark, path) == {"a": 0.5, "b": 0.25}
    df = spark.createDataFrame([(1.0, 2.0, float("nan"), 3)], "latitude double, longitude double, score double, k int")
    doc = json.loads(writers.geojson(df, {"m": 1}, order=["k"]))
    assert doc["features"][0]["geometry"]["coordinates"] == [2.0, 1.0] and doc["features"][0]["properties"] == {"score": None, "k": 3}
    spark.createDataFrame([(i, 0.0, 1.0) for i in range(136)], "idx int, mean double, std double").write.parquet(str(tmp_path / "stats"))
    assert readers.channel_statistics(spark, str(tmp_path / "stats")).count() == 137
    landed = spark.createDataFrame([(dt.datetime(2024, 1, 2, 6),), (dt.datetime(2024, 1, 1, 0),)], "ts timestamp_ntz")
    assert readers.newest_cycle(landed, dt.datetime(2024, 1, 3, 1)).first()["ts"] == dt.datetime(2024, 1, 2, 6)


def test_grid_source(spark, tmp_path):
    path = str(tmp_path / "a.parquet")
    spark.createDataFrame([("tmpprs", 850.0, 1.0, 2.0, 3.0), ("tmpprs", 500.0, 1.0, 2.0, 4.0), ("rhprs", 850.0, 1.0, 2.0, 5.0)], "variable string, lev double, lat double, lon double, value double").coalesce(1).write.parquet(path)
    grid_source.register(spark)
    got = spark.read.format("grid").option("paths", path).load().where("variable = 'tmpprs' AND lev = 850.0").collect()
    assert [(r["value"], r["error"]) for r in got] == [(3.0, None)]
    broken = str(tmp_path / "b.parquet")
    (tmp_path / "b.parquet").write_text("no parquet")
    both = spark.read.format("grid").option("paths", f"{path},{broken}").option("mode", "PERMISSIVE").load().collect()
    assert sorted((r["value"] or 0.0, r["error"] is None) for r in both) == [(0.0, False), (3.0, True), (4.0, True), (5.0, True)]
    with pytest.raises(Exception, match="(?i)parquet"):
        spark.read.format("grid").option("paths", broken).load().collect()


def test_streams(spark, tmp_path):
    folder, out = str(tmp_path / "in"), str(tmp_path / "cp")
    t = dt.datetime(2024, 1, 1)
    rows = [("A", t, 1.0), ("A", t + dt.timedelta(hours=7), 2.0), ("B", t, 3.0)]
    spark.createDataFrame(rows, "storm string, ts timestamp, v double").write.parquet(folder)
    stream = cycles.landed(spark, folder, "storm string, ts timestamp, v double")
    seen = []
    cycles.run_cycles(stream, lambda df, i: seen.extend(tuple(r) for r in df.collect()), checkpoint=out).awaitTermination()
    assert len(seen) == 3
    q = cycles.newest_per_storm(stream, storm="storm", ts="ts", values=["v"]).writeStream.format("memory").queryName("newest").outputMode("update").option("checkpointLocation", str(tmp_path / "cp2")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted((r["storm"], r["v"]) for r in spark.table("newest").collect()) == [("A", 2.0), ("B", 3.0)]


# --- order without a single task ---------------------------------------------------------------------------------------


def test_running_and_quantiles(spark):
    rng = random.Random(1)
    rows = [(rng.choice(["a", "b", None]), float(rng.randrange(40))) for _ in range(500)] + [("c", 7.0)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(6)
    for by in ([], ["g"]):
        groups = {}
        for g, v in rows:
            groups.setdefault(g if by else "", []).append(v)
        got = {(r["g"] if by else ""): r for r in ordered.quantiles(df, "v", {"low": 0.1, "mid": 0.5, "top": 1.0}, by=by).collect()}
        assert set(got) == set(groups)
        for g, values in groups.items():
            values.sort()
            for name, q in (("low", 0.1), ("mid", 0.5), ("top", 1.0)):
                at = q * (len(values) - 1)
                want = values[math.floor(at)] + (at - math.floor(at)) * (values[math.ceil(at)] - values[math.floor(at)])
                assert got[g][name] == pytest.approx(want)
    ranks = ordered.running(spark.range(100).repartition(5), [F.desc("id")], {"n": F.lit(1)}).collect()
    assert all(r["n"] == 100 - r["id"] and r["all_n"] == 100 for r in ranks)
    assert ordered.quantiles(df.limit(0), "v", {"mid": 0.5}).first()["mid"] is None
    whole = metrics.distribution(df, "v").first()
    assert whole["min"] == 0.0 and whole["median"] == pytest.approx(sorted(v for _, v in rows)[250])


def test_large_groups_in_rounds(spark, monkeypatch):
    """What folds keep, rounds keep."""
    rng = random.Random(2)
    points = [(i % 2, i, rng.uniform(-60, 60), rng.uniform(-180, 180), float(rng.randrange(30))) for i in range(160)]
    df = spark.createDataFrame(points, "g int, key long, lat double, lon double, conf double")
    options = {"by": ["g"], "lat": "lat", "lon": "lon", "confidence": "conf", "key": "key"}
    folded = sorted(map(tuple, detect.suppress(df, 2000.0, **options).collect()))
    pairs = joins.distance_join(df.where("key % 3 = 0").select("g", F.col("key").alias("p"), "lat", "lon"), df.where("key % 3 = 1").select("g", F.col("key").alias("e"), F.col("lat").alias("lat2"), F.col("lon").alias("lon2")), 6000.0, left_at=("lat", "lon"), right_at=("lat2", "lon2"), on=["g"])
    matched = sorted(map(tuple, joins.greedy_match(pairs, group=["g"], left="p", right="e", distance="distance_km").collect()))
    monkeypatch.setattr(detect, "FOLD_ROWS", 5)
    monkeypatch.setattr(joins, "FOLD_ROWS", 5)
    assert sorted(map(tuple, detect.suppress(df, 2000.0, **options).collect())) == folded and len(folded) > 20
    assert sorted(map(tuple, joins.greedy_match(pairs, group=["g"], left="p", right="e", distance="distance_km").collect())) == matched and len(matched) > 20
    start = dt.datetime(2024, 1, 1)
    left = df.select("key", "lat", "lon", F.lit(start).cast("timestamp_ntz").alias("t"))
    sys = df.select((F.col("key") + 500).alias("skey"), F.col("lat").alias("sl"), (F.col("lon") / 2).alias("so"), when.plus_hours(F.lit(start).cast("timestamp_ntz"), (F.col("key") % 30).cast("int")).alias("st"))
    find = lambda most: sorted((r["key"], r["skey"], r["distance_km"]) for r in joins.nearest_with_age(left, sys, left_at=("lat", "lon"), left_time="t", key="skey", system_at=("sl", "so"), system_time="st", most=most).collect())
    assert find(2000) == find(7)


def test_dense_groups_in_turns(spark, monkeypatch):
    """A large group where many are near each other needs no pairs; copies of a position, nulls and a limit change nothing."""
    rng = random.Random(4)
    points = [(None if i % 3 else 1, i, rng.randrange(-20, 20) / 2.0, rng.randrange(-20, 20) / 2.0, float(rng.randrange(50))) for i in range(600)]
    points += [(1, 1000, None, 5.0, 60.0), (None, 1001, None, None, -1.0)]
    df = spark.createDataFrame(points, "g int, key long, lat double, lon double, conf double")
    options = {"by": ["g"], "lat": "lat", "lon": "lon", "confidence": "conf", "key": "key"}
    ordered_rows = lambda **o: sorted(map(repr, detect.suppress(df, 400.0, **options, **o).collect()))
    folded, three = ordered_rows(), ordered_rows(top=3)
    assert len(folded) > 10 and len(three) == 6 and sum("lat=None" in r for r in folded) == 2
    monkeypatch.setattr(detect, "FOLD_ROWS", 7)
    monkeypatch.setattr(detect, "_by_pairs", lambda *a: pytest.fail("pairs of a dense group"))
    assert ordered_rows() == folded and ordered_rows(top=3) == three


def test_groups_are_folded_in_many_tasks(spark):
    """Groups are few bytes and much arithmetic; they aren't gathered in as few tasks as their bytes would fit in."""
    df = spark.range(40_000).select((F.col("id") % 400).alias("g"), F.col("id").alias("key"), ((F.col("id") * 7919) % 141 - 70.0).alias("lat"), ((F.col("id") * 104729) % 360 - 180.0).alias("lon"), (F.col("id") % 97 / 97.0).alias("conf"))
    kept = detect._folded(df, 1500.0, ["g"], "lat", "lon", "conf", "key")
    assert kept.select(F.spark_partition_id()).distinct().count() > 12


def test_dense_rows_after_scattered_ones(spark, monkeypatch):
    """Where the first rows of a large group are far from a dense rest, this rest makes no pairs of its rows either."""
    rng = random.Random(7)
    points = [(g, i, -60.0 + 10 * (i // 12), -180.0 + 30 * (i % 12), 1000.0 - i) for g in (1, None) for i in range(60)]
    points += [(g, i, rng.uniform(40, 50), rng.uniform(170, 190), float(rng.randrange(30))) for g in (1, None) for i in range(100, 500)]
    points += [(1, 1000, None, 5.0, 0.0)]
    df = spark.createDataFrame(points, "g int, key long, lat double, lon double, conf double")
    run = lambda km: sorted(map(repr, detect.suppress(df, km, by=["g"], lat="lat", lon="lon", confidence="conf", key="key").collect()))
    folded, apart = run(300.0), run(0.0)
    assert len(folded) > 130 and len(apart) == len(points)
    made, join = [], joins.distance_join

    def counted(*args, **options):
        out = join(*args, **options)
        made.append(out.count() if options.get("how", "inner") == "inner" else 0)
        return out

    monkeypatch.setattr(joins, "distance_join", counted)
    monkeypatch.setattr(detect, "FOLD_ROWS", 20)
    assert run(300.0) == folded and 0 < max(made) < 5 * len(points)
    assert run(0.0) == apart


def test_nearest_by_rings(spark, monkeypatch):
    """Many systems meet the rows around them only; far rows, copies, poles and nulls get what a full comparison gives."""
    rng = random.Random(5)
    place = lambda: (float(rng.randrange(-180, 181)) / 2, float(rng.randrange(-180, 180)))
    left = [(i, i % 3, *place(), rng.randrange(40)) for i in range(150)] + [(900, 0, 89.9, 10.0, 3), (901, 0, None, 10.0, 3), (902, 7, 1.0, 1.0, 1)]
    systems = [(i, 0, *place(), rng.randrange(40)) for i in range(300)] + [(1000 + i, 1, 10.0, 20.0, i % 5) for i in range(90)] + [(2000 + i, 2, *place(), 9) for i in range(5)] + [(2, 0, None, None, 1)]
    start = F.lit(dt.datetime(2024, 1, 1)).cast("timestamp_ntz")
    l = spark.createDataFrame(left, "key long, g int, lat double, lon double, h int").withColumn("t", when.plus_hours(start, F.col("h")))  # noqa: E741
    s = spark.createDataFrame(systems, "skey long, g int, slat double, slon double, h int").select("skey", "g", "slat", "slon", when.plus_hours(start, F.col("h")).alias("st"))
    seen = []
    plain = joins.distance_join
    monkeypatch.setattr(joins, "distance_join", lambda *a, **o: seen.append(a[2]) or plain(*a, **o))
    find = lambda most: sorted((r["key"], r["skey"], r["distance_km"], r["age_hours"]) for r in joins.nearest_with_age(l, s, left_at=("lat", "lon"), left_time="t", key="skey", system_at=("slat", "slon"), system_time="st", on=["g"], most=most).collect())
    whole = find(10_000)
    assert not seen and find(50) == whole and min(seen) < 3000 and max(seen) > 9000
    got = {k: rest for k, *rest in whole}
    assert len(got) == 153 and got[901] == [None] * 3 and got[902] == [None] * 3 and got[900][0] is not None


def test_pairs_by_position(spark, monkeypatch):
    """Pairs of rows at few positions: each pair once, distances from pairs of positions, arrays of a bounded length."""
    rng = random.Random(6)
    points = [(i * 3 % 101, rng.choice([-30.0, 0.0, 0.0, 88.0]), rng.choice([179.5, -179.5, 0.0, 4.0])) for i in range(100)] + [(500, None, 1.0)]
    df = spark.createDataFrame(points, "key long, lat double, lon double")
    monkeypatch.setattr(joins, "ARRAY_KEYS", 3)
    monkeypatch.setattr(joins, "TASK_PAIRS", 100)
    seen, plain = [], joins.distance_join
    monkeypatch.setattr(joins, "distance_join", lambda l, *a, **o: seen.append(l.count()) or plain(l, *a, **o))  # noqa: E741
    pairs = joins.pairs_within(df, 500.0, key="key", lat="lat", lon="lon", digits=6)
    want = plain(df, df.select(F.col("key").alias("k2"), F.col("lat").alias("la2"), F.col("lon").alias("lo2")), 500.0, left_at=("lat", "lon"), right_at=("la2", "lo2")).where("key < k2").select("key", "k2", F.round("distance_km", 6))
    got = sorted(map(tuple, pairs.collect()))
    assert got == sorted(map(tuple, want.collect())) and len(got) > 300 and seen[0] <= 12
    assert joins.pairs_within(df.limit(0), 500.0, key="key", lat="lat", lon="lon").count() == 0


def test_matches_band_by_band(spark, monkeypatch):
    """Bands of distances match what all pairs do, and make fewer of them."""
    rng = random.Random(7)
    place = lambda: (float(rng.randrange(-40, 40)), float(rng.randrange(-180, 180, 2)))
    l = spark.createDataFrame([(i % 2, i, *place()) for i in range(300)] + [(0, 999, None, 1.0)], "g int, p long, lat double, lon double")  # noqa: E741
    r = spark.createDataFrame([(i % 2, i, *place()) for i in range(40)] + [(1, 40 + i, 5.0, 6.0) for i in range(4)], "g int, e long, la2 double, lo2 double")
    pairs = joins.distance_join(l, r, 4000.0, left_at=("lat", "lon"), right_at=("la2", "lo2"), on=["g"]).select("g", "p", "e", F.round("distance_km", 6).alias("distance_km"))
    want = sorted(map(tuple, joins.greedy_match(pairs, group=["g"], left="p", right="e", distance="distance_km").collect()))
    made, plain = [], joins.greedy_match
    monkeypatch.setattr(joins, "greedy_match", lambda df, **o: made.append(df.count()) or plain(df, **o))
    monkeypatch.setattr(joins, "BAND_PAIRS", 0.1)
    got = joins.match_within(l, r, 4000.0, group=["g"], left_key="p", right_key="e", left_at=("lat", "lon"), right_at=("la2", "lo2"))
    assert sorted(map(tuple, got.select("g", "p", "e", "distance_km").collect())) == want and len(want) == 44
    assert len(made) > 1 and 2 * sum(made) < pairs.count()


def test_negative_centers_stay_in_their_row(spark):
    """The first try that is inside, for every point, without a shuffle or a sort of the tries."""
    rows = [(1, 0.0, 100.0), (1, 29.0, 100.0), (2, 0.0, 5.0), (3, 60.0, 100.0), (4, None, 100.0)]
    df = spark.createDataFrame(rows, "key long, lat double, lon double")
    found = tracks.negative_centers(df, key="key", distances=[8.0, 16.0], box=(-30.0, 30.0, 10.0, 350.0))
    assert found.columns == ["key", "lat", "lon", "shift", "angle", "new_lat", "new_lon"]
    got = sorted((r["key"], r["lat"], r["shift"], r["angle"]) for r in found.collect())
    assert got == [(1, 0.0, 16.0, 0), (1, 29.0, 16.0, 0), (2, 0.0, 16.0, 0)]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Sort" not in plan


def test_values_are_not_shuffled_by_channel(spark):
    """Statistics are few: values meet them where they are, also where Spark by itself would broadcast nothing."""
    df = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("b", 5.0), ("b", 5.5)], "variable string, value double")
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        z = grid.normalised(df, grid.channel_stats(df, by=["variable"], value="value", epsilon=0.0), by=["variable"], value="value")
        plan = z._jdf.queryExecution().executedPlan().toString()
        assert "hashpartitioning" not in plan and sorted(map(tuple, z.collect())) == [("a", 1.0, -1.0), ("a", 3.0, 1.0), ("b", 5.0, -1.0), ("b", 5.5, 1.0)]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)


def test_points_are_not_grouped(spark):
    """Crossings are counted where a point meets a polygon's edges: no aggregate or shuffle after the join."""
    ring = spark.createDataFrame([(1, 0, n, *v) for n, v in enumerate([(0.0, 350.0), (0.0, 10.0), (10.0, 10.0), (10.0, 350.0)])] + [(1, 1, n, *v) for n, v in enumerate([(4.0, 1.0), (6.0, 1.0), (6.0, 3.0), (4.0, 3.0)])], "polygon int, ring int, nth int, latitude double, longitude double")
    points = spark.createDataFrame([(1, 5.0, 355.0), (2, 5.0, 2.0), (3, 5.0, 5.0), (4, 5.0, 20.0), (5, None, 1.0)], "key long, lat double, lon double")
    found = polygons.inside(points, polygons.edges(ring, band=5.0), key=["key"], latitude="lat", longitude="lon", band=5.0)
    assert sorted(map(tuple, found.collect())) == [(1, 1), (3, 1)]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(key" not in plan


def test_boxes_by_cells(spark):
    rng = random.Random(3)
    p = [(i, i % 3, rng.uniform(-89, 89), rng.choice([-179.5, 179.5, rng.uniform(-180, 360)])) for i in range(80)]
    f = [(i % 3, rng.uniform(-89, 89), rng.choice([179.9, -179.9, rng.uniform(-180, 180)])) for i in range(25)]
    for half in (0.4, 7.0, 20.0, 200.0):
        got = {r["k"] for r in joins.box_exclusion(spark.createDataFrame(p, "k int, t int, lat double, lon double"), spark.createDataFrame(f, "ft int, lat double, lon double"), time="t", fix_time="ft", lat="lat", lon="lon", half=half).collect()}
        off = lambda a, b: abs((a - b + 180) % 360 - 180)
        assert got == {k for k, t, la, lo in p if not any(t == u and abs(la - a) <= half and off(o, lo) <= half for u, a, o in f)}


# --- whole runs --------------------------------------------------------------------------------------------------------


def test_stored_inputs(spark, tmp_path):
    names = checks.channel_names()
    checks.channel_list(names)
    assert len(names) == 137
    for bad, said in ((names[1:], "index 0"), (names[:-1], "136 channels"), ({}, "not a list")):
        with pytest.raises(ValueError, match=said):
            checks.channel_list(bad)
    good = {"dataset": "fnl", "num_channels": 137, "patch_size": 21}
    assert checks.training_metadata(good, patch=21) and not checks.training_metadata({**good, "dataset": "x"}, patch=21, allow_other=True)
    for bad in ({**good, "dataset": "x"}, {**good, "patch_size": 3}, []):
        with pytest.raises(ValueError):
            checks.training_metadata(bad, patch=21)
    (tmp_path / "a").write_text("x")
    assert checks.inputs_there(spark, [str(tmp_path / "a")], [str(tmp_path / "b")]) == [str(tmp_path / "b")]
    with pytest.raises(FileNotFoundError):
        checks.inputs_there(spark, [str(tmp_path / "c")], [])


def test_enrichment(spark):
    rows = spark.createDataFrame([("f", 1), ("f", 2), ("g", 1)], "file string, cell int")
    cache = spark.createDataFrame([("f", 1, 0.5, None)], "file string, cell int, xai_mean_rhprs double, midlevel_rh_percent double")
    cells = spark.createDataFrame([("f", 2, "rhprs", 600.0, 40.0, False), ("f", 2, "rhprs", 500.0, 60.0, True), ("f", 1, "rhprs", 600.0, 1.0, True)], "file string, cell int, variable string, lev double, value double, is_center boolean")
    seen = spark.createDataFrame([("f", 2, "rhprs", -3.0), ("f", 2, "hgtprs", 1.0)], "file string, cell int, variable string, value double")
    got = sorted(tuple(r) for r in compositions.enriched(rows, cache, cells, seen, keys=["file", "cell"]).select("file", "cell", "xai_mean_rhprs", "midlevel_rh_percent").collect())
    assert got == [("f", 1, 0.5, None), ("f", 2, 0.75, 50.0), ("g", 1, None, None)]


def test_reports_and_training(spark, tmp_path):
    rows = spark.createDataFrame([(i, int(i >= 60), i / 100) for i in range(100)], "key long, y int, p double")
    metrics.prediction_sanity(rows, "y", "p")
    with pytest.raises(ValueError):
        metrics.prediction_sanity(rows.where("y = 1"), "y", "p")
    path = f"file://{tmp_path}/thresholds.json"
    assert compositions.threshold_report(spark, rows, path, "f1", label=F.col("y"), score=F.col("p"))["f1"]["threshold"] == 0.6
    assert set(compositions.threshold_report(spark, rows, path, "recall", label=F.col("y"), score=F.col("p"), least_recall=0.5)) == {"f1", "recall"}
    shape, top = compositions.raw_sweep(rows, score="p", key="key", top=3)
    assert (shape.first()["high"], shape.first()["constant"]) == (49, False) and [r["key"] for r in top.collect()] == [99, 98, 97]
    curve = metrics.pr_curve(rows, F.col("y"), F.col("p")).orderBy("score").collect()
    assert len(curve) == 100 and curve[60]["precision"] == curve[60]["recall"] == 1.0 and curve[0]["precision"] == 0.4
    make = lambda epoch: [(r["key"], r["label"], r["batch"]) for r in compositions.training_epoch(rows.where("y = 1").select("key"), rows.where("y = 0").select("key"), key="key", ratio=3, epoch=epoch, batch=32).orderBy("batch", "label", "key").collect()]
    a = make(1)
    assert len(a) == 160 and sum(y for _, y, _ in a) == 40 and make(1) == a != make(2)
    assert [sum(b == n for *_, b in a) for n in range(5)] == [32] * 5


def test_augmentation(spark):
    patches = spark.range(400).select("id", F.array(*[F.lit(1.0)] * 8).alias("p"))
    draw = lambda seed: {r["id"]: r["x"] for r in patches.select("id", compositions.augmented(F.col("p"), F.col("id"), channels=4, last=3, seed=seed).alias("x")).collect()}
    got = draw(1)
    assert got == draw(1) != draw(2) and all(x[3] == x[7] == 1.0 for x in got.values())
    same = sum(x == [1.0] * 8 for x in got.values())
    assert 80 < same < 200 and all(abs(v - 1) < 0.1 or v == 0 for x in got.values() for v in x)


def test_small_helpers(spark, tmp_path):
    (tmp_path / "1999_storms.txt").write_text("01 32.5 10.0 350.0\nbad line\n")
    r = readers.yearly_storm_text(spark, str(tmp_path / "1999_storms.txt")).first()
    assert (r["sid"], r["lat"], r["lon"]) == ("1999-01", 10.0, 350.0) and r["date"].month == 2
    for d in ("x", "x/y"):
        (tmp_path / d).mkdir()
        (tmp_path / d / "a_predictions.csv").write_text("k\n1\n")
    assert readers.prediction_csvs(spark, str(tmp_path / "x"), str(tmp_path / "x"), schema="k int").count() == 2
    listed = spark.createDataFrame([(json.dumps([{"name": "unnamed", "storm_id": "W1", "latitude": "10", "longitude": "370", "time": "2024-01-01T00:00:00Z"}, {"name": "x"}]),)], "json string")
    assert [(r["name"], r["status"]) for r in systems.listed_systems(listed).collect()] == [("W1", "UNKNOWN")]
    levels = spark.createDataFrame([("a", "tmpprs", float(x)) for x in grid.LEVELS] + [("b", "tmpprs", 850.0)], "cycle string, variable string, lev double")
    assert [r["cycle"] for r in grid.complete_levels(levels).collect()] == ["a"]
    z = one(spark, grid.normalised_patch(F.array(F.lit(3.0), F.lit(float("nan")), F.lit(9.0)), F.array(*map(F.lit, [1.0, 0.0, 0.0])), F.array(*map(F.lit, [2.0, 1.0, 1.0])), last=2))
    assert z == [1.0, 0.0, 9.0]
    assert [one(spark, learn.hit_label(F.lit(x))) for x in (" hit", "False  Alarm", "?")] == [1, 0, None]
    found = one(spark, attribution.by_prefix(F.create_map(F.lit("xai_a"), F.lit(0.2), F.lit("xai_b"), F.lit(0.7), F.lit("c"), F.lit(9.0)), "xai_"))
    assert [tuple(x) for x in found] == [("b", 0.7), ("a", 0.2)]
    ts = F.lit("2024-03-01 06:00:00").cast("timestamp_ntz")
    assert one(spark, when.iso_z(ts)) == "2024-03-01T06:00:00Z" and one(spark, when.archive_url(ts, "http://h/")).startswith("http://h/2024/202403/")
    assert one(spark, text.pipe_key(F.lit("a"), F.lit(None), F.lit(3))) == "a||3"
    moved = spark.range(300).select(*[c.alias(n) for c, n in zip(tracks.jittered(F.lit(10.0), F.lit(359.0), F.col("id")), "ab", strict=True)]).collect()
    assert {r["a"] for r in moved} == {8.0, 9.0, 10.0, 11.0, 12.0} and {r["b"] for r in moved} == {357.0, 358.0, 359.0, 0.0, 1.0}
    now = dt.datetime(2024, 1, 4)
    ages = spark.createDataFrame([(now - dt.timedelta(hours=h),) for h in (-3, -1, 5, 71, 80)], "ts timestamp")
    assert cycles.fresh(ages, ts="ts", now=now).count() == 3
    six = cycles.six_hour_counts(ages, ts="ts").collect()
    assert sum(r["n"] for r in six) == 5
