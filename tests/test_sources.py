"""The GeoJSON sink, gridded files and active systems on streams, checks in a run's own scan, fits of all folds."""

import datetime as dt
import json
import math
import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from windrose.operators import grid, learn, systems
from windrose.sources import geojson_sink, grid_stream
from windrose.streaming import active

# publishing


def detections(spark, n=5):
    rows = [(float(i), float(-i), 0.5 + i / 10, {"b": 1.0, "a": math.nan} if i else None, "x" if i % 2 else None) for i in range(n)]
    return spark.createDataFrame(rows, "latitude double, longitude double, confidence double, xai_mean map<string,double>, matched string")


def publish(df, folder, name, **options):
    df.write.format("geojson").mode("append").options(path=folder, name=name, flatten="xai_mean", **options).save()


def test_one_document_and_the_latest(spark, tmp_path):
    geojson_sink.register(spark)
    meta = json.dumps({"threshold": 0.75})
    publish(detections(spark).orderBy(F.desc("confidence")).coalesce(1), f"file://{tmp_path}", "forecast_24h_1", latest="24h", metadata=meta)
    assert sorted(os.listdir(tmp_path)) == ["forecast_24h_1.geojson", "latest_24h.geojson"]
    first, latest = ((tmp_path / n).read_text() for n in ("forecast_24h_1.geojson", "latest_24h.geojson"))
    doc = json.loads(first)
    assert first == latest and doc["type"] == "FeatureCollection" and doc["metadata"] == {"threshold": 0.75}
    assert [f["properties"]["confidence"] for f in doc["features"]] == [0.9, 0.8, 0.7, 0.6, 0.5]
    assert doc["features"][0] == {"type": "Feature", "geometry": {"type": "Point", "coordinates": [-4.0, 4.0]}, "properties": {"confidence": 0.9, "matched": None, "xai_mean_a": None, "xai_mean_b": 1.0}}
    publish(detections(spark, 2).coalesce(1), f"file://{tmp_path}", "forecast_24h_2", latest="24h")
    assert len(json.loads((tmp_path / "latest_24h.geojson").read_text())["features"]) == 2
    assert len(json.loads((tmp_path / "forecast_24h_1.geojson").read_text())["features"]) == 5
    publish(detections(spark).where("confidence > 9").coalesce(1), f"file://{tmp_path}", "forecast_24h_3", latest="24h")
    assert json.loads((tmp_path / "latest_24h.geojson").read_text())["features"] == []


def test_many_documents_and_a_manifest(spark, tmp_path):
    geojson_sink.register(spark)
    df = spark.range(1000).select((F.col("id") % 90).cast("double").alias("latitude"), F.col("id").cast("double").alias("longitude"), "id")
    df.repartitionByRange(4, "id").sortWithinPartitions("id").write.format("geojson").mode("append").options(path=str(tmp_path), name="all", latest="x").save()
    manifest = json.loads((tmp_path / "latest_x.manifest.json").read_text())
    assert manifest["features"] == 1000 and len(manifest["documents"]) > 1 and manifest == json.loads((tmp_path / "all.manifest.json").read_text())
    ids = [f["properties"]["id"] for n in manifest["documents"] for f in json.loads((tmp_path / n).read_text())["features"]]
    assert ids == list(range(1000)) and not [n for n in os.listdir(tmp_path) if n.startswith(".staging")]


def test_a_failed_task_leaves_nothing_visible(spark, tmp_path):
    geojson_sink.register(spark)
    publish(detections(spark).coalesce(1), str(tmp_path), "good", latest="24h")
    before = {n: (tmp_path / n).read_text() for n in os.listdir(tmp_path)}
    boom = F.udf(lambda x: 1 / (x - 700), "double")
    df = spark.range(1000).select(F.lit(1.0).alias("latitude"), F.lit(2.0).alias("longitude"), boom("id").alias("v")).repartition(4)
    with pytest.raises(Exception, match="ZeroDivision|division"):
        df.write.format("geojson").mode("append").options(path=str(tmp_path), name="bad", latest="24h").save()
    assert {n: (tmp_path / n).read_text() for n in os.listdir(tmp_path)} == before
    for wrong in ({"name": "x"}, {"path": str(tmp_path)}, {"path": str(tmp_path), "name": "x", "latitude": "lat"}):
        with pytest.raises(Exception):
            detections(spark).write.format("geojson").mode("append").options(**wrong).save()


# gridded files on a stream


def land(folder, cycle, values, at):
    import pyarrow as pa
    import pyarrow.parquet as pq

    rows = [(v, lev, 1.0, 2.0, x) for v, lev, x in values]
    path = folder / f"fnl_{cycle}.parquet"
    pq.write_table(pa.table({c: [r[i] for r in rows] for i, c in enumerate(("variable", "lev", "lat", "lon", "value"))}), path)
    os.utime(path, (at, at))


def test_gridded_files_land_once_across_restarts(spark, tmp_path):
    grid_stream.register(spark)
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "readme.txt").write_text("x")
    out, seen = str(tmp_path / "out"), lambda: sorted(tuple(r) for r in spark.read.parquet(out).select("cycle", "variable", "lev", "value").collect())

    def run():
        stream = spark.readStream.format("grid_stream").options(path=f"file://{folder}", variables="tmpprs, rhprs", levels="850", settle="0", maxFilesPerTrigger="2").load()
        q = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "cp")).trigger(processingTime="0 seconds").start()
        try:
            for _ in range(3):
                q.processAllAvailable()
        finally:
            q.stop()

    some = [("tmpprs", 850.0, 1.0), ("tmpprs", 500.0, 2.0), ("rhprs", 850.0, 3.0), ("hgtprs", 850.0, 4.0)]
    of = lambda cycle: [(cycle, "rhprs", 850.0, 3.0), (cycle, "tmpprs", 850.0, 1.0)]
    now = dt.datetime.now().timestamp() - 1000
    for i in range(3):
        land(folder, f"2024010{i + 1}_06", some, now + i)
    run()
    want = sorted(sum((of(f"2024010{i + 1}06") for i in range(3)), []))
    assert seen() == want
    run()  # nothing new, nothing again
    assert seen() == want
    land(folder, "20231231_18", some, now + 10)  # late, of an older cycle
    land(folder, "20240104_00", some, now + 11)
    run()
    assert seen() == sorted(want + of("2023123118") + of("2024010400"))


def test_a_folder_of_files(spark, tmp_path):
    from windrose.sources import grid_source

    grid_source.register(spark)
    (tmp_path / "in").mkdir()
    for c in ("20240102_00", "20240101_00"):
        land(tmp_path / "in", c, [("t", 850.0, 1.0), ("u", 500.0, 2.0)], 1000)
    (tmp_path / "in" / ".hidden").write_text("x")
    read = lambda **o: sorted((os.path.basename(r["path"]), r["variable"], r["value"]) for r in spark.read.format("grid").options(**o).load().where("variable = 't'").collect())
    both = [("fnl_20240101_00.parquet", "t", 1.0), ("fnl_20240102_00.parquet", "t", 1.0)]
    one, two = (f"{tmp_path}/in/fnl_2024010{i}_00.parquet" for i in (1, 2))
    assert read(path=f"file://{tmp_path}/in") == read(path=f"{tmp_path}/in") == read(paths=json.dumps([one, two])) == read(paths=f"{one},file://{two}") == both
    assert read(path=one) == both[:1]


def test_offsets(tmp_path):
    for i, c in enumerate(("20240101_00", "20240102_00", "20240103_00")):
        land(tmp_path, c, [("t", 1.0, 1.0)], 1000 + i)
    reader = grid_stream._Reader({"path": str(tmp_path), "settle": "0", "newest": "true"})
    start = reader.initialOffset()
    assert [p.cycle for p in reader.partitions(start, reader.latestOffset())] == ["2024010300"]
    land(tmp_path, "20240104_00", [("t", 1.0, 1.0)], dt.datetime.now().timestamp())
    unsettled = grid_stream._Reader({"path": str(tmp_path), "settle": "600"})
    assert unsettled.latestOffset()["name"] == "fnl_20240103_00.parquet"
    few = grid_stream._Reader({"path": str(tmp_path), "settle": "0", "maxFilesPerTrigger": "2"})
    one, two = few.latestOffset(), few.latestOffset()
    assert (one["name"], two["name"]) == ("fnl_20240102_00.parquet", "fnl_20240104_00.parquet")
    assert [p.cycle for p in few.partitions(one, two)] == ["2024010300", "2024010400"]
    assert grid_stream._Reader({"path": str(tmp_path / "none")}).latestOffset() == {"landed": 0, "name": "", "from": ""}
    with pytest.raises(ValueError):
        grid_stream._Reader({})


# active systems


def test_active_systems_across_ids_and_restarts(spark, tmp_path):
    """Batches in any order of fixes end as one table of all would; late, repeated and expired fixes; a batch run twice."""
    rng, start = random.Random(12), dt.datetime(2024, 5, 1)
    schema = "storm_id string, time timestamp_ntz, latitude double, longitude double"
    fixes = []
    for i in range(40):
        lat, lon, t = rng.uniform(-20, 20), rng.choice([179.5, 100.0, rng.uniform(-180, 180)]), rng.uniform(0, 90)
        for k in range(rng.randrange(1, 4)):
            fixes.append((f"S{i % 25}", start + dt.timedelta(hours=t + 3 * k), lat + 0.3 * k, lon))
    fixes += [(n, start + dt.timedelta(hours=80 + i), 30.0, 40.0 + 3 * i) for i, n in enumerate((None, "UNKNOWN", "unknown ", ""))]
    fixes += [(f"C{i}", start + dt.timedelta(hours=85 - i), -10.0, 60.0 + i) for i in range(8)]  # a chain, each near the next
    fixes += fixes[:5]
    rng.shuffle(fixes)
    kept = active.ActiveSystems(spark, f"file://{tmp_path}/active", schema)
    assert kept.current().count() == 0
    parts = [fixes[i::4] for i in range(4)]
    frame = lambda rows: spark.createDataFrame(rows, schema)
    for number, part in enumerate(parts):
        kept.update(frame(part), number)
        if number == 2:  # after a restart the batch comes again, to another object
            kept = active.ActiveSystems(spark, f"file://{tmp_path}/active", schema)
            kept.update(frame(part), number)
    last = max(f[1] for f in fixes)
    young = [f for f in set(fixes) if (last - f[1]).total_seconds() <= 72 * 3600]
    want = sorted(map(tuple, systems.deduplicated(frame(young)).collect()), key=str)
    got = sorted(map(tuple, kept.current().collect()), key=str)
    assert got == want and 5 < len(want) < len({f[0] for f in young}) + 4 and len(kept.snapshots()) == 2
    chain = sorted(f[0] for f in want if f[0] and f[0].startswith("C"))
    assert chain == ["C0", "C2", "C4", "C6"]
    # what was left out comes back when what it was near to has gone
    kept.update(frame([("C0", start + dt.timedelta(hours=85.5), 50.0, -100.0)]), 4)
    assert {r["storm_id"] for r in kept.current().collect()} >= {"C0", "C1", "C3"}
    kept.update(frame([("LATE", start + dt.timedelta(hours=1), 0.0, 0.0), ("BAD", None, 0.0, 0.0), ("BAD", last, None, 0.0)]), 5)
    assert not {"LATE", "BAD"} & {r["storm_id"] for r in kept.current().collect()}
    kept.update(frame([("NEW", start + dt.timedelta(hours=500), 0.0, 0.0)]), 6)
    assert [r["storm_id"] for r in kept.current().collect()] == ["NEW"]


def test_active_systems_follow_a_stream(spark, tmp_path):
    schema = "storm_id string, time timestamp_ntz, latitude double, longitude double"
    kept = active.ActiveSystems(spark, f"file://{tmp_path}/active", schema)

    def put(name, rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/land/{name}")

    def run():
        kept.follow(spark.readStream.schema(schema).parquet(f"{tmp_path}/land/*"), checkpoint=f"{tmp_path}/cp").awaitTermination()

    t = dt.datetime(2024, 5, 1)
    put("a", [("A", t, 1.0, 1.0), ("B", t + dt.timedelta(hours=1), 1.5, 1.0)])
    run()
    assert [r["storm_id"] for r in kept.current().collect()] == ["B"]
    put("b", [("B", t + dt.timedelta(hours=30), 9.0, 9.0), ("Z", t + dt.timedelta(hours=2), 40.0, 40.0)])
    run()
    run()
    assert sorted(r["storm_id"] for r in kept.current().collect()) == ["A", "B", "Z"]


# checks of a run's own scan


def test_observed(spark):
    levels = [1000.0, 500.0]
    good = [("t", lev, i, float(y), float(x), 1.0) for i, lev in enumerate(levels) for y in range(3) for x in range(4)] + [("s", None, None, 0.0, 0.0, 1.0)]
    schema = "variable string, lev double, lev_i int, lat double, lon double, value double"

    def seen(rows):
        df, what = grid.observed(spark.createDataFrame(rows, schema), levels=[1000, 500], name=f"g{random.random()}")
        df.write.format("noop").mode("overwrite").save()
        return what

    assert grid.passed(seen(good), ["t", "s"])["rows"] == len(good)
    for bad, told in ((("t", 500.0, 0, 0.0, 0.0, 1.0), "level_order"), (("t", 1000.0, 0, 91.0, 0.0, 1.0), "lat"), (("t", 1000.0, 0, 0.0, 360.0, 1.0), "lon"), (("t", 1000.0, 0, 0.0, 0.0, None), "value"), (("t", 1000.0, 9, 0.0, 0.0, 1.0), "level_order")):
        with pytest.raises(ValueError, match=told):
            grid.passed(seen([*good, bad]), ["t", "s"])
    with pytest.raises(ValueError, match="missing"):
        grid.passed(seen(good), ["t", "s", "u"])
    axis = spark.createDataFrame([(0, 0, 1.0), (0, 1, 2.0), (0, 1, 2.0), (0, 2, 2.0), (1, 0, 1.0), (1, 1, 3.0), (1, 1, 4.0), (1, 2, 5.0), (2, 0, 9.0)], "cycle int, row int, lat double")
    assert {tuple(r) for r in grid.axis_faults(axis, by=["cycle"], index="row", at="lat").collect()} == {(0, 2, "not ascending"), (1, 1, "several positions")}


# folds


def labelled(spark, n=600):
    rng = np.random.default_rng(5)
    x = rng.standard_normal((n, 3)) * [1.0, 10.0, 0.1] + [0.0, 5.0, 1.0]
    y = (rng.random(n) < 1 / (1 + np.exp(-(x[:, 0] + 0.2 * (x[:, 1] - 5) - 1.5)))).astype(int)
    rows = [(i, int(y[i]), *[None if rng.random() < 0.1 else float(v) for v in x[i]], 7.0) for i in range(n)]
    return spark.createDataFrame(rows, "key long, y int, a double, b double, c double, flat double")


def test_folds_are_even(spark):
    counts = {}
    for r in learn.folds(labelled(spark), "y", "key", 5).groupBy("y", "fold").count().collect():
        counts.setdefault(r["y"], []).append(r["count"])
    assert all(len(c) == 5 and max(c) - min(c) <= 1 for c in counts.values())


@pytest.mark.parametrize("balanced,c", [(True, 0.35), (False, 1.0)])
def test_all_folds_at_once_are_those_of_single_fits(spark, balanced, c):
    columns = ["a", "b", "c", "flat"]
    dealt = learn.folds(labelled(spark), "y", "key", 4).cache()
    fits = learn.FoldFits(dealt, columns, "y", k=4, c=c, balanced=balanced)
    whole = {r["key"]: r["p"] for r in dealt.select("key", fits.probability(F.col("fold")).alias("p")).collect()}
    for m in range(4):
        ready, how = learn.imputed_scaled(dealt.where(F.col("fold") != m), columns)
        assert fits.medians[m] == pytest.approx([how["imputation_medians"][x] for x in columns])
        assert fits.means[m] == pytest.approx([how["means"][x] for x in columns]) and fits.scales[m] == pytest.approx([how["scales"][x] for x in columns])
        model = learn.logistic(ready, columns, "y", c=c, balanced=balanced)
        assert fits.coefficients[m] == pytest.approx([*model.coefficients, model.intercept], abs=2e-6)
    assert all(0 < p < 1 for p in whole.values()) and len(whole) == 600
    out = learn.out_of_fold(labelled(spark), columns, "y", "key", k=4, c=c, balanced=balanced)
    assert {r["key"]: pytest.approx(r["oof"], abs=1e-12) for r in out.collect()} == whole


def test_folds_of_few_rows(spark):
    df = spark.createDataFrame([(0, 1, None), (1, 0, 2.0), (2, 1, 3.0), (3, 0, 1.0), (4, 1, 9.0)], "key long, y int, a double")
    p = [r["oof"] for r in learn.out_of_fold(df, ["a"], "y", "key", k=5).collect()]
    assert len(p) == 5 and all(0 < x < 1 for x in p)


# a forecast run


def test_forecast_publishes_every_lead_time(spark, tmp_path):
    from windrose.operators import compositions
    from windrose.plans import runs

    rng = np.random.default_rng(8)
    stack = lambda: [float(v) for v in rng.uniform(0.1, 1.0, 9)]
    cells = spark.createDataFrame([("2024050106", r, c, stack(), True) for r in range(9) for c in range(12)], "cycle string, row int, col int, stack array<double>, candidate boolean")
    none = spark.createDataFrame([], "cycle string, storm_id string, status string, system_latitude double, system_longitude double, system_time timestamp_ntz")
    config = compositions.ScanConfig(lead_times=(24, 48), at=0.5, least_expert=0.1, km=2000.0, top=3, radius=1)
    assert compositions.ScanConfig.of(config.text()) == config
    scorer = lambda bias: lambda x: np.stack([1 / (1 + np.exp(-x.mean((1, 2, 3)) - bias)), np.full(len(x), 0.5), np.full(len(x), 0.6)], 1)
    how = dict(channel=runs.PLACES, variables=[c[0] for c in runs.CHANNELS], columns=12, latitude=lambda r: (r - 4) * 5.0, longitude=lambda c: c * 30.0, time=lambda c: F.lit("2024-05-01 06:00:00").cast("timestamp_ntz"), explain=lambda x: x.mean((1, 2)))
    made = compositions.forecast(cells, none, {24: scorer(0.0), 48: scorer(1.0)}, config, f"file://{tmp_path}", cycle="20240501_0600", metadata={"source_product": "x"}, **how)
    assert made == {24: "genesis_forecast_24h_20240501_0600", 48: "genesis_forecast_48h_20240501_0600"}
    for hours, name in made.items():
        text = (tmp_path / f"{name}.geojson").read_text()
        doc = json.loads(text)
        assert text == (tmp_path / f"latest_{hours}h.geojson").read_text() and doc["metadata"]["lead_time_hrs"] == hours and doc["metadata"]["settings"]["top"] == 3
        said = [f["properties"] for f in doc["features"]]
        assert len(said) == 3 and [p["rank"] for p in said] == [1, 2, 3] and all(p["lead_time_hrs"] == hours and p["system_class"] for p in said)
        assert sum(v for k, v in said[0].items() if k.startswith("xai_mean_")) == pytest.approx(1)
    with pytest.raises(ValueError, match="48"):
        compositions.forecast(cells, none, {24: scorer(0.0)}, config, f"file://{tmp_path}", cycle="x", **how)
    for wrong in (dict(lead_times=()), dict(lead_times=(24, 24)), dict(at=1.5), dict(mode="x"), dict(band=(5.0, 5.0)), dict(top=0), dict(least_warmth=-1.0)):
        with pytest.raises(ValueError):
            compositions.ScanConfig(**{"lead_times": (24,), **wrong})
    df = spark.createDataFrame([(-36.0, 0.0, 300.0), (0.0, 0.6, 300.0), (0.0, 0.5, 298.0), (35.0, 0.5, 299.0), (None, 0.0, 300.0)], "lat double, land double, warm double")
    assert [r[0] for r in df.select(compositions.ScanConfig(lead_times=(24,), least_warmth=299.0).candidate(F.col("lat"), F.col("land"), F.col("warm"))).collect()] == [False, False, False, True, None]


def test_candidates_of_fields(spark):
    rows = [(1, "a2", 1.0), (1, "a1", 2.0), (1, "a1", 3.0), (2, "a2", 4.0), (2, "b1", 5.0), (3, "c", 6.0)]
    df = spark.createDataFrame(rows, "cycle int, variable string, value double")
    found = grid.first_available(df, {"a": ["a1", "a2"], "b": ["b1"]}, by=["cycle"])
    assert sorted(map(tuple, found.collect())) == [(1, "a", 2.0), (1, "a", 3.0), (2, "a", 4.0), (2, "b", 5.0)]
    assert {tuple(r) for r in grid.lacking(found, ["a", "b"], by=["cycle"]).selectExpr("cycle", "array_join(missing, ',')").collect()} == {(1, "b")}
    assert grid.first_available(df.limit(0), {"a": ["a1"]}, by=["cycle"]).count() == 0


# classic NetCDF

#: The one-variable file that the format's published description prints: short vx(dim) = 3, 1, 4, 1, 5.
TINY = bytes.fromhex("434446 01 00000000 0000000a 00000001 00000003 64696d00 00000005 0000000000000000 0000000b 00000001 00000002 76780000 00000001 00000000 0000000000000000 00000003 0000000c 00000050 0003 0001 0004 0001 0005 8001".replace(" ", ""))


def test_the_published_file():
    from windrose.sources import netcdf

    file = netcdf.Classic(lambda at, n: TINY[at : at + n])
    assert file.dims == [("dim", 5)] and file.values("vx").tolist() == [3, 1, 4, 1, 5] and file.values("vx", 2).tolist() == 4
    for bad in (b"HDF" + TINY[3:], TINY[:40], TINY[:-6]):
        with pytest.raises(ValueError):
            netcdf.Classic(lambda at, n, bad=bad: bad[at : at + n]).values("vx")


def test_records_fill_and_scale():
    from windrose.sources import netcdf

    data = netcdf.packed({"x": 3}, {"v": (["x"], np.array([1, -9, 3], np.int32), {"_FillValue": -9.0, "scale_factor": 0.5, "add_offset": 10.0, "dtype": "float32"})}, {"title": "é"})
    file = netcdf.Classic(lambda at, n: data[at : at + n])
    assert file.attributes == {"title": "é"}
    assert file.values("v").tolist()[::2] == [10.5, 11.5] and math.isnan(file.values("v")[1])
    # two variables over records, the first of an odd width
    head = bytes.fromhex("43444601 00000002 0000000a 00000001 00000001 74000000 00000000 0000000000000000 0000000b 00000002".replace(" ", ""))
    var = lambda name, kind, size, begin: bytes.fromhex(f"00000001 {name}000000 00000001 00000000 0000000000000000 {kind:08x} {size:08x} {begin:08x}".replace(" ", ""))
    begin = len(head) + 2 * len(var("61", 3, 4, 0))
    whole = head + var("61", 3, 4, begin) + var("62", 4, 4, begin + 4) + bytes.fromhex("0007 0000 00000001 0008 0000 00000002".replace(" ", ""))
    file = netcdf.Classic(lambda at, n: whole[at : at + n])
    assert file.values("a").tolist() == [7, 8] and file.values("b").tolist() == [1, 2] and file.values("b", 1).tolist() == 2


def test_patches_as_files_and_back(spark, tmp_path):
    from windrose.sources import grid_source, netcdf

    rng = random.Random(3)
    cells = [(f"f/{p}", v, lev, float(y), float(x), rng.random()) for p in range(3) for v, levs in (("tmpprs", (850.0, 500.0)), ("tmpsfc", (None,))) for lev in levs for y in range(4) for x in range(5) if (p, v, y, x) != (1, "tmpsfc", 0, 0)]
    rng.shuffle(cells)
    df = spark.createDataFrame(cells, "path string, variable string, lev double, lat double, lon double, value double")
    made = netcdf.patch_files(df, f"file://{tmp_path}/nc", keys=["path"]).collect()
    assert sorted(r["path"] for r in made) == ["f/0", "f/1", "f/2"] and all(os.path.getsize(tmp_path / "nc" / r["name"]) == r["bytes"] for r in made)
    grid_source.register(spark)
    for r in made:
        read = spark.read.format("grid").options(path=f"file://{tmp_path}/nc/{r['name']}", decoder="windrose.sources.netcdf:decoder").load()
        got = {(x["variable"], x["lev"], x["lat"], x["lon"]): x["value"] for x in read.collect()}
        want = {c[1:5]: c[5] for c in cells if c[0] == r["path"]}
        gap = set(got) - set(want)
        assert (gap == {("tmpsfc", None, 0.0, 0.0)}) == (r["path"] == "f/1") and all(math.isnan(got[g]) for g in gap)
        assert {k: pytest.approx(v, abs=1e-6) for k, v in want.items()} == {k: v for k, v in got.items() if k not in gap}
        some = read.where("variable = 'tmpprs' AND lev = 500.0")
        assert some.count() == 20
    x = netcdf.opened(f"{tmp_path}/nc/{made[0]['name']}")
    assert x.values("lev").tolist() == [850.0, 500.0] and x.values("lat").tolist() == [0.0, 1.0, 2.0, 3.0]
