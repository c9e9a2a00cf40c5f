"""Fields in tiles, training samples, polygons, the ledger, kept moments and clusters against plain Python."""

import math
import random
from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from windrose.functions import draws, geo
from windrose.operators import compositions, detect, grid, learn, moments, polygons, tiles, tracks, training
from windrose.streaming import ledger


def kilometres(a, b, c, d):
    p, q = math.radians(a), math.radians(c)
    h = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(d - b) / 2) ** 2
    return 2 * 6371.0088 * math.asin(min(1.0, math.sqrt(h)))


# tiles


def fields(spark, cycles, rows, columns, depth, kind="float", without=()):
    rng = np.random.default_rng(3)
    data = rng.standard_normal((cycles, rows, columns, depth))
    data = data.astype(np.float32) if kind == "float" else data
    cells = [(k, r, c, data[k, r, c].tolist(), (r * 7 + c * 3 + k) % 4 > 0) for k in range(cycles) for r in range(rows) for c in range(columns) if (k, r, c) not in without]
    return data, spark.createDataFrame(cells, f"cycle int, row long, col int, stack array<{kind}>, candidate boolean")


@pytest.mark.parametrize("kind,tile,radius", [("float", (4, 5), 2), ("double", (3, 100), 1), ("float", (50, 2), 3), ("double", (16, 32), 0)])
def test_patches_are_those_of_the_whole_field(spark, kind, tile, radius):
    """Around the date line and over tile borders; candidates at the first and last rows and beside a gap have none."""
    gap = {(1, 5, 0)}
    data, cells = fields(spark, 2, 9, 11, 3, kind, gap)
    got = {(r["cycle"], r["row"], r["col"]): r["patch"] for r in tiles.patches(cells, radius, 11, tile=tile).collect()}
    want = {}
    for k in range(2):
        for r in range(radius, 9 - radius):
            for c in range(11):
                around = [(k, r + i, (c + j) % 11) for i in range(-radius, radius + 1) for j in range(-radius, radius + 1)]
                if (r * 7 + c * 3 + k) % 4 > 0 and not gap & set(around):
                    want[k, r, c] = [float(x) for a in around for x in data[a]]
    assert got == want and len(want) > 30


def test_scan(spark):
    data, cells = fields(spark, 2, 12, 14, 4)
    means, stds = [0.1, 0.2, 0.3, 0.4], [1.0, 2.0, 0.5, 1.5]

    def scorer(x):
        assert x.ndim == 4 and x.shape[1:] == (5, 5, 4)
        m = x.mean((1, 2))
        return np.stack([m @ [1, -1, 1, 0], np.where(m[:, 0] > 0, np.nan, m[:, 1]), m[:, 2]], 1)

    out = tiles.scan(cells, scorer, ["a", "b", "c"], radius=2, columns=14, at=-0.05, least_expert=-0.4, explain=lambda x: np.abs(x).mean((1, 2)), means=means, stds=stds, tile=(5, 6), batch=7)
    got = {(r["cycle"], r["row"], r["col"]): r for r in out.collect()}
    seen = 0
    for r in tiles.patches(cells, 2, 14).collect():
        raw = np.array(r["patch"]).reshape(1, 5, 5, 4)
        x = (raw - means) / stds
        s = scorer(x)[0]
        key = (r["cycle"], r["row"], r["col"])
        if abs(s[0] + 0.05) < 1e-4 or any(abs(v + 0.4) < 1e-4 for v in s[1:]):
            continue
        assert (key in got) == (s[0] >= -0.05 and not (s[1:] < -0.4).any())
        if key in got:
            g, seen = got[key], seen + 1
            assert g["a"] == pytest.approx(s[0], abs=1e-5) and (g["b"] is None) == np.isnan(s[1])
            assert g["center"] == pytest.approx(data[key].tolist()) and g["mean"] == pytest.approx(raw.mean((1, 2))[0], abs=1e-6)
            assert g["attribution"] == pytest.approx(np.abs(x).mean((1, 2))[0], abs=1e-5)
    assert seen > 15
    nothing = tiles.scan(cells, scorer, ["a", "b", "c"], radius=2, columns=14, at=99.0)
    assert nothing.count() == 0 and tiles.scan(cells.limit(0), scorer, ["a", "b", "c"], radius=2, columns=14).count() == 0
    with pytest.raises(ValueError):
        tiles.patches(cells, 7, 14)


def test_shares_and_scored(spark):
    df = spark.createDataFrame([([1.0, -3.0, 2.0],), ([0.0, 0.0, 0.0],), ([],)], "attribution array<double>")
    assert [r[0] for r in df.select(tiles.shares(["u", "u", "t"])).collect()] == [{"u": 0.5, "t": 0.5}, {}, {}]
    patch = spark.createDataFrame([(k, [float(k), 1.0, 2.0]) for k in range(1000)], "key long, patch array<float>")
    got = grid.scored(patch, lambda x: np.stack([x.sum(1), x[:, 0]], 1), ["s", "t"], batch=64)
    assert all(r["s"] == r["key"] + 3 and r["t"] == r["key"] and len(r["patch"]) == 3 for r in got.collect()) and got.count() == 1000


# training samples


def test_draws(spark):
    u = [r[0] for r in spark.range(4000).select(draws.uniform(3, F.lit("x"), F.col("id"))).collect()]
    assert 0 < min(u) and max(u) < 1 and abs(np.mean(u) - 0.5) < 0.02 and abs(np.var(u) - 1 / 12) < 0.005
    n = [r[0] for r in spark.range(4000).select(draws.whole(3, 2, 6, F.col("id"))).collect()]
    assert set(n) == {2, 3, 4, 5} and min(map(n.count, set(n))) > 850


def test_tried_negatives(spark):
    """Each result is the first try that holds by the rules, and none of a file without a result does."""
    rng = random.Random(9)
    rows, columns, half = 20, 40, 2
    field = {(r, c): (rng.choice([0.0, 5e-6, 2e-5, -2e-5]), float(rng.random() < 0.2)) for r in range(rows) for c in range(columns)}
    fields = spark.createDataFrame([("f", r, c, *v) for (r, c), v in field.items()], "field string, row int, col int, vorticity double, landmask double")
    files = spark.createDataFrame([(i, "f") for i in range(400)], "path long, field string")
    storms = {i: [(rng.uniform(-25, 25), rng.uniform(-180, 360)) for _ in range(rng.choice([0, 3, 40]))] for i in range(400)}
    table = spark.createDataFrame([(i, *s) for i, x in storms.items() for s in x], "path long, latitude double, longitude double")
    at = lambda r, c: ((r - 10) * 2.5, c * 9.0)
    how = dict(key="path", field="field", band=(3, 16), columns=columns, latitude=lambda r: (r - 10) * 2.5, longitude=lambda c: c * 9.0, half=half, most_land=0.2, km=700.0, seed=4)
    got = {r["path"]: r for r in training.tried_negatives(files, fields, table, **how).collect()}
    drawn = files.select("path", F.explode(F.sequence(F.lit(0), F.lit(14))).alias("nth"))
    draw = lambda name, low, beyond: draws.whole(4, low, beyond, F.lit(name), F.col("path"), F.col("nth"))
    drawn = drawn.select("path", "nth", (draws.uniform(4, F.lit("hard"), F.col("path")) < 0.7).alias("hard"), draw("row", 3, 17).alias("r"), draw("col", half, columns - half).alias("c")).collect()
    first, hard = {}, {}
    for t in sorted(drawn, key=lambda t: (t["path"], t["nth"])):
        hard[t["path"]] = t["hard"]
        spot = at(t["r"], t["c"])
        patch = [field[r, c][1] for r in range(max(0, t["r"] - half), min(rows, t["r"] + half + 1)) for c in range(max(0, t["c"] - half), min(columns, t["c"] + half + 1))]
        ok = (not t["hard"] or abs(field[t["r"], t["c"]][0]) >= 1e-5) and np.mean(patch) <= 0.2 and all(kilometres(*spot, a, b) >= 700 for a, b in storms[t["path"]])
        if ok and t["path"] not in first:
            first[t["path"]] = (t["nth"], t["r"], t["c"])
    assert {p: (r["nth"], r["row"], r["col"]) for p, r in got.items()} == first and 250 < len(first) < 400
    assert abs(np.mean(list(hard.values())) - 0.7) < 0.08
    assert training.tried_negatives(files.limit(0), fields, table, **how).count() == 0
    assert training.tried_negatives(files, fields, table.limit(0), **how).count() >= len(first)


def test_weighted_negatives(spark):
    rng = random.Random(2)
    rows = [(f, i, rng.choice([None, 0.0, -1.0, float("nan"), 1.0, 1.0, 9.0])) for f in range(60) for i in range(200)] + [(99, i, 0.0) for i in range(5)]
    df = spark.createDataFrame(rows, "path long, cell long, w double")
    got = training.weighted_negatives(df, key="path", cell=["cell"], weight="w", count=20, seed=1).collect()
    by = {}
    for r in got:
        by.setdefault(r["path"], []).append(r)
    assert len(by[99]) <= 5 and not any(r["hard"] for r in by[99])
    for path, some in by.items():
        assert len({r["cell"] for r in some}) == len(some) and sorted(r["rank"] for r in some) == list(range(1, len(some) + 1))
        assert path == 99 or len(some) == 20
        assert all(r["w"] is not None and r["w"] > 0 for r in some if r["hard"])
    hard = [r for r in got if r["hard"]]
    assert abs(len(hard) / 1200 - 0.7) < 0.05
    assert 0.7 < np.mean([r["w"] == 9.0 for r in hard]) < 0.9  # a third of the weighted cells, nine times as likely at first


def test_pair_plan(spark):
    domain = (-30.0, 30.0, 0.0, 359.0)
    p = [("f1", 1, "a", 10.0, 100.0), ("f1", 1, "a", 10.0, 100.0), ("f1", 1, "b", 28.0, -60.0), ("f1", 1, "out", 30.0, 10.0), ("f2", 2, "c", 0.0, 355.0)]
    positives = spark.createDataFrame(p, "path string, time int, sid string, latitude double, longitude double")
    fixes = spark.createDataFrame([(1, 10.0, 125.0), (1, 0.0, -60.0), (2, 0.0, 15.0)], "time int, latitude double, longitude double")
    got = {(r["path"], r["sid"], r["kind"]): r for r in training.pair_plan(positives, fixes, size=10.0, distances=[10.0, 20.0], domain=domain).collect()}
    assert set(got) == {("f1", s, k) for s in "ab" for k in ("positive", "negative")} | {("f2", "c", k) for k in ("positive", "negative")}
    box = lambda r: (r["south"], r["north"], r["west"], r["east"])
    assert box(got["f1", "b", "positive"]) == (20.0, 30.0, 295.0, 305.0)  # moved down into the domain; longitudes from 0
    a = got["f1", "a", "negative"]
    assert (a["shift"], a["angle"]) == (20.0, 45) and a["latitude"] == pytest.approx(10 + 20 * math.sin(math.pi / 4))  # 20 degrees to the east the patch would hold a fix
    b = got["f1", "b", "negative"]
    assert (b["shift"], b["angle"], b["longitude"]) == (20.0, 0, 320.0)
    c = got["f2", "c", "negative"]
    assert (c["shift"], c["angle"]) == (20.0, 45)  # its patch around 15 degrees east would hold the fix
    wet = lambda df: df.where("longitude < 90")
    assert {(r["sid"], r["kind"]): r["angle"] for r in training.pair_plan(positives, fixes, size=10.0, distances=[10.0, 20.0], domain=domain, ocean=wet).collect()}["a", "negative"] == 135
    none = lambda df: df.limit(0)
    assert training.pair_plan(positives, fixes, size=10.0, distances=[10.0], domain=domain, ocean=none).where("kind = 'negative'").count() == 0
    cells = spark.createDataFrame([("f1", float(y), float(x)) for y in range(-30, 31, 2) for x in range(0, 360, 2) if not (x > 110 and x < 130)], "path string, latitude double, longitude double")
    plan = training.pair_plan(positives, fixes, size=10.0, distances=[10.0, 20.0], domain=domain, cells=cells, least_cells=25)
    held = training.in_patches(plan, cells, size=10.0, keys=["path", "sid", "kind"])
    counts = {(r["sid"], r["kind"]): r["cells"] for r in training.patch_cells(plan, cells, size=10.0, keys=["path", "sid", "kind"]).collect()}
    for r in plan.collect():
        inside = [(y, x) for y in range(-30, 31, 2) for x in range(0, 360, 2) if r["path"] == "f1" and not 110 < x < 130 and r["south"] <= y <= r["north"] and r["west"] <= x <= r["east"]]
        there = held.where((F.col("sid") == r["sid"]) & (F.col("kind") == r["kind"])).select("latitude", "longitude").collect()
        assert sorted(map(tuple, there)) == sorted(inside) and counts.get((r["sid"], r["kind"]), 0) == len(inside)
        assert r["kind"] == "positive" or len(inside) >= 25


def test_patch_cells_are_counted(spark, monkeypatch):
    """Copies of patches and of cells, cells on the bounds and unplaced ones, tiles in one and in many parts; no patch meets
    its cells one by one."""
    rng = random.Random(4)
    half = lambda low, high: rng.randrange(2 * low, 2 * high) / 2
    cells = [(rng.choice(["f", "g"]), half(-35, 35), half(0, 360)) for _ in range(3000)] * 2
    odd = [("f", None, 1.0), ("f", float("nan"), 1.0), (None, 1.0, 1.0), ("f", 1.0, float("inf"))]
    at = [(rng.choice(["f", "g", "h", None]), half(-35, 20), half(0, 340)) for _ in range(300)] * 2
    plan = [(p, i, s, s + 15.0, w, w + rng.choice([0.0, 20.0])) for i, (p, s, w) in enumerate(at)]
    want = {(p, i): n for p, i, s, no, w, e in plan if (n := sum(c[0] == p and s <= c[1] <= no and w <= c[2] <= e for c in cells))}
    boxes = spark.createDataFrame(plan, "path string, sid long, south double, north double, west double, east double")
    df = spark.createDataFrame(cells + odd, "path string, latitude double, longitude double")
    monkeypatch.setattr(training, "in_patches", None)
    for most in (training.TILE_PATCHES, 7):
        monkeypatch.setattr(training, "TILE_PATCHES", most)
        monkeypatch.setattr(training, "TILE_POSITIONS", most)
        got = training.patch_cells(boxes, df, size=15.0, keys=["path", "sid"]).collect()
        assert {(r["path"], r["sid"]): r["cells"] for r in got} == want and len(got) == len(want) > 150


def test_no_exploded_side_is_broadcast(spark, monkeypatch, tmp_path):
    """Patches, centres and their counts are joined by shuffles, small as Spark takes them to be."""
    plans, seen = [], lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or df
    monkeypatch.setattr(training, "cut", lambda df, cut=training.cut: cut(seen(df)))
    monkeypatch.setattr(training, "small", lambda df: df.hint("merge"), raising=False)  # what is counted may be
    stored = lambda name, rows, schema: spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}") or spark.read.parquet(f"{tmp_path}/{name}")
    positives = stored("p", [("f", 1, i, i / 10, 100.0) for i in range(50)], "path string, time int, sid int, latitude double, longitude double")
    fixes = stored("f", [(1, 10.0, 125.0)], "time int, latitude double, longitude double")
    cells = stored("c", [("f", float(y), float(x)) for y in range(-30, 31, 10) for x in range(0, 360, 10)], "path string, latitude double, longitude double")
    plan = training.pair_plan(positives, fixes, size=30.0, distances=[20.0], domain=(-35.0, 35.0, 5.0, 355.0), cells=cells, least_cells=2)
    counts = seen(training.patch_cells(seen(plan), cells, size=30.0, keys=["path", "sid", "kind"]))
    assert counts.count() == 100 and not [x for x in plans if "BroadcastHashJoin" in x] and sum(x.count("SortMergeJoin") for x in plans) >= 10


def test_moved_patch_holds_its_far_side(spark):
    """A patch moved to the domain's southern edge is as tall as the others: its northern bound isn't short by rounding."""
    df = spark.createDataFrame([(-21.0 - k / 997,) for k in range(1, 900)], "y double")
    box = training.patch_box(F.col("y"), F.lit(100.0), 30.0, (-35.0, 35.0, 5.0, 355.0))
    assert {(r["south"], r["north"]) for r in df.select(box["south"].alias("south"), box["north"].alias("north")).collect()} == {(-35.0, -5.0)}


def test_balanced_negatives(spark):
    df = spark.range(7).withColumnRenamed("id", "key").withColumn("x", F.col("key") * 2)
    for count in (0, 1, 7, 17, 21):
        got = tracks.balanced_negatives(df, count, key="key").collect()
        n = {}
        for r in got:
            n.setdefault(r["key"], []).append(r["draw"])
            assert r["x"] == 2 * r["key"]
        assert len(got) == count and all(sorted(d) == list(range(len(d))) for d in n.values()) and all(abs(len(d) - count / 7) < 1 for d in n.values())
    assert tracks.balanced_negatives(df.limit(0), 5, key="key").count() == 0


# polygons


def winding(lat, lon, rings):
    odd = False
    for ring in rings:
        for (y1, x1), (y2, x2) in zip(ring, ring[1:] + ring[:1], strict=True):
            for turn in (-720, -360, 0, 360, 720):
                if (y1 > lat) != (y2 > lat) and lon + turn < x1 + (lat - y1) * (x2 - x1) / (y2 - y1):
                    odd = not odd
    return odd


def test_points_in_polygons(spark):
    rng = random.Random(6)
    shapes, vertices = {}, []
    for p in range(12):
        la, lo = rng.uniform(-50, 50), rng.choice([0.0, 359.0, 180.0, rng.uniform(0, 360)])
        rings = []
        for size, corners in ((25, 9), (6, 5)):
            rings.append([(la + size * rng.uniform(0.7, 1) * math.sin(2 * math.pi * k / corners), lo + size * rng.uniform(0.7, 1) * math.cos(2 * math.pi * k / corners)) for k in range(corners)])
        shapes[p] = rings
        for k, ring in enumerate(rings):
            shift = rng.choice([-360, 0, 360])
            closed = ring + ring[:1] if p % 2 else ring
            vertices += [(p, k, i, y, (x + 180) % 360 - 180 + shift) for i, (y, x) in enumerate(closed)]
    points = [(i, rng.uniform(-80, 80), rng.uniform(-180, 360)) for i in range(800)] + [(900, None, 1.0), (901, 1.0, None)]
    sides = polygons.edges(spark.createDataFrame([*vertices, (3, 0, 99, None, 1.0)], "polygon int, ring int, nth int, latitude double, longitude double"), band=4.0)
    df = spark.createDataFrame(points, "key long, latitude double, longitude double")
    got = {(r["key"], r["polygon"]) for r in polygons.inside(df, sides, key=["key"], band=4.0).collect()}
    want = {(i, p) for i, y, x in points[:800] for p, rings in shapes.items() if winding(y, x % 360, rings)}
    assert got == want and len(want) > 100
    wet = polygons.on_ocean(df, sides, key=["key"], band=4.0)
    assert {r["key"] for r in wet.collect()} == {i for i, _ in want}
    assert polygons.on_ocean(df, sides, key=["key"], band=4.0, land=True).count() == len(points) - wet.count()


# accumulation


def test_accumulation_goes_on_after_a_lost_driver(spark, tmp_path):
    folder = f"file://{tmp_path}/acc"
    calls = []

    def build(part):
        calls.append(part)
        if part == "2024-03" and len(calls) < 4:
            raise RuntimeError("the driver is lost")
        n = int(part[-1])
        return spark.range(10 * n).select(F.lit(part).alias("part"), (F.col("id") % 2).alias("hit"))

    totals = {"rows": F.count("*"), "hits": F.sum("hit")}
    months = [f"2024-0{i}" for i in range(1, 9)]
    run = lambda least: ledger.accumulate(spark, folder, months, build, totals=totals, enough=lambda t: t["rows"] >= least)
    with pytest.raises(RuntimeError):
        run(95)
    book = ledger.Ledger(spark, folder)
    assert sorted(book.entries()) == months[:2]
    # rows whose entry was never made, and an entry that was never renamed
    spark.range(5).selectExpr("'2024-03' AS part", "id AS hit").write.parquet(f"{folder}/data/2024-03-lost")
    (tmp_path / "acc/ledger/2024-03-lost.tmp").write_text("{")
    schema = "part string, hit long"
    assert book.rows(schema).count() == 30
    assert run(95) == ({"rows": 100, "hits": 50}, ["2024-03", "2024-04"])
    assert calls == ["2024-01", "2024-02", "2024-03", "2024-03", "2024-04"]
    assert not (tmp_path / "acc/data/2024-03-lost").exists() and not list((tmp_path / "acc/ledger").glob("*.tmp"))
    assert {r["part"]: r["count"] for r in book.rows(schema).groupBy("part").count().collect()} == {f"2024-0{i}": 10 * i for i in range(1, 5)}
    assert run(95) == ({"rows": 100, "hits": 50}, []) and run(140)[1] == ["2024-05"] and run(10**6)[1] == months[5:]


def test_a_part_is_finished_once(spark, tmp_path):
    book = ledger.Ledger(spark, f"file://{tmp_path}/acc")
    one = book.finish("a", spark.range(3), {"n": F.count("*")})
    assert book.finish("a", spark.range(5), {"n": F.count("*")}) == one and book.rows("id long").count() == 3 and book.clear() == []
    assert book.finish("empty", spark.range(0), {"n": F.count("*"), "s": F.sum("id")})["totals"] == {"n": 0, "s": 0}
    with pytest.raises(ValueError):
        book.finish("../x", spark.range(1), {})


def test_a_killed_driver_leaves_whole_parts(spark, tmp_path):
    """Another process is killed while it writes its third part."""
    import os
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    folder = f"file://{tmp_path}/acc"
    script = f"""
import os, sys
sys.path.insert(0, {root!r})
from pyspark.sql import SparkSession, functions as F
from windrose.streaming import ledger
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.driver.host", "127.0.0.1").getOrCreate()
book = ledger.Ledger(spark, {folder!r})
def build(part):
    if part == "c":
        spark.range(7).write.parquet({folder!r} + "/data/c-half")
        os._exit(9)
    return spark.range(4)
ledger.accumulate(spark, {folder!r}, "abcd", build, totals={{"n": F.count("*")}}, enough=lambda t: t["n"] >= 14)
"""
    assert subprocess.run([sys.executable, "-c", script], capture_output=True, timeout=180).returncode == 9
    book = ledger.Ledger(spark, folder)
    assert sorted(book.entries()) == ["a", "b"] and book.rows("id long").count() == 8
    got = ledger.accumulate(spark, folder, "abcd", lambda part: spark.range(6), totals={"n": F.count("*")}, enough=lambda t: t["n"] >= 14)
    assert got == ({"n": 14}, ["c"]) and book.rows("id long").count() == 14


# moments


def test_moments_after_any_order_of_changes(spark):
    rng = random.Random(4)
    data = {f: [(c, rng.gauss(1e6, 2.0) if c == "big" else rng.gauss(0, 1)) for c in ("big", "small", "flat") for _ in range(rng.randrange(1, 30))] for f in range(8)}
    data[3] += [("small", float("nan")), ("small", float("inf")), ("small", None), ("only", 5.0)]
    frame = lambda d: spark.createDataFrame([(f, c, v) for f, x in d.items() for c, v in x] or [], "path long, channel string, value double")
    table = lambda d: moments.by_file(frame(d), file="path", by=["channel"], value="value")
    kept, now = table({f: data[f] for f in (0, 1, 2)}), {f: data[f] for f in (0, 1, 2)}
    for add, gone in (((3, 4), (1,)), ((1,), ()), ((5, 6, 7), (3, 0)), ((2,), (5,))):
        fresh = {f: [(c, v if v is None else v + (f == 2)) for c, v in data[f]] for f in add}
        kept = moments.changed(kept, table(fresh), spark.createDataFrame([(g,) for g in gone], "file long"))
        now = {**{f: x for f, x in now.items() if f not in gone}, **fresh}
        got = {r["channel"]: (r["n"], r["mean"], r["std"]) for r in moments.merged(kept, by=["channel"], epsilon=0.0).collect()}
        for c in {c for x in now.values() for c, _ in x}:
            v = np.array([v for x in now.values() for k, v in x if k == c and v is not None and math.isfinite(v)])
            assert (c in got) == bool(len(v)) and (not len(v) or got[c] == (len(v), pytest.approx(v.mean(), rel=1e-12), pytest.approx(v.std(), rel=1e-7, abs=1e-12)))
    assert moments.merged(table({}), by=["channel"]).count() == 0
    assert moments.merged(table({0: [("a", 2.0)]}), by=["channel"], floor=1e-8).first()["std"] == pytest.approx(1e-4)


def test_statistics_text(spark):
    order = [(0, "t", 850.0), (1, "t", 500.0), (2, "landmask", None)]
    stats = spark.createDataFrame([(1, 2.0, 3.0), (0, 1.0, 0.5)], "channel int, mean double, std double")
    assert moments.statistics_text(stats, order) == ([1.0, 2.0, 0.0], [0.5, 3.0, 1.0])
    with pytest.raises(ValueError):
        moments.statistics_text(stats.where("channel = 1"), order)


# clusters


def slow_clusters(points, km, least):
    near = {k: [j for j, a, b in points if kilometres(x, y, a, b) <= km] for k, x, y in points}
    core = {k for k in near if len(near[k]) >= least}
    label = {k: k for k in core}
    moved = True
    while moved:
        moved = False
        for k in core:
            best = min(label[j] for j in near[k] if j in core)
            moved |= best < label[k]
            label[k] = best
    return label | {k: min(label[j] for j in near[k] if j in core) for k in near if k not in core and core & set(near[k])}


@pytest.mark.parametrize("least,km", [(1, 300.0), (2, 150.0), (4, 300.0), (9, 500.0), (3, 3000.0)])
def test_density_clusters_are_those_of_all_pairs(spark, least, km):
    """Dense groups, copies of positions, the date line and a pole; cells that are full and cells that aren't."""
    rng = random.Random(least)
    rows = []
    for g in range(2):
        points = [(rng.uniform(-60, 60), rng.uniform(-180, 180)) for _ in range(60)]
        points += [(10 + rng.gauss(0, 2), 179 + rng.gauss(0, 3)) for _ in range(60)] + [(88 + rng.uniform(0, 2), rng.uniform(-180, 180)) for _ in range(25)]
        points += [(-20 + 0.9 * k, 30.0) for k in range(12)] + [points[0]] * 5 + [(90.0, 5.0), (-90.0, 0.0)]
        rows += [(g, i, y, (x + 180) % 360 - 180) for i, (y, x) in enumerate(points)]
    df = spark.createDataFrame([*rows, (0, 999, None, 1.0)], "cycle int, key long, lat double, lon double")
    got = {(r["cycle"], r["key"]): r["cluster"] for r in detect.density_clusters(df, km, least, key="key", lat="lat", lon="lon", on=["cycle"]).collect()}
    assert got == {(g, k): c for g in range(2) for k, c in slow_clusters([r[1:] for r in rows if r[0] == g], km, least).items()}
    assert detect.density_clusters(df.limit(0), km, least, key="key", lat="lat", lon="lon", on=["cycle"]).count() == 0


def test_cells_are_within_reach(spark):
    """Corners and edges of a cell are no farther apart than the radius, and half of it from the centre."""
    rng = random.Random(1)
    for km in (50.0, 900.0, 6000.0):
        rows = [(rng.choice([rng.uniform(-90, 90), rng.uniform(-5, 5), 89.9]), rng.uniform(-180, 180)) for _ in range(3000)]
        cells = {}
        for r in detect._celled(spark.createDataFrame(rows, "lat double, lon double"), km, "lat", "lon").collect():
            assert kilometres(r["lat"], r["lon"], r["_clat"], r["_clon"]) <= km / 2 + 1e-6
            cells.setdefault((r["_i"], r["_j"]), []).append((r["lat"], r["lon"]))
        assert all(kilometres(*a, *b) <= km for x in cells.values() for a in x[:20] for b in x[:20])


def test_imputed_scaled(spark):
    rows = [(1.0, None, None), (2.0, 5.0, None), (float("nan"), 5.0, None), (9.0, float("inf"), None)]
    ready, how = learn.imputed_scaled(spark.createDataFrame(rows, "a double, b double, c double"), ["a", "b", "c"])
    assert how["imputation_medians"] == {"a": 2.0, "b": 5.0, "c": 0.0} and how["scales"]["b"] == 1.0 and how["means"]["a"] == pytest.approx(3.5)
    assert [r["a"] for r in ready.collect()] == pytest.approx([(x - 3.5) / np.std([1, 2, 2, 9]) for x in (1, 2, 2, 9)])


def test_longitude_of_runs(spark):
    """What field_scan gives out as places, for a scorer that takes everything."""
    data, cells = fields(spark, 1, 7, 8, 9, "double")
    systems = spark.createDataFrame([], "cycle int, storm_id string, status string, system_latitude double, system_longitude double, system_time timestamp_ntz")
    from windrose.plans import runs

    out = compositions.field_scan(cells, systems, lambda x: np.full((len(x), 3), 0.9), channel=runs.PLACES, variables=[c[0] for c in runs.CHANNELS], columns=8, radius=1, latitude=lambda r: r * 1.0, longitude=lambda c: c * 45.0, time=lambda c: F.lit("2024-01-01").cast("timestamp_ntz"), at=0.5, km=1.0, top=1000)
    got = {r["key"]: (r["latitude"], r["longitude"], r["storm_id"], r["cluster"] if "cluster" in out.columns else None) for r in out.collect()}
    want = {r * 8 + c: (float(r), c * 45.0 if c <= 4 else c * 45.0 - 360, None, None) for r in range(1, 6) for c in range(8) if (r * 7 + c * 3) % 4 > 0}
    assert got == want
    assert geo.EARTH_KM == 6371.0088


def test_doubled_cells_and_storms(spark):
    """Windows with a cell that is given twice are left out, as those with a missing one; a storm given twice counts once."""
    from windrose.plans import runs

    _, cells = fields(spark, 1, 7, 8, 9, "double")
    cells = cells.withColumn("candidate", F.lit(True))
    twice = cells.unionByName(cells.where("row = 3 AND col = 0").withColumn("stack", F.transform("stack", lambda x: x + 1)))
    at = lambda df: {(r["row"], r["col"]) for r in tiles.scan(df, lambda x: np.full((len(x), 3), 0.9), ["a", "b", "c"], radius=1, columns=8).collect()}
    left_out = {(r, c) for r in (2, 3, 4) for c in (7, 0, 1)}
    assert at(cells) - at(twice) == left_out and at(twice) < at(cells)
    assert {(r["row"], r["col"]) for r in tiles.patches(twice, 1, 8).collect()} == at(twice)
    systems = spark.createDataFrame([(0, "s", "TS", 80.0, 0.0, datetime(2024, 1, 1))] * 2, "cycle int, storm_id string, status string, system_latitude double, system_longitude double, system_time timestamp_ntz")
    out = compositions.field_scan(cells, systems, lambda x: np.full((len(x), 3), 0.9), channel=runs.PLACES, variables=[c[0] for c in runs.CHANNELS], columns=8, radius=1, latitude=lambda r: r * 1.0, longitude=lambda c: c * 45.0, time=lambda c: F.lit("2024-01-01").cast("timestamp_ntz"), at=0.5, km=1.0, match_km=1.0, top=1000)
    keys = [r["key"] for r in out.collect()]
    assert len(keys) == len(set(keys)) == 40 and {r["storm_id"] for r in out.collect()} == {"s"}


def test_scan_of_a_large_cycle(spark, monkeypatch):
    """A cycle with many detections near each other is ranked as when it is folded whole, and makes no pairs of them."""
    rng = random.Random(6)
    rows = [(k % 2, k, rng.randrange(-20, 20) / 2.0, rng.randrange(-20, 20) / 2.0, rng.randrange(40, 90) / 100.0) for k in range(900)]
    fixed = {"cnn_confidence": 0.9, "vit_confidence": 0.8, "land_fraction": 0.05, "midlevel_rh_percent": 70.0, "shear_200_850_ms": 10.0, "cyclonic_vorticity_850_s1": 2e-5, "pressure_anomaly_pa": -100.0, "surface_temperature_k": 301.0}
    time = F.lit("2024-01-01").cast("timestamp_ntz")
    df = spark.createDataFrame(rows, "cycle int, key long, latitude double, longitude double, confidence double").withColumns({**{c: F.lit(v) for c, v in fixed.items()}, "shares": F.create_map(F.lit("rhprs"), F.lit(0.3)), "learned": F.lit(None).cast("double"), "time": time})
    systems = spark.range(150).select((F.col("id") % 2).cast("int").alias("cycle"), F.col("id").cast("string").alias("storm_id"), F.lit("TS").alias("status"), (F.col("id") % 40 - 20).cast("double").alias("system_latitude"), (F.col("id") % 37 - 18).cast("double").alias("system_longitude"), time.alias("system_time"))
    found = lambda: sorted((r["cycle"], r["rank"], r["key"], r["storm_id"], r["system_class"], round(r["distance_km"], 6)) for r in compositions.operational_scan(df, systems, at=0.5, km=400.0, top=10).collect())
    whole = found()
    monkeypatch.setattr(detect, "FOLD_ROWS", 40)
    monkeypatch.setattr(detect, "_by_pairs", None)
    assert found() == whole and len(whole) == 20


def test_scan_rates_systems_once(spark):
    """Suppression and the search for systems, most of a scan's work, aren't done again for each that reads their result."""
    time = F.lit("2024-01-01").cast("timestamp_ntz")
    fixed = {"cnn_confidence": 0.9, "vit_confidence": 0.8, "land_fraction": 0.05, "midlevel_rh_percent": 70.0, "shear_200_850_ms": 10.0, "cyclonic_vorticity_850_s1": 2e-5, "pressure_anomaly_pa": -100.0, "surface_temperature_k": 301.0}
    rows = spark.range(200).select((F.col("id") % 4).cast("int").alias("cycle"), F.col("id").alias("key"), (F.col("id") % 40 - 20.0).alias("latitude"), (F.col("id") * 7 % 360 - 180.0).alias("longitude"), (F.col("id") % 97 / 97.0).alias("confidence"), time.alias("time"), *[F.lit(v).alias(c) for c, v in fixed.items()], F.create_map(F.lit("rhprs"), F.lit(0.3)).alias("shares"), F.lit(None).cast("double").alias("learned"))
    systems = spark.range(20).select((F.col("id") % 4).cast("int").alias("cycle"), F.col("id").cast("string").alias("storm_id"), F.lit("TS").alias("status"), (F.col("id") - 10.0).alias("system_latitude"), (F.col("id") * 9 - 90.0).alias("system_longitude"), time.alias("system_time"))
    plan = compositions.operational_scan(rows, systems, at=0.3, km=400.0)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("array_min(") + plan.count("collect_list(") <= 2


def test_components(spark, monkeypatch):
    """Long paths, a hub with most of the links, cycles, repeats and nulls; numbers, strings and structs."""
    from windrose.operators import components

    rng = random.Random(8)
    edges = [(i, i + 1) for i in range(1000, 1400)] + [(7, 5000 + i) for i in range(3000)] + [(1, 2), (2, 3), (3, 1), (4, 4), (None, 1), (9, None)] * 2
    rng.shuffle(edges)
    want = {i: 1000 for i in range(1000, 1401)} | {5000 + i: 7 for i in range(3000)} | {7: 7, 1: 1, 2: 1, 3: 1}
    df = spark.createDataFrame(edges, "a long, b long").repartition(4)
    for most in (components.RUN_ROWS, 50):
        monkeypatch.setattr(components, "RUN_ROWS", most)
        got = components.components(df)
        assert {r["node"]: r["root"] for r in got.collect()} == want and got.count() == len(want)
    text = df.selectExpr("lpad(a, 5, '0') AS a", "lpad(b, 5, '0') AS b")
    assert {r["node"]: r["root"] for r in components.components(text).collect()} == {f"{k:05}": f"{v:05}" for k, v in want.items()}
    pair = df.selectExpr("struct(a % 1 AS g, a AS k) AS a", "struct(b % 1 AS g, b AS k) AS b").where("a.k IS NOT NULL AND b.k IS NOT NULL")
    assert {r["node"]["k"]: r["root"]["k"] for r in components.components(pair).collect()} == want
    assert components.components(df.limit(0)).count() == 0
