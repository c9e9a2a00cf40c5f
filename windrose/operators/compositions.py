"""Whole runs over all cycles at once: operational scan, verification, enrichment, threshold report, training sets."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import physics
from ..sources import geojson_sink, writers
from . import attribution, classify, detect, joins, metrics, ordered, tiles, tracks
from .lineage import cut

CONDITIONS = [c for c, *_ in classify.CONDITIONS.values()]


@dataclass(frozen=True)
class ScanConfig:
    """What a forecast run is made with; checked when it is made, and the same from then on."""

    lead_times: tuple[int, ...]
    at: float = 0.75
    least_expert: float = 0.45
    km: float = 300.0
    match_km: float = 600.0
    top: int = 20
    mode: str = "auto"
    stale_km: float = 500.0
    band: tuple[float, float] = (-35.0, 35.0)
    most_land: float = 0.5
    least_warmth: float | None = None
    radius: int = 10

    def __post_init__(self):
        low, high = self.band
        wrong = [
            name
            for name, fine in {
                "lead_times": len(self.lead_times) > 0 and all(isinstance(h, int) and h > 0 for h in self.lead_times) and len(set(self.lead_times)) == len(self.lead_times),
                "at": 0 < self.at < 1,
                "least_expert": 0 <= self.least_expert <= 1,
                "km": self.km > 0,
                "match_km": self.match_km > 0,
                "stale_km": self.stale_km > 0,
                "top": self.top > 0,
                "mode": self.mode in ("auto", "rules", "learned"),
                "band": -90 <= low < high <= 90,
                "most_land": 0 <= self.most_land <= 1,
                "least_warmth": self.least_warmth is None or self.least_warmth > 0,
                "radius": self.radius >= 0,
            }.items()
            if not fine
        ]
        if wrong:
            raise ValueError(f"wrong settings: {wrong}")

    def text(self) -> str:
        """As JSON, for a run's metadata."""
        return json.dumps(asdict(self), sort_keys=True)

    @classmethod
    def of(cls, text: str) -> ScanConfig:
        found = json.loads(text)
        return cls(**{k: tuple(v) if isinstance(v, list) else v for k, v in found.items()})

    def candidate(self, latitude: Column, land: Column, warmth: Column) -> Column:
        """Whether a cell is looked at; windows that aren't whole are left out by the scan."""
        fine = latitude.between(*self.band) & (land <= self.most_land)
        return fine if self.least_warmth is None else fine & (warmth >= self.least_warmth)


#: Retained detections that one task rates against the systems of their cycle.
TASK_ROWS = 2000


def operational_scan(candidates: DataFrame, systems: DataFrame, *, at: float = 0.75, least_expert: float = 0.45, km: float = 300.0, match_km: float = 600.0, top: int = 20, generic: list[str] | None = None) -> DataFrame:
    """The retained detections of each cycle, classified and ranked.

    ``candidates``: cycle, key, latitude, longitude, time, confidence, cnn_confidence, vit_confidence, the six CONDITIONS,
    shares (map of attributions) and learned (gated probability or null); ``systems``: cycle, storm_id, status,
    system_latitude, system_longitude, system_time. Score gate, suppression within ``km``, nearest system by distance and
    age, hybrid support, rule cascade, one detection of each matched system, and the ``top`` best of a cycle. A storm that
    a cycle has twice under one id counts once, with its least status.
    """
    gated = candidates.where(detect.available_gate(F.col("confidence"), F.col("cnn_confidence"), F.col("vit_confidence"), at, least_expert))
    kept = cut(detect.suppress(gated, km, by=["cycle"], lat="latitude", lon="longitude", confidence="confidence", key="key").select("cycle", "key"))
    # rows are few bytes, but each is rated against its systems: dealt by number
    rows = gated.join(kept, ["cycle", "key"]).repartition(int(max(1, min(20_000, -(-kept.count() // TASK_ROWS)))), "cycle", "key")
    near = joins.nearest_with_age(rows, systems, left_at=("latitude", "longitude"), left_time="time", key="storm_id", system_at=("system_latitude", "system_longitude"), system_time="system_time", on=["cycle"])
    # one row for each storm, so that one given twice doesn't double its detections
    near = near.join(systems.groupBy("cycle", "storm_id").agg(F.min("status").alias("status")), ["cycle", "storm_id"], "left")
    near = cut(near)  # what follows reads it twice, and filters would rate the systems again
    c = {n: F.col(n) for n in CONDITIONS}
    support = classify.hybrid_support(classify.environment_support(c), classify.attribution_support(F.col("shares")), F.col("confidence"), F.col("cnn_confidence"), F.col("vit_confidence"))
    verdict = classify.cascade(distance=F.col("distance_km"), age=F.col("age_hours"), status=F.col("status"), land=F.col("land_fraction"), rh=F.col("midlevel_rh_percent"), shear=F.col("shear_200_850_ms"), vorticity=F.col("cyclonic_vorticity_850_s1"), checks=classify.favourable_count(c), hybrid=F.col("hybrid_support"), learned=F.col("learned"))
    judged = near.withColumn("hybrid_support", support).withColumn("_v", verdict)
    judged = judged.withColumns({"system_class": F.col("_v.system_class"), "class_confidence": F.col("_v.confidence"), "matched_system": F.when(F.col("distance_km") <= match_km, F.col("storm_id"))}).drop("_v")
    single = detect.one_per_system(judged, by=["cycle"], system="matched_system", confidence="confidence", key="key", generic=generic or [])
    return detect.top_k(single, top, by=["cycle"], order=[F.desc("confidence"), F.col("key")])


def field_scan(
    cells: DataFrame,
    systems: DataFrame,
    scorer: Callable,
    *,
    channel: dict[str, int | list[int]],
    variables: list[str],
    columns: int,
    radius: int,
    latitude: Callable[[Column], Column],
    longitude: Callable[[Column], Column],
    time: Callable[[Column], Column],
    learned: Callable[[dict[str, Column]], Column] | None = None,
    at: float = 0.75,
    least_expert: float = 0.45,
    explain: Callable | None = None,
    means: list[float] | None = None,
    stds: list[float] | None = None,
    **options,
) -> DataFrame:
    """From fields to ranked hotspots: windows of all candidate cells scored in tiles, and operational_scan of what passes.

    ``cells``: cycle, row, col, stack, candidate. ``scorer`` gives confidence, cnn_confidence and vit_confidence (see
    tiles.scan, which also tells of ``explain``, ``means`` and ``stds``). ``channel`` has the conditions' places in the
    stack (tiles.environment), ``variables`` the variable of each channel; latitude, longitude and time are functions of
    row, column and cycle. ``learned`` makes the gated probability from the detection's columns.
    """
    scores = ["confidence", "cnn_confidence", "vit_confidence"]
    found = tiles.scan(cells, scorer, scores, radius=radius, columns=columns, at=at, least_expert=least_expert, explain=explain, means=means, stds=stds)
    lat, lon = latitude(F.col("row")), longitude(F.col("col"))
    place = {"key": (F.col("row") * columns + F.col("col")).cast("long"), "latitude": lat, "longitude": F.when(lon <= 180, lon).otherwise(lon - 360), "time": time(F.col("cycle"))}
    rows = found.withColumns({**place, **tiles.environment(channel), "shares": tiles.shares(variables)}).drop("row", "col", "center", "mean", "attribution")
    rows = cut(rows.withColumn("cyclonic_vorticity_850_s1", physics.cyclonic(F.col("latitude"), F.col("vorticity_850_s1"))))
    nothing = F.lit(None).cast("double")
    rows = rows.withColumn("learned", nothing if learned is None else learned({c: F.col(c) for c in rows.columns}))
    return operational_scan(rows, systems, at=at, least_expert=least_expert, **options)


def forecast(cells: DataFrame, systems: DataFrame, scorers: dict[int, Callable], config: ScanConfig, folder: str, *, cycle: str, metadata: dict | None = None, **scan) -> dict[int, str]:
    """Scans one cycle's fields for every lead time of ``config`` and publishes each as GeoJSON, with ``latest_<hours>h``
    moved last; the names of the documents. ``scorers``: lead time to scorer; ValueError, before anything runs, if one is
    missing. ``cycle`` names the cycle; ``scan`` goes to field_scan. One document is written by one task: a cycle keeps
    ``config.top`` detections.
    """
    missing = [h for h in config.lead_times if h not in scorers]
    if missing:
        raise ValueError(f"no scorer for lead times {missing}")
    geojson_sink.register(cells.sparkSession)
    made = {}
    for hours in config.lead_times:
        found = field_scan(cells, systems, scorers[hours], radius=config.radius, at=config.at, least_expert=config.least_expert, km=config.km, match_km=config.match_km, top=config.top, **scan)
        shown = found.withColumns({"lead_time_hrs": F.lit(hours), "confidence_percent": F.round(F.col("confidence") * 100, 2), "xai_mean": F.col("shares")}).drop("shares", "_n")
        name = f"genesis_forecast_{hours}h_{cycle}"
        about = {**(metadata or {}), "lead_time_hrs": hours, "initialization_time_utc": cycle, "settings": json.loads(config.text())}
        one = shown.repartition(1).sortWithinPartitions("cycle", "rank")  # at most ``top`` rows of a cycle
        one.write.format("geojson").mode("append").options(path=folder, name=name, latest=f"{hours}h", flatten="xai_mean", metadata=json.dumps(about)).save()
        made[hours] = name
    return made


def verified_cycles(detections: DataFrame, events: DataFrame, *, lead: float, tolerance: float, match_km: float, at: float, least_expert: float, cluster_km: float, least: int = 1, top: int | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Annotated predictions, annotated events, and a summary by cycle.

    ``detections``: cycle, analysis_time, key, latitude, longitude, confidence, cnn_confidence, vit_confidence; ``events``:
    event_id, event_name, event_time, event_latitude, event_longitude. Strict score gate, clusters within a cycle and
    their representatives, events whose genesis is ``lead`` hours off give or take ``tolerance`` (not before the
    analysis), and greedy one-to-one matches within ``match_km``.
    """
    cycles = detections.select("cycle", "analysis_time").distinct()
    raw = detections.where(detect.score_gate(F.col("confidence"), F.col("cnn_confidence"), F.col("vit_confidence"), at, least_expert))
    labels = detect.density_clusters(raw, cluster_km, least, key="key", lat="latitude", lon="longitude", on=["cycle"])
    predictions = detect.representatives(raw.join(labels, ["cycle", "key"]), by=["cycle", "cluster"], key="key", top=top)
    due = joins.interval_join(cycles, events, left_time="analysis_time", right_time="event_time", low_hours=max(0.0, lead - tolerance), high_hours=lead + tolerance)
    near = joins.distance_join(predictions.select("cycle", "cluster", "latitude", "longitude"), due.select("cycle", "event_id", "event_latitude", "event_longitude"), match_km, left_at=("latitude", "longitude"), right_at=("event_latitude", "event_longitude"), on=["cycle"])
    matches = joins.greedy_match(near.select("cycle", "cluster", "event_id", "distance_km"), group=["cycle"], left="cluster", right="event_id", distance="distance_km")
    p = predictions.join(matches, ["cycle", "cluster"], "left").withColumn("verification_status", F.when(F.col("event_id").isNotNull(), "HIT").otherwise("FALSE_ALARM"))
    p = p.join(events.select("event_id", F.col("event_name").alias("matched_name")), "event_id", "left")
    e = due.join(matches.select("cycle", "event_id", "cluster"), ["cycle", "event_id"], "left").withColumn("verification_status", F.when(F.col("cluster").isNotNull(), "HIT").otherwise("MISS"))
    n = lambda c: F.coalesce(c, F.lit(0))
    names = lambda c: F.array_join(F.sort_array(F.collect_set(c)), "; ")
    hit = F.col("verification_status") == "HIT"
    by_p = p.groupBy("cycle").agg(F.count("*").alias("predictions"), F.count_if(hit).alias("hits"), F.count_if(~hit).alias("false_alarms"), names(F.when(hit, F.col("matched_name"))).alias("names_hit"))
    by_e = e.groupBy("cycle").agg(F.count("*").alias("events"), F.count_if(~hit).alias("misses"), names("event_name").alias("names"))
    counts = raw.groupBy("cycle").agg(F.count("*").alias("raw_detections"))
    summary = cycles.join(counts, "cycle", "left").join(by_p, "cycle", "left").join(by_e, "cycle", "left")
    whole = [c for c in ("raw_detections", "predictions", "events", "hits", "misses", "false_alarms")]
    return p, e, summary.select("cycle", *[n(F.col(c)).alias(c) for c in whole], F.coalesce("names", F.lit("")).alias("names"), F.coalesce("names_hit", F.lit("")).alias("names_hit"))


def enriched(rows: DataFrame, cache: DataFrame, cells: DataFrame, attributions: DataFrame, *, keys: list[str]) -> DataFrame:
    """``rows`` with the attributions and patch means that a cache has, or that patches give where it has none.

    ``cells``: the keys with variable, lev, value and is_center of each row's patch; ``attributions``: the keys with
    variable and value. Both may hold more rows than are wanted; only pending ones are aggregated.
    """
    values = [c for c in cache.columns if c not in keys]
    known, pending = joins.reuse_cached(rows, cache, keys, values)
    wanted = pending.select(*keys).distinct()
    from . import grid

    means = grid.environment(cells.join(wanted, keys, "left_semi"), by=keys)
    share = attribution.shares(attributions.join(wanted, keys, "left_semi"), by=keys, variable="variable", value="value")
    names = F.map_from_entries(F.collect_list(F.struct(F.concat(F.lit("xai_mean_"), "variable"), "mean_share"))).alias("shares")
    made = means.join(share.groupBy(*keys).agg(names), keys, "left")
    flat = made.select(*keys, *[F.col(c) if c in made.columns else F.try_element_at("shares", F.lit(c)).alias(c) for c in values])
    return known.unionByName(pending.join(flat, keys, "left"))


def threshold_report(spark: SparkSession, predictions: DataFrame, path: str, key: str, *, label: Column, score: Column, least_recall: float | None = None) -> dict:
    """Picks a threshold on validated predictions and puts it with its figures under ``key`` of a JSON document."""
    best = metrics.pick_threshold(predictions, label, score, least_recall=least_recall).first()
    if best is None or best["threshold"] is None:
        raise ValueError("no threshold reaches the recall asked for")
    return writers.upsert_json(spark, path, key, {c: float(best[c]) for c in ("threshold", "precision", "recall", "f1")})


def raw_sweep(scored: DataFrame, *, score: str, key: str, top: int = 100, high: float = 0.5) -> tuple[DataFrame, DataFrame]:
    """Distribution of raw scores with how many are over ``high`` and whether all are alike, and the ``top`` with ranks."""
    ends = scored.agg(F.count_if(F.col(score) > high).alias("high"), (F.max(score) == F.min(score)).alias("constant"))
    shape = metrics.distribution(scored, score)
    one = lambda df: df.withColumn("_one", F.lit(1))  # noqa: E731  each is a single row
    return one(shape).join(one(ends), "_one").drop("_one"), scored.orderBy(F.desc(score), key).limit(top)


def training_epoch(positives: DataFrame, candidates: DataFrame, *, key: str, ratio: int, epoch: int, batch: int, seed: int = 0) -> DataFrame:
    """One epoch: all positives and ``ratio`` negatives for each, in an order of its own, with label and batch number.

    ``ratio`` 1 and a fixed ``epoch`` make an evaluation set. Batches are numbered by rank, the last may be short.
    """
    negatives = tracks.balanced_negatives(candidates, ratio * positives.count(), key=key, seed=seed + epoch)
    rows = positives.withColumns({"draw": F.lit(0).cast("long"), "label": F.lit(1)}).unionByName(negatives.withColumn("label", F.lit(0)))
    order = F.md5(F.concat_ws("|", F.lit(str(seed)), F.lit(str(epoch)), F.col("label").cast("string"), F.col(key).cast("string"), F.col("draw").cast("string")))
    ranked = ordered.running(rows.withColumn("_o", order), [F.col("_o"), F.col(key)], {"_n": F.lit(1)})
    return ranked.withColumn("batch", F.floor((F.col("_n") - 1) / batch)).drop("_o", "_n", "all__n")


def augmented(patch: Column, key: Column, *, channels: int, last: int = 136, seed: int = 0) -> Column:
    """A patch (channel values cell by cell) with noise, scales by channel and blanked cells, each with its probability and
    drawn from hashes of seed and key, so that another run draws the same; channels from ``last`` on stay."""
    draw = lambda *parts: (F.pmod(F.xxhash64(F.lit(seed), key, *parts), F.lit(1 << 30)) + 0.5) / float(1 << 30)
    said = lambda name: F.lit(name)
    normal = lambda i: F.sqrt(-2 * F.ln(draw(said("r"), i))) * F.cos(2 * F.pi() * draw(said("a"), i))

    def one(x: Column, i: Column) -> Column:
        channel, cell = F.pmod(i, F.lit(channels)), F.floor(i / channels)
        noisy = x + F.when(draw(said("noise")) < 0.5, 0.01 * normal(i)).otherwise(0.0)
        scaled = noisy * F.when(draw(said("scale")) < 0.3, 0.99 + 0.02 * draw(said("s"), channel)).otherwise(1.0)
        return F.when(channel >= last, x).otherwise(F.when((draw(said("mask")) < 0.2) & (draw(said("m"), cell) <= 0.01), 0.0).otherwise(scaled))

    return F.transform(patch, one)


def display_score(percent: Column, confidence_percent: Column, confidence: Column) -> Column:
    """The score shown, in percent: the first that is a finite number, else 0."""
    return F.coalesce(physics.finite(percent), physics.finite(confidence_percent), physics.finite(confidence) * 100, F.lit(0.0))


def marker_radius(score: Column) -> Column:
    return F.greatest(F.lit(8.0), F.least(F.lit(15.0), 7 + (score - 70) * 0.2))


def impact_profile(hour: Column) -> Column:
    """What the hour of a variable's bend says."""
    return F.when(hour <= -60, "Early Environment Setup").when(hour <= -36, "Vortex Spin-up Phase").otherwise("Core Inflow Collapse")
