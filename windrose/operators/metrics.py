"""Verification, ranking and calibration metrics as aggregates.

Rankings are computed from one row per distinct score, added up over range partitions (ordered.running): exact, and no
task holds all scores.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import ordered


def _n(condition: Column) -> Column:
    return F.count_if(condition).cast("double")


def contingency(hits: Column, misses: Column, false_alarms: Column) -> dict[str, Column]:
    """POD, precision, FAR and CSI; null where their denominator is 0."""
    return {"pod": F.try_divide(hits, hits + misses), "precision": F.try_divide(hits, hits + false_alarms), "far": F.try_divide(false_alarms, hits + false_alarms), "csi": F.try_divide(hits, hits + misses + false_alarms)}


def event_metrics(predictions: DataFrame, events: DataFrame) -> DataFrame:
    """One row from rows marked by verification_status (predictions also with distance_km and event_name)."""
    hit = F.col("verification_status") == "HIT"
    p = predictions.agg(F.count_if(hit).alias("hits"), F.count_if(~hit).alias("false_alarms"), F.avg(F.when(hit, F.col("distance_km"))).alias("mean_km"), F.array_join(F.sort_array(F.collect_set(F.when(hit, F.col("event_name")))), "; ").alias("hit_names"))
    e = events.agg(F.count_if(F.col("verification_status") == "MISS").alias("misses"))
    q = ordered.quantiles(predictions.where(hit), "distance_km", {"median_km": 0.5})
    one = lambda df: df.withColumn("_one", F.lit(1))  # noqa: E731  each is a single row
    joined = one(p).join(one(e), "_one").join(one(q), "_one", "left").drop("_one")
    return joined.withColumns(contingency(F.col("hits"), F.col("misses"), F.col("false_alarms")))


def unique_storms(events: DataFrame, *, storm: str = "sid") -> DataFrame:
    """Storms hit at least once, of all storms."""
    s = events.groupBy(storm).agg(F.bool_or(F.col("verification_status") == "HIT").alias("hit"))
    return s.agg(F.count("*").alias("storms"), F.count_if("hit").alias("storms_hit"), F.avg(F.col("hit").cast("double")).alias("storm_pod"))


def confusion(df: DataFrame, label: Column, score: Column, at: float, *, by: list[str] | None = None, epsilon: float = 1e-6) -> DataFrame:
    """tp, fp, fn, tn, accuracy, and precision, recall and F1 with ``epsilon`` in each denominator; and CSI."""
    y, p = label == 1, score >= at
    c = df.groupBy(*(by or [])).agg(F.count_if(y & p).alias("tp"), F.count_if(~y & p).alias("fp"), F.count_if(y & ~p).alias("fn"), F.count_if(~y & ~p).alias("tn"))
    tp, fp, fn, tn = (F.col(k) for k in ("tp", "fp", "fn", "tn"))
    c = c.withColumns({"accuracy": F.try_divide(tp + tn, tp + fp + fn + tn), "precision": tp / (tp + fp + epsilon), "recall": tp / (tp + fn + epsilon), "csi": tp / F.greatest(tp + fp + fn, F.lit(1))})
    return c.withColumn("f1", 2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall") + epsilon))


def classification_report(df: DataFrame, label: str, predicted: str) -> DataFrame:
    """precision, recall, f1 and support by class, and their macro and weighted means; 0 where undefined."""
    pairs = df.select(F.col(label).cast("string").alias("y"), F.col(predicted).cast("string").alias("p"))
    true = pairs.groupBy(F.col("y").alias("class")).agg(F.count("*").alias("support"), F.count_if(F.col("y") == F.col("p")).alias("tp"))
    said = pairs.groupBy(F.col("p").alias("class")).agg(F.count("*").alias("said"))
    zero = lambda x: F.coalesce(x, F.lit(0.0))
    rows = true.join(said, "class", "full").na.fill(0, ["support", "tp", "said"])
    rows = rows.withColumns({"precision": zero(F.try_divide("tp", "said")), "recall": zero(F.try_divide("tp", "support"))})
    rows = rows.withColumn("f1", zero(F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))).select("class", "precision", "recall", "f1", "support")
    names = ("precision", "recall", "f1")
    macro = rows.agg(F.lit("macro avg").alias("class"), *[F.avg(c).alias(c) for c in names], F.sum("support").alias("support"))
    weighted = rows.agg(F.lit("weighted avg").alias("class"), *[zero(F.try_divide(F.sum(F.col(c) * F.col("support")), F.sum("support"))).alias(c) for c in names], F.sum("support").alias("support"))
    return rows.unionByName(macro).unionByName(weighted)


def score_table(df: DataFrame, label: Column, score: Column, *, by: list[str] | None = None) -> DataFrame:
    """Positives and negatives at each distinct score, and running counts from the highest score down."""
    t = df.select(*(by or []), label.cast("int").alias("y"), score.cast("double").alias("score")).where("y IN (0, 1) AND score IS NOT NULL AND NOT isnan(score)")
    g = t.groupBy(*(by or []), "score").agg(F.sum("y").cast("double").alias("pos"), F.sum(1 - F.col("y")).cast("double").alias("neg"))
    return ordered.running(g, [F.desc("score")], {"tp": F.col("pos"), "fp": F.col("neg")}, by=by).withColumnsRenamed({"all_tp": "P", "all_fp": "N"})


def roc_auc(df: DataFrame, label: Column, score: Column, *, by: list[str] | None = None) -> DataFrame:
    """Chance that a positive scores above a negative, ties half; null with one label only."""
    t = score_table(df, label, score, by=by)
    return t.groupBy(*(by or [])).agg(F.try_divide(F.sum(F.col("neg") * (F.col("tp") - F.col("pos") / 2)), F.first("P") * F.first("N")).alias("roc_auc"))


def _curve(df: DataFrame, label: Column, score: Column, by: list[str] | None) -> DataFrame:
    """Precision and recall at each score, and at the next higher one (1 and 0 above the highest)."""
    t = score_table(df, label, score, by=by)
    before, wrong = F.col("tp") - F.col("pos"), F.col("fp") - F.col("neg")
    return t.withColumns({"precision": F.col("tp") / (F.col("tp") + F.col("fp")), "recall": F.try_divide("tp", "P"), "last_recall": F.coalesce(F.try_divide(before, F.col("P")), F.lit(0.0)), "last_precision": F.coalesce(F.try_divide(before, before + wrong), F.lit(1.0))})


def pr_curve(df: DataFrame, label: Column, score: Column, *, by: list[str] | None = None) -> DataFrame:
    return _curve(df, label, score, by).select(*(by or []), "score", "precision", "recall")


def pr_auc(df: DataFrame, label: Column, score: Column, *, by: list[str] | None = None) -> DataFrame:
    """Area under the precision-recall curve by trapezoids."""
    c = _curve(df, label, score, by)
    return c.groupBy(*(by or [])).agg(F.sum((F.col("recall") - F.col("last_recall")) * (F.col("precision") + F.col("last_precision")) / 2).alias("pr_auc"))


def average_precision(df: DataFrame, label: Column, score: Column, *, by: list[str] | None = None) -> DataFrame:
    """Precision summed over steps of recall."""
    c = _curve(df, label, score, by)
    return c.groupBy(*(by or [])).agg(F.sum((F.col("recall") - F.col("last_recall")) * F.col("precision")).alias("average_precision"))


def brier_and_log_loss(label: Column, p: Column, edge: float = 1e-15) -> dict[str, Column]:
    q = F.greatest(F.lit(edge), F.least(F.lit(1 - edge), p))
    return {"brier": F.avg(F.pow(p - label, 2)), "log_loss": F.avg(-(label * F.ln(q) + (1 - label) * F.ln(1 - q)))}


def expected_calibration_error(df: DataFrame, label: Column, p: Column, bins: int = 10) -> DataFrame:
    """Over equal bins, closed on the right."""
    edge = sum(((p > i / bins).cast("int") for i in range(1, bins)), F.lit(0))
    b = df.select(label.cast("double").alias("y"), p.alias("p"), edge.alias("bin")).groupBy("bin").agg(F.count("*").alias("n"), F.avg("y").alias("y"), F.avg("p").alias("p"))
    return b.agg((F.sum(F.col("n") * F.abs(F.col("y") - F.col("p"))) / F.sum("n")).alias("ece"))


def pick_threshold(df: DataFrame, label: Column, score: Column, *, objective: str = "max_f1", least_recall: float | None = None) -> DataFrame:
    """threshold, precision, recall and f1: greatest F1 (ties: lowest threshold), or with ``least_recall`` greatest precision at that recall (ties: highest threshold)."""
    t = score_table(df, label, score).withColumns({"precision": F.col("tp") / (F.col("tp") + F.col("fp")), "recall": F.try_divide("tp", "P")})
    t = t.withColumn("f1", F.coalesce(F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")), F.lit(0.0)))
    if least_recall is not None:
        best = t.where(F.col("recall") >= least_recall).agg(F.max(F.struct("precision", "score", "recall", "f1")).alias("b"))
        return best.select(F.col("b.score").alias("threshold"), "b.precision", "b.recall", "b.f1")
    if objective != "max_f1":
        raise ValueError(objective)
    best = t.agg(F.max(F.struct("f1", (-F.col("score")).alias("s"), "precision", "recall")).alias("b"))
    return best.select((-F.col("b.s")).alias("threshold"), "b.precision", "b.recall", "b.f1")


def sweep(df: DataFrame, label: Column, score: Column, *, low: float = 0.2, high: float = 0.8, steps: int = 121, precision_weight: float = 0.15) -> DataFrame:
    """Of evenly spaced thresholds the best by (CSI + weight * precision, threshold, precision, recall, CSI)."""
    # a score belongs to all thresholds up to it: count by the highest such step, then add up from above
    rank = F.floor((score.cast("double") - low) * (steps - 1) / (high - low) + 1e-9)
    usable = df.select(label.cast("int").alias("y"), F.greatest(F.lit(-1), F.least(F.lit(steps - 1), rank)).cast("long").alias("step")).where("y IN (0, 1) AND step IS NOT NULL")
    counts = usable.groupBy("step").agg(F.sum("y").cast("double").alias("pos"), F.sum(1 - F.col("y")).cast("double").alias("neg"))
    grid = df.sparkSession.range(-1, steps).withColumnRenamed("id", "step").join(counts, "step", "left").na.fill(0.0)
    above = Window.orderBy(F.desc("step")).rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    at = grid.withColumns({"pos_in": F.sum("pos").over(above), "neg_in": F.sum("neg").over(above), "all": F.sum("pos").over(whole)}).where("step >= 0").withColumns({"threshold": low + (high - low) * F.col("step") / (steps - 1), "pos_out": F.col("all") - F.col("pos_in")})
    rated = at.withColumns({"precision": F.coalesce(F.try_divide("pos_in", F.col("pos_in") + F.col("neg_in")), F.lit(0.0)), "recall": F.coalesce(F.try_divide("pos_in", F.col("pos_in") + F.col("pos_out")), F.lit(0.0)), "csi": F.col("pos_in") / F.greatest(F.col("pos_in") + F.col("neg_in") + F.col("pos_out"), F.lit(1.0))})
    best = rated.agg(F.max(F.struct((F.col("csi") + precision_weight * F.col("precision")).alias("rating"), "threshold", "precision", "recall", "csi")).alias("b"))
    return best.select("b.*")


def distribution(df: DataFrame, value: str, *, by: list[str] | None = None) -> DataFrame:
    """min, mean, median, p95, p99 and max, exact."""
    by = by or []
    ends = df.groupBy(*by).agg(F.min(value).alias("min"), F.avg(value).alias("mean"), F.max(value).alias("max"))
    q = ordered.quantiles(df, value, {"median": 0.5, "p95": 0.95, "p99": 0.99}, by=by)
    names = ("min", "mean", "median", "p95", "p99", "max")
    if not by:
        return ends.withColumn("_one", F.lit(1)).join(q.withColumn("_one", F.lit(1)), "_one", "left").select(*names)
    q = q.withColumnsRenamed({c: f"_k_{c}" for c in by})
    same = F.lit(True)
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"_k_{c}"))
    return ends.join(q, same, "left").select(*by, *names)


def outcome(label: Column, predicted: Column) -> Column:
    return F.when((label == 1) & (predicted == 1), "TP").when((label == 1) & (predicted == 0), "FN").when((label == 0) & (predicted == 1), "FP").otherwise("TN")


def prediction_sanity(df: DataFrame, label: str, score: str) -> None:
    """ValueError unless labels are 0 and 1, both there, and scores finite and within [0, 1]."""
    r = df.agg(F.count_if(~F.coalesce(F.col(label).isin(0, 1), F.lit(False))).alias("labels"), F.count_distinct(label).alias("kinds"), F.count_if(~F.coalesce(F.col(score).between(0, 1), F.lit(False)) | F.isnan(F.col(score))).alias("scores")).first()
    if r["labels"] or r["kinds"] != 2 or r["scores"]:
        raise ValueError(f"unusable predictions: {r.asDict()}")
