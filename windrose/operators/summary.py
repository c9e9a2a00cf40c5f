"""What is shown of published detections and of verified files: filters, counters, classes, summaries by file."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The classes that the counters of genesis and of active cyclones count.
GENESIS_CLASS, ACTIVE_CLASS = "NEW_GENESIS_CANDIDATE", "ACTIVE_CYCLONE"


def visible(detections: DataFrame, *, system_class: Column, score: Column, chosen: str | None = None, least: float = 0.0) -> DataFrame:
    """Detections of the ``chosen`` class (None: all) with a score of ``least`` or more; a missing score counts as 0."""
    kept = detections.where(F.coalesce(score, F.lit(0.0)) >= least)
    return kept if chosen is None else kept.where(system_class == chosen)


def counters(detections: DataFrame, *, system_class: Column, score: Column, by: list[str] | None = None) -> DataFrame:
    """(by, visible, genesis, active, mean_score); without detections the mean is null."""
    of = lambda name: F.count_if(F.coalesce(system_class == name, F.lit(False)))
    return detections.groupBy(*(by or [])).agg(F.count("*").alias("visible"), of(GENESIS_CLASS).alias("genesis"), of(ACTIVE_CLASS).alias("active"), F.avg(F.coalesce(score, F.lit(0.0))).alias("mean_score"))


def classes(detections: DataFrame, system_class: Column) -> DataFrame:
    """The distinct classes, in order."""
    return detections.select(system_class.alias("system_class")).where("system_class IS NOT NULL").distinct().orderBy("system_class")


def confident(detections: DataFrame, score: Column, above: float = 0.50) -> DataFrame:
    """Detections that score more than ``above``."""
    return detections.where(score > above)


def by_file(predictions: DataFrame, events: DataFrame, *, file: list[str], status: str = "verification_status", matched: str = "matched_name", name: str = "event_name") -> DataFrame:
    """(file, predictions, hits, false_alarms, events, misses, names, names_hit): one row for each file that has either.

    ``names`` are those of all events, ``names_hit`` those that hits were matched with: distinct, sorted, joined by "; ".
    Names are made distinct where the rows are, before they are gathered.
    """
    is_ = lambda what: F.count_if(F.coalesce(F.col(status) == what, F.lit(False)))
    listed = lambda c: F.array_join(F.sort_array(F.collect_set(c)), "; ")
    p = predictions.groupBy(*file).agg(F.count("*").alias("predictions"), is_("HIT").alias("hits"), is_("FALSE_ALARM").alias("false_alarms"), listed(F.when(F.col(status) == "HIT", F.col(matched).cast("string"))).alias("names_hit"))
    e = events.groupBy(*file).agg(F.count("*").alias("events"), is_("MISS").alias("misses"), listed(F.col(name).cast("string")).alias("names"))
    both = p.join(e, file, "full")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    empty = lambda c: F.coalesce(F.col(c), F.lit("")).alias(c)
    return both.select(*file, zero("predictions"), zero("hits"), zero("false_alarms"), zero("events"), zero("misses"), empty("names"), empty("names_hit"))
