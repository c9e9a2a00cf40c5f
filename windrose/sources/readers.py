"""Readers with explicit schemas. Column pruning and filters reach the scans of Parquet; text is parsed in the plan."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geo, when
from ..operators import tracks

TRACK_COLUMNS = ["SID", "SEASON", "BASIN", "SUBBASIN", "NAME", "ISO_TIME", "NATURE", "LAT", "LON", "USA_WIND"]


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def track_csv(spark: SparkSession, path: str, *, seasons: tuple[int, int] | None = None) -> DataFrame:
    """Fixes of a best-track file; its row of units can't be read as numbers and so drops out."""
    raw = spark.read.csv(path, header=True, enforceSchema=False, mode="PERMISSIVE", nullValue="\u0000", emptyValue="")
    if seasons:
        raw = raw.where(F.col("SEASON").try_cast("int").between(*seasons))
    return tracks.clean_tracks(raw)


def yearly_storm_text(spark: SparkSession, path: str) -> DataFrame:
    """Files of blank-separated lines (storm, day of year, lat, lon), a year in each name: sid, date, lat, lon."""
    lines = spark.read.text(path).withColumn("path", F.col("_metadata.file_path"))
    f = F.split(F.trim("value"), r"\s+")
    year = F.regexp_extract(F.element_at(F.split("path", "/"), -1), r"(\d{4})", 1).try_cast("int")
    parsed = lines.where(F.size(f) >= 4).select(year.alias("year"), f[0].alias("storm"), f[1].try_cast("double").alias("day"), f[2].try_cast("double").alias("lat"), geo.lon_360(f[3].try_cast("double")).alias("lon"))
    return parsed.where("day IS NOT NULL AND lat IS NOT NULL AND lon IS NOT NULL AND year IS NOT NULL").select(F.concat_ws("-", "year", "storm").alias("sid"), when.day_of_year(F.col("year"), F.col("day")).alias("date"), "lat", "lon")


def prediction_csvs(spark: SparkSession, *roots: str, schema: str) -> DataFrame:
    """All *_predictions.csv under the roots, each file once, with its path."""
    return spark.read.schema(schema).option("header", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*_predictions.csv").csv(list(dict.fromkeys(roots))).withColumn("source_file", F.col("_metadata.file_path"))


def files(spark: SparkSession, root: str, pattern: str = "*", *, least_bytes: int = 0) -> DataFrame:
    """path, size, modified and analysis time of files, without their contents."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(root)
    return found.where(F.col("length") >= least_bytes).select("path", "length", F.col("modificationTime").alias("modified"), F.coalesce(when.analysis_time(F.element_at(F.split("path", "/"), -1)), when.underscore_time(F.element_at(F.split("path", "/"), -1))).alias("ts"))


def newest(found: DataFrame) -> DataFrame:
    return found.agg(F.max_by("path", F.struct("modified", "path")).alias("path"))


def document(spark: SparkSession, path: str) -> dict | list:
    """A JSON document of configuration; an error if it isn't there."""
    return json.loads(spark.read.text(path, wholetext=True).first()[0])


def thresholds(spark: SparkSession, path: str) -> dict[str, float]:
    found = {k: float(v) for k, v in document(spark, path).items() if isinstance(v, int | float)}
    wrong = {k: v for k, v in found.items() if not 0 < v < 1}
    if wrong or not found:
        raise ValueError(f"thresholds must lie between 0 and 1: {wrong or 'none there'}")
    return found


def channel_statistics(spark: SparkSession, path: str, channels: int = 137) -> DataFrame:
    """idx, mean, std > 0; where the land mask's row is missing it is added as it stands (0, 1)."""
    stats = spark.read.schema("idx int, mean double, std double").parquet(path)
    r = stats.agg(F.count("*").alias("n"), F.count_if(F.expr("std <= 0 OR isnan(mean) OR isnan(std)")).alias("bad")).first()
    if r["bad"] or r["n"] not in (channels - 1, channels):
        raise ValueError(f"{r['n']} rows, {r['bad']} unusable")
    return stats if r["n"] == channels else stats.unionByName(spark.createDataFrame([(channels - 1, 0.0, 1.0)], "idx int, mean double, std double"))


def newest_cycle(landed: DataFrame, now, *, steps: int = 120, hours: int = 6) -> DataFrame:
    """The newest synoptic cycle of the last ``steps`` that has landed (column ts)."""
    spark = landed.sparkSession
    last = when.floor_cycle(F.lit(now).cast("timestamp_ntz"), hours)
    wanted = spark.range(steps).select((last - F.make_dt_interval(F.lit(0), (F.col("id") * hours).cast("int"))).alias("ts"))
    return wanted.join(landed.select("ts").distinct(), "ts", "left_semi").agg(F.max("ts").alias("ts"))
