"""Writers: GeoJSON, CSV and JSON documents, replaced as a whole."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def feature(lon: Column, lat: Column, properties: list[Column | str]) -> Column:
    """A GeoJSON point feature as text; numbers that aren't finite become null."""
    clean = F.struct(*properties)
    return F.to_json(F.struct(F.lit("Feature").alias("type"), F.struct(F.lit("Point").alias("type"), F.array(lon, lat).alias("coordinates")).alias("geometry"), clean.alias("properties")), {"ignoreNullFields": "false"})


def finite_columns(df: DataFrame) -> DataFrame:
    """NaN and infinity to null in all floating-point columns."""
    return df.withColumns({c: F.when(F.isnan(c) | (F.abs(c) == float("inf")), None).otherwise(F.col(c)) for c, t in df.dtypes if t in ("double", "float")})


def feature_lines(df: DataFrame, *, lat: str = "latitude", lon: str = "longitude") -> DataFrame:
    """One feature per row, as line-delimited GeoJSON: the form for outputs of any size."""
    clean = finite_columns(df)
    return clean.select(feature(F.col(lon), F.col(lat), [c for c in df.columns if c not in (lat, lon)]).alias("value"))


def geojson(df: DataFrame, metadata: dict, *, order: list[str], lat: str = "latitude", lon: str = "longitude", most: int = 100_000) -> str:
    """A FeatureCollection of the retained detections of a forecast; ValueError over ``most`` rows (use feature_lines)."""
    rows = feature_lines(df.orderBy(*order), lat=lat, lon=lon).limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"over {most} features")
    return json.dumps({"type": "FeatureCollection", "metadata": metadata, "features": [json.loads(r["value"]) for r in rows]})


def replace_text(spark: SparkSession, path: str, content: str) -> None:
    """Writes a file under another name and renames it over the old one in one step: readers see either, and a crash
    leaves the old one."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    staged = jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}.tmp")
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    fs = target.getFileSystem(conf)
    out = fs.create(staged, True)
    out.write(bytearray(content.encode()))
    out.close()
    mode = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    mode[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.makeQualified(target).toUri(), conf).rename(fs.makeQualified(staged), fs.makeQualified(target), mode)


def upsert_json(spark: SparkSession, path: str, key: str, value) -> dict:
    """Sets one key of a JSON document, other keys kept; a document that isn't there is begun."""
    from .readers import document

    jvm = spark.sparkContext._jvm
    there = jvm.org.apache.hadoop.fs.Path(path)
    old = document(spark, path) if there.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(there) else {}
    new = {**old, key: value}
    replace_text(spark, path, json.dumps(new, indent=2))
    return new


def csv(df: DataFrame, path: str, *, by: list[str] | None = None) -> None:
    w = df.write.option("header", True).mode("overwrite")
    (w.partitionBy(*by) if by else w).csv(path)
