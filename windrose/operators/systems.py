"""Active systems: feeds, bulletins and their de-duplication."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geo, text, when
from . import joins, ordered
from .joins import keep_last
from .lineage import cut

# Dvorak T-numbers from which a status holds.
DVORAK = [(5.0, "TY"), (3.5, "TS"), (2.0, "TD"), (0.0, "DB")]

_NHC = "activeStorms array<struct<id:string,name:string,classification:string,lastUpdate:string,latitude:string,longitude:string,latitudeNumeric:double,longitudeNumeric:double,intensity:string,pressure:string,publicAdvisory:struct<url:string>>>"
_FILE = "systems array<struct<name:string,storm_id:string,latitude:string,longitude:string,time:string,status:string,source:string,basin:string>>"


def in_age_window(ts: Column, now: Column, hours: float = 72.0, future: float = 2.0) -> Column:
    return when.hours_between(now, ts).between(-future, hours)


def nhc_systems(documents: DataFrame, now: Column, *, column: str = "json", hours: float = 72.0) -> DataFrame:
    """One row per storm of the feed's documents; records without a position or time in the window are left out."""
    s = documents.select(F.explode(F.from_json(column, _NHC)["activeStorms"]).alias("s"))
    rows = s.select(
        F.coalesce(F.nullif(F.trim("s.name"), F.lit("")), F.col("s.id")).alias("name"),
        F.upper("s.id").alias("storm_id"),
        F.coalesce("s.latitudeNumeric", text.coordinate(F.col("s.latitude"))).alias("latitude"),
        geo.lon_180(F.coalesce("s.longitudeNumeric", text.coordinate(F.col("s.longitude")))).alias("longitude"),
        when.parse_iso(F.col("s.lastUpdate")).alias("time"),
        F.coalesce(text.coded(F.upper("s.classification"), text.NHC_STATUS), F.upper("s.classification"), F.lit("TC")).alias("status"),
        text.optional_float(F.col("s.intensity")).alias("intensity_kt"),
        text.optional_float(F.col("s.pressure")).alias("pressure_hpa"),
        text.coded(F.upper(F.substring("s.id", 1, 2)), text.NHC_BASIN).alias("basin"),
        F.col("s.publicAdvisory.url").alias("bulletin_url"),
    )
    return rows.where(F.col("latitude").isNotNull() & F.col("longitude").isNotNull() & in_age_window(F.col("time"), now, hours))


def bulletin_links(pages: DataFrame, *, column: str = "html") -> DataFrame:
    """Links to bulletins: url, basin_code, stamp and storm id, newest first."""
    links = pages.select(F.explode(F.regexp_extract_all(column, F.lit(r"""(?i)href\s*=\s*["']?([^"'\s>]+)"""), F.lit(1))).alias("url"))
    pattern = r"(?i)/([a-z]+)/(\d{12})(\d{2}[A-Z])\.html"
    found = links.withColumns({"basin_code": F.lower(F.regexp_extract("url", pattern, 1)), "stamp": F.regexp_extract("url", pattern, 2), "storm_id": F.upper(F.regexp_extract("url", pattern, 3))})
    found = found.where("storm_id <> ''").distinct()
    stamp = F.concat(F.substring("stamp", 1, 4), F.lit("-"), F.substring("stamp", 5, 2), F.lit("-"), F.substring("stamp", 7, 2), F.lit(" "), F.substring("stamp", 9, 2), F.lit(":"), F.substring("stamp", 11, 2), F.lit(":00"))
    return found.withColumn("time", stamp.try_cast("timestamp_ntz")).orderBy(F.desc("stamp"), "storm_id")


def bulletins(df: DataFrame, *, body: str = "body", url: str = "url") -> DataFrame:
    """Systems read from bulletin texts with lettered fields; url names basin, time and id. Unreadable ones are left out."""
    pattern = r"(?i)/([a-z]+)/(\d{12})(\d{2}[A-Z])\.html"
    b = F.regexp_replace(body, r"<[^>]*>", " ")
    field = lambda letter: F.trim(F.regexp_extract(b, rf"(?m)^\s*{letter}\.\s*(.+?)\s*$", 1))
    s = F.regexp_extract(url, pattern, 2)
    near = F.concat(F.substring(s, 1, 4), F.lit("-"), F.substring(s, 5, 2), F.lit("-"), F.substring(s, 7, 2), F.lit(" "), F.substring(s, 9, 2), F.lit(":"), F.substring(s, 11, 2), F.lit(":00")).try_cast("timestamp_ntz")
    named = F.upper(F.trim(F.regexp_extract(field("A"), r"\(([^)]*)\)", 1)))
    storm = F.upper(F.regexp_extract(url, pattern, 3))
    code = F.lower(F.regexp_extract(url, pattern, 1))
    clock = r"^(\d{1,2})\s*/\s*(\d{4})\s*Z"
    day, hhmm = F.regexp_extract(field("B"), clock, 1).try_cast("int"), F.regexp_extract(field("B"), clock, 2)
    out = df.select(
        F.when(named.isin(*text.GENERIC_NAMES), storm).otherwise(named).alias("name"),
        storm.alias("storm_id"),
        text.coordinate(field("C")).alias("latitude"),
        text.coordinate(field("D")).alias("longitude"),
        F.when(day.isNotNull(), when.bulletin_time(day, hhmm, near)).otherwise(near).alias("time"),
        text.dvorak_status(b, DVORAK).alias("status"),
        F.coalesce(text.coded(code, text.OSPO_BASIN), code).alias("basin"),
        F.col(url).alias("bulletin_url"),
    )
    return out.where("latitude IS NOT NULL AND longitude IS NOT NULL AND time IS NOT NULL")


def listed_systems(documents: DataFrame, *, column: str = "json") -> DataFrame:
    """Systems of a file that is a list or has one under ``systems``; generic names give way to the id."""
    wrapped = F.when(F.trim(column).startswith("["), F.concat(F.lit('{"systems":'), F.col(column), F.lit("}"))).otherwise(F.col(column))
    s = documents.select(F.explode(F.from_json(wrapped, _FILE)["systems"]).alias("s"))
    rows = s.select(
        F.when(F.upper(F.trim(F.coalesce("s.name", F.lit("")))).isin(*text.GENERIC_NAMES) & F.col("s.storm_id").isNotNull(), F.col("s.storm_id")).otherwise(F.col("s.name")).alias("name"),
        F.col("s.storm_id").alias("storm_id"),
        text.coordinate(F.col("s.latitude")).alias("latitude"),
        text.coordinate(F.col("s.longitude")).alias("longitude"),
        when.parse_iso(F.col("s.time")).alias("time"),
        F.upper(F.coalesce("s.status", F.lit("UNKNOWN"))).alias("status"),
        F.col("s.source").alias("source"),
        F.col("s.basin").alias("basin"),
    )
    return rows.where("latitude IS NOT NULL AND longitude IS NOT NULL AND time IS NOT NULL")


def deduplicated(systems: DataFrame, *, hours: float = 12.0, km: float = 150.0) -> DataFrame:
    """Newest fix of each id, then newest first (ties: least id, then position): a system is left out when one that stays
    is within ``hours`` and ``km``. Ids that say nothing count as different systems.

    Near systems are found by time buckets and cells, and decided in rounds (ordered.first_kept).
    """
    generic = F.col("storm_id").isNull() | F.upper(F.trim(F.coalesce("storm_id", F.lit("")))).isin("", "UNKNOWN")
    known = keep_last(systems.where(~generic), ["storm_id"], [F.col("time"), F.col("latitude"), F.col("longitude")])
    place = F.struct((-F.unix_micros(F.col("time").cast("timestamp"))).alias("t"), F.coalesce("storm_id", F.lit("")).alias("id"), F.struct(*systems.columns).alias("row"))
    rows = cut(known.unionByName(systems.where(generic)).withColumns({"_place": place, "_key": F.monotonically_increasing_id()}))
    bucket = F.floor(F.unix_seconds(F.col("time").cast("timestamp")) / (hours * 3600)).cast("long")
    side = lambda x, b: rows.select(F.col("_key").alias(f"_key{x}"), F.col("_place").alias(f"_place{x}"), F.col("time").alias(f"_time{x}"), F.col("latitude").alias(f"_lat{x}"), F.col("longitude").alias(f"_lon{x}"), b.alias("_b"))
    near = joins.distance_join(side("1", bucket), side("2", F.explode(F.array(bucket - 1, bucket, bucket + 1))), km, left_at=("_lat1", "_lon1"), right_at=("_lat2", "_lon2"), on=["_b"])
    near = near.where((F.abs(when.hours_between(F.col("_time1"), F.col("_time2"))) <= hours) & (F.struct("_place1", "_key1") < F.struct(F.col("_place2").alias("_place1"), F.col("_key2").alias("_key1"))))
    kept = ordered.first_kept(rows, near.select(F.col("_key1").alias("_key"), F.col("_key2").alias("_after__key")), ["_key"])
    return rows.join(kept, "_key", "left_semi").select(*systems.columns)
