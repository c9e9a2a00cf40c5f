"""Text of bulletins, names and codes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Codes of the feeds.
NHC_STATUS = {"HU": "HU", "TS": "TS", "TD": "TD", "ST": "ST", "SS": "SS", "SD": "SD", "PT": "PTC", "PTC": "PTC"}
NHC_BASIN = {"AL": "North Atlantic", "EP": "Eastern Pacific", "CP": "Central Pacific"}
OSPO_BASIN = {"wpac": "Western Pacific", "nind": "North Indian Ocean", "spac": "South Pacific", "epac": "Eastern Pacific", "atl": "North Atlantic"}
GENERIC_NAMES = ["", "UNKNOWN", "UNNAMED", "NONAME", "NO NAME", "TROPICAL", "DISTURBANCE", "TROPICAL DISTURBANCE"]


def coded(code: Column, table: dict[str, str]) -> Column:
    """The table's value, or null."""
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), code)


def coordinate(text: Column) -> Column:
    """Signed degrees of text such as 13.4N or 177.0E, or of a plain number; null if it is neither."""
    number = F.regexp_extract(text, r"^\s*([+-]?\d+(?:\.\d+)?)\s*([NSEWnsew]?)\s*$", 1).try_cast("double")
    side = F.upper(F.regexp_extract(text, r"^\s*([+-]?\d+(?:\.\d+)?)\s*([NSEWnsew]?)\s*$", 2))
    return F.when(side.isin("S", "W"), -F.abs(number)).when(side.isin("N", "E"), F.abs(number)).otherwise(number)


def dvorak_status(text: Column, thresholds: list[tuple[float, str]]) -> Column:
    """Status by the T-number; TC without one, DB under all thresholds."""
    t = F.regexp_extract(text, r"(?i)\bT(\d+(?:\.\d+)?)\s*/", 1).try_cast("double")
    out = F.when(t.isNull(), "TC")
    for least, status in sorted(thresholds, reverse=True):
        out = out.when(t >= least, status)
    return out.otherwise("DB")


def clean_name(name: Column) -> Column:
    """Trimmed, upper case; empty and NOT_NAMED become UNNAMED."""
    x = F.upper(F.trim(name))
    return F.when(x.isNull() | x.isin("", "NOT_NAMED"), "UNNAMED").otherwise(x)


def optional_float(text: Column) -> Column:
    """Empty text and "null" are missing."""
    x = F.trim(text.cast("string"))
    return F.when(F.lower(x).isin("", "null"), None).otherwise(x.try_cast("double"))


def pipe_key(*columns: Column) -> Column:
    return F.concat_ws("|", *[F.coalesce(c.cast("string"), F.lit("")) for c in columns])
