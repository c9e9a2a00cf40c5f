"""Times from file names, bulletins and cycles. Timestamps carry no zone and mean UTC."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def floor_cycle(ts: Column, hours: int = 6) -> Column:
    """Start of the synoptic cycle."""
    day = F.date_trunc("day", ts.cast("timestamp_ntz"))
    return day + F.make_dt_interval(F.lit(0), (F.floor(F.hour(ts) / hours) * hours).cast("int"))


def is_synoptic(ts: Column, hours: int = 6) -> Column:
    return (F.minute(ts) == 0) & (F.hour(ts) % hours == 0)


def plus_hours(ts: Column, hours: Column | int) -> Column:
    return ts + F.make_dt_interval(F.lit(0), F.lit(hours) if isinstance(hours, int) else hours)


def hours_between(later: Column, earlier: Column) -> Column:
    """Signed, with fractions."""
    return (F.unix_micros(later.cast("timestamp")) - F.unix_micros(earlier.cast("timestamp"))) / 3.6e9


def analysis_time(name: Column) -> Column:
    """From a file name: yyyymmdd_HH[_MM], else yyyymmddHH, else yyyy-mm-ddTHH; null without any."""
    found = None
    for pattern in (r"(\d{4})(\d{2})(\d{2})[_.-](\d{2})(\d{2})?(?=\D|$)", r"(?<!\d)(\d{4})(\d{2})(\d{2})(\d{2})(?!\d)", r"(\d{4})-(\d{2})-(\d{2})[T_ ](\d{2})"):
        part = lambda i, p=pattern: F.regexp_extract(name, p, i)
        text = F.concat(part(1), F.lit("-"), part(2), F.lit("-"), part(3), F.lit(" "), part(4), F.lit(":00:00"))
        this = F.when(part(1) != "", text.try_cast("timestamp_ntz"))
        found = this if found is None else F.coalesce(found, this)
    return found


def underscore_time(name: Column) -> Column:
    """From names that end in _yyyymmdd_HH_MM before the suffix."""
    parts = F.split(F.regexp_replace(name, r"\.[A-Za-z0-9]+$", ""), "_")
    text = F.concat_ws("", F.slice(parts, -3, 3))
    return F.when(text.rlike(r"^\d{12}$"), F.concat(F.substring(text, 1, 4), F.lit("-"), F.substring(text, 5, 2), F.lit("-"), F.substring(text, 7, 2), F.lit(" "), F.substring(text, 9, 2), F.lit(":"), F.substring(text, 11, 2), F.lit(":00")).try_cast("timestamp_ntz"))


def day_of_year(year: Column, day: Column) -> Column:
    return F.date_add(F.make_date(year, F.lit(1), F.lit(1)), (day - 1).cast("int"))


def bulletin_time(day: Column, hhmm: Column, near: Column) -> Column:
    """A day of month and time of day, in the month that brings it closest to ``near``; ``near`` if no month has it."""
    hour, minute = F.substring(hhmm, 1, 2).cast("int"), F.substring(hhmm, 3, 2).cast("int")
    months = F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda m: F.add_months(F.trunc(near, "month"), m))
    tries = F.transform(months, lambda m: F.concat(F.date_format(m, "yyyy-MM-"), F.lpad(day.cast("string"), 2, "0"), F.lit(" "), F.lpad(hour.cast("string"), 2, "0"), F.lit(":"), F.lpad(minute.cast("string"), 2, "0"), F.lit(":00")).try_cast("timestamp_ntz"))
    rated = F.transform(F.filter(tries, lambda t: t.isNotNull()), lambda t: F.struct(F.abs(hours_between(t, near)).alias("off"), t.alias("t")))
    return F.coalesce(F.array_min(rated)["t"], near.cast("timestamp_ntz"))


def iso_z(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def parse_iso(text: Column) -> Column:
    """ISO text with Z, an offset or nothing, as UTC; null if it can't be read."""
    return F.regexp_replace(F.trim(text), "Z$", "+00:00").try_cast("timestamp").cast("timestamp_ntz")


def month_starts(start: Column, months: int) -> Column:
    """Array of the first days of consecutive months."""
    first = F.trunc(start, "month")
    return F.sequence(first, F.add_months(first, months - 1), F.expr("interval 1 month"))


def archive_name(ts: Column, prefix: str = "fnl_", suffix: str = "_00.grib2") -> Column:
    """Name of an analysis file."""
    return F.concat(F.lit(prefix), F.date_format(ts, "yyyyMMdd_HH"), F.lit(suffix))


def archive_url(ts: Column, base: str) -> Column:
    return F.concat(F.lit(base.rstrip("/") + "/"), F.date_format(ts, "yyyy"), F.lit("/"), F.date_format(ts, "yyyyMM"), F.lit("/"), archive_name(ts))
