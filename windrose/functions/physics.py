"""Scalar support functions of screening and classification."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def finite(value: Column) -> Column:
    """Null for what isn't a finite number."""
    x = value.cast("double")
    return F.when(F.isnan(x) | (F.abs(x) == float("inf")), None).otherwise(x)


def safe_float(value: Column, default: float = 0.0) -> Column:
    """A number from any text or number, ``default`` where it is missing, unreadable or not finite."""
    return F.coalesce(finite(value.try_cast("double")), F.lit(float(default)))


def finite_or_zero(value: Column) -> Column:
    return F.coalesce(finite(value), F.lit(0.0))


def clip01(value: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), value))


def soft_pass(value: Column, threshold: float, scale: float, *, higher_is_better: bool = True) -> Column:
    """Logistic support around a threshold; its argument is held within 20."""
    z = (value - threshold) / max(abs(scale), 1e-12)
    z = z if higher_is_better else -z
    return 1 / (1 + F.exp(-F.greatest(F.lit(-20.0), F.least(F.lit(20.0), z))))


def logit(p: Column, edge: float = 1e-6) -> Column:
    q = F.greatest(F.lit(edge), F.least(F.lit(1 - edge), p))
    return F.ln(q / (1 - q))


def wind_shear(u1: Column, v1: Column, u2: Column, v2: Column) -> Column:
    return F.hypot(u2 - u1, v2 - v1)


def cyclonic(lat: Column, vorticity: Column) -> Column:
    """Vorticity with the sign that is cyclonic in its hemisphere."""
    return F.when(lat >= 0, vorticity).otherwise(-vorticity)


def relative_humidity_percent(value: Column, units: Column, field_max: Column) -> Column:
    """Fractions (by their unit, or fields that never exceed 1.5) become percent."""
    return F.when(F.lower(F.trim(F.coalesce(units, F.lit("")))).isin("1", "fraction", "0-1") | (field_max <= 1.5), value * 100).otherwise(value)


def pressure_pa(value: Column, units: Column) -> Column:
    return F.when(F.lower(F.trim(units)).isin("hpa", "mb", "mbar", "millibar"), value * 100).otherwise(value)


def geopotential_height(value: Column, units: Column) -> Column:
    return F.when(F.regexp_replace(F.lower(F.trim(units)), r"\s|\*\*|\^", "").isin("m2s-2", "m2/s2"), value / 9.80665).otherwise(value)


def clamp(value: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), value))
