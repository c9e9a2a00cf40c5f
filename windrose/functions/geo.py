"""Geodesy on the sphere. Angles are degrees; a null gives a null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_KM, GENERATOR_EARTH_KM = 6371.0088, 6371.0


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column, radius: float = EARTH_KM) -> Column:
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * radius * F.asin(F.least(F.lit(1.0), F.sqrt(a)))


def haversine_atan2_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column, radius: float = GENERATOR_EARTH_KM) -> Column:
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * radius * F.atan2(F.sqrt(a), F.sqrt(1 - a))


def lon_180(lon: Column) -> Column:
    """In (-180, 180]."""
    x = F.pmod(lon + 180, F.lit(360.0)) - 180
    return F.when(x == -180, 180.0).otherwise(x)


def lon_360(lon: Column) -> Column:
    """In [0, 360), negative input too."""
    return F.pmod(lon.cast("double"), F.lit(360.0))


def circular_mean_lon(weight: Column, lon: Column) -> Column:
    """Aggregate: weighted mean direction, in (-180, 180]."""
    return lon_180(F.degrees(F.atan2(F.sum(weight * F.sin(F.radians(lon))) / F.sum(weight), F.sum(weight * F.cos(F.radians(lon))) / F.sum(weight))))


def lat_cell(lat: Column, size: float) -> Column:
    return F.floor((lat + 90) / size)


def lon_cell(lon: Column, size: float) -> Column:
    """Cells of a ring that closes: ``size`` must divide 360."""
    return F.floor(lon_360(lon) / size)


def grid_row(lat: Column) -> Column:
    """Row of the one-degree grid from -90."""
    return F.bround(lat + 90, 0).cast("int")


def grid_column(lon: Column) -> Column:
    """Column of the one-degree grid, around the date line."""
    return F.pmod(F.bround(lon_360(lon), 0).cast("int"), F.lit(360))
