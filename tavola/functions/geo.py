"""Distances, their scores and grid cells."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_RADIUS_M = 6_371_000.0


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Metres along the great circle."""
    half_lat, half_lon = F.radians(lat2 - lat1) / 2, F.radians(lon2 - lon1) / 2
    a = F.sin(half_lat) * F.sin(half_lat) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.sin(half_lon) * F.sin(half_lon)
    return EARTH_RADIUS_M * 2 * F.atan2(F.sqrt(a), F.sqrt(1 - a))


def geo_score(lat1: Column, lon1: Column, lat2: Column, lon2: Column, decay: float = 0.00035) -> Column:
    """exp(-decay * metres); 0 if a coordinate is missing."""
    missing = lat1.isNull() | lon1.isNull() | lat2.isNull() | lon2.isNull()
    return F.when(missing, F.lit(0.0)).otherwise(F.exp(-decay * haversine(lat1, lon1, lat2, lon2)))


def cell(coordinate: Column, size: float = 0.05) -> Column:
    """Number of a grid cell; halves go to the even one."""
    return F.rint(coordinate / size).cast("int")


def grid_key(lat: Column, lon: Column, size: float = 0.05) -> Column:
    """``lat_lon`` of a cell's centre with two decimals, or ``no_coords``."""
    text = F.format_string("%.2f_%.2f", F.rint(lat / size) * size, F.rint(lon / size) * size)
    return F.when(lat.isNull() | lon.isNull(), F.lit("no_coords")).otherwise(text)


def point(coordinates: Column) -> Column:
    """(lat, lon) of a [lon, lat] array; nulls if it is short or has null parts."""
    lon, lat = F.try_element_at(coordinates, F.lit(1)), F.try_element_at(coordinates, F.lit(2))
    ok = lon.isNotNull() & lat.isNotNull()
    return F.struct(F.when(ok, lat).alias("lat"), F.when(ok, lon).alias("lon"))
