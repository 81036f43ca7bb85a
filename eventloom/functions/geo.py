"""Geospatial Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_KM = 6371.0


def haversine_km(lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lng2 - lng1) / 2), 2)
    return F.lit(2 * EARTH_KM) * F.asin(F.sqrt(F.least(a, F.lit(1.0))))


def in_box(lat: Column, lng: Column, south: float, west: float, north: float, east: float) -> Column:
    """Inclusive; a box does not cross the antimeridian."""
    return lat.between(south, north) & lng.between(west, east)


def cell(x: Column, size: float = 0.1) -> Column:
    return F.floor(x / size)


def coordinates(*columns: str) -> Column:
    """struct<lat,lng> from JSON columns in turn: location.{lat,lng}, location.{latitude,longitude}, then the same at the top.
    A pair out of range falls through to the next."""
    shapes = [("location.lat", "location.lng"), ("location.latitude", "location.longitude"), ("lat", "lng"), ("latitude", "longitude")]
    found = []
    for c in columns:
        for a, b in shapes:
            lat, lng = (F.get_json_object(F.col(c), f"$.{p}").try_cast("double") for p in (a, b))
            found.append(F.when(lat.between(-90, 90) & lng.between(-180, 180), F.struct(lat.alias("lat"), lng.alias("lng"))))
    return F.coalesce(*found)
