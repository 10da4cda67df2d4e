"""Distances and predicates on longitude/latitude columns: plain expressions that stay in generated code."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Mean earth radius in km, and km of one degree along a meridian.
EARTH_KM = 6371.0088
KM_PER_DEGREE = EARTH_KM * math.pi / 180


def _num(x: Column | float) -> Column:
    return x if isinstance(x, Column) else F.lit(float(x))


def haversine_km(lon1: Column | float, lat1: Column | float, lon2: Column | float, lat2: Column | float) -> Column:
    """Great-circle distance in km."""
    lon1, lat1, lon2, lat2 = map(_num, (lon1, lat1, lon2, lat2))
    s1, s2 = F.sin(F.radians(lat2 - lat1) / 2), F.sin(F.radians(lon2 - lon1) / 2)
    a = s1 * s1 + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * s2 * s2
    return F.lit(2 * EARTH_KM) * F.asin(F.least(F.lit(1.0), F.sqrt(a)))


def degree_weights(lat: float) -> tuple[float, float]:
    """km of one degree of longitude and of latitude at a latitude."""
    return KM_PER_DEGREE * math.cos(math.radians(lat)), KM_PER_DEGREE


def radius_box(lon: float, lat: float, km: float) -> tuple[float, float, float, float] | None:
    """(west, south, east, north) that holds every point within ``km``; None where it would cross the date line or a pole."""
    south, north = lat - km / KM_PER_DEGREE, lat + km / KM_PER_DEGREE
    if south <= -90 or north >= 90:
        return None
    wide = math.degrees(math.asin(min(1.0, math.sin(min(km / EARTH_KM, math.pi / 2)) / math.cos(math.radians(lat)))))
    west, east = lon - wide, lon + wide
    return None if west < -180 or east > 180 else (west, south, east, north)


def within_box(lon: Column, lat: Column, p: tuple[float, float], q: tuple[float, float]) -> Column:
    """Inside the box of any two opposite corners, borders included."""
    return lon.between(min(p[0], q[0]), max(p[0], q[0])) & lat.between(min(p[1], q[1]), max(p[1], q[1]))


def within_radius(lon: Column, lat: Column, center: tuple[float, float], km: float) -> Column:
    """At most ``km`` away, border included. A bounding box comes first, which the file scan can use to skip row groups."""
    if km < 0:
        raise ValueError("the radius cannot be negative")
    exact = haversine_km(lon, lat, *center) <= km
    box = radius_box(*center, km * (1 + 1e-9) + 1e-9)
    return within_box(lon, lat, box[:2], box[2:]) & exact if box else exact
