"""Great-circle distance and the cubic grid used to find neighbours on the globe."""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F

EARTH_RADIUS_M = 6_371_000.0


def haversine_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance in metres between two points given in degrees."""
    half_dlat = F.sin(F.radians(lat2 - lat1) / 2)
    half_dlon = F.sin(F.radians(lon2 - lon1) / 2)
    a = half_dlat * half_dlat + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * half_dlon * half_dlon
    return F.lit(2 * EARTH_RADIUS_M) * F.atan2(F.sqrt(a), F.sqrt(F.lit(1.0) - a))


def chord_m(arc_m: float) -> float:
    """Straight-line length of an arc; grows with the arc, so thresholds carry over."""
    return 2 * EARTH_RADIUS_M * math.sin(arc_m / (2 * EARTH_RADIUS_M))


def cartesian(lat: Column, lon: Column) -> tuple[Column, Column, Column]:
    """Point on the sphere in metres. Unlike degrees it has no poles and no date line."""
    phi, lam = F.radians(lat), F.radians(lon)
    return (
        F.lit(EARTH_RADIUS_M) * F.cos(phi) * F.cos(lam),
        F.lit(EARTH_RADIUS_M) * F.cos(phi) * F.sin(lam),
        F.lit(EARTH_RADIUS_M) * F.sin(phi),
    )
