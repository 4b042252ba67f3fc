"""Column functions on coordinates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH = 6371000.0


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance in metres."""
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return F.lit(2 * EARTH) * F.atan2(F.sqrt(a), F.sqrt(1 - a))


def project(lat: Column, lon: Column, lat0: float = 40.75, lon0: float = -111.90) -> tuple[Column, Column]:
    """Metres east and north of a centre."""
    return F.radians(lon - lon0) * EARTH * F.cos(F.radians(F.lit(lat0))), F.radians(lat - lat0) * EARTH


def point_segment(px: Column, py: Column, ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    """Distance of a point from a segment."""
    dx, dy = bx - ax, by - ay
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((px - ax) * dx + (py - ay) * dy) / F.greatest(dx * dx + dy * dy, F.lit(1e-9))))
    return F.hypot(px - (ax + t * dx), py - (ay + t * dy))


def unit(dx: Column, dy: Column) -> tuple[Column, Column]:
    """Unit direction; null for no length."""
    n = F.nullif(F.hypot(dx, dy), F.lit(0.0))
    return dx / n, dy / n
