"""Column expressions for local kilometre frames and great-circle geometry."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the data model.
EARTH_KM = 6371.0
KM_PER_DEG = 111.320
M_PER_DEG = 111320.0
QUICK_KM_PER_DEG = 111.0
M2_PER_ACRE = 4046.86


def km_per_lon(lat: Column) -> Column:
    return F.lit(KM_PER_DEG) * F.greatest(F.cos(F.radians(lat)), F.lit(1e-6))


def local_x(lon: Column, lon0: Column, lat0: Column) -> Column:
    return (lon - lon0) * km_per_lon(lat0)


def local_y(lat: Column, lat0: Column) -> Column:
    return (lat - lat0) * F.lit(KM_PER_DEG)


def quick_km(lat_a: Column, lon_a: Column, lat_b: Column, lon_b: Column) -> Column:
    """Flat distance with 111 km per degree, scaled at the first point's latitude."""
    return F.hypot(
        (lat_a - lat_b) * F.lit(QUICK_KM_PER_DEG),
        (lon_a - lon_b) * F.lit(QUICK_KM_PER_DEG) * F.cos(F.radians(lat_a)),
    )


def flat_km(lat: Column, lon: Column, lat0: Column, lon0: Column) -> Column:
    """Flat distance in the 111.32 km frame centred on (lat0, lon0)."""
    return F.hypot(
        (lon - lon0) * F.lit(KM_PER_DEG) * F.cos(F.radians(lat0)),
        (lat - lat0) * F.lit(KM_PER_DEG),
    )


def haversine_km(lat_a: Column, lon_a: Column, lat_b: Column, lon_b: Column) -> Column:
    half_lat = F.sin(F.radians(lat_b - lat_a) / 2)
    half_lon = F.sin(F.radians(lon_b - lon_a) / 2)
    chord = half_lat * half_lat + F.cos(F.radians(lat_a)) * F.cos(F.radians(lat_b)) * half_lon * half_lon
    return F.lit(2 * EARTH_KM) * F.asin(F.least(F.lit(1.0), F.sqrt(chord)))


def bearing_deg(lat_a: Column, lon_a: Column, lat_b: Column, lon_b: Column) -> Column:
    dlon = F.radians(lon_b - lon_a)
    east = F.sin(dlon) * F.cos(F.radians(lat_b))
    north = F.cos(F.radians(lat_a)) * F.sin(F.radians(lat_b)) - F.sin(F.radians(lat_a)) * F.cos(
        F.radians(lat_b)
    ) * F.cos(dlon)
    return wrap_360(F.degrees(F.atan2(east, north)))


def destination(lat: Column, lon: Column, bearing: Column, km: Column) -> tuple[Column, Column]:
    """Point reached from (lat, lon) along a great circle."""
    arc = km / F.lit(EARTH_KM)
    phi, theta = F.radians(lat), F.radians(bearing)
    phi2 = F.asin(F.sin(phi) * F.cos(arc) + F.cos(phi) * F.sin(arc) * F.cos(theta))
    lam2 = F.radians(lon) + F.atan2(
        F.sin(theta) * F.sin(arc) * F.cos(phi), F.cos(arc) - F.sin(phi) * F.sin(phi2)
    )
    return F.degrees(phi2), wrap_180(F.degrees(lam2))


def wrap_360(angle: Column) -> Column:
    return angle - F.lit(360.0) * F.floor(angle / F.lit(360.0))


def wrap_180(angle: Column) -> Column:
    return wrap_360(angle + F.lit(540.0)) - F.lit(180.0)


def wrap_pi(angle: Column) -> Column:
    """Map radians into [-pi, pi)."""
    turn = 2 * math.pi
    return angle + F.lit(math.pi) - F.lit(turn) * F.floor((angle + F.lit(math.pi)) / F.lit(turn)) - F.lit(math.pi)


def truncate(value: Column) -> Column:
    """Integer part toward zero."""
    return value.cast("bigint")


def seconds(ts: Column) -> Column:
    """Epoch seconds with microsecond fraction."""
    return F.unix_micros(ts.cast("timestamp")) / F.lit(1e6)


def clip(value: Column, lo: float, hi: float) -> Column:
    return F.least(F.greatest(value, F.lit(lo)), F.lit(hi))


def segment_distance(px: Column, py: Column, x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    dx, dy = x2 - x1, y2 - y1
    length2 = dx * dx + dy * dy
    along = F.when(length2 == 0, F.lit(0.0)).otherwise(((px - x1) * dx + (py - y1) * dy) / length2)
    u = clip(along, 0.0, 1.0)
    ex, ey = px - (x1 + u * dx), py - (y1 + u * dy)
    return F.sqrt(ex * ex + ey * ey)
