"""Distances and projections, as plain column arithmetic."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

RADIUS_KM = 6371.0


def haversine_km(lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    p, q = F.radians(lat1), F.radians(lat2)
    a = F.pow(F.sin((q - p) / 2), 2) + F.cos(p) * F.cos(q) * F.pow(F.sin(F.radians(lng2 - lng1) / 2), 2)
    return F.lit(2 * RADIUS_KM) * F.asin(F.sqrt(F.least(a, F.lit(1.0))))


#: Fixed values of the TWD97 TM2 grid: GRS80 axis and flattening, scale, origin.
AXIS, FLATTENING, SCALE, EASTING, CENTRAL = 6378137.0, 1 / 298.257222101, 0.9999, 250000.0, 121.0


def tm2_to_wgs84(x: Column, y: Column) -> tuple[Column, Column]:
    """Inverse transverse Mercator: (lat, lng) in degrees."""
    e2 = FLATTENING * (2 - FLATTENING)
    ep2 = e2 / (1 - e2)
    e1 = (1 - math.sqrt(1 - e2)) / (1 + math.sqrt(1 - e2))
    mu = y / SCALE / (AXIS * (1 - e2 / 4 - 3 * e2**2 / 64 - 5 * e2**3 / 256))
    foot = mu
    for k, c in ((2, 3 * e1 / 2 - 27 * e1**3 / 32), (4, 21 * e1**2 / 16 - 55 * e1**4 / 32), (6, 151 * e1**3 / 96), (8, 1097 * e1**4 / 512)):
        foot = foot + F.sin(mu * k) * c
    s, c, t = F.sin(foot), F.cos(foot), F.tan(foot)
    c1, t1 = c * c * ep2, t * t
    w = F.lit(1.0) - s * s * e2
    n1, r1 = F.lit(AXIS) / F.sqrt(w), F.lit(AXIS * (1 - e2)) / F.pow(w, F.lit(1.5))
    d = (x - EASTING) / (n1 * SCALE)
    lat = foot - (n1 * t / r1) * (d**2 / 2 - (F.lit(5) + t1 * 3 + c1 * 10 - c1**2 * 4 - 9 * ep2) * d**4 / 24 + (F.lit(61) + t1 * 90 + c1 * 298 + t1**2 * 45 - 252 * ep2 - c1**2 * 3) * d**6 / 720)
    lng = (d - (F.lit(1) + t1 * 2 + c1) * d**3 / 6 + (F.lit(5) - c1 * 2 + t1 * 28 - c1**2 * 3 + 8 * ep2 + t1**2 * 24) * d**5 / 120) / c
    return F.degrees(lat), F.degrees(lng) + CENTRAL


def in_taiwan(lat: Column, lng: Column) -> Column:
    return F.coalesce((lat > 20) & (lat < 27) & (lng > 118) & (lng < 123), F.lit(False))


def resolve_coords(x: Column, y: Column) -> Column:
    """struct(lat, lng, reason) from longitude and latitude in any order, or TM2 metres."""
    lat, lng = tm2_to_wgs84(x, y)
    straight, swapped = in_taiwan(y, x), in_taiwan(x, y)
    metres = x.between(100_000, 400_000) & y.between(2_300_000, 2_900_000)
    make = lambda a, b, why: F.struct(a.cast("double").alias("lat"), b.cast("double").alias("lng"), F.lit(why).alias("reason"))
    none = F.lit(None)
    return F.when(x.isNull() | y.isNull(), make(none, none, "missing")).when(straight, make(y, x, "lonlat")).when(swapped, make(x, y, "swapped")).when(metres, make(lat, lng, "tm2")).otherwise(make(none, none, "out of range"))


def map_radius(n: Column) -> Column:
    return F.least(F.lit(14.0), F.lit(3.0) + F.sqrt(n) * 1.1)
