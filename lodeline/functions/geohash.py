"""Geohashes and great-circle distance in built-in expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

BASE32 = "0123456789bcdefghjkmnpqrstuvwxyz"
EARTH_M = 6_371_000.0
SIZE = 12


def encode(lat: Column, lon: Column, size: int = SIZE) -> Column:
    """Cell name of a point: longitude and latitude bits by turns, five to a character."""
    n_lon, n_lat = (5 * size + 1) // 2, 5 * size // 2
    x = F.least(F.floor((lon + 180.0) / 360.0 * float(1 << n_lon)), F.lit((1 << n_lon) - 1)).cast("bigint")
    y = F.least(F.floor((lat + 90.0) / 180.0 * float(1 << n_lat)), F.lit((1 << n_lat) - 1)).cast("bigint")
    chars = []
    for c in range(size):
        index = F.lit(0).cast("bigint")
        for b in range(5 * c, 5 * c + 5):
            value, place = (x, n_lon - 1 - b // 2) if b % 2 == 0 else (y, n_lat - 1 - b // 2)
            index = index * 2 + F.shiftrightunsigned(value, place).bitwiseAND(F.lit(1))
        chars.append(F.substring(F.lit(BASE32), index.cast("int") + 1, F.lit(1)))
    return F.concat(*chars)


def decode(cell: Column, size: int = SIZE) -> Column:
    """struct(lat, lon): the middle of a cell of ``size`` characters."""
    n_lon, n_lat = (5 * size + 1) // 2, 5 * size // 2
    x = y = F.lit(0).cast("bigint")
    for c in range(size):
        index = F.instr(F.lit(BASE32), F.substring(cell, c + 1, 1)) - 1
        for b in range(5):
            bit = F.shiftrightunsigned(index.cast("bigint"), 4 - b).bitwiseAND(F.lit(1))
            if (5 * c + b) % 2 == 0:
                x = x * 2 + bit
            else:
                y = y * 2 + bit
    return F.struct(((y + 0.5) * (180.0 / (1 << n_lat)) - 90.0).alias("lat"), ((x + 0.5) * (360.0 / (1 << n_lon)) - 180.0).alias("lon"))


def distance(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Haversine metres on a sphere."""
    a1, a2 = F.radians(lat1), F.radians(lat2)
    h = F.pow(F.sin((a2 - a1) / 2), 2) + F.cos(a1) * F.cos(a2) * F.pow(F.sin((F.radians(lon2) - F.radians(lon1)) / 2), 2)
    return F.lit(2 * EARTH_M) * F.asin(F.sqrt(F.least(h, F.lit(1.0))))


def box(lat: float, lon: float, radius: float) -> tuple[float, float, float, float]:
    """South, north, west, east of a circle's bounding box (west and east span all longitudes near a pole)."""
    d = math.degrees(radius / EARTH_M)
    south, north = max(-90.0, lat - d), min(90.0, lat + d)
    if south <= -90.0 or north >= 90.0:
        return south, north, -180.0, 180.0
    reach = math.degrees(math.asin(min(1.0, math.sin(radius / EARTH_M) / math.cos(math.radians(lat)))))
    return south, north, lon - reach, lon + reach
