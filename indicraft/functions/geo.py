"""Distances, coordinate checks and a square lat/lon grid."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from .cleaning import ColumnLike, as_col

EARTH_RADIUS_KM = 6371.0

# Box around the United States and its territories.
US_LAT = (17.0, 72.0)
US_LON = (-180.0, -65.0)


def haversine_km(lat1: ColumnLike, lon1: ColumnLike, lat2: ColumnLike, lon2: ColumnLike) -> Column:
    """Great-circle distance; the root is clipped at 1 so antipodes stay in the domain of asin."""
    p1, p2 = F.radians(as_col(lat1)), F.radians(as_col(lat2))
    half_lat = F.sin((p2 - p1) / 2)
    half_lon = F.sin(F.radians(as_col(lon2) - as_col(lon1)) / 2)
    chord = half_lat * half_lat + F.cos(p1) * F.cos(p2) * half_lon * half_lon
    return F.lit(2 * EARTH_RADIUS_KM) * F.asin(F.least(F.lit(1.0), F.sqrt(chord)))


def is_valid_latlon(lat: ColumnLike, lon: ColumnLike) -> Column:
    """False for missing, non-numeric, (0,0) or out-of-box coordinates; never null."""
    y, x = as_col(lat).try_cast("double"), as_col(lon).try_cast("double")
    inside = y.between(*US_LAT) & x.between(*US_LON) & ~((y == 0) & (x == 0))
    return F.coalesce(inside, F.lit(False))


def cell_size(level: int) -> float:
    """Edge of a level-`level` grid cell in degrees; each level halves the one before."""
    return 180.0 / (2**level)


def grid_index(value: ColumnLike, offset: float, level: int) -> Column:
    return F.floor((as_col(value) + F.lit(offset)) / F.lit(cell_size(level))).cast("bigint")


def grid_key(lat: ColumnLike, lon: ColumnLike, level: int) -> Column:
    """Cell id struct<level, y, x>; null when a coordinate is missing."""
    y, x = grid_index(lat, 90.0, level), grid_index(lon, 180.0, level)
    return F.when(
        y.isNotNull() & x.isNotNull(),
        F.struct(F.lit(level).alias("level"), y.alias("y"), x.alias("x")),
    )


def grid_parent(key: ColumnLike, level: int) -> Column:
    """Enclosing cell at a coarser level, by dropping the low bits."""
    k = as_col(key)
    shift = F.pow(F.lit(2.0), k["level"] - F.lit(level))
    return F.struct(
        F.lit(level).alias("level"),
        F.floor(k["y"] / shift).cast("bigint").alias("y"),
        F.floor(k["x"] / shift).cast("bigint").alias("x"),
    )


def grid_center(key: ColumnLike) -> Column:
    k = as_col(key)
    edge = F.lit(180.0) / F.pow(F.lit(2.0), k["level"])
    return F.struct(
        ((k["y"] + F.lit(0.5)) * edge - 90.0).alias("lat"),
        ((k["x"] + F.lit(0.5)) * edge - 180.0).alias("lon"),
    )


def grid_ring(key: ColumnLike, k: int = 1) -> Column:
    """All (2k+1)² cells around a cell, itself included, as an array."""
    cell = as_col(key)
    span = range(-k, k + 1)
    return F.array(
        *[
            F.struct(
                cell["level"].alias("level"),
                (cell["y"] + F.lit(dy)).alias("y"),
                (cell["x"] + F.lit(dx)).alias("x"),
            )
            for dy in span
            for dx in span
        ]
    )


def level_for_area(target_km2: float, deepest: int = 24) -> int:
    """Grid level whose equatorial cell area is closest to the target."""
    km_per_degree = math.pi * EARTH_RADIUS_KM / 180

    def miss(level: int) -> float:
        return abs((cell_size(level) * km_per_degree) ** 2 - target_km2)

    return min(range(deepest + 1), key=miss)
