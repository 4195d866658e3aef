"""Points near a given position, centres of groups; `nearest` joins whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.geo import haversine_km
from .nearest import nearest

__all__ = ["group_centroid", "nearest", "nearest_by_grid_distance", "nearest_to_point"]


def nearest_to_point(points: DataFrame, lat: float, lon: float, key: str, k: int = 1, lat_col: str = "latitude", lon_col: str = "longitude") -> DataFrame:
    """The k points closest to one position, as a distributed top-k."""
    d = haversine_km(F.lit(float(lat)), F.lit(float(lon)), lat_col, lon_col)
    located = points.filter(F.col(lat_col).isNotNull() & F.col(lon_col).isNotNull())
    return located.withColumn("distance_km", d).orderBy("distance_km", key).limit(k)


def nearest_by_grid_distance(points: DataFrame, lat: float, lon: float, key: str, lat_col: str = "latitude", lon_col: str = "longitude") -> DataFrame:
    """The single point with the smallest |Δlat| + |Δlon|, as a map click resolves it."""
    d = F.abs(F.col(lat_col) - F.lit(float(lat))) + F.abs(F.col(lon_col) - F.lit(float(lon)))
    return points.filter(d.isNotNull()).withColumn("grid_distance", d).orderBy("grid_distance", key).limit(1)


def group_centroid(df: DataFrame, by: str, lat: str = "latitude", lon: str = "longitude") -> DataFrame:
    return df.groupBy(by).agg(F.avg(lat).alias("centroid_lat"), F.avg(lon).alias("centroid_lon"))
