"""Event-time windows and duplicate suppression with watermarks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def dedup_stream(df: DataFrame, keys: str | Sequence[str], ts: str, delay: str) -> DataFrame:
    """First row per key; a key is remembered until the watermark passes it, so state stays bounded."""
    names = [keys] if isinstance(keys, str) else list(keys)
    return df.withWatermark(ts, delay).dropDuplicatesWithinWatermark(names)


def windowed_counts(df: DataFrame, ts: str, size: str, by: Sequence[str], delay: str, slide: str | None = None) -> DataFrame:
    """Rows per tumbling or sliding window and group; rows later than `delay` are dropped."""
    window = F.window(ts, size, slide) if slide else F.window(ts, size)
    counted = df.withWatermark(ts, delay).groupBy(window.alias("w"), *by).agg(F.count(F.lit(1)).alias("row_count"))
    return counted.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *by, "row_count")


def session_counts(df: DataFrame, ts: str, gap: str, by: Sequence[str], delay: str) -> DataFrame:
    """Activity sessions per group: a session ends after a pause of `gap`."""
    counted = df.withWatermark(ts, delay).groupBy(F.session_window(ts, gap).alias("w"), *by).agg(F.count(F.lit(1)).alias("row_count"))
    return counted.select(F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), *by, "row_count")
