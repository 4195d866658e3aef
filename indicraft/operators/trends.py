"""Year-over-year directions and unusual changes."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.cleaning import round_half_up
from ..functions.scoring import direction
from ..session import attach_stats


def change_zscore(df: DataFrame, col: str, out: str, flag: str, z: float = 2.5) -> DataFrame:
    """Z-score of a change against all rows (sample deviation) and a flag beyond ±z.

    Mean and deviation come from a one-row aggregate instead of a window over the
    whole table. Without spread every score is 0 and nothing is flagged.
    """
    stats = df.agg(F.avg(col).alias("mean"), F.stddev(col).alias("sd"))
    raw = (F.col(col) - F.col("_s.mean")) / F.nullif(F.col("_s.sd"), F.lit(0.0))
    usable = F.col("_s.sd") > 0
    return (
        attach_stats(df, stats, "_s")
        .withColumn(out, F.when(usable, round_half_up(raw, 2)).otherwise(F.lit(0.0)))
        .withColumn(flag, F.coalesce(usable & (F.abs(raw) > z), F.lit(False)))
        .drop("_s")
    )


def trend_table(
    df: DataFrame,
    trends: Mapping[str, tuple[str, bool]],
    combined: Sequence[str],
    combined_trend: str = "education_trend",
    combined_change: str = "combined_education_change",
    zscore: str = "education_change_zscore",
    flag: str = "is_anomalous",
    threshold: float = 2,
    z: float = 2.5,
) -> DataFrame:
    """Directions per change column, the combined direction and its z-score.

    `trends` maps output name to (change column, falling is good). The combined
    change counts missing parts as zero and uses twice the single threshold.
    """
    total = F.lit(0.0)
    for c in combined:
        total = total + F.coalesce(F.col(c).cast("double"), F.lit(0.0))
    out = df.select(
        "*",
        *[direction(c, threshold, invert).alias(name) for name, (c, invert) in trends.items()],
        round_half_up(total, 6).alias(combined_change),
    ).withColumn(combined_trend, direction(combined_change, threshold * len(combined)))
    return change_zscore(out, combined_change, zscore, flag, z)
