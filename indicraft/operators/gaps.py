"""Resource gaps: pillars in the bottom national quartile."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.cleaning import round_half_up
from ..functions.scoring import argmin_label, count_true, spread
from ..session import attach_stats
from .bounds import percentile_bounds, quantile_name


def priority(gaps: Column, strengths: Column, width: Column, policy: str) -> Column:
    """Intervention label.

    `sql`: any gap next to a strength is High, two gaps without one Critical, one gap Moderate.
    `severity`: three gaps Critical, two gaps or a spread above 30 High, otherwise Moderate.
    """
    if policy == "severity":
        out = F.when(gaps >= 3, "Critical Need").when((gaps >= 2) | (width > 30), "High Priority")
    else:
        out = F.when((gaps >= 1) & (strengths >= 1), "High Priority").when(gaps >= 2, "Critical Need")
    return out.when(gaps >= 1, "Moderate Need").otherwise("No Gaps Identified")


def gap_table(
    df: DataFrame,
    pillars: Mapping[str, str],
    policy: str = "sql",
    only_gaps: bool = True,
) -> DataFrame:
    """Gap flags, counts, weakest pillar, spread and priority; `pillars` maps label to column.

    Quartiles come from all rows of `df`. Output is not ordered; use `serving.page`
    or an explicit orderBy for display.
    """
    cols = list(pillars.values())
    with_q = attach_stats(df, percentile_bounds(df, cols, (0.25, 0.5)), "_q")
    low = {c: F.col(c) < F.col(f"_q.{quantile_name(c, 0.25)}") for c in cols}
    strong = [F.col(c) >= F.col(f"_q.{quantile_name(c, 0.5)}") for c in cols]
    flagged = with_q.select(
        *df.columns,
        *[low[c].alias(f"has_{label.lower()}_gap") for label, c in pillars.items()],
        count_true(*low.values()).alias("gap_count"),
        count_true(*strong).alias("pillars_above_median"),
        argmin_label(pillars, null_as=999).alias("weakest_pillar"),
        spread(cols).alias("_width"),
    )
    out = flagged.withColumn("pillar_spread", round_half_up("_width", 1)).withColumn(
        "intervention_priority",
        priority(F.col("gap_count"), F.col("pillars_above_median"), F.col("_width"), policy),
    )
    return (out.filter(F.col("gap_count") >= 1) if only_gaps else out).drop("_width")
