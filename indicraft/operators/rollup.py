"""Area roll-ups: county summary over scored entities, area context and gaps."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.cleaning import round_half_up
from ..functions.scoring import score_category
from .joins import enrich
from .ranking import percent, rank_levels


def score_summary(
    scores: DataFrame,
    area: str,
    score: str,
    category: str,
    pillars: Sequence[str],
    count_name: str = "scored_school_count",
) -> DataFrame:
    """Per area: count, mean, extremes and deviation of the score, pillar means, category counts."""
    counts = {
        "Thriving": "thriving_count",
        "Moderate": "moderate_count",
        "At Risk": "at_risk_count",
        "Critical": "critical_count",
    }
    moments = {"avg": F.avg, "min": F.min, "max": F.max, "stddev": F.stddev}
    return scores.groupBy(area).agg(
        F.count(F.lit(1)).alias(count_name),
        *[round_half_up(fn(score), 2).alias(f"{name}_{score}") for name, fn in moments.items()],
        *[round_half_up(F.avg(p), 2).alias(f"avg_{p}") for p in pillars],
        *[F.count_if(F.col(category) == label).alias(name) for label, name in counts.items()],
    )


def county_summary(
    scores: DataFrame,
    community: DataFrame,
    gaps: DataFrame,
    area: str = "county_fips",
    state: str = "state_abbr",
    score: str = "wellbeing_score",
    category: str = "wellbeing_category",
    pillars: Sequence[str] = ("education_score", "health_score", "environment_score", "safety_score"),
) -> DataFrame:
    """Areas that have scored entities, with context, gap counts and ranks."""
    gap_counts = gaps.groupBy(area).agg(
        F.count(F.lit(1)).alias("schools_with_gaps"), F.avg("gap_count").alias("avg_gap_count")
    )
    joined = community.join(score_summary(scores, area, score, category, pillars), area, "inner")
    mean = f"avg_{score}"
    full = enrich(joined, [(gap_counts, area)], {"schools_with_gaps": 0, "avg_gap_count": 0.0}).withColumn(
        "county_category", score_category(mean)
    )
    ranked = rank_levels(full, mean, {"national": [], "state": [state]}, percentiles=["national"])
    return (
        ranked.withColumn("national_percentile", percent("national_percentile"))
        .withColumnRenamed("national_total", "total_counties")
        .drop("state_total")
    )
