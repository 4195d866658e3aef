"""Gold tables: scores, rankings, gaps, trends and the county summary."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.gaps import gap_table
from ..operators.joins import enrich
from ..operators.ranking import percent, rank_columns, rank_levels
from ..operators.rollup import county_summary as summarize
from ..operators.scoring import Metric, ScoreSpec, score_table
from ..operators.trends import trend_table

ID = "nces_school_id"
PILLARS = {
    "Education": "education_score",
    "Health": "health_score",
    "Environment": "environment_score",
    "Safety": "safety_score",
}

# Sub-scores, pillar weights and composite weights of the index.
# The underserved-area score uses the primary-care shortage flag, and the clinic
# score subtracts four points per shortage point: no better source is landed.
INDEX = ScoreSpec(
    metrics=(
        Metric("math_proficiency_score", "math_proficiency_pct"),
        Metric("reading_proficiency_score", "reading_proficiency_pct"),
        Metric("chronic_absenteeism_score", "chronic_absenteeism_pct", invert=True),
        Metric("student_teacher_ratio_score", "student_teacher_ratio", invert=True),
        Metric("title_i_score", "is_title_i", "penalty"),
        Metric("child_poverty_score", "child_poverty_rate", invert=True),
        Metric("uninsured_children_score", "uninsured_children_rate", invert=True),
        Metric("hpsa_score", "is_hpsa_designated", "penalty"),
        Metric("food_desert_score", "pct_tracts_food_desert", invert=True),
        Metric("mua_score", "has_primary_care_shortage", "penalty"),
        Metric("clinic_distance_score", "hpsa_primary_care_score", "linear", slope=4),
        Metric("aqi_score", "median_aqi", invert=True),
        Metric("fema_hazard_score", "expected_annual_loss", invert=True),
        Metric("cdc_env_health_score", "asthma_pct", "linear"),
        Metric("violent_crime_score", "violent_crime_rate", invert=True),
        Metric("social_vulnerability_inv_score", "social_vulnerability_score", invert=True),
        Metric("property_crime_score", "property_crime_rate", invert=True),
    ),
    pillars={
        "education_score": [
            ("math_proficiency_score", 0.30),
            ("reading_proficiency_score", 0.30),
            ("chronic_absenteeism_score", 0.20),
            ("student_teacher_ratio_score", 0.10),
            ("title_i_score", 0.10),
        ],
        "health_score": [
            ("child_poverty_score", 0.25),
            ("uninsured_children_score", 0.20),
            ("hpsa_score", 0.20),
            ("food_desert_score", 0.15),
            ("mua_score", 0.10),
            ("clinic_distance_score", 0.10),
        ],
        "environment_score": [
            ("aqi_score", 0.40),
            ("fema_hazard_score", 0.30),
            ("cdc_env_health_score", 0.30),
        ],
        "safety_score": [
            ("violent_crime_score", 0.50),
            ("social_vulnerability_inv_score", 0.30),
            ("property_crime_score", 0.20),
        ],
    },
    weights={"education_score": 0.30, "health_score": 0.30, "environment_score": 0.20, "safety_score": 0.20},
    composite="wellbeing_score",
    categories={
        "wellbeing_score": "wellbeing_category",
        "education_score": "education_category",
        "health_score": "health_category",
        "environment_score": "environment_category",
        "safety_score": "safety_category",
    },
)

DESCRIPTIVE = ("school_name", "state_abbr", "county_fips", "county_name", "latitude", "longitude", "total_enrollment", "school_type")
DRILLDOWN = (
    "math_proficiency_score",
    "reading_proficiency_score",
    "chronic_absenteeism_score",
    "child_poverty_score",
    "uninsured_children_score",
    "aqi_score",
    "violent_crime_score",
)


def wellbeing_scores(inputs: DataFrame, scored_at=None) -> DataFrame:
    """One row per scored school. `inputs` is read several times: pass a stored frame at scale."""
    out = score_table(inputs, INDEX)
    cols = [ID, *DESCRIPTIVE, *PILLARS.values(), "wellbeing_score", *INDEX.categories.values(), *DRILLDOWN, "pillars_with_data"]
    return out.select(*cols, *([scored_at.alias("scored_at")] if scored_at is not None else []))


def school_rankings(scores: DataFrame) -> DataFrame:
    """National, state and county rank, totals, percentiles and national pillar ranks."""
    base = scores.select(
        ID, "school_name", "state_abbr", "county_fips", "county_name", "total_enrollment", "school_type",
        "wellbeing_score", "wellbeing_category", *PILLARS.values(), "pillars_with_data",
    )
    ranked = rank_levels(
        base,
        "wellbeing_score",
        {"national": [], "state": ["state_abbr"], "county": ["county_fips"]},
        percentiles=["national", "state"],
    )
    ranked = rank_columns(ranked, {c: f"{label.lower()}_national_rank" for label, c in PILLARS.items()})
    return ranked.withColumn("national_percentile_pct", percent("national_percentile")).withColumn(
        "state_percentile_pct", percent("state_percentile")
    )


def resource_gaps(scores: DataFrame, policy: str = "sql") -> DataFrame:
    base = scores.select(
        ID, "school_name", "state_abbr", "county_fips", "county_name", "total_enrollment", "wellbeing_score",
        "wellbeing_category", *PILLARS.values(),
    )
    return gap_table(base, PILLARS, policy)


def trend_metrics(scores: DataFrame, profiles: DataFrame) -> DataFrame:
    changes = ["math_proficiency_change", "reading_proficiency_change", "absenteeism_change", "enrollment_change"]
    base = scores.select(
        ID, "school_name", "state_abbr", "county_fips", "county_name", "wellbeing_score", *PILLARS.values(), "wellbeing_category"
    )
    return trend_table(
        enrich(base, [(profiles.select(ID, *changes), ID)]),
        {
            "math_trend": ("math_proficiency_change", False),
            "reading_trend": ("reading_proficiency_change", False),
            "absenteeism_trend": ("absenteeism_change", True),
        },
        ["math_proficiency_change", "reading_proficiency_change"],
    )


def county_summary(scores: DataFrame, community: DataFrame, gaps: DataFrame) -> DataFrame:
    cols = [c for c in community.columns if c not in ("title_i_count", "avg_student_teacher_ratio")]
    return summarize(scores, community.select(*cols).withColumnRenamed("school_count", "total_school_count"), gaps)


def out_of_range(scores: DataFrame) -> DataFrame:
    """Scored rows with any score outside 0-100; empty when all is well."""
    cols = ["wellbeing_score", *PILLARS.values()]
    bad = F.lit(False)
    for c in cols:
        bad = bad | F.coalesce((F.col(c) < 0) | (F.col(c) > 100), F.lit(False))
    return scores.filter(bad).select(ID, *cols)


def without_location(scores: DataFrame) -> DataFrame:
    return scores.filter(F.col("latitude").isNull() | F.col("longitude").isNull()).select(ID, "school_name", "state_abbr")
