"""Staging, silver and gold models."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from indicraft.functions.cleaning import round_half_up
from indicraft.plans import gold, silver
from indicraft.plans.medallion import Medallion
from indicraft.plans.staging import STAGING
from indicraft.session import materialize

from . import model_sql as sql
from .base import query, rnd, shared
from .raw import COUNTY_YEARS, MEASURES, PRIOR_YEAR, RAW, YEAR


def raw(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return shared(spark, sf_dir, RAW[name])


_stored: dict[tuple[str, str], Medallion] = {}


def landed(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """All raw frames; the counts by county and year, which air and crime (read twice) rest on, are stored, so the orders are joined once for the three."""
    counts = materialize(shared(spark, sf_dir, COUNTY_YEARS), "county_years")
    counts.createOrReplaceTempView(view := f"county_years_{uuid.uuid4().hex}")
    try:
        return {k: shared(spark, sf_dir, text.replace(f"({COUNTY_YEARS})", view)) for k, text in RAW.items()}
    finally:
        spark.catalog.dropTempView(view)


def medallion(spark: SparkSession, sf_dir: str) -> Medallion:
    """One set of stored tables per session and data folder."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _stored:
        _stored[key] = Medallion(landed(spark, sf_dir), YEAR, PRIOR_YEAR, MEASURES)
    return _stored[key]


def staged(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return STAGING[name](raw(spark, sf_dir, name))


def _register_staging(name: str) -> None:
    @query(f"staging_{name}", sql.STG[name])
    def run(spark, d):
        return staged(spark, d, name)


for _name in STAGING:
    _register_staging(_name)


def _profiles(spark, d):
    return silver.school_profiles(staged(spark, d, "schools"), raw(spark, d, "states"), YEAR, PRIOR_YEAR)


def _round_all(df: DataFrame, digits: int = 4) -> DataFrame:
    """Round doubles so that engine-specific summation order does not show."""
    return df.select(*[round_half_up(f.name, digits).alias(f.name) if f.dataType.typeName() == "double" else F.col(f.name) for f in df.schema.fields])


def rounded_sql(body: str, cols: str, digits: int = 4) -> str:
    """`body` with the named double columns rounded."""
    return f"select * replace ({', '.join(f'{rnd(c, digits)} as {c}' for c in cols.split())}) from ({body}) q"


PROFILE_DOUBLES = (
    "latitude longitude student_teacher_ratio math_proficiency_pct reading_proficiency_pct chronic_absenteeism_pct "
    "math_proficiency_change reading_proficiency_change absenteeism_change frpl_pct"
)


@query("silver_school_profiles", sql.silver(rounded_sql("select * from profiles", PROFILE_DOUBLES)))
def school_profiles(spark, d):
    return _round_all(_profiles(spark, d))


HEALTH_DOUBLES = "poverty_rate child_poverty_rate uninsured_children_rate median_household_income " + " ".join(MEASURES.values())


@query("silver_health_context", sql.silver(rounded_sql("select * replace (cast(county_population as bigint) as county_population) from health", HEALTH_DOUBLES)))
def health_context(spark, d):
    return _round_all(silver.health_context(_profiles(spark, d), staged(spark, d, "census"), staged(spark, d, "health_measures"), MEASURES))


@query("silver_environment", sql.silver("select * from environment"))
def environment(spark, d):
    return silver.environment(_profiles(spark, d), staged(spark, d, "air_quality"), staged(spark, d, "hazards"))


@query("silver_safety", sql.silver("select * from safety"))
def safety(spark, d):
    return silver.safety(_profiles(spark, d), staged(spark, d, "crime"), staged(spark, d, "hazards"))


@query("silver_resources", sql.silver("select * replace (cast(food_desert_population as bigint) as food_desert_population) from resources"))
def resources(spark, d):
    return silver.resources(_profiles(spark, d), staged(spark, d, "shortage_areas"), staged(spark, d, "food_access"))


COMMUNITY_DOUBLES = (
    "avg_math_proficiency avg_reading_proficiency avg_chronic_absenteeism avg_student_teacher_ratio avg_frpl_pct avg_math_change "
    "avg_reading_change avg_poverty_rate avg_child_poverty_rate avg_uninsured_rate avg_median_income"
)
COMMUNITY_INTS = "replace (cast(total_enrollment as bigint) as total_enrollment, cast(total_population as bigint) as total_population)"


@query("silver_community_areas", sql.silver(rounded_sql(f"select * {COMMUNITY_INTS} from community", COMMUNITY_DOUBLES)))
def community_areas(spark, d):
    s = lambda n: staged(spark, d, n)
    return _round_all(
        silver.community_areas(
            _profiles(spark, d), s("census"), s("air_quality"), s("hazards"), s("crime"), s("shortage_areas"), s("food_access")
        )
    )


@query("gold_wellbeing_scores", sql.gold("select * from scores"))
def wellbeing_scores(spark, d):
    return medallion(spark, d).scores


RANK_DOUBLES = "national_percentile state_percentile"


@query("gold_school_rankings", sql.gold(rounded_sql("select * from rankings", RANK_DOUBLES, 6)))
def school_rankings(spark, d):
    out = medallion(spark, d).rankings
    return out.withColumns({c: round_half_up(c, 6) for c in RANK_DOUBLES.split()})


@query("gold_resource_gaps", sql.gold("select * from gaps"))
def resource_gaps(spark, d):
    return medallion(spark, d).gaps


@query("gold_resource_gaps_severity", sql.gold(sql.gaps_sql("severity")))
def resource_gaps_severity(spark, d):
    return gold.resource_gaps(medallion(spark, d).scores, policy="severity")


TREND_DOUBLES = "math_proficiency_change reading_proficiency_change absenteeism_change combined_education_change"


@query("gold_trend_metrics", sql.gold(rounded_sql("select * from trends", TREND_DOUBLES)))
def trend_metrics(spark, d):
    out = medallion(spark, d).trends
    return out.withColumns({c: round_half_up(c, 4) for c in TREND_DOUBLES.split()})


SUMMARY_DOUBLES = COMMUNITY_DOUBLES.replace("avg_student_teacher_ratio ", "") + " avg_gap_count"


@query("gold_county_summary", sql.gold(rounded_sql(f"select * {COMMUNITY_INTS} from summary", SUMMARY_DOUBLES)))
def county_summary(spark, d):
    return _round_all(medallion(spark, d).counties)


@query("check_scores_in_range", sql.gold("select nces_school_id, wellbeing_score, education_score, health_score, environment_score, safety_score from scores where wellbeing_score not between 0 and 100 or education_score not between 0 and 100 or health_score not between 0 and 100 or environment_score not between 0 and 100 or safety_score not between 0 and 100"))
def scores_in_range(spark, d):
    return gold.out_of_range(medallion(spark, d).scores)


@query("check_scores_without_location", sql.gold("select nces_school_id, school_name, state_abbr from scores where latitude is null or longitude is null"))
def scores_without_location(spark, d):
    return gold.without_location(medallion(spark, d).scores)
