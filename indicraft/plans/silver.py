"""Staging tables to the school spine and its county contexts.

County contexts are aggregated before they meet the spine, so the large side is
never expanded and, for contexts that turn out small, never shuffled.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.cleaning import round_half_up
from ..functions.predicates import null_or_at_least
from ..functions.scoring import low_confidence
from ..operators.aggregates import pivot_measures, share_true
from ..operators.joins import enrich, lookup, period_over_period
from ..operators.windows import latest_per_key

ID, COUNTY = "nces_school_id", "county_fips"

# Health measures that become columns.
HEALTH_MEASURES = {
    "obesity": "obesity_pct",
    "casthma": "asthma_pct",
    "mhlth": "poor_mental_health_pct",
    "access2": "lack_health_insurance_pct",
    "checkup": "annual_checkup_pct",
    "dental": "dental_visit_pct",
    "depression": "depression_pct",
    "disability": "disability_pct",
}

# Disciplines of the shortage areas and the column stems they feed.
DISCIPLINES = {"primary care": "primary_care", "mental health": "mental_health", "dental health": "dental"}


def school_profiles(staged: DataFrame, states: DataFrame, year: str, prior_year: str) -> DataFrame:
    """Schools of one year with state names, lunch share and changes since the prior year."""
    tracked = ["total_enrollment", "math_proficiency_pct", "reading_proficiency_pct", "chronic_absenteeism_pct"]
    names = ["enrollment_change", "math_proficiency_change", "reading_proficiency_change", "absenteeism_change"]
    changed = period_over_period(staged, ID, "school_year", tracked, year, prior_year)
    for source, name in zip(tracked, names):
        changed = changed.withColumnRenamed(f"{source}_change", name)
    eligible = F.coalesce("free_lunch_eligible", F.lit(0)) + F.coalesce("reduced_lunch_eligible", F.lit(0))
    share = F.when(F.col("total_enrollment") > 0, round_half_up(eligible / F.col("total_enrollment") * 100, 1))
    named = lookup(changed, "state_fips", states, "fips_code", "state_name", "state_name", "state_abbr")
    return named.withColumn("frpl_eligible", eligible).withColumn("frpl_pct", share).drop("operational_status")


def census_by_county(staged: DataFrame) -> DataFrame:
    return staged.groupBy(COUNTY).agg(
        F.avg("poverty_rate").alias("poverty_rate"),
        F.avg("child_poverty_rate").alias("child_poverty_rate"),
        F.avg("uninsured_children_rate").alias("uninsured_children_rate"),
        F.avg("median_household_income").alias("median_household_income"),
        F.sum("total_population").alias("county_population"),
    )


def health_context(profiles: DataFrame, census: DataFrame, measures: DataFrame, names: dict[str, str] | None = None) -> DataFrame:
    """County census means and health measures per school; `names` maps measure to column."""
    wide = pivot_measures(measures, [COUNTY], "measure_id", "data_value", names or HEALTH_MEASURES)
    return enrich(profiles.select(ID, COUNTY), [(census_by_county(census), COUNTY), (wide, COUNTY)]).drop(COUNTY)


def latest_air(staged: DataFrame) -> DataFrame:
    bad = F.col("unhealthy_days") + F.col("very_unhealthy_days") + F.col("hazardous_days")
    return latest_per_key(staged, COUNTY, ["data_year"]).select(
        COUNTY,
        "median_aqi",
        "p90_aqi",
        F.col("good_days").alias("aqi_good_days"),
        bad.alias("bad_air_days"),
        "days_with_aqi",
        "dominant_pollutant",
        F.col("data_year").alias("aqi_year"),
    )


def environment(profiles: DataFrame, air: DataFrame, hazards: DataFrame) -> DataFrame:
    risk = hazards.select(
        COUNTY,
        "nri_risk_score",
        "nri_risk_rating",
        "expected_annual_loss",
        "social_vulnerability_score",
        "social_vulnerability_rating",
        "community_resilience_score",
        "heatwave_loss",
        "tornado_loss",
        "wildfire_loss",
    )
    return enrich(profiles.select(ID, COUNTY), [(latest_air(air), COUNTY), (risk, COUNTY)]).drop(COUNTY)


def latest_crime(staged: DataFrame, minimum_coverage: float | None = 40) -> DataFrame:
    """Most recent year per county; years with thin coverage are passed over when a minimum is given."""
    where = None if minimum_coverage is None else null_or_at_least("agency_coverage_pct", minimum_coverage)
    return latest_per_key(staged, COUNTY, ["data_year"], where).select(
        COUNTY,
        "violent_crime_rate",
        "property_crime_rate",
        "violent_crime_count",
        "property_crime_count",
        F.col("agency_coverage_pct").alias("crime_coverage_pct"),
        F.col("data_year").alias("crime_year"),
    )


def safety(profiles: DataFrame, crime: DataFrame, hazards: DataFrame) -> DataFrame:
    svi = hazards.select(COUNTY, "social_vulnerability_score", "social_vulnerability_rating", "community_resilience_score")
    joined = enrich(profiles.select(ID, COUNTY), [(latest_crime(crime), COUNTY), (svi, COUNTY)]).drop(COUNTY)
    return joined.withColumn("low_confidence_crime", low_confidence("violent_crime_rate", "crime_coverage_pct"))


def shortage_by_county(staged: DataFrame) -> DataFrame:
    kind = F.col("discipline_type")
    score = [
        F.max(F.when(kind == d, F.col("hpsa_score"))).alias(f"hpsa_{stem}_score") for d, stem in DISCIPLINES.items()
    ]
    flags = [F.bool_or(kind == d).alias(f"has_{stem}_shortage") for d, stem in DISCIPLINES.items()]
    return staged.groupBy(COUNTY).agg(*score, *flags, F.max("hpsa_score").alias("max_hpsa_score"))


def food_by_county(staged: DataFrame) -> DataFrame:
    desert = F.col("is_food_desert")
    return staged.groupBy(COUNTY).agg(
        share_true(desert).alias("pct_tracts_food_desert"),
        F.sum(F.when(desert, F.col("tract_population")).otherwise(0)).alias("food_desert_population"),
        F.count_if(desert).alias("food_desert_tract_count"),
        F.count(F.lit(1)).alias("county_tract_count"),
    )


def resources(profiles: DataFrame, shortage: DataFrame, food: DataFrame, heavy: float = 30) -> DataFrame:
    """Shortage and food access per school; a county without shortage rows has no shortage."""
    flags = [f"has_{stem}_shortage" for stem in DISCIPLINES.values()]
    joined = enrich(
        profiles.select(ID, COUNTY),
        [(shortage_by_county(shortage).drop("max_hpsa_score"), COUNTY), (food_by_county(food), COUNTY)],
        {f: False for f in flags},
    ).drop(COUNTY)
    heavy_share = F.coalesce("pct_tracts_food_desert", F.lit(0.0)) > heavy
    return joined.withColumn(
        "is_hpsa_designated", F.col("has_primary_care_shortage") | F.col("has_mental_health_shortage")
    ).withColumn("is_food_desert_area", heavy_share)


def school_stats_by_county(profiles: DataFrame, carried: Sequence[Column] = ()) -> DataFrame:
    means: dict[str, Column | str] = {
        "avg_math_proficiency": "math_proficiency_pct",
        "avg_reading_proficiency": "reading_proficiency_pct",
        "avg_chronic_absenteeism": "chronic_absenteeism_pct",
        "avg_student_teacher_ratio": "student_teacher_ratio",
        "avg_frpl_pct": "frpl_pct",
        "avg_math_change": "math_proficiency_change",
        "avg_reading_change": "reading_proficiency_change",
    }
    return profiles.groupBy(COUNTY, "state_abbr", "county_name", "state_name").agg(
        F.count(F.lit(1)).alias("school_count"),
        F.sum("total_enrollment").alias("total_enrollment"),
        F.count_if("is_title_i").alias("title_i_count"),
        *[F.avg(c).alias(name) for name, c in means.items()],
        *carried,
    )


def community_areas(
    profiles: DataFrame,
    census: DataFrame,
    air: DataFrame,
    hazards: DataFrame,
    crime: DataFrame,
    shortage: DataFrame,
    food: DataFrame,
) -> DataFrame:
    """One row per county (and its name columns) with every context attached."""
    income = census_by_county(census).select(
        COUNTY,
        F.col("poverty_rate").alias("avg_poverty_rate"),
        F.col("child_poverty_rate").alias("avg_child_poverty_rate"),
        F.col("uninsured_children_rate").alias("avg_uninsured_rate"),
        F.col("median_household_income").alias("avg_median_income"),
        F.col("county_population").alias("total_population"),
    )
    risk = hazards.select(
        COUNTY, "nri_risk_score", "social_vulnerability_score", "community_resilience_score", "expected_annual_loss"
    )
    no_doctor = ["has_primary_care_shortage", "has_mental_health_shortage"]
    return enrich(
        school_stats_by_county(profiles),
        [
            (income, COUNTY),
            (latest_air(air).select(COUNTY, "median_aqi", "bad_air_days"), COUNTY),
            (risk, COUNTY),
            (latest_crime(crime, None).select(COUNTY, "violent_crime_rate", "property_crime_rate"), COUNTY),
            (shortage_by_county(shortage).select(COUNTY, *no_doctor, "max_hpsa_score"), COUNTY),
            (food_by_county(food).select(COUNTY, F.col("pct_tracts_food_desert").alias("pct_food_desert")), COUNTY),
        ],
        {f: False for f in no_doctor},
    )


def all_contexts(
    profiles: DataFrame,
    census: DataFrame,
    measures: DataFrame,
    air: DataFrame,
    hazards: DataFrame,
    crime: DataFrame,
    shortage: DataFrame,
    food: DataFrame,
    names: dict[str, str] | None = None,
) -> DataFrame:
    """Profiles with the columns of all four context tables in one pass.

    Same values as joining the four tables on the school id, but the county contexts
    attach directly, so the spine is never shuffled against copies of itself.
    """
    wide = pivot_measures(measures, [COUNTY], "measure_id", "data_value", names or HEALTH_MEASURES)
    risk = hazards.select(
        COUNTY, "nri_risk_score", "nri_risk_rating", "expected_annual_loss", "social_vulnerability_score",
        "social_vulnerability_rating", "community_resilience_score", "heatwave_loss", "tornado_loss", "wildfire_loss",
    )
    flags = [f"has_{stem}_shortage" for stem in DISCIPLINES.values()]
    any_crime = latest_crime(crime, None).select(
        COUNTY, F.col("violent_crime_rate").alias("county_violent_rate"), F.col("property_crime_rate").alias("county_property_rate")
    )
    joined = enrich(
        profiles,
        [
            (census_by_county(census), COUNTY),
            (wide, COUNTY),
            (latest_air(air), COUNTY),
            (risk, COUNTY),
            (latest_crime(crime), COUNTY),
            (any_crime, COUNTY),
            (shortage_by_county(shortage), COUNTY),
            (food_by_county(food), COUNTY),
        ],
        {f: False for f in flags},
    )
    return (
        joined.withColumn("low_confidence_crime", low_confidence("violent_crime_rate", "crime_coverage_pct"))
        .withColumn("is_hpsa_designated", F.col("has_primary_care_shortage") | F.col("has_mental_health_shortage"))
        .withColumn("is_food_desert_area", F.coalesce("pct_tracts_food_desert", F.lit(0.0)) > 30)
    )


# County columns of the wide table and their names in the county table.
COUNTY_COLUMNS = {
    "poverty_rate": "avg_poverty_rate",
    "child_poverty_rate": "avg_child_poverty_rate",
    "uninsured_children_rate": "avg_uninsured_rate",
    "median_household_income": "avg_median_income",
    "county_population": "total_population",
    "median_aqi": "median_aqi",
    "bad_air_days": "bad_air_days",
    "nri_risk_score": "nri_risk_score",
    "social_vulnerability_score": "social_vulnerability_score",
    "community_resilience_score": "community_resilience_score",
    "expected_annual_loss": "expected_annual_loss",
    "county_violent_rate": "violent_crime_rate",
    "county_property_rate": "property_crime_rate",
    "has_primary_care_shortage": "has_primary_care_shortage",
    "has_mental_health_shortage": "has_mental_health_shortage",
    "max_hpsa_score": "max_hpsa_score",
    "pct_tracts_food_desert": "pct_food_desert",
}


def community_from_wide(wide: DataFrame) -> DataFrame:
    """`community_areas` from the stored wide table: context columns are constant per county."""
    carried = [F.max(c).alias(name) for c, name in COUNTY_COLUMNS.items()]
    return school_stats_by_county(wide, carried)
