"""Raw tables to typed, padded, filtered staging rows: one narrow projection each, no shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.cleaning import (
    code_label,
    flag_on,
    lenient,
    null_sentinels,
    round_half_up,
    safe_rate,
    tidy_name,
    to_int,
    yes_no,
)
from ..functions.codes import format_code, pad_code, tract_to_county

CENSUS_MISSING = -666666666

# Codes of the school directory.
SCHOOL_TYPES = {1: "Regular", 2: "Special Education", 3: "Vocational", 4: "Alternative"}
OPERATING = {1: "Open", 3: "Open", 2: "Closed", 6: "Temporarily Closed"}


def _upper(c: str) -> Column:
    return F.upper(F.trim(F.col(c)))


def _lower(c: str) -> Column:
    return F.lower(F.trim(F.col(c)))


def _number(c: str) -> Column:
    return lenient(c, "double")


def _non_negative(c: str) -> Column:
    return null_sentinels(to_int(c), negative=True)


def _not_reported(c: str) -> Column:
    return null_sentinels(_number(c), (-1,))


def schools(raw: DataFrame) -> DataFrame:
    """Open schools, one row per school and year."""
    members, staff = to_int("member"), _number("total_staff")
    ratio = F.when((staff > 0) & (members > 0), round_half_up(members / staff, 1))
    status = code_label(to_int("updated_status"), OPERATING, "Unknown")
    return raw.filter(F.col("ncessch").isNotNull() & (status == "Open")).select(
        pad_code("ncessch", 12).alias("nces_school_id"),
        F.col("sch_name").alias("school_name"),
        F.col("lea_name").alias("district_name"),
        pad_code("leaid", 7).alias("district_id"),
        pad_code("fipst", 2).alias("state_fips"),
        _upper("stabr").alias("state_abbr"),
        pad_code("cnty", 5).alias("county_fips"),
        F.trim("coname").alias("county_name"),
        _number("latitude").alias("latitude"),
        _number("longitude").alias("longitude"),
        _non_negative("member").alias("total_enrollment"),
        _non_negative("free_lunch").alias("free_lunch_eligible"),
        _non_negative("reduced_lunch").alias("reduced_lunch_eligible"),
        ratio.alias("student_teacher_ratio"),
        yes_no(to_int("title_i_status")).alias("is_title_i"),
        to_int("sch_type").alias("school_type_code"),
        code_label(to_int("sch_type"), SCHOOL_TYPES, "Other").alias("school_type"),
        status.alias("operational_status"),
        F.coalesce("g_lograde", F.lit("PK")).alias("lowest_grade"),
        F.coalesce("g_higrade", F.lit("12")).alias("highest_grade"),
        "school_year",
        _not_reported("math_proficiency").alias("math_proficiency_pct"),
        _not_reported("reading_proficiency").alias("reading_proficiency_pct"),
        _not_reported("chronic_absenteeism_rate").alias("chronic_absenteeism_pct"),
        "_loaded_at",
    )


def health_measures(raw: DataFrame) -> DataFrame:
    """Long table of tract measures; rows of other geographies have shorter ids."""
    place = F.col("locationid").cast("string")
    return raw.filter((F.length(place) >= 10) & F.col("data_value").isNotNull()).select(
        pad_code("locationid", 11).alias("census_tract_fips"),
        tract_to_county("locationid").alias("county_fips"),
        F.trim("locationname").alias("location_name"),
        _upper("stateabbr").alias("state_abbr"),
        _lower("measureid").alias("measure_id"),
        F.trim("measure").alias("measure_name"),
        _number("data_value").alias("data_value"),
        _number("low_confidence_limit").alias("ci_low"),
        _number("high_confidence_limit").alias("ci_high"),
        to_int("totalpopulation").alias("total_population"),
        F.col("data_value_type").alias("value_type"),
        to_int("year").alias("data_year"),
        F.col("category").alias("measure_category"),
        "_loaded_at",
    )


def census(raw: DataFrame) -> DataFrame:
    """Tract rates; a zero or missing-marker universe gives null."""
    rate = lambda part, whole: safe_rate(F.col(part), F.col(whole), 100, 2, (CENSUS_MISSING,))
    return raw.filter(F.col("state_fips").isNotNull()).select(
        format_code("state_fips", "county_fips", "tract_fips", truncate=True).alias("census_tract_fips"),
        format_code("state_fips", "county_fips", truncate=True).alias("county_fips"),
        pad_code("state_fips", 2).alias("state_fips"),
        rate("below_poverty_level", "total_poverty_universe").alias("poverty_rate"),
        rate("children_below_poverty", "child_poverty_universe").alias("child_poverty_rate"),
        rate("children_uninsured", "child_insurance_universe").alias("uninsured_children_rate"),
        null_sentinels(to_int("median_household_income"), (CENSUS_MISSING,)).alias("median_household_income"),
        null_sentinels(to_int("total_population"), (CENSUS_MISSING, 0)).alias("total_population"),
        to_int("acs_year").alias("acs_year"),
        "_loaded_at",
    )


AIR_DAYS = ("good_days", "moderate_days", "unhealthy_sensitive_days", "unhealthy_days", "very_unhealthy_days", "hazardous_days", "days_with_aqi")


def air_quality(raw: DataFrame) -> DataFrame:
    keep = F.col("state_code").isNotNull() & F.col("county_code").isNotNull() & F.col("median_aqi").isNotNull()
    return raw.filter(keep).select(
        format_code("state_code", "county_code", truncate=True).alias("county_fips"),
        F.trim("county_name").alias("county_name"),
        F.trim("state_abbr").alias("state_abbr"),
        to_int("year").alias("data_year"),
        to_int("median_aqi").alias("median_aqi"),
        to_int("percentile_90_aqi").alias("p90_aqi"),
        to_int("max_aqi").alias("max_aqi"),
        *[to_int(c).alias(c) for c in AIR_DAYS],
        tidy_name("main_pollutant").alias("dominant_pollutant"),
        "_loaded_at",
    )


def crime(raw: DataFrame) -> DataFrame:
    keep = F.col("fips_state").isNotNull() & F.col("fips_county").isNotNull() & F.col("violent_crime_rate").isNotNull()
    coverage = _number("coverage_pct")
    return raw.filter(keep).select(
        format_code("fips_state", "fips_county", truncate=True).alias("county_fips"),
        F.trim("county_name").alias("county_name"),
        _upper("state_abbr").alias("state_abbr"),
        to_int("year").alias("data_year"),
        _number("violent_crime_rate").alias("violent_crime_rate"),
        _number("property_crime_rate").alias("property_crime_rate"),
        *[to_int(c).alias(c) for c in ("violent_crime_count", "property_crime_count", "population")],
        F.when(coverage > 0, coverage).alias("agency_coverage_pct"),
        "_loaded_at",
    )


# Raw hazard columns and their staging names.
HAZARD_NUMBERS = {
    "risk_score": "nri_risk_score",
    "eal_valt": "expected_annual_loss",
    "sovi_score": "social_vulnerability_score",
    "resl_score": "community_resilience_score",
    "hwav_ealv": "heatwave_loss",
    "trnd_ealv": "tornado_loss",
    "rfld_ealv": "riverine_flood_loss",
    "hrcn_ealv": "hurricane_loss",
    "wfir_ealv": "wildfire_loss",
}
HAZARD_RATINGS = {
    "risk_rating": "nri_risk_rating",
    "sovi_ratng": "social_vulnerability_rating",
    "resl_ratng": "community_resilience_rating",
}


def hazards(raw: DataFrame) -> DataFrame:
    code = pad_code("stcofips", 5)
    return raw.filter(F.col("stcofips").isNotNull() & F.col("risk_score").isNotNull()).select(
        code.alias("county_fips"),
        F.substring(code, 1, 2).alias("state_fips"),
        F.trim("county").alias("county_name"),
        F.trim("state").alias("state_name"),
        *[_number(c).alias(name) for c, name in HAZARD_NUMBERS.items()],
        *[F.col(c).alias(name) for c, name in HAZARD_RATINGS.items()],
        to_int("population").alias("population"),
        "_loaded_at",
    )


def shortage_areas(raw: DataFrame) -> DataFrame:
    """Designated areas only."""
    return raw.filter(_lower("hpsa_status") == "designated").select(
        F.col("hpsa_id").cast("string").alias("hpsa_id"),
        F.trim("hpsa_name").alias("hpsa_name"),
        _lower("discipline_type").alias("discipline_type"),
        _lower("hpsa_type").alias("designation_type"),
        to_int("hpsa_score").alias("hpsa_score"),
        _lower("hpsa_status").alias("designation_status"),
        pad_code("state_fips", 2).alias("state_fips"),
        pad_code("county_fips", 5).alias("county_fips"),
        _upper("state_abbr").alias("state_abbr"),
        F.trim("county_name").alias("county_name"),
        null_sentinels(_number("provider_ratio"), (0,)).alias("provider_ratio"),
        lenient("designation_date", "date").alias("designation_date"),
        "_loaded_at",
    )


def food_access(raw: DataFrame) -> DataFrame:
    """A desert is low income and low access within one mile."""
    flag = lambda c: flag_on(to_int(c))
    return raw.filter(F.col("census_tract").isNotNull()).select(
        pad_code("census_tract", 11).alias("census_tract_fips"),
        tract_to_county("census_tract").alias("county_fips"),
        pad_code("state_fips", 2).alias("state_fips"),
        _upper("state_abbr").alias("state_abbr"),
        F.trim("county_name").alias("county_name"),
        flag("low_income_flag").alias("is_low_income"),
        flag("la_flag_1mile").alias("is_low_access_1mi"),
        flag("la_flag_10mile").alias("is_low_access_10mi"),
        flag("la_flag_half_mile").alias("is_low_access_half_mi"),
        (flag("low_income_flag") & flag("la_flag_1mile")).alias("is_food_desert"),
        to_int("population").alias("tract_population"),
        to_int("low_access_pop_1mile").alias("low_access_pop_1mi"),
        to_int("low_access_pop_10mile").alias("low_access_pop_10mi"),
        flag("urban_flag").alias("is_urban"),
        "_loaded_at",
    )


STAGING = {
    "schools": schools,
    "health_measures": health_measures,
    "census": census,
    "air_quality": air_quality,
    "crime": crime,
    "hazards": hazards,
    "shortage_areas": shortage_areas,
    "food_access": food_access,
}
