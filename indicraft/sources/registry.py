"""The twelve raw sources: header aliases, value rules and contracts."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.cleaning import (
    cap,
    code_label,
    lenient,
    null_sentinels,
    positive_rate,
    round_half_up,
    sum_present,
    within,
)
from ..functions.codes import pad_code, whole_number_code
from ..functions.predicates import lacks_text
from ..operators.windows import dedup_first
from .contracts import CONTRACTS, validate
from .readers import read_csv, read_csv_any_encoding, read_geojson_alerts, read_header_row_json, read_json_records

CENSUS_MISSING = -666666666
UNDERSERVED_MAX = 62.0
DESCRIPTION_CHARS = 2000


def upper_header(name: str) -> str:
    return name.strip().upper()


def snake_header(name: str) -> str:
    return name.strip().lower().replace(" ", "_").replace("-", "_").replace(".", "")


def rename_by_alias(df: DataFrame, aliases: Mapping[str, str], rule: Callable[[str], str] = upper_header, only_known: bool = False) -> DataFrame:
    """Rename by a header alias map after normalising the header; the first alias present wins.

    One projection, no data movement. `only_known` drops columns without an alias.
    """
    taken: dict[str, Column] = {}
    for c in df.columns:
        header = rule(c)
        name = aliases.get(header, None if only_known else header)
        if name is not None and name not in taken:
            taken[name] = F.col(f"`{c}`").alias(name)
    return df.select(*taken.values())


@dataclass(frozen=True)
class SourceSpec:
    """How one raw source becomes clean rows.

    Rules apply to the columns that are present, in this order: rename, pad codes, cast,
    null negatives / sentinels, trim, then `derive`.
    """

    name: str
    aliases: Mapping[str, str]
    header: Callable[[str], str] = snake_header
    only_known: bool = False
    codes: Mapping[str, int] = field(default_factory=dict)
    longs: Sequence[str] = ()
    ints: Sequence[str] = ()
    doubles: Sequence[str] = ()
    negative_is_null: Sequence[str] = ()
    sentinels: Sequence[float] = ()
    trimmed: Sequence[str] = ()
    derive: Callable[[DataFrame], DataFrame] | None = None
    #: How the files are read: csv, header_row, records, env_health or alerts.
    kind: str = "csv"


def clean_source(df: DataFrame, spec: SourceSpec) -> DataFrame:
    out = rename_by_alias(df, spec.aliases, spec.header, spec.only_known)
    casts = {**{c: "bigint" for c in spec.longs}, **{c: "int" for c in spec.ints}, **{c: "double" for c in spec.doubles}}
    cols = []
    for c in out.columns:
        value = F.col(f"`{c}`")
        if c in spec.codes:
            value = pad_code(value, spec.codes[c], truncate=False)
        if c in casts:
            value = lenient(value, casts[c])
            if spec.sentinels:
                value = null_sentinels(value, spec.sentinels)
        if c in spec.negative_is_null:
            value = null_sentinels(value, negative=True)
        if c in spec.trimmed:
            value = F.trim(value)
        cols.append(value.alias(c))
    out = out.select(*cols)
    return spec.derive(out) if spec.derive else out


def _has(df: DataFrame, *cols: str) -> bool:
    return set(cols) <= set(df.columns)


def _directory(df: DataFrame) -> DataFrame:
    return df.filter(F.col("school_type").isin(1, 2, 3, 4)) if _has(df, "school_type") else df


def _locations(df: DataFrame) -> DataFrame:
    lon = F.col("longitude")
    return df.withColumn("latitude", within("latitude", 17.0, 72.0)).withColumn("longitude", F.when(lon <= -65.0, lon))


def _census(df: DataFrame) -> DataFrame:
    df = df.withColumn("full_fips", F.concat("state_fips", "county_fips", "tract_fips"))
    share = lambda a, b: round_half_up(a / F.nullif(b, F.lit(0.0)) * 100, 2)
    if _has(df, "poverty_below_total", "poverty_universe"):
        df = df.withColumn("poverty_rate", share(F.col("poverty_below_total"), F.col("poverty_universe")))
    uninsured = [c for c in df.columns if c.startswith("uninsured_")]
    if uninsured:
        df = df.withColumn("uninsured_children", sum_present(*uninsured).cast("bigint"))
    higher = [c for c in ("edu_bachelors", "edu_masters", "edu_professional", "edu_doctorate") if c in df.columns]
    if higher and _has(df, "edu_universe"):
        df = df.withColumn("pct_bachelors_plus", share(sum_present(*higher), F.col("edu_universe")))
    for c in ("median_hh_income", "total_population"):
        if c in df.columns:
            df = df.withColumn(c, F.col(c).cast("bigint"))
    return df


def _air(df: DataFrame) -> DataFrame:
    return df.withColumn("county_fips", F.concat("state_code", "county_code"))


def _not_withdrawn(df: DataFrame, status: str) -> DataFrame:
    return df.filter(lacks_text(status, "withdrawn")) if _has(df, status) else df


# Discipline codes of the shortage files.
DISCIPLINES = {"PC": "Primary Care", "DH": "Dental Health", "MH": "Mental Health"}


def _shortage(df: DataFrame) -> DataFrame:
    df = _not_withdrawn(df, "hpsa_status")
    if _has(df, "state_fips", "county_fips_3"):
        df = df.withColumn("county_fips", F.concat("state_fips", "county_fips_3"))
    if _has(df, "discipline_code"):
        label = code_label("discipline_code", DISCIPLINES)
        df = df.withColumn("discipline", F.coalesce(label, F.col("discipline_code")))
    if _has(df, "hpsa_score"):
        df = df.withColumn("hpsa_score", F.round("hpsa_score", 0).cast("int"))
    return df


def _underserved(df: DataFrame) -> DataFrame:
    df = _not_withdrawn(df, "status")
    if _has(df, "state_fips", "county_fips_3"):
        df = df.withColumn("county_fips", F.concat("state_fips", "county_fips_3"))
    if _has(df, "imu_score"):
        score = F.col("imu_score")
        df = df.withColumn("medically_underserved", score.isNull() | (score <= UNDERSERVED_MAX))
    if "designation_type" not in df.columns and _has(df, "mua_name"):
        df = df.withColumn("designation_type", F.when(F.col("mua_name").contains("MUP"), "MUP").otherwise("MUA"))
    return df


FOOD_FLAGS = ("low_access_1", "low_access_half", "low_income", "lila_1_and_10", "lila_half_and_10")


def _food(df: DataFrame) -> DataFrame:
    df = df.withColumn("census_tract", whole_number_code("census_tract", 11))
    on = lambda c: lenient(c, "double") == 1.0
    if _has(df, "urban_raw"):
        df = df.withColumn("urban", on("urban_raw")).drop("urban_raw")
    for c in FOOD_FLAGS:
        if c in df.columns:
            df = df.withColumn(c, on(c))
    if _has(df, "poverty_rate"):
        df = df.withColumn("poverty_rate", cap("poverty_rate", 100.0))
    # "first" needs an order to be reproducible: all columns, as text
    return dedup_first(df, "census_tract", [F.to_json(F.struct(*df.columns)).asc()])


def _hazard(df: DataFrame) -> DataFrame:
    for c in ("risk_score", "eal_score", "eal_value", "sovi_score", "resl_score"):
        if c in df.columns:
            stripped = F.trim(F.regexp_replace(F.col(c).cast("string"), r"\*", ""))
            df = df.withColumn(c, lenient(stripped, "double"))
    return df


def _crime(df: DataFrame) -> DataFrame:
    if _has(df, "state_fips_raw"):
        df = df.withColumn("state_fips", pad_code("state_fips_raw", 2, truncate=False))
        if _has(df, "county_fips_raw"):
            df = df.withColumn("county_fips", F.concat("state_fips", pad_code("county_fips_raw", 3, truncate=False)))
    for count, rate in (("violent_crime", "violent_crime_rate"), ("property_crime", "property_crime_rate")):
        if _has(df, count, "population"):
            df = df.withColumn(rate, positive_rate(count, "population", 100_000, 1))
    return df


# Alert severities, most severe highest.
SEVERITY_RANK = {"Extreme": 5, "Severe": 4, "Moderate": 3, "Minor": 2, "Unknown": 1}


def severity_rank(c: str | Column) -> Column:
    table = F.create_map(*[F.lit(x) for kv in SEVERITY_RANK.items() for x in kv])
    return F.coalesce(F.try_element_at(table, F.col(c) if isinstance(c, str) else c), F.lit(1))


def parse_alerts(features: DataFrame, ingested_at: Column, state_filter: str | None = None, summary_chars: int = DESCRIPTION_CHARS) -> DataFrame:
    """`properties` structs of alert features to flat rows; zone URLs shrink to their last part.

    `description` is whole, `description_short` its first `summary_chars` characters.
    """
    p = lambda name: F.col(f"properties.{name}")
    area = F.regexp_extract(F.get(p("geocode.UGC"), F.lit(0)), "^([A-Za-z]{2})", 1)
    state = F.nullif(area, F.lit(""))
    if state_filter:
        state = F.coalesce(state, F.when(p("areaDesc").contains(state_filter), F.lit(state_filter)))
    zones = F.transform(p("affectedZones"), lambda z: F.element_at(F.split(z, "/"), -1))
    severity = F.coalesce(p("severity"), F.lit("Unknown"))
    return features.select(
        F.coalesce(p("id"), F.lit("")).alias("alert_id"),
        F.coalesce(p("event"), F.lit("")).alias("event"),
        severity.alias("severity"),
        p("certainty").alias("certainty"),
        p("urgency").alias("urgency"),
        p("headline").alias("headline"),
        F.coalesce(p("description"), F.lit("")).alias("description"),
        F.substring(F.coalesce(p("description"), F.lit("")), 1, summary_chars).alias("description_short"),
        p("areaDesc").alias("area_desc"),
        F.coalesce(F.array_join(zones, ","), F.lit("")).alias("affected_zones"),
        state.alias("state"),
        p("onset").alias("onset"),
        p("expires").alias("expires"),
        p("senderName").alias("sender"),
        p("messageType").alias("message_type"),
        severity_rank(severity).alias("severity_rank"),
        ingested_at.alias("ingested_at"),
    )


def env_health_records(
    df: DataFrame, payload: str, measure: str, geo_type: int, area: str, default_year: str, keep: Sequence[str] = ()
) -> DataFrame:
    """JSON objects whose field names vary between releases to one fixed layout."""
    j = lambda *names: F.coalesce(*[F.get_json_object(payload, f"$.{n}") for n in names])
    blank = F.lit("")
    return df.select(
        *keep,
        F.coalesce(j("geoId", "geo_id"), blank).alias("geo_id"),
        F.lit(geo_type).alias("geo_type"),
        F.trim(F.coalesce(j("geo", "geoName"), blank)).alias("geo_name"),
        lenient(F.col(measure), "int").alias("measure_id"),
        F.coalesce(j("displayName"), blank).alias("measure_name"),
        F.lit(area).alias("content_area"),
        F.coalesce(j("year", "temporal"), F.lit(default_year)).alias("year"),
        lenient(j("dataValue", "value"), "double").alias("data_value"),
        F.coalesce(j("unitName"), blank).alias("data_value_unit"),
        F.coalesce(j("confidenceInterval"), blank).alias("confidence_interval"),
    )


# Header aliases of the source files.
DIRECTORY_ALIASES = {
    "NCESSCH": "ncessch",
    "SCH_NAME": "school_name",
    "SCHNAM": "school_name",
    "LEA_NAME": "lea_name",
    "LEANM": "lea_name",
    "ST": "state_abbr",
    "STABR": "state_abbr",
    "FIPST": "state_fips",
    "STFIP": "state_fips",
    "CNTY": "county_fips",
    "CONUM": "county_fips",
    "LAT": "latitude",
    "LATCOD": "latitude",
    "LON": "longitude",
    "LONCOD": "longitude",
    "SCH_TYPE": "school_type",
    "SCHOOL_TYPE": "school_type",
    "TOTAL": "enrollment",
    "MEMBER": "enrollment",
    "TOTFRL": "free_reduced_lunch",
    "FRL": "free_reduced_lunch",
    "TITLEI": "title_i_status",
    "TITLEI_STATUS": "title_i_status",
    "LEVEL": "school_level",
    "SCHOOL_LEVEL": "school_level",
}
LOCATION_ALIASES = {
    "NCESSCH": "ncessch",
    "LAT": "latitude",
    "LON": "longitude",
    "NMADDR": "street_address",
    "MADDR": "street_address",
    "CITY": "city",
    "STATE": "state",
    "STABR": "state",
    "ZIP": "zip_code",
    "CNTY": "county_name",
    "CONUM": "county_fips",
    "CNTY_FIPS": "county_fips",
    "LOCALE": "locale_code",
    "ULOCALE": "locale_code",
}
CENSUS_ALIASES = {
    "B17001_001E": "poverty_universe",
    "B17001_002E": "poverty_below_total",
    "B27001_001E": "insurance_universe",
    "B27001_005E": "uninsured_male_under6",
    "B27001_008E": "uninsured_male_6to18",
    "B27001_033E": "uninsured_female_under6",
    "B27001_036E": "uninsured_female_6to18",
    "B15003_001E": "edu_universe",
    "B15003_017E": "edu_hs_diploma",
    "B15003_022E": "edu_bachelors",
    "B15003_023E": "edu_masters",
    "B15003_024E": "edu_professional",
    "B15003_025E": "edu_doctorate",
    "B19013_001E": "median_hh_income",
    "B01003_001E": "total_population",
    "B03002_001E": "race_universe",
    "B03002_003E": "race_white_alone",
    "B03002_004E": "race_black_alone",
    "B03002_012E": "race_hispanic",
    "STATE": "state_fips",
    "COUNTY": "county_fips",
    "TRACT": "tract_fips",
}
AIR_ALIASES = {
    "state": "state_name",
    "county": "county_name",
    "unhealthy_for_sensitive_groups_days": "unhealthy_sensitive_days",
    "90th_percentile_aqi": "percentile_90_aqi",
}
SHORTAGE_ALIASES = {
    "hpsa_source_id": "hpsa_id",
    "source_id": "hpsa_id",
    "common_state_abbreviation": "state_abbr",
    "state_abbreviation": "state_abbr",
    "common_state_fips_code": "state_fips",
    "state_fips_code": "state_fips",
    "component_state_fips_code": "state_fips",
    "common_county_fips_code": "county_fips_3",
    "component_county_fips_code": "county_fips_3",
    "status_code": "hpsa_status",
    "hpsa_component_type_description": "hpsa_component_type",
    "hpsa_date_last_updated": "last_update",
    "hpsa_geo_type": "geo_type",
}
UNDERSERVED_ALIASES = {
    "medically_underserved_area/population_(mua/p)_source_id": "mua_source_id",
    "mua/p_source_id": "mua_source_id",
    "source_id": "mua_source_id",
    "mua/p_name": "mua_name",
    "area_name": "mua_name",
    "common_state_abbreviation": "state_abbr",
    "state_abbreviation": "state_abbr",
    "common_state_fips_code": "state_fips",
    "state_fips_code": "state_fips",
    "common_county_fips_code": "county_fips_3",
    "county_fips_code": "county_fips_3",
    "index_of_medical_underservice_score": "imu_score",
    "mua/p_status": "status",
    "mua/p_status_code": "status",
    "rural_status_description": "rural_status",
}
FOOD_ALIASES = {
    "CENSUSTRACT": "census_tract",
    "STATE": "state",
    "COUNTY": "county",
    "URBAN": "urban_raw",
    "POVERTYRATE": "poverty_rate",
    "MEDIANFAMILYINCOME": "median_family_income",
    "LA1AND10": "low_access_1",
    "LAHALFAND10": "low_access_half",
    "LOWINCOMETRACTS": "low_income",
    "LILATRACTS_1AND10": "lila_1_and_10",
    "LILATRACTS_HALFAND10": "lila_half_and_10",
    "POP2010": "total_pop",
    "TRACTKIDS": "kids_pop",
    "TRACTSENIORS": "seniors_pop",
    "LALOWI1_10": "lila_1_and_10",
    "LALOWIHALFSHARE": "lila_half_and_10",
}
HAZARD_ALIASES = {
    "STATEFIPS": "state_fips",
    "STATE": "state_name",
    "STATEABBRV": "state_abbr",
    "COUNTY": "county_name",
    "COUNTYTYPE": "county_type",
    "COUNTYFIPS": "county_fips",
    "STCOFIPS": "county_fips",
    "POPULATION": "population",
    "BUILDVALUE": "building_value",
    "RISK_SCORE": "risk_score",
    "RISK_RATNG": "risk_rating",
    "EAL_SCORE": "eal_score",
    "EAL_VALT": "eal_value",
    "SOVI_SCORE": "sovi_score",
    "SOVI_RATNG": "sovi_rating",
    "RESL_SCORE": "resl_score",
    "RESL_RATNG": "resl_rating",
    "AVLN_AFREQ": "avalanche_freq",
    "ERQK_AFREQ": "earthquake_freq",
    "HRCN_AFREQ": "hurricane_freq",
    "RFLD_AFREQ": "riverine_flood_freq",
    "TRND_AFREQ": "tornado_freq",
    "WFIR_AFREQ": "wildfire_freq",
    "DRGT_AFREQ": "drought_freq",
    "HWAV_AFREQ": "heat_wave_freq",
}
CRIME_ALIASES = {
    "fips_state": "state_fips_raw",
    "state_fips": "state_fips_raw",
    "fips_county": "county_fips_raw",
    "county_fips": "county_fips_raw",
    "violent_crime_total": "violent_crime",
    "murder_and_nonnegligent_manslaughter": "murder",
    "rape_(revised_definition)": "rape",
    "property_crime_total": "property_crime",
    "larceny_theft": "larceny",
}

AIR_DAYS = ("days_with_aqi", "good_days", "moderate_days", "unhealthy_sensitive_days", "unhealthy_days", "very_unhealthy_days", "hazardous_days")
AIR_LEVELS = ("max_aqi", "percentile_90_aqi", "median_aqi")
CRIMES = ("violent_crime", "murder", "rape", "robbery", "aggravated_assault", "property_crime", "burglary", "larceny", "motor_vehicle_theft", "population")

REGISTRY: dict[str, SourceSpec] = {
    s.name: s
    for s in (
        SourceSpec(
            "nces_ccd", DIRECTORY_ALIASES, upper_header, True,
            codes={"ncessch": 12, "state_fips": 2, "county_fips": 5},
            longs=("enrollment", "free_reduced_lunch"), ints=("school_type",), doubles=("latitude", "longitude"),
            negative_is_null=("enrollment", "free_reduced_lunch"), derive=_directory,
        ),
        SourceSpec(
            "nces_edge", LOCATION_ALIASES, upper_header, True,
            codes={"ncessch": 12, "county_fips": 5}, doubles=("latitude", "longitude"), derive=_locations,
        ),
        SourceSpec(
            "cdc_places", {}, kind="records", trimmed=("locationname",), ints=("year",), longs=("totalpopulation",),
            doubles=("data_value", "low_confidence_limit", "high_confidence_limit"),
        ),
        SourceSpec("cdc_env_health", {}, kind="env_health", ints=("measure_id", "geo_type"), doubles=("data_value",), trimmed=("geo_name",)),
        SourceSpec(
            "census_acs", CENSUS_ALIASES, upper_header, True, kind="header_row",
            codes={"state_fips": 2, "county_fips": 3, "tract_fips": 6},
            doubles=tuple(v for v in CENSUS_ALIASES.values() if not v.endswith("_fips")),
            sentinels=(CENSUS_MISSING,), derive=_census,
        ),
        SourceSpec(
            "epa_airnow", AIR_ALIASES, codes={"state_code": 2, "county_code": 3},
            ints=(*AIR_DAYS, *AIR_LEVELS, "year"), negative_is_null=AIR_LEVELS, derive=_air,
        ),
        SourceSpec(
            "hrsa_hpsa", SHORTAGE_ALIASES, codes={"state_fips": 2, "county_fips_3": 3, "county_fips": 5},
            doubles=("hpsa_score", "latitude", "longitude"), derive=_shortage,
        ),
        SourceSpec(
            "hrsa_mua", UNDERSERVED_ALIASES, codes={"state_fips": 2, "county_fips_3": 3},
            doubles=("imu_score",), derive=_underserved,
        ),
        SourceSpec(
            "usda_food_access", FOOD_ALIASES, upper_header, True,
            longs=("total_pop", "kids_pop", "seniors_pop"), doubles=("poverty_rate", "median_family_income"), derive=_food,
        ),
        SourceSpec(
            "fema_nri", HAZARD_ALIASES, upper_header, True, codes={"state_fips": 2, "county_fips": 5},
            longs=("population",), doubles=("building_value",), trimmed=("county_name", "state_name"), derive=_hazard,
        ),
        SourceSpec("noaa_nws_alerts", {}, kind="alerts"),
        SourceSpec(
            "fbi_ucr", CRIME_ALIASES, longs=CRIMES, ints=("year",),
            trimmed=("state_name", "county_name"), derive=_crime,
        ),
    )
}


# The fields of a health record that are read.
PLACES_FIELDS = (
    "year stateabbr statedesc locationname datasource category measure data_value_unit data_value_type data_value "
    "low_confidence_limit high_confidence_limit totalpopulation locationid categoryid measureid datavaluetypeid short_question_text"
).split()


def read_source(spark: SparkSession, name: str, path: str, encoding: str | None = None, whole_files: bool = False, **options) -> DataFrame:
    """Raw rows of one registered source, whatever its files are.

    JSON sources hold one payload per line, or per file with `whole_files`. Options: `measure`,
    `geo_type`, `area`, `default_year` of environmental health records (`measure` may name a column of the payload);
    `ingested_at` and `state_filter` of alerts. CSV files without an `encoding` are decided one by one.
    """
    kind = REGISTRY[name].kind
    if kind == "csv":
        return read_csv(spark, path, encoding=encoding) if encoding else read_csv_any_encoding(spark, path)
    if kind == "header_row":
        return read_header_row_json(spark, path, list(REGISTRY[name].aliases), whole_files)
    if kind == "records":
        return read_json_records(spark, path, ", ".join(f"{c} string" for c in PLACES_FIELDS), whole_files)
    if kind == "alerts":
        return parse_alerts(read_geojson_alerts(spark, path, whole_files), options.get("ingested_at", F.current_timestamp()), options.get("state_filter"))
    payload = spark.read.text(path, wholetext=whole_files)
    payload = payload.select(F.explode(F.coalesce(F.from_json("value", "array<string>"), F.array("value"))).alias("value"))
    payload = payload.withColumn("measure", F.coalesce(F.get_json_object("value", "$.measureId"), F.lit(options.get("measure")).cast("string")))
    return env_health_records(payload, "value", "measure", options.get("geo_type", 2), options.get("area", ""), options.get("default_year", ""))


def load_source(spark: SparkSession, name: str, path: str, encoding: str | None = None, **options) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Read, clean and validate any registered source: (valid, rejected, summary)."""
    clean = clean_source(read_source(spark, name, path, encoding, **options), REGISTRY[name])
    return validate(clean, CONTRACTS[name])
