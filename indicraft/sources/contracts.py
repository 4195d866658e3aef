"""Row contracts: required fields, types, patterns, ranges and enumerations as one predicate."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.cleaning import round_half_up

JSON_TYPES = {"string": "string", "integer": "long", "number": "double", "boolean": "boolean"}


@dataclass(frozen=True)
class Field:
    name: str
    kind: str = "string"
    required: bool = False
    pattern: str | None = None
    low: float | None = None
    high: float | None = None
    values: Sequence[Any] | None = None

    def problems(self, present: bool) -> list[tuple[str, Column]]:
        """(reason, condition that marks a row as broken)."""
        if not present:
            return [("missing", F.lit(True))] if self.required else []
        c = F.col(f"`{self.name}`")
        found: list[tuple[str, Column]] = []
        if self.required:
            found.append(("required", c.isNull()))
        if self.kind != "string":
            found.append(("type", c.isNotNull() & c.cast("string").try_cast(self.kind).isNull()))
        if self.pattern:
            found.append(("pattern", ~c.cast("string").rlike(self.pattern)))
        number = c.cast("string").try_cast("double")
        if self.low is not None:
            found.append(("minimum", number < self.low))
        if self.high is not None:
            found.append(("maximum", number > self.high))
        if self.values is not None:
            found.append(("enum", ~c.cast("string").isin(*[str(v) for v in self.values])))
        return [(reason, F.coalesce(cond, F.lit(False))) for reason, cond in found]


@dataclass(frozen=True)
class Contract:
    name: str
    fields: Sequence[Field]

    def violations(self, df: DataFrame) -> Column:
        """Array of `field:reason` for one row, empty when the row is valid."""
        have = set(df.columns)
        marks = [
            F.when(cond, F.lit(f"{f.name}:{reason}"))
            for f in self.fields
            for reason, cond in f.problems(f.name in have)
        ]
        return F.array_compact(F.array(*marks)) if marks else F.array().cast("array<string>")


def contract_from_json_schema(name: str, schema: str | Mapping[str, Any]) -> Contract:
    """Contract from the subset required / type / pattern / minimum / maximum / enum of JSON Schema."""
    spec = json.loads(schema) if isinstance(schema, str) else schema
    required = set(spec.get("required", ()))
    fields = []
    for field, rule in spec.get("properties", {}).items():
        kinds = rule.get("type", "string")
        kinds = [kinds] if isinstance(kinds, str) else kinds
        kind = next((JSON_TYPES[k] for k in kinds if k in JSON_TYPES), "string")
        values = rule.get("enum")
        fields.append(
            Field(
                field,
                kind,
                field in required,
                rule.get("pattern"),
                rule.get("minimum"),
                rule.get("maximum"),
                [v for v in values if v is not None] if values else None,
            )
        )
    return Contract(name, fields)


def validate(df: DataFrame, contract: Contract) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(valid rows, rejected rows with their `violations`, one-row summary). All lazy."""
    marked = df.withColumn("violations", contract.violations(df))
    good = F.size("violations") == 0
    rows = F.count(F.lit(1))
    dropped = F.count_if(~good)
    summary = marked.agg(
        F.lit(contract.name).alias("contract"),
        rows.alias("total"),
        dropped.alias("dropped"),
        round_half_up(dropped / F.greatest(rows, F.lit(1)) * 100, 1).alias("dropped_pct"),
    )
    return marked.filter(good).drop("violations"), marked.filter(~good), summary


def violation_counts(df: DataFrame, contract: Contract) -> DataFrame:
    """How often each rule was broken."""
    broken = df.select(F.explode(contract.violations(df)).alias("violation"))
    return broken.groupBy("violation").agg(F.count(F.lit(1)).alias("row_count"))


STATE2, COUNTY3, COUNTY5 = "^[0-9]{2}$", "^[0-9]{3}$", "^[0-9]{5}$"
TRACT6, CODE11, CODE12, ABBR = "^[0-9]{6}$", "^[0-9]{11}$", "^[0-9]{12}$", "^[A-Z]{2}$"


def _text(*names: str, required: bool = False) -> list[Field]:
    return [Field(n, "string", required) for n in names]


def _numbers(kind: str, *names: str, low: float | None = None, high: float | None = None) -> list[Field]:
    return [Field(n, kind, low=low, high=high) for n in names]


# The landing contracts of the twelve sources.
CONTRACTS: dict[str, Contract] = {
    c.name: c
    for c in (
        Contract(
            "nces_ccd",
            [
                Field("ncessch", required=True, pattern=CODE12),
                Field("school_name", required=True),
                Field("state_abbr", required=True, pattern=ABBR),
                Field("state_fips", required=True, pattern=STATE2),
                Field("county_fips", pattern=COUNTY5),
                Field("latitude", "double", low=17, high=72),
                Field("longitude", "double", low=-180, high=-65),
                Field("school_type", "long", values=(1, 2, 3, 4)),
                *_numbers("long", "enrollment", "free_reduced_lunch", low=0),
            ],
        ),
        Contract(
            "nces_edge",
            [
                Field("ncessch", required=True, pattern=CODE12),
                *_numbers("double", "latitude", "longitude"),
                Field("state", pattern=ABBR),
                Field("county_fips", pattern=COUNTY5),
            ],
        ),
        Contract(
            "cdc_places",
            [
                Field("stateabbr", required=True, pattern=ABBR),
                *_text("locationname", "measure", required=True),
                *_numbers("long", "year", "totalpopulation"),
                *_numbers("double", "data_value", "low_confidence_limit", "high_confidence_limit"),
            ],
        ),
        Contract(
            "cdc_env_health",
            [
                Field("geo_id", required=True),
                Field("geo_type", "long", True, values=(2, 3)),
                Field("measure_id", "long", True),
                Field("data_value", "double"),
            ],
        ),
        Contract(
            "census_acs",
            [
                Field("state_fips", required=True, pattern=STATE2),
                Field("county_fips", required=True, pattern=COUNTY3),
                Field("tract_fips", required=True, pattern=TRACT6),
                Field("full_fips", required=True, pattern=CODE11),
                *_numbers("long", "total_population", "uninsured_children", low=0),
                *_numbers("double", "poverty_rate", "pct_bachelors_plus", low=0, high=100),
                Field("median_hh_income", "long"),
            ],
        ),
        Contract(
            "epa_airnow",
            [
                Field("state_code", required=True, pattern=STATE2),
                Field("county_code", required=True, pattern=COUNTY3),
                Field("county_fips", pattern=COUNTY5),
                Field("year", "long", True),
                Field("days_with_aqi", "long", low=0, high=366),
                *_numbers("long", "good_days", "moderate_days", "unhealthy_sensitive_days", low=0),
                *_numbers("long", "unhealthy_days", "very_unhealthy_days", "hazardous_days", low=0),
                *_numbers("long", "max_aqi", "percentile_90_aqi", "median_aqi"),
            ],
        ),
        Contract(
            "fbi_ucr",
            [
                Field("state_fips", required=True, pattern=STATE2),
                Field("county_fips", required=True, pattern=COUNTY5),
                Field("year", "long", True),
                *_numbers("long", "population", "violent_crime", "murder", "rape", "robbery", low=0),
                *_numbers("long", "aggravated_assault", "property_crime", "burglary", "larceny", low=0),
                Field("motor_vehicle_theft", "long", low=0),
                *_numbers("double", "violent_crime_rate", "property_crime_rate", low=0),
            ],
        ),
        Contract(
            "fema_nri",
            [
                Field("state_fips", required=True, pattern=STATE2),
                Field("county_fips", required=True, pattern=COUNTY5),
                *_text("county_name", "state_name", required=True),
                *_numbers("double", "risk_score", "sovi_score", "resl_score", low=0, high=100),
                Field(
                    "risk_rating",
                    values=("Very Low", "Relatively Low", "Relatively Moderate", "Relatively High", "Very High"),
                ),
                Field("population", "long", low=0),
                Field("building_value", "double", low=0),
            ],
        ),
        Contract(
            "hrsa_hpsa",
            [
                *_text("hpsa_id", "hpsa_name", "hpsa_status", required=True),
                Field("state_abbr", required=True, pattern=ABBR),
                Field("state_fips", pattern=STATE2),
                Field("county_fips", pattern=COUNTY5),
                Field("hpsa_score", "long", low=0, high=26),
                Field("discipline", values=("Primary Care", "Dental Health", "Mental Health")),
            ],
        ),
        Contract(
            "hrsa_mua",
            [
                Field("mua_source_id", required=True),
                Field("state_abbr", required=True, pattern=ABBR),
                Field("state_fips", pattern=STATE2),
                Field("county_fips", pattern=COUNTY5),
                Field("designation_type", required=True, values=("MUA", "MUP")),
                Field("imu_score", "double", low=0, high=100),
            ],
        ),
        Contract(
            "noaa_nws_alerts",
            [
                *_text("alert_id", "event", required=True),
                Field("severity", required=True, values=("Extreme", "Severe", "Moderate", "Minor", "Unknown")),
                Field("severity_rank", "long", low=1, high=5),
            ],
        ),
        Contract(
            "usda_food_access",
            [
                Field("census_tract", required=True, pattern=CODE11),
                Field("poverty_rate", "double", low=0, high=100),
                *_numbers("long", "total_pop", "kids_pop", "seniors_pop", low=0),
            ],
        ),
    )
}
