"""The declared checks of the published tables, as plain specs, and one run over all of them."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.checked_write import CheckedWrite, write_checked
from ..operators.quality import Check, run_checks

PERCENT = {"low": 0, "high": 100}


def _rows(warn: int, fail: int) -> Check:
    return Check("row_count", warn=("<", warn), fail=("<", fail))


def _key(column: str) -> list[Check]:
    return [Check("missing_count", column, fail=(">", 0)), Check("duplicate_count", column, fail=(">", 0))]


def _percents(*columns: str) -> list[Check]:
    return [Check("invalid_count", c, fail=(">", 0), options=PERCENT) for c in columns]


def _missing(column: str, warn: float, fail: float) -> Check:
    return Check("missing_percent", column, warn=(">", warn), fail=(">", fail))


def _within(column: str, low: float, high: float, warn: int) -> Check:
    return Check("invalid_count", column, warn=(">", warn), options={"low": low, "high": high})


# Thresholds of the published check suites.
SUITES: Mapping[str, Sequence[Check]] = {
    "scores": [
        _rows(100_000, 60_000),
        *_key("nces_school_id"),
        *_percents("wellbeing_score", "education_score", "health_score", "environment_score", "safety_score"),
        Check("avg", "wellbeing_score", warn=("not between", (35, 75)), fail=("not between", (20, 85))),
        Check("stddev", "wellbeing_score", warn=("<", 8), fail=("<", 3)),
        Check("missing_count", "wellbeing_category", fail=(">", 0)),
        Check("avg", "pillars_with_data", warn=("<", 3.0), fail=("<", 2.5)),
        _missing("latitude", 3, 10),
        Check("distinct_count", "state_abbr", warn=("<", 50), fail=("<", 45)),
    ],
    "counties": [
        _rows(2_500, 2_000),
        Check("duplicate_count", "county_fips", fail=(">", 0)),
        *_percents("avg_wellbeing_score"),
        Check("missing_count", "county_category", fail=(">", 0)),
    ],
    "rankings": [
        _rows(100_000, 60_000),
        Check("duplicate_count", "nces_school_id", fail=(">", 0)),
        *_percents("national_percentile_pct"),
    ],
    "health_context": [
        _rows(120_000, 80_000),
        *_key("nces_school_id"),
        _missing("poverty_rate", 10, 25),
        _missing("child_poverty_rate", 15, 30),
        *_percents("poverty_rate", "child_poverty_rate", "uninsured_children_rate"),
        _within("obesity_pct", 0, 100, 10),
        _within("asthma_pct", 0, 100, 10),
        _within("median_household_income", 0, 500_000, 10),
        _missing("obesity_pct", 20, 40),
        _missing("poor_mental_health_pct", 20, 40),
    ],
    "profiles": [
        _rows(120_000, 80_000),
        *_key("nces_school_id"),
        *[Check("missing_count", c, fail=(">", 0)) for c in ("school_name", "state_abbr", "county_fips")],
        _missing("latitude", 5, 15),
        _missing("longitude", 5, 15),
        Check("invalid_percent", "state_abbr", fail=(">", 0), options={"length": 2}),
        _within("total_enrollment", 0, 20_000, 100),
        _missing("total_enrollment", 10, 25),
        _missing("math_proficiency_pct", 50, 75),
        _within("frpl_pct", 0, 100, 50),
    ],
}

#: Days without new rows after which a source warns and fails.
FRESHNESS: Mapping[str, tuple[int, int]] = {
    "schools": (90, 180),
    "health_measures": (120, 240),
    "census": (180, 365),
    "air_quality": (120, 240),
    "shortage_areas": (30, 90),
    "crime": (180, 365),
    "hazards": (180, 365),
    "food_access": (365, 730),
}


def freshness_checks(source: str, loaded_at: str = "_loaded_at") -> list[Check]:
    warn, fail = FRESHNESS[source]
    return [Check("freshness", loaded_at, warn=(">", warn), fail=(">", fail))]


def run_suites(tables: Mapping[str, DataFrame], suites: Mapping[str, Sequence[Check]] = SUITES, as_of: Column | None = None) -> DataFrame:
    """(table_name, check_name, column_name, value, status) of every suite whose table is given.

    One aggregate per table for all plain measures. A check on a column that a table does not have fails with a
    null value instead of stopping the run.
    """
    out = None
    for name, checks in suites.items():
        if name not in tables:
            continue
        df = tables[name]
        missing = {c.column for c in checks if c.column and c.column not in df.columns}
        found = run_checks(df, [c for c in checks if c.column not in missing], as_of).select(F.lit(name).alias("table_name"), "*")
        absent = [(name, c.name, c.column) for c in checks if c.column in missing]
        if absent:
            rows = df.sparkSession.createDataFrame(absent, "table_name string, check_name string, column_name string")
            found = found.unionByName(rows.select("*", F.lit(None).cast("double").alias("value"), F.lit("fail").alias("status")))
        out = found if out is None else out.unionByName(found)
    if out is None:
        raise ValueError("none of the suites' tables is given")
    return out


def publish(df: DataFrame, name: str, path: str, suites: Mapping[str, Sequence[Check]] = SUITES, as_of: Column | None = None) -> CheckedWrite:
    """Write the table `name` and measure its suite in the same pass; see `write_checked`."""
    return write_checked(df, path, suites[name], as_of)


@dataclass(frozen=True)
class Parent:
    """Every value of `column` must occur in `field` of the table `table`."""

    column: str
    table: str
    field: str


def _unique(column: str) -> list[Check]:
    return [Check("duplicate_count", column, fail=(">", 0)), Check("missing_count", column, fail=(">", 0))]


def _present(*columns: str) -> list[Check]:
    return [Check("missing_count", c, fail=(">", 0)) for c in columns]


def _between(column: str, low: float, high: float, severity: str = "warn") -> Check:
    return Check("invalid_count", column, **{severity: (">", 0)}, options={"low": low, "high": high})


def _one_of(column: str, *values: str) -> Check:
    return Check("invalid_count", column, fail=(">", 0), options={"values": values})


# Column tests of the published models.
_CATEGORIES = ("Thriving", "Moderate", "At Risk", "Critical", "Insufficient Data")
_TRENDS = ("Improving", "Declining", "Stable")
_SPINE = Parent("nces_school_id", "profiles", "nces_school_id")
COLUMN_TESTS: Mapping[str, Sequence[Check | Parent]] = {
    "profiles": [
        *_unique("nces_school_id"),
        *_present("school_name", "state_abbr", "county_fips"),
        _between("latitude", 17, 72),
        _between("longitude", -180, -64),
        _between("total_enrollment", 0, 15_000),
        _between("math_proficiency_pct", 0, 100),
        _between("reading_proficiency_pct", 0, 100),
    ],
    "health_context": [*_unique("nces_school_id"), _SPINE, _between("child_poverty_rate", 0, 100)],
    "environment": [*_unique("nces_school_id"), _SPINE, _between("median_aqi", 0, 500)],
    "safety": [*_unique("nces_school_id"), _SPINE],
    "resources": [*_unique("nces_school_id"), _SPINE],
    "areas": [*_unique("county_fips"), *_present("school_count"), _between("school_count", 1, 5_000, "fail")],
    "scores": [
        *_unique("nces_school_id"),
        *_present("wellbeing_score"),
        _between("wellbeing_score", 0, 100, "fail"),
        *[_between(c, 0, 100) for c in ("education_score", "health_score", "environment_score", "safety_score")],
        _one_of("wellbeing_category", *_CATEGORIES),
        _between("pillars_with_data", 1, 4, "fail"),
        Check("missing_count", "latitude", warn=(">", 0)),
        Check("missing_count", "longitude", warn=(">", 0)),
    ],
    "rankings": [*_unique("nces_school_id"), Parent("nces_school_id", "scores", "nces_school_id"), *_present("national_rank", "state_rank")],
    "gaps": [
        *_unique("nces_school_id"),
        _between("gap_count", 1, 4, "fail"),
        _one_of("intervention_priority", "High Priority", "Critical Need", "Moderate Need"),
        _one_of("weakest_pillar", "Education", "Health", "Environment", "Safety"),
    ],
    "trends": [*_unique("nces_school_id"), _one_of("math_trend", *_TRENDS), _one_of("reading_trend", *_TRENDS)],
    "counties": [
        *_unique("county_fips"),
        *_present("avg_wellbeing_score"),
        _between("avg_wellbeing_score", 0, 100, "fail"),
        _one_of("county_category", *_CATEGORIES),
    ],
}


def run_column_tests(tables: Mapping[str, DataFrame], tests: Mapping[str, Sequence[Check | Parent]] = COLUMN_TESTS) -> DataFrame:
    """(table_name, check_name, column_name, value, status) of every column test whose table is given.

    A parent test counts the rows with a value that its parent table lacks; it is left out, like a test of
    an absent table, where that parent is not given. Nulls have no parent and are not counted.
    """
    checks = {name: [c for c in found if isinstance(c, Check)] for name, found in tests.items()}
    out = run_suites(tables, checks)
    for name, found in tests.items():
        for p in found:
            if not isinstance(p, Parent) or name not in tables or p.table not in tables:
                continue
            parents = tables[p.table].select(F.col(p.field).alias("_parent"))
            orphans = tables[name].join(parents, F.col(p.column) == F.col("_parent"), "left_anti").filter(F.col(p.column).isNotNull())
            counted = orphans.agg(F.count(F.lit(1)).cast("double").alias("value"))
            out = out.unionByName(
                counted.select(
                    F.lit(name).alias("table_name"),
                    F.lit(f"orphan_count({p.column})").alias("check_name"),
                    F.lit(p.column).alias("column_name"),
                    "value",
                    F.when(F.col("value") > 0, "fail").otherwise("pass").alias("status"),
                )
            )
    return out
