"""Model features: interactions, encodings, imputation, coverage."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import attach_stats
from .aggregates import null_rates
from .bounds import grouped_median, percentile_bounds, quantile_name


@dataclass(frozen=True)
class Interaction:
    """`product` a·b/100, `flag` flag·b, `ratio` a / max(b, 1)."""

    out: str
    a: str
    b: str
    kind: str = "product"


# The interaction features of the published feature set.
DEFAULT_INTERACTIONS = (
    Interaction("poverty_x_food_desert", "child_poverty_rate", "pct_tracts_food_desert"),
    Interaction("hpsa_x_uninsured", "is_hpsa_designated", "uninsured_children_rate", "flag"),
    Interaction("crime_x_poverty", "violent_crime_rate", "child_poverty_rate"),
    Interaction("aqi_x_asthma", "median_aqi", "asthma_pct"),
    Interaction("absenteeism_x_poverty", "chronic_absenteeism_pct", "child_poverty_rate"),
    Interaction("implied_teacher_count", "total_enrollment", "student_teacher_ratio", "ratio"),
)

# Ordinal codes of the categorical features.
CATEGORY_CODES = {"Critical": 0, "At Risk": 1, "Moderate": 2, "Thriving": 3}
SCHOOL_TYPE_CODES = {
    "Regular": 0,
    "Special Education": 1,
    "Career/Technical": 2,
    "Alternative": 3,
    "Charter": 4,
    "Magnet": 5,
}

NUMERIC = (T.DoubleType, T.FloatType, T.LongType, T.IntegerType)


def interactions(df: DataFrame, spec: Sequence[Interaction] = DEFAULT_INTERACTIONS) -> DataFrame:
    """Add the interactions whose two columns are present."""
    have = set(df.columns)
    added = []
    for s in spec:
        if s.a not in have or s.b not in have:
            continue
        a, b = F.col(s.a).cast("double"), F.col(s.b).cast("double")
        value = {"product": a * b / 100, "flag": a * b, "ratio": a / F.when(b.isNotNull(), F.greatest(b, F.lit(1.0)))}[s.kind]
        added.append(value.alias(s.out))
    return df.select("*", *added)


def encode(df: DataFrame, codes: Mapping[str, Mapping[str, int]]) -> DataFrame:
    """`<col>_encoded` by lookup, unknown labels become null."""
    added = []
    for c, mapping in codes.items():
        if c in df.columns:
            table = F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv])
            added.append(F.try_element_at(table, F.col(c)).cast("int").alias(f"{c}_encoded"))
    return df.select("*", *added)


def bools_to_int(df: DataFrame) -> DataFrame:
    """`<col>_int` copy of every boolean column."""
    flags = [f.name for f in df.schema.fields if isinstance(f.dataType, T.BooleanType)]
    return df.select("*", *[F.col(c).cast("int").alias(f"{c}_int") for c in flags])


def renamed_changes(df: DataFrame, key: str, names: Mapping[str, str]) -> DataFrame:
    """Change columns under feature names, ready to join on the key."""
    return df.select(key, *[F.col(c).alias(n) for c, n in names.items() if c in df.columns])


def numeric_features(df: DataFrame, exclude: Sequence[str] = ()) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, NUMERIC) and f.name not in exclude]


def select_by_importance(df: DataFrame, importances: Mapping[str, float], threshold: float = 0.01) -> list[str]:
    return [c for c, weight in importances.items() if weight >= threshold and c in df.columns]


def impute_grouped_median(df: DataFrame, by: str, cols: Sequence[str], flags: Sequence[str] = ()) -> DataFrame:
    """Fill nulls with the group median, then with the median of the filled column; flags with 0.

    All group medians come from one pass and one join.
    """
    medians = grouped_median(df, [by], cols)
    packed = medians.select(by, F.struct(*cols).alias("_group"))
    joined = df.join(packed, by, "left")
    filled = joined.select(
        *[
            F.coalesce(F.col(c).cast("double"), F.col(f"_group.{c}")).alias(c) if c in cols else F.col(c)
            for c in df.columns
        ]
    )
    overall = attach_stats(filled, percentile_bounds(filled, cols, (0.5,)), "_all")
    out = []
    for f in df.schema.fields:
        c = F.col(f.name)
        if f.name in cols:
            c = F.coalesce(c, F.col(f"_all.{quantile_name(f.name, 0.5)}"))
        elif f.name in flags:
            c = F.coalesce(c, F.lit(0).cast("int").cast(f.dataType))
        out.append(c.alias(f.name))
    return overall.select(*out)


def drop_low_coverage(df: DataFrame, minimum: float = 0.30, keep: Sequence[str] = ()) -> DataFrame:
    """Drop columns whose share of values is below `minimum`.

    Needs one aggregate pass: the schema of the result depends on the data, so the
    per-column counts (one short row per column) come to the driver.
    """
    candidates = [c for c in df.columns if c not in keep]
    rates = null_rates(df, candidates, digits=6).collect()
    sparse = [r["column_name"] for r in rates if 100 - r["null_pct"] < minimum * 100]
    return df.drop(*sparse)
