"""Joins of an entity spine with its context tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def enrich(
    spine: DataFrame,
    contexts: Sequence[tuple[DataFrame, str | Sequence[str]]],
    defaults: Mapping[str, Any] | None = None,
    check_unique: bool = False,
) -> DataFrame:
    """Left-join context frames on their keys; `defaults` fills columns no row matched.

    No broadcast hint is given: the planner and AQE broadcast a context whose real
    size is under the threshold and sort-merge (with skew splitting) beyond it.
    `check_unique` makes the job fail if a context holds a key twice, which would
    multiply spine rows.
    """
    out = spine
    for context, keys in contexts:
        on = [keys] if isinstance(keys, str) else list(keys)
        if check_unique:
            context = require_unique(context, on)
        out = out.join(context, on, "left")
    for name, value in (defaults or {}).items():
        out = out.withColumn(name, F.coalesce(F.col(name), F.lit(value)))
    return out


def require_unique(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Collapse to one row per key, raising inside the job when a key occurs twice."""
    others = [c for c in df.columns if c not in keys]
    packed = F.struct(*others) if others else F.struct(F.lit(1))
    grouped = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.first(packed).alias("_row"))
    checked = grouped.withColumn(
        "_row",
        F.when(F.col("_n") == 1, F.col("_row")).otherwise(
            F.raise_error(F.concat(F.lit("duplicate key: "), F.to_json(F.struct(*keys))))
        ),
    )
    return checked.select(*keys, *[F.col(f"_row.{c}").alias(c) for c in others])


def lookup(
    df: DataFrame, key: str, table: DataFrame, table_key: str, value: str, out: str, fallback: str | None = None
) -> DataFrame:
    """Left lookup of one value on a deduplicated table, with a fallback column."""
    small = table.groupBy(F.col(table_key).alias(key)).agg(F.min(value).alias("_found"))
    joined = df.join(small, key, "left")
    found = F.col("_found") if fallback is None else F.coalesce("_found", fallback)
    return joined.withColumn(out, found).drop("_found")


def period_over_period(
    df: DataFrame,
    key: str | Sequence[str],
    period: str,
    cols: Sequence[str],
    current: Any,
    prior: Any,
    suffix: str = "_change",
) -> DataFrame:
    """Rows of period `current` with the change of each column since period `prior`."""
    keys = [key] if isinstance(key, str) else list(key)
    now = df.filter(F.col(period) == F.lit(current))
    before = df.filter(F.col(period) == F.lit(prior)).select(
        *keys, *[F.col(c).alias(f"_prior_{c}") for c in cols]
    )
    joined = now.join(before, keys, "left")
    for c in cols:
        joined = joined.withColumn(f"{c}{suffix}", F.col(c) - F.col(f"_prior_{c}"))
    return joined.drop(*[f"_prior_{c}" for c in cols])


def flagged_by_both(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Keys present in both flag sets."""
    return a.select(key).distinct().join(b.select(key).distinct(), key, "left_semi")


def not_yet_done(todo: DataFrame, done: DataFrame, keys: str | Sequence[str]) -> DataFrame:
    """Rows whose key does not occur in `done`."""
    on = [keys] if isinstance(keys, str) else list(keys)
    return todo.join(done.select(*on).distinct(), on, "left_anti")


def orphan_keys(child: DataFrame, parent: DataFrame, key: str, parent_key: str | None = None) -> DataFrame:
    """Child keys without a parent and how many child rows carry them."""
    known = parent.select(F.col(parent_key or key).alias(key))
    counts = child.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("child_rows"))
    return counts.join(known.distinct(), key, "left_anti")
