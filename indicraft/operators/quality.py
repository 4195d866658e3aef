"""Declarative data-quality checks, one aggregation per table."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.cleaning import age_days, round_half_up
from ..session import attach_stats, materialize, one_row
from .aggregates import mode_share

Threshold = tuple[str, Any]


@dataclass(frozen=True)
class Check:
    """One check: `kind` on `column`, with `warn` and `fail` as (operator, value).

    Kinds: row_count, missing_count, missing_percent, duplicate_count, distinct_count,
    invalid_count, invalid_percent, avg, stddev, min, max, freshness (age in days).
    Validity options: low, high, values, pattern, length.
    Operators: <, <=, >, >=, =, !=, between, not between. A threshold that holds is a breach.
    """

    kind: str
    column: str | None = None
    warn: Threshold | None = None
    fail: Threshold | None = None
    options: Mapping[str, Any] = field(default_factory=dict)

    @property
    def name(self) -> str:
        return f"{self.kind}({self.column})" if self.column else self.kind


def valid(column: str | Column, low=None, high=None, values=None, pattern=None, length=None) -> Column:
    """Conjunction of the given rules on a value."""
    c = F.col(column) if isinstance(column, str) else column
    cond = F.lit(True)
    if low is not None:
        cond = cond & (c >= low)
    if high is not None:
        cond = cond & (c <= high)
    if values is not None:
        cond = cond & c.isin(*values)
    if pattern is not None:
        cond = cond & c.cast("string").rlike(pattern)
    if length is not None:
        cond = cond & (F.length(c.cast("string")) == length)
    return cond


def _breached(value: Column, threshold: Threshold | None) -> Column:
    if threshold is None:
        return F.lit(False)
    op, limit = threshold
    tests = {
        "<": lambda: value < limit,
        "<=": lambda: value <= limit,
        ">": lambda: value > limit,
        ">=": lambda: value >= limit,
        "=": lambda: value == limit,
        "!=": lambda: value != limit,
        "between": lambda: value.between(*limit),
        "not between": lambda: ~value.between(*limit),
    }
    return F.coalesce(tests[op](), F.lit(False))


#: Measures that need the rows of a key together.
KEYED = ("duplicate_count", "distinct_count")


def plain_value(check: Check, as_of: Column | None) -> Column:
    """The measure of a check that is not keyed, as one aggregate."""
    rows = F.count(F.lit(1))
    c = F.col(check.column) if check.column else None
    share = lambda n: n / F.nullif(rows, F.lit(0)) * 100
    if check.kind == "row_count":
        return rows
    if check.kind == "missing_count":
        return F.count_if(c.isNull())
    if check.kind == "missing_percent":
        return share(F.count_if(c.isNull()))
    if check.kind == "invalid_count":
        return F.count_if(c.isNotNull() & ~valid(c, **check.options))
    if check.kind == "invalid_percent":
        return share(F.count_if(c.isNotNull() & ~valid(c, **check.options)))
    if check.kind == "freshness":
        return age_days(F.max(c), as_of)
    return {"avg": F.avg, "stddev": F.stddev, "min": F.min, "max": F.max}[check.kind](c)


def key_counts(df: DataFrame, key: str) -> DataFrame:
    """One row: keys that occur more than once and different keys, nulls left out."""
    sizes = df.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    return sizes.agg(F.count_if(F.col("n") > 1).alias("duplicate_count"), F.count(F.lit(1)).alias("distinct_count"))


def verdicts(measured: DataFrame, checks: Sequence[Check], values: Sequence[Column], digits: int = 4, more: Sequence[Column] = ()) -> DataFrame:
    """Rows (check_name, column_name, value, status) from one row of measures; `more` adds a column, one value per check."""
    cells = []
    for i, (c, value) in enumerate(zip(checks, values, strict=True)):
        status = F.when(_breached(value, c.fail), "fail").when(_breached(value, c.warn), "warn").otherwise("pass")
        cells.append(
            F.struct(
                F.lit(c.name).alias("check_name"),
                F.lit(c.column).cast("string").alias("column_name"),
                round_half_up(value, digits).alias("value"),
                status.alias("status"),
                *more[i : i + 1],
            )
        )
    return measured.select(F.inline(F.array(*cells)))


def run_checks(df: DataFrame, checks: Sequence[Check], as_of: Column | None = None, digits: int = 4) -> DataFrame:
    """Rows (check_name, column_name, value, status) with status pass / warn / fail.

    All plain measures share one aggregate over the table. Key measures (duplicate and
    distinct counts) need the rows grouped by that key, once per key column.
    """
    key_stats = {k: key_counts(df, k) for k in sorted({c.column for c in checks if c.kind in KEYED})}
    plain = [(F.lit(0) if c.kind in KEYED else plain_value(c, as_of)).cast("double").alias(f"_v{i}") for i, c in enumerate(checks)]
    values = [one_row(key_stats[c.column])[c.kind].cast("double") if c.kind in KEYED else F.col(f"_v{i}") for i, c in enumerate(checks)]
    return verdicts(df.agg(*plain), checks, values, digits)


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that occur more than once and how often."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("occurrences")).filter(F.col("occurrences") > 1)


def failing_rows(df: DataFrame, rule: Column, *cols: str) -> DataFrame:
    """Rows a rule rejects: an empty result means the rule holds."""
    return df.filter(rule).select(*cols)


def table_rules(
    df: DataFrame,
    table: str,
    min_rows: int = 0,
    required: Sequence[str] = (),
    max_null_pct: Mapping[str, float] | None = None,
    ranges: Mapping[str, tuple[float, float]] | None = None,
) -> DataFrame:
    """Rule runner over the whole table: rows (table_name, rule, observed, status), one job."""
    nulls = {c: p for c, p in (max_null_pct or {}).items() if c in df.columns}
    spans = {c: r for c, r in (ranges or {}).items() if c in df.columns}
    rows = F.count(F.lit(1))
    aggs = [rows.cast("double").alias("_rows")]
    aggs += [round_half_up(F.count_if(F.col(c).isNull()) / F.greatest(rows, F.lit(1)) * 100, 2).alias(f"_null_{c}") for c in nulls]
    for c in spans:
        aggs += [F.min(c).cast("double").alias(f"_lo_{c}"), F.max(c).cast("double").alias(f"_hi_{c}")]
    verdict = lambda ok: F.when(ok, "pass").otherwise("fail")
    cells = [(F.lit("row_count"), F.col("_rows"), verdict(F.col("_rows") >= min_rows))]
    for c in required:
        cells.append((F.lit(f"required:{c}"), F.lit(None).cast("double"), F.lit("pass" if c in df.columns else "fail")))
    for c, limit in nulls.items():
        cells.append((F.lit(f"null_pct:{c}"), F.col(f"_null_{c}"), verdict(F.col(f"_null_{c}") <= limit)))
    for c, (lo, hi) in spans.items():
        low, high = F.col(f"_lo_{c}"), F.col(f"_hi_{c}")
        status = F.when(low.isNull(), "warn").otherwise(verdict((low >= lo) & (high <= hi)))
        cells.append((F.lit(f"range:{c}"), F.when(low < lo, low).otherwise(high), status))
    packed = F.array(*[F.struct(F.lit(table).alias("table_name"), n.alias("rule"), v.alias("observed"), s.alias("status")) for n, v, s in cells])
    return df.agg(*aggs).select(F.inline(packed))


def distribution_check(df: DataFrame, col: str, mean_range=(20, 80), min_std: float = 1, max_mode_pct: float = 25) -> DataFrame:
    """One row: mean, deviation and modal share of a score with a verdict each."""
    scored = df.filter(F.col(col).isNotNull())
    base = scored.agg(
        F.count(F.lit(1)).alias("row_count"),
        round_half_up(F.avg(col), 2).alias("mean"),
        round_half_up(F.stddev(col), 2).alias("std"),
    )
    out = attach_stats(base, mode_share(scored, col), "_m")
    verdict = lambda ok: F.when(ok, "pass").otherwise("fail")
    return out.select(
        "row_count",
        "mean",
        "std",
        F.col("_m.mode_pct").alias("mode_pct"),
        verdict(F.col("mean").between(*mean_range)).alias("mean_status"),
        verdict(F.col("std") > min_std).alias("std_status"),
        verdict(F.col("_m.mode_pct") <= max_mode_pct).alias("mode_status"),
    )


def freshness(df: DataFrame, ts: str, as_of: Column, warn_days: float, fail_days: float) -> DataFrame:
    """Latest timestamp, its age in days and pass / warn / fail; no timestamp at all is unknown."""
    age = age_days("latest", as_of)
    status = (
        F.when(F.col("latest").isNull(), "unknown").when(age > fail_days, "fail").when(age > warn_days, "warn").otherwise("pass")
    )
    return df.agg(F.max(ts).alias("latest")).select("latest", round_half_up(age, 1).alias("age_days"), status.alias("status"))


def freshness_report(
    spark: SparkSession,
    tables: Mapping[str, tuple[DataFrame | None, str | None, float]],
    as_of: Column,
) -> DataFrame:
    """fresh / stale / missing / unknown per table; `tables`: name → (frame, timestamp column, max age)."""
    parts = []
    for name, (df, ts, limit) in tables.items():
        if df is None or ts is None:
            state = "missing" if df is None else "unknown"
            part = spark.range(1).select(F.lit(None).cast("timestamp").alias("latest"), F.lit(None).cast("double").alias("age_days"), F.lit(state).alias("status"))
        else:
            age = age_days("latest", as_of)
            status = F.when(F.col("latest").isNull(), "unknown").when(age <= limit, "fresh").otherwise("stale")
            part = df.agg(F.max(F.col(ts).cast("timestamp")).alias("latest")).select("latest", round_half_up(age, 1).alias("age_days"), status.alias("status"))
        parts.append(part.select(F.lit(name).alias("table_name"), "latest", "age_days", F.lit(float(limit)).alias("max_age_days"), "status"))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def quality_report(results: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Pass rate and overall state (healthy without failures, else degraded) of check results."""
    passed, failed = F.count_if(F.col("status") == "pass"), F.count_if(F.col("status") == "fail")
    rate = round_half_up(passed / F.greatest(passed + failed, F.lit(1)) * 100, 1)
    return results.groupBy(*by).agg(
        (passed + failed).alias("total_checks"),
        passed.alias("passed"),
        failed.alias("failed"),
        F.count_if(F.col("status") == "warn").alias("warnings"),
        rate.alias("pass_rate"),
        F.when(passed + failed == 0, "no_data").when(failed == 0, "healthy").otherwise("degraded").alias("status"),
    )


def result_log(results: DataFrame, layer: str, checked_at: Column) -> DataFrame:
    """Per layer and table: counts plus the details as a JSON array, ready to append to a log table."""
    return results.groupBy("table_name").agg(
        F.lit(layer).alias("layer"),
        checked_at.alias("checked_at"),
        F.count_if(F.col("status") == "pass").alias("passed"),
        F.count_if(F.col("status") == "fail").alias("failed"),
        F.count_if(F.col("status") == "warn").alias("warnings"),
        # one entry per rule of the table, a handful by construction
        F.to_json(F.array_sort(F.collect_list(F.struct("rule", "observed", "status")))).alias("details_json"),
    )


def new_failures(log: DataFrame, cursor: Column) -> DataFrame:
    """Failures logged after the cursor, per layer."""
    recent = log.filter((F.col("checked_at") > cursor) & (F.col("failed") > 0))
    return recent.groupBy("layer").agg(F.sum("failed").alias("failed"), F.max("checked_at").alias("last_checked_at"))


def sample_suspicious(
    df: DataFrame,
    key: str,
    n: int,
    score: str,
    changes: Sequence[str] = (),
    pillars: Sequence[str] = (),
    seed: int = 42,
    extremes: tuple[float, float] = (10, 98),
    large_change: float = 25,
    mismatch: float = 20,
) -> DataFrame:
    """Review sample of `n` rows: extreme scores (up to a third), large changes (a third),
    composite far from its pillars (a quarter), the rest at random.

    Order inside a stratum is the md5 of key and seed, so the sample is reproducible;
    every stratum is a top-n, and nothing larger than `n` rows per stratum is moved.
    """
    draw = F.md5(F.concat_ws("#", F.col(key).cast("string"), F.lit(str(seed))))
    strata: list[tuple[str, Column, int]] = [
        ("extreme", (F.col(score) < extremes[0]) | (F.col(score) > extremes[1]), n // 3)
    ]
    if changes:
        cond = F.lit(False)
        for c in changes:
            cond = cond | F.coalesce(F.abs(F.col(c)) > large_change, F.lit(False))
        strata.append(("large_change", cond, n // 3))
    if pillars:
        present = sum((F.col(p).isNotNull().cast("int") for p in pillars), F.lit(0))
        total = sum((F.coalesce(F.col(p), F.lit(0.0)) for p in pillars), F.lit(0.0))
        strata.append(("inconsistent", F.abs(F.col(score) - total / F.nullif(present, F.lit(0))) > mismatch, n // 4))
    from .windows import dedup_first, topk_per_group

    # One pass finds the rows of all strata. The picks, less than n rows, are stored: the fill reads them again.
    tagged = df.withColumn("_draw", draw)
    hits = [
        F.when(cond, F.struct(F.lit(name).alias("stratum"), F.lit(i).alias("_prio"), F.lit(quota).alias("_quota")))
        for i, (name, cond, quota) in enumerate(strata)
    ]
    found = tagged.select("*", F.inline(F.array_compact(F.array(*hits))))
    best = topk_per_group(found, "_prio", [F.col("_draw"), F.col(key)], max(quota for *_, quota in strata), "_rank")
    # A key picked by two strata counts once, and the fill is drawn from the rows that no stratum picked,
    # so n rows come back wherever df has them.
    picks = dedup_first(best.filter(F.col("_rank") <= F.col("_quota")).drop("_rank", "_quota"), key, [F.col("_prio"), F.col("_draw")])
    picks = materialize(picks, "picks")
    other = F.md5(F.concat_ws("#", F.col(key).cast("string"), F.lit(str(seed + 1))))
    fill = tagged.join(picks.select(F.col(key).alias("_picked")), F.col(key).eqNullSafe(F.col("_picked")), "left_anti").withColumn("_draw", other)
    fill = fill.orderBy("_draw", key).limit(n).withColumn("stratum", F.lit("random")).withColumn("_prio", F.lit(len(strata)))
    unique = dedup_first(picks.unionByName(fill), key, [F.col("_prio"), F.col("_draw")])
    return unique.orderBy("_prio", "_draw", key).limit(n).drop("_prio", "_draw")
