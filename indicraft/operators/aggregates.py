"""Grouped summaries. All use partial (map-side) aggregation, so hot groups are cheap."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.cleaning import round_half_up
from .bounds import percentile_bounds


def mean_of(c: str | Column, digits: int | None = None) -> Column:
    out = F.avg(c)
    return out if digits is None else round_half_up(out, digits)


def rollup_stats(
    df: DataFrame,
    by: Sequence[str],
    cols: Sequence[str],
    digits: int = 2,
    stats: Sequence[str] = ("avg", "min", "max", "stddev"),
) -> DataFrame:
    """Row count plus rounded statistics per column: `avg_x`, `min_x`, `max_x`, `stddev_x`, `sum_x`."""
    makers = {"avg": F.avg, "min": F.min, "max": F.max, "stddev": F.stddev, "sum": F.sum}
    aggs = [F.count(F.lit(1)).alias("row_count")]
    for c in cols:
        aggs += [round_half_up(makers[s](F.col(c)), digits).alias(f"{s}_{c}") for s in stats]
    return df.groupBy(*by).agg(*aggs)


def category_counts(df: DataFrame, by: Sequence[str], col: str, values: Mapping[str, str]) -> DataFrame:
    """Rows per category as columns; `values` maps category to output name."""
    return df.groupBy(*by).agg(
        *[F.count_if(F.col(col) == v).alias(name) for v, name in values.items()]
    )


def banded_counts(df: DataFrame, by: Sequence[str], bands: Mapping[str, Column]) -> DataFrame:
    """Rows per condition, and in total."""
    aggs = [F.count_if(cond).alias(name) for name, cond in bands.items()]
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("row_count"), *aggs)


def pivot_measures(
    df: DataFrame,
    by: Sequence[str],
    name: str,
    value: str,
    measures: Mapping[str, str],
    agg: str = "avg",
    digits: int | None = None,
) -> DataFrame:
    """Long measures to wide columns, one conditional aggregate each, in a single pass."""
    maker = {"avg": F.avg, "max": F.max, "min": F.min, "sum": F.sum, "count": F.count}[agg]
    aggs = []
    for measure, out in measures.items():
        cell = maker(F.when(F.col(name) == measure, F.col(value)))
        aggs.append((cell if digits is None else round_half_up(cell, digits)).alias(out))
    return df.groupBy(*by).agg(*aggs)


def flag_any(df: DataFrame, by: Sequence[str], flags: Mapping[str, Column]) -> DataFrame:
    """True per group when any row satisfies the condition."""
    return df.groupBy(*by).agg(*[F.bool_or(cond).alias(name) for name, cond in flags.items()])


def share_true(c: str | Column, digits: int = 1) -> Column:
    """Percentage of rows where the flag is set; unknown counts as not set."""
    col = F.col(c) if isinstance(c, str) else c
    return round_half_up(F.avg(F.when(col, 1.0).otherwise(0.0)) * 100, digits)


def distinct_counts(df: DataFrame, cols: Sequence[str], by: Sequence[str] = (), approx: bool = False) -> DataFrame:
    maker = F.approx_count_distinct if approx else F.count_distinct
    return df.groupBy(*by).agg(*[maker(F.col(c)).alias(f"distinct_{c}") for c in cols])


def value_counts(df: DataFrame, *cols: str) -> DataFrame:
    return df.groupBy(*cols).agg(F.count(F.lit(1)).alias("row_count")).orderBy(F.desc("row_count"), *cols)


def distinct_list(df: DataFrame, col: str) -> DataFrame:
    return df.filter(F.col(col).isNotNull()).select(col).distinct().orderBy(col)


def mode_share(df: DataFrame, col: str, digits: int = 2) -> DataFrame:
    """Most frequent value (smallest on ties), of the column's own type, and its share of all rows in percent."""
    counts = df.filter(F.col(col).isNotNull()).groupBy(col).agg(F.count(F.lit(1)).alias("_n"))
    best = F.min_by(F.struct(F.col("_n").alias("n"), F.col(col).alias("value")), F.struct(-F.col("_n"), F.col(col)))
    return counts.agg(best.alias("top"), F.sum("_n").alias("total")).select(
        F.col("top.value").alias("mode_value"),
        F.col("top.n").alias("mode_count"),
        round_half_up(F.col("top.n") / F.col("total") * 100, digits).alias("mode_pct"),
    )


def null_rates(df: DataFrame, cols: Sequence[str] | None = None, digits: int = 2) -> DataFrame:
    """Null count and percentage of every column in one pass, one row per column."""
    names = list(cols or df.columns)
    counted = df.agg(
        F.count(F.lit(1)).alias("_rows"),
        *[F.count_if(F.col(f"`{c}`").isNull()).alias(f"_n{i}") for i, c in enumerate(names)],
    )
    cells = F.array(
        *[F.struct(F.lit(c).alias("column_name"), F.col(f"_n{i}").alias("nulls")) for i, c in enumerate(names)]
    )
    return counted.select("_rows", F.inline(cells)).select(
        "column_name",
        "nulls",
        round_half_up(F.col("nulls") / F.greatest("_rows", F.lit(1)) * 100, digits).alias("null_pct"),
    )


def ordered_series(df: DataFrame, by: Sequence[str], col: str, digits: int = 2) -> DataFrame:
    """Mean and row count per group, ordered by the group columns (trend lines)."""
    return (
        df.groupBy(*by)
        .agg(mean_of(col, digits).alias(f"avg_{col}"), F.count(F.lit(1)).alias("row_count"))
        .orderBy(*by)
    )


def totals(df: DataFrame, sums: Sequence[str] = (), means: Sequence[str] = (), medians: Sequence[str] = (), digits: int = 2) -> DataFrame:
    """One summary row: row count, sums, means and exact medians."""
    aggs = [F.count(F.lit(1)).alias("row_count")]
    aggs += [round_half_up(F.sum(c), digits).alias(f"sum_{c}") for c in sums]
    aggs += [mean_of(c, digits).alias(f"avg_{c}") for c in means]
    out = df.agg(*aggs)
    if medians:
        from ..session import attach_stats

        bounds = percentile_bounds(df, medians, (0.5,))
        out = attach_stats(out, bounds, "_m")
        for c in medians:
            out = out.withColumn(f"median_{c}", round_half_up(F.col(f"_m.{c}_p50"), digits))
        out = out.drop("_m")
    return out


def percentile_rollup(df: DataFrame, by: Sequence[str], col: str, qs: Sequence[float] = (0.1, 0.5, 0.9), digits: int = 2) -> DataFrame:
    """Exact percentiles of one column per group."""
    wide = percentile_bounds(df, [col], qs, by)
    return wide.select(*by, *[round_half_up(F.col(c), digits).alias(c) for c in wide.columns if c not in by])


def deviation_from_group_mean(df: DataFrame, by: Sequence[str], col: str, out: str, digits: int = 2) -> DataFrame:
    """Difference of each row from the mean of its group."""
    means = df.groupBy(*by).agg(F.avg(col).alias("_mean"))
    return df.join(means, list(by), "left").withColumn(out, round_half_up(F.col(col) - F.col("_mean"), digits)).drop("_mean")
