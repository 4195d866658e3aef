"""Exact percentiles that never gather a large column in one task.

A sketch brackets each wanted percentile. One aggregate then counts the values between the brackets, with
the smallest and largest of each such region, and those inside one by one; only these counts are sorted.
A bracket is a few ranks of the sketch's error wide, whatever the size of the column. The same steps run at
every size, and their plan does not grow with the number of columns.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import held, materialize
from .ranking import null_safe_join

# Rank error of the sketch is n / accuracy; brackets keep a margin of four times that. Below
# `accuracy` rows the sketch is exact and only the neighbour of its value may be meant, which is noted too.
ACCURACY = 100_000


def _with_edges(df: DataFrame, cols: Sequence[str], qs: Sequence[float], by: Sequence[str], accuracy: int) -> DataFrame:
    """`df` with `_edges`: both ends of the bracket of every column and percentile in turn, the same array in all rows of a group.

    Without groups the array is one row of numbers, which the next pass takes as a literal.
    """
    margin = 4 / accuracy
    ends: list[Column] = []
    for c in cols:
        x = F.col(f"`{c}`").cast("double")
        wanted = sorted({min(max(q + d, 0.0), 1.0) for q in qs for d in (-margin, margin)})
        sketch = F.percentile_approx(x, [float(e) for e in wanted], accuracy)
        low, high = F.min(x), F.max(x)
        for q in qs:
            ends.append(low if q - margin <= 0 else sketch[wanted.index(q - margin)])
            ends.append(high if q + margin >= 1 else sketch[wanted.index(q + margin)])
    row = F.array(*ends).alias("_edges")
    if by:
        return null_safe_join(df, df.groupBy(*by).agg(row), by)
    return df.withColumn("_edges", F.array(*[F.lit(e).cast("double") for e in df.agg(row).first()[0]]))


def _narrow(df: DataFrame, cols: Sequence[str], by: Sequence[str]) -> DataFrame:
    return df.select(*[F.col(f"`{c}`") for c in dict.fromkeys([*by, *cols])])


def _at_ranks(df: DataFrame, cols: Sequence[str], qs: Sequence[float], by: Sequence[str], accuracy: int) -> DataFrame:
    """`by..., metric_at, q_at, value`: one row per group and percentile, null where a group has no value.

    The edges cut the line into regions, of which each value outside all brackets adds to one count and each
    value inside is counted by itself. Wanted ranks fall on a value inside or on the end of a region beside it.
    """
    cells = F.posexplode(F.array(*[F.col(f"`{c}`").cast("double") for c in cols])).alias("metric_at", "_x")
    x = F.col("_x")
    region, inside = F.lit(0), F.lit(False)
    for j in range(len(qs)):
        low, high = (F.get("_edges", F.col("metric_at") * (2 * len(qs)) + (2 * j + end)) for end in (0, 1))
        region = region + (x >= low).cast("int") + (x > high).cast("int")
        inside = inside | ((x >= low) & (x <= high))
    keys = [*by, "metric_at"]
    counted = (
        _with_edges(df, cols, qs, by, accuracy)
        .select(*by, "_edges", cells)
        .groupBy(*keys, region.alias("_region"), F.when(inside, x).alias("_value"))
        .agg(F.count(x).alias("_n"), F.min(x).alias("_low"), F.max(x).alias("_high"))
    )
    group = W.partitionBy(*keys)
    running = counted.withColumn("_upto", F.sum("_n").over(group.orderBy("_low").rowsBetween(W.unboundedPreceding, W.currentRow)))
    running = running.withColumn("_rows", F.sum("_n").over(group))
    found = []
    for j, q in enumerate(qs):
        place = F.lit(float(q)) * (F.col("_rows") - 1)
        for label, side in (("low", F.floor), ("high", F.ceil)):
            rank = side(place)
            value = F.coalesce("_value", F.when(rank == F.col("_upto") - 1, F.col("_high")).otherwise(F.col("_low")))
            found.append(F.max(F.when((rank >= F.col("_upto") - F.col("_n")) & (rank < F.col("_upto")), value)).alias(f"_{label}{j}"))
    cells_at = []
    for j, q in enumerate(qs):
        place, low, high = F.lit(float(q)) * (F.col("_rows") - 1), F.col(f"_low{j}"), F.col(f"_high{j}")
        cells_at.append(F.struct(F.lit(j).alias("q_at"), (low + (high - low) * (place - F.floor(place))).alias("value")))
    return running.groupBy(*keys).agg(F.first("_rows").alias("_rows"), *found).select(*keys, F.inline(F.array(*cells_at)))


def quantile_table(
    df: DataFrame,
    cols: Sequence[str],
    qs: Sequence[float],
    by: Sequence[str] = (),
    accuracy: int = ACCURACY,
) -> DataFrame:
    """Long result `by..., metric, q, value` with linear interpolation between neighbours.

    Columns without any value give no row. With `by`, brackets are found per group,
    so one group may hold most of the rows.
    """
    names = F.array(*[F.lit(c) for c in cols])
    points = F.array(*[F.lit(float(q)) for q in qs])
    with held(_narrow(df, cols, by), "percentiles") as narrow:
        found = _at_ranks(narrow, cols, qs, by, accuracy).filter(F.col("value").isNotNull())
        return materialize(found.select(*by, names[F.col("metric_at")].alias("metric"), points[F.col("q_at")].alias("q"), "value"), "quantiles")


def quantile_name(col: str, q: float) -> str:
    """`score`, 0.05 → `score_p5`."""
    return f"{col}_p{q * 100:g}".replace(".", "_")


def percentile_bounds(
    df: DataFrame,
    cols: Sequence[str],
    qs: Sequence[float] = (0.05, 0.95),
    by: Sequence[str] = (),
    approx: bool = False,
    accuracy: int = ACCURACY,
) -> DataFrame:
    """All percentiles of all columns, one row (per group): `<col>_p5`, `<col>_p95`, ...

    Exact by default, null where a group has no value; every group of the input has a row.
    The needed columns are stored for the two passes and removed again, so whatever computes `df` runs once.
    The row of a result without groups is read back, a result by group is stored. `approx=True` takes the sketch values in a single pass.
    """
    if approx:
        aggs = []
        for c in cols:
            values = F.percentile_approx(f"`{c}`", [float(q) for q in qs], accuracy)
            aggs += [values[i].alias(quantile_name(c, q)) for i, q in enumerate(qs)]
        return df.groupBy(*by).agg(*aggs)
    with held(_narrow(df, cols, by), "percentiles") as narrow:
        table = _at_ranks(narrow, cols, qs, by, accuracy)
        names = {(i, j): quantile_name(c, q) for i, c in enumerate(cols) for j, q in enumerate(qs)}
        if by:
            at = lambda i, j: (F.col("metric_at") == i) & (F.col("q_at") == j)
            return materialize(table.groupBy(*by).agg(*[F.max(F.when(at(*k), F.col("value"))).alias(name) for k, name in names.items()]), "percentiles")
        found = {(r["metric_at"], r["q_at"]): r["value"] for r in table.collect()}
    return df.sparkSession.range(1).select(*[F.lit(found.get(k)).cast("double").alias(name) for k, name in names.items()])


def grouped_median(df: DataFrame, by: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """Exact median of every column per group, one pass for all columns."""
    table = percentile_bounds(df, cols, (0.5,), by)
    return table.select(*by, *[F.col(quantile_name(c, 0.5)).alias(c) for c in cols])
