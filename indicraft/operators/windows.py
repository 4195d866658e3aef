"""Latest rows, ordered deduplication, lags and rolling means."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

KeyList = str | Sequence[str]


def _names(keys: KeyList) -> list[str]:
    return [keys] if isinstance(keys, str) else list(keys)


def topk_per_group(df: DataFrame, by: KeyList, order: Sequence[Column], k: int, rank_col: str | None = None) -> DataFrame:
    """First `k` rows of each group in the given order.

    The planner puts a group limit before the shuffle, so every task sends at most
    `k` rows per group however large a group is. `order` should end in a unique column.
    """
    place = F.row_number().over(W.partitionBy(*_names(by)).orderBy(*order))
    out = df.withColumn("_place", place).filter(F.col("_place") <= k)
    return out.withColumnRenamed("_place", rank_col) if rank_col else out.drop("_place")


def latest_per_key(df: DataFrame, keys: KeyList, order: Sequence[str], where: Column | None = None) -> DataFrame:
    """Most recent row per key by the `order` columns (all descending, nulls last)."""
    kept = df if where is None else df.filter(where)
    return topk_per_group(kept, keys, [F.col(c).desc_nulls_last() for c in order], 1)


def dedup_first(df: DataFrame, keys: KeyList, order: Sequence[Column]) -> DataFrame:
    """Keep the first row per key in an explicit order."""
    return topk_per_group(df, keys, order, 1)


def _shifted(df: DataFrame, keys: Sequence[str], period: str, cols: Sequence[str], lags: Sequence[int]) -> DataFrame:
    """Every row once per lag, dated forward to the period that looks back at it."""
    steps = F.explode(F.array(*[F.lit(k) for k in lags])).alias("_lag")
    return df.select(*keys, F.col(period), *cols, steps).withColumn(
        period, (F.col(period) + F.col("_lag")).cast(df.schema[period].dataType)
    )


def lag_features(df: DataFrame, key: KeyList, period: str, cols: Sequence[str], lags: Sequence[int] = (1, 2, 3)) -> DataFrame:
    """`<col>_lag<k>`: the value `k` periods earlier by the period number, null when that period is absent.

    One row per key and period is expected. Rows are dated forward and regrouped on
    (key, period), so a key with a very long history is spread over the cluster
    instead of being sorted in one task.
    """
    keys = _names(key)
    ahead = _shifted(df, keys, period, cols, lags)
    aggs = [F.max(F.when(F.col("_lag") == k, F.col(c))).alias(f"{c}_lag{k}") for c in cols for k in lags]
    return df.join(ahead.groupBy(*keys, period).agg(*aggs), [*keys, period], "left")


def rolling_mean(df: DataFrame, key: KeyList, period: str, cols: Sequence[str], width: int = 3) -> DataFrame:
    """`<col>_mean<width>`: mean over the period and the `width - 1` periods before it, absent ones left out.

    Regroups on (key, period) like `lag_features`.
    """
    keys = _names(key)
    ahead = _shifted(df, keys, period, cols, range(width))
    means = ahead.groupBy(*keys, period).agg(*[F.avg(c).alias(f"{c}_mean{width}") for c in cols])
    return df.join(means, [*keys, period], "left")


def union_tagged(frames: dict[str, DataFrame], tag: str) -> DataFrame:
    """Diagonal union: columns matched by name, absent ones null, origin in `tag`."""
    out: DataFrame | None = None
    for name, frame in frames.items():
        part = frame.withColumn(tag, F.lit(name))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    if out is None:
        raise ValueError("nothing to union")
    return out


def union_by_priority(frames: Sequence[DataFrame], key: KeyList) -> DataFrame:
    """Union where an earlier frame wins when a key occurs in several."""
    tagged = None
    for i, frame in enumerate(frames):
        part = frame.withColumn("_priority", F.lit(i))
        tagged = part if tagged is None else tagged.unionByName(part, allowMissingColumns=True)
    return dedup_first(tagged, key, [F.col("_priority")]).drop("_priority")
