"""Ranks and percentiles at several levels without a global sort.

`rank() over (order by ...)` moves the whole table into one task. A rank only
depends on how many rows hold each score, so the rows are first counted per
score; running sums over range slices of those counts are joined back.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.cleaning import round_half_up
from ..session import materialize


def _prefix_counts(counts: DataFrame, keys: Sequence[str], score: str, descending: bool, out: str) -> DataFrame:
    """Rows ahead of each score within its keys and the keys' `_total`, for any number of distinct scores.

    Counts are range-partitioned on (keys, score) and written once, so the slice
    number stays fixed; running sums stay inside a slice and one small table of
    slice totals per key carries the offsets. No task sees a whole group.
    """
    edge = F.col(score).desc_nulls_last() if descending else F.col(score).asc_nulls_first()
    slices = int(counts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = materialize(
        counts.repartitionByRange(slices, *[F.col(k) for k in keys], edge).withColumn("_slice", F.spark_partition_id()),
        "rank",
    )
    inside = W.partitionBy("_slice", *keys).orderBy(edge).rowsBetween(W.unboundedPreceding, -1)
    sums = placed.groupBy("_slice", *keys).agg(F.sum("_n").alias("_slice_n"))
    earlier = W.partitionBy(*keys).orderBy("_slice")
    before = F.sum("_slice_n").over(earlier.rowsBetween(W.unboundedPreceding, -1))
    total = F.sum("_slice_n").over(earlier.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    offsets = sums.withColumns({"_before": F.coalesce(before, F.lit(0)), "_total": total}).drop("_slice_n")
    running = placed.withColumn("_inside", F.coalesce(F.sum("_n").over(inside), F.lit(0)))
    return null_safe_join(running, offsets, ["_slice", *keys]).select(
        *keys, score, "_n", (F.col("_inside") + F.col("_before")).alias(out), "_total"
    )


def rank_levels(
    df: DataFrame,
    score: str,
    levels: Mapping[str, Sequence[str]] | None = None,
    percentiles: Sequence[str] | None = None,
) -> DataFrame:
    """Add `<level>_rank`, `<level>_total` and `<level>_percentile` for each level.

    Nulls rank last. The counts of all levels are one long table (level, keys, score), cut into range slices and
    stored once; the ranks reach the rows through a single join on (all keys, score).
    """
    levels = levels or {"national": [], "state": ["state_abbr"], "county": ["county_fips"]}
    wanted = set(levels if percentiles is None else percentiles)
    keys = list(dict.fromkeys(k for ks in levels.values() for k in ks))
    kinds = {k: df.schema[k].dataType for k in keys}
    counts = df.groupBy(*keys, score).agg(F.count(F.lit(1)).alias("_n"))
    # every count once per level, keys that the level does not have as nulls
    cells = [
        F.struct(F.lit(i).alias("_level"), *[(F.col(k) if k in level_keys else F.lit(None).cast(kinds[k])).alias(k) for k in keys])
        for i, level_keys in enumerate(levels.values())
    ]
    spread = counts.select(F.explode(F.array(*cells)).alias("_c"), score, "_n").select("_c.*", score, "_n")
    merged = spread.groupBy("_level", *keys, score).agg(F.sum("_n").alias("_n"))
    ahead = _prefix_counts(merged, ["_level", *keys], score, True, "_above")
    below = F.col("_total") - F.col("_above") - F.col("_n")
    share = F.when(F.col("_total") > 1, below / (F.col("_total") - 1)).otherwise(F.lit(0.0))
    ranked = counts.drop("_n")
    for i, (level, level_keys) in enumerate(levels.items()):
        found = [(F.col("_above") + 1).alias(f"{level}_rank"), F.col("_total").alias(f"{level}_total")]
        if level in wanted:
            found.append(share.alias(f"{level}_percentile"))
        table = ahead.filter(F.col("_level") == i).select(*level_keys, score, *found)
        ranked = null_safe_join(ranked, table, [*level_keys, score])
    return null_safe_join(df, ranked, [*keys, score])


def rank_columns(df: DataFrame, cols: Mapping[str, str]) -> DataFrame:
    """Whole-table rank of several score columns (`column → output name`), nulls last.

    One unpivoted count, ranked by range slices, gives the ranks of all columns.
    """
    cells = F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value")) for c in cols])
    counts = df.select(F.inline(cells)).groupBy("metric", "value").agg(F.count(F.lit(1)).alias("_n"))
    ranks = materialize(_prefix_counts(counts, ["metric"], "value", True, "_above"), "rank")
    out = df
    for c, name in cols.items():
        one = ranks.filter(F.col("metric") == c).select(F.col("value").alias(c), (F.col("_above") + 1).alias(name))
        out = null_safe_join(out, one, [c])
    return out


def percent(c: str | Column, digits: int = 1) -> Column:
    return round_half_up((F.col(c) if isinstance(c, str) else c) * 100, digits)


def null_safe_join(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Inner-like left join that also matches null keys, keeping the left key columns."""
    renamed = right
    for i, k in enumerate(keys):
        renamed = renamed.withColumnRenamed(k, f"_k{i}")
    cond = F.lit(True)
    for i, k in enumerate(keys):
        cond = cond & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    return left.join(renamed, cond, "left").drop(*[f"_k{i}" for i in range(len(keys))])


def state_ranking(df: DataFrame, by: str, score: str, digits: int = 1) -> DataFrame:
    """Groups ordered by mean score with rank; the group table is small by nature of the key."""
    grouped = df.groupBy(by).agg(
        F.count(F.lit(1)).alias("school_count"),
        round_half_up(F.avg(score), digits).alias("avg_score"),
        round_half_up(F.min(score), digits).alias("min_score"),
        round_half_up(F.max(score), digits).alias("max_score"),
        F.count_if(F.col(score) <= 25).alias("critical_schools"),
    )
    ranked = rank_levels(grouped, "avg_score", {"state": []}, percentiles=[])
    return ranked.drop("state_total").orderBy("state_rank", by)
