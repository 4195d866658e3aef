"""Composite scores: metrics → sub-scores → pillars → weighted composite."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scoring import (
    count_present,
    linear_score,
    normalize_metric,
    penalty_score,
    score_category,
    weighted_score,
)
from ..session import attach_stats
from .bounds import percentile_bounds, quantile_name


@dataclass(frozen=True)
class Metric:
    """How one raw column becomes a 0-100 sub-score.

    kind `bounds` places it between population percentiles, `penalty` turns a flag
    into 0/100, `linear` subtracts `slope` points per unit.
    """

    score: str
    column: str
    kind: str = "bounds"
    invert: bool = False
    slope: float = 1.0


@dataclass(frozen=True)
class ScoreSpec:
    metrics: Sequence[Metric]
    # pillar column → [(sub-score column, weight)]
    pillars: Mapping[str, Sequence[tuple[str, float]]]
    # pillar column → weight in the composite
    weights: Mapping[str, float]
    composite: str = "composite_score"
    quantiles: tuple[float, float] = (0.05, 0.95)
    degenerate: float | None = None
    # pillar or composite column → category column
    categories: Mapping[str, str] = field(default_factory=dict)

    @property
    def bounded_columns(self) -> list[str]:
        return list(dict.fromkeys(m.column for m in self.metrics if m.kind == "bounds"))


def _sub_score(m: Metric, stats: str, spec: ScoreSpec) -> Column:
    if m.kind == "penalty":
        return penalty_score(m.column)
    if m.kind == "linear":
        return linear_score(m.column, m.slope)
    lo, hi = (F.col(f"{stats}.{quantile_name(m.column, q)}") for q in spec.quantiles)
    return normalize_metric(F.col(m.column).cast("double"), lo, hi, m.invert, spec.degenerate)


def _is_scored(m: Metric, stats: str, spec: ScoreSpec) -> Column:
    """Whether a sub-score will hold a value, told from the raw column."""
    if m.kind == "penalty":
        return F.lit(True)
    present = F.col(m.column).isNotNull()
    if m.kind == "linear":
        return present
    return present & F.col(f"{stats}.{quantile_name(m.column, spec.quantiles[0])}").isNotNull()


def _any_pillar(spec: ScoreSpec, stats: str) -> Column:
    """Whether a row will get a composite.

    Stated on raw columns: filtering on the composite itself would make the optimizer
    copy the whole nested score expression into the filter.
    """
    by_score = {m.score: m for m in spec.metrics}
    cond = F.lit(False)
    for parts in spec.pillars.values():
        for score, weight in parts:
            if weight > 0:
                cond = cond | _is_scored(by_score[score], stats, spec)
    return cond


def score_table(df: DataFrame, spec: ScoreSpec, bounds: DataFrame | None = None) -> DataFrame:
    """Add sub-scores, pillar scores, the composite, categories and `pillars_with_data`.

    Rows without any pillar are dropped. `df` is read once for the bounds (unless
    given) and once for the scores: hand in a stored frame when it is costly.
    """
    if bounds is None:
        bounds = percentile_bounds(df, spec.bounded_columns, spec.quantiles)
    out = attach_stats(df, bounds, "_bounds").filter(_any_pillar(spec, "_bounds"))
    out = out.select("*", *[_sub_score(m, "_bounds", spec).alias(m.score) for m in spec.metrics]).drop("_bounds")
    out = out.select("*", *[weighted_score(parts).alias(p) for p, parts in spec.pillars.items()])
    out = out.withColumn(spec.composite, weighted_score(list(spec.weights.items())))
    labels = [score_category(c).alias(name) for c, name in spec.categories.items()]
    return out.select("*", *labels, count_present(*spec.pillars).alias("pillars_with_data"))


def weights_from_table(df: DataFrame, weights: DataFrame, pillars: Sequence[str], out: str) -> DataFrame:
    """Composite with weights read from a table of (pillar, weight), one row per pillar."""
    row = weights.agg(*[F.max(F.when(F.col("pillar") == p, F.col("weight"))).alias(p) for p in pillars])
    joined = attach_stats(df, row, "_w")
    zero = F.lit(0.0)
    total, weight = zero, zero
    for p in pillars:
        total = total + F.coalesce(F.col(p) * F.col(f"_w.{p}"), zero)
        weight = weight + F.when(F.col(p).isNotNull(), F.col(f"_w.{p}")).otherwise(zero)
    from ..functions.cleaning import round_half_up

    return joined.withColumn(out, round_half_up(total / F.nullif(weight, zero), 2)).drop("_w")
