"""Scores as Columns: normalisation, weighted means, categories, extremes."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .cleaning import ColumnLike, as_col, round_half_up

# Lower bound of each category, best first.
CATEGORY_CUTS = ((76, "Thriving"), (51, "Moderate"), (26, "At Risk"))
CATEGORY_FLOOR = "Critical"
CATEGORY_MISSING = "Insufficient Data"

# Upper bound of each serving band, worst first.
BAND_CUTS = ((25, "Critical"), (50, "At Risk"), (75, "Moderate"))
BAND_TOP = "Thriving"


def normalize_metric(
    c: ColumnLike,
    lo: ColumnLike,
    hi: ColumnLike,
    invert: bool = False,
    degenerate: float | None = None,
) -> Column:
    """Place a metric on 0-100 between two bounds, two decimals, null stays null.

    At or below `lo` is 0, at or above `hi` is 100 (swapped when `invert`). With
    lo = hi every value sits on the lower bound; `degenerate` overrides that case.
    """
    x, low, high = as_col(c), as_col(lo), as_col(hi)
    share = (x - low) / F.nullif(high - low, F.lit(0.0))
    at_low, at_high = (100.0, 0.0) if invert else (0.0, 100.0)
    inner = round_half_up((F.lit(1.0) - share if invert else share) * 100.0, 2)
    out = F.when(x.isNull(), F.lit(None).cast("double"))
    if degenerate is not None:
        out = out.when(low == high, F.lit(float(degenerate)))
    return out.when(x <= low, F.lit(at_low)).when(x >= high, F.lit(at_high)).otherwise(inner)


def weighted_score(parts: Sequence[tuple[ColumnLike, float]], digits: int = 2) -> Column:
    """Weighted mean of the present parts, weights rescaled to them; null when none is present."""
    zero = F.lit(0.0)
    total, weight = zero, zero
    for c, w in parts:
        col = as_col(c)
        total = total + F.coalesce(col * F.lit(float(w)), zero)
        weight = weight + F.when(col.isNotNull(), F.lit(float(w))).otherwise(zero)
    return round_half_up(total / F.nullif(weight, zero), digits)


def score_category(c: ColumnLike) -> Column:
    """Label by lower cut-offs 76 / 51 / 26; null is its own label."""
    col = as_col(c)
    out = F.when(col.isNull(), CATEGORY_MISSING)
    for cut, label in CATEGORY_CUTS:
        out = out.when(col >= cut, label)
    return out.otherwise(CATEGORY_FLOOR)


def score_band(c: ColumnLike) -> Column:
    """Label by upper cut-offs 25 / 50 / 75, the form the serving queries use."""
    col = as_col(c)
    out = F.when(col.isNull(), F.lit(None).cast("string"))
    for cut, label in BAND_CUTS:
        out = out.when(col <= cut, label)
    return out.otherwise(BAND_TOP)


def penalty_score(flag: ColumnLike) -> Column:
    """0 when the flag is set, otherwise 100; an unknown flag counts as unset."""
    return F.when(as_col(flag), F.lit(0.0)).otherwise(F.lit(100.0))


def linear_score(c: ColumnLike, slope: float = 1.0) -> Column:
    """100 minus `slope` per unit, never below 0; null stays null."""
    col = as_col(c)
    return F.when(col.isNotNull(), F.greatest(F.lit(0.0), F.lit(100.0) - col * F.lit(float(slope))))


def count_present(*cols: ColumnLike) -> Column:
    """How many of the columns hold a value."""
    total = F.lit(0)
    for c in cols:
        total = total + as_col(c).isNotNull().cast("int")
    return total


def count_true(*conds: Column) -> Column:
    """How many conditions hold; an unknown condition counts as not holding."""
    total = F.lit(0)
    for cond in conds:
        total = total + F.coalesce(cond.cast("int"), F.lit(0))
    return total


def argmin_label(cols: Mapping[str, ColumnLike], null_as: float) -> Column:
    """Label of the smallest value; on ties the earlier label wins."""
    entries = [
        F.struct(F.coalesce(as_col(c).cast("double"), F.lit(float(null_as))), F.lit(i), F.lit(label))
        for i, (label, c) in enumerate(cols.items())
    ]
    return F.array_min(F.array(*entries))["col3"]


def argmax_label(cols: Mapping[str, ColumnLike], null_as: float) -> Column:
    """Label of the largest value; on ties the earlier label wins."""
    entries = [
        F.struct(F.coalesce(as_col(c).cast("double"), F.lit(float(null_as))), F.lit(-i), F.lit(label))
        for i, (label, c) in enumerate(cols.items())
    ]
    return F.array_max(F.array(*entries))["col3"]


def spread(cols: Sequence[ColumnLike], null_low: float = 0.0, null_high: float = 100.0) -> Column:
    """Best minus worst, missing values taken as the far end of the scale."""
    top = F.greatest(*[F.coalesce(as_col(c), F.lit(null_low)) for c in cols])
    bottom = F.least(*[F.coalesce(as_col(c), F.lit(null_high)) for c in cols])
    return top - bottom


def direction(c: ColumnLike, threshold: float, invert: bool = False) -> Column:
    """Improving / Declining beyond ±threshold, otherwise (and for null) Stable."""
    col = as_col(c)
    up, down = ("Declining", "Improving") if invert else ("Improving", "Declining")
    return F.when(col > threshold, up).when(col < -threshold, down).otherwise("Stable")


def signed_label(c: ColumnLike) -> Column:
    """Kind of an anomaly by the sign of its change."""
    col = as_col(c)
    return F.when(col > 0, "improvement").when(col < 0, "decline")


def low_confidence(rate: ColumnLike, coverage: ColumnLike, minimum: float = 60) -> Column:
    """True when the rate is missing or its coverage is below the minimum."""
    return as_col(rate).isNull() | F.coalesce(as_col(coverage) < minimum, F.lit(False))
