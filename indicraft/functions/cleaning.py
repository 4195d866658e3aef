"""Null rules, lenient casts, guarded arithmetic and code labels."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

ColumnLike = Column | str


def as_col(c: ColumnLike) -> Column:
    return F.col(c) if isinstance(c, str) else c


def round_half_up(c: ColumnLike, digits: int = 2) -> Column:
    """Round half away from zero in decimal arithmetic, back to double.

    Binary doubles such as 1.005 sit just below the tie; going through a
    decimal gives the result a numeric column type would give.
    """
    return F.round(as_col(c).cast("decimal(30,8)"), digits).cast("double")


def lenient(c: ColumnLike, kind: str) -> Column:
    """Cast that yields null on bad text (a plain cast raises in ANSI mode)."""
    return as_col(c).try_cast(kind)


def to_int(c: ColumnLike) -> Column:
    """Numeric to int by rounding, as SQL `::int` does; Spark's own cast truncates."""
    return F.round(as_col(c).try_cast("double"), 0).try_cast("int")


def blank_to_null(c: ColumnLike, *blanks: str) -> Column:
    """Trimmed text; empty text and the listed placeholders become null."""
    trimmed = F.trim(as_col(c))
    return F.when(trimmed.isin("", *blanks), None).otherwise(trimmed)


def tidy_name(c: ColumnLike, default: str = "Unknown") -> Column:
    return F.coalesce(blank_to_null(c), F.lit(default))


def null_sentinels(c: ColumnLike, values: Sequence[Any] = (), negative: bool = False) -> Column:
    """Replace missing-value markers by null: listed values and/or all negatives."""
    col = as_col(c)
    out = col
    if values:
        out = F.when(~col.isin(*values), col)
    if negative:
        out = F.when(out >= 0, out)
    return out


def safe_rate(
    num: ColumnLike,
    den: ColumnLike,
    scale: float = 100,
    digits: int = 2,
    sentinels: Sequence[Any] = (),
) -> Column:
    """`num / den * scale`, null when the denominator is missing, zero or a sentinel."""
    den_col = as_col(den)
    usable = den_col.isNotNull() & ~den_col.isin(0, *sentinels)
    ratio = as_col(num).cast("double") / den_col.cast("double") * F.lit(float(scale))
    return F.when(usable, round_half_up(ratio, digits))


def positive_rate(num: ColumnLike, den: ColumnLike, scale: float, digits: int) -> Column:
    """Rate that needs a denominator above zero (per-100k style)."""
    return F.when(as_col(den) > 0, safe_rate(num, den, scale, digits))


def sum_present(*cols: ColumnLike) -> Column:
    """Row-wise sum that counts missing parts as zero."""
    total = F.lit(0.0)
    for c in cols:
        total = total + F.coalesce(as_col(c).cast("double"), F.lit(0.0))
    return total


def code_label(c: ColumnLike, mapping: Mapping[Any, str], default: str | None = None) -> Column:
    """Code to label with one map lookup; unknown or null codes give `default`."""
    pairs = [F.lit(x) for kv in mapping.items() for x in kv]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), as_col(c)), F.lit(default))


def yes_no(c: ColumnLike, yes: Any = 1, no: Any = 2) -> Column:
    """Three-valued flag: yes code → true, no code → false, anything else → null."""
    col = as_col(c)
    return F.when(col == yes, True).when(col == no, False)


def flag_on(c: ColumnLike, on: Any = 1) -> Column:
    """Two-valued flag: missing counts as off."""
    return F.coalesce(as_col(c), F.lit(0)) == F.lit(on)


def within(c: ColumnLike, lo: float, hi: float) -> Column:
    """Value kept only inside [lo, hi]."""
    col = as_col(c)
    return F.when(col.between(lo, hi), col)


def cap(c: ColumnLike, hi: float) -> Column:
    """Values above `hi` become `hi`; null stays null."""
    col = as_col(c)
    return F.when(col > hi, F.lit(hi)).otherwise(col)


def clamp(c: ColumnLike, lo: float, hi: float) -> Column:
    col = as_col(c)
    return F.when(col.isNotNull(), F.least(F.greatest(col, F.lit(lo)), F.lit(hi)))


def age_days(ts: ColumnLike, as_of: ColumnLike) -> Column:
    """Age of a timestamp in days at an explicit moment."""
    micros = lambda c: F.unix_micros(as_col(c).cast("timestamp"))
    return (micros(as_of) - micros(ts)) / F.lit(86_400_000_000.0)
