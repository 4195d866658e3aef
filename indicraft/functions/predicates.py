"""Reusable filter conditions."""

from __future__ import annotations

from collections.abc import Sequence
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from .cleaning import ColumnLike, as_col


def null_or_at_least(c: ColumnLike, minimum: float) -> Column:
    col = as_col(c)
    return col.isNull() | (col >= minimum)


def matches_any(needle: str, cols: Sequence[ColumnLike]) -> Column:
    """Case-insensitive substring in any of the columns; `%` and `_` in the needle are literal."""
    escaped = needle.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_")
    cond = F.lit(False)
    for c in cols:
        cond = cond | as_col(c).ilike(f"%{escaped}%")
    return cond


def lacks_text(c: ColumnLike, word: str) -> Column:
    """Text without the word, ignoring case; null rows do not pass."""
    return ~F.lower(as_col(c)).contains(word.lower())


def build_filters(
    equals: dict[str, Any] | None = None,
    at_least: dict[str, Any] | None = None,
    at_most: dict[str, Any] | None = None,
    between: dict[str, tuple[Any, Any]] | None = None,
    member_of: dict[str, Sequence[Any]] | None = None,
    is_true: Sequence[str] = (),
) -> Column:
    """Fold optional conditions into one conjunction; entries set to None are left out.

    The result is an ordinary Column, so Catalyst pushes each part to the scan.
    """
    cond = F.lit(True)
    for name, value in (equals or {}).items():
        if value is not None:
            cond = cond & (F.col(name) == F.lit(value))
    for name, value in (at_least or {}).items():
        if value is not None:
            cond = cond & (F.col(name) >= F.lit(value))
    for name, value in (at_most or {}).items():
        if value is not None:
            cond = cond & (F.col(name) <= F.lit(value))
    for name, bounds in (between or {}).items():
        if bounds is not None:
            cond = cond & F.col(name).between(*bounds)
    for name, values in (member_of or {}).items():
        if values is not None:
            cond = cond & F.col(name).isin(*values)
    for name in is_true:
        cond = cond & F.col(name)
    return cond
