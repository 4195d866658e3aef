"""Fixed-width area codes: state (2) + county (3) + tract (6)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .cleaning import ColumnLike, as_col


def pad_code(c: ColumnLike, n: int, truncate: bool = True) -> Column:
    """Left-pad with zeros to `n`. SQL padding cuts over-long input; `truncate=False` keeps it."""
    text = as_col(c).cast("string")
    padded = F.lpad(text, n, "0")
    return padded if truncate else F.when(F.length(text) < n, padded).otherwise(text)


def tract_to_county(c: ColumnLike) -> Column:
    """First five digits of the 11-digit tract code; restores a lost leading zero first."""
    return F.substring(pad_code(c, 11), 1, 5)


def format_code(state: ColumnLike, county: ColumnLike, tract: ColumnLike | None = None, truncate: bool = False) -> Column:
    """Concatenate padded parts; `truncate` cuts over-long parts as SQL padding does."""
    parts = [pad_code(state, 2, truncate), pad_code(county, 3, truncate)]
    if tract is not None:
        parts.append(pad_code(tract, 6, truncate))
    return F.concat(*parts)


def parse_code(c: ColumnLike) -> Column:
    """Split a code into struct<state, county, tract, remainder>.

    11, 5 and 2 characters are the known layouts; any other length keeps the
    text after the state part in `remainder`.
    """
    code = F.trim(as_col(c))
    size = F.length(code)
    known = size.isin(2, 5, 11)
    return F.struct(
        F.substring(code, 1, 2).alias("state"),
        F.when(size.isin(5, 11), F.substring(code, 3, 3)).alias("county"),
        F.when(size == 11, F.substring(code, 6, 6)).alias("tract"),
        F.when(~known, F.substr(code, F.lit(3))).alias("remainder"),
    )


def is_valid_code(c: ColumnLike) -> Column:
    """Two to eleven digits after trimming."""
    return F.trim(as_col(c)).rlike("^[0-9]{2,11}$")


def whole_number_code(c: ColumnLike, n: int) -> Column:
    """Code that was read as a float (1.7031e10) back to padded digits."""
    return pad_code(as_col(c).try_cast("double").try_cast("bigint"), n, truncate=False)
