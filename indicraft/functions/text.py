"""Small text helpers: hashes, joined lines, templates, JSON paths."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from .cleaning import ColumnLike, as_col


def text_hash(c: ColumnLike, n: int = 12) -> Column:
    return F.substring(F.md5(as_col(c)), 1, n)


def prettify(c: ColumnLike) -> Column:
    """`weakest_pillar` → `Weakest Pillar`."""
    return F.initcap(F.replace(as_col(c), F.lit("_"), F.lit(" ")))


def split_list(c: ColumnLike, sep: str = ",") -> Column:
    """Separated text to an array of trimmed items."""
    return F.transform(F.split(as_col(c), sep), lambda x: F.trim(x))


def join_list(c: ColumnLike, sep: str = ",") -> Column:
    return F.array_join(as_col(c), sep)


def json_text(c: ColumnLike, path: str) -> Column:
    """Value at a JSON path; null for bad JSON or a missing path."""
    return F.get_json_object(as_col(c), path)


def record_line(fields: Mapping[str, ColumnLike], sep: str = " | ") -> Column:
    """`Label: value` parts joined by `sep`; missing fields leave no part."""
    parts = [F.concat(F.lit(f"{label}: "), as_col(c).cast("string")) for label, c in fields.items()]
    return F.concat_ws(sep, *parts)


def fill_template(template: str, fields: Mapping[str, tuple[ColumnLike, object]]) -> Column:
    """Fill `{name}` slots; each field carries the default used when it is null."""
    pieces: list[Column] = []
    rest = template
    while rest:
        start = rest.find("{")
        if start < 0:
            pieces.append(F.lit(rest))
            break
        stop = rest.index("}", start)
        if start:
            pieces.append(F.lit(rest[:start]))
        column, default = fields[rest[start + 1 : stop]]
        pieces.append(F.coalesce(as_col(column).cast("string"), F.lit(str(default))))
        rest = rest[stop + 1 :]
    return F.concat(*pieces)
