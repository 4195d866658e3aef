"""The scalar operators as SQL functions, for users who write SQL.

They are SQL-bodied, so the optimizer inlines them like built-in expressions.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

_ROUND = "cast(round(cast({0} as decimal(30, 8)), 2) as double)"


def _placed(inverted: bool) -> str:
    share = "(c - lo) / nullif(hi - lo, 0)"
    low, high = ("100D", "0D") if inverted else ("0D", "100D")
    inner = _ROUND.format(f"(1 - {share}) * 100" if inverted else f"{share} * 100")
    return f"case when c is null then null when c <= lo then {low} when c >= hi then {high} else {inner} end"


def _blend(names: list[str]) -> str:
    top = " + ".join(f"coalesce({n} * w_{n}, 0)" for n in names)
    bottom = " + ".join(f"if({n} is null, 0, w_{n})" for n in names)
    return _ROUND.format(f"({top}) / nullif({bottom}, 0)")


_PILLARS = ["education", "health", "environment", "safety"]
_DEFAULTS = {"education": 0.3, "health": 0.3, "environment": 0.2, "safety": 0.2}

SQL_FUNCTIONS = {
    "pad_code(c string, n int) returns string": "lpad(c, n, '0')",
    "tract_to_county(c string) returns string": "substring(lpad(c, 11, '0'), 1, 5)",
    "normalize_metric(c double, lo double, hi double) returns double": _placed(False),
    "normalize_metric_inverted(c double, lo double, hi double) returns double": _placed(True),
    "composite_score("
    + ", ".join(f"{p} double" for p in _PILLARS)
    + ", "
    + ", ".join(f"w_{p} double default {_DEFAULTS[p]}" for p in _PILLARS)
    + ") returns double": _blend(_PILLARS),
    "score_category(c double) returns string": (
        "case when c is null then 'Insufficient Data' when c >= 76 then 'Thriving' when c >= 51 then 'Moderate' "
        "when c >= 26 then 'At Risk' else 'Critical' end"
    ),
    "haversine_km(lat1 double, lon1 double, lat2 double, lon2 double) returns double": (
        "12742D * asin(least(1D, sqrt(pow(sin(radians(lat2 - lat1) / 2), 2) "
        "+ cos(radians(lat1)) * cos(radians(lat2)) * pow(sin(radians(lon2 - lon1) / 2), 2))))"
    ),
}


def register_sql_functions(spark: SparkSession) -> list[str]:
    """Create the temporary functions and return their names."""
    for signature, body in SQL_FUNCTIONS.items():
        spark.sql(f"create or replace temporary function {signature} return {body}")
    return [s.split("(")[0] for s in SQL_FUNCTIONS]
