"""Registration and shared inputs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def query(name: str, sql: str | None = None):
    """Register a query and, where SQL can express it, its oracle."""

    def add(fn: Callable[[SparkSession, str], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql.strip()
        return fn

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """Run an input derivation that is plain SQL in both engines on the Parquet tables."""
    names = {t: f"parquet.`{sf_dir}/{t}.parquet`" for t in TABLES}
    return spark.sql(sql.format(**names))


def duck(sql: str) -> str:
    """The same derivation as a sub-select over the registered views."""
    return "(" + sql.format(**{t: t for t in TABLES}) + ")"


def rnd(expr: str, digits: int = 2) -> str:
    """SQL for rounding half up in decimal arithmetic, as the operators do."""
    return f"cast(round(cast({expr} as decimal(30,8)), {digits}) as double)"
