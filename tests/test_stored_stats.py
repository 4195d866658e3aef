"""Stored statistics against whole-table figures."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from indicraft.operators import stored_stats
from indicraft.operators.stored_stats import StatsStore

QS = (0.0, 0.05, 0.5, 0.95, 1.0)


@pytest.fixture(scope="module")
def years():
    rng = np.random.default_rng(9)
    return {y: np.concatenate([rng.normal(y - 2020, 3, 4_000), np.full(3_000, 1.5), rng.integers(0, 9, 500)]) for y in (2021, 2022, 2023)}


def frame(spark, values):
    rows = [(float(v), None if k % 5 else float(v) ** 2) for k, v in enumerate(values)] + [(None, float("nan"))]
    return spark.createDataFrame(rows, "a double, b double")


def want(values, parts):
    a = np.concatenate([values[p] for p in parts])
    b = np.concatenate([values[p][::5] ** 2 for p in parts])
    return {(m, q): np.quantile(x, q) for m, x in (("a", a), ("b", b)) for q in QS}


@pytest.mark.parametrize("margin", [stored_stats.MARGIN, 1e-9])
def test_percentiles_after_increments_equal_full_runs(spark, tmp_path, years, monkeypatch, margin):
    monkeypatch.setattr(stored_stats, "CHUNK_ROWS", 64)
    monkeypatch.setattr(stored_stats, "MARGIN", margin)  # far too narrow brackets have to widen
    store = StatsStore(spark, str(tmp_path / "s"))
    for n, (y, values) in enumerate(years.items(), 1):
        store.add(frame(spark, values), str(y), ["a", "b"])
        if n == 1:
            continue
        got = {(r["metric"], r["q"]): r["value"] for r in store.percentiles(QS).collect()}
        assert got == pytest.approx(want(years, list(years)[:n]), abs=1e-12)
    if margin < 1e-8:
        return
    got = {(r["metric"], r["q"]): r["value"] for r in store.percentiles(QS, ["2021", "2023"]).collect()}
    assert got == pytest.approx(want(years, [2021, 2023]), abs=1e-12)
    store.add(frame(spark, years[2021]), "2022", ["a", "b"])  # replaces a year
    got = {(r["metric"], r["q"]): r["value"] for r in store.percentiles(QS).collect()}
    assert got == pytest.approx(want({**years, 2022: years[2021]}, years), abs=1e-12)


def test_distinct_estimates_merge(spark, tmp_path):
    store = StatsStore(spark, str(tmp_path / "s"))
    for k in range(3):
        store.add(spark.range(k * 10_000, k * 10_000 + 20_000).select(F.col("id").alias("x"), F.lit(None).cast("double").alias("none")), f"p{k}", ["x", "none"])
    rows = store.distinct().collect()
    assert [(r["metric"], r["n"]) for r in rows] == [("x", 60_000)] and abs(rows[0]["n_distinct"] - 40_000) < 1_200
    assert [r["metric"] for r in store.percentiles((0.5,)).collect()] == ["x"]


def test_only_chunks_around_the_bracket_are_opened(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(stored_stats, "CHUNK_ROWS", 500)
    store = StatsStore(spark, str(tmp_path / "s"))
    store.add(spark.range(100_000).select(F.col("id").cast("double").alias("x")), "p", ["x"])
    (_, _, lo, hi), = store._brackets({("x", 0.5): 0.004}, None)
    chunks = store._read("chunks", None)
    assert chunks.count() >= 200 and 0 < chunks.filter((F.col("high") >= lo) & (F.col("low") <= hi)).count() < 12
