"""Checks measured by the write against checks that scan, and column tests with parents."""

import pytest
from pyspark.sql import functions as F

from indicraft.operators import checked_write as cw
from indicraft.operators.quality import Check, run_checks
from indicraft.plans.suites import Parent, run_column_tests

CHECKS = [
    Check("row_count", warn=("<", 10)),
    Check("missing_percent", "x", warn=(">", 5)),
    Check("invalid_count", "x", fail=(">", 0), options={"low": 0, "high": 50}),
    Check("avg", "x", warn=("not between", (20, 30))),
    Check("stddev", "x", fail=("<", 1)),
    Check("duplicate_count", "id", fail=(">", 0)),
    Check("duplicate_count", "name", fail=(">", 0)),
    Check("distinct_count", "name", fail=("<", 3)),
    Check("freshness", "t", warn=(">", 1)),
]
COLS = ("check_name", "column_name", "value", "status")


def frame(spark, n, repeats=2):
    d = spark.range(n).select(
        "id",
        F.when(F.col("id") % 7 > 0, F.col("id") % 60).cast("double").alias("x"),
        # an empty name is a name, a missing one is none
        F.when(F.col("id") % 5 > 0, F.when(F.col("id") % 5 == 1, "").otherwise((F.col("id") / repeats).cast("long").cast("string"))).alias("name"),
        F.lit("2024-01-01").cast("timestamp").alias("t"),
    )
    return d


@pytest.mark.parametrize("n", [0, 1, 1_000])
def test_equals_checks_by_scan(spark, tmp_path, n):
    df, as_of = frame(spark, n), F.lit("2024-01-05").cast("timestamp")
    done = cw.write_checked(df, str(tmp_path / "t"), CHECKS, as_of)
    assert done.results.select(*COLS).collect() == run_checks(df, CHECKS, as_of).collect()
    assert done.table.count() == n and done.failed == (run_checks(df, CHECKS, as_of).filter("status = 'fail'").count() > 0)


def test_source_runs_once(spark, tmp_path):
    runs = spark.sparkContext.accumulator(0)

    def counted(batches):
        runs.add(1)
        yield from batches

    df = frame(spark, 400).repartition(4).mapInPandas(counted, "id long, x double, name string, t timestamp")
    done = cw.write_checked(df, str(tmp_path / "t"), CHECKS, F.current_timestamp())
    how = {r["check_name"]: r["measured_by"] for r in done.results.collect()}
    assert runs.value == 4
    assert how["avg(x)"] == "write" and how["duplicate_count(id)"] == "sketch" and how["duplicate_count(name)"] == "key column"


def test_many_keys_are_settled_by_the_sketch_or_counted(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(cw, "SKETCH_BITS", 8)  # 256 keys are exact
    df = spark.range(5_000).select((F.col("id") % 4_000).alias("k"))
    checks = [Check("distinct_count", "k", fail=("<", 100)), Check("distinct_count", "k", fail=("<", 4_001)), Check("distinct_count", "k", warn=("=", 4_000)), Check("duplicate_count", "k", fail=(">", 0))]
    far, near, equal, repeated = cw.write_checked(df, str(tmp_path / "t"), checks).results.collect()
    assert far["measured_by"] == "sketch" and far["status"] == "pass" and abs(far["value"] - 4_000) < 6 * 4_000 / 16
    assert (near["measured_by"], near["value"], near["status"]) == ("key column", 4_000.0, "fail")
    assert (equal["measured_by"], equal["status"]) == ("key column", "warn")
    assert (repeated["value"], repeated["status"]) == (1_000.0, "fail")


def test_existing_tables_are_kept_unless_told(spark, tmp_path):
    path = str(tmp_path / "t")
    cw.write_checked(frame(spark, 10), path, CHECKS[:1])
    with pytest.raises(Exception, match="already exists"):
        cw.write_checked(frame(spark, 5), path, CHECKS[:1])
    again = cw.write_checked(frame(spark, 5), path, CHECKS[:1], overwrite=True, partition_by=["x"])
    assert again.table.count() == 5 and again.results.first()["value"] == 5.0


def test_parents(spark):
    tables = {"child": spark.createDataFrame([(1,), (2,), (2,), (9,), (None,)], "k int"), "parent": spark.createDataFrame([(1,), (2,), (None,)], "p int")}
    tests = {"child": [Check("missing_count", "k", fail=(">", 0)), Parent("k", "parent", "p"), Parent("k", "absent", "p")], "nowhere": [Parent("k", "parent", "p")]}
    got = {r["check_name"]: (r["value"], r["status"]) for r in run_column_tests(tables, tests).collect()}
    assert got == {"missing_count(k)": (1.0, "fail"), "orphan_count(k)": (1.0, "fail")}
