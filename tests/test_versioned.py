"""The versioned table against dictionaries."""

import random

import pytest
from pyspark.sql import functions as F

from indicraft.sources.versioned import VersionedTable, WriteConflict

COLUMNS = "k long, part string, v double"


def rows(df):
    return {(r["k"], r["part"]): r["v"] for r in df.collect()}


def test_merges_equal_dictionaries_and_touch_only_their_buckets(spark, tmp_path):
    rng = random.Random(8)
    table = VersionedTable(spark, str(tmp_path / "t"), ["k", "part"], buckets=8)
    state = {(k, "ab"[k % 2]): float(k) for k in range(200)}
    make = lambda d: spark.createDataFrame([(*k, v) for k, v in d.items()], COLUMNS)
    history = [dict(state)]
    table.create(make(state))
    for n in range(3):
        change = {(k, "ab"[k % 2]): -1.0 * n - k for k in rng.sample(range(260), 2)}
        before = {r["path"]: (r["bucket"], r["bytes"], r["modified"]) for r in table.manifest().collect()}
        hit = {r[0] for r in table._bucketed(make(change)).select("_bucket").collect()}
        assert table.merge(make(change)) == n + 2
        after = {r["path"]: (r["bucket"], r["bytes"], r["modified"]) for r in table.manifest().collect()}
        assert {p: x for p, x in before.items() if x[0] not in hit} == {p: x for p, x in after.items() if x[0] not in hit}
        assert not {p for p in before if before[p][0] in hit} & after.keys()
        state |= change
        history.append(dict(state))
    for v, want in enumerate(history, 1):
        assert rows(table.read(v)) == want
    assert rows(table.read()) == state and table.versions() == [1, 2, 3, 4]
    gone = table.vacuum(keep=1)
    assert gone > 0 and table.versions() == [4] and rows(table.read()) == state


def test_deletes_new_columns_and_null_keys(spark, tmp_path):
    table = VersionedTable(spark, str(tmp_path / "t"), ["k"], buckets=4)
    table.create(spark.createDataFrame([(1, 1.0), (2, 2.0), (None, 0.0)], "k long, v double"))
    table.merge(spark.createDataFrame([(2, 9.0, "new"), (3, 3.0, None), (None, 5.0, None)], "k long, v double, note string"))
    got = sorted((r["k"] or 0, r["v"], r["note"]) for r in table.read().collect())
    assert got == [(0, 0.0, None), (0, 5.0, None), (1, 1.0, None), (2, 9.0, "new"), (3, 3.0, None)]
    table.merge(spark.createDataFrame([(1, None), (7, None)], "k long, v double"), delete=F.col("v").isNull())
    assert sorted(r["k"] or 0 for r in table.read().collect()) == [0, 0, 2, 3]


def test_conflicts_and_empty_tables(spark, tmp_path):
    table = VersionedTable(spark, str(tmp_path / "t"), ["k"], buckets=4)
    with pytest.raises(ValueError):
        table.read()
    table.create(spark.createDataFrame([], "k long, v double"))
    assert table.read().count() == 0
    with pytest.raises(WriteConflict):
        table.create(spark.createDataFrame([(1, 1.0)], "k long, v double"))
    table.merge(spark.createDataFrame([(1, 1.0)], "k long, v double"))
    table.merge(spark.createDataFrame([], "k long, v double"))
    assert [tuple(r) for r in table.read().collect()] == [(1, 1.0)] and table.versions() == [1, 2, 3]
