"""State with timers and expiry, and reading it back."""

import pytest
from pyspark.sql import functions as F

from indicraft.session import scratch_path
from indicraft.streaming import collect_stream, failures_by_cursor, rocks_store, silent_sources, stored_values


def test_silence_fires_once_and_the_rest_stays_in_state(spark):
    path, ck, out = (scratch_path(spark, x) for x in ("t-in", "t-ck", "t-out"))
    first = [("a", "2024-01-01 00:00:00"), ("b", "2024-01-01 01:00:00"), (None, "2024-01-01 00:30:00"), ("x", None)]
    for rows in (first, [("b", "2024-01-01 09:00:00"), ("c", "2024-01-01 09:30:00"), ("c", "2024-01-01 09:10:00")]):
        df = spark.createDataFrame(rows, "src string, t string").withColumn("t", F.col("t").cast("timestamp"))
        df.coalesce(1).write.mode("append").parquet(path)
        stream = spark.readStream.schema("src string, t timestamp").parquet(path)
        with rocks_store(spark):
            found = collect_stream(silent_sources(stream, "src", "t", 2 * 3_600_000, "10 minutes"), out, ck)
    assert {(r[0], r[1].hour, r[1].minute) for r in found.collect()} == {("a", 0, 0), (None, 0, 30)} and found.count() == 2
    at = {r[0]: r[1] for r in stored_values(spark, ck, "last").collect()}
    assert set(at) == {"b", "c"} and at["c"] - at["b"] == 30 * 60 * 1_000_000


@pytest.mark.parametrize("again", [False, True])
def test_cursor_counts_what_is_newer(spark, again):
    path, ck, out = (scratch_path(spark, x) for x in ("t-in", "t-ck", "t-out"))
    log = [("gold", "2024-01-02", 2), ("gold", "2024-01-03", 0), ("raw", "2024-01-01", 1), (None, "2024-01-01", 4), ("raw", None, 9)]
    late = [("gold", "2024-01-01", 7), ("gold", "2024-01-05", 3), ("gold", "2024-01-05", 1), ("raw", "2024-01-01", 1)]
    for rows in (log, log if again else late):
        df = spark.createDataFrame(rows, "layer string, at string, failed int").withColumn("at", F.col("at").cast("timestamp"))
        df.write.mode("append").parquet(path)
        stream = spark.readStream.schema("layer string, at timestamp, failed int").parquet(path)
        with rocks_store(spark, empty_batches=False):
            found = collect_stream(failures_by_cursor(stream, "layer", "at", "failed", 3_600_000), out, ck)
    got = sorted([(r[0] or "", r[1], r[2], r[3].day) for r in found.collect()])
    first = [("", 4, 4, 1), ("gold", 2, 2, 2), ("raw", 1, 1, 1)]
    assert got == sorted(first if again else [*first, ("gold", 4, 6, 5)])


def test_settings_come_back(spark):
    names = ("spark.sql.streaming.stateStore.providerClass", "spark.sql.streaming.noDataMicroBatches.enabled")
    before = [spark.conf.get(n, None) for n in names]
    with rocks_store(spark, empty_batches=False):
        assert spark.conf.get(names[1]) == "false"
    assert [spark.conf.get(n, None) for n in names] == before
