import pytest
from pyspark.sql import functions as F

from indicraft.session import scratch_path
from indicraft.streaming import collect_stream, dedup_stream, latest_state, windowed_counts


def _folder(spark, rows_by_file):
    path = scratch_path(spark, "t-in")
    for rows in rows_by_file:
        df = spark.createDataFrame(rows, "id int, t string, v int").withColumn("t", F.col("t").cast("timestamp"))
        df.coalesce(1).write.mode("append").parquet(path)
    return path


def _stream(spark, path):
    return spark.readStream.schema("id int, t timestamp, v int").option("maxFilesPerTrigger", 1).parquet(path)


def test_windows_close_with_the_watermark_and_late_rows_are_dropped(spark):
    path = _folder(
        spark,
        [
            [(1, "2024-01-01 00:10:00", 1), (2, "2024-01-01 05:00:00", 1)],
            [(3, "2024-01-01 09:00:00", 1)],
            [(4, "2024-01-01 00:20:00", 1), (5, "2024-01-01 12:00:00", 1)],
        ],
    )
    counts = windowed_counts(_stream(spark, path), "t", "1 hour", [], "1 hour")
    out = collect_stream(counts, scratch_path(spark, "t-out"), scratch_path(spark, "t-ck"))
    got = {str(r["window_start"]): r["row_count"] for r in out.collect()}
    assert got["2024-01-01 00:00:00"] == 1
    assert "2024-01-01 12:00:00" not in got


def test_duplicates_across_batches(spark):
    path = _folder(spark, [[(1, "2024-01-01 00:00:00", 1)], [(1, "2024-01-01 00:01:00", 2), (2, "2024-01-01 00:02:00", 3)]])
    out = collect_stream(dedup_stream(_stream(spark, path), "id", "t", "1 day"), scratch_path(spark, "t-out"), scratch_path(spark, "t-ck"))
    assert sorted(r["id"] for r in out.collect()) == [1, 2]


@pytest.mark.parametrize("compact_every", [1, 2, 50])
def test_latest_state_over_batches(spark, compact_every):
    path = _folder(
        spark,
        [
            [(1, "2024-01-02 00:00:00", 9)],
            [(1, "2024-01-01 00:00:00", 8), (2, "2024-01-01 00:00:00", 7)],
            [(2, "2024-01-03 00:00:00", 5), (3, "2024-01-01 00:00:00", 1)],
        ],
    )
    out = latest_state(_stream(spark, path), ["id"], ["t"], scratch_path(spark, "t-state"), scratch_path(spark, "t-ck"), compact_every)
    assert sorted((r["id"], r["v"]) for r in out.collect()) == [(1, 9), (2, 5), (3, 1)]
