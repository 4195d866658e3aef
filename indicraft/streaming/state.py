"""Per-key state: newest row, staleness timers, failures since the last run."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.windows import latest_per_key


def _finished(spark: SparkSession, path: str, kind: str) -> list[int]:
    """Batch numbers of the completely written folders of one kind."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    folder = hadoop.Path(path)
    fs = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(folder):
        return []
    names = [s.getPath() for s in fs.listStatus(folder)]
    done = [p.getName() for p in names if fs.exists(hadoop.Path(p, "_SUCCESS"))]
    return sorted(int(n.split("-")[1]) for n in done if n.startswith(f"{kind}-"))


def current_state(spark: SparkSession, schema: T.StructType, keys: Sequence[str], order: Sequence[str], path: str, upto: int | None = None) -> DataFrame:
    """Newest row per key: the last snapshot and the batches after it."""
    known = lambda kind: [n for n in _finished(spark, path, kind) if upto is None or n <= upto]
    snapshot = max(known("snapshot"), default=-1)
    parts = [f"{path}/snapshot-{snapshot}"] if snapshot >= 0 else []
    parts += [f"{path}/batch-{n}" for n in known("batch") if n > snapshot]
    if not parts:
        return spark.createDataFrame([], schema)
    return latest_per_key(spark.read.schema(schema).parquet(*parts), keys, order)


def latest_state(stream: DataFrame, keys: Sequence[str], order: Sequence[str], path: str, checkpoint: str, compact_every: int = 50) -> DataFrame:
    """Keep the newest row per key of a stream in a folder, and return that state.

    A batch writes only its own newest rows, under its number, so cost follows the batch
    and a repeated batch replaces itself. Every `compact_every` batches a snapshot folds
    the history, so reading stays bounded too.
    """
    spark, schema = stream.sparkSession, stream.schema

    def merge(batch: DataFrame, batch_id: int) -> None:
        latest_per_key(batch, keys, order).write.mode("overwrite").parquet(f"{path}/batch-{batch_id}")
        if (batch_id + 1) % compact_every == 0:
            folded = current_state(batch.sparkSession, schema, keys, order, path, batch_id)
            folded.write.mode("overwrite").parquet(f"{path}/snapshot-{batch_id}")

    stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return current_state(spark, schema, keys, order, path)


def stale_sources(df: DataFrame, source: str, ts: str, timeout_ms: int, delay: str) -> DataFrame:
    """One row (source, last_seen) for every source silent for longer than the timeout.

    Rows without a time are left out, a null source is watched like any other.
    State per source is a single timestamp; an event-time timer fires once the
    watermark has moved past last_seen + timeout. Each Arrow batch is reduced to one row
    per source before the shuffle, so a busy source costs its task no more than a quiet one.
    """
    kind = df.schema[source].dataType.simpleString()

    def watch(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            (last,) = state.get
            state.remove()
            yield pd.DataFrame({source: [key[0]], "last_seen": [pd.Timestamp(last, unit="us")]})
            return
        last = state.get[0] if state.exists else -(2**62)
        for frame in frames:
            last = max(last, int(frame["micros"].max()))
        state.update((last,))
        state.setTimeoutTimestamp(max(last // 1000 + timeout_ms, state.getCurrentWatermarkMs() + 1))

    def newest(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield frame.dropna(subset=[ts]).groupby(source, as_index=False, dropna=False)[[ts]].max()

    reduced = df.select(source, ts).mapInPandas(newest, f"{source} {kind}, {ts} timestamp")
    watched = reduced.withWatermark(ts, delay).select(source, ts, F.unix_micros(ts).alias("micros"))
    return watched.groupBy(source).applyInPandasWithState(
        watch, f"{source} {kind}, last_seen timestamp", "last bigint", "append", GroupStateTimeout.EventTimeTimeout
    )


def failures_since_checkpoint(results: DataFrame, path: str, checkpoint: str, failed: Column | None = None) -> DataFrame:
    """Append failed checks that arrived since the last run; the checkpoint is the cursor."""
    bad = failed if failed is not None else F.col("failed") > 0
    spark = results.sparkSession

    def keep(batch: DataFrame, batch_id: int) -> None:
        # the batch number names the folder, so a repeated batch replaces its own rows
        batch.filter(bad).write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    results.writeStream.foreachBatch(keep).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(results.schema).option("basePath", path).parquet(path)
