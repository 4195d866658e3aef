"""Per-source state in the state store: timers for silence, values that expire, and reading them back."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_EMPTY = "spark.sql.streaming.noDataMicroBatches.enabled"


@contextmanager
def rocks_store(spark: SparkSession, empty_batches: bool = True) -> Iterator[None]:
    """State of the streams started inside the block lives in the RocksDB store, which keeps it outside the heap.

    Timers on event time need batches without rows, which carry the watermark on. State that expires by the
    clock asks for such batches for ever, so a run over what is available ends only with `empty_batches=False`.
    """
    wanted = {_PROVIDER: ROCKS, _EMPTY: str(empty_batches).lower()}
    before = {k: spark.conf.get(k, None) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


class SilenceWatch(StatefulProcessor):
    """One timestamp and one timer per source; emits (source, last_seen) when the timer fires."""

    def __init__(self, source: str, timeout_ms: int) -> None:
        self.source, self.timeout_ms = source, timeout_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "micros bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        known = self.last.get()[0] if self.last.exists() else None
        newest = max((int(frame["micros"].max()) for frame in rows), default=None)
        if newest is not None and (known is None or newest > known):
            self.last.update((newest,))
            for due in list(self.handle.listTimers()):
                self.handle.deleteTimer(due)
            self.handle.registerTimer(max(newest // 1000 + self.timeout_ms, timerValues.getCurrentWatermarkInMs() + 1))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        (last,) = self.last.get()
        self.last.clear()
        yield pd.DataFrame({self.source: [key[0]], "last_seen": [pd.Timestamp(last, unit="us")]})

    def close(self) -> None:
        pass


def _newest(df: DataFrame, source: str, ts: str, delay: str) -> DataFrame:
    """(source, ts, micros), reduced to one row per source and Arrow batch before anything is shuffled."""
    kind = df.schema[source].dataType.simpleString()

    def newest(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield frame.dropna(subset=[ts]).groupby(source, as_index=False, dropna=False)[[ts]].max()

    reduced = df.select(source, ts).mapInPandas(newest, f"`{source}` {kind}, `{ts}` timestamp")
    return reduced.withWatermark(ts, delay).select(source, ts, F.unix_micros(ts).alias("micros"))


def silent_sources(df: DataFrame, source: str, ts: str, timeout_ms: int, delay: str) -> DataFrame:
    """One row (source, last_seen) for every source silent for longer than the timeout.

    As `stale_sources`, on state with timers of its own: start it inside `rocks_store`, and the sources
    still watched can be read from the checkpoint by `stored_values(spark, checkpoint, "last")`.
    Rows without a time are left out; a null source is watched like any other.
    """
    kind = df.schema[source].dataType
    out = T.StructType([T.StructField(source, kind), T.StructField("last_seen", T.TimestampType())])
    watched = _newest(df, source, ts, delay)
    return watched.groupBy(source).transformWithStateInPandas(
        SilenceWatch(source, timeout_ms), outputStructType=out, outputMode="Append", timeMode="EventTime"
    )


class FailureCursor(StatefulProcessor):
    """Failures per layer since the layer's cursor, which is the newest failure passed on so far.

    The count of all failures expires `keep_ms` after the last one, so layers that are retired leave no state.
    """

    def __init__(self, layer: str, keep_ms: int) -> None:
        self.layer, self.keep_ms = layer, keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.cursor = handle.getValueState("cursor", "micros bigint", self.keep_ms)
        self.total = handle.getValueState("total", "failed bigint", self.keep_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        cursor = self.cursor.get()[0] if self.cursor.exists() else None
        total = self.total.get()[0] if self.total.exists() else 0
        fresh, newest = 0, cursor
        for frame in rows:
            late = frame if cursor is None else frame[frame["micros"] > cursor]
            if len(late):
                fresh += int(late["failed"].sum())
                newest = max(int(late["micros"].max()), newest if newest is not None else -(2**62))
        if fresh:
            self.cursor.update((newest,))
            self.total.update((total + fresh,))
            yield pd.DataFrame({self.layer: [key[0]], "failed": [fresh], "total": [total + fresh], "last_checked_at": [pd.Timestamp(newest, unit="us")]})

    def close(self) -> None:
        pass


def failures_by_cursor(log: DataFrame, layer: str, checked_at: str, failed: str, keep_ms: int) -> DataFrame:
    """(layer, failed, total, last_checked_at): failures newer than the layer's cursor, once per run and layer.

    Each batch is summed per layer and time before its rows meet the state; rows at or before the cursor count as
    seen. Start it inside `rocks_store(spark, empty_batches=False)`. State of a layer without failures for `keep_ms` of clock time expires.
    """
    kind = log.schema[layer].dataType
    fields = [(layer, kind), ("failed", T.LongType()), ("total", T.LongType()), ("last_checked_at", T.TimestampType())]
    out = T.StructType([T.StructField(n, k) for n, k in fields])
    bad = log.filter((F.col(failed) > 0) & F.col(checked_at).isNotNull())
    rows = bad.select(layer, F.unix_micros(checked_at).alias("micros"), F.col(failed).cast("bigint").alias("failed"))

    def summed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield frame.groupby([layer, "micros"], as_index=False, dropna=False)[["failed"]].sum()

    reduced = rows.mapInPandas(summed, rows.schema)
    return reduced.groupBy(layer).transformWithStateInPandas(
        FailureCursor(layer, keep_ms), outputStructType=out, outputMode="Append", timeMode="ProcessingTime"
    )


def stored_values(spark: SparkSession, checkpoint: str, name: str) -> DataFrame:
    """(key..., value...) of the value state `name` as of the last committed batch of a stopped or running stream."""
    state = spark.read.format("statestore").option("path", checkpoint).option("stateVarName", name).load()
    return state.select("key.*", "value.*")
