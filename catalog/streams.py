"""Structured Streaming over the events table."""

from __future__ import annotations

from pyspark.sql import functions as F

from indicraft.session import materialize, scratch_path
from indicraft.sources.registry import severity_rank
from indicraft.streaming import (
    collect_stream,
    dedup_stream,
    failures_by_cursor,
    failures_since_checkpoint,
    ingest_files,
    latest_state,
    rocks_store,
    session_counts,
    silent_sources,
    stale_sources,
    stored_values,
    table_stream,
    windowed_counts,
)

from .base import query, table


def _places(spark, label):
    return scratch_path(spark, label), scratch_path(spark, f"{label}-ck")


@query("stream_file_ingest", "select count(*) as row_count, count(distinct user_id) as users, cast(sum(round(value * 100)) as bigint) as cents, 2::bigint as sources, 0::bigint as second_run from events")
def file_ingest(spark, d):
    """Events as arriving CSV files of two sources; a second run finds nothing new."""
    inbox, (target, checkpoint) = scratch_path(spark, "inbox"), _places(spark, "landed")
    e = table(spark, d, "events").select("event_id", "user_id", "event_type", "value")
    for name, cond in (("alerts", F.col("event_type") == "error"), ("activity", F.col("event_type") != "error")):
        e.filter(cond).write.option("header", "true").mode("append").csv(f"{inbox}/{name}")
    schema = "event_id long, user_id long, event_type string, value double"
    rows = None
    totals = []
    for _ in range(2):
        out = {}
        for name in ("alerts", "activity"):
            out.update(ingest_files(spark, f"{inbox}/{name}", {name: ("*.csv", schema)}, target, checkpoint))
        rows = out["alerts"].withColumn("src", F.lit("a")).unionByName(out["activity"].withColumn("src", F.lit("b")))
        totals.append(rows.count())
    return rows.agg(
        F.count(F.lit(1)).alias("row_count"),
        F.count_distinct("user_id").alias("users"),
        F.sum(F.round(F.col("value") * 100).cast("bigint")).alias("cents"),
        F.count_distinct("src").alias("sources"),
        F.lit(totals[1] - totals[0]).cast("bigint").alias("second_run"),
    )


@query("stream_dedup", "select event_id, user_id, event_type from events")
def dedup(spark, d):
    """Every event arrives twice; one copy survives."""
    e = table(spark, d, "events")
    twice = materialize(e.unionByName(e), "twice")
    folder = twice.inputFiles()[0].rsplit("/", 1)[0]
    stream = spark.readStream.schema(twice.schema).parquet(folder).withColumn("ts", F.col("ts").cast("timestamp"))
    path, ck = _places(spark, "dedup")
    return collect_stream(dedup_stream(stream, "event_id", "ts", "40 days"), path, ck).select("event_id", "user_id", "event_type")


@query(
    "stream_daily_counts",
    """select w as window_start, w + interval 1 day as window_end, severity_rank, count(*) as row_count from (
  select date_trunc('day', ts) as w, case event_type when 'error' then 5 when 'click' then 4 else 1 end as severity_rank, max(ts) over () as newest from events) q
group by w, severity_rank having w + interval 1 day <= max(newest) - interval 2 day""",
)
def daily_counts(spark, d):
    severity = F.when(F.col("event_type") == "error", "Extreme").when(F.col("event_type") == "click", "Severe")
    stream = table_stream(spark, d, "events", ts="ts").withColumn("severity_rank", severity_rank(severity))
    path, ck = _places(spark, "daily")
    return collect_stream(windowed_counts(stream, "ts", "1 day", ["severity_rank"], "2 days"), path, ck)


@query(
    "stream_sliding_counts",
    """select w as window_start, w + interval 2 day as window_end, event_type, count(*) as row_count from (
  select unnest([date_trunc('day', ts), date_trunc('day', ts) - interval 1 day]) as w, event_type, newest from (select *, max(ts) over () as newest from events) e) q
group by w, event_type having w + interval 2 day <= max(newest) - interval 2 day""",
)
def sliding_counts(spark, d):
    path, ck = _places(spark, "sliding")
    stream = table_stream(spark, d, "events", ts="ts")
    return collect_stream(windowed_counts(stream, "ts", "2 days", ["event_type"], "2 days", "1 day"), path, ck)


@query(
    "stream_sessions",
    """with e as (select user_id, ts, max(ts) over () as newest, lag(ts) over (partition by user_id order by ts) as before from events),
g as (select *, sum(case when ts - before > interval 12 hour or before is null then 1 else 0 end) over (partition by user_id order by ts rows unbounded preceding) as n from e)
select min(ts) as session_start, max(ts) + interval 12 hour as session_end, user_id, count(*) as row_count from g group by user_id, n having max(ts) + interval 12 hour <= max(newest) - interval 2 day""",
)
def sessions(spark, d):
    path, ck = _places(spark, "sessions")
    return collect_stream(session_counts(table_stream(spark, d, "events", ts="ts"), "ts", "12 hours", ["user_id"], "2 days"), path, ck)


@query("stream_latest_state", "select user_id, event_id, event_type from events qualify row_number() over (partition by user_id order by ts desc, event_id desc) = 1")
def newest_state(spark, d):
    """Events arrive in two deliveries, the older ones last; the second run continues from the first."""
    e, inbox = table(spark, d, "events"), scratch_path(spark, "arrivals")
    path, ck = _places(spark, "state")
    state = None
    cut = F.lit("2024-01-15 00:00:00").cast("timestamp")
    for part in (e.filter(F.col("ts") >= cut), e.filter(F.col("ts") < cut)):
        part.write.mode("append").parquet(inbox)
        state = latest_state(spark.readStream.schema(e.schema).parquet(inbox), ["user_id"], ["ts", "event_id"], path, ck)
    return state.select("user_id", "event_id", "event_type")


@query(
    "stream_stale_sources",
    "select user_id, max(ts) as last_seen from events group by 1 having epoch_ms(max(ts)) + 86400000 < (select epoch_ms(max(ts)) - 3600000 from events)",
)
def stale(spark, d):
    path, ck = _places(spark, "stale")
    return collect_stream(stale_sources(table_stream(spark, d, "events", ts="ts"), "user_id", "ts", 86_400_000, "1 hour"), path, ck)


@query(
    "stream_stale_nameless_sources",
    "select case when event_type <> 'click' then event_type end as source, max(ts) as last_seen from events group by 1 having epoch_ms(max(ts)) + 1 < (select epoch_ms(max(ts)) - 3600000 from events)",
)
def stale_nameless(spark, d):
    """Sources of which one has no name; it is watched like the others."""
    path, ck = _places(spark, "nameless")
    e = table_stream(spark, d, "events", ts="ts").select(F.when(F.col("event_type") != "click", F.col("event_type")).alias("source"), "ts")
    return collect_stream(stale_sources(e, "source", "ts", 1, "1 hour"), path, ck)


@query("stream_new_failures", "select event_id, user_id from events where event_type = 'error'")
def stream_failures(spark, d):
    path, ck = _places(spark, "failures")
    return failures_since_checkpoint(table_stream(spark, d, "events"), path, ck, F.col("event_type") == "error").select("event_id", "user_id")


def _watch(spark, d):
    """The stream of silent users run to its end, and its checkpoint."""
    path, ck = _places(spark, "silent")
    with rocks_store(spark):
        silent = silent_sources(table_stream(spark, d, "events", ts="ts"), "user_id", "ts", 86_400_000, "1 hour")
        return collect_stream(silent, path, ck), ck


@query(
    "stream_silent_sources",
    "select user_id, max(ts) as last_seen from events group by 1 having epoch_ms(max(ts)) + 86400000 < (select epoch_ms(max(ts)) - 3600000 from events)",
)
def silent(spark, d):
    """Silent users by a timer each in the state store."""
    return _watch(spark, d)[0]


@query(
    "stream_watched_state",
    "select user_id, max(ts) as last_seen from events group by 1 having epoch_ms(max(ts)) + 86400000 >= (select epoch_ms(max(ts)) - 3600000 from events)",
)
def watched(spark, d):
    """Users still watched, read back from the state of the stopped stream."""
    return stored_values(spark, _watch(spark, d)[1], "last").select("user_id", F.timestamp_micros("micros").alias("last_seen"))


@query(
    "stream_failures_by_cursor",
    """with log as (select event_type, ts, (value > 25)::bigint as failed from events), a as (select event_type, sum(failed)::bigint as n, max(ts) as seen from log where failed > 0 and ts < timestamp '2024-01-15' group by 1),
b as (select l.event_type, sum(failed)::bigint as n, max(ts) as seen from log l left join a using (event_type) where failed > 0 and ts >= timestamp '2024-01-10' and (a.seen is null or ts > a.seen) group by 1)
select event_type, n as failed, n as total, seen as last_checked_at from a union all select event_type, b.n, (b.n + coalesce(a.n, 0))::bigint, b.seen from b left join a using (event_type)""",
)
def by_cursor(spark, d):
    """Two deliveries that overlap by five days: what the cursor has passed counts once."""
    e = table(spark, d, "events").select("event_type", F.col("ts").cast("timestamp").alias("ts"), F.when(F.col("value") > 25, 1).otherwise(0).alias("failed"))
    inbox, (path, ck) = scratch_path(spark, "arrivals"), _places(spark, "cursor")
    at = lambda day: F.lit(f"2024-01-{day} 00:00:00").cast("timestamp")
    out = None
    with rocks_store(spark, empty_batches=False):
        for part in (e.filter(F.col("ts") < at("15")), e.filter(F.col("ts") >= at("10"))):
            part.write.mode("append").parquet(inbox)
            log = spark.readStream.schema(e.schema).parquet(inbox)
            out = collect_stream(failures_by_cursor(log, "event_type", "ts", "failed", 86_400_000), path, ck)
    return out.select("event_type", "failed", "total", "last_checked_at")
