"""Session set-up, table loading and lineage cuts."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def build_session(app: str = "indicraft", master: str | None = None, **conf: str) -> SparkSession:
    """Session with adaptive execution and UTC clock.

    Shuffle partitions are left to the cluster: AQE coalesces them from the
    configured initial number, so the same code serves a laptop and 1,000 executors.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        # sessions of one task's rows merge before the shuffle, so a busy key sends few rows
        "spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition": "true",
        # call-site capture costs more than planning for expression-heavy frames
        "spark.python.sql.dataFrameDebugging.enabled": "false",
    }
    settings.update(conf)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def load_table(spark: SparkSession, base: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{base}/{name}.parquet")


def scratch_root(spark: SparkSession) -> str:
    """Shared folder for lineage cuts: `spark.checkpoint.dir`.

    Only a session of one machine (master `local[...]`) that sets none gets a temporary folder;
    everywhere else the setting is required.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current
    if not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    chosen = tempfile.mkdtemp(prefix="indicraft-")
    spark.sparkContext.setCheckpointDir(chosen)
    return chosen


def scratch_path(spark: SparkSession, label: str) -> str:
    return f"{scratch_root(spark)}/indicraft/{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str = "stage") -> DataFrame:
    """Write `df` once as Parquet in the shared folder and return a scan of it.

    Used where several later steps read one costly frame: the work runs once,
    lost executors recompute nothing, and every reader prunes columns.
    """
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def held(df: DataFrame, label: str = "held") -> Iterator[DataFrame]:
    """`df` stored in the shared folder while the block runs, removed after it."""
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.parquet(path)
    try:
        yield spark.read.schema(df.schema).parquet(path)
    finally:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def one_row(stats: DataFrame) -> Column:
    """A one-row frame as a struct-valued scalar subquery.

    Global statistics reach every row as a literal: no join, no window over
    the whole table, and Spark raises if the frame ever has two rows.
    """
    return stats.select(F.struct(*[F.col(f"`{c}`") for c in stats.columns]).alias("row")).scalar()


def attach_stats(df: DataFrame, stats: DataFrame, name: str = "stats") -> DataFrame:
    """Add the single row of `stats` to every row of `df` as struct column `name`."""
    return df.withColumn(name, one_row(stats))
