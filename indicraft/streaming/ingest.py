"""File streams in, stored tables out. The checkpoint is what makes each file count once."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def table_stream(spark: SparkSession, base: str, name: str, files_per_trigger: int | None = None, ts: str | None = None) -> DataFrame:
    """A Parquet table as a stream; `ts` is cast to a zoned timestamp, which watermarks need."""
    # the glob makes a table that is a single file as readable as one that is a folder
    path = f"{base}/{name}.parquet"
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    df = reader.parquet(f"{path}*")
    return df if ts is None else df.withColumn(ts, F.col(ts).cast("timestamp"))


def collect_stream(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Run the stream over everything available, append its output to `path`, and scan that."""
    (
        stream.writeStream.format("parquet")
        .outputMode(mode)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start(path)
        .awaitTermination()
    )
    return stream.sparkSession.read.schema(stream.schema).parquet(path)


def ingest_files(
    spark: SparkSession,
    directory: str,
    specs: Mapping[str, tuple[str, T.StructType | str]],
    target: str,
    checkpoint: str,
) -> dict[str, DataFrame]:
    """Land arriving CSV files, routed by name: source → (file-name glob, schema).

    Every call takes up the files that arrived since the last one, each exactly once,
    and records file name and time of ingest next to the rows.
    """
    landed = {}
    for source, (glob, schema) in specs.items():
        reader = spark.readStream.option("header", "true").option("pathGlobFilter", glob).option("mode", "PERMISSIVE")
        rows = reader.schema(schema).csv(directory).withColumns(
            {"source_file": F.col("_metadata.file_name"), "ingested_at": F.current_timestamp()}
        )
        landed[source] = collect_stream(rows, f"{target}/{source}", f"{checkpoint}/{source}")
    return landed
