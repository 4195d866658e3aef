"""Landed files and tables to DataFrames. Schemas are explicit; bad values become null."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.windows import union_tagged

CORRUPT = "_corrupt"


def string_schema(names: Sequence[str]) -> T.StructType:
    return T.StructType([T.StructField(n, T.StringType()) for n in names])


def read_csv(
    spark: SparkSession,
    path: str | Sequence[str],
    schema: T.StructType | str | None = None,
    encoding: str = "UTF-8",
    keep_corrupt: bool = False,
    **options: str,
) -> DataFrame:
    """CSV with header, tolerant: bad values read as null, surplus fields of ragged rows dropped.

    Without a schema all columns are text (no inference pass over the data); cleaning
    casts them leniently afterwards. `keep_corrupt` adds the raw line of rows that did
    not fit as column `_corrupt`.
    """
    reader = spark.read.option("header", "true").option("mode", "PERMISSIVE").option("encoding", encoding)
    reader = reader.option("enforceSchema", "true").options(**options)
    if schema is None:
        return reader.csv(path)
    if isinstance(schema, str):
        schema = T.StructType.fromDDL(schema)
    if keep_corrupt:
        schema = T.StructType([*schema.fields, T.StructField(CORRUPT, T.StringType())])
        reader = reader.option("columnNameOfCorruptRecord", CORRUPT)
    return reader.schema(schema).csv(path)


def read_csv_any_encoding(spark: SparkSession, path: str, schema: T.StructType | str | None = None, fallback: str = "iso-8859-1") -> DataFrame:
    """Each file as UTF-8, or as the fallback charset if it holds bytes that are not UTF-8.

    One scan sorts the files into the two sets, which are read separately. The driver holds file names
    only, as Spark's own file listing does.
    """
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), (~F.is_valid_utf8("value")).alias("bad"))
    files = lines.groupBy("file").agg(F.bool_or("bad").alias("bad")).collect()
    parts = []
    for bad, encoding in ((False, "UTF-8"), (True, fallback)):
        chosen = [r["file"] for r in files if r["bad"] == bad]
        if chosen:
            parts.append(read_csv(spark, chosen, schema, encoding=encoding))
    if not parts:
        return read_csv(spark, path, schema)
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1], allowMissingColumns=True)


def read_tagged(spark: SparkSession, paths: Mapping[str, str], tag: str, schema=None, **options: str) -> DataFrame:
    """One file (set) per tag value, columns matched by name, tag in its own column."""
    return union_tagged({name: read_csv(spark, p, schema, **options) for name, p in paths.items()}, tag)


def read_json_records(spark: SparkSession, path: str, schema: T.StructType | str, multi_line: bool = False) -> DataFrame:
    """Arrays of objects with an explicit schema: one array per line, or per file with `multi_line`.

    Lines split a large file over tasks; a `multi_line` file is one task.
    """
    if isinstance(schema, str):
        schema = T.StructType.fromDDL(schema)
    return spark.read.schema(schema).option("multiLine", multi_line).option("mode", "PERMISSIVE").json(path)


def header_row_table(df: DataFrame, payload: str, columns: Sequence[str]) -> DataFrame:
    """Text column with `[[header...], [row...], ...]` to one row per record.

    Every payload carries its own header row, so column order may differ between payloads.
    """
    parsed = df.select(F.from_json(payload, "array<array<string>>").alias("t"))
    rows = parsed.select(F.col("t")[0].alias("head"), F.explode(F.slice("t", 2, F.greatest(F.size("t") - 1, F.lit(0)))).alias("r"))
    place = lambda c: F.array_position("head", c).cast("int")
    return rows.select(
        *[F.when(place(c) > 0, F.try_element_at("r", F.nullif(place(c), F.lit(0)))).alias(c) for c in columns]
    )


def read_header_row_json(spark: SparkSession, path: str, columns: Sequence[str], whole_files: bool = False) -> DataFrame:
    """One header-row array per line, or per file with `whole_files` (a file is one task then)."""
    return header_row_table(spark.read.text(path, wholetext=whole_files), "value", columns)


# The fields of an alert feature that are read.
ALERT_PROPERTIES = (
    "struct<id:string,event:string,severity:string,certainty:string,urgency:string,"
    "headline:string,description:string,areaDesc:string,affectedZones:array<string>,"
    "geocode:struct<UGC:array<string>>,onset:string,expires:string,senderName:string,messageType:string>"
)


def alert_features(df: DataFrame, payload: str) -> DataFrame:
    """Text column with a GeoJSON feature collection to one `properties` struct per row."""
    parsed = F.from_json(payload, f"features array<struct<properties:{ALERT_PROPERTIES}>>")
    return df.select(F.explode(parsed["features"]).alias("f")).select("f.properties")


def read_geojson_alerts(spark: SparkSession, path: str, whole_files: bool = False) -> DataFrame:
    """One feature collection per line, or per file with `whole_files` (a file is one task then)."""
    return alert_features(spark.read.text(path, wholetext=whole_files), "value")


def read_table(spark: SparkSession, name: str) -> DataFrame:
    """Catalog table, or Parquet folder when the name is a path."""
    return spark.read.parquet(name) if "/" in name else spark.table(name)


def read_jdbc(spark: SparkSession, url: str, table: str, partition_column: str, low: int, high: int, partitions: int, **options: str) -> DataFrame:
    """Database table read in parallel ranges of a numeric column (needs a driver on the classpath)."""
    return (
        spark.read.format("jdbc")
        .options(url=url, dbtable=table, partitionColumn=partition_column, lowerBound=str(low), upperBound=str(high), numPartitions=str(partitions), **options)
        .load()
    )


def csv_views(spark: SparkSession, files: Mapping[str, str]) -> None:
    """Register CSV files as temp views: name → path."""
    for name, path in files.items():
        read_csv(spark, path).createOrReplaceTempView(name)
