"""Write modes: replace, append, upsert; views and tables per layer."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.windows import latest_per_key

# Staging models are views, the later layers are stored.
LAYER_KIND = {"staging": "view", "silver": "table", "gold": "table", "ml": "table", "quality": "table"}


def write_replace(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    """Full refresh; with partitions only those present in `df` are replaced."""
    writer = df.write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(*partition_by).option("partitionOverwriteMode", "dynamic")
    writer.parquet(path)


def write_append(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    writer = df.write.mode("append")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def upsert(existing: DataFrame, incoming: DataFrame, keys: Sequence[str]) -> DataFrame:
    """State after insert-or-update: incoming rows win over existing ones with the same key.

    `incoming` holds one row per key. Only keys are shuffled for the anti-join.
    """
    untouched = existing.join(incoming.select(*keys), list(keys), "left_anti")
    return untouched.unionByName(incoming, allowMissingColumns=True)


def upsert_latest(existing: DataFrame, incoming: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """As `upsert`, for several versions per key: the highest `order` columns win."""
    versions = existing.withColumn("_new", F.lit(0)).unionByName(
        incoming.withColumn("_new", F.lit(1)), allowMissingColumns=True
    )
    return latest_per_key(versions, list(keys), [*order, "_new"]).drop("_new")


def materialize_layer(df: DataFrame, layer: str, name: str, root: str) -> DataFrame:
    """Temp view for staging, stored Parquet (registered as view) for the other layers."""
    if LAYER_KIND[layer] == "view":
        df.createOrReplaceTempView(f"{layer}_{name}")
        return df
    path = f"{root}/{layer}/{name}"
    write_replace(df, path)
    stored = df.sparkSession.read.schema(df.schema).parquet(path)
    stored.createOrReplaceTempView(f"{layer}_{name}")
    return stored
