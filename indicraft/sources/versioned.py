"""A keyed table that is updated in place: buckets of files, copy on write, versions by manifest.

The folder holds `data` (one sub-folder per write, files by bucket) and `manifests` (one sub-folder per version, a row
per file of that version). A merge reads and rewrites only the files of buckets that hold incoming keys; all others go
on into the next version as they are. A version exists once its manifest is committed, so readers see
the table before or after a merge, never between; two writers that start from one version collide on the manifest's folder and the
later one fails without touching the table. Old versions stay readable until `vacuum`.

Keys with a null are equal to none, as in an SQL merge: such rows are always added.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MANIFEST = "bucket int, path string, bytes long, modified timestamp, written_in int"


class WriteConflict(RuntimeError):
    """Another writer has made the version that this one was about to make."""


@dataclass
class VersionedTable:
    """A versioned table at `path`, rows told apart by `keys`, in `buckets` by `bucket` (a hash of the keys if none is given)."""

    spark: SparkSession
    path: str
    keys: Sequence[str]
    buckets: int = 64
    bucket: Column | None = None

    def _fs(self, path: str):
        where = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return where, where.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def versions(self) -> list[int]:
        """All committed versions in their order."""
        where, fs = self._fs(f"{self.path}/manifests")
        if not fs.exists(where):
            return []
        jvm = self.spark._jvm
        names = [s.getPath().getName() for s in fs.listStatus(where)]
        done = [n for n in names if n.startswith("v=") and fs.exists(jvm.org.apache.hadoop.fs.Path(f"{self.path}/manifests/{n}/_SUCCESS"))]
        return sorted(int(n[2:]) for n in done)

    def manifest(self, version: int | None = None) -> DataFrame:
        """(bucket, path, bytes, modified, written_in): the files of a version, the newest if none is named."""
        known = self.versions()
        version = (known[-1] if known else None) if version is None else version
        if version not in known:
            raise ValueError(f"no version {version} in {self.path}: {known}")
        return self.spark.read.schema(MANIFEST).parquet(f"{self.path}/manifests/v={version}")

    def _files(self, manifest: DataFrame) -> DataFrame:
        paths = [r["path"] for r in manifest.select("path").collect()]  # a row per file
        return self.spark.read.option("mergeSchema", "true").parquet(*paths)

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version; columns that a file lacks are null."""
        manifest = self.manifest(version)
        if manifest.isEmpty():
            return self.spark.read.parquet(f"{self.path}/data/v=1/empty")
        return self._files(manifest)

    def _bucketed(self, df: DataFrame) -> DataFrame:
        own = F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)) if self.bucket is None else self.bucket
        return df.withColumn("_bucket", own.cast("int"))

    def _write(self, rows: DataFrame, version: int, keep: DataFrame | None) -> int:
        folder = f"{self.path}/data/v={version}-{uuid.uuid4().hex}"
        rows.repartition("_bucket", *self.keys).write.partitionBy("_bucket").parquet(folder)
        files = self.spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "true").load(folder)
        bucket = F.regexp_extract("path", r"/_bucket=(\d+)/", 1).cast("int")
        fresh = files.select(bucket.alias("bucket"), "path", F.col("length").alias("bytes"), F.col("modificationTime").alias("modified"), F.lit(version).alias("written_in"))
        if keep is not None:
            fresh = keep.unionByName(fresh)
        at = f"{self.path}/manifests/v={version}"
        where, fs = self._fs(at)
        # making the folder is the race that one writer wins
        if fs.exists(where):
            raise WriteConflict(at)
        fresh.coalesce(1).write.mode("errorifexists").parquet(at)
        return version

    def create(self, rows: DataFrame) -> int:
        """Version 1 from `rows`, one row per key."""
        if self.versions():
            raise WriteConflict(f"{self.path} exists")
        rows.limit(0).write.mode("overwrite").parquet(f"{self.path}/data/v=1/empty")
        return self._write(self._bucketed(rows), 1, None)

    def merge(self, incoming: DataFrame, delete: Column | None = None) -> int:
        """The next version: incoming rows (one per key) replace rows with their key or are added; rows of `incoming` for which
        `delete` holds only take theirs away. Returns the version."""
        known = self.versions()
        incoming = self._bucketed(incoming)
        # at most `buckets` numbers
        touched = [r[0] for r in incoming.select("_bucket").distinct().collect()]
        manifest = self.manifest()
        old = manifest.filter(F.col("bucket").isin(touched))
        rows = incoming if delete is None else incoming.filter(~F.coalesce(delete, F.lit(False)))
        if not old.isEmpty():
            before = self._bucketed(self._files(old))
            # the bucket is part of the join, so rows move once for join and files
            stay = before.join(incoming.select("_bucket", *self.keys), ["_bucket", *self.keys], "left_anti")
            rows = stay.unionByName(rows, allowMissingColumns=True)
        return self._write(rows, known[-1] + 1, manifest.filter(~F.col("bucket").isin(touched)))

    def vacuum(self, keep: int = 1) -> int:
        """Drop all but the newest `keep` versions and the files that only those held; returns how many files went."""
        known = self.versions()
        live = None
        for v in known[-keep:]:
            rows = self.manifest(v).select("path")
            live = rows if live is None else live.unionByName(rows)
        gone = None
        for v in known[:-keep]:
            rows = self.manifest(v).select("path")
            gone = rows if gone is None else gone.unionByName(rows)
        if gone is None:
            return 0
        dead = [r["path"] for r in gone.distinct().join(live.distinct(), "path", "left_anti").collect()]
        for path in [*dead, *[f"{self.path}/manifests/v={v}" for v in known[:-keep]]]:
            where, fs = self._fs(path)
            fs.delete(where, True)
        return len(dead)
