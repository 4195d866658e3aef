"""Substring search by posting tables: which rows hold which runs of one, two, three, six and twelve characters.

A text that contains a needle contains all its runs of the longest of these lengths that fits it, which up to 24 characters is at least half
of it. A search therefore takes the needle's rarest runs and checks the few rows of their postings with the plain condition, so its
result is that of a scan. Many needles together take one run each: its postings are few where the needle is rare, and common runs beside it
would cost more than the rows they spare. An index built with other lengths has to be built again.

The index is a folder, all of it Parquet:

    rows       the key and the searched columns, by a hash of the key (`row_bucket`)
    postings   (gram, key, row_bucket), each row once per gram, by a hash of the gram (`gram_bucket`), sorted by gram
    counts     (gram, n): how many rows hold it, by the same hash

Filters on the bucket columns prune the other folders at planning, and the order by gram lets the scan skip row groups. A gram that most rows
hold is cut by the rows' keys into files of about `FILE_ROWS`. `add` writes a new segment beside the old ones; it
is seen by searches once its counts, written last, are committed.

Matching is that of `ilike` with `%` and `_` taken literally: both sides in lower case. A null column holds nothing; a null needle finds nothing and
an empty one every row with a text; rows with a null key are found like others; rows that were added twice are found twice.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import materialize
from .windows import topk_per_group

#: Postings of one gram, and rows, in one file.
FILE_ROWS = 1_000_000
#: Lengths of the runs that have postings.
LENGTHS = (1, 2, 3, 6, 12)
#: Grams of a single needle that are looked up; more would narrow the candidates little.
MOST_GRAMS = 4


def _runs(text: Column, n: int) -> Column:
    """All runs of n neighbouring characters of the text."""
    return F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{n}}}))."), 1)


def text_grams(*texts: Column) -> Column:
    """The distinct runs of the texts together, of all lengths."""
    every = [_runs(F.lower(F.coalesce(t.cast("string"), F.lit(""))), n) for t in texts for n in LENGTHS]
    return F.array_distinct(F.flatten(F.array(*every)))


def needle_grams(needle: Column) -> Column:
    """The runs that a search looks up: those of the longest length that fits."""
    low = F.lower(needle)
    fitting = F.lit(None).cast("array<string>")
    for n in LENGTHS:
        fitting = F.when(F.length(low) >= n, _runs(low, n)).otherwise(fitting)
    return F.array_distinct(F.coalesce(fitting, F.array(low)))


@dataclass
class TextIndex:
    """An index at `path` over the text columns `cols` of rows with the key column `key`."""

    spark: SparkSession
    path: str
    key: str
    cols: Sequence[str]
    key_type: T.DataType = field(default_factory=T.LongType)
    buckets: int = 64
    file_rows: int = FILE_ROWS

    def _bucket(self, c: Column) -> Column:
        return F.pmod(F.xxhash64(c), F.lit(self.buckets)).cast("int")

    def segments(self) -> list[str]:
        """The committed segments, oldest first."""
        jvm = self.spark._jvm
        where = jvm.org.apache.hadoop.fs.Path(f"{self.path}/counts")
        fs = where.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(where):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(where)]
        return sorted(n[4:] for n in names if n.startswith("seg=") and fs.exists(jvm.org.apache.hadoop.fs.Path(f"{self.path}/counts/{n}/_SUCCESS")))

    def add(self, rows: DataFrame) -> str:
        """Index all of `rows` as a new segment and return its name."""
        known = self.segments()
        seg = f"s{int(known[-1][1:]) + 1 if known else 0:09d}"
        slim = rows.select(F.col(self.key).cast(self.key_type).alias("key"), *[F.col(c).cast("string").alias(c) for c in self.cols])
        slim = slim.withColumn("row_bucket", self._bucket(F.col("key")))
        total = slim.count()
        cut = max(1, math.ceil(total / self.file_rows))
        thin = F.pmod(F.xxhash64("key", F.lit(7)), F.lit(max(1, math.ceil(total / self.buckets / self.file_rows))))
        slim.repartition("row_bucket", thin).write.partitionBy("row_bucket").mode("overwrite").parquet(f"{self.path}/rows/seg={seg}")
        grams = slim.select(F.explode(text_grams(*[F.col(f"`{c}`") for c in self.cols])).alias("gram"), "key", "row_bucket")
        grams = grams.withColumn("gram_bucket", self._bucket(F.col("gram")))
        # a gram is in as many postings as there are rows at most, so one gram brings a task `file_rows` at most
        split = grams.repartition("gram_bucket", F.pmod(F.xxhash64("key", F.lit(7)), F.lit(cut)))
        split.sortWithinPartitions("gram_bucket", "gram").write.partitionBy("gram_bucket").mode("overwrite").parquet(f"{self.path}/postings/seg={seg}")
        # the segment's own folder: it is not listed as committed yet
        written = self.spark.read.schema(self._schema("postings")).option("basePath", f"{self.path}/postings").parquet(f"{self.path}/postings/seg={seg}")
        counts = written.groupBy("gram_bucket", "gram").agg(F.count("*").alias("n"))
        counts.repartition("gram_bucket").sortWithinPartitions("gram_bucket", "gram").write.partitionBy("gram_bucket").mode("overwrite").parquet(f"{self.path}/counts/seg={seg}")
        return seg

    def _schema(self, kind: str) -> T.StructType:
        own = {
            "rows": [("key", self.key_type), *[(c, T.StringType()) for c in self.cols], ("seg", T.StringType()), ("row_bucket", T.IntegerType())],
            "postings": [("gram", T.StringType()), ("key", self.key_type), ("row_bucket", T.IntegerType()), ("seg", T.StringType()), ("gram_bucket", T.IntegerType())],
            "counts": [("gram", T.StringType()), ("n", T.LongType()), ("seg", T.StringType()), ("gram_bucket", T.IntegerType())],
        }
        return T.StructType([T.StructField(n, t) for n, t in own[kind]])

    def table(self, kind: str) -> DataFrame:
        """`rows`, `postings` or `counts` of all committed segments."""
        known = self.segments()
        if not known:
            return self.spark.createDataFrame([], self._schema(kind))
        return self.spark.read.schema(self._schema(kind)).parquet(f"{self.path}/{kind}").filter(F.col("seg").isin(known))

    def _named(self, rows: DataFrame, *first: str) -> DataFrame:
        return rows.select(*first, F.col("key").alias(self.key), *[F.col(f"`{c}`") for c in self.cols])

    def candidates(self, needle: str) -> DataFrame | None:
        """(seg, row_bucket, key) of the rows that hold the needle's rarest grams; None where some gram is in no row."""
        grams = self.spark.range(1).select(needle_grams(F.lit(needle)).alias("g"), F.transform("g", lambda g: self._bucket(g)).alias("b")).first()
        known = self.table("counts").filter(F.col("gram_bucket").isin(sorted(set(grams["b"]))) & F.col("gram").isin(grams["g"]))
        # one row per gram of the needle
        counts = sorted((r["n"], r["gram"], r["gram_bucket"]) for r in known.groupBy("gram_bucket", "gram").agg(F.sum("n").alias("n")).collect())
        if len(counts) < len(grams["g"]):
            return None
        rarest = counts[:MOST_GRAMS]
        hits = self.table("postings").filter(F.col("gram_bucket").isin(sorted({b for _, _, b in rarest})) & F.col("gram").isin([g for _, g, _ in rarest]))
        return hits.groupBy("seg", "row_bucket", "key").agg(F.count_distinct("gram").alias("found")).filter(F.col("found") == len(rarest)).drop("found")

    def find(self, needle: str | None) -> DataFrame:
        """(key, columns) of all rows that contain the needle in some column."""
        rows = self.table("rows")
        if needle is None:
            return self._named(rows.filter(F.lit(False)))
        holds = F.lit(False)
        for c in self.cols:
            holds = holds | F.coalesce(F.lower(F.col(f"`{c}`")).contains(F.lower(F.lit(needle))), F.lit(False))
        if needle == "":
            return self._named(rows.filter(holds))
        near = self.candidates(needle)
        if near is None:
            return self._named(rows.filter(F.lit(False)))
        near = materialize(near, "candidates")
        # at most `buckets` numbers
        places = sorted(r[0] for r in near.select("row_bucket").distinct().collect())
        return self._named(_semi(rows.filter(F.col("row_bucket").isin(places)), near).filter(holds))

    def find_all(self, needles: DataFrame, needle: str = "needle") -> DataFrame:
        """(needle, key, columns): the rows of every distinct needle of a frame. Frames of any size, all by joins."""
        asked = needles.select(F.col(needle).cast("string").alias("needle")).filter("needle is not null").distinct()
        grams = asked.filter("needle <> ''").select("needle", F.explode(needle_grams(F.col("needle"))).alias("gram")).withColumn("gram_bucket", self._bucket(F.col("gram")))
        counts = self.table("counts").groupBy("gram_bucket", "gram").agg(F.sum("n").alias("n"))
        rarest = topk_per_group(grams.join(counts, ["gram_bucket", "gram"], "left"), "needle", [F.col("n").asc_nulls_first(), F.col("gram")], 1, "place")
        # a needle with a run that no row holds is in no row; stored, as its size tells Spark whether postings have to move
        wanted = materialize(rarest.filter("n is not null").select("needle", "gram_bucket", "gram"), "needles")
        hits = self.table("postings").join(wanted, ["gram_bucket", "gram"])
        near = hits.select("needle", "seg", F.col("row_bucket").alias("b"), F.col("key").alias("k")).distinct()
        rows = self.table("rows")
        same = (rows["seg"] == near["seg"]) & (rows["row_bucket"] == near["b"]) & rows["key"].eqNullSafe(near["k"])
        holds = F.lit(False)
        for c in self.cols:
            holds = holds | F.coalesce(F.lower(rows[f"`{c}`"]).contains(F.lower(F.col("needle"))), F.lit(False))
        out = self._named(rows.join(near, same).filter(holds), "needle")
        if asked.filter("needle = ''").limit(1).count():
            some = F.coalesce(*[F.col(f"`{c}`") for c in self.cols]).isNotNull()
            out = out.unionByName(self._named(rows.filter(some).withColumn("needle", F.lit("")), "needle"))
        return out


def _semi(rows: DataFrame, near: DataFrame) -> DataFrame:
    same = (rows["seg"] == near["seg"]) & (rows["row_bucket"] == near["row_bucket"]) & rows["key"].eqNullSafe(near["key"])
    return rows.join(near, same, "left_semi")
