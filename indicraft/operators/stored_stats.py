"""Statistics that grow by partition: sketches and sorted chunks per (partition, metric), merged when read.

Adding a partition (a year, a source) reads that partition only. Stored for it are

    sketches   one row a metric: rows, a KLL quantile sketch and a HyperLogLog sketch of the values
    chunks     the values in order, a few thousand a row, with the least, the largest and how many

Percentiles over any set of partitions merge the sketches, which bracket the wanted value; chunks wholly below the bracket are counted by
their numbers, and only chunks that reach into it are opened, pruned by their bounds. A bracket that misses the rank, which a sketch
may do, is widened until it holds it, so values are exact whatever the sketch says. Old partitions are never scanned again.

Nulls and NaN are left out; a metric without values has no percentiles; adding a partition again replaces it.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import held

#: Size of the quantile sketch: ranks are right to about 0.1% of the rows.
SKETCH_K = 4_000
#: Bits of the distinct sketch: counts are right to about 1%.
SKETCH_BITS = 14
CHUNK_ROWS = 4_096
#: First half-width of a bracket, as a share of the rows.
MARGIN = 0.004


@dataclass
class StatsStore:
    """Stored statistics at `path`; `part` in the tables is the name that a partition was added under."""

    spark: SparkSession
    path: str

    def add(self, df: DataFrame, part: str, metrics: Sequence[str]) -> None:
        """Statistics of the columns `metrics` of `df` under the name `part`."""
        cells = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(f"`{m}`").cast("double").alias("value")) for m in metrics])
        values = df.select(F.inline(cells)).filter("value is not null and not isnan(value)")
        with held(values, "stats") as long:
            sketches = long.groupBy("metric").agg(
                F.count("*").alias("n"), F.kll_sketch_agg_double("value", F.lit(SKETCH_K)).alias("kll"), F.hll_sketch_agg(F.xxhash64("value"), F.lit(SKETCH_BITS)).alias("hll")
            )
            self._replace(sketches, "sketches", part)
            # equal values first become one row with their number, so a value that fills a metric fills no task
            counted = long.groupBy("metric", "value").agg(F.count("*").alias("times"))
            sliced = counted.repartitionByRange("metric", "value").withColumn("slice", F.spark_partition_id())
            row = F.row_number().over(Window.partitionBy("slice", "metric").orderBy("value"))
            chunks = sliced.withColumn("chunk", F.floor(row / CHUNK_ROWS)).groupBy("metric", "slice", "chunk").agg(
                F.min("value").alias("low"), F.max("value").alias("high"), F.sum("times").alias("n"),
                F.sort_array(F.collect_list(F.struct("value", "times"))).alias("values"),
            )
            self._replace(chunks.drop("slice", "chunk").repartitionByRange("metric", "low").sortWithinPartitions("metric", "low"), "chunks", part)

    def _replace(self, df: DataFrame, kind: str, part: str) -> None:
        df.withColumn("part", F.lit(part)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("part").parquet(f"{self.path}/{kind}")

    def _read(self, kind: str, parts: Sequence[str] | None) -> DataFrame:
        rows = self.spark.read.parquet(f"{self.path}/{kind}")
        return rows if parts is None else rows.filter(F.col("part").cast("string").isin(list(parts)))

    def distinct(self, parts: Sequence[str] | None = None) -> DataFrame:
        """(metric, n, n_distinct): values and estimated different ones over `parts` (all if none are named)."""
        rows = self._read("sketches", parts).groupBy("metric").agg(F.sum("n").alias("n"), F.hll_union_agg("hll").alias("hll"))
        return rows.select("metric", "n", F.hll_sketch_estimate("hll").alias("n_distinct"))

    def estimates(self, qs: Sequence[float], parts: Sequence[str] | None = None) -> DataFrame:
        """(metric, q, value) from the sketches alone."""
        rows = self._read("sketches", parts).groupBy("metric").agg(F.kll_merge_agg_double("kll").alias("kll"))
        points = F.array(*[F.lit(float(q)) for q in qs])
        got = rows.select("metric", F.posexplode(F.kll_sketch_get_quantile_double("kll", points)).alias("at", "value"))
        return got.select("metric", points[F.col("at")].alias("q"), "value")

    def percentiles(self, qs: Sequence[float], parts: Sequence[str] | None = None) -> DataFrame:
        """(metric, q, value): exact, with linear interpolation between neighbours."""
        sizes = {r["metric"]: r["n"] for r in self._read("sketches", parts).groupBy("metric").agg(F.sum("n").alias("n")).collect()}
        # one entry per metric and percentile: everything on the driver here is that small
        open_ = {(m, q): MARGIN for m in sizes for q in qs}
        done: dict[tuple[str, float], float] = {}
        while open_:
            brackets = self._brackets(open_, parts)
            for (m, q), value in self._inside(brackets, sizes, parts).items():
                if value is None:
                    open_[(m, q)] *= 50
                else:
                    done[(m, q)] = value
                    del open_[(m, q)]
        return self.spark.createDataFrame([(m, q, v) for (m, q), v in sorted(done.items())], "metric string, q double, value double")

    def _brackets(self, margins: dict[tuple[str, float], float], parts) -> list[tuple[str, float, float, float]]:
        """(metric, q, low, high); a bracket that would reach past an end is open there."""
        ends = {(m, q): (q - w, q + w) for (m, q), w in margins.items()}
        ranks = sorted({min(max(e, 0.0), 1.0) for pair in ends.values() for e in pair})
        at = {(r["metric"], r["q"]): r["value"] for r in self.estimates(ranks, parts).collect()}
        inf = float("inf")
        return [(m, q, at[m, a] if a > 0 else -inf, at[m, b] if b < 1 else inf) for (m, q), (a, b) in ends.items()]

    def _inside(self, brackets, sizes, parts) -> dict[tuple[str, float], float | None]:
        """The exact percentile of each bracket, or None where the bracket misses its rank."""
        asked = self.spark.createDataFrame([(*b, b[1] * (sizes[b[0]] - 1)) for b in brackets], "metric string, q double, lo double, hi double, place double")
        chunks = self._read("chunks", parts)
        met = chunks.select("metric", "low", "high", "n").join(F.broadcast(asked), "metric")
        below = met.groupBy("metric", "q").agg(F.sum(F.when(F.col("high") < F.col("lo"), F.col("n")).otherwise(0)).alias("below"))
        # the widest bounds reach the scan, each bracket's own ones the join
        reach = F.lit(False)
        for m in {b[0] for b in brackets}:
            for b in [b for b in brackets if b[0] == m]:
                reach = reach | ((F.col("metric") == m) & (F.col("high") >= b[2]) & (F.col("low") <= b[3]))
        opened = chunks.filter(reach).join(F.broadcast(asked), "metric").filter((F.col("high") >= F.col("lo")) & (F.col("low") <= F.col("hi")))
        values = opened.select("metric", "q", "lo", "hi", "place", F.inline("values"))
        under = values.filter(F.col("value") < F.col("lo")).groupBy("metric", "q").agg(F.sum("times").alias("under"))
        within = values.filter((F.col("value") >= F.col("lo")) & (F.col("value") <= F.col("hi"))).groupBy("metric", "q", "place", "value").agg(F.sum("times").alias("times"))
        running = Window.partitionBy("metric", "q").orderBy("value")
        placed = within.withColumn("upto", F.sum("times").over(running)).join(F.broadcast(below), ["metric", "q"]).join(F.broadcast(under), ["metric", "q"], "left")
        upto = F.col("upto") + F.col("below") + F.coalesce("under", F.lit(0))
        first = upto - F.col("times")

        def at(rank):
            return F.max(F.when((first <= rank) & (rank < upto), F.col("value")))

        found = placed.groupBy("metric", "q", "place").agg(at(F.floor("place")).alias("a"), at(F.ceil("place")).alias("b"))
        value = F.col("a") + (F.col("b") - F.col("a")) * (F.col("place") - F.floor("place"))
        got = {(r["metric"], r["q"]): r["value"] for r in found.select("metric", "q", value.alias("value")).collect()}
        return {(m, q): got.get((m, q)) for m, q, _, _ in brackets}
