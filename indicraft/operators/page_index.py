"""Any page of an ordered table at the cost of one slice, by an index of order statistics.

Rows are stored in range slices of the order, and a small table says how many rows stand before each
slice. A page number thus names its slices, whose folders are all that is read. `offset` must sort
page x per_page rows, and a keyset page needs the row before it.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

SLICE_ROWS = 250_000


def _directed(order: Mapping[str, bool]) -> list[Column]:
    return [F.col(c).desc_nulls_last() if down else F.col(c).asc_nulls_last() for c, down in order.items()]


@dataclass(frozen=True)
class PageIndex:
    """An index under `path`: `rows` by slice, `slices` with (by..., _slice, rows, before).

    order: column → descending, nulls last either way. by: columns with their own page numbers, such as a state.
    """

    spark: SparkSession
    path: str
    schema: T.StructType
    order: Mapping[str, bool]
    by: tuple[str, ...] = ()

    @classmethod
    def build(cls, df: DataFrame, path: str, order: Mapping[str, bool], by: Sequence[str] = (), slice_rows: int = SLICE_ROWS) -> PageIndex:
        """Store `df` in slices of about `slice_rows` rows.

        `order` should end in a unique column; rows alike in all of `by` and `order` share one slice and
        their order is open. Slices are cut by (by, order) together, so a group that holds most rows spreads over many.
        `df` is read three times, to count, to find the cuts and to write, so hand in a stored table.
        A table without rows gives an index whose pages are all empty.
        """
        clash = {"_slice", "rows", "before"} & set(by) or {"_slice"} & set(df.columns)
        if clash:
            raise ValueError(f"columns {', '.join(sorted(clash))} are used by the index itself")
        edges = [*[F.col(c).asc_nulls_first() for c in by], *_directed(order)]
        slices = max(1, math.ceil(df.count() / slice_rows))
        placed = df.repartitionByRange(slices, *edges).withColumn("_slice", F.spark_partition_id())
        placed.sortWithinPartitions("_slice", *edges).write.partitionBy("_slice").parquet(f"{path}/rows")
        index = cls(df.sparkSession, path, placed.schema, dict(order), tuple(by))
        counts = index.rows().groupBy(*by, "_slice").agg(F.count(F.lit(1)).alias("rows"))
        # one row per slice and group that meets it, so this window is over slices and not over rows
        earlier = W.partitionBy(*by) if by else W.partitionBy(F.lit(0))
        before = F.sum("rows").over(earlier.orderBy("_slice").rowsBetween(W.unboundedPreceding, -1))
        counts.withColumn("before", F.coalesce(before, F.lit(0))).write.parquet(f"{path}/slices")
        return index

    def rows(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(f"{self.path}/rows")

    def slices(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/slices")

    def _group(self, group: Mapping[str, Any]) -> Column:
        if set(group) != set(self.by):
            raise ValueError(f"name a value of each of: {', '.join(self.by) or 'no column'}")
        cond = F.lit(True)
        for c, value in group.items():
            cond = cond & F.col(c).eqNullSafe(F.lit(value))
        return cond

    def total(self, **group: Any) -> int:
        return self.slices().filter(self._group(group)).agg(F.coalesce(F.sum("rows"), F.lit(0))).first()[0]

    def pages(self, per_page: int = 50, **group: Any) -> int:
        return math.ceil(self.total(**group) / per_page)

    def page(self, number: int, per_page: int = 50, **group: Any) -> DataFrame:
        """Rows of page `number`, counted from 1, in order; none beyond the last page."""
        start = (number - 1) * per_page
        # a page of `per_page` rows meets at most that many slices
        met = (
            self.slices()
            .filter(self._group(group) & (F.col("before") < start + per_page) & (F.col("before") + F.col("rows") > start))
            .select("_slice", "before")
            .collect()
        )
        inside = self.rows().filter(self._group(group) & F.col("_slice").isin([r["_slice"] for r in met] or [-1]))
        first = min((r["before"] for r in met), default=0)
        return inside.orderBy(*_directed(self.order)).offset(start - first if met else 0).limit(per_page).drop("_slice")
