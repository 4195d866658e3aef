"""k nearest rows on the sphere without comparing all pairs.

Right positions are cut into slices along a space-filling curve. A small table of boxes, sixteen to a
slice, tells every left position which slices can hold one of its k nearest; it goes to those only. Inside a
slice, blocks of neighbouring positions are pruned the same way before any distance is taken.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geo import EARTH_RADIUS_KM, haversine_km
from ..session import materialize
from .windows import topk_per_group

GROUP = 256  # left positions pruned together
MATRIX = 2_000_000  # entries of a distance matrix at once
CURVE_BITS = 24


def curve_code(lat: str, lon: str) -> Column:
    """Place along a Z-order curve over latitude and longitude; near positions mostly have near codes."""
    top = 2**CURVE_BITS - 1

    def spread(c: str, low: float, width: float) -> Column:
        step = F.least(F.lit(top), F.floor((F.col(c) - low) / width * (top + 1))).cast("long")
        # binary digits read to base four leave every second bit free
        return F.conv(F.bin(step), 4, 10).cast("long")

    return spread(lat, -90.0, 180.0) + spread(lon, -180.0, 360.0) * 2


class Boxes:
    """Latitude-longitude boxes with the number of positions in each."""

    def __init__(self, south, north, west, east, sizes):
        self.south, self.north, self.west, self.east, self.sizes = south, north, west, east, sizes
        cos_s, cos_n = np.cos(np.radians(south)), np.cos(np.radians(north))
        self.least_cos = np.maximum(np.minimum(cos_s, cos_n), 0.0)
        self.most_cos = np.where((south <= 0) & (north >= 0), 1.0, np.maximum(cos_s, cos_n))

    @classmethod
    def of_runs(cls, lat: np.ndarray, lon: np.ndarray, run: int) -> Boxes:
        """One box for every `run` neighbouring positions."""
        starts = np.arange(0, len(lat), run)
        sizes = np.diff(np.append(starts, len(lat)))
        low, high = np.minimum.reduceat, np.maximum.reduceat
        return cls(low(lat, starts), high(lat, starts), low(lon, starts), high(lon, starts), sizes)

    def take(self, at: np.ndarray) -> Boxes:
        return Boxes(self.south[at], self.north[at], self.west[at], self.east[at], self.sizes[at])


def _distances(a: Boxes, b: Boxes) -> tuple[np.ndarray, np.ndarray]:
    """(no two positions are closer, none are farther) in km, a row per box of `a`, a column per box of `b`."""
    s, n, w, e = (v[:, None] for v in (a.south, a.north, a.west, a.east))
    up = np.maximum(0.0, np.maximum(b.south - n, s - b.north))
    aside = np.minimum.reduce([np.maximum(0.0, np.maximum(b.west - (e + t), (w + t) - b.east)) for t in (0.0, 360.0, -360.0)])
    # distance from a position to a meridian
    sideways = np.arcsin(a.least_cos[:, None] * np.sin(np.radians(np.minimum(aside, 90.0))))
    least = EARTH_RADIUS_KM * np.maximum(np.radians(up), sideways) * (1 - 1e-9)
    # along a meridian, then along the parallel of either end
    rise = np.maximum(b.north - s, n - b.south)
    run = np.minimum(180.0, np.maximum(b.east - w, e - b.west))
    most = EARTH_RADIUS_KM * (np.radians(rise) + np.minimum(a.most_cos[:, None], b.most_cos) * np.radians(run)) * (1 + 1e-9)
    return least, most


def _in_reach(a: Boxes, b: Boxes, k: int, max_km: float) -> np.ndarray:
    """Which boxes of `b` may hold one of the k nearest positions of a position in each box of `a`."""
    least, most = _distances(a, b)
    order = np.argsort(most, axis=1)
    held = np.cumsum(b.sizes[order], axis=1)
    at = np.argmax(held >= k, axis=1)
    rows = np.arange(len(most))
    bound = np.where(held[:, -1] >= k, most[rows, order[rows, at]], np.inf)
    return least <= np.minimum(bound, max_km)[:, None]


def _groups(n: int) -> Iterator[slice]:
    return (slice(i, min(i + GROUP, n)) for i in range(0, n, GROUP))


def _steps(part: slice, width: int) -> Iterator[slice]:
    step = max(1, MATRIX // max(width, 1))
    return (slice(i, min(i + step, part.stop)) for i in range(part.start, part.stop, step))


def _router(boxes: Boxes, owner: np.ndarray, k: int, max_km: float):
    """Arrow mapper: a row per left position and slice that may hold one of its k nearest."""

    def route(batches):
        for batch in batches:
            lat, lon = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("qlat", "qlon"))
            rows, slices = [], []
            for part in _groups(len(lat)):
                near = np.flatnonzero(_in_reach(Boxes.of_runs(lat[part], lon[part], GROUP), boxes, k, max_km)[0])
                some, owners = boxes.take(near), owner[near]
                for few in _steps(part, len(near)):
                    if not len(near):
                        break
                    i, j = np.nonzero(_in_reach(Boxes.of_runs(lat[few], lon[few], 1), some, k, max_km))
                    pairs = np.unique(np.stack([i + few.start, owners[j]], axis=1), axis=0)
                    rows.append(pairs[:, 0])
                    slices.append(pairs[:, 1])
            if rows:
                sent = batch.take(pa.array(np.concatenate(rows)))
                yield pa.RecordBatch.from_arrays([*sent.columns, pa.array(np.concatenate(slices), pa.int32())], [*sent.schema.names, "slice"])

    return route


def _searcher(k: int, max_km: float, leaf: int):
    """Cogroup function: the k nearest positions of a slice, and their equals, for the left positions sent to it."""
    # half-chord squares are compared: they grow with the distance and need no arc
    far = np.sin(max_km / (2 * EARTH_RADIUS_KM)) ** 2 * (1 + 1e-9) if max_km < np.pi * EARTH_RADIUS_KM else np.inf

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        left, right = left.sort_by("code"), right.sort_by("code")
        qlat, qlon = (left.column(c).to_numpy() for c in ("qlat", "qlon"))
        slat, slon = (right.column(c).to_numpy() for c in ("slat", "slon"))
        p, cos_p = np.radians(slat), np.cos(np.radians(slat))
        rows, found = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        blocks = Boxes.of_runs(slat, slon, leaf) if len(slat) else None
        for part in _groups(len(qlat)) if blocks else ():
            near = _in_reach(Boxes.of_runs(qlat[part], qlon[part], GROUP), blocks, k, max_km)[0]
            at = np.flatnonzero(np.repeat(near, blocks.sizes))
            if not len(at):
                continue
            for few in _steps(part, len(at)):
                o = np.radians(qlat[few])[:, None]
                half_lat = np.sin((p[at] - o) / 2)
                half_lon = np.sin(np.radians(slon[at] - qlon[few][:, None]) / 2)
                chord = half_lat * half_lat + np.cos(o) * cos_p[at] * half_lon * half_lon
                limit = np.full(len(chord), far)
                if len(at) > k:
                    limit = np.minimum(limit, np.partition(chord, k - 1, axis=1)[:, k - 1] * (1 + 1e-12))
                i, j = np.nonzero(chord <= limit[:, None])
                rows.append(i + few.start)
                found.append(at[j])
        i, j = pa.array(np.concatenate(rows)), pa.array(np.concatenate(found))
        pairs = {"qlat": left, "qlon": left, "slat": right, "slon": right, "keys": right}
        return pa.table({c: t.column(c).take(i if t is left else j) for c, t in pairs.items()})

    return search


def nearest(
    left: DataFrame,
    right: DataFrame,
    left_key: str,
    right_key: str,
    k: int = 1,
    max_km: float | None = None,
    left_lat: str = "latitude",
    left_lon: str = "longitude",
    right_lat: str = "latitude",
    right_lon: str = "longitude",
    leaf: int = 64,
    per_slice: int = 65_536,
) -> DataFrame:
    """Exact k nearest right rows of every left row: (left_key, right_key, distance_km, place).

    Both sides are first reduced to distinct positions, so a crowded position counts once. Slices hold about
    `per_slice` right positions, blocks inside them `leaf`. The driver and the tasks hold sixteen boxes of five
    numbers per slice, 640 bytes for 65,536 positions. A slice that many left positions need is sent to as many
    tasks as their number asks for. Equal distances go to the smaller right key. Rows whose position is null,
    not a number or beyond 90 and 180 degrees take no part.
    """
    limit = np.inf if max_km is None else float(max_km)

    def positions(df: DataFrame, key: str, lat: str, lon: str, names: tuple[str, str, str]) -> DataFrame:
        y, x = F.col(lat).cast("double"), F.col(lon).cast("double")
        return df.filter(y.between(-90.0, 90.0) & x.between(-180.0, 180.0)).select(F.col(key).alias(names[0]), y.alias(names[1]), x.alias(names[2]))

    r = positions(right, right_key, right_lat, right_lon, ("rk", "slat", "slon"))
    q = positions(left, left_key, left_lat, left_lon, ("lk", "qlat", "qlon"))
    # at most k keys of one position can be among the k nearest
    few = topk_per_group(r, ["slat", "slon"], [F.col("rk")], k).groupBy("slat", "slon").agg(F.collect_list(F.struct("rk")).alias("keys"))
    sites = materialize(few.withColumn("code", curve_code("slat", "slon")), "near-sites")
    slices = max(1, -(-sites.count() // per_slice))
    row = F.monotonically_increasing_id().bitwiseAND(F.lit(2**33 - 1))
    along = [F.col("code"), F.col("slat"), F.col("slon")]
    placed = materialize(
        sites.repartitionByRange(slices, *along)
        .sortWithinPartitions(*along)
        .withColumns({"slice": F.spark_partition_id(), "box": F.floor(row / F.lit(max(1, per_slice // 16)))}),
        "near-slices",
    )
    size = placed.groupBy("slice", "box").agg(F.min("slat"), F.max("slat"), F.min("slon"), F.max("slon"), F.count(F.lit(1)))
    table = np.array([tuple(b) for b in size.collect()], dtype="float64").reshape(-1, 7)
    spots = q.select("qlat", "qlon").distinct().withColumn("code", curve_code("qlat", "qlon")).sortWithinPartitions("code")
    if len(table):
        route = _router(Boxes(*table[:, 2:6].T, table[:, 6].astype("int64")), table[:, 0].astype("int32"), k, limit)
        spots = spots.mapInArrow(route, "qlat double, qlon double, code long, slice int")
    else:
        spots = spots.withColumn("slice", F.lit(0)).limit(0)
    routed = materialize(spots, "near-routes")

    # left positions of a slice in chunks, the slice once per chunk
    chunk = min(8_192, max(512, 500_000 // k))
    asked = routed.groupBy("slice").agg(F.ceil(F.count(F.lit(1)) / F.lit(chunk)).cast("long").alias("chunks"))
    wanted = routed.join(asked, "slice").withColumn("chunk", F.pmod(F.xxhash64("qlat", "qlon"), "chunks")).drop("chunks")
    sent = placed.drop("box").join(asked, "slice").withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).drop("chunks")
    kind = right.schema[right_key].dataType.simpleString()
    pairs = wanted.groupBy("slice", "chunk").cogroup(sent.groupBy("slice", "chunk")).applyInArrow(
        _searcher(k, limit, leaf), f"qlat double, qlon double, slat double, slon double, keys array<struct<rk:{kind}>>"
    )
    pairs = pairs.withColumn("distance_km", haversine_km("qlat", "qlon", "slat", "slon"))
    if max_km is not None:
        pairs = pairs.filter(F.col("distance_km") <= limit)
    named = pairs.select("qlat", "qlon", "distance_km", F.inline("keys"))
    best = topk_per_group(named, ["qlat", "qlon"], [F.col("distance_km"), F.col("rk")], k, "place")
    return q.join(best, ["qlat", "qlon"]).select(F.col("lk").alias(left_key), F.col("rk").alias(right_key), "distance_km", "place")
