"""Hexagonal cells as plain Column arithmetic.

Positions go to an equal-area plane (cylindrical, true at 37.5 degrees) and there to axial coordinates (q, r) of a
hexagonal lattice by cube rounding. Every resolution has cells of a seventh of the area of the one before, its lattice
turned by the angle that puts the centre of every parent on the centre of one child, so a parent has exactly seven children:
the middle one and its six neighbours. A cell is one long: resolution, q and r side by side.

A null or non-finite position has no cell. The lattice ends at 180 degrees and does not wrap around.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .cleaning import ColumnLike, as_col
from .geo import EARTH_RADIUS_KM

# Area of a cell at resolution 0 in square kilometres; every further resolution has a seventh of it.
AREA_KM2 = 4250546.848
APERTURE = 7
DEFAULT_RESOLUTION = 8
DEEPEST = 12
TRUE_LATITUDE = math.radians(37.5)
TURN = math.atan2(1.5, 2.5 * math.sqrt(3))
#: Bits of q and of r; both are stored from -2^27 up.
BITS = 28
HALF = 1 << (BITS - 1)


def cell_area(resolution: int) -> float:
    return AREA_KM2 / APERTURE**resolution


def cell_side(resolution: int) -> float:
    """Kilometres from a cell's centre to a corner."""
    return math.sqrt(cell_area(resolution) * 2 / (3 * math.sqrt(3)))


def let(value: Column, fn: Callable[[Column], Column]) -> Column:
    """`fn(value)` with `value` computed once, however often `fn` uses it."""
    return F.transform(F.array(value), fn)[0]


def _round(x: Column) -> Column:
    return F.floor(x + 0.5)


def cube_round(q: Column, r: Column) -> Column:
    """struct<q, r>: the cell whose centre is nearest to fractional axial coordinates."""

    def fix(at: Column) -> Column:
        s = -at["q"] - at["r"]
        rq, rr, rs = _round(at["q"]), _round(at["r"]), _round(s)
        dq, dr, ds = F.abs(rq - at["q"]), F.abs(rr - at["r"]), F.abs(rs - s)
        far_q = (dq > dr) & (dq > ds)
        q_ = F.when(far_q, -rr - rs).otherwise(rq)
        r_ = F.when(~far_q & (dr > ds), -rq - rs).otherwise(rr)
        return F.struct(q_.cast("bigint").alias("q"), r_.cast("bigint").alias("r"))

    return let(F.struct(q.cast("double").alias("q"), r.cast("double").alias("r")), fix)


def pack(resolution: Column, q: Column, r: Column) -> Column:
    top = F.shiftleft(resolution.cast("bigint"), 2 * BITS)
    return top.bitwiseOR(F.shiftleft(q + HALF, BITS)).bitwiseOR(r + HALF)


def hex_parts(cell: ColumnLike) -> Column:
    """struct<resolution, q, r> of a cell."""
    c = as_col(cell)
    mask = F.lit((1 << BITS) - 1)
    return F.when(
        c.isNotNull(),
        F.struct(
            F.shiftright(c, 2 * BITS).cast("int").alias("resolution"),
            (F.shiftright(c, BITS).bitwiseAND(mask) - HALF).alias("q"),
            (c.bitwiseAND(mask) - HALF).alias("r"),
        ),
    )


def hex_cell(lat: ColumnLike, lon: ColumnLike, resolution: int = DEFAULT_RESOLUTION) -> Column:
    """The cell of a position; `resolution` from 0 to 12."""
    if not 0 <= resolution <= DEEPEST:
        raise ValueError(f"resolution {resolution} is not in 0..{DEEPEST}")
    side, turn = cell_side(resolution), resolution * TURN
    y, x = as_col(lat).cast("double"), as_col(lon).cast("double")
    east = F.radians(x) * (EARTH_RADIUS_KM * math.cos(TRUE_LATITUDE))
    north = F.sin(F.radians(y)) * (EARTH_RADIUS_KM / math.cos(TRUE_LATITUDE))
    usable = y.isNotNull() & x.isNotNull() & y.between(-90, 90) & x.between(-180, 180)

    def place(p: Column) -> Column:
        px = p["east"] * math.cos(turn) - p["north"] * math.sin(turn)
        py = p["east"] * math.sin(turn) + p["north"] * math.cos(turn)
        r = py / (1.5 * side)
        return cube_round(px / (math.sqrt(3) * side) - r / 2, r)

    at = let(F.struct(east.alias("east"), north.alias("north")), place)
    return F.when(usable, let(at, lambda c: pack(F.lit(resolution), c["q"], c["r"])))


def hex_center(cell: ColumnLike) -> Column:
    """struct<lat, lon> of a cell's centre."""

    def place(c: Column) -> Column:
        side = F.lit(cell_side(0)) / F.pow(F.lit(math.sqrt(APERTURE)), c["resolution"])
        turn = c["resolution"] * F.lit(TURN)
        px, py = side * math.sqrt(3) * (c["q"] + c["r"] / 2), side * 1.5 * c["r"]
        east, north = px * F.cos(turn) + py * F.sin(turn), py * F.cos(turn) - px * F.sin(turn)
        sine = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), north * (math.cos(TRUE_LATITUDE) / EARTH_RADIUS_KM)))
        lon = F.degrees(east / (EARTH_RADIUS_KM * math.cos(TRUE_LATITUDE)))
        return F.when(c.isNotNull(), F.struct(F.degrees(F.asin(sine)).alias("lat"), lon.alias("lon")))

    return let(hex_parts(cell), place)


def hex_parent(cell: ColumnLike, resolution: int) -> Column:
    """The enclosing cell at a coarser resolution, step by step in integers; null for a finer one."""

    def up(at: Column, _: Column) -> Column:
        return cube_round((3 * at["q"] + at["r"]) / 7, (2 * at["r"] - at["q"]) / 7)

    def climb(c: Column) -> Column:
        levels = c["resolution"] - resolution
        steps = F.when(levels > 0, F.sequence(F.lit(1), F.greatest(levels, F.lit(1)))).otherwise(F.array().cast("array<int>"))
        top = F.aggregate(steps, F.struct(c["q"].alias("q"), c["r"].alias("r")), up)
        return F.when(levels >= 0, let(top, lambda t: pack(F.lit(resolution), t["q"], t["r"])))

    return let(hex_parts(cell), climb)


def hex_ring(cell: ColumnLike, k: int = 1) -> Column:
    """All 3k(k+1)+1 cells within `k` steps of a cell, itself included, as an array."""
    moves = [(dq, dr) for dq in range(-k, k + 1) for dr in range(max(-k, -dq - k), min(k, -dq + k) + 1)]
    near = lambda c: F.array(*[pack(c["resolution"], c["q"] + dq, c["r"] + dr) for dq, dr in moves])
    return F.when(as_col(cell).isNotNull(), let(hex_parts(cell), near))


def hex_distance(a: ColumnLike, b: ColumnLike) -> Column:
    """Steps between two cells of one resolution; null if their resolutions differ."""

    def steps(p: Column) -> Column:
        dq, dr = p["a"]["q"] - p["b"]["q"], p["a"]["r"] - p["b"]["r"]
        return F.when(p["a"]["resolution"] == p["b"]["resolution"], ((F.abs(dq) + F.abs(dr) + F.abs(dq + dr)) / 2).cast("bigint"))

    return let(F.struct(hex_parts(a).alias("a"), hex_parts(b).alias("b")), steps)


def resolution_for_area(target_km2: float) -> int:
    """Resolution whose cell area is closest to the target."""
    return min(range(DEEPEST + 1), key=lambda r: abs(cell_area(r) - target_km2))


def hex_counts(df: DataFrame, lat: str, lon: str, resolution: int, name: str = "n") -> DataFrame:
    """(cell, n): positions per cell; those without a cell are left out."""
    return df.select(hex_cell(lat, lon, resolution).alias("cell")).filter("cell is not null").groupBy("cell").agg(F.count("*").alias(name))


def hex_nearby(left: DataFrame, right: DataFrame, lat: str, lon: str, resolution: int, k: int = 1) -> DataFrame:
    """(cell, n_left, n_right): per cell of `left` its positions and those of `right` within `k` steps.

    Both sides are counted per cell before they meet, so a cell that holds most positions is one row of the join, and
    only counts are spread over rings.
    """
    own = hex_counts(left, lat, lon, resolution, "n_left")
    spread = hex_counts(right, lat, lon, resolution, "n").select(F.explode(hex_ring("cell", k)).alias("cell"), "n")
    near = spread.groupBy("cell").agg(F.sum("n").alias("n_right"))
    return own.join(near, "cell", "left").select("cell", "n_left", F.coalesce("n_right", F.lit(0)).alias("n_right"))


def hex_pairs_within(left: DataFrame, right: DataFrame, left_key: str, right_key: str, lat: str, lon: str, km: float, most_lat: float = 72.0) -> DataFrame:
    """(left_key, right_key, distance_km): all pairs at most `km` apart, of positions up to `most_lat` degrees from the equator.

    Cells are as large as the radius where the plane stretches it most, so pairs stand at most one step apart.
    """
    from .geo import haversine_km

    stretch = max(math.cos(TRUE_LATITUDE) / math.cos(math.radians(most_lat)), 1 / math.cos(TRUE_LATITUDE))
    fine = max((r for r in range(DEEPEST + 1) if cell_side(r) >= km * stretch * 1.001), default=0)
    if cell_side(fine) < km * stretch:
        raise ValueError(f"{km} km reach beyond the neighbours of the largest cells")
    a = left.select(F.col(left_key), F.col(lat).alias("_lat"), F.col(lon).alias("_lon"), hex_cell(lat, lon, fine).alias("_cell"))
    b = right.select(F.col(right_key), F.col(lat).alias("_lat2"), F.col(lon).alias("_lon2"), F.explode(hex_ring(hex_cell(lat, lon, fine))).alias("_cell"))
    met = a.join(b, "_cell").withColumn("distance_km", haversine_km("_lat", "_lon", "_lat2", "_lon2"))
    return met.filter(F.col("distance_km") <= km).select(left_key, right_key, "distance_km")
