"""Hexagonal cells: neighbours, parents and joins against plain geometry."""

import math
import random

import pytest
from pyspark.sql import functions as F

from indicraft.functions import hexgrid as hx
from indicraft.functions.geo import haversine_km


@pytest.fixture(scope="module")
def places(spark):
    rng = random.Random(5)
    rows = [(k, rng.uniform(18, 70), rng.uniform(-178, -66)) for k in range(400)]
    return spark.createDataFrame(rows + [(400, None, -90.0), (401, 40.0, None), (402, float("nan"), 1.0), (403, 95.0, 1.0)], "id int, lat double, lon double")


def test_positions_lie_in_their_cell(places):
    for r in (0, 4, 8, 12):
        cells = places.withColumn("c", hx.hex_cell("lat", "lon", r)).withColumn("m", hx.hex_center("c"))
        again = cells.filter("c is not null").select("c", hx.hex_cell("m.lat", "m.lon", r).alias("d"))
        assert cells.filter("c is null").count() == 4
        if r > 1:
            assert again.filter("c <> d").count() == 0
            plane = "sqrt(pow((radians(lon) - radians(m.lon)) * {a}, 2) + pow((sin(radians(lat)) - sin(radians(m.lat))) * {b}, 2))"
            a, b = 6371 * math.cos(hx.TRUE_LATITUDE), 6371 / math.cos(hx.TRUE_LATITUDE)
            assert cells.filter("c is not null").select(F.max(F.expr(plane.format(a=a, b=b)))).first()[0] <= hx.cell_side(r) * 1.000001


def test_rings_hold_distinct_neighbours_at_their_distance(places):
    for k in (0, 1, 2, 4):
        rows = places.limit(20).select(hx.hex_cell("lat", "lon", 7).alias("c")).select("c", F.explode(hx.hex_ring("c", k)).alias("n"))
        got = rows.groupBy("c").agg(F.countDistinct("n").alias("n"), F.max(hx.hex_distance("c", "n")).alias("far")).collect()
        assert all(r["n"] == 3 * k * (k + 1) + 1 and r["far"] == k for r in got)
    back = places.limit(20).select(hx.hex_cell("lat", "lon", 7).alias("c")).select("c", F.explode(hx.hex_ring("c")).alias("n"))
    assert back.filter(~F.array_contains(hx.hex_ring("n"), F.col("c"))).count() == 0


def test_a_parent_has_seven_children_around_one_middle(places):
    parents = places.select(hx.hex_parent(hx.hex_cell("lat", "lon", 6), 5).alias("p")).filter("p is not null").distinct()
    inner = parents.select("p", hx.hex_center("p").alias("m")).select("p", F.explode(hx.hex_ring(hx.hex_cell("m.lat", "m.lon", 6), 3)).alias("child"))
    own = inner.filter(hx.hex_parent("child", 5) == F.col("p"))
    middle = hx.hex_cell("m.lat", "m.lon", 6)
    assert {r["count"] for r in own.groupBy("p").count().collect()} == {7}
    near = own.withColumn("m", hx.hex_center("p")).select(hx.hex_distance(middle, "child").alias("d")).groupBy("d").count().collect()
    n = parents.count()
    assert {r["d"]: r["count"] for r in near} == {0: n, 1: 6 * n}


def test_parents_compose_and_finer_ones_are_null(places):
    c = hx.hex_cell("lat", "lon", 9)
    got = places.select((hx.hex_parent(c, 4) == hx.hex_parent(hx.hex_parent(c, 6), 4)).alias("same"), hx.hex_parent(c, 10).alias("finer"), (hx.hex_parent(c, 9) == c).alias("own")).limit(400).collect()
    assert all(r["same"] and r["own"] for r in got if r["same"] is not None) and all(r["finer"] is None for r in got)


def test_resolution_picker():
    assert [hx.resolution_for_area(a) for a in (5e6, 36, 5.161, 0.737, 0.1, 0)] == [0, 6, 7, 8, 9, 12]
    with pytest.raises(ValueError):
        hx.hex_cell("lat", "lon", 13)


def test_pairs_within_equal_all_pairs(spark, places):
    near = spark.createDataFrame([(k, 44.0 + k * 0.01, -100.0 + (k % 7) * 0.02) for k in range(60)] + [(99, 71.9, -150.0), (98, 71.9, -150.3)], "id int, lat double, lon double")
    other = near.withColumnRenamed("id", "other")
    for km in (2.0, 15.0, 60.0):
        met = near.crossJoin(other.withColumnsRenamed({"lat": "lat2", "lon": "lon2"})).filter(haversine_km("lat", "lon", "lat2", "lon2") <= km)
        want = sorted((r["id"], r["other"]) for r in met.collect())
        got = sorted((r["id"], r["other"]) for r in hx.hex_pairs_within(near, other, "id", "other", "lat", "lon", km).collect())
        assert got == want and len(want) > 62


def test_nearby_counts_a_crowded_cell_once(spark):
    crowd = spark.range(5_000).select(F.lit(44.0).alias("lat"), F.lit(-100.0).alias("lon"))
    got = hx.hex_nearby(crowd, crowd.limit(70), "lat", "lon", 8).collect()
    assert [(r["n_left"], r["n_right"]) for r in got] == [(5_000, 70)]
