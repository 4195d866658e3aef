"""Connected components by repeated contraction, without gathering the graph anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """`edges` (a long, b long) → (id, root): one row per vertex, equal roots when connected.

    Every round each vertex joins the neighbour (or itself) with the least hash under that
    round's seed, edges are renamed and loops dropped. A random order at least about halves
    the vertices per round whatever the shape, so a path of a million vertices takes some 20
    rounds and stars take two or three. Minima are combined before the shuffle, so a hub with a
    third of all edges is no hot task. Each round is stored, so lineage stays one round deep.
    """
    edges = scratch.store(edges.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    maps: list[DataFrame] = []
    seed = 0
    while not edges.isEmpty():
        both = edges.select("a", "b").union(edges.select("b", "a")).toDF("id", "to")
        order = lambda c, s=seed: F.struct(F.xxhash64(F.col(c), F.lit(s)).alias("h"), F.col(c).alias("v"))
        nearest = both.groupBy("id").agg(F.min(order("to")).alias("m")).select("id", F.least(F.col("m"), order("id")).getField("v").alias("to"))
        nearest = scratch.store(nearest, "contract")
        renamed = (
            edges.join(nearest.toDF("a", "x"), "a").join(nearest.toDF("b", "y"), "b").filter("x <> y")
            .select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
        )
        renamed = scratch.store(renamed, "edges")
        scratch.drop(edges)
        edges, seed = renamed, seed + 1
        maps.append(nearest)
    scratch.drop(edges)
    if not maps:
        return edges.sparkSession.createDataFrame([], "id long, root long")
    out = maps[0].toDF("id", "root")
    for step in maps[1:]:
        out = out.join(step.toDF("root", "next"), "root", "left").select("id", F.coalesce("next", "root").alias("root"))
    return out
