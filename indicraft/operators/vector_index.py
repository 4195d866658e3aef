"""Inverted-file vector index: vectors stored by the list of their nearest centroid, searches read few lists.

Centroids come from spherical k-means rounds in which every task adds up its own vectors per list, so a round
shuffles one row per task and list. The index is a folder: `lists` holds all vectors partitioned by list, `stats` one row a
list with its centroid, size and narrowest cosine. A search picks lists by centroid; the filter on the partition column prunes
all other folders when the scan is planned, and what is read is scored exactly.

With `exact`, a second pass reads every list that could still hold a better row: a vector of a list stands within the list's
widest angle of its centroid, so its cosine with the query is at most cos(angle to the centroid - widest angle).

Vectors that are null, hold nulls or no finite numbers, or are zero have no direction: they are stored in list -1, which no search reads.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import held, materialize
from .windows import topk_per_group

#: Vectors that the centroids may be fitted on; every vector is indexed.
FIT_ROWS = 200_000
#: Vectors in one file of a list.
FILE_ROWS = 500_000
#: Queries of one search.
BLOCK_QUERIES = 10_000


def _rows(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(places of vectors with a direction, their unit vectors); all have the length of the first."""
    places, parts, dim = [], [], None
    for k, v in enumerate(column):
        x = None if v.as_py() is None or v.values.null_count or len(v.values) == 0 else v.values.to_numpy(zero_copy_only=False).astype(np.float64)
        if x is None or not np.isfinite(x).all() or not x.any():
            continue
        dim = len(x) if dim is None else dim
        if len(x) != dim:
            raise ValueError(f"vectors of {dim} and of {len(x)} components")
        x = x / np.abs(x).max()
        places.append(k)
        parts.append(x / math.sqrt(float(x @ x)))
    return np.array(places, dtype=np.int64), np.array(parts) if parts else np.zeros((0, dim or 0))


def train_centroids(vectors: DataFrame, lists: int, vector: str = "embedding", rounds: int = 8, seed: int = 7, fit_rows: int = FIT_ROWS) -> np.ndarray:
    """Unit centroids [list, component]; at most `lists`, fewer if there are fewer directions.

    Fitted on all vectors, or on a sample of about `fit_rows` where there are more. The driver holds
    lists x components numbers, whatever the number of vectors.
    """
    slim = vectors.select(F.col(vector).cast("array<double>").alias("v")).filter("v is not null")
    total = slim.count()
    if total > fit_rows:
        slim = slim.sample(fit_rows / total, seed)
    with held(slim, "kmeans") as fit:
        # starts: the vectors with the least hashes, so a rerun starts alike
        start = fit.select("v").distinct().orderBy(F.xxhash64("v", F.lit(seed)), "v").limit(4 * lists).toPandas()["v"]
        _, found = _rows(pa.array([list(x) for x in start], pa.list_(pa.float64())))
        centroids = found[:lists]
        for _ in range(rounds if len(centroids) > 1 else 0):
            sums = {r["list"]: np.frombuffer(r["total"]) for r in _sums(fit, centroids).collect()}
            new = np.array([sums.get(k, c) for k, c in enumerate(centroids)])
            size = np.linalg.norm(new, axis=1, keepdims=True)
            new = np.where(size > 0, new / np.where(size > 0, size, 1), centroids)
            if np.abs(new - centroids).max() < 1e-6:
                break
            centroids = new
    return centroids


def _sums(fit: DataFrame, centroids: np.ndarray) -> DataFrame:
    """(list, total): the vectors of each list added up, first in the tasks, then per list."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros_like(centroids)
        seen = np.zeros(len(centroids), bool)
        for batch in batches:
            _, x = _rows(batch.column(0))
            if len(x):
                at = (x @ centroids.T).argmax(axis=1)
                np.add.at(sums, at, x)
                seen[at] = True
        yield _packed(np.flatnonzero(seen), sums)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                sums[k] = sums.get(k, 0) + np.frombuffer(raw)
        keys = sorted(sums)
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int32()), pa.array([sums[k].tobytes() for k in keys], pa.binary())], names=["list", "total"])

    return fit.mapInArrow(add, "list int, total binary").repartition("list").mapInArrow(merge, "list int, total binary")


def _packed(lists: np.ndarray, sums: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(lists.astype(np.int32)), pa.array([sums[k].tobytes() for k in lists], pa.binary())], names=["list", "total"])


@dataclass
class VectorIndex:
    """An index folder; `centroids`, `sizes` and `narrowest` (the least cosine of a list's vectors with its centroid) have a row per list."""

    spark: SparkSession
    path: str
    centroids: np.ndarray
    sizes: np.ndarray
    narrowest: np.ndarray

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> VectorIndex:
        rows = spark.read.parquet(f"{path}/stats").orderBy("list").collect()
        return cls(spark, path, np.array([r["centroid"] for r in rows]), np.array([r["n"] for r in rows]), np.array([r["narrowest"] for r in rows]))

    def vectors(self) -> DataFrame:
        shape = self.spark.read.parquet(f"{self.path}/shape").schema
        return self.spark.read.schema(shape).parquet(f"{self.path}/lists")

    def reading(self, lists: list[int]) -> DataFrame:
        """The vectors of some lists; other folders are pruned at planning."""
        return self.vectors().filter(F.col("list").isin([int(k) for k in lists]))


def write_index(vectors: DataFrame, path: str, key: str, vector: str = "embedding", lists: int = 64, file_rows: int = FILE_ROWS, **fit) -> VectorIndex:
    """Index every row of `vectors` under `path`: (key, vector) by list. A crowded list is cut into files of about `file_rows`."""
    spark = vectors.sparkSession
    centroids = train_centroids(vectors, lists, vector, **fit)
    slim = vectors.select(F.col(key), F.col(vector).cast("array<double>").alias(vector))
    schema = T.StructType([*slim.schema.fields, T.StructField("list", T.IntegerType()), T.StructField("cosine", T.DoubleType())])

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, cosine = np.full(batch.num_rows, -1, np.int32), np.zeros(batch.num_rows)
            places, x = _rows(batch.column(1))
            if len(places) and len(centroids):
                scores = x @ centroids.T
                at[places], cosine[places] = scores.argmax(axis=1), scores.max(axis=1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(at), pa.array(cosine)], names=schema.names)

    with held(slim.mapInArrow(assign, schema), "assigned") as assigned:
        known = {r["list"]: r for r in assigned.groupBy("list").agg(F.count("*").alias("n"), F.min("cosine").alias("narrowest")).collect()}
        stats = [(k, centroids[k].tolist(), int(known[k]["n"]) if k in known else 0, float(known[k]["narrowest"]) if k in known else 1.0) for k in range(len(centroids))]
        files = [max(1, math.ceil(known[k]["n"] / file_rows)) if k in known else 1 for k in range(-1, len(centroids))]
        # one row per list, so the array is as bounded as the centroids are
        part = F.pmod(F.xxhash64(key), F.element_at(F.array(*[F.lit(n) for n in files]), F.col("list") + 2))
        assigned.drop("cosine").limit(0).write.parquet(f"{path}/shape")
        assigned.drop("cosine").repartition("list", part).write.option("maxRecordsPerFile", file_rows).partitionBy("list").parquet(f"{path}/lists")
    spark.createDataFrame(stats, "list int, centroid array<double>, n long, narrowest double").coalesce(1).write.parquet(f"{path}/stats")
    return VectorIndex.load(spark, path)


def _bounds(index: VectorIndex, cosines: np.ndarray) -> np.ndarray:
    """The largest cosine that a vector of each list can have with each query."""
    apart = np.arccos(np.clip(cosines, -1, 1)) - np.arccos(np.clip(index.narrowest, -1, 1))[None, :]
    return np.cos(np.maximum(apart, 0)) + 1e-9


def _kept(rows: pd.DataFrame, want: int) -> pd.DataFrame:
    """Best `want` rows per query; copies share a score, so the smallest keys fill the remaining places."""
    return rows.sort_values(["qi", "score", "k"], ascending=[True, False, True], kind="stable").groupby("qi", sort=False).head(want)


def _scan(index: VectorIndex, matrix: np.ndarray, asked: np.ndarray, key: str, vector: str, want: int, threshold: float) -> DataFrame:
    """(qi, k, score, place): the best rows of the lists that each query asks for (`asked` [query, list])."""
    lists = np.flatnonzero(asked.any(axis=0)).tolist()
    rows = index.reading(lists).select(F.col(key).alias("k"), F.col(vector).alias("v"), "list")
    key_type = rows.schema["k"].dataType.simpleString()

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, waiting = [], 0
        for batch in batches:
            at_list = batch.column(2).to_numpy()
            for n in np.unique(at_list):
                queries = np.flatnonzero(asked[:, n])
                part = batch.filter(pa.array(at_list == n))
                for start in range(0, part.num_rows, 1_024):
                    some = part.slice(start, 1_024)
                    places, x = _rows(some.column(1))
                    scores = x @ matrix[queries].T
                    r, q = np.nonzero(scores >= threshold)
                    if r.size:
                        keys = some.column(0).take(pa.array(places[r])).to_pandas()
                        found.append(pd.DataFrame({"qi": queries[q].astype(np.int32), "k": keys, "score": scores[r, q]}))
                        waiting += r.size
            if waiting > 4 * want * len(matrix) + 100_000:
                found = [_kept(pd.concat(found), want)]
                waiting = len(found[0])
        if found:
            yield pa.RecordBatch.from_pandas(_kept(pd.concat(found), want), preserve_index=False)

    return topk_per_group(rows.mapInArrow(best, f"qi int, k {key_type}, score double"), "qi", [F.col("score").desc(), F.col("k")], want, "place")


def search(index: VectorIndex, queries: DataFrame, query_key: str, key: str, vector: str = "embedding", k: int = 20, probes: int = 4,
           threshold: float = 0.35, exact: bool = False, block: int = BLOCK_QUERIES) -> DataFrame:
    """Up to `k` rows per query with cosine >= threshold: (query, key, score, place), from the `probes` nearest lists.

    Queries are cut into blocks of about `block` by the hash of their key. Queries without a direction find nothing.
    """
    blocks = max(1, -(-queries.count() // block))
    out = None
    for at in range(blocks):
        part = queries.filter(F.pmod(F.xxhash64(query_key), F.lit(blocks)) == at) if blocks > 1 else queries
        found = _search(index, part, query_key, key, vector, k, probes, threshold, exact)
        out = found if out is None else out.unionByName(found)
    return out


def probed(index: VectorIndex, matrix: np.ndarray, probes: int) -> np.ndarray:
    """[query, list]: the `probes` lists whose centroids are nearest, empty lists left out."""
    cosines = np.where(index.sizes[None, :] > 0, matrix @ index.centroids.T, -2.0)
    nearest = np.argsort(-cosines, axis=1, kind="stable")[:, :probes]
    asked = np.zeros(cosines.shape, bool)
    np.put_along_axis(asked, nearest, True, axis=1)
    return asked & (index.sizes[None, :] > 0)


def _search(index: VectorIndex, queries: DataFrame, query_key: str, key: str, vector: str, want: int, probes: int, threshold: float, exact: bool) -> DataFrame:
    # a block of queries, bounded by `block`
    rows = queries.select(F.col(query_key).alias("q"), F.col(vector).cast("array<double>").alias("v")).collect()
    places, matrix = _rows(pa.array([r["v"] for r in rows], pa.list_(pa.float64())))
    names_type = T.StructType([T.StructField("qi", T.IntegerType()), T.StructField(query_key, queries.schema[query_key].dataType)])
    names = index.spark.createDataFrame([(i, rows[p]["q"]) for i, p in enumerate(places.tolist())], names_type)
    if len(matrix) == 0 or len(index.centroids) == 0:
        nothing = index.vectors().filter(F.lit(False)).select(F.lit(0).alias("qi"), F.col(key), F.lit(0.0).alias("score"), F.lit(0).alias("place"))
        return nothing.join(names, "qi").select(query_key, key, "score", "place")
    asked = probed(index, matrix, probes)
    hits = _scan(index, matrix, asked, key, vector, want, threshold)
    if exact:
        hits = materialize(hits, "probed")
        full = {r["qi"]: r["least"] for r in hits.groupBy("qi").agg(F.count("*").alias("n"), F.min("score").alias("least")).filter(F.col("n") == want).collect()}
        floor = np.array([full.get(i, threshold) for i in range(len(matrix))])
        more = ~asked & (index.sizes[None, :] > 0) & (_bounds(index, matrix @ index.centroids.T) >= floor[:, None])
        if more.any():
            both = hits.drop("place").unionByName(_scan(index, matrix, more, key, vector, want, threshold).drop("place"))
            hits = topk_per_group(both, "qi", [F.col("score").desc(), F.col("k")], want, "place")
    return hits.join(names, "qi").select(query_key, F.col("k").alias(key), "score", "place")


def rows_read(index: VectorIndex, asked: np.ndarray) -> int:
    """Vectors that a search of these lists reads."""
    return int(index.sizes[asked.any(axis=0)].sum())


def recall(found: DataFrame, truth: DataFrame, query_key: str, key: str) -> Column:
    """Share of the rows of `truth` that `found` holds, as a scalar."""
    hit = truth.select(query_key, key).join(found.select(query_key, key, F.lit(1).alias("hit")), [query_key, key], "left")
    return hit.agg(F.avg(F.coalesce("hit", F.lit(0))).alias("recall")).scalar()
