"""Near-duplicate vectors by Euclidean p-stable hashing and exact cosine checks.

Vectors are scaled to length one, where cosine c is a distance of sqrt(2 - 2c). Each of `tables` keys
joins `rows` quantised random projections floor((a.x + b) / width) with Gaussian a: nearby vectors agree on all
of a key with known chance, far ones hardly ever. Vectors that share a key (and the label) meet in blocks,
each pair only at the first key they share, and link if the cosine in double precision reaches the threshold.

Recall at the defaults: at cosine 0.98 (distance 0.2) with width 1.6 one projection agrees with chance
0.90, a key of 12 with 0.28, so no key of 48 with 2e-7; closer pairs are lost less often.

Equal vectors of a label are one class with a count, so copies cost one row each. Large buckets are
dealt to pairs of blocks; blocks emit counts and edges to their own roots, never all pairs.

Defined cases: a null label, a null or zero vector, or one with null or non-finite components links with
nothing and keeps itself; vectors of different lengths never link; null or repeated ids are separate rows,
null sorting last; an empty table gives an empty result.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .buckets import block_pairs, bucket_members, dealt, in_blocks, spanning
from .common import Scratch, col, matrix
from .components import components

THRESHOLD = 0.98
TABLES, ROWS, WIDTH = 48, 12, 1.6
SEED = 20


def collision(distance: float, width: float) -> float:
    """Chance that one quantised Gaussian projection agrees at this distance."""
    t = width / distance
    return math.erf(t / math.sqrt(2)) - 2 / (math.sqrt(2 * math.pi) * t) * (1 - math.exp(-t * t / 2))


def projections(dim: int, tables: int, rows: int, width: float) -> tuple[np.ndarray, np.ndarray]:
    draw = np.random.default_rng([SEED, dim])
    return draw.standard_normal((dim, tables * rows)), draw.uniform(0, width, tables * rows)


def hash_keys(x: np.ndarray, tables: int, rows: int, width: float) -> np.ndarray:
    """Keys [vector, table] of vectors of one length."""
    a, b = projections(x.shape[1], tables, rows, width)
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    cells = np.floor((unit @ a + b) / width).astype(np.int64).astype(np.uint64).reshape(len(x), tables, rows)
    out = np.full((len(x), tables), np.uint64(x.shape[1]), np.uint64)
    for k in range(rows):
        out = (out ^ cells[:, :, k]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return out.view(np.int64)


def mixed_with_label(keys: np.ndarray, labels: np.ndarray) -> np.ndarray:
    return keys ^ (labels.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)).view(np.int64)[:, None]


def _fingerprint(label: int, raw: bytes) -> int:
    return xxhash.xxh3_64_intdigest(raw + label.to_bytes(8, "little", signed=True)) - 2**63


def _classes(vectors: DataFrame) -> DataFrame:
    """(vec_id, label, fp, raw): raw holds the components as doubles; fp and raw are null where nothing can link."""

    def run(batches):
        for batch in batches:
            fp, raw = [], []
            for label, v in zip(batch.column(1).to_pylist(), batch.column(2)):
                x = None if v.as_py() is None or label is None else v.values
                ok = x is not None and len(x) > 0 and x.null_count == 0
                if ok:
                    data = x.to_numpy(zero_copy_only=False).astype(np.float64) + 0.0
                    ok = bool(np.isfinite(data).all()) and bool(data.any())
                if ok:
                    # a power of two changes no cosine and keeps the norms of tiny and huge vectors in range
                    data = np.ldexp(data, -int(np.frexp(np.abs(data).max())[1])) + 0.0
                fp.append(_fingerprint(label, data.tobytes()) if ok else None)
                raw.append(data.tobytes() if ok else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(fp, pa.int64()), pa.array(raw, pa.binary())], names=["vec_id", "label", "fp", "raw"])

    return vectors.mapInArrow(run, "vec_id long, label long, fp long, raw binary")


def _keyed(reps: DataFrame, tables: int, rows: int, width: float) -> DataFrame:
    """Keys per vector, mixed with the label, so that only equal labels meet."""

    def run(batches):
        for batch in batches:
            labels, raws = batch.column(1).to_numpy(), batch.column(2).to_pylist()
            sizes = np.array([len(r) for r in raws])
            keys = np.zeros((len(raws), tables), np.int64)
            for n in np.unique(sizes):
                at = np.flatnonzero(sizes == n)
                x = np.frombuffer(b"".join([raws[k] for k in at]), np.float64).reshape(len(at), -1)
                keys[at] = hash_keys(x, tables, rows, width)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(list(mixed_with_label(keys, labels)), pa.list_(pa.int64()))], names=["id", "keys"])

    return reps.select("id", "label", "raw").mapInArrow(run, "id long, keys array<long>")


def _linked(tables: int, rows: int, width: float, threshold: float):
    def work(block: pa.Table):
        # unlike lengths meet only if 64-bit keys collide, and never link
        sizes = np.array([len(r) for r in block.column("raw").to_pylist()])
        for size in np.unique(sizes):
            yield from one_length(block if (sizes == size).all() else block.filter(pa.array(sizes == size)))

    def one_length(block: pa.Table):
        ids, labels, copies = (block.column(c).to_numpy() for c in ("id", "label", "n_copies"))
        x = matrix(block.column("raw"), np.float64)
        norm = np.sqrt((x * x).sum(axis=1))
        keys = mixed_with_label(hash_keys(x, tables, rows, width), labels)
        links, found = np.zeros(len(ids), np.int64), []
        for i, j in block_pairs(block, keys, True):
            for at in range(0, len(i), 20_000):
                a, b = i[at : at + 20_000], j[at : at + 20_000]
                ok = ((x[a] * x[b]).sum(axis=1) / (norm[a] * norm[b]) >= threshold) & (labels[a] == labels[b])
                a, b = a[ok], b[ok]
                links += np.bincount(a, weights=copies[b], minlength=len(ids)).astype(np.int64)
                links += np.bincount(b, weights=copies[a], minlength=len(ids)).astype(np.int64)
                found.append((a, b))
        root = spanning(len(ids), found)
        some = np.flatnonzero(links)
        yield pa.RecordBatch.from_arrays([pa.array(ids[some]), pa.array(ids[root[some]]), pa.array(links[some])], names=["a", "b", "links"])

    return work


def embedding_dedup(vectors: DataFrame, id: str = "vec_id", vector: str = "embedding", label: str = "label", threshold: float = THRESHOLD,
                    tables: int = TABLES, rows: int = ROWS, width: float = WIDTH) -> DataFrame:
    """(vec_id, n_links, component_id, kept): one row per row of `vectors`, copies counted in `n_links`."""
    scratch = Scratch(vectors.sparkSession)
    slim = vectors.select(col(id).cast("long").alias("vec_id"), col(label).cast("long").alias("label"), col(vector).cast("array<double>").alias("vector"))
    classed = scratch.store(_classes(slim), "vectors")
    usable = classed.filter("fp is not null")
    counts = scratch.store(usable.groupBy("fp").agg(F.count("*").alias("n_copies"), F.min("vec_id").alias("class_id")), "classes")
    first = usable.groupBy("fp").agg(F.first("label").alias("label"), F.first("raw").alias("raw"))
    reps = scratch.store(first.join(counts.select("fp", "n_copies"), "fp").withColumnRenamed("fp", "id"), "reps")
    met = bucket_members(_keyed(reps, tables, rows, width)).join(reps, "id")
    linked = scratch.store(in_blocks(dealt(met, ["slot", "key"], "n"), _linked(tables, rows, width, threshold), "a long, b long, links long"), "links")
    roots = components(linked.select("a", "b"), scratch)
    links = linked.groupBy("a").agg(F.sum("links").alias("links")).withColumnRenamed("a", "fp")
    named = counts.join(roots.withColumnRenamed("id", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    lowest = named.groupBy("root").agg(F.min("class_id").alias("component_id"))
    named = named.join(links, "fp", "left").join(lowest, "root").select("fp", "component_id", (F.coalesce("links", F.lit(0)) + F.col("n_copies") - 1).alias("n_links"))
    out = classed.select("vec_id", "fp").join(named, "fp", "left")
    component = F.when(F.col("fp").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return out.select(
        F.col("vec_id").alias(id), F.coalesce("n_links", F.lit(0)).alias("n_links"), component.alias("component_id"),
        F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"),
    )
