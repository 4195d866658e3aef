"""Jaccard self-join on word n-grams with Bayesian pruning of MinHash candidates.

Texts become sets of hashed word 5-grams (lower case, `\\w+`; a shorter text with a word is one gram).
Texts with equal sets are one class and join the rest through one representative. Candidates are
pairs that agree on all MinHash values of some band. Their values are compared step by step: with a
uniform prior, `m` agreements of `n` give a Beta(m + 1, n - m + 1) posterior of the similarity, and
a pair is dropped as soon as the posterior chance of reaching the threshold falls below the
tolerance. What survives is verified exactly on the whole sets.

Recall: at the default 40 bands of 5 values a pair at exactly 0.8 shares no band with chance 1.3e-7
(less above it), and a tolerance of 1e-9 loses about as little again. Links are counted inside blocks and
never emitted pair by pair; what leaves a block is one count per row and edges to the block's own roots.

Defined cases: null, empty and wordless texts link with nothing; equal texts link with each other; null or
repeated ids are separate rows (a repeated row is a copy of itself); an empty table gives an empty result.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .buckets import block_pairs, bucket_members, dealt, in_blocks, spanning
from .common import Scratch, col, fresh, map_texts, matrix, text_or_empty
from .components import components

WORD = re.compile(r"\w+")
WORDS = 5
THRESHOLD = 0.8
BANDS, ROWS = 40, 5
TOLERANCE = 1e-9
#: Hashes compared between two looks at the posterior.
STEP = 20
#: Texts that meet in one block of exact checks.
VERIFY_ROWS = 512
MIX = np.uint64(0x9E3779B97F4A7C15)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


def shingles(text: str, size: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word n-grams of a text."""
    words = WORD.findall(text.lower())
    if not words:
        return np.zeros(0, np.uint64)
    digest = xxhash.xxh3_64_intdigest
    h = np.fromiter((digest(w) for w in words), dtype=np.uint64, count=len(words))
    n = max(1, len(h) - size + 1)
    out = np.zeros(n, np.uint64)
    for k in range(min(size, len(h))):
        out = _mixed(out * MIX + h[k : k + n] + np.uint64(1))
    return np.unique(out)


def minhash(grams: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Least value per hash function of non-empty grams, as 32-bit numbers."""
    best = np.full(len(a), np.iinfo(np.uint64).max, np.uint64)
    for start in range(0, len(grams), 256):
        part = grams[start : start + 256]
        values = part[None, :] * a[:, None]
        values += b[:, None]
        np.minimum(best, values.min(axis=1), out=best)
    return (best >> np.uint64(32)).astype(np.uint32)


def functions(count: int, seed: int = 1) -> tuple[np.ndarray, np.ndarray]:
    draw = np.random.default_rng(seed).integers(0, 2**64, (2, count), dtype=np.uint64)
    return draw[0] | np.uint64(1), draw[1]


def least_matches(hashes: int, step: int, threshold: float, tolerance: float) -> list[tuple[int, int]]:
    """(n, least agreements among the first n) at which the posterior still reaches the tolerance.

    For whole m and n the tail of Beta(m + 1, n - m + 1) above t equals the chance that a
    Binomial(n + 1, t) is at most m, so the table is exact.
    """
    out = []
    for n in range(step, hashes + 1, step):
        tail, m = 0.0, 0
        while m <= n:
            tail += math.comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
            if tail >= tolerance:
                break
            m += 1
        out.append((n, m))
    return out


def sketch(docs: DataFrame, text: str, size: int, bands: int, rows: int) -> DataFrame:
    """Append `fp` (id of the shingle set, null without one), `n_grams` and `sig` (32-bit MinHash values)."""
    source = "_sketch_text"
    add = T.StructType([T.StructField("fp", T.LongType()), T.StructField("n_grams", T.LongType()), T.StructField("sig", T.BinaryType())])

    def run(batch: pa.RecordBatch) -> dict:
        a, b = functions(bands * rows)
        fp, count, sig = [], [], []
        for t in batch.column(batch.schema.names.index(source)).to_pylist():
            grams = shingles(t, size)
            count.append(len(grams))
            if len(grams):
                fp.append(xxhash.xxh3_64_intdigest(grams.tobytes()) - 2**63)
                sig.append(minhash(grams, a, b).tobytes())
            else:
                fp.append(None)
                sig.append(None)
        return {"fp": fp, "n_grams": count, "sig": sig}

    return map_texts(docs.withColumn(source, text_or_empty(text)), run, add, source).drop(source)


def band_keys(sig: np.ndarray, bands: int, rows: int) -> np.ndarray:
    x = sig.reshape(len(sig), bands, rows).astype(np.uint64)
    out = np.zeros((len(sig), bands), np.uint64)
    for k in range(rows):
        out = _mixed(out * MIX + x[:, :, k] + np.uint64(1))
    return out.view(np.int64)


def _with_keys(reps: DataFrame, bands: int, rows: int) -> DataFrame:
    def run(batches):
        for batch in batches:
            if batch.num_rows:
                keys = band_keys(matrix(batch.column(1), np.uint32), bands, rows)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(list(keys), type=pa.list_(pa.int64()))], names=["id", "keys"])

    return reps.select("id", "sig").mapInArrow(run, "id long, keys array<long>")


def bayes_filter(sig: np.ndarray, i: np.ndarray, j: np.ndarray, least: list[tuple[int, int]]) -> np.ndarray:
    """Mask of the pairs that are never dropped while their values are compared step by step."""
    alive, matches, done = np.arange(len(i)), np.zeros(len(i), np.int64), 0
    for n, m in least:
        matches = matches + (sig[i[alive], done:n] == sig[j[alive], done:n]).sum(axis=1)
        ok = matches >= m
        alive, matches, done = alive[ok], matches[ok], n
    mask = np.zeros(len(i), bool)
    mask[alive] = True
    return mask


def _edges(ids: np.ndarray, root: np.ndarray) -> pa.RecordBatch:
    moved = np.flatnonzero(root != np.arange(len(root)))
    return pa.RecordBatch.from_arrays([pa.array(ids[moved]), pa.array(ids[root[moved]])], names=["a", "b"])


def _survivors(bands: int, rows: int, least: list[tuple[int, int]]) -> Callable:
    def work(block: pa.Table):
        ids = block.column("id").to_numpy()
        sig = matrix(block.column("sig"), np.uint32)
        found = []
        for i, j in block_pairs(block, band_keys(sig, bands, rows), True):
            ok = bayes_filter(sig, i, j, least)
            if ok.any():
                found.append((i[ok], j[ok]))
        if found:
            yield _edges(ids, spanning(len(ids), found))

    return work


def overlaps(sets: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Exact intersection sizes of the sets of pairs."""
    if len(i) <= 4 * len(sets):
        return np.array([len(np.intersect1d(sets[a], sets[b], assume_unique=True)) for a, b in zip(i, j)], dtype=np.int64)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    values, at, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = times[at] > 1
    number = np.cumsum(times > 1) - 1
    owner, at = owner[shared], number[at[shared]]
    out = np.zeros((len(sets), len(sets)), np.float32)
    for start in range(0, int((times > 1).sum()), 4_096):
        inside = (at >= start) & (at < start + 4_096)
        rows = np.zeros((len(sets), 4_096), np.float32)
        rows[owner[inside], at[inside] - start] = 1
        out += rows @ rows.T
    return np.rint(out[i, j]).astype(np.int64)


def _verified(size: int, bands: int, rows: int, least: list[tuple[int, int]], threshold: float) -> Callable:
    def work(block: pa.Table):
        # a row that repeats its id and text came along; each class counts once per block
        keys = np.stack([block.column("block").to_numpy(), block.column("id").to_numpy()], axis=1)
        _, once = np.unique(keys, axis=0, return_index=True)
        block = block.take(pa.array(np.sort(once)))
        ids = block.column("id").to_numpy()
        sig = matrix(block.column("sig"), np.uint32)
        copies = block.column("n_copies").to_numpy()
        sets = [shingles(t, size) for t in block.column("text").to_pylist()]
        sizes = np.array([len(s) for s in sets], dtype=np.int64)
        links, found = np.zeros(len(ids), np.int64), []
        for i, j in block_pairs(block, band_keys(sig, bands, rows), False):
            ok = bayes_filter(sig, i, j, least)
            i, j = i[ok], j[ok]
            if not len(i):
                continue
            both = overlaps(sets, i, j)
            ok = both >= threshold * (sizes[i] + sizes[j] - both)
            i, j = i[ok], j[ok]
            links += np.bincount(i, weights=copies[j], minlength=len(ids)).astype(np.int64)
            links += np.bincount(j, weights=copies[i], minlength=len(ids)).astype(np.int64)
            found.append((i, j))
        root = spanning(len(ids), found)
        some = np.flatnonzero(links)
        yield pa.RecordBatch.from_arrays([pa.array(ids[some]), pa.array(ids[root[some]]), pa.array(links[some])], names=["a", "b", "links"])

    return work


def ngram_join(docs: DataFrame, id: str = "doc_id", text: str = "text", size: int = WORDS, threshold: float = THRESHOLD,
               bands: int = BANDS, rows: int = ROWS, tolerance: float = TOLERANCE) -> DataFrame:
    """(id, text_hash, fp, root, n_links, class_id, component_id): one row per row of `docs`.

    `class_id` is the least id among rows with the same shingle set, `component_id` the least id
    reachable by links, both the row's own for a text without words; `n_links` counts the other
    rows linked directly, copies included. `text_hash` tells rows of one id apart, `fp` names
    the shingle set and `root` the component (both null for a text without words).
    """
    spark = docs.sparkSession
    scratch = Scratch(spark)
    least = least_matches(bands * rows, STEP, threshold, tolerance)
    slim = docs.select(col(id).cast("long").alias("doc_id"), text_or_empty(text).alias("text"))
    keyed = slim.withColumn("text_hash", F.xxhash64("text"))
    sketched = scratch.store(sketch(keyed, "text", size, bands, rows).drop("text"), "sketch")

    first = F.struct(F.coalesce("doc_id", F.lit(2**63 - 1)).alias("d"), "text_hash")
    classes = sketched.filter("fp is not null").groupBy("fp").agg(F.min(first).alias("rep"), F.count("*").alias("n_copies"), F.min("doc_id").alias("class_id"))
    lead = F.struct(F.coalesce("doc_id", F.lit(2**63 - 1)).alias("d"), F.col("text_hash"))
    # one signature per class; equal (id, text) rows carry equal signatures
    reps = scratch.store(sketched.filter("fp is not null").groupBy("fp").agg(F.min_by("sig", lead).alias("sig")).withColumnRenamed("fp", "id"), "reps")
    classes = scratch.store(classes, "classes")

    met = bucket_members(_with_keys(reps, bands, rows)).join(reps, "id")
    survivors = in_blocks(dealt(met, ["slot", "key"], "n"), _survivors(bands, rows, least), "a long, b long")
    tight = scratch.store(components(survivors, scratch), "tight")

    sizes = tight.groupBy("root").agg(F.count("*").alias("n"))
    wanted = (
        tight.join(sizes, "root").join(classes.select(F.col("fp").alias("id"), "rep", "n_copies"), "id").join(reps, "id")
        .select("id", "root", "n", "n_copies", "sig", F.col("rep.d").alias("d"), F.col("rep.text_hash").alias("text_hash"))
    )
    texts = keyed.select(F.coalesce("doc_id", F.lit(2**63 - 1)).alias("d"), "text_hash", "text")
    found = texts.join(wanted, ["d", "text_hash"]).drop("d", "text_hash")
    verified = scratch.store(in_blocks(dealt(found, ["root"], "n", VERIFY_ROWS), _verified(size, bands, rows, least, threshold), "a long, b long, links long"), "verified")
    scratch.drop(tight)
    links = verified.groupBy("a").agg(F.sum("links").alias("links"))
    roots = components(verified.select("a", "b"), scratch)

    named = classes.join(roots.select(F.col("id").alias("fp"), "root"), "fp", "left").join(links.withColumnRenamed("a", "fp"), "fp", "left")
    named = named.withColumn("root", F.coalesce("root", "fp"))
    lowest = named.groupBy("root").agg(F.min("class_id").alias("component_id"))
    named = named.join(lowest, "root").select("fp", "root", "class_id", "component_id", (F.coalesce("links", F.lit(0)) + F.col("n_copies") - 1).alias("n_links"))
    out = sketched.drop("sig").join(named, "fp", "left")
    return out.select(
        F.col("doc_id").alias(id), "text_hash", "fp", "root", F.coalesce("n_links", F.lit(0)).alias("n_links"),
        F.when(F.col("fp").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
        F.when(F.col("fp").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"),
    )


def keep_one(docs: DataFrame, id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The rows of `docs` without near-duplicates: of each component the row with the least id stays.

    Equal ids are told apart by their text; of rows equal in both one stays. Rows without words have no
    duplicates but their exact repetitions. The repetitions go first, so a repeated row is limited to one per
    task before any shuffle, and the join below reuses that exchange.
    """
    joined = ngram_join(docs, id, text, **options)
    d, h = F.coalesce(col(id).cast("long"), F.lit(2**63 - 1)), F.xxhash64(text_or_empty(text))
    order = F.struct(F.coalesce(F.col(id), F.lit(2**63 - 1)).alias("d_"), F.col("text_hash").alias("h_"))
    # a component is named by its root, so null ids and shared ids don't mix components
    linked = joined.filter("root is not null").groupBy("root").agg(F.min(order).alias("kept")).select("kept.*")
    lone = joined.filter("root is null").select(order.alias("kept")).select("kept.*").distinct()
    kept = linked.unionByName(lone)
    names = docs.columns
    dk, hk = fresh(docs, "d_"), fresh(docs, "h_")
    place = fresh(docs, "place_")
    rows = docs.withColumn(dk, d).withColumn(hk, h)
    rows = rows.withColumn(place, F.row_number().over(Window.partitionBy(dk, hk).orderBy(F.lit(1)))).filter(col(place) == 1)
    return rows.join(kept.select(F.col("d_").alias(dk), F.col("h_").alias(hk)), [dk, hk], "left_semi").select(*[col(c) for c in names])
