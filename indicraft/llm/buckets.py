"""Pairs that share a hash bucket, met in blocks of bounded size and without repeating a pair."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bundles

#: Most members of a bucket that meet in one block; larger buckets are dealt to pairs of blocks.
BLOCK_ROWS = 1_024


def bucket_members(items: DataFrame) -> DataFrame:
    """`items` (id long, keys array<long>, one key per table) → (slot, key, id, n) of buckets with company.

    Buckets of several tables with the very same members are kept once, for the first table: the first
    table in which two items collide is then always kept for them. Member sets are compared by their
    size and two sums of hashes, so no bucket is ever gathered; one exchange serves counting and lookup.
    """
    rows = items.select("id", F.posexplode("keys").alias("slot", "key")).repartition("slot", "key")
    sets = rows.groupBy("slot", "key").agg(
        F.count("*").alias("n"),
        F.bit_xor(F.xxhash64("id", F.lit(1))).alias("x"),
        F.bit_xor(F.xxhash64("id", F.lit(2))).alias("y"),
    ).filter("n > 1")
    kept = sets.groupBy("n", "x", "y").agg(F.min(F.struct("slot", "key")).alias("first")).select("n", "first.slot", "first.key")
    return rows.join(kept, ["slot", "key"])


def dealt(rows: DataFrame, by: list[str], n: str, most: int = BLOCK_ROWS) -> DataFrame:
    """Deal the rows of each group (its size in `n`) to blocks: adds `block` (group key), `part`, `left`, `right`.

    A group of at most `most` rows is one block. A larger one is cut into parts by the hash of the id
    and every two parts meet in a block of their own, so a task never holds more than two parts and
    one group's work spreads over all executors.
    """
    parts = F.ceil(F.col(n) / F.lit(most)).cast("int")
    rows = rows.withColumn("parts", parts).withColumn("part", F.pmod(F.xxhash64("id", F.lit(3)), F.col("parts")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    rows = rows.withColumn("left", F.least("part", "other")).withColumn("right", F.greatest("part", "other"))
    return rows.withColumn("block", F.xxhash64(*by, "left", "right")).drop("parts", "other")


def in_blocks(rows: DataFrame, work: Callable[[pa.Table], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """Run `work` on whole blocks of `dealt`, which stream through a sorted partition; small ones come in bundles."""

    def run(batches):
        for block in bundles(batches, "block"):
            yield from work(block)

    return rows.repartition("block").sortWithinPartitions("block").mapInArrow(run, schema)


def block_pairs(block: pa.Table, keys: np.ndarray, slotted: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs (i, j) inside the blocks of a table that share a key.

    With `slotted` only pairs whose first shared table is the block's own `slot`. Between two parts of a large
    group only pairs of unlike parts count, the others meet elsewhere.
    """
    ids, part = block.column("block").to_numpy(), block.column("part").to_numpy()
    cross = block.column("left").to_numpy() != block.column("right").to_numpy()
    slot = block.column("slot").to_numpy() if slotted else None
    if ids[0] == ids[-1] and len(ids) > 16:
        yield from candidate_pairs(keys, part, bool(cross[0]), int(slot[0]) if slotted else None)
        return
    for step in range(1, len(ids)):
        i = np.flatnonzero(ids[step:] == ids[:-step])
        if len(i) == 0:
            return
        j = i + step
        shared = keys[i] == keys[j]
        ok = shared.any(axis=1) & (~cross[i] | (part[i] != part[j]))
        if slotted:
            ok &= shared.argmax(axis=1) == slot[i]
        if ok.any():
            yield i[ok], j[ok]


def candidate_pairs(keys: np.ndarray, part: np.ndarray, cross: bool, slot: int | None, rows: int = 256) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs (i, j) of a block that share a key; with `slot`, only pairs whose first shared table it is."""
    n = len(keys)
    if cross:
        left, right = np.flatnonzero(part == part.min()), np.flatnonzero(part != part.min())
    else:
        left = right = np.arange(n)
    for start in range(0, len(left), rows):
        a = left[start : start + rows]
        b = right if cross else np.arange(a[0] + 1, n)
        if len(b) == 0:
            continue
        if slot is None:
            hit = np.zeros((len(a), len(b)), dtype=bool)
            for t in range(keys.shape[1]):
                hit |= keys[a, t][:, None] == keys[b, t][None, :]
        else:
            hit = keys[a, slot][:, None] == keys[b, slot][None, :]
            for t in range(slot):
                hit &= keys[a, t][:, None] != keys[b, t][None, :]
        if not cross:
            hit &= b[None, :] > a[:, None]
        i, j = np.nonzero(hit)
        for at in range(0, len(i), 200_000):
            yield a[i[at : at + 200_000]], b[j[at : at + 200_000]]


def spanning(n: int, pairs: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Least index of each index's component under `pairs`."""
    root = np.arange(n)
    if not pairs:
        return root
    a, b = np.concatenate([p[0] for p in pairs]), np.concatenate([p[1] for p in pairs])
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        new = new[new]
        if np.array_equal(new, root):
            return root
        root = new
