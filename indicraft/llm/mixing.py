"""Mixing sources to target sizes by entropy balancing.

Documents get rates as close as possible (in relative entropy, against a rate of one) to taking all
once, under one constraint per source: its taken words equal its target. The dual of this convex
problem has one multiplier per source and the solution is an exponential tilt by size, stopped at the
largest rate: rate = min(cap, exp(multiplier * size / mean size of the source)). Newton steps, kept in
a bracket, solve all sources at once; each step is one aggregation over (source, size) cells with counts,
which are exact because rates depend on nothing else. Rates become whole copies cell by cell: a cell's
copies follow its expected words plus what the larger sizes of the source left over, so a source misses
its target by about half its shortest document. Inside a cell, documents with the least hash of the
id take the copy that does not divide evenly.

Defined cases: null text has size 0; a null source is a source of its own and sorts last; a document of size
0 takes 0 words; rows that repeat an id and size within a source are taken alike; an empty table gives an
empty result. Sums run in decimals, so reruns agree whatever the order of the tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, col, fresh, groups, text_or_empty

#: Newton steps at most; a step that leaves the bracket halves it, so this many always suffice.
STEPS = 60
#: Relative miss of a source's words at which the steps stop.
CLOSE = 1e-7
#: Hash ranges per cell in which the last taken document is looked for.
RANGES = 256


def word_count(text: str) -> Column:
    return F.coalesce(F.regexp_count(text_or_empty(text), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def _exact(c: Column) -> Column:
    return F.sum(c.cast("decimal(38,10)")).cast("double")


def ranked(sources: DataFrame, name: str, scratch: Scratch) -> DataFrame:
    """Number the sources 0, 1, ... by code point, null last, by range slices with offsets."""
    order = [F.col(name).asc_nulls_last()]
    sliced = scratch.store(sources.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id()), "sources")
    slices = sliced.groupBy(F.shiftright("at", 33).alias("slice")).agg(F.count("*").alias("n"))
    # one row per slice, and there are at most as many slices as shuffle partitions
    before = F.sum("n").over(Window.partitionBy(F.lit(0)).orderBy("slice").rowsBetween(Window.unboundedPreceding, -1))
    offsets = slices.select("slice", F.coalesce(before, F.lit(0)).alias("offset"))
    out = sliced.join(offsets, F.shiftright("at", 33) == F.col("slice"))
    return out.withColumn("rank", F.col("offset") + F.col("at").bitwiseAND(F.lit(2**33 - 1))).drop("at", "slice", "offset")


def targets(sources: DataFrame, weights: tuple[float, ...], share: float, cap: float, scratch: Scratch) -> DataFrame:
    """Add `target` to ranked sources (source_size): weights repeat by rank, excess above the cap is reshared."""
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    table = scratch.store(sources.withColumn("weight", weight), "weights")
    most = F.col("source_size") * F.lit(float(cap))
    total = float(table.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0]) * share
    level = None
    while True:  # the set of capped sources only grows, usually for a handful of rounds
        full = F.lit(False) if level is None else most <= F.col("weight") * F.lit(level)
        held, free = table.agg(F.coalesce(_exact(F.when(full, most)), F.lit(0.0)), F.coalesce(_exact(F.when(~full, F.col("weight"))), F.lit(0.0))).first()
        new = (total - held) / free if free > 0 else float("inf")
        if level is not None and new <= level * (1 + 1e-12):
            break
        level = new
        if free <= 0:
            break
    return table.withColumn("target", F.least(most, F.col("weight") * F.lit(level)))


def duals(cells: DataFrame, sources: DataFrame, cap: float, scratch: Scratch) -> DataFrame:
    """Multiplier of each source (rank, dual) by safeguarded Newton steps over the cells (rank, size, n)."""
    limit = float(np.log(cap))
    scale = cells.filter("size > 0").groupBy("rank").agg((_exact(F.col("n") * F.col("size")) / F.sum("n")).alias("scale"), F.min("size").alias("least"))
    state = sources.join(scale, "rank").select(
        "rank", "target", "scale", (F.col("source_size") * cap <= F.col("target") * (1 + 1e-12)).alias("full"),
        F.lit(0.0).alias("dual"), F.lit(-1.0).alias("low"), (F.col("scale") / F.col("least") * limit).alias("high"), F.lit(False).alias("bounded"), F.lit(False).alias("done"),
    )
    state = scratch.store(state.withColumn("dual", F.when(F.col("full"), F.col("high")).otherwise(F.col("dual"))).withColumn("done", F.col("full")), "duals")
    for _ in range(STEPS):
        z = F.col("size") / F.col("scale")
        tilt = F.least(F.exp(F.least(F.col("dual") * z, F.lit(limit))), F.lit(float(cap)))
        words = F.col("n") * F.col("size") * tilt
        sums = cells.filter("size > 0").join(state.filter("not done"), "rank").groupBy("rank").agg(
            _exact(words).alias("f"), F.coalesce(_exact(F.when(F.col("dual") * z < limit, words * z)), F.lit(0.0)).alias("slope")
        )
        miss = F.col("f") - F.col("target")
        met = F.coalesce(F.abs(miss) <= F.col("target") * CLOSE, F.lit(False))
        low = F.when(miss < 0, F.col("dual")).otherwise(F.col("low"))
        high = F.when(miss > 0, F.col("dual")).otherwise(F.col("high"))
        # until a multiplier with too few words is known the lower end doubles outwards
        bounded = F.col("bounded") | (miss < 0)
        newton = F.col("dual") - miss / F.col("slope")
        low2 = F.when(bounded, low).otherwise(F.least(F.col("low"), F.col("dual")) * 2)
        middle = (low2 + high) / 2
        step = F.when((F.col("slope") > 0) & (newton > low2) & (newton < high), newton).otherwise(middle)
        alive = F.col("f").isNotNull()
        state2 = state.join(sums, "rank", "left").select(
            "rank", "target", "scale", "full",
            F.when(alive & ~met, step).otherwise(F.col("dual")).alias("dual"),
            F.when(alive, low2).otherwise(F.col("low")).alias("low"),
            F.when(alive, high).otherwise(F.col("high")).alias("high"),
            F.when(alive, bounded).otherwise(F.col("bounded")).alias("bounded"),
            (F.col("done") | met).alias("done"),
        )
        state2 = scratch.store(state2, "duals")
        scratch.drop(state)
        state = state2
        if state.filter("not done").isEmpty():
            break
    return state.select("rank", "scale", "dual")


def cell_copies(cells: DataFrame, solved: DataFrame, sources: DataFrame, cap: float) -> DataFrame:
    """(rank, size, n, copies): whole copies per cell, largest sizes first, the rest carried on within a source.

    One source's cells stream through one task in order of size; there are at most as many as
    different document sizes, however many documents the source has.
    """
    limit = float(np.log(cap))
    tilt = F.least(F.exp(F.least(F.col("dual") * F.col("size") / F.col("scale"), F.lit(limit))), F.lit(float(cap)))
    rated = cells.filter("size > 0").join(solved, "rank").join(sources.select("rank", "target"), "rank").withColumn("expected", F.col("n") * F.col("size") * tilt)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in groups(batches, "rank"):
            size, n, expected = (block.column(c).to_numpy() for c in ("size", "n", "expected"))
            # what the solver's tolerance leaves is spread over the source first
            expected = expected * (block.column("target")[0].as_py() / max(expected.sum(), 1e-9))
            copies, rest = np.zeros(len(size), np.int64), 0.0
            for k in range(len(size)):
                want = (expected[k] + rest) / size[k]
                copies[k] = min(max(int(np.floor(want + 0.5)), 0), int(cap * n[k]))
                rest += expected[k] - copies[k] * size[k]
            yield pa.RecordBatch.from_arrays([block.column("rank").combine_chunks(), pa.array(size), pa.array(n), pa.array(copies)], names=["rank", "size", "n", "copies"])

    return rated.repartition("rank").sortWithinPartitions("rank", F.col("size").desc()).select("rank", "size", "n", "expected", "target").mapInArrow(run, "rank long, size long, n long, copies long")


def last_taken(rows: DataFrame, cells: DataFrame) -> DataFrame:
    """(rank, size, last): hash of the last of the `extra` documents with the least hashes of a cell.

    Counts per hash range find the range, then only that range of a cell is sorted, so a cell
    with a third of all documents is no sorted group of its own.
    """
    at = F.shiftright(F.col("h"), 64 - RANGES.bit_length() + 1).cast("int")
    some = rows.select("rank", "size", "h", at.alias("range")).join(cells.filter("extra > 0").select("rank", "size", "extra"), ["rank", "size"])
    counts = some.groupBy("rank", "size", "extra", "range").agg(F.count("*").alias("n"))
    upto = F.expr("sum(n) over (partition by rank, size order by range)")
    chosen = counts.withColumn("upto", upto).filter("upto >= extra and upto - n < extra").select("rank", "size", "range", (F.col("extra") - F.col("upto") + F.col("n")).alias("k"))
    inside = some.join(chosen, ["rank", "size", "range"])
    return inside.withColumn("place", F.expr("row_number() over (partition by rank, size order by h)")).filter("place = k").select("rank", "size", F.col("h").alias("last"))


def mix(docs: DataFrame, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, cap: float = 2.0,
        id: str = "doc_id", source: str = "source", text: str = "text", size: str | None = None) -> DataFrame:
    """Append `size`, `source_size`, `target`, `copies` and `taken` (= copies * size) to every row of `docs`.

    `size` names a column with sizes counted before; otherwise words of the whole text are counted.
    """
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession)
    new = ("size", "source_size", "target", "copies", "taken")
    counted = col(size).cast("long") if size else word_count(text)
    hashed, key = fresh(docs, "h_"), fresh(docs, "source_")
    held = [c for c in docs.columns if c.lower() not in new]
    rows = docs.select(*[col(c) for c in held], counted.alias("size"), F.xxhash64(col(id)).alias(hashed), col(source).alias(key))

    narrow = scratch.store(rows.groupBy(F.col(key).alias("source"), "size").agg(F.count("*").alias("n")), "cells")
    per_source = narrow.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))
    planned = scratch.store(targets(ranked(per_source, "source", scratch), weights, share, cap, scratch), "targets")
    cells = scratch.store(narrow.join(planned.select(F.col("source").alias("s"), "rank"), F.col("source").eqNullSafe(F.col("s"))).drop("s"), "ranked_cells")
    solved = duals(cells.select("rank", "size", "n"), planned, cap, scratch)
    copies = cell_copies(cells.select("rank", "size", "n"), solved, planned, cap)
    copies = copies.select("rank", "size", F.floor(F.col("copies") / F.col("n")).alias("base"), (F.col("copies") % F.col("n")).alias("extra"))
    copies = scratch.store(copies.join(cells.select("source", "rank", "size"), ["rank", "size"]), "copies")
    keyed = rows.select(F.col(key).alias("source"), "size", F.col(hashed).alias("h")).join(copies.filter("extra > 0").select(F.col("source").alias("s"), F.col("size").alias("z"), "rank"), F.col("source").eqNullSafe(F.col("s")) & (F.col("size") == F.col("z"))).select("rank", "size", "h")
    last = last_taken(keyed, copies)
    plan = cells.select("source", "rank", "size").join(copies.select("rank", "size", "base", "extra"), ["rank", "size"], "left").join(last, ["rank", "size"], "left")
    plan = plan.join(planned.select("rank", "source_size", "target"), "rank")
    plan = scratch.store(plan.select(F.col("source").alias("s_"), F.col("size").alias("z_"), "base", "last", "source_size", "target"), "plan")
    out = rows.join(plan, F.col(key).eqNullSafe(F.col("s_")) & (F.col("size") == F.col("z_")))
    number = F.coalesce(F.col("base"), F.lit(0)) + F.when(F.col("last").isNotNull() & (F.col(hashed) <= F.col("last")), 1).otherwise(0)
    return out.select(*[col(c) for c in held], "size", "source_size", "target", number.cast("long").alias("copies"), (number * F.col("size")).cast("long").alias("taken"))
