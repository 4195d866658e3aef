"""Checks measured by the write that publishes a table, so a suite costs no scan of its own."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from .quality import KEYED, Check, key_counts, plain_value, verdicts

# A sketch with 2^16 entries counts up to 65,536 different keys exactly and takes half a megabyte in a task.
SKETCH_BITS = 16
# Beyond that its relative error is 1 / sqrt(2^16); a threshold nearer than this many errors is settled exactly.
ERRORS = 6.0


@dataclass(frozen=True)
class CheckedWrite:
    """The stored table and what was measured while it was written.

    `results` has the columns of `run_checks` and `measured_by`: `write` for measures that the write
    carried, `sketch` for keys that its sketch settles, `key column` where that column was read again.
    """

    table: DataFrame
    results: DataFrame

    @property
    def failed(self) -> bool:
        return self.results.filter("status = 'fail'").limit(1).count() > 0


def _settled(check: Check, rows: int, distinct: float) -> float | None:
    """The measure of a keyed check by the sketch, or None where only the keys themselves can tell."""
    exact = distinct < 2**SKETCH_BITS
    if check.kind == "duplicate_count":
        # all keys differ; otherwise the number of repeated ones is not in the sketch
        return 0.0 if exact and rows == round(distinct) else None
    if exact:
        return float(round(distinct))
    margin = ERRORS * distinct / 2 ** (SKETCH_BITS / 2)
    limits = [x for t in (check.warn, check.fail) if t for x in (t[1] if isinstance(t[1], (tuple, list)) else (t[1],))]
    if any(op in ("=", "!=") for op, _ in filter(None, (check.warn, check.fail))):
        return None
    return float(round(distinct)) if all(abs(distinct - x) > margin for x in limits) else None


def write_checked(
    df: DataFrame,
    path: str,
    checks: Sequence[Check],
    as_of: Column | None = None,
    digits: int = 4,
    partition_by: Sequence[str] = (),
    overwrite: bool = False,
) -> CheckedWrite:
    """Write `df` as Parquet and run `checks` on what is written, in one pass over `df`.

    Plain measures are metrics observed by the tasks that write, each counted once however often a task is
    repeated, since nothing is shuffled after them. Keys pass through a sketch: it proves small key columns
    free of duplicates and settles distinct counts that are far from their thresholds. What it cannot
    settle is counted on that one column of the stored table; `df` itself never runs twice.

    Null keys are no keys, as in `run_checks`. A table without rows is checked like any other. With more than
    65,536 keys a distinct count far from its thresholds is the sketch's estimate, not the exact number.
    """
    keys = sorted({c.column for c in checks if c.kind in KEYED})
    metrics = [plain_value(c, as_of).cast("double").alias(f"v{i}") for i, c in enumerate(checks) if c.kind not in KEYED]
    for j, key in enumerate(keys):
        k = F.col(f"`{key}`")
        sketch = F.theta_sketch_agg(F.when(k.isNotNull(), F.xxhash64(k)), SKETCH_BITS)
        metrics += [F.count(k).alias(f"n{j}"), F.theta_sketch_estimate(sketch).cast("double").alias(f"d{j}")]
    seen = Observation()
    writer = df.observe(seen, F.count(F.lit(1)).alias("rows"), *metrics).write.mode("overwrite" if overwrite else "errorifexists")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    spark = df.sparkSession
    table = spark.read.schema(df.schema).parquet(path)
    found = seen.get
    if "rows" not in found:  # the plan of a table known to be empty carries no metrics
        found = table.agg(F.count(F.lit(1)).alias("rows"), *metrics).first().asDict()

    settled = {}
    for i, c in enumerate(checks):
        if c.kind not in KEYED:
            settled[i] = found[f"v{i}"], "write"
            continue
        j = keys.index(c.column)
        value = _settled(c, found[f"n{j}"], found[f"d{j}"] or 0.0)
        settled[i] = value, "key column" if value is None else "sketch"
    again = {c.column for i, c in enumerate(checks) if settled[i][1] == "key column"}
    exact = {k: key_counts(table, k).first().asDict() for k in sorted(again)}
    values = [float(exact[c.column][c.kind]) if settled[i][1] == "key column" else settled[i][0] for i, c in enumerate(checks)]

    # one row of measures, as many columns as the suite has checks
    row = spark.createDataFrame([tuple(values)], ", ".join(f"v{i} double" for i in range(len(checks))))
    results = verdicts(row, checks, [F.col(f"v{i}") for i in range(len(checks))], digits, [F.lit(settled[i][1]).alias("measured_by") for i in range(len(checks))])
    return CheckedWrite(table, results)
