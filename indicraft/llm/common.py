"""Helpers shared by the text operators: clash-free columns, Arrow batches, groups in a sorted stream."""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from indicraft.session import scratch_path

#: Bytes of text that one step inside a Python worker handles; a longer single text is one step of its own.
STEP_BYTES = 2_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


class Scratch:
    """Parquet tables in the shared folder (`spark.checkpoint.dir`), removable once nothing reads them."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, {}

    def store(self, df: DataFrame, label: str) -> DataFrame:
        path = scratch_path(self.spark, label)
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(out)] = (path, out)
        return out

    def drop(self, *frames: DataFrame) -> None:
        for frame in frames:
            path, _ = self.paths.pop(id(frame), (None, None))
            if path:
                where = self.spark._jvm.org.apache.hadoop.fs.Path(path)
                where.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(where, True)


def fresh(df: DataFrame, name: str) -> str:
    """`name`, prefixed until no column of `df` has it (Spark compares names without case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def col(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def quoted(df: DataFrame) -> list[Column]:
    return [col(c) for c in df.columns]


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(col(name).cast("string"), F.lit(""))


def pack(df: DataFrame, *names: str) -> tuple[DataFrame, str]:
    """`names` beside the whole row as one struct, so that no other column can clash with an operator's own."""
    row = fresh(df, "row_")
    return df.select(*[col(n) for n in names], F.struct(*quoted(df)).alias(row)), row


def pack_rest(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """Column `name` beside a struct of all others, so that it crosses to Python once."""
    row = fresh(df, "row_")
    return df.select(col(name), F.struct(*[col(c) for c in df.columns if c != name]).alias(row)), row


def unpack(df: DataFrame, row: str, names: list[str], **new: Column) -> DataFrame:
    """The columns of a packed row again, those in `new` replaced."""
    return df.select(*[new[n].alias(n) if n in new else F.col(row).getField(n).alias(n) for n in names])


def steps(texts: pa.Array, most: int = STEP_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of a batch whose texts hold about `most` bytes each."""
    if len(texts) == 0:
        return
    sizes = np.array([0 if x is None else x for x in pa.compute.binary_length(texts).to_pylist()], dtype=np.int64)
    ends = np.cumsum(sizes)
    start = 0
    while start < len(sizes):
        base = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, base + most, side="right")))
        yield start, stop
        start = stop


def map_texts(df: DataFrame, fn: Callable[[pa.RecordBatch], dict[str, pa.Array]], add: T.StructType, text: str) -> DataFrame:
    """Append the columns that `fn` computes for slices of Arrow batches, whole texts, in the scan's own tasks."""
    schema = T.StructType([*df.schema.fields, *add.fields])
    types = [pa_type(f.dataType) for f in add.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, stop in steps(batch.column(batch.schema.names.index(text))):
                part = batch.slice(start, stop - start)
                got = fn(part)
                arrays = [v if isinstance(v := got[f.name], pa.Array) else pa.array(v, type=t) for f, t in zip(add.fields, types)]
                yield pa.RecordBatch.from_arrays([*part.columns, *arrays], names=[*part.schema.names, *[f.name for f in add.fields]])

    return df.mapInArrow(run, schema)


def pa_type(kind: T.DataType) -> pa.DataType:
    simple = {"bigint": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string(), "binary": pa.binary(), "boolean": pa.bool_()}
    if isinstance(kind, T.ArrayType):
        return pa.list_(pa_type(kind.elementType))
    if isinstance(kind, T.StructType):
        return pa.struct([(f.name, pa_type(f.dataType)) for f in kind.fields])
    return simple[kind.simpleString()]


def groups(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Runs of equal `key` (a long) in a stream that is sorted by it; a run may cross batches."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in itertools.chain(batches):
        if batch.num_rows == 0:
            continue
        keys = batch.column(batch.schema.names.index(key)).to_numpy(zero_copy_only=False)
        cuts = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), len(keys)]
        for a, b in itertools.pairwise(cuts):
            if held and keys[a] != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
            last = keys[a]
    if held:
        yield pa.Table.from_batches(held)


def bundles(batches: Iterator[pa.RecordBatch], key: str, small: int = 16, rows: int = 4_096) -> Iterator[pa.Table]:
    """Whole runs of equal `key` in a sorted stream: longer ones one by one, neighbouring short ones together.

    Only the last run of a batch waits for the next batch, so memory follows the longest run.
    """
    held = None
    for batch in batches:
        if batch.num_rows == 0:
            continue
        table = pa.Table.from_batches([batch])
        table = table if held is None else pa.concat_tables([held, table])
        keys = table.column(key).to_numpy()
        cuts = np.concatenate([[0], np.flatnonzero(keys[1:] != keys[:-1]) + 1])
        held = table.slice(int(cuts[-1]))
        yield from _runs(table, cuts, small, rows)
    if held is not None:
        yield held


def _runs(table: pa.Table, cuts: np.ndarray, small: int, rows: int) -> Iterator[pa.Table]:
    sizes = np.diff(cuts)
    at = 0
    while at < len(sizes):
        stop = at + 1
        if sizes[at] <= small:
            long = np.flatnonzero(sizes[at:] > small)
            end = at + int(long[0]) if len(long) else len(sizes)
            stop = min(end, max(at + 1, int(np.searchsorted(cuts, cuts[at] + rows, side="right")) - 1))
        yield table.slice(int(cuts[at]), int(cuts[stop] - cuts[at]))
        at = stop


def matrix(column: pa.ChunkedArray | pa.Array, dtype) -> np.ndarray:
    """Rows of equal-length binary values as a 2-d array."""
    values = column.to_pylist()
    return np.frombuffer(b"".join(values), dtype=dtype).reshape(len(values), -1)
