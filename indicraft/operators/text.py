"""Documents to overlapping chunks."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import text_hash

# Break points tried in order, blanks that are trimmed, and the default sizes in characters.
SEPARATORS = ("\n\n", "\n", ". ", " ", "")
WHITESPACE = " \t\n\r\f\v"
CHUNK_CHARS = 2048
OVERLAP_CHARS = 200
#: Characters of chunks that a task hands on at once.
BATCH_CHARS = 2_000_000


def usable_documents(df: DataFrame, text: str, minimum: int = 50) -> DataFrame:
    """Documents with at least `minimum` trimmed characters, with a short content hash."""
    return df.filter(F.length(F.trim(F.col(text), F.lit(WHITESPACE))) >= minimum).withColumn("doc_hash", text_hash(text))


def chunk_windows(df: DataFrame, key: str, text: str, size: int = CHUNK_CHARS, overlap: int = OVERLAP_CHARS, min_len: int = 20) -> DataFrame:
    """Fixed windows with overlap, entirely inside the JVM."""
    step = size - overlap
    n = F.length(F.col(text))
    last = F.greatest(F.ceil((n - overlap) / F.lit(float(step))).cast("int"), F.lit(1)) - 1
    starts = F.transform(F.sequence(F.lit(0), last), lambda i: i * step + 1)
    out = df.filter(n > 0).select("*", F.posexplode(starts).alias("chunk_index", "_start"))
    chunk = F.trim(F.substring(F.col(text), F.col("_start"), F.lit(size)), F.lit(WHITESPACE))
    return out.withColumn("chunk_text", chunk).filter(F.length("chunk_text") >= min_len).select(key, "chunk_index", "chunk_text")


def _pieces(text: str, sep: str) -> list[str]:
    """Parts of the text, each keeping the separator it starts with."""
    if sep == "":
        return list(text)
    head, *rest = text.split(sep)
    return [p for p in [head, *(sep + r for r in rest)] if p]


def _pack(pieces: Sequence[str], size: int, overlap: int) -> Iterator[str]:
    """Join neighbouring pieces up to `size`, repeating up to `overlap` characters of the tail."""
    window: deque[str] = deque()
    width = 0
    for piece in pieces:
        if window and width + len(piece) > size:
            yield "".join(window)
            while window and (width > overlap or width + len(piece) > size):
                width -= len(window.popleft())
        window.append(piece)
        width += len(piece)
    if window:
        yield "".join(window)


def _split(text: str, size: int, overlap: int, seps: Sequence[str]) -> Iterator[str]:
    at = next((i for i, s in enumerate(seps) if s == "" or s in text), len(seps) - 1)
    finer = seps[at + 1 :]
    fitting: list[str] = []
    for piece in _pieces(text, seps[at]):
        if len(piece) < size:
            fitting.append(piece)
            continue
        yield from _pack(fitting, size, overlap)
        fitting = []
        if finer:
            yield from _split(piece, size, overlap, finer)
        else:
            yield piece
    yield from _pack(fitting, size, overlap)


def split_text(text: str, size: int = CHUNK_CHARS, overlap: int = OVERLAP_CHARS, seps: Sequence[str] = SEPARATORS) -> list[str]:
    """Chunks that end at the coarsest break point that fits, whitespace trimmed, blanks left out."""
    return [c for c in (raw.strip() for raw in _split(text, size, overlap, seps)) if c]


def chunk_text(
    df: DataFrame,
    key: str,
    text: str,
    source: str | None = None,
    size: int = CHUNK_CHARS,
    overlap: int = OVERLAP_CHARS,
    min_len: int = 20,
) -> DataFrame:
    """Boundary-aware chunks: (key, source, chunk_index, chunk_text, doc_hash).

    A narrow, shuffle-free map over Arrow batches; every text is read whole, and a task holds one text
    and about `BATCH_CHARS` characters of chunks beside its input batch.
    """
    digest = F.substring(F.md5(F.col(text).cast("binary")), 1, 12)
    inputs = df.select(F.col(key).alias("k"), F.col(source or key).cast("string").alias("s"), digest.alias("h"), F.col(text).cast("string").alias("t"))
    schema = T.StructType([T.StructField("k", df.schema[key].dataType), T.StructField("s", T.StringType()), T.StructField("i", T.IntegerType()), T.StructField("c", T.StringType()), T.StructField("h", T.StringType())])
    out = inputs.mapInArrow(lambda batches: chunk_batches(batches, size, overlap, min_len), schema)
    return out.toDF(key, "source", "chunk_index", "chunk_text", "doc_hash")


def chunk_batches(batches: Iterator[pa.RecordBatch], size: int, overlap: int, min_len: int, most_chars: int = BATCH_CHARS) -> Iterator[pa.RecordBatch]:
    """(k, s, h, t) to (k, s, i, c, h), a batch at the latest when its chunks hold `most_chars` characters or one text more."""
    for batch in batches:
        rows: list[int] = []
        places: list[int] = []
        chunks: list[str] = []
        held = 0

        def made(batch=batch) -> pa.RecordBatch:
            at = pa.array(rows, pa.int64())
            k, s, h = (batch.column(j).take(at) for j in range(3))
            return pa.RecordBatch.from_arrays([k, s, pa.array(places, pa.int32()), pa.array(chunks, pa.string()), h], names=["k", "s", "i", "c", "h"])

        for row, value in enumerate(batch.column(3)):
            if not value.is_valid:
                continue
            for i, chunk in enumerate(split_text(value.as_py(), size, overlap)):
                if len(chunk) >= min_len:
                    rows.append(row)
                    places.append(i)
                    chunks.append(chunk)
                    held += len(chunk)
            if held >= most_chars:
                yield made()
                rows, places, chunks, held = [], [], [], 0
        if rows:
            yield made()
