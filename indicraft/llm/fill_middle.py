"""Fill-in-middle transformation over a boundary set held in containers by the high half of an offset.

A text's token ends (and 0) are its possible cuts: rising code point offsets, at least one more than it has
tokens. Offsets with equal bits above the lowest 16 share a container, which holds the low halves in the
smallest of three forms: a sorted array, a bitmap, or runs. Cumulative cardinalities say which container holds
the k-th cut, and a select inside that container gives its offset, so both cuts of a document come from two
searches and two local selects.

Defined cases: null and empty texts have no tokens, one possible cut (0) and stay plain; texts that hold a
control string stay plain; white space alone is one token; a null id is hashed as an empty string; repeated
rows come out alike; texts of any length are one step of their own; an empty table gives no rows. A column of the
input that is named like a result is dropped in favour of the result.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import col, fresh, map_texts, text_or_empty

#: Control strings of the three parts.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
CHUNK_BITS = 16
CHUNK = 1 << CHUNK_BITS
POPCOUNT = np.array([bin(b).count("1") for b in range(256)], dtype=np.uint8)
RESULT = T.StructType([
    T.StructField("n", T.LongType()), T.StructField("form", T.StringType()), T.StructField("prefix_chars", T.LongType()),
    T.StructField("middle_chars", T.LongType()), T.StructField("output", T.StringType()),
])


@dataclass
class Array:
    """Low halves as sorted 16-bit numbers."""

    values: np.ndarray

    def select(self, k: int) -> int:
        return int(self.values[k])


@dataclass
class Bitmap:
    """One bit per low half, with the ones before each byte."""

    bits: np.ndarray
    before: np.ndarray

    def select(self, k: int) -> int:
        byte = int(np.searchsorted(self.before, k, side="right")) - 1
        ones = np.flatnonzero(np.unpackbits(self.bits[byte : byte + 1], bitorder="little"))
        return byte * 8 + int(ones[k - int(self.before[byte])])


@dataclass
class Runs:
    """Stretches of neighbouring low halves: their starts and the values before each."""

    starts: np.ndarray
    before: np.ndarray

    def select(self, k: int) -> int:
        run = int(np.searchsorted(self.before, k, side="right")) - 1
        return int(self.starts[run]) + k - int(self.before[run])


def container(low: np.ndarray) -> Array | Bitmap | Runs:
    """The smallest form of the sorted low halves of one chunk, by its bytes."""
    heads = np.concatenate([[0], np.flatnonzero(np.diff(low) != 1) + 1])
    sizes = {"array": 2 * len(low), "bitmap": CHUNK // 8, "runs": 4 * len(heads)}
    best = min(sizes, key=sizes.__getitem__)
    if best == "array":
        return Array(low.astype(np.uint16))
    if best == "runs":
        return Runs(low[heads].astype(np.uint16), heads.astype(np.int32))
    flags = np.zeros(CHUNK, np.uint8)
    flags[low] = 1
    bits = np.packbits(flags, bitorder="little")
    ones = np.cumsum(POPCOUNT[bits], dtype=np.int32)
    return Bitmap(bits, np.concatenate([[0], ones[:-1]]).astype(np.int32))


class BoundarySet:
    """Sorted distinct offsets; `select(k)` is the k-th of them, counted from 0."""

    def __init__(self, offsets: np.ndarray):
        high = offsets >> CHUNK_BITS
        cuts = np.concatenate([[0], np.flatnonzero(np.diff(high)) + 1, [len(high)]])
        self.highs = high[cuts[:-1]]
        self.before = cuts[:-1]
        self.containers = [container(offsets[a:b] & (CHUNK - 1)) for a, b in zip(cuts[:-1], cuts[1:])]
        self.size = len(offsets)

    def select(self, k: int) -> int:
        if not 0 <= k < self.size:
            raise IndexError(k)
        at = int(np.searchsorted(self.before, k, side="right")) - 1
        return (int(self.highs[at]) << CHUNK_BITS) | self.containers[at].select(k - int(self.before[at]))


def boundaries(text: str) -> np.ndarray:
    """0 and the ends of all tokens: a word with the white space before it, and white space at the end of the text."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    if len(points) == 0:
        return np.zeros(1, np.int64)
    space = (points == 32) | ((points >= 9) & (points <= 13))
    ends = np.flatnonzero(~space[:-1] & space[1:]) + 1
    return np.concatenate([[0], ends, [len(points)]]).astype(np.int64)


def draws(seed: int, doc_id: int | None) -> tuple[int, int, int, int]:
    """Four 32-bit numbers of a document."""
    name = "" if doc_id is None else str(doc_id)
    digest = hashlib.sha256(f"{seed}:{name}".encode()).digest()
    return tuple(int.from_bytes(digest[k : k + 4], "big") for k in (0, 4, 8, 12))  # type: ignore[return-value]


def transform(text: str, doc_id: int | None, seed: int, rate: int, spm: int) -> tuple[int, str, int | None, int | None, str]:
    """(tokens, form, code points of prefix and middle, output) of one document."""
    cuts = BoundarySet(boundaries(text))
    n = cuts.size - 1
    h1, h2, h3, h4 = draws(seed, doc_id)
    if not text or PREFIX in text or SUFFIX in text or MIDDLE in text or h3 % 100 >= rate:
        return n, "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    first, second = cuts.select(a), cuts.select(b)
    prefix, middle, suffix = text[:first], text[first:second], text[second:]
    if h4 % 100 < spm:
        return n, "spm", first, second - first, f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}"
    return n, "psm", first, second - first, f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}"


def fill_in_middle(docs: DataFrame, id: str = "doc_id", text: str = "text", seed: int = 42, rate: int = 50, spm: int = 80) -> DataFrame:
    """Append n (tokens), form, prefix_chars, middle_chars and output; `rate` percent of the texts are cut, `spm` percent
    of those with the suffix first. One pass in the scan's tasks, no shuffle."""
    docs = docs.select(*[col(c) for c in docs.columns if c.lower() not in RESULT.fieldNames()])
    source, key = fresh(docs, "text_in"), fresh(docs, "id_in")

    def run(batch: pa.RecordBatch) -> dict:
        names = batch.schema.names
        texts, ids = batch.column(names.index(source)).to_pylist(), batch.column(names.index(key)).to_pylist()
        rows = [transform(t, i, seed, rate, spm) for t, i in zip(texts, ids)]
        return {f.name: pa.array(list(v), type=kind) for f, v, kind in zip(RESULT, zip(*rows), (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()))}

    slim = docs.withColumns({source: text_or_empty(text), key: col(id).cast("long")})
    return map_texts(slim, run, RESULT, source).drop(source, key)


def restored(output: Column, form: Column) -> Column:
    """The text again, from output and form. No control string can overlap a cut, so the first of each kind is the right one."""

    def parts(first: str, second: str) -> tuple[Column, Column, Column]:
        at = F.instr(output, second)
        middle = F.instr(output, MIDDLE)
        mark = len(first)
        head = F.substr(output, F.lit(mark + 1), at - mark - 1)
        tail = F.substr(output, at + mark, middle - at - mark)
        return head, tail, F.substr(output, middle + mark)

    p_prefix, p_suffix, p_middle = parts(PREFIX, SUFFIX)
    s_suffix, s_prefix, s_middle = parts(SUFFIX, PREFIX)
    psm, spm = F.concat(p_prefix, p_middle, p_suffix), F.concat(s_prefix, s_middle, s_suffix)
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)
