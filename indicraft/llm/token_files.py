"""Token ids in binary files with Elias-Fano document boundaries.

Texts are placed by range of (id, hash of the text), so files in the order of their names hold documents in ascending order
of id. A task encodes its range and cuts it into shards; a shard is one file:

    head     magic, bytes per id, documents, null ids, least id, ids in all
    doc ids  Elias-Fano of (id - least id), rising
    ends     Elias-Fano of the end of each document in the id array
    ids      all ids end to end, 2 or 4 bytes each, little-endian

Elias-Fano keeps the low bits of rising numbers packed and the high bits in unary in a bitmap, about 2 + log2(universe / n)
bits each; the k-th number is a select of the k-th one in the bitmap, helped by the place of every 256th one as a 32-bit
number. No table of 64-bit offsets exists, on disk or in memory. A manifest of one row a shard (its documents and ids
stand in the folder's name) turns offsets in a shard into offsets in the whole corpus.

Files are written by Spark's text sink and read by its binary file source, so any shared file system
serves, a task's file appears only when it is committed, and lost executors repeat their ranges. The sink ends a file with one newline.

The tokenizer sees units instead of texts: a text may be cut before every single space between two other characters, and between a
letter and a punctuation mark, since no piece of a byte-level pattern runs across these, and equal units of a worker are encoded once.

Defined cases: null and empty texts have the end id only; null ids come first and stay null; rows of equal id are ordered by the
hash of their text, so equal rows may stand for one another; a text longer than a shard has a shard of its own; an empty table gives no shards; other columns stay behind.
"""

from __future__ import annotations

import functools
import math
import os
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import col, steps, text_or_empty

#: Ids in a shard: 8 MB of two-byte ids.
SHARD_IDS = 4_000_000
#: Bytes of text that one task encodes.
RANGE_BYTES = 24_000_000
#: Bytes of units and their ids that a worker remembers.
REMEMBERED_BYTES = 40_000_000
MAGIC = b"EFT1"
HEAD = "<4sBxxxIIqQ"
EF_HEAD = "<IQBxxxIII"
SAMPLE = 256
LETTER, MARK = (np.isin(np.arange(256), np.frombuffer(chars, np.uint8)) for chars in (b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ", b".,;:!?"))
POPCOUNT = np.array([bin(b).count("1") for b in range(256)], dtype=np.uint8)
#: Place of the k-th one in each byte.
IN_BYTE = np.array([([i for i in range(8) if b >> i & 1] + [0] * 8)[:8] for b in range(256)], dtype=np.uint8)


class EliasFano:
    """A rising sequence of non-negative numbers; `select(k)` is the k-th."""

    def __init__(self, n: int, low_bits: int, low: np.ndarray, high: np.ndarray, samples: np.ndarray):
        self.n, self.low_bits, self.low, self.high, self.samples = n, low_bits, low, high, samples

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        values = values.astype(np.uint64)
        n = len(values)
        if n == 0:
            return cls(0, 0, np.zeros(0, np.uint8), np.zeros(0, np.uint8), np.zeros(0, np.uint32))
        width = max(0, (int(values[-1]) // n).bit_length() - 1)
        bits = (values[:, None] >> np.arange(width, dtype=np.uint64)) & np.uint64(1)
        places = (values >> np.uint64(width)).astype(np.int64) + np.arange(n)
        flags = np.zeros(int(places[-1]) + 1, np.uint8)
        flags[places] = 1
        return cls(n, width, np.packbits(bits.astype(np.uint8).ravel(), bitorder="little"), np.packbits(flags, bitorder="little"), places[::SAMPLE].astype(np.uint32))

    def _low(self, k: np.ndarray) -> np.ndarray:
        """Low bits of the k-th values, read across byte borders."""
        out = np.zeros(len(k), np.uint64)
        at = k.astype(np.int64) * self.low_bits
        for i in range(self.low_bits):
            where = at + i
            out |= ((self.low[where >> 3] >> (where & 7).astype(np.uint8)) & np.uint8(1)).astype(np.uint64) << np.uint64(i)
        return out

    def select(self, k: int) -> int:
        """From the sampled one before the k-th, byte by byte."""
        if not 0 <= k < self.n:
            raise IndexError(k)
        place = int(self.samples[k // SAMPLE])
        left = k % SAMPLE
        byte = place >> 3
        rest = int(self.high[byte]) >> (place & 7) << (place & 7)
        while (ones := rest.bit_count()) <= left:
            left -= ones
            byte += 1
            rest = int(self.high[byte])
        place = byte * 8 + int(IN_BYTE[rest, left])
        return (place - k << self.low_bits) | int(self._low(np.array([k]))[0])

    def select_many(self, k: np.ndarray) -> np.ndarray:
        """`select` of many ranks, by the ones before each byte."""
        if len(k) == 0:
            return np.zeros(0, np.uint64)
        upto = np.cumsum(POPCOUNT[self.high], dtype=np.int64)
        byte = np.searchsorted(upto, k, side="right")
        before = np.where(byte > 0, upto[byte - 1], 0)
        place = byte * 8 + IN_BYTE[self.high[byte], k - before]
        return ((place - k).astype(np.uint64) << np.uint64(self.low_bits)) | self._low(k)

    def to_bytes(self) -> bytes:
        return struct.pack(EF_HEAD, self.n, 0, self.low_bits, len(self.low), len(self.high), len(self.samples)) + self.low.tobytes() + self.high.tobytes() + self.samples.tobytes()

    @classmethod
    def parse(cls, data: memoryview, at: int) -> tuple[EliasFano, int]:
        n, _, width, low, high, samples = struct.unpack_from(EF_HEAD, data, at)
        at += struct.calcsize(EF_HEAD)
        parts = []
        for size, kind in ((low, np.uint8), (high, np.uint8), (samples, np.uint32)):
            parts.append(np.frombuffer(data, kind, size, at))
            at += parts[-1].nbytes
        return cls(n, width, *parts), at


def write_shard(doc_ids: list[int | None], sizes: list[int], ids: list[bytes], id_bytes: int) -> bytes:
    """One shard; `doc_ids` rise, nulls first; `ids` are the ids of each document end to end."""
    known = np.array([d for d in doc_ids if d is not None], dtype=np.int64)
    least = int(known[0]) if len(known) else 0
    gaps = known.astype(np.uint64) - np.array([least], dtype=np.int64).astype(np.uint64)
    ends = np.cumsum(sizes, dtype=np.int64)
    head = struct.pack(HEAD, MAGIC, id_bytes, len(doc_ids), len(doc_ids) - len(known), least, int(ends[-1]) if len(ends) else 0)
    return b"".join([head, EliasFano.of(gaps).to_bytes(), EliasFano.of(ends).to_bytes(), *ids])


class Shard:
    """A shard file opened for random access to its documents."""

    def __init__(self, data: bytes | memoryview):
        view = memoryview(data)
        magic, self.id_bytes, self.n_docs, self.n_null, self.least, self.n_ids = struct.unpack_from(HEAD, view, 0)
        if magic != MAGIC:
            raise ValueError("not a token shard")
        self.gaps, at = EliasFano.parse(view, struct.calcsize(HEAD))
        self.ends, at = EliasFano.parse(view, at)
        self.ids = np.frombuffer(view, np.uint16 if self.id_bytes == 2 else np.uint32, self.n_ids, at)

    def doc_id(self, k: int) -> int | None:
        return None if k < self.n_null else self.least + self.gaps.select(k - self.n_null)

    def span(self, k: int) -> tuple[int, int]:
        return (self.ends.select(k - 1) if k else 0), self.ends.select(k)

    def document(self, k: int) -> np.ndarray:
        start, end = self.span(k)
        return self.ids[start:end]

    def doc_ids(self) -> list[int | None]:
        gaps = self.gaps.select_many(np.arange(self.n_docs - self.n_null))
        return [None] * self.n_null + (gaps + np.array([self.least], dtype=np.int64).astype(np.uint64)).astype(np.int64).tolist()

    def all_ends(self) -> np.ndarray:
        return self.ends.select_many(np.arange(self.n_docs)).astype(np.int64)


def unit_starts(data: np.ndarray, text_starts: np.ndarray) -> np.ndarray:
    """Byte places where units begin: at each text's start, at single spaces between two characters that are no white space,
    and between an ASCII letter and a punctuation mark.

    White space beyond ASCII is told by its UTF-8 bytes, and where the next character could be some, the text stays whole.
    """
    begins = np.zeros(len(data), bool)
    begins[text_starts] = True
    if len(data) > 2:
        inner = np.flatnonzero(data[1:-1] == 32) + 1
        last, nxt = data[inner - 1], data[inner + 1]
        fits = (last > 32) & (nxt > 32)
        for lead in (0xC2, 0xE1, 0xE2, 0xE3):
            fits &= nxt != lead
        wide = np.flatnonzero(last >= 0x80)
        at = inner[wide]
        before2, before3 = data[np.maximum(at - 2, 0)], data[np.maximum(at - 3, 0)]
        fits[wide] &= ~((np.isin(data[at - 1], (0x85, 0xA0)) & (before2 == 0xC2)) | (np.isin(before2, (0x80, 0x81, 0x9A)) & np.isin(before3, (0xE1, 0xE2, 0xE3))))
        begins[inner[fits]] = True
        marks = np.flatnonzero(MARK[data[1:]]) + 1
        begins[marks[LETTER[data[marks - 1]]]] = True
    return np.flatnonzero(begins)


class UnitCoder:
    """Ids of texts by the tokenizer library, equal units encoded once.

    Units that begin with a space and a character and end with a character may stand side by side in one string, so
    the library is called once for many; the lengths of their tokens tell them apart again. Known units live in
    two generations: those that were met since the last change of generations stay.
    """

    def __init__(self, path: str, remembered: int = REMEMBERED_BYTES):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        size = self.tokenizer.get_vocab_size()
        self.kind = np.uint16 if size <= 1 << 16 else np.uint32
        # a byte-level token has one character per byte
        self.lengths = np.zeros(size, np.int64)
        for token, i in self.tokenizer.get_vocab().items():
            self.lengths[i] = len(token)
        self.remembered = remembered
        self.young: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}
        self.held = 0

    def _ids(self, strings: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, dtype=self.kind) for e in self.tokenizer.encode_batch_fast(strings, add_special_tokens=False)]

    def _learn(self, units: list[bytes]) -> None:
        joined, alone = [], []
        for u in units:
            text = u.decode()
            fits = len(text) > 1 and text[0] == " " and not text[1].isspace() and not text[-1].isspace()
            (joined if fits else alone).append(u)
        for start in range(0, len(joined), 16_384):
            some = joined[start : start + 16_384]
            ids = self._ids([b"".join(some).decode()])[0]
            ends = np.cumsum(self.lengths[ids])
            want = np.cumsum([len(u) for u in some])
            cuts = np.searchsorted(ends, want)
            if len(ids) == 0 or cuts[-1] != len(ends) - 1 or (ends[cuts] != want).any():
                alone += some  # not a byte-level vocabulary: one by one
                continue
            blob, width = ids.tobytes(), ids.itemsize
            at = 0
            for u, cut in zip(some, ((cuts + 1) * width).tolist()):
                self.young[u] = blob[at:cut]
                at = cut
        for start in range(0, len(alone), 4_096):
            some = alone[start : start + 4_096]
            for u, ids in zip(some, self._ids([u.decode() for u in some])):
                self.young[u] = ids.tobytes()
        self.held += sum(3 * len(u) + 150 for u in units)

    def encode(self, texts: pa.Array) -> list[bytes]:
        """The ids of each text, end to end."""
        if self.held > self.remembered / 2:
            self.old, self.young, self.held = self.young, {}, 0
        if len(texts) == 0:
            return []
        # the texts of a slice of an Arrow array lie end to end in its buffer
        texts = texts.cast(pa.large_string())
        bounds = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, texts.offset * 8)
        sizes = np.diff(bounds)
        full = np.flatnonzero(sizes)
        if len(full) == 0:
            return [b""] * len(texts)
        data = texts.buffers()[2].slice(int(bounds[0]), int(bounds[-1] - bounds[0]))
        text_starts = (bounds[:-1] - bounds[0])[full]
        starts = unit_starts(np.frombuffer(data, np.uint8), text_starts)
        offsets = pa.py_buffer(np.append(starts, data.size).astype(np.int64).tobytes())
        units = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, offsets, data]).dictionary_encode()
        distinct = units.dictionary.to_pylist()
        young, old = self.young, self.old
        new = []
        for u in [u for u in distinct if u not in young]:
            known = old.get(u)
            if known is None:
                new.append(u)
            else:
                young[u] = known
                self.held += 3 * len(u) + 150
        self._learn(new)
        ids = pa.array([young[u] for u in distinct], pa.large_binary()).take(units.indices)
        ends = np.frombuffer(ids.buffers()[1], np.int64, len(ids) + 1)
        blob = memoryview(ids.buffers()[2] or b"")
        firsts = np.append(np.searchsorted(starts, text_starts), len(starts))
        out = [b""] * len(texts)
        for k, a, b in zip(full.tolist(), ends[firsts[:-1]].tolist(), ends[firsts[1:]].tolist()):
            out[k] = bytes(blob[a:b])
        return out


@functools.lru_cache(maxsize=1)
def coder(path: str) -> UnitCoder:
    return UnitCoder(path)


def write_token_files(docs: DataFrame, path: str, tokenizer: str, id: str = "doc_id", text: str = "text", end_id: int = 0,
                      shard_ids: int = SHARD_IDS, range_bytes: int = RANGE_BYTES) -> None:
    """Write every text's ids and the end id to shards under `path`, ascending by id.

    One shuffle moves texts to their ranges; ties of a hot id spread by the text's hash and then by place, so no id
    fills a task. The tokenizer file must be readable by the driver, which ships it.
    """
    spark = docs.sparkSession
    spark.sparkContext.addFile(tokenizer)
    name = tokenizer.rsplit("/", 1)[-1]
    slim = docs.select(col(id).cast("long").alias("d"), text_or_empty(text).alias("t"))
    total = slim.agg(F.sum(F.octet_length("t") + 16)).first()[0] or 0
    ranges = max(1, math.ceil(total / range_bytes))
    placed = slim.withColumns({"h": F.xxhash64("t"), "at": F.monotonically_increasing_id()})
    order = [F.col("d").asc_nulls_first(), F.col("h"), F.col("at")]
    placed = placed.repartitionByRange(ranges, *order).sortWithinPartitions(*order).select(F.spark_partition_id().alias("part"), "d", "t")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = coder(SparkFiles.get(name))
        width = np.dtype(own.kind).itemsize
        end = np.array([end_id], dtype=own.kind).tobytes()
        part, seq, used = 0, 0, 0
        doc_ids: list[int | None] = []
        sizes: list[int] = []
        held: list[bytes] = []

        def shard() -> pa.RecordBatch:
            label = f"{part:09d}-{seq:06d}-{len(doc_ids)}-{used}"
            return pa.RecordBatch.from_pydict({"shard": [label], "data": pa.array([write_shard(doc_ids, sizes, held, width)], pa.binary())})

        for batch in batches:
            for start, stop in steps(batch.column(2), 2_000_000):
                rows = batch.slice(start, stop - start)
                part = rows.column(0)[0].as_py()
                for d, ids in zip(rows.column(1).to_pylist(), own.encode(rows.column(2))):
                    size = len(ids) // width + 1
                    if doc_ids and used + size > shard_ids:
                        yield shard()
                        doc_ids, sizes, held, used, seq = [], [], [], 0, seq + 1
                    doc_ids.append(d)
                    sizes.append(size)
                    held += [ids, end]
                    used += size
            del batch, rows
        if doc_ids:
            yield shard()
        pa.default_memory_pool().release_unused()

    shards = placed.mapInArrow(run, "shard string, data binary")
    shards.select("shard", F.col("data").cast("string").alias("value")).write.partitionBy("shard").option("maxRecordsPerFile", 1).text(path)


def _files(spark: SparkSession, path: str) -> DataFrame:
    """All shard files with `shard`, the label in their folder's name."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return rows.withColumn("shard", F.regexp_extract("path", "shard=([0-9-]+)/", 1))


def manifest(spark: SparkSession, path: str, block: int = 256) -> DataFrame:
    """(shard, n_docs, n_ids, first_id): one row a shard with the ids of all shards before it, from the folder names alone.

    The running sum goes over blocks of ranges first, so no task holds the shards of the whole corpus.
    """
    part = F.split("shard", "-")
    rows = _files(spark, path).select("shard").distinct()
    rows = rows.select("shard", F.floor(part[0].cast("long") / block).alias("block"), part[2].cast("long").alias("n_docs"), part[3].cast("long").alias("n_ids"))
    within = Window.partitionBy("block").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    blocks = rows.groupBy("block").agg(F.sum("n_ids").alias("in_block"))
    earlier = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select("block", F.coalesce(F.sum("in_block").over(earlier), F.lit(0)).alias("base"))
    rows = rows.withColumn("inside", F.coalesce(F.sum("n_ids").over(within), F.lit(0)))
    return rows.join(blocks, "block").select("shard", "n_docs", "n_ids", (F.col("base") + F.col("inside")).cast("long").alias("first_id"))


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document in the shards; `start` counts the ids of all documents before it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for label, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                shard = Shard(memoryview(data.as_buffer()))
                ends = shard.all_ends()
                starts = np.concatenate([[0], ends[:-1]]).astype(np.int64)
                sums = []
                for a, b in zip(starts.tolist(), ends.tolist()):
                    sums.append(zlib.crc32(shard.ids[a:b].astype("<u4").tobytes()))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([label] * shard.n_docs, pa.string()), pa.array(shard.doc_ids(), pa.int64()), pa.array(starts), pa.array(ends - starts), pa.array(sums, pa.int64())],
                    names=["shard", "doc_id", "at", "n_tokens", "ids_crc32"],
                )

    rows = _files(spark, path).select("shard", "content").mapInArrow(run, "shard string, doc_id long, at long, n_tokens long, ids_crc32 long")
    bases = manifest(spark, path).select("shard", "first_id")
    return rows.join(bases, "shard").select("doc_id", (F.col("first_id") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")
