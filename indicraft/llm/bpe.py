"""Byte-level BPE encoding and decoding over padded numpy matrices.

Texts are split by the tokenizer's pattern; each distinct piece of a slice is encoded once. Pieces of
similar length form a padded matrix of token ids. Every round looks the neighbouring pairs up in a
hashed table of merges, each row merges its leftmost pair of least rank, rows are compacted, and rows
without a pair left drop out. A long piece would need as many rounds as it has bytes, so above
`MATRIX_BYTES` the same rule (least rank first, leftmost among equals) runs over a heap of pairs in
O(n log n); both give the ids of the reference tokenizer library.

Defined cases: null and empty texts give no ids and decode to no bytes; every byte is a token, so any
text encodes; ids outside the vocabulary raise when decoded.
"""

from __future__ import annotations

import base64
import heapq
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import col, fresh, map_texts, steps, text_or_empty

#: Longest piece, in bytes, that takes part in the matrices.
MATRIX_BYTES = 128
#: Most pieces in one matrix.
MATRIX_ROWS = 16_384
#: Pieces a worker remembers between slices.
REMEMBERED = 120_000


class Vocabulary:
    """Ranks of a tiktoken-format file and a hash table (left id, right id) → merged id."""

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as lines:
            pairs = [line.split() for line in lines if line.strip()]
        self.ranks = {base64.b64decode(token): int(rank) for token, rank in pairs}
        self.split = regex.compile(pattern)
        self.tokens = [b""] * (max(self.ranks.values()) + 1)
        for token, rank in self.ranks.items():
            self.tokens[rank] = token
        self.byte = np.array([self.ranks[bytes([b])] for b in range(256)], dtype=np.int64)
        keys, ids = [], []
        get = self.ranks.get
        for token, rank in self.ranks.items():
            for cut in range(1, len(token)):
                left, right = get(token[:cut]), get(token[cut:])
                if left is not None and right is not None:
                    keys.append((left << 32) | right)
                    ids.append(rank)
        self._fill(np.array(keys, dtype=np.uint64), np.array(ids, dtype=np.int64))
        self.done: dict[str, bytes] = {}

    def _fill(self, keys: np.ndarray, ids: np.ndarray) -> None:
        """Open addressing with linear probing in numpy arrays, filled a probe distance at a time."""
        size = 1 << int(np.ceil(np.log2(max(2, len(keys)) * 3)))
        self.mask = size - 1
        self.slots, self.ids = np.full(size, np.iinfo(np.uint64).max, np.uint64), np.full(size, -1, np.int64)
        at, left, self.probes = self._home(keys), np.arange(len(keys)), 0
        while len(left):
            self.probes += 1
            free = self.slots[at[left]] == np.iinfo(np.uint64).max
            _, first = np.unique(at[left[free]], return_index=True)
            put = left[free][first]
            self.slots[at[put]], self.ids[at[put]] = keys[put], ids[put]
            left = np.setdiff1d(left, put, assume_unique=True)
            at[left] = (at[left] + 1) & self.mask

    def _home(self, keys: np.ndarray) -> np.ndarray:
        mixed = keys * np.uint64(0x9E3779B97F4A7C15)
        return ((mixed ^ (mixed >> np.uint64(29))) >> np.uint64(11)).astype(np.int64) & self.mask

    def merged(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Id of each pair's merge, or -1."""
        keys = (left.astype(np.uint64) << np.uint64(32)) | right.astype(np.uint64)
        at, out = self._home(keys), np.full(len(keys), -1, np.int64)
        open_ = np.arange(len(keys))
        while len(open_):
            slot = self.slots[at[open_]]
            hit = slot == keys[open_]
            out[open_[hit]] = self.ids[at[open_[hit]]]
            open_ = open_[~hit & (slot != np.iinfo(np.uint64).max)]
            at[open_] = (at[open_] + 1) & self.mask
        return out


@lru_cache(maxsize=4)
def vocabulary(path: str, pattern: str) -> Vocabulary:
    return Vocabulary(path, pattern)


def merge_matrix(vocab: Vocabulary, pieces: list[bytes]) -> list[bytes]:
    """Ids (as 32-bit numbers end to end) of pieces of similar length, by rounds over one padded matrix (-1 pads)."""
    sizes = np.array([len(p) for p in pieces])
    width = int(sizes.max())
    ids = np.full((len(pieces), width), -1, np.int64)
    inside = np.arange(width)[None, :] < sizes[:, None]
    ids[inside] = vocab.byte[np.frombuffer(b"".join(pieces), np.uint8)]
    # rank of the merge at each position with its right neighbour; a huge number where there is none
    none = np.iinfo(np.int64).max
    rank = np.full((len(pieces), width), none, np.int64)
    pair = inside[:, 1:]
    got = vocab.merged(ids[:, :-1][pair], ids[:, 1:][pair])
    got[got < 0] = none
    rank[:, :-1][pair] = got
    out: list[bytes] = [b""] * len(pieces)
    rows = np.arange(len(pieces))
    while True:
        at = rank.argmin(axis=1)  # the first of equal minima, so the leftmost
        best = rank[np.arange(len(rows)), at]
        stop = best == none
        stride = ids.shape[1]
        whole = ids.astype(np.int32).tobytes() if stop.any() else b""
        for k, row, n in zip((np.flatnonzero(stop) * stride * 4).tolist(), rows[stop].tolist(), (sizes[stop] * 4).tolist()):
            out[row] = whole[k : k + n]
        if stop.all():
            return out
        go = ~stop
        rows, ids, rank, sizes, at, best = rows[go], ids[go], rank[go], sizes[go], at[go], best[go]
        n = np.arange(len(rows))
        ids[n, at] = best
        # compaction: everything right of the merged pair moves one place left
        width = int(sizes.max())
        columns = np.arange(width - 1)[None, :]
        source = columns + (columns > at[:, None])
        ids, rank = np.take_along_axis(ids, source, axis=1), np.take_along_axis(rank, source, axis=1)
        sizes = sizes - 1
        # ranks change only beside the new token
        for shift in (-1, 0):
            where = at + shift
            ok = (where >= 0) & (where < sizes)
            r, c = n[ok], where[ok]
            has = c + 1 < sizes[r]
            new = np.full(len(r), none, np.int64)
            found = vocab.merged(ids[r[has], c[has]], ids[r[has], c[has] + 1])
            found[found < 0] = none
            new[has] = found
            rank[r, c] = new


def merge_long(vocab: Vocabulary, piece: bytes) -> bytes:
    """The same rule for one long piece: a heap of (rank, position) over a linked list."""
    ids = vocab.byte[np.frombuffer(piece, np.uint8)].tolist()
    n = len(ids)
    first = vocab.merged(np.array(ids[:-1], dtype=np.int64), np.array(ids[1:], dtype=np.int64)).tolist() if n > 1 else []
    heap = [(r, i) for i, r in enumerate(first) if r >= 0]
    heapq.heapify(heap)
    now = first + [-1]
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    get, tokens = vocab.ranks.get, vocab.tokens

    def look(i: int) -> None:
        j = after[i]
        now[i] = -1 if j >= n else get(tokens[ids[i]] + tokens[ids[j]], -1)
        if now[i] >= 0:
            heapq.heappush(heap, (now[i], i))

    while heap:
        r, i = heapq.heappop(heap)
        if now[i] != r:
            continue
        j = after[i]
        ids[i], ids[j], now[j] = r, -1, -2
        after[i] = after[j]
        if after[i] < n:
            before[after[i]] = i
        look(i)
        if before[i] >= 0:
            look(before[i])
    return np.array([x for x in ids if x >= 0], dtype=np.int32).tobytes()


def encode_pieces(vocab: Vocabulary, pieces: list[bytes]) -> list[bytes]:
    """Ids of distinct pieces, bucketed by length so that little of a matrix is padding."""
    out: list[bytes] = [b""] * len(pieces)
    buckets: dict[int, list[int]] = {}
    for k, piece in enumerate(pieces):
        n = len(piece)
        if n > MATRIX_BYTES:
            out[k] = merge_long(vocab, piece)
        else:
            buckets.setdefault(n if n < 16 else -(-n // 8) * 8, []).append(k)
    for _, members in sorted(buckets.items()):
        for start in range(0, len(members), MATRIX_ROWS):
            part = members[start : start + MATRIX_ROWS]
            for k, ids in zip(part, merge_matrix(vocab, [pieces[k] for k in part])):
                out[k] = ids
    return out


def encode_texts(vocab: Vocabulary, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(all ids end to end, offsets of each text)."""
    split, done = vocab.split.findall, vocab.done
    if len(done) > REMEMBERED:
        done.clear()
    found = [split(t) for t in texts]
    new = list(set().union(*found) - done.keys()) if found else []
    for piece, ids in zip(new, encode_pieces(vocab, [p.encode() for p in new])):
        done[piece] = ids
    rows = [b"".join([done[p] for p in pieces]) for pieces in found]
    return np.frombuffer(b"".join(rows), np.int32), np.concatenate([[0], np.cumsum([len(r) // 4 for r in rows])]).astype(np.int64)


def shipped(df: DataFrame, path: str) -> str:
    """Name under which Spark hands the vocabulary file to every executor."""
    df.sparkSession.sparkContext.addFile(path)
    return path.rsplit("/", 1)[-1]


def encode(df: DataFrame, path: str, pattern: str, text: str = "text", ids: str = "token_ids") -> DataFrame:
    """Append the array of ids of each whole text; `path` is a rank file the driver can read."""
    name, source = shipped(df, path), fresh(df, "text_in")

    def run(batch: pa.RecordBatch) -> dict:
        vocab = vocabulary(SparkFiles.get(name), pattern)
        flat, offsets = encode_texts(vocab, batch.column(batch.schema.names.index(source)).to_pylist())
        return {ids: pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(flat))}

    df = df.select(*[col(c) for c in df.columns if c.lower() != ids.lower()])
    return map_texts(df.withColumn(source, text_or_empty(text)), run, T.StructType([T.StructField(ids, T.ArrayType(T.IntegerType()))]), source).drop(source)


def decode(df: DataFrame, path: str, pattern: str, ids: str = "token_ids", out: str = "decoded") -> DataFrame:
    """Append the bytes of each array of ids; null ids give no bytes."""
    name = shipped(df, path)
    keep = [c for c in df.columns if c.lower() != out.lower()]
    df = df.select(*[col(c) for c in keep])
    schema = T.StructType([*df.schema.fields, T.StructField(out, T.BinaryType())])
    at = df.columns.index(ids)

    def run(batches):
        tokens = vocabulary(SparkFiles.get(name), pattern).tokens
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                column = part.column(at)
                flat = column.flatten().to_pylist()
                sizes = [0 if n is None else n for n in column.value_lengths().to_pylist()]
                data, k = [], 0
                for n in sizes:
                    data.append(b"".join([tokens[i] for i in flat[k : k + n]]))
                    k += n
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(data, type=pa.binary())], names=[*part.schema.names, out])

    return df.mapInArrow(run, schema)


def round_trip(df: DataFrame, path: str, pattern: str, text: str = "text", ids: str = "token_ids") -> DataFrame:
    """`text` replaced by what its ids decode to, and the array of ids appended, in one pass of one Python worker.

    Null texts come back empty. A worker forgets its pieces at the end of a partition.
    """
    name, source = shipped(df, path), fresh(df, "text_in")
    keep = [c for c in df.columns if c.lower() not in (text.lower(), ids.lower())]
    df = df.select(*[col(c) for c in keep], text_or_empty(text).alias(source))
    schema = T.StructType([*[df.schema[c] for c in keep], T.StructField(text, T.StringType()), T.StructField(ids, T.ArrayType(T.IntegerType()))])

    def run(batches):
        vocab = vocabulary(SparkFiles.get(name), pattern)
        tokens = vocab.tokens
        for batch in batches:
            texts = batch.column(batch.num_columns - 1)
            for start, stop in steps(texts):
                part = batch.slice(start, stop - start)
                flat, offsets = encode_texts(vocab, part.column(part.num_columns - 1).to_pylist())
                back = [b"".join([tokens[i] for i in flat[a:b].tolist()]).decode() for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
                coded = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(flat))
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(back, pa.string()), coded], names=schema.names)
            del batch, texts
        vocab.done.clear()
        pa.default_memory_pool().release_unused()

    return df.mapInArrow(run, schema)
