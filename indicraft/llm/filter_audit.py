"""What filters remove alone, together and in every order, from a sparse document-term matrix.

Tasks count the words of their documents against a word list of their own and store shards: compressed sparse rows
(row ends, word numbers, counts) with the shard's words. All shards' words then get global numbers in one shuffle: words are dealt to
buckets by hash and ranked in each, and the number is rank times buckets plus bucket, so buckets hand out numbers in turn and none
needs to know how many words another holds. A word takes part once per shard and not once per document, so one that stands in every document
costs a row per shard. With global numbers in place, a row's sum is the document's words (filter A) and its stored entries are the distinct ones (filter B).

C and D are read off the text's bytes on the way. E, the same text under a smaller id, compares ids with the least id of the text's
digest, after rows of one (id, digest) are counted together. What is left are counts per part and set of failed filters, at
most 32 a part; 120 orders of five steps are figured on those.

Defined cases: null texts are empty; a null id is smaller than none and has no smaller one, so it never fails E; rows of one id and text do not make
each other fail; an id labelled more than once counts as good or toxic if any of its rows says so; null and empty sources
are one part; very long texts are a shard of their own; an empty table gives no rows; other columns are not read, so none can clash.
"""

from __future__ import annotations

import hashlib
import itertools
import math
import uuid
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, col, steps, text_or_empty

#: The filters in the order of their bits, and the characters of C and D.
FILTERS = "ABCDE"
UPPER = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
SYMBOLS = b"#$%&*|"
LEAST_WORDS = 200
LEAST_DISTINCT = 50
MOST_UPPER = 2
#: Bytes of text in a shard.
SHARD_BYTES = 16_000_000
#: Words of shards, repeats counted, that a bucket of the dictionary ranks.
BUCKET_WORDS = 1_000_000
#: Bits of a global number where it is packed behind the word's place in its shard.
TERM_BITS = 40
#: Number types that a shard may use, smallest first; the place of the type is a packed array's first byte.
KINDS = ("<u1", "<u2", "<u4", "<u8")


@dataclass
class TermMatrix:
    """`shards` (shard, docs, ends, terms, counts): compressed rows with global word numbers; `dictionary` (word, term), which
    is read from the stored word lists `local` of the shards."""

    shards: DataFrame
    dictionary: DataFrame
    local: DataFrame

    def rows(self, shard) -> list[tuple[np.ndarray, np.ndarray]]:
        """(terms, counts) of each document of one collected shard."""
        ends = unpacked(bytes(shard["ends"])).astype(np.int64)
        terms, counts = unstepped(unpacked(bytes(shard["terms"])), ends), unpacked(bytes(shard["counts"]))
        return list(zip(np.split(terms, ends[:-1]), np.split(counts, ends[:-1])))


_DOC = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("part", T.StringType()), T.StructField("digest", T.BinaryType()),
    T.StructField("c", T.BooleanType()), T.StructField("d", T.BooleanType()),
])
_SHARD = T.StructType([
    T.StructField("shard", T.LongType()), T.StructField("docs", T.ArrayType(_DOC)), T.StructField("ends", T.BinaryType()),
    T.StructField("terms", T.BinaryType()), T.StructField("counts", T.BinaryType()), T.StructField("words", T.ArrayType(T.BinaryType())),
])
_ARROW_DOC = pa.struct([("doc_id", pa.int64()), ("part", pa.string()), ("digest", pa.binary()), ("c", pa.bool_()), ("d", pa.bool_())])


def packed(values: np.ndarray) -> bytes:
    """Non-negative numbers in the smallest type that holds them, compressed."""
    top = int(values.max()) if len(values) else 0
    kind = next(k for k, name in enumerate(KINDS) if top <= np.iinfo(name).max)
    return bytes([kind]) + zstandard.compress(values.astype(KINDS[kind]).tobytes(), 1)


def unpacked(data: pa.Scalar | bytes) -> np.ndarray:
    view = memoryview(data if isinstance(data, bytes) else data.as_buffer())
    return np.frombuffer(zstandard.decompress(view[1:]), KINDS[view[0]])


def stepped(values: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Rising rows as the steps between neighbours; a row's first stays."""
    out = np.diff(values, prepend=values[:0] if len(values) == 0 else 0)
    starts = np.concatenate([[0], ends[:-1]])[ends > np.concatenate([[0], ends[:-1]])]
    out[starts] = values[starts]
    return out


def unstepped(steps_: np.ndarray, ends: np.ndarray) -> np.ndarray:
    total = np.cumsum(steps_, dtype=np.int64)
    starts = np.concatenate([[0], ends[:-1]])
    sizes = ends - starts
    starts = starts[sizes > 0]
    return total - np.repeat(total[starts] - steps_[starts], sizes[sizes > 0])


class _Builder:
    """Rows of one shard while its task reads documents."""

    def __init__(self) -> None:
        self.docs: list[dict] = []
        self.number: dict[bytes, int] = {}
        self.terms: list[np.ndarray] = []
        self.counts: list[np.ndarray] = []
        self.sizes: list[int] = []
        self.held = 0

    def add(self, doc_id: int | None, part: str, text: str) -> None:
        data = text.encode("utf-8", "surrogatepass")
        # bytes.split cuts at exactly the six ASCII characters that words may not hold
        found = Counter(data.split())
        number = self.number
        terms = np.fromiter([number.setdefault(w, len(number)) for w in found], np.int64, len(found))
        rising = np.argsort(terms)
        self.terms.append(terms[rising])
        self.counts.append(np.fromiter(found.values(), np.int64, len(found))[rising])
        self.sizes.append(len(found))
        upper = len(data) - len(data.translate(None, UPPER))
        symbols = len(data) - len(data.translate(None, SYMBOLS))
        digest = hashlib.blake2b(data, digest_size=16).digest()
        self.docs.append({"doc_id": doc_id, "part": part, "digest": digest, "c": 100 * upper > MOST_UPPER * len(text), "d": symbols > 0})
        self.held += len(data) + 64

    def batch(self) -> pa.RecordBatch:
        ends = np.cumsum(self.sizes)
        values = [
            pa.array([uuid.uuid4().int >> 65], pa.int64()), pa.array([self.docs], pa.list_(_ARROW_DOC)),
            pa.array([packed(ends)], pa.binary()), pa.array([packed(stepped(np.concatenate(self.terms), ends))], pa.binary()),
            pa.array([packed(np.concatenate(self.counts))], pa.binary()), pa.array([list(self.number)], pa.list_(pa.binary())),
        ]
        return pa.RecordBatch.from_arrays(values, names=_SHARD.names)


def local_shards(docs: DataFrame, id: str, text: str, source: str, shard_bytes: int) -> DataFrame:
    """Compressed rows with word numbers of the shard itself, and the shard's words in that order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = _Builder()
        for batch in batches:
            for start, stop in steps(batch.column(2)):
                rows = batch.slice(start, stop - start)
                for doc_id, part, value in zip(*[c.to_pylist() for c in rows.columns]):
                    shard.add(doc_id, part, value)
                    if shard.held >= shard_bytes:
                        yield shard.batch()
                        shard = _Builder()
        if shard.docs:
            yield shard.batch()

    slim = docs.select(col(id).cast("long").alias("i"), F.coalesce(col(source).cast("string"), F.lit("")).alias("p"), text_or_empty(text).alias("t"))
    return slim.mapInArrow(run, _SHARD)


def _ranked(words: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """(rank of each word among the distinct ones, the distinct ones in order)."""
    coded = words.dictionary_encode()
    rising = pc.sort_indices(coded.dictionary).to_numpy()
    ranks = np.empty(len(rising), np.int64)
    ranks[rising] = np.arange(len(rising))
    return ranks[coded.indices.to_numpy()], coded.dictionary.take(pa.array(rising))


def _by_bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.Table]]:
    """The task's buckets one by one, each whole: there are as many partitions as buckets, so a task has few."""
    held = pa.Table.from_batches(got) if (got := [b for b in batches if b.num_rows]) else None
    if held is None:
        return
    buckets = held["bucket"].to_numpy()
    for bucket in np.unique(buckets).tolist():
        yield bucket, held.filter(pa.array(buckets == bucket))


def bucket_entries(batches: Iterator[pa.RecordBatch], buckets: int) -> Iterator[pa.RecordBatch]:
    """(shard, at, word, bucket) of whole buckets to (shard, entries): per bucket and shard the words' places in its list, packed with their global numbers."""
    for bucket, table in _by_bucket(batches):
        ranks, _ = _ranked(table["word"].combine_chunks())
        entries = (table["at"].to_numpy().astype(np.int64) << TERM_BITS) | (ranks * buckets + bucket)
        shards = table["shard"].to_numpy()
        by_shard = np.argsort(shards, kind="stable")
        shards, entries = shards[by_shard], entries[by_shard]
        cuts = [0, *(np.flatnonzero(np.diff(shards)) + 1).tolist(), len(shards)]
        packs = [entries[a:b].astype("<i8").tobytes() for a, b in itertools.pairwise(cuts)]
        yield pa.RecordBatch.from_arrays([pa.array(shards[cuts[:-1]], pa.int64()), pa.array(packs, pa.binary())], names=["shard", "entries"])


def bucket_dictionary(batches: Iterator[pa.RecordBatch], buckets: int) -> Iterator[pa.RecordBatch]:
    """(word, bucket) of whole buckets to the distinct words with their global numbers."""
    for bucket, table in _by_bucket(batches):
        _, words = _ranked(table["word"].combine_chunks())
        yield pa.RecordBatch.from_arrays([words, pa.array(np.arange(len(words)) * buckets + bucket, pa.int64())], names=["word", "term"])


def document_term_matrix(docs: DataFrame, scratch: Scratch, id: str = "doc_id", text: str = "text", source: str = "source",
                         shard_bytes: int = SHARD_BYTES, bucket_words: int = BUCKET_WORDS) -> TermMatrix:
    """Counts of every word of every whole text as stored shards of compressed sparse rows with global word numbers."""
    local = scratch.store(local_shards(docs, id, text, source, shard_bytes), "audit-local")
    total = local.agg(F.sum(F.size("words"))).first()[0] or 0
    buckets = 64 * max(1, -(-total // (64 * bucket_words)))
    named = local.select("shard", F.posexplode("words").alias("at", "word")).withColumn("bucket", F.pmod(F.xxhash64("word"), F.lit(buckets)).cast("int"))
    named = named.repartition(buckets, "bucket")
    lookup = named.mapInArrow(lambda batches: bucket_entries(batches, buckets), "shard long, entries binary").groupBy("shard").agg(F.collect_list("entries").alias("entries"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1)
                ends, counts = unpacked(row.column(2)[0]).astype(np.int64), unpacked(row.column(4)[0])
                # the place in the list leads each entry, so sorting restores it
                entries = np.frombuffer(b"".join(row.column(5)[0].as_py()), "<i8")
                table = np.sort(entries) & ((1 << TERM_BITS) - 1)
                terms = table[unstepped(unpacked(row.column(3)[0]), ends)]
                # rows rise by global number too
                rising = np.lexsort((terms, np.repeat(np.arange(len(ends)), np.diff(ends, prepend=0))))
                blobs = packed(stepped(terms[rising], ends)), packed(counts[rising])
                yield pa.RecordBatch.from_arrays([*row.columns[:3], *[pa.array([b], pa.binary()) for b in blobs]], names=["shard", "docs", "ends", "terms", "counts"])

    joined = local.drop("words").join(lookup, "shard", "left").select("shard", "docs", "ends", "terms", "counts", F.coalesce("entries", F.array().cast("array<binary>")).alias("entries"))
    schema = T.StructType([_SHARD["shard"], _SHARD["docs"], _SHARD["ends"], _SHARD["terms"], _SHARD["counts"]])
    shards = scratch.store(joined.mapInArrow(run, schema), "audit-shards")
    dictionary = named.select("word", "bucket").mapInArrow(lambda batches: bucket_dictionary(batches, buckets), "word binary, term long")
    return TermMatrix(shards, dictionary, local)


def row_figures(matrix: TermMatrix) -> DataFrame:
    """(doc_id, part, digest, c, d, n_words, n_distinct): row sums and stored entries of the shards' rows."""
    figures = T.StructType([*_DOC.fields, T.StructField("n_words", T.LongType()), T.StructField("n_distinct", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                ends, counts = unpacked(batch.column(1)[k]).astype(np.int64), unpacked(batch.column(2)[k])
                starts = np.concatenate([[0], ends[:-1]])
                upto = np.concatenate([[0], np.cumsum(counts, dtype=np.int64)])
                docs = batch.column(0).slice(k, 1).flatten()
                yield pa.RecordBatch.from_arrays([*docs.flatten(), pa.array(upto[ends] - upto[starts]), pa.array(ends - starts)], names=figures.names)

    return matrix.shards.select("docs", "ends", "counts").mapInArrow(run, figures)


def failures(rows: DataFrame, labels: DataFrame, id: str = "doc_id") -> DataFrame:
    """(part, failed, n, n_good, n_toxic): rows by part and set of failed filters, a bit per filter from A on."""
    flags = rows.select(
        "doc_id", "part", "digest",
        (F.when(F.col("n_words") < LEAST_WORDS, 1).otherwise(0) + F.when(100 * F.col("n_distinct") < LEAST_DISTINCT * F.col("n_words"), 2).otherwise(0)
         + F.col("c").cast("int") * 4 + F.col("d").cast("int") * 8).alias("failed"),
    )
    # repeated rows count together before anything is joined, so neither an id nor a text is a hot key
    counted = flags.groupBy("doc_id", "digest", "part", "failed").agg(F.count("*").alias("n"))
    first = flags.filter("doc_id is not null").groupBy("digest").agg(F.min("doc_id").alias("doc_id")).withColumn("first", F.lit(True))
    marks = labels.filter(col(id).isNotNull()).groupBy(col(id).cast("long").alias("doc_id")).agg(
        F.coalesce(F.bool_or(F.col("quality") == 1), F.lit(False)).alias("good"), F.coalesce(F.bool_or(F.col("toxic") == 1), F.lit(False)).alias("toxic")
    )
    known = counted.filter("doc_id is not null").join(first, ["doc_id", "digest"], "left").join(marks, "doc_id", "left")
    known = known.select("part", (F.col("failed") + F.when(F.col("first").isNull(), 16).otherwise(0)).alias("failed"), "n",
                         F.coalesce("good", F.lit(False)).alias("good"), F.coalesce("toxic", F.lit(False)).alias("toxic"))
    unknown = counted.filter("doc_id is null").select("part", "failed", "n", F.lit(False).alias("good"), F.lit(False).alias("toxic"))
    n = lambda when: F.coalesce(F.sum(F.when(when, F.col("n"))), F.lit(0)).alias
    return known.unionByName(unknown).groupBy("part", "failed").agg(F.sum("n").alias("n"), n(F.col("good"))("n_good"), n(F.col("toxic"))("n_toxic"))


def orders(spark: SparkSession) -> DataFrame:
    """(line, filter_order, step, own, before): the 120 orders, a row per step with the bits of its filter and of those before it."""
    bit = {f: 1 << k for k, f in enumerate(FILTERS)}
    rows = [("".join(o), k + 1, bit[o[k]], sum(bit[f] for f in o[:k])) for o in itertools.permutations(FILTERS) for k in range(len(o))]
    return spark.createDataFrame([(n, *r) for n, r in enumerate(rows)], "line int, filter_order string, step int, own int, before int")


def interactions(cells: DataFrame) -> DataFrame:
    """One row per part, order and step from the counts of `failures`."""
    lines = math.factorial(len(FILTERS)) * len(FILTERS)
    failed, own, before = F.col("failed"), F.col("own"), F.col("before")
    fails = failed.bitwiseAND(own) > 0
    earlier = failed.bitwiseAND(before) > 0
    # orders in which a given one of the failed filters comes first
    share = F.lit(math.factorial(len(FILTERS))) / F.greatest(F.bit_count(failed), F.lit(1))

    def total(when: Column, value: Column | str = "n") -> Column:
        return F.coalesce(F.sum(F.when(when, F.col(value) if isinstance(value, str) else value)), F.lit(0)).cast("long")

    # at most 32 cells a part and a fixed table of 600 lines
    every = cells.withColumn("line", F.explode(F.sequence(F.lit(0), F.lit(lines - 1))))
    return every.join(F.broadcast(orders(cells.sparkSession)), "line").groupBy("part", "filter_order", "step").agg(
        total(~fails & ~earlier).alias("kept"), total(fails & ~earlier).alias("removed"), total(fails & earlier).alias("redundant"),
        total(failed == own).alias("unique_fails"), total(fails & ~earlier, "n_good").alias("good_lost"), total(fails & ~earlier, "n_toxic").alias("toxic_lost"),
        total(fails, F.col("n") * share).alias("shapley"),
    )


def audit_filters(docs: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """The audit of the five filters over all documents; intermediate tables go once the counts are known."""
    spark = docs.sparkSession
    scratch = Scratch(spark)
    matrix = document_term_matrix(docs, scratch, id, text, source)
    scratch.drop(matrix.local)
    cells = scratch.store(failures(row_figures(matrix), labels, id), "audit-cells")
    scratch.drop(matrix.shards)
    return interactions(cells)
