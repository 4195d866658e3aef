"""Filter audit, token files and fill-in-middle against plain versions."""

import hashlib
import itertools
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from indicraft.llm.common import Scratch
from indicraft.llm.fill_middle import Array, Bitmap, BoundarySet, Runs, boundaries, fill_in_middle, restored, transform
from indicraft.llm.filter_audit import audit_filters, document_term_matrix, packed, stepped, unpacked, unstepped
from indicraft.llm.token_files import EliasFano, Shard, UnitCoder, manifest, read_token_files, write_shard, write_token_files

from .conftest import prose

WORD = re.compile(r"[^\x20\x09-\x0D]+")
TOKEN = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")
TEXTS = st.text(st.sampled_from("ab é\t\n\x0b\x85 #<P>S"), max_size=60)
TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


# ---- filter audit


def plain_audit(rows, labels):
    good, toxic = ({r[0] for r in labels if r[0] is not None and r[k] == 1} for k in (1, 2))
    table = {}
    for i, t, s in rows:
        t, words = t or "", WORD.findall(t or "")
        failed = {
            "A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words), "C": 100 * len(re.findall("[A-Z]", t)) > 2 * len(t),
            "D": bool(re.search(r"[#$%&*|]", t)), "E": any(j is not None and i is not None and j < i and (u or "") == t for j, u, _ in rows),
        }
        fails = {f for f, bad in failed.items() if bad}
        for order in itertools.permutations("ABCDE"):
            gone = False
            for k, f in enumerate(order):
                c = table.setdefault((s or "", "".join(order), k + 1), Counter())
                if f in fails:
                    c["redundant" if gone else "removed"] += 1
                    c["unique_fails"] += fails == {f}
                    if not gone:
                        c["good_lost"] += i in good
                        c["toxic_lost"] += i in toxic
                    gone = True
                c["kept"] += not gone
    shapley = Counter()
    for (s, order, k), c in table.items():
        shapley[s, order[k - 1]] += c["removed"]
    return {(*key, *[c[n] for n in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")], shapley[key[0], key[1][key[2] - 1]]) for key, c in table.items()}


def audited(docs, labels):
    return {tuple(r) for r in audit_filters(docs, labels).select("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley").collect()}


@pytest.fixture(scope="module")
def marks(spark):
    rows = [(1, 1, 0), (2, 0, 1), (2, 1, None), (6, None, 1), (9, 1, 1), (None, 1, 1), (99, 1, 1)]
    return rows, spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def test_audit_equals_every_order_played_out(spark, clashing, marks):
    more = [(20 + k, t, "en", "a", 0) for k, t in enumerate(["A B C " * 80, "x #y " * 150, prose(1), prose(9, 250), prose(9, 250), "one two"])]
    docs = clashing.unionByName(spark.createDataFrame(more, "doc_id long, text string, lang string, source string, n_chars long"), allowMissingColumns=True)
    rows = [tuple(r) for r in docs.select("doc_id", "text", "source").collect()]
    assert audited(docs, marks[1]) == plain_audit(rows, marks[0])


def test_audit_of_one_text_repeated_and_of_nothing(spark, nothing, marks):
    hot = spark.range(2_000).select(F.col("id").alias("doc_id"), F.lit("the the the").alias("text"), F.lit("s").alias("source"))
    got = {r["filter_order"]: r for r in audit_filters(hot, marks[1]).filter("step = 1").collect()}
    assert (got["EABCD"]["removed"], got["EABCD"]["kept"], got["ABCDE"]["removed"], got["EABCD"]["shapley"]) == (1_999, 1, 2_000, 1_999 * 40)
    assert audit_filters(nothing, marks[1]).count() == 0


def test_shards_hold_the_corpus_counts_under_global_numbers(spark, awkward):
    scratch = Scratch(spark)
    docs = awkward.unionByName(awkward.withColumn("text", F.concat("text", F.lit(" the the end")))).repartition(5)
    matrix = document_term_matrix(docs, scratch, shard_bytes=2_000)
    words = {r["term"]: bytes(r["word"]).decode() for r in matrix.dictionary.collect()}
    want = sorted(sorted(Counter(WORD.findall(r["text"] or "")).items()) for r in docs.collect())
    assert len(set(words.values())) == len(words)
    shards = matrix.shards.collect()
    got = [sorted((words[int(t)], int(c)) for t, c in zip(terms, counts)) for r in shards for terms, counts in matrix.rows(r)]
    assert len(shards) > 5 and sorted(got) == want


def test_packed_numbers_take_the_smallest_type():
    assert [packed(np.array(v))[0] for v in ([], [255], [256], [70_000], [2**40])] == [0, 0, 1, 2, 3]


@given(st.lists(st.sets(st.integers(0, 2**33), max_size=9), min_size=1, max_size=9))
def test_steps_give_the_rows_back(rows):
    values, ends = np.array([v for r in rows for v in sorted(r)], dtype=np.int64), np.cumsum([len(r) for r in rows])
    assert unstepped(unpacked(packed(stepped(values, ends))), ends).tolist() == values.tolist()


# ---- token files


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(0, 2**40) | st.integers(0, 30), max_size=700), st.sampled_from([0, 1, 2**62]))
def test_select_gives_the_sequence(values, base):
    values = sorted(v + base for v in values)
    coded = EliasFano.of(np.array(values, dtype=np.uint64))
    back, at = EliasFano.parse(memoryview(coded.to_bytes()), 0)
    assert at == len(coded.to_bytes())
    assert back.select_many(np.arange(len(values))).tolist() == values == [back.select(k) for k in range(len(values))]
    with pytest.raises(IndexError):
        back.select(len(values))


def test_boundaries_take_few_bits():
    ends = np.cumsum(np.random.default_rng(3).integers(1, 1_200, 50_000))
    assert len(EliasFano.of(ends).to_bytes()) * 8 < 50_000 * (2.2 + np.log2(ends[-1] / 50_000))


def test_shard_round_trip_with_negative_null_and_equal_ids():
    docs = [(None, [7]), (-(2**63), [1, 2]), (5, []), (5, [9] * 300), (2**63 - 1, [50_000])]
    shard = Shard(write_shard([d for d, _ in docs], [len(x) for _, x in docs], [np.array(x, np.uint16).tobytes() for _, x in docs], 2) + b"\n")
    assert [(shard.doc_id(k), shard.document(k).tolist()) for k in range(len(docs))] == docs
    assert shard.doc_ids() == [d for d, _ in docs]


@pytest.fixture(scope="module")
def coder():
    return UnitCoder(TOKENIZER)


@settings(max_examples=150, deadline=None)
@given(texts=st.lists(st.text(st.sampled_from("ab' sté1!.\t\n\x1c\x85\xa0  　á漢 <|endoftext|>"), max_size=40), max_size=6))
def test_units_encode_like_whole_texts(coder, texts):
    whole = [e.ids for e in coder.tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert [np.frombuffer(x, np.uint16).tolist() for x in coder.encode(pa.array(texts, pa.string()))] == whole


def test_units_of_the_documents_encode_like_whole_texts(spark, sf_dir, coder):
    texts = [r["text"] or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    small = UnitCoder(TOKENIZER, remembered=100_000)
    for k in range(0, len(texts), 20):
        want = [e.ids for e in coder.tokenizer.encode_batch(texts[k : k + 20], add_special_tokens=False)]
        assert [np.frombuffer(x, np.uint16).tolist() for x in small.encode(pa.array(texts[k : k + 20], pa.string()))] == want
        assert small.encode(pa.array([None, *texts[k : k + 3]]).slice(1)) == small.encode(pa.array(texts[k : k + 3]))


def plain_files(coder, rows):
    out, start = [], 0
    for d, t in rows:
        ids = [*coder.tokenizer.encode(t or "", add_special_tokens=False).ids, 0]
        out.append((d, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


@pytest.mark.parametrize(("shard_ids", "range_bytes"), [(500, 3_000), (10**6, 10**9)])
def test_files_equal_a_plain_concatenation(spark, clashing, tmp_path, coder, shard_ids, range_bytes):
    path = str(tmp_path / "files")
    docs = clashing.filter("doc_id is null or doc_id <> 6")
    write_token_files(docs, path, TOKENIZER, shard_ids=shard_ids, range_bytes=range_bytes)
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64(F.coalesce("text", F.lit("")))]
    want = plain_files(coder, [tuple(r) for r in docs.orderBy(*order).select("doc_id", "text").collect()])
    got = sorted((tuple(r) for r in read_token_files(spark, path).collect()), key=lambda r: r[1])
    assert got == want
    known = manifest(spark, path).orderBy("shard").collect()
    assert (len(known) > 3) == (shard_ids == 500) and sum(r["n_docs"] for r in known) == len(want)


def test_one_id_may_hold_most_rows_and_none_may(spark, nothing, tmp_path):
    docs = spark.range(3_000).select(F.when(F.col("id") % 3 > 0, 7).otherwise(F.col("id")).alias("doc_id"), F.lit("same words here").alias("text"))
    write_token_files(docs, str(tmp_path / "hot"), TOKENIZER, range_bytes=4_000)
    got = read_token_files(spark, str(tmp_path / "hot")).orderBy("start").collect()
    assert [r["doc_id"] for r in got] == sorted(r["doc_id"] for r in got) and len(got) == 3_000
    assert [r["start"] for r in got] == [k * got[0]["n_tokens"] for k in range(3_000)]
    assert manifest(spark, str(tmp_path / "hot")).select(F.max("n_docs")).first()[0] < 1_000
    write_token_files(nothing, str(tmp_path / "none"), TOKENIZER)
    assert read_token_files(spark, str(tmp_path / "none")).count() == 0


# ---- fill in middle


@settings(max_examples=60, deadline=None)
@given(st.sets(st.integers(0, 400_000), min_size=1, max_size=300), st.integers(0, 300_000), st.integers(0, 9_000))
def test_boundary_set_selects_every_member(loose, start, length):
    offsets = np.array(sorted(loose | set(range(start, start + length))), dtype=np.int64)
    held = BoundarySet(offsets)
    for k in {0, len(offsets) // 2, len(offsets) - 1, *range(0, len(offsets), 97)}:
        assert held.select(k) == offsets[k]


def test_containers_take_three_forms():
    offsets = np.concatenate([np.arange(0, 60_000, 9), 65_536 + np.arange(5_000), 131_072 + np.arange(0, 60_000, 60)])
    held = BoundarySet(offsets)
    assert [type(c) for c in held.containers] == [Bitmap, Runs, Array]
    assert [held.select(k) for k in range(held.size)] == offsets.tolist()


@settings(max_examples=150, deadline=None)
@given(TEXTS)
def test_boundaries_are_token_ends(text):
    tokens = TOKEN.findall(text)
    assert boundaries(text).tolist() == [0, *itertools.accumulate(map(len, tokens))]


def plain_middle(doc_id, text):
    text = text or ""
    tokens = TOKEN.findall(text)
    digest = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[k : k + 8], 16) for k in (0, 8, 16, 24)]
    n = len(tokens)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(tokens[:a]), "".join(tokens[a:b]), "".join(tokens[b:])
    if not text or any(c in text for c in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 50:
        return n, "plain", None, None, text
    if h[3] % 100 < 80:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


@settings(max_examples=200, deadline=None)
@given(TEXTS, st.integers(-5, 60))
def test_transform_equals_token_lists(text, doc_id):
    assert transform(text, doc_id, 42, 50, 80) == plain_middle(doc_id, text)


def test_fill_in_middle_on_awkward_rows(spark, clashing, nothing):
    tricky = spark.createDataFrame([(k, t, "en", "z", 0) for k, t in enumerate(["a <", "< S> <", "x <P> y", " \n ", "<S", "é  ü\x85 z"] * 8)], nothing.schema)
    docs = clashing.unionByName(tricky, allowMissingColumns=True)
    got = fill_in_middle(docs).withColumn("back", restored(F.col("output"), F.col("form"))).collect()
    assert {r["form"] for r in got} == {"plain", "psm", "spm"} and len(got) == docs.count()
    for r in got:
        assert (r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"]) == plain_middle(r["doc_id"], r["text"])
        assert r["back"] == (r["text"] or "")
    assert fill_in_middle(nothing).count() == 0


def test_words_are_numbered_by_bucket_without_sorting_their_rows(spark, awkward):
    from pyspark.sql import Window

    docs = awkward.repartition(5)
    matrix = document_term_matrix(docs, Scratch(spark), shard_bytes=2_000, bucket_words=50)
    assert "Window" not in matrix.dictionary._jdf.queryExecution().executedPlan().toString()
    words = matrix.local.select(F.explode("words").alias("word"))
    buckets = 64 * max(1, -(-words.count() // (64 * 50)))
    bucket = F.pmod(F.xxhash64("word"), F.lit(buckets)).cast("int")
    want = words.distinct().withColumn("b", bucket).select("word", ((F.row_number().over(Window.partitionBy("b").orderBy("word")) - 1).cast("long") * buckets + F.col("b")).alias("term"))
    assert {tuple(r) for r in matrix.dictionary.collect()} == {tuple(r) for r in want.collect()} != set()
