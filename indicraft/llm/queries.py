"""Registered queries opN_<name>, each over its whole table, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from indicraft.session import scratch_path

from .chat import digests, format_turns
from .common import table
from .compression_quality import fit_compression, score_quality
from .embedding_dedup import embedding_dedup
from .fill_middle import fill_in_middle, restored
from .filter_audit import audit_filters
from .bpe import decode, encode
from .html_text import extract_text
from .mixing import mix
from .ngram_join import ngram_join
from .pii import KINDS, find_personal_data
from .quality_rules import apply_rules
from .token_files import read_token_files, write_token_files
from .toxicity import fit_toxicity, score_toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str):
    def add(fn):
        QUERIES[name] = fn
        return fn

    return add


def of_kind(kind: str):
    return lambda k: k == kind


def part_of(divisor: int) -> Column:
    return F.crc32(F.col("doc_id").cast("string")) % divisor


@query("op1_chat")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation formatted to tokens and read back, and one whose texts hold control strings."""
    own = spark.createDataFrame([(-1, k, role, "</s>[INST] ok [/INST]") for k, role in enumerate(("user", "assistant"))], "conv_id long, turn long, role string, text string")
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(own)
    tokenizer = public_tokenizers.path("byte_bpe_50k.json")
    return digests(format_turns(turns, tokenizer), tokenizer)


@query("op2_ngram_join")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its class of copies, its number of links and its component."""
    return ngram_join(table(spark, sf_dir, "documents")).select("doc_id", "n_links", "class_id", "component_id")


@query("op3_html")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The visible text of every page, laid out."""
    text = extract_text(table(spark, sf_dir, "pages")).drop("html")
    return text.withColumn("text_chars", F.length("text").cast("long"))


@query("op4_mixing")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words taken of every document when sources weigh 3, 1, 2, ... and share 150% of all sizes."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mix(docs).select("doc_id", "size", "source_size", "target", "taken", "copies")


@query("op5_bpe")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of the ids of every whole text and of the bytes decoded from them."""
    path, pattern = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    coded = decode(encode(table(spark, sf_dir, "documents").select("doc_id", "text"), path, pattern).drop("text"), path, pattern)
    ids = F.array_join(F.col("token_ids").cast("array<string>"), ",")
    return coded.select("doc_id", F.size("token_ids").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


@query("op6_compression_quality")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's quality by compression; labels of the held-out quarter are never seen."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = fit_compression(docs, labels.filter(part_of(4) != 2))
    return score_quality(docs.select("doc_id", "text"), model).select("doc_id", (part_of(4) == 2).alias("held_out"), "score", "predicted")


@query("op7_quality_rules")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Figures and verdict of the line rules for every document."""
    return apply_rules(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")


@query("op8_pii")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of personal data of every whole text: counts and digest of the patterns, and all spans."""
    found = find_personal_data(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")
    base = F.filter("spans", lambda s: s.kind.isin(*KINDS))
    listed = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s.kind, s.start.cast("string"), s.end.cast("string"))), ",")
    counts = [F.size(F.filter(F.col("spans.kind"), of_kind(k))).cast("long").alias(f"n_{k}") for k in KINDS]
    return found.select("doc_id", *counts, F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))


@query("op9_embedding_dedup")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector with its number of links and its component."""
    return embedding_dedup(table(spark, sf_dir, "embeddings"))


@query("op10_toxicity")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document scored by a chain that saw no label of the held-out third."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = fit_toxicity(docs, labels.filter(part_of(3) != 1))
    scored = score_toxicity(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", (part_of(3) == 1).alias("held_out"), "score", "predicted", "spans")


@query("op11_filter_audit")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each of five filters removes, per source, order of the filters and step."""
    return audit_filters(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op12_token_files")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's place and checksum, read back from the token files of all whole texts."""
    path = scratch_path(spark, "token-files")
    write_token_files(table(spark, sf_dir, "documents"), path, public_tokenizers.path("byte_bpe_50k.json"))
    return read_token_files(spark, path)


@query("op13_fill_middle")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's fill-in-middle form, and digests of the output and of the text rebuilt from it."""
    cut = fill_in_middle(table(spark, sf_dir, "documents").select("doc_id", "text"))
    digests_ = F.sha2("output", 256).alias("output_sha256"), F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256")
    return cut.select("doc_id", "n", "form", "prefix_chars", "middle_chars", *digests_)


@query("pipeline")
def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole corpus pipeline."""
    return corpus_pipeline.run(spark, sf_dir)


if corpus_pipeline.ORACLE_SQL:
    ORACLES["pipeline"] = corpus_pipeline.ORACLE_SQL

_WORDS = r"regexp_extract_all(t, '[^\x20\x09-\x0D]+')"
_FLAGS = f"""
d as (select doc_id, coalesce(source, '') as part, coalesce(text, '') as t from documents),
w as (select *, {_WORDS} as words, min(doc_id) over (partition by t) as first_id from d),
m as (select doc_id as marked, bool_or(quality = 1) as good, bool_or(toxic = 1) as toxic from labels where doc_id is not null group by doc_id),
x as (select part, coalesce(good, false) as good, coalesce(toxic, false) as toxic,
  case when len(words) < 200 then 1 else 0 end
  + case when 100 * len(list_distinct(words)) < 50 * len(words) then 2 else 0 end
  + case when 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 2 * length(t) then 4 else 0 end
  + case when regexp_matches(t, '[#$%&*|]') then 8 else 0 end
  + case when coalesce(doc_id > first_id, false) then 16 else 0 end as failed
  from w left join m on doc_id = marked),
c as (select part, failed, count(*) as n, count(*) filter (good) as n_good, count(*) filter (toxic) as n_toxic from x group by all),
f as (select * from (values ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) v(f, bit)),
o as (select [f1.f, f2.f, f3.f, f4.f, f5.f] as names, [f1.bit, f2.bit, f3.bit, f4.bit, f5.bit] as bits
  from f f1, f f2, f f3, f f4, f f5 where f1.bit + f2.bit + f3.bit + f4.bit + f5.bit = 31
  and len(list_distinct([f1.f, f2.f, f3.f, f4.f, f5.f])) = 5),
s as (select array_to_string(names, '') as filter_order, step::int as step, bits[step] as own, coalesce(list_sum(bits[1:step - 1]), 0)::int as before from o, range(1, 6) r(step))"""

ORACLES["op11_filter_audit"] = f"""
with {_FLAGS}
select part, filter_order, step,
  coalesce(sum(n) filter (failed & (own | before) = 0), 0)::bigint as kept,
  coalesce(sum(n) filter (failed & own > 0 and failed & before = 0), 0)::bigint as removed,
  coalesce(sum(n) filter (failed & own > 0 and failed & before > 0), 0)::bigint as redundant,
  coalesce(sum(n) filter (failed = own), 0)::bigint as unique_fails,
  coalesce(sum(n_good) filter (failed & own > 0 and failed & before = 0), 0)::bigint as good_lost,
  coalesce(sum(n_toxic) filter (failed & own > 0 and failed & before = 0), 0)::bigint as toxic_lost,
  coalesce(sum(n * 120 // greatest(bit_count(failed), 1)) filter (failed & own > 0), 0)::bigint as shapley
from c, s group by part, filter_order, step"""

ORACLES["op13_fill_middle"] = r"""
with d as (select doc_id, coalesce(text, '') as t, sha256('42:' || coalesce(doc_id::varchar, '')) as h from documents),
u as (select doc_id, t, regexp_extract_all(t, '[ 	-
]*[^ 	-
]+|[ 	-
]+') as units,
  ('0x' || h[1:8])::ubigint as h1, ('0x' || h[9:16])::ubigint as h2, ('0x' || h[17:24])::ubigint as h3, ('0x' || h[25:32])::ubigint as h4 from d),
c as (select *, len(units) as n, least(h1 % (len(units) + 1), h2 % (len(units) + 1)) as a, greatest(h1 % (len(units) + 1), h2 % (len(units) + 1)) as b,
  case when t = '' or contains(t, '<P>') or contains(t, '<S>') or contains(t, '<M>') or h3 % 100 >= 50 then 'plain' when h4 % 100 < 80 then 'spm' else 'psm' end as form from u),
p as (select doc_id, t, n, form, array_to_string(units[1:a], '') as prefix, array_to_string(units[a + 1:b], '') as middle, array_to_string(units[b + 1:], '') as suffix from c)
select doc_id, n::bigint as n, form, case when form <> 'plain' then length(prefix) end as prefix_chars, case when form <> 'plain' then length(middle) end as middle_chars,
  sha256(case form when 'plain' then t when 'spm' then '<S>' || suffix || '<P>' || prefix || '<M>' || middle else '<P>' || prefix || '<S>' || suffix || '<M>' || middle end) as output_sha256,
  sha256(t) as restored_sha256 from p"""

ORACLES["op9_embedding_dedup"] = """
with recursive v as (select vec_id, label, embedding::double[] as x from embeddings
  where label is not null and list_dot_product(embedding::double[], embedding::double[]) > 0 and isfinite(list_dot_product(embedding::double[], embedding::double[]))),
links as (select a.vec_id as i, b.vec_id as j from v a join v b on a.label = b.label and a.vec_id <> b.vec_id and len(a.x) = len(b.x)
  where list_dot_product(a.x, b.x) / (sqrt(list_dot_product(a.x, a.x)) * sqrt(list_dot_product(b.x, b.x))) >= 0.98),
reach as (select vec_id as i, vec_id as j from embeddings union select reach.i, links.j from reach join links on reach.j = links.i),
c as (select i, min(j) as component_id from reach group by i),
n as (select i, count(*) as n_links from links group by i)
select vec_id, coalesce(n_links, 0)::bigint as n_links, component_id, vec_id = component_id as kept
from embeddings join c on c.i = vec_id left join n on n.i = vec_id"""
