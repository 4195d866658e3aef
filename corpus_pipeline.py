"""Training corpus from `documents`: toxic texts out, one of each near-duplicate group, personal data
rewritten, sources mixed to target sizes, ids of the tokenizer. Each stage is written and read again."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from indicraft.llm.bpe import round_trip
from indicraft.llm.common import col, pack, pack_rest, table, unpack
from indicraft.llm.mixing import mix
from indicraft.llm.ngram_join import keep_one
from indicraft.llm.pii import find_personal_data
from indicraft.llm.toxicity import fit_toxicity, score_toxicity
from indicraft.session import scratch_path

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the chain, trained on all labels, does not call toxic."""
    model = fit_toxicity(docs, table(spark, sf_dir, "labels"))
    packed, row = pack_rest(docs, "text")
    return unpack(score_toxicity(packed, model).filter("predicted = 0"), row, docs.columns, text=F.col("text"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, the one with the least id."""
    return keep_one(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data and terms that reveal it rewritten."""
    packed, row = pack(docs, "text", "n_chars")
    found = find_personal_data(packed, clean="clean_text")
    hit = F.size("spans") > 0
    text = F.when(hit, F.col("clean_text")).otherwise(F.col("text"))
    n_chars = F.when(hit, F.length("clean_text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType)
    return unpack(found, row, docs.columns, text=text, n_chars=n_chars)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it: sources weigh 3, 1, 2, ... and share 150% of all words."""
    packed, row = pack(docs, "doc_id", "source", "text")
    taken = mix(packed).filter("copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    return unpack(taken, row, docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every text in `token_ids`, counted in `n_tokens`; the text is what the ids decode to. Other columns stay, but for
    ones of these two names."""
    coded = round_trip(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    kept = [col(c) for c in docs.columns if c.lower() not in ("token_ids", "n_tokens")]
    return coded.select(*kept, "token_ids", F.size("token_ids").cast("long").alias("n_tokens"))


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", toxicity),
    ("near_duplicates", near_duplicates),
    ("personal_data", personal_data),
    ("mixing", mixing),
    ("bpe", tokens),
]

#: The stages learn models and hash texts, which SQL can't express; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; each result is stored in the shared folder and reread."""
    docs = table(spark, sf_dir, "documents")
    name = uuid.uuid4().hex
    for label, stage in STAGES:
        path = scratch_path(spark, f"pipeline-{name}-{label}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
