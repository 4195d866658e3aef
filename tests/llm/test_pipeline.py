"""Stages of the corpus pipeline against plain versions, each on its own input."""

import collections
import itertools
import re

import numpy as np
import pytest

import corpus_pipeline
from indicraft.llm import ngram_join, pii, toxicity
from indicraft.llm.common import table

STAGES = dict(corpus_pipeline.STAGES)
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return table(spark, SF, "documents")


def rows_of(df):
    return collections.Counter(map(tuple, df.collect()))


def test_toxicity_stage(spark):
    sf = "/root/testdata/sf0.01"  # the smallest tables have too few toxic labels to learn from
    docs = table(spark, sf, "documents")
    model = toxicity.fit_toxicity(docs, table(spark, sf, "labels"))
    want = collections.Counter()
    for r in docs.collect():
        words = re.findall(r"[^\W\d_]+", r.text.lower())
        s = np.array([model.emission(w) for w in words])
        # one state after the other, in plain recursions
        f, b = np.zeros((len(s), 2)), np.ones((len(s), 2))
        for k in range(len(s)):
            into = np.exp(model.start) if k == 0 else f[k - 1] @ np.exp(model.transitions)
            f[k] = into * [1, np.exp(s[k])]
            f[k] /= f[k].sum()
        for k in range(len(s) - 2, -1, -1):
            b[k] = np.exp(model.transitions) @ (b[k + 1] * [1, np.exp(s[k + 1])])
            b[k] /= b[k].sum()
        p = (f * b)[:, 1] / (f * b).sum(axis=1)
        x = np.array([1, np.log(p.sum() + 0.01), p.max(initial=0), np.log1p(len(s)) if len(s) else 0])
        if 1 / (1 + np.exp(-x @ model.calibration)) < 0.7:
            want[tuple(r)] += 1
    assert rows_of(STAGES["toxicity"](spark, docs, sf)) == want and 0 < sum(want.values()) < docs.count()


def test_near_duplicate_stage(spark, docs):
    rows = sorted(docs.collect(), key=lambda r: r.doc_id)
    sets = [set(ngram_join.shingles(r.text).tolist()) for r in rows]
    group = list(range(len(rows)))
    for a, b in itertools.combinations(range(len(rows)), 2):
        if sets[a] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
            old, new = max(group[a], group[b]), min(group[a], group[b])
            group = [new if g == old else g for g in group]
    want = collections.Counter(tuple(rows[k]) for k in range(len(rows)) if group[k] == k)
    assert rows_of(STAGES["near_duplicates"](spark, docs, SF)) == want and sum(want.values()) < len(rows)


def test_personal_data_stage(spark, docs):
    want = collections.Counter()
    for r in docs.collect():
        spans = pii.base_spans(r.text)
        text = pii.rewrite(r.text, spans)
        want[(r.doc_id, text, r.lang, r.source, len(text) if spans else r.n_chars)] += 1
    assert rows_of(STAGES["personal_data"](spark, docs, SF)) == want


def test_mixing_stage(spark, docs):
    out = STAGES["mixing"](spark, docs, SF).toPandas()
    all_docs = docs.toPandas()
    words = lambda df: df.text.str.count(r"[^\x20\x09-\x0D]+")
    assert words(out).sum() == pytest.approx(1.5 * words(all_docs).sum(), rel=0.02)
    assert out.groupby("doc_id").size().max() <= 2 and set(out.doc_id) <= set(all_docs.doc_id) and list(out.columns) == list(all_docs.columns)


def test_stages_on_awkward_rows(spark, awkward, clashing, nothing, tmp_path):
    labels = spark.createDataFrame([(1, 1, 0), (6, 0, 1), (None, None, 1)], "doc_id long, quality int, toxic int")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    for name, stage in corpus_pipeline.STAGES:
        for df in (awkward, clashing, nothing):
            out = stage(spark, df, str(tmp_path))
            n = out.count()
            if name != "bpe":
                assert out.columns == df.columns
            if name in ("personal_data", "bpe"):
                assert n == df.count()
        if name != "bpe":
            own = {r.score for r in stage(spark, clashing, str(tmp_path)).select("score").collect()}
            assert all(s.startswith("own") for s in own)


def test_run_equals_stages_in_turn(spark):
    out = corpus_pipeline.run(spark, SF)
    assert {"doc_id", "token_ids", "n_tokens"} <= set(out.columns)
    got = out.select("text", "n_tokens", "token_ids").collect()
    assert got and all(r.n_tokens == len(r.token_ids) for r in got) and not any(pii.base_spans(r.text) for r in got)
