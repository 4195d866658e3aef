"""Inverted-file index against the exact search."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from indicraft.operators import retrieval, vector_index as vi


@pytest.fixture(scope="module")
def world(spark, tmp_path_factory):
    rng = np.random.default_rng(11)
    middles = rng.normal(size=(24, 16))
    rows = [(k, (middles[k % 24] + rng.normal(size=16) * 0.35).tolist()) for k in range(3_000)]
    rows += [(10_000 + k, rows[5][1]) for k in range(900)]  # a crowd of copies
    odd = [None, [0.0] * 16, [float("nan")] * 16, [None, *[1.0] * 15]]
    docs = spark.createDataFrame(rows + [(20_000 + k, v) for k, v in enumerate(odd)], "id long, embedding array<double>")
    index = vi.write_index(docs, str(tmp_path_factory.mktemp("index") / "ivf"), "id", lists=24, file_rows=300)
    queries = spark.createDataFrame([(f"q{k}", (middles[k % 24] + rng.normal(size=16) * 0.4).tolist()) for k in range(40)] + [("zero", [0.0] * 16), ("none", None)], "q string, embedding array<double>")
    return docs.filter("id < 20000"), index, queries


def hits(df):
    return {(r["q"], r["place"]): (r["id"], round(r["score"], 9)) for r in df.collect()}


def test_every_row_is_indexed_and_crowded_lists_are_cut(world):
    docs, index, _ = world
    stored = index.vectors()
    assert stored.count() == docs.count() + 4 and stored.filter("list = -1").count() == 4
    assert index.sizes.sum() == docs.count()
    files = stored.groupBy(F.col("list"), F.input_file_name()).count()
    assert files.groupBy("list").count().agg(F.max("count")).first()[0] >= 3


def test_exact_search_equals_reading_everything(world):
    docs, index, queries = world
    want = hits(retrieval.cosine_topk(queries.filter("q like 'q%'"), docs, "q", "id", k=5))
    got = hits(vi.search(index, queries, "q", "id", k=20, probes=1, exact=True))
    assert got == want and len(want) == 800


def test_few_lists_find_most_and_read_little(world, spark):
    docs, index, queries = world
    truth = retrieval.cosine_topk(queries.filter("q like 'q%'"), docs, "q", "id", k=5)
    found = vi.search(index, queries, "q", "id", k=20, probes=3, block=15)
    assert spark.range(1).select(vi.recall(found, truth, "q", "id")).first()[0] >= 0.9
    one = queries.limit(1).collect()[0]["embedding"]
    asked = vi.probed(index, np.array([one]) / np.linalg.norm(one), 3)
    assert 0 < vi.rows_read(index, asked) < docs.count() / 2
    plan = index.reading(np.flatnonzero(asked[0]).tolist())._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [list" in plan


def test_empty_index_and_no_queries(spark, tmp_path, world):
    docs, index, queries = world
    empty = vi.write_index(docs.limit(0), str(tmp_path / "none"), "id")
    assert vi.search(empty, queries, "q", "id").count() == 0
    assert vi.search(index, queries.limit(0), "q", "id", exact=True).count() == 0
