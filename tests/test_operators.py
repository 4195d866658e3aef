import hashlib
import re

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from indicraft.operators import aggregates, anomaly, features, joins, model, quality, retrieval, serving, spatial, text
from indicraft.operators.bounds import _at_ranks, percentile_bounds, quantile_table
from indicraft.operators.ranking import rank_columns, rank_levels
from indicraft.operators.windows import lag_features, latest_per_key, rolling_mean, topk_per_group
from indicraft.sources.contracts import CONTRACTS, contract_from_json_schema, validate
from indicraft.sources.readers import read_csv_any_encoding
from indicraft.sources.registry import REGISTRY, clean_source
from indicraft.sources.sinks import upsert_latest


@pytest.mark.parametrize("kind", ["spread", "third_equal", "skewed"])
def test_bracketed_percentiles_equal_numpy(spark, kind):
    rng = np.random.default_rng(5)
    x = rng.normal(size=6000)
    if kind == "third_equal":
        x[:2000] = 0.0
    if kind == "skewed":
        x = np.exp(x * 4)
    df = spark.createDataFrame(pd.DataFrame({"x": x})).repartition(5)
    qs = (0.0, 0.05, 0.333, 0.5, 0.95, 1.0)
    got = {r["q"]: r["value"] for r in quantile_table(df, ["x"], qs, accuracy=200).collect()}
    for q in qs:
        assert got[q] == pytest.approx(np.percentile(x, q * 100), rel=1e-12)


@pytest.mark.parametrize("accuracy", [2, 20, 100_000])
def test_percentiles_of_empty_columns_and_groups_are_null(spark, accuracy):
    df = spark.createDataFrame([(1, None), (2, None)], "a int, b double")
    assert tuple(percentile_bounds(df, ["a", "b"], (0.5,), accuracy=accuracy).first()) == (1.5, None)
    assert tuple(percentile_bounds(df.limit(0), ["a", "b"], (0.5,), accuracy=accuracy).first()) == (None, None)
    rows = [("x", 1.0), ("x", 2.0), ("none", None), ("none", None), (None, 7.0), ("one", 3.0)]
    out = percentile_bounds(spark.createDataFrame(rows, "g string, v double"), ["v"], (0.25, 1.0), ["g"], accuracy=accuracy).collect()
    assert {tuple(r) for r in out} == {("x", 1.25, 2.0), ("none", None, None), (None, 7.0, 7.0), ("one", 3.0, 3.0)}


@pytest.mark.parametrize("n", [1, 2, 3, 5, 10, 37])
def test_percentiles_of_few_rows_equal_numpy(spark, n):
    x = np.random.default_rng(n).integers(0, 6, n) * 1.5
    qs = tuple(k / 20 for k in range(21))
    df = spark.createDataFrame(pd.DataFrame({"x": x}))
    for accuracy in (10, 100_000):
        got = {r["q"]: r["value"] for r in quantile_table(df, ["x"], qs, accuracy=accuracy).collect()}
        assert [got[q] for q in qs] == pytest.approx([np.percentile(x, q * 100) for q in qs])


def test_percentiles_of_all_columns_are_counted_in_one_read(spark, tmp_path):
    rng = np.random.default_rng(8)
    pdf = pd.DataFrame({"g": rng.integers(0, 3, 4000), "a": rng.integers(0, 9, 4000) * 1.0, "b": rng.normal(size=4000)})
    spark.createDataFrame(pdf).repartition(4).write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    plan = _at_ranks(df, ["a", "b"], (0.05, 0.95), [], 100)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1
    for r in percentile_bounds(df, ["a", "b"], (0.05, 0.06, 0.95), ["g"], accuracy=100).collect():
        for c in "ab":
            x = pdf[pdf.g == r["g"]][c]
            assert [r[f"{c}_p5"], r[f"{c}_p6"], r[f"{c}_p95"]] == pytest.approx(list(np.percentile(x, [5, 6, 95])))


@pytest.mark.parametrize("digits", [2, 12])
def test_ranks_equal_windows(spark, digits):
    rng = np.random.default_rng(3)
    n = 3000
    pdf = pd.DataFrame({"id": range(n), "s": np.where(rng.random(n) < 0.33, 50.0, np.round(rng.random(n) * 100, digits)), "g": np.where(rng.random(n) < 0.4, "hot", rng.integers(0, 9, n).astype(str)), "p": rng.integers(0, 50, n) / 1.0})
    df = spark.createDataFrame(pdf).withColumn("p", F.when(F.col("p") > 5, F.col("p")))
    out = rank_columns(rank_levels(df, "s", {"national": [], "group": ["g"]}), {"p": "p_rank"})
    whole, part = W.partitionBy(F.lit(1)), W.partitionBy("g")
    checked = out.select(
        (F.col("national_rank") == F.rank().over(whole.orderBy(F.desc("s")))).alias("a"),
        (F.col("group_rank") == F.rank().over(part.orderBy(F.desc("s")))).alias("b"),
        (F.abs(F.col("group_percentile") - F.percent_rank().over(part.orderBy("s"))) < 1e-12).alias("c"),
        (F.col("p_rank") == F.rank().over(whole.orderBy(F.desc_nulls_last("p")))).alias("d"),
        (F.col("group_total") == F.count("*").over(part)).alias("e"),
    )
    assert checked.filter(~(F.col("a") & F.col("b") & F.col("c") & F.col("d") & F.col("e"))).count() == 0
    assert out.count() == n


def test_single_row_percentile_is_zero(spark):
    out = rank_levels(spark.createDataFrame([(1, 5.0)], "id int, s double"), "s", {"national": []}).first()
    assert (out["national_rank"], out["national_total"], out["national_percentile"]) == (1, 1, 0.0)


def test_lags_need_the_exact_period(spark):
    df = spark.createDataFrame([("a", 2020, 1.0), ("a", 2021, 2.0), ("a", 2023, 4.0)], "k string, y int, v double")
    out = {r["y"]: (r["v_lag1"], r["v_lag2"], r["v_lag3"]) for r in lag_features(df, "k", "y", ["v"]).collect()}
    assert out == {2020: (None, None, None), 2021: (1.0, None, None), 2023: (None, 2.0, 1.0)}
    means = {r["y"]: r["v_mean3"] for r in rolling_mean(df, "k", "y", ["v"]).collect()}
    assert means == {2020: 1.0, 2021: 1.5, 2023: 3.0}


def test_top_rows_are_limited_before_the_shuffle(spark):
    df = spark.range(100).select((F.col("id") % 3).alias("k"), "id")
    plan = topk_per_group(df, "k", [F.desc("id")], 2)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2
    assert latest_per_key(df, "k", ["id"]).count() == 3


def test_one_row_statistics_need_no_join(spark):
    from indicraft.session import attach_stats

    df = spark.range(10)
    plan = attach_stats(df, df.agg(F.avg("id").alias("m")), "s")._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Subquery" in plan


def test_unique_check_raises(spark):
    spine = spark.createDataFrame([(1,)], "k int")
    twice = spark.createDataFrame([(1, "a"), (1, "b")], "k int, v string")
    assert joins.enrich(spine, [(twice, "k")]).count() == 2
    with pytest.raises(Exception, match="duplicate key"):
        joins.enrich(spine, [(twice, "k")], check_unique=True).collect()


def test_upsert_latest(spark):
    old = spark.createDataFrame([(1, 5, "old"), (2, 5, "old")], "k int, t int, v string")
    new = spark.createDataFrame([(1, 4, "late"), (2, 5, "new"), (3, 1, "new")], "k int, t int, v string")
    out = {r["k"]: r["v"] for r in upsert_latest(old, new, ["k"], ["t"]).collect()}
    assert out == {1: "old", 2: "new", 3: "new"}


def _cut_by_places(text, size, overlap, seps):
    """Chunks found by searching start and end places in the running lengths of the pieces."""
    at = next((k for k, sep in enumerate(seps) if not sep or sep in text), len(seps) - 1)
    starts = [0] + [m.start() for m in re.finditer(re.escape(seps[at]), text)] if seps[at] else list(range(len(text)))
    edges = sorted({*starts, len(text)})
    pieces = list(zip(edges, edges[1:]))
    out, run = [], []

    def close():
        first = 0
        while first < len(run):
            ends = [k for k in range(first + 1, len(run) + 1) if k == first + 1 or run[k - 1][1] - run[first][0] <= size]
            last = max(ends)
            out.append(text[run[first][0] : run[last - 1][1]])
            if last == len(run):
                break
            fits = [k for k in range(first, last + 1) if k == last or run[last - 1][1] - run[k][0] <= overlap and run[last][1] - run[k][0] <= size]
            first = min(fits)
        run.clear()

    for a, b in pieces:
        if b - a < size:
            run.append((a, b))
            continue
        close()
        out.extend(_cut_by_places(text[a:b], size, overlap, seps[at + 1 :]) if at + 1 < len(seps) else [text[a:b]])
    close()
    return out


def test_chunks_equal_cuts_by_places(spark, sf_dir):
    rng = np.random.default_rng(8)
    pool = ["alpha ", "be", "gamma. ", "\n", "\n\n", "delta epsilon ", "x" * 17, ". ", "é"]
    for n in range(250):
        content = "".join(rng.choice(pool, size=n))
        size = int(rng.integers(2, 40))
        overlap = int(rng.integers(0, size))
        want = [c.strip() for c in _cut_by_places(content, size, overlap, text.SEPARATORS)]
        assert text.split_text(content, size, overlap) == [c for c in want if c]
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = {}
    for r in text.chunk_text(docs, "doc_id", "text", "source").collect():
        got.setdefault(r.doc_id, []).append((r.chunk_index, r.chunk_text))
    for r in docs.filter("length(text) between 1000 and 12000").collect():
        chunks = [c for c in (x.strip() for x in _cut_by_places(r.text, 2048, 200, text.SEPARATORS)) if c]
        assert sorted(got[r.doc_id]) == [(k, c) for k, c in enumerate(chunks) if len(c) >= 20]


def _places(n, seed):
    rng = np.random.default_rng(seed)
    dense = rng.random(n) < 0.4
    lat = np.where(dense, 40 + rng.normal(0, 0.01, n), rng.uniform(-89, 89, n)).round(3)
    lon = np.where(dense, -73 + rng.normal(0, 0.01, n), rng.uniform(-180, 180, n)).round(3)
    lat[: n // 5], lon[: n // 5] = 12.5, 179.99
    return pd.DataFrame({"id": np.arange(n), "latitude": lat, "longitude": lon})


def _kilometres(left, right):
    p1, p2 = np.radians(left.latitude.values)[:, None], np.radians(right.latitude.values)[None, :]
    dl = np.radians(right.longitude.values[None, :] - left.longitude.values[:, None])
    a = np.sin((p2 - p1) / 2) ** 2 + np.cos(p1) * np.cos(p2) * np.sin(dl / 2) ** 2
    return 2 * 6371 * np.arcsin(np.minimum(1, np.sqrt(a)))


@pytest.mark.parametrize("leaf,per_slice,k", [(32, 65_536, 3), (4, 40, 3), (1, 16, 1), (8, 64, 50)])
def test_nearest_equals_brute_force(spark, leaf, per_slice, k):
    left, right = _places(150, 1), _places(300, 2)
    got = spatial.nearest(
        spark.createDataFrame(left), spark.createDataFrame(right).withColumnRenamed("id", "rid"), "id", "rid", k=k, leaf=leaf, per_slice=per_slice
    ).toPandas()
    want = np.sort(_kilometres(left, right), axis=1)[:, :k]
    have = got.sort_values(["id", "place"]).distance_km.values.reshape(-1, k)
    assert np.allclose(have, want, atol=1e-6)


def test_nearest_when_most_left_rows_need_one_slice(spark):
    """Nine in ten left positions lie in one small cell: its slice goes to several tasks, no row is lost."""
    rng = np.random.default_rng(5)
    left = _places(20_000, 3)
    left.loc[:18_000, "latitude"] = 41 + rng.random(18_001) / 100
    left.loc[:18_000, "longitude"] = -87 + rng.random(18_001) / 100
    right = _places(400, 4)
    got = spatial.nearest(spark.createDataFrame(left), spark.createDataFrame(right).withColumnRenamed("id", "rid"), "id", "rid", leaf=8, per_slice=64).toPandas()
    assert np.allclose(got.sort_values("id").distance_km.values, _kilometres(left, right).min(axis=1), atol=1e-6)


def test_nearest_radius_ties_and_rows_without_position(spark):
    """Equal distances go to the smaller key, the date line and a pole part nothing, a radius leaves rows out."""
    sites = spark.createDataFrame(
        [(9, 0.0, 20.5), (4, 0.0, 19.5), (5, 90.0, 10.0), (3, 85.0, -170.0), (6, -5.0, 179.5), (8, None, 1.0), (2, 95.0, 0.0)], "rid int, latitude double, longitude double"
    )
    left = spark.createDataFrame([(1, 0.0, 20.0), (2, 89.9, 50.0), (3, 45.0, 0.0), (4, float("nan"), 0.0), (5, -5.0, -179.5)], "id int, latitude double, longitude double")
    for per_slice in (16, 65_536):
        got = spatial.nearest(left, sites, "id", "rid", k=2, max_km=200, leaf=1, per_slice=per_slice).collect()
        assert sorted((r["id"], r["place"], r["rid"]) for r in got) == [(1, 1, 4), (1, 2, 9), (2, 1, 5), (5, 1, 6)]


def test_nearest_of_few_or_no_points(spark):
    one = spark.createDataFrame([(7, 10.0, 10.0)], "rid int, latitude double, longitude double")
    left = spark.createDataFrame([(1, 0.0, 0.0), (2, None, 3.0)], "id int, latitude double, longitude double")
    assert [(r["id"], r["rid"]) for r in spatial.nearest(left, one, "id", "rid", k=3).collect()] == [(1, 7)]
    assert spatial.nearest(left, one.limit(0), "id", "rid").count() == 0


def test_kept_forest_scores_rows_as_a_plain_walk(spark):
    rng = np.random.default_rng(3)
    rows = [(i, float(a), float(b)) for i, (a, b) in enumerate(rng.normal(size=(700, 2)))] + [(700, 40.0, -40.0)]
    df = spark.createDataFrame(rows, "id int, a double, b double")
    nodes = anomaly.grow_forest(df, "id", ["a", "b"], 12, 64, 701)
    got = {r["id"]: r["forest_score"] for r in anomaly.forest_scores(df, ["a", "b"], nodes, 64).collect()}
    trees = [{n.node: n for n in t.itertuples()} for _, t in nodes.groupby("tree")]
    assert len(trees) == 12 and len(nodes) <= 12 * 128
    usual = anomaly._path_norm(64)
    for key, *x in rows[::50] + rows[-1:]:
        depth = 0.0
        for tree in trees:
            at = tree[0]
            while at.feature >= 0:
                at = tree[at.left_node if x[at.feature] <= at.cut else at.right_node]
            depth += at.depth
        assert got[key] == pytest.approx(-(2 ** (-depth / 12 / usual)))
    assert min(got, key=got.get) == 700


def test_cosine_topk_equals_brute_force_with_copies(spark):
    rng = np.random.default_rng(0)
    v = rng.normal(size=(400, 8)).astype("float32")
    v[100:250] = v[100]
    corpus = spark.createDataFrame([(i, [float(x) for x in row]) for i, row in enumerate(v)], "id long, embedding array<float>").repartition(4)
    queries = spark.createDataFrame([(0, [float(x) for x in v[100]]), (1, [float(x) for x in v[3]])], "q int, embedding array<float>")
    out = retrieval.cosine_topk(queries, corpus, "q", "id", k=3, threshold=0.2).toPandas()
    unit = v.astype("float64") / np.linalg.norm(v.astype("float64"), axis=1, keepdims=True)
    for q, row in ((0, 100), (1, 3)):
        s = (unit @ unit[row]).round(9)
        order = [i for i in np.lexsort((np.arange(400), -s)) if s[i] >= 0.2][:12]
        mine = out[out.q == q].sort_values("place")
        assert mine.id.tolist() == order if q == 1 else set(mine.score.round(6)) == {1.0}
        assert len(mine) == len(order)


def test_any_number_of_queries_is_answered(spark):
    df = spark.range(10_001).select(F.col("id").alias("q"), F.array(F.lit(1.0), F.col("id").cast("double")).alias("embedding"))
    corpus = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [1.0, 1.0])], "id long, embedding array<double>")
    out = retrieval.cosine_topk(df, corpus, "q", "id", k=1, multiplier=1, threshold=-1).toPandas()
    assert len(out) == 10_001 == out.q.nunique()
    assert set(out[out.q > 3].id) == {2} and out.set_index("q").id[0] == 1
    small = retrieval.cosine_topk(df.filter("q < 40"), corpus, "q", "id", k=1, multiplier=1, threshold=-1, block=7).toPandas()
    assert small.sort_values("q").id.tolist() == out[out.q < 40].sort_values("q").id.tolist()


def test_diversity_boost(spark):
    hits = spark.createDataFrame([(1, "a", 1, 0.9), (1, "a", 2, 0.8), (1, "b", 3, 0.79)], "q int, source string, id int, score double")
    out = retrieval.diversity_rerank(hits, "q", "source", "id").orderBy("place").collect()
    assert [r["id"] for r in out] == [1, 3, 2] and out[1]["score"] == pytest.approx(0.8295)


def test_split_text_keeps_everything_and_respects_sizes():
    para = "Alpha beta gamma. " * 30
    body = "\n\n".join([para] * 6) + "\n\n" + "x" * 5000
    chunks = text.split_text(body, 400, 50)
    assert max(map(len, chunks)) <= 400
    assert sum(c.count("x") for c in chunks) >= 5000
    assert "".join(chunks[0].split()) == "".join(body.split())[: len("".join(chunks[0].split()))]
    assert text.split_text("short text", 400, 50) == ["short text"]
    assert text.split_text("aaa bbb ccc ddd", 8, 4) == ["aaa bbb", "bbb ccc", "ccc ddd"]


def test_chunk_windows_cover_the_text(spark):
    body = "".join(chr(97 + i % 26) for i in range(5000))
    df = spark.createDataFrame([(1, body), (2, ""), (3, "tiny")], "id int, t string")
    out = text.chunk_windows(df, "id", "t", 1000, 100, 20).orderBy("chunk_index").collect()
    rebuilt = out[0]["chunk_text"] + "".join(r["chunk_text"][100:] for r in out[1:])
    assert rebuilt == body and {r["id"] for r in out} == {1}


def test_isolation_forest_finds_planted_outliers(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(50, 5, size=(600, 2))
    x[:12] = rng.choice([5.0, 95.0], size=(12, 2))
    df = spark.createDataFrame(pd.DataFrame({"id": range(600), "a": x[:, 0], "b": x[:, 1]}))
    flagged = anomaly.isolation_forest(df, "id", ["a", "b"], trees=60).toPandas()
    assert set(range(12)) <= set(flagged.id)
    assert 20 <= len(flagged) <= 30 and (flagged.iforest_score < 0).all()
    again = anomaly.isolation_forest(df.repartition(7), "id", ["a", "b"], trees=60).toPandas()
    assert sorted(again.id) == sorted(flagged.id)
    with pytest.raises(ValueError):
        anomaly.isolation_forest(df.limit(10), "id", ["a", "b"], minimum_rows=50)


def test_zscore_flags_need_enough_rows(spark):
    df = spark.createDataFrame([(i, 0.0 if i else 100.0, 1.0) for i in range(40)], "id int, a double, b double")
    hit = anomaly.zscore_flags(df, "id", ["a", "b"]).collect()
    assert [(r["id"], r["zscore_trigger_col"]) for r in hit] == [(0, "a")]
    with pytest.raises(Exception, match="at least 30 needed"):
        anomaly.zscore_flags(df.filter("id < 20"), "id", ["a", "b"], minimum_rows=30).count()


def test_merge_flags_severity(spark):
    f = spark.createDataFrame([(1, -0.2), (2, -0.1)], "id int, iforest_score double")
    z = spark.createDataFrame([(2, 3.0), (3, -4.0)], "id int, zscore_worst double")
    out = {r["id"]: (r["detection_method"], r["severity"]) for r in anomaly.merge_flags(f, z, "id").collect()}
    assert out == {1: ("isolation_forest", "isolation_forest"), 2: ("isolation_forest", "both_methods"), 3: ("zscore", "zscore")}
    assert {r["severity"] for r in anomaly.merge_flags(f.limit(0), z, "id").collect()} == {"zscore_only"}
    assert {r["severity"] for r in anomaly.merge_flags(f, z.limit(0), "id").collect()} == {"iforest_only"}


def test_narrative(spark):
    df = spark.createDataFrame([("S", 95.0, 12.0, -6.0, 2.0), ("T", 50.0, 50.0, None, None)], "name string, a_score double, b_score double, m double, absenteeism double")
    out = [r["narrative"] for r in anomaly.narrate(df, "name", ["a_score", "b_score"], {"m": "math", "absenteeism": "chronic absenteeism"}).collect()]
    assert out[0] == "S: Large pillar gap — A (95) vs B (12), a 83-point spread. Math decreased by 6.0 points YoY."
    assert out[1] == "T: Unusual score profile detected."


def test_imputation_order(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("a", None), ("b", None)], "s string, v double")
    out = sorted((r["s"], r["v"]) for r in features.impute_grouped_median(df, "s", ["v"]).collect())
    assert out == [("a", 1.0), ("a", 2.0), ("a", 3.0), ("b", 2.0)]


def test_low_coverage_columns_go(spark):
    df = spark.createDataFrame([(i, None if i else 1.0, 2.0, None) for i in range(10)], "id int, rare double, full double, kept double")
    assert features.drop_low_coverage(df, 0.3, ["id", "kept"]).columns == ["id", "full", "kept"]


def test_temporal_split_sizes(spark):
    for n in (100, 101, 102, 103):
        train, test = model.temporal_split(spark.range(n).withColumnRenamed("id", "t"), "t")
        assert (train.count(), test.count()) == (int(n * 0.75), n - int(n * 0.75))


@pytest.mark.parametrize("years", [1, 2])
def test_splits_and_folds_of_few_periods(spark, years):
    df = spark.range(100).select("id", (F.col("id") % years).alias("year"))
    train, test = model.temporal_split(df, "year", ties=["id"])
    want = [r["id"] for r in df.orderBy("year", "id").collect()]
    assert {r["id"] for r in train.collect()} == set(want[:75]) and {r["id"] for r in test.collect()} == set(want[75:])
    folds = model.expanding_folds(df, "year", 4, ["id"])
    assert [({r["id"] for r in a.collect()}, {r["id"] for r in b.collect()}) for a, b in folds] == [
        (set(want[: 20 * k]), set(want[20 * k : 20 * k + 20])) for k in range(1, 5)
    ]


def test_folds_expand(spark):
    folds = model.expanding_folds(spark.range(100).withColumnRenamed("id", "t"), "t", 4)
    assert [(a.count(), b.count()) for a, b in folds] == [(20, 20), (40, 20), (60, 20), (80, 20)]


def test_boosted_trees_learn_and_predict(spark):
    df = spark.range(400).select("id", (F.col("id") % 20).cast("double").alias("x"), (F.col("id") % 20 * 3.0 + 1).alias("y"))
    trained = model.train_gbt(df, ["x", "absent"], "y", "id", {"maxIter": 5, "maxDepth": 4, "stepSize": 0.5}, {"maxDepth": [1, 4]}, folds=2, tune_folds=2)
    assert trained.params["maxDepth"] == 4 and len(trained.cv_mae) == 2
    assert list(trained.importances())[0] == "x"
    out = model.predict(trained, df, "id", ["y"])
    assert model.regression_metrics(out, "y", "predicted_change").first()["r2"] > 0.9
    with pytest.raises(ValueError):
        model.train_gbt(df.limit(10), ["x"], "y", params={"maxIter": 1})


def test_sampled_interval_is_near_the_closed_form(spark):
    df = spark.createDataFrame([(i, 10.0) for i in range(50)], "id int, p double")
    a = model.with_interval(df, "p", 4.0).agg(F.avg("ci_lower").alias("l"), F.avg("ci_upper").alias("u")).first()
    b = model.with_sampled_interval(df, "p", 4.0).agg(F.avg("ci_lower").alias("l"), F.avg("ci_upper").alias("u")).first()
    assert a["l"] == pytest.approx(b["l"], abs=0.3) and a["u"] == pytest.approx(b["u"], abs=0.3)


def test_run_checks_on_an_empty_table(spark):
    df = spark.createDataFrame([], "a int")
    out = quality.run_checks(df, [quality.Check("row_count", fail=("<", 1)), quality.Check("missing_percent", "a", fail=(">", 0))]).collect()
    assert [r["status"] for r in out] == ["fail", "pass"]


def test_suspicious_sample_quota(spark):
    df = spark.range(500).select("id", (F.col("id") % 100).cast("double").alias("score"))
    out = quality.sample_suspicious(df, "id", 30, "score").collect()
    kinds = [r["stratum"] for r in out]
    assert kinds.count("extreme") == 10 and len({r["id"] for r in out}) == len(out) == 30


@pytest.mark.parametrize("rows,n", [(40, 10), (40, 30), (40, 36), (40, 40), (40, 50), (1000, 100)])
def test_suspicious_sample_is_filled(spark, rows, n):
    df = spark.range(rows).select("id", (F.col("id") * 7 % 100).cast("double").alias("score"), (F.col("id") % 60).cast("double").alias("change"), F.lit(50.0).alias("p"))
    out = quality.sample_suspicious(df, "id", n, "score", ["change"], ["p"]).collect()
    kinds = [r["stratum"] for r in out]
    assert len({r["id"] for r in out}) == len(out) == min(n, rows)
    assert kinds.count("extreme") <= n // 3 and kinds.count("large_change") <= n // 3 and kinds.count("inconsistent") <= n // 4


def test_suspicious_sample_reads_its_rows_once_for_all_strata(spark, tmp_path):
    pdf = pd.DataFrame({"id": range(500), "score": [i * 7 % 100 * 1.0 for i in range(500)], "change": [i % 60 - 20.0 for i in range(500)], "p": 55.0})
    spark.createDataFrame(pdf).write.parquet(str(tmp_path / "t"))
    out = quality.sample_suspicious(spark.read.parquet(str(tmp_path / "t")), "id", 40, "score", ["change"], ["p"])
    # the rows once for the fill, the stored picks twice
    assert out._jdf.queryExecution().executedPlan().toString().count("FileScan") <= 3
    draw = lambda i, seed: hashlib.md5(f"{i}#{seed}".encode()).hexdigest()
    far = {"extreme": ((pdf.score < 10) | (pdf.score > 98), 13), "large_change": (pdf.change.abs() > 25, 13), "inconsistent": ((pdf.score - pdf.p).abs() > 20, 10)}
    want = {}
    for name, (hit, quota) in far.items():
        for i in sorted(pdf.id[hit], key=lambda i: draw(i, 42))[:quota]:
            want.setdefault(i, name)
    rest = sorted(set(pdf.id) - set(want), key=lambda i: draw(i, 43))
    want |= dict.fromkeys(rest[: 40 - len(want)], "random")
    assert {r["id"]: r["stratum"] for r in out.collect()} == want


def test_mode_of_any_type(spark):
    df = spark.createDataFrame([("b", 2**60), ("a", 2**60 + 1), ("b", 2**60 + 1), ("a", 5), (None, None)], "t string, n long")
    assert tuple(aggregates.mode_share(df, "t").first()) == ("a", 2, 50.0)
    assert tuple(aggregates.mode_share(df, "n").first()) == (2**60 + 1, 2, 50.0)


def test_charset_is_decided_per_file(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes("k,name\n1,Ñu\n".encode())
    (tmp_path / "b.csv").write_bytes("k,name\n2,Ñu\n".encode("iso-8859-1"))
    assert {tuple(r) for r in read_csv_any_encoding(spark, str(tmp_path), "k int, name string").collect()} == {(1, "Ñu"), (2, "Ñu")}


def test_contract_split(spark):
    contract = contract_from_json_schema("t", {"required": ["a"], "properties": {"a": {"type": "string", "pattern": "^x"}, "n": {"type": ["integer", "null"], "minimum": 0}}})
    df = spark.createDataFrame([("x1", "5"), ("y", "5"), (None, "5"), ("x", "-1"), ("x", "abc"), ("x", None)], "a string, n string")
    good, bad, summary = validate(df, contract)
    assert [r["a"] for r in good.collect()] == ["x1", "x"]
    assert sorted(tuple(r["violations"]) for r in bad.collect()) == [("a:pattern",), ("a:required",), ("n:minimum",), ("n:type",)]
    assert tuple(summary.first())[1:] == (6, 4, 66.7)


def test_every_source_has_a_contract():
    assert set(REGISTRY) == set(CONTRACTS) and len(REGISTRY) == 12


def test_first_alias_wins(spark):
    df = spark.createDataFrame([("1", "A", "B", "2")], "NCESSCH string, SCH_NAME string, SCHNAM string, SCH_TYPE string")
    out = clean_source(df, REGISTRY["nces_ccd"]).first()
    assert (out["ncessch"], out["school_name"], out["school_type"]) == ("000000000001", "A", 2)


def test_keyset_pages_equal_offset_pages(spark):
    df = spark.range(100).select("id", (F.col("id") % 7).cast("double").alias("s"))
    order = [F.col("s"), F.col("id")]
    want = [tuple(r) for r in serving.page(df, order, 3, 10)[0].collect()]
    last = serving.page(df, order, 2, 10)[0].collect()[-1]
    assert [tuple(r) for r in serving.page_after(df, "s", "id", (last["s"], last["id"]), 10).collect()] == want
    assert tuple(serving.page(df, order, 1, 30)[1].first()) == (100, 4)


def test_sort_key_and_compare_limits(spark):
    with pytest.raises(ValueError):
        serving.sort_key("x; drop", ["score"])
    with pytest.raises(ValueError):
        serving.compare(spark.range(1), "id", range(6), limit=5)
    assert serving.compare(spark.range(20), "id", range(9)).count() == 9


def test_chunks_leave_a_task_in_bounded_batches():
    import pyarrow as pa

    texts = ["word " * 8_000, None, "", "x" * 30_000, *["some words. " * 3_000] * 40]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(["s"] * len(texts)), pa.array(["h"] * len(texts)), pa.array(texts, pa.string())], names=["k", "s", "h", "t"])
    out = list(text.chunk_batches(iter([batch, batch.slice(0, 0)]), 2048, 200, 20, most_chars=100_000))
    assert len(out) > 10 and max(sum(map(len, b.column("c").to_pylist())) for b in out) < 150_000
    got = [(r["k"], r["i"], r["c"]) for b in out for r in b.to_pylist()]
    assert got == [(k, i, c) for k, t in enumerate(texts) if t for i, c in enumerate(text.split_text(t)) if len(c) >= 20]
