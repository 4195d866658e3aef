"""The posting tables against plain scans."""

import random

import pytest
from pyspark.sql import functions as F

from indicraft.functions.predicates import matches_any
from indicraft.operators.text_index import TextIndex, needle_grams, text_grams

ROWS = [
    (1, "Lincoln High", "Cook"), (2, "LINCOLN middle", None), (3, None, None), (4, "", ""), (5, "a", "b"), (6, "100% ready_now", "x\\y"), (7, "Straße", "ΣΊΣΥΦΟΣ"),
    (8, "日本語学校", "東京都"), (9, "smile 🙂🙃 now", "🙂"), (None, "no key Lincoln", "c"), (10, "aaaaaa", "aaa"), (10, "aaaaaa", "aaa"), (11, "line\nbreak", "tab\there"),
]
NEEDLES = [
    "lincoln", "LINC", "a", "aa", "aaaa", "aaaaaaa", "%", "_", "100%", "\\", "x\\y", "straße", "STRASSE", "Σ", "σ", "ίσ", "日本", "学校", "🙂", "🙂🙃", "🙃 n", "zzz", "k", "ok", "\n", "e\nb", "lincoln high school", " ", "",
]
SCHEMA = "id long, name string, area string"


@pytest.fixture(scope="module")
def index(spark, tmp_path_factory):
    out = TextIndex(spark, str(tmp_path_factory.mktemp("index") / "t"), "id", ["name", "area"], buckets=8, file_rows=4)
    rows = spark.createDataFrame(ROWS, SCHEMA)
    assert out.segments() == [] and out.find("x").count() == 0
    out.add(rows.filter("id < 6 or id is null"))
    out.add(rows.filter("id >= 6"))
    return out


def keys(df):
    return sorted((r["id"] is None, r["id"] or 0) for r in df.collect())


def test_single_needles_equal_a_scan(spark, index):
    rows = spark.createDataFrame(ROWS, SCHEMA)
    for needle in NEEDLES[:12] + NEEDLES[-6:]:
        assert keys(index.find(needle)) == keys(rows.filter(matches_any(needle, ["name", "area"]))), needle
    assert index.find(None).count() == 0


def test_many_needles_equal_a_scan(spark, index):
    rows = spark.createDataFrame(ROWS, SCHEMA)
    rng = random.Random(5)
    texts = [t for r in ROWS for t in r[1:] if t]
    drawn = []
    for _ in range(60):
        t = rng.choice(texts)
        a = rng.randrange(len(t))
        drawn.append(t[a : a + rng.randint(1, 30)].swapcase())
    asked = [*NEEDLES, *drawn, *drawn[:5], None]
    found = index.find_all(spark.createDataFrame([(n,) for n in asked], "needle string")).collect()
    texts = spark.createDataFrame([(n,) for n in {n for n in asked if n is not None}], "needle string")
    holds = F.lower("name").contains(F.lower("needle")) | F.lower("area").contains(F.lower("needle"))
    want = texts.join(rows, holds).collect()
    order = lambda rs: sorted((r["needle"], r["id"] is None, r["id"] or 0, r["name"] or "") for r in rs)
    assert order(found) == order(want)


def test_searches_prune_folders(index):
    plan = index.candidates("lincoln")._jdf.queryExecution().toString()
    assert "gram_bucket" in plan.split("PartitionFilters: [")[1].split("]")[0] and "In(gram" in plan
    assert index.candidates("lincolnx") is None


def test_grams(column):
    assert sorted(column([("AbCd",)], "t string", text_grams(F.col("t")))[0]) == ["a", "ab", "abc", "b", "bc", "bcd", "c", "cd", "d"]
    got = column([("abab",), ("ab",), ("🙂🙃x",)], "t string", needle_grams(F.col("t")))
    assert [sorted(g) for g in got] == [["aba", "bab"], ["ab"], ["🙂🙃x"]]
    assert column([("",), (None,)], "t string", text_grams(F.col("t"))) == [[], []]


def test_needles_of_numbers_have_few_candidates(spark, tmp_path):
    """Numbered names share all their short runs; six characters tell them apart."""
    index = TextIndex(spark, str(tmp_path / "t"), "id", ["name"], buckets=4)
    index.add(spark.range(3_000).selectExpr("id", "concat('Customer#', lpad(id, 9, '0')) as name"))
    needles = spark.range(200).selectExpr("concat('#', lpad(id * 14 + 100, 9, '0')) as needle")
    found = index.find_all(needles)
    assert sorted(r["id"] for r in found.collect()) == [k * 14 + 100 for k in range(200)]
    asked = needles.select("needle", F.explode(needle_grams(F.col("needle"))).alias("gram"))
    rarest = asked.join(index.table("counts"), "gram").groupBy("needle").agg(F.min("n").alias("n")).agg(F.sum("n")).first()[0]
    assert rarest < 200 * 20
    long = "abcdefghijklmnopqrstuvwxyz"
    assert sorted(spark.range(1).select(needle_grams(F.lit(long)).alias("g")).first()["g"]) == [long[k : k + 12] for k in range(15)]
