import pytest
from pyspark.sql import functions as F

from indicraft.functions import scoring as sc
from indicraft.functions.cleaning import round_half_up
from indicraft.operators.gaps import gap_table
from indicraft.operators.rollup import score_summary
from indicraft.operators.scoring import Metric, ScoreSpec, score_table
from indicraft.operators.trends import change_zscore, trend_table


@pytest.mark.parametrize(
    "value,invert,want",
    [
        (None, False, None), (10.0, False, 0.0), (90.0, False, 100.0), (50.0, False, 50.0), (5.0, False, 0.0),
        (95.0, False, 100.0), (25.0, False, 18.75), (75.0, False, 81.25), (10.0, True, 100.0), (90.0, True, 0.0), (50.0, True, 50.0),
    ],
)
def test_normalize(column, value, invert, want):
    assert column([(value,)], "x double", sc.normalize_metric("x", F.lit(10.0), F.lit(90.0), invert)) == [want]


def test_normalize_flat_bounds(column):
    fifty = F.lit(50.0)
    assert column([(50.0,)], "x double", sc.normalize_metric("x", fifty, fifty)) == [0.0]
    assert column([(50.0,)], "x double", sc.normalize_metric("x", fifty, fifty, invert=True)) == [100.0]
    assert column([(50.0,)], "x double", sc.normalize_metric("x", fifty, fifty, degenerate=50)) == [50.0]
    assert column([(999.0,), (-50.0,)], "x double", sc.normalize_metric("x", F.lit(0.0), F.lit(100.0))) == [100.0, 0.0]


@pytest.mark.parametrize(
    "parts,want",
    [
        ([(80.0, 0.3), (60.0, 0.3), (70.0, 0.2), (90.0, 0.2)], 74.0),
        ([(80.0, 0.5), (None, 0.3), (60.0, 0.2)], 74.29),
        ([(None, 0.5), (None, 0.5)], None),
        ([(75.0, 1.0)], 75.0),
        ([(0.0, 0.5), (0.0, 0.5)], 0.0),
        ([(70.0, 0.3), (None, 0.3), (80.0, 0.2), (50.0, 0.2)], 67.14),
        ([(None, 0.3), (55.0, 0.3), (None, 0.2), (None, 0.2)], 55.0),
        ([(80.0, 0.4), (60.0, 0.2), (70.0, 0.2), (90.0, 0.2)], 76.0),
    ],
)
def test_weighted_score(column, parts, want):
    expr = sc.weighted_score([(F.lit(v).cast("double"), w) for v, w in parts])
    assert column([(1,)], "x int", expr) == [want]


def test_equal_weights_are_the_plain_mean(column):
    rows = [(10.0, 20.0, None), (1.0, 2.0, 6.0), (None, None, 5.0)]
    got = column(rows, "a double, b double, c double", sc.weighted_score([("a", 1), ("b", 1), ("c", 1)]))
    assert got == [15.0, 3.0, 5.0]


def test_categories(column):
    rows = [(v,) for v in (0.0, 15.0, 25.0, 25.5, 26.0, 50.0, 51.0, 75.0, 76.0, 100.0, None)]
    want = ["Critical"] * 4 + ["At Risk"] * 2 + ["Moderate"] * 2 + ["Thriving"] * 2 + ["Insufficient Data"]
    assert column(rows, "x double", sc.score_category("x")) == want
    bands = column([(25.0,), (25.5,), (50.0,), (75.0,), (75.1,), (None,)], "x double", sc.score_band("x"))
    assert bands == ["Critical", "At Risk", "At Risk", "Moderate", "Thriving", None]


def test_null_rules_of_sub_scores(column):
    flags = [(True,), (False,), (None,)]
    assert column(flags, "x boolean", sc.penalty_score("x")) == [0.0, 100.0, 100.0]
    assert column([(3.0,), (30.0,), (None,)], "x double", sc.linear_score("x", 4)) == [88.0, 0.0, None]


def test_rounding_is_half_up_in_decimal(column):
    assert column([(1.005,), (2.675,), (-1.005,), (None,)], "x double", round_half_up("x", 2)) == [1.01, 2.68, -1.01, None]


def test_extremes_and_ties(column):
    rows = [(50.0, 50.0, None), (None, 3.0, 3.0), (9.0, 1.0, 100.0), (None, None, None)]
    labels = {"A": "a", "B": "b", "C": "c"}
    schema = "a double, b double, c double"
    assert column(rows, schema, sc.argmin_label(labels, 999)) == ["A", "B", "B", "A"]
    assert column(rows, schema, sc.argmax_label(labels, 0)) == ["A", "B", "C", "A"]
    assert column(rows, schema, sc.spread(["a", "b", "c"])) == [0.0, 0.0, 99.0, -100.0]


def test_direction(column):
    rows = [(2.1,), (2.0,), (-2.1,), (None,)]
    assert column(rows, "x double", sc.direction("x", 2)) == ["Improving", "Stable", "Declining", "Stable"]
    assert column(rows, "x double", sc.direction("x", 2, invert=True)) == ["Declining", "Stable", "Improving", "Stable"]


def test_low_confidence(column):
    rows = [(None, 90.0), (5.0, 59.0), (5.0, None), (5.0, 60.0)]
    assert column(rows, "r double, c double", sc.low_confidence("r", "c")) == [True, True, False, False]


def test_score_table_stays_in_range_and_drops_rows_without_data(spark):
    rows = [(i, float(i), None if i % 3 else float(i * 7 % 50)) for i in range(200)] + [(999, None, None)]
    df = spark.createDataFrame(rows, "id int, a double, b double")
    spec = ScoreSpec(
        metrics=(Metric("sa", "a"), Metric("sb", "b", invert=True)),
        pillars={"pa": [("sa", 1.0)], "pb": [("sb", 1.0)]},
        weights={"pa": 0.5, "pb": 0.5},
    )
    out = score_table(df, spec).collect()
    assert len(out) == 200
    assert all(0 <= r["composite_score"] <= 100 for r in out)
    assert {r["pillars_with_data"] for r in out} == {1, 2}


def _pillars(spark, rows):
    return spark.createDataFrame(rows, "id int, e double, h double, n double, s double")


def test_gap_rules(spark):
    rows = [(i, float(i), 50.0 + i % 5, 60.0, None) for i in range(1, 101)]
    out = {r["id"]: r for r in gap_table(_pillars(spark, rows), {"Education": "e", "Health": "h", "Environment": "n", "Safety": "s"}, only_gaps=False).collect()}
    assert out[1]["has_education_gap"] is True and out[100]["has_education_gap"] is False
    assert out[1]["has_safety_gap"] is None
    assert out[1]["weakest_pillar"] == "Education"
    assert out[1]["intervention_priority"] == "High Priority"
    assert out[52]["gap_count"] == 0 and out[52]["intervention_priority"] == "No Gaps Identified"


def test_gap_policy_severity(spark):
    rows = [(1, 1.0, 1.0, 1.0, 90.0), (2, 1.0, 1.0, 90.0, 90.0), (3, 1.0, 90.0, 90.0, 90.0), (4, 89.0, 90.0, 90.0, 90.0)]
    rows += [(i, 90.0, 90.0, 90.0, 90.0) for i in range(5, 60)]
    labels = {"Education": "e", "Health": "h", "Environment": "n", "Safety": "s"}
    out = {r["id"]: r["intervention_priority"] for r in gap_table(_pillars(spark, rows), labels, "severity").collect()}
    assert out == {1: "Critical Need", 2: "High Priority", 3: "High Priority", 4: "Moderate Need"}


def test_zscore_without_spread(spark):
    df = spark.createDataFrame([(i, 4.0) for i in range(5)], "id int, c double")
    out = change_zscore(df, "c", "z", "flag").collect()
    assert {(r["z"], r["flag"]) for r in out} == {(0.0, False)}


def test_trend_table(spark):
    df = spark.createDataFrame([(1, 3.0, 2.0), (2, None, None), (3, -5.0, 0.5)], "id int, m double, r double")
    out = {r["id"]: r for r in trend_table(df, {"mt": ("m", False)}, ["m", "r"]).collect()}
    assert (out[1]["mt"], out[1]["education_trend"]) == ("Improving", "Improving")
    assert (out[2]["mt"], out[2]["combined_education_change"]) == ("Stable", 0.0)
    assert out[3]["education_trend"] == "Declining"


def test_category_counts_add_up(spark):
    rows = [("c1", float(i), c) for i, c in enumerate(["Thriving", "Moderate", "At Risk", "Critical", "Critical"])]
    df = spark.createDataFrame(rows, "area string, s double, cat string")
    r = score_summary(df, "area", "s", "cat", []).first()
    assert r["thriving_count"] + r["moderate_count"] + r["at_risk_count"] + r["critical_count"] == r["scored_school_count"] == 5
