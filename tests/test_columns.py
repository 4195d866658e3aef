import datetime

import pytest
from pyspark.sql import functions as F

from indicraft.functions import cleaning as c
from indicraft.functions import codes, geo, text
from indicraft.functions.predicates import build_filters, lacks_text, matches_any, null_or_at_least


def test_codes(column):
    assert column([("17",), ("17031",), ("17031842100",), ("",), ("1",), ("abcde",), ("123456789012",), (" 17 ",)], "x string", codes.is_valid_code("x")) == [True, True, True, False, False, False, False, True]
    assert column([(9,), (123456,)], "x int", codes.pad_code("x", 5)) == ["00009", "12345"]
    assert column([(9,), (123456,)], "x int", codes.pad_code("x", 5, truncate=False)) == ["00009", "123456"]
    assert column([("1001020100",), ("17031842100",)], "x string", codes.tract_to_county("x")) == ["01001", "17031"]
    assert column([(17, 31, 842100)], "s int, c int, t int", codes.format_code("s", "c", "t")) == ["17031842100"]


@pytest.mark.parametrize(
    "code,want",
    [
        ("17031842100", ("17", "031", "842100", None)), ("17031", ("17", "031", None, None)), (" 17 ", ("17", None, None, None)), ("1703", ("17", None, None, "03")),
    ],
)
def test_parse_code(column, code, want):
    assert tuple(column([(code,)], "x string", codes.parse_code("x"))[0]) == want


def test_float_codes(column):
    assert column([("1.7031842100e10",), ("1001020100.0",)], "x string", codes.whole_number_code("x", 11)) == ["17031842100", "01001020100"]


def test_cleaning(column):
    assert column([("Cook County   ",), ("",), ("N/A",), (None,)], "x string", c.blank_to_null("x", "N/A")) == ["Cook County", None, None, None]
    assert column([(-666666666,), (0,), (5,), (None,)], "x int", c.null_sentinels("x", (-666666666, 0))) == [None, None, 5, None]
    assert column([(-1,), (0,), (None,)], "x int", c.null_sentinels("x", negative=True)) == [None, 0, None]
    assert column([(1, 4), (1, 0), (1, None), (1, -666666666)], "n int, d int", c.safe_rate("n", "d", sentinels=(-666666666,))) == [25.0, None, None, None]
    assert column([(1.7,), (-1.5,), (2.5,)], "x double", c.to_int("x")) == [2, -2, 3]
    assert column([(1,), (2,), (3,), (None,)], "x int", c.yes_no("x")) == [True, False, None, None]
    assert column([(1,), (0,), (None,)], "x int", c.flag_on("x")) == [True, False, False]
    assert column([(1,), (9,), (None,)], "x int", c.code_label("x", {1: "one"}, "other")) == ["one", "other", "other"]
    assert column([(120.0,), (None,)], "x double", c.cap("x", 100.0)) == [100.0, None]
    assert column([("12",), ("x",)], "x string", c.lenient("x", "int")) == [12, None]


def test_age(column):
    start = datetime.datetime(2024, 1, 1)
    expr = c.age_days("t", F.lit("2024-01-02 12:00:00").cast("timestamp"))
    assert column([(start,)], "t timestamp", expr) == [1.5]


@pytest.mark.parametrize(
    "a,b,lo,hi",
    [
        ((1.0, 1.0), (1.0, 1.0), 0, 0), ((41.8781, -87.6298), (40.7128, -74.0060), 1130, 1160), ((0.0, 0.0), (0.0, 1.0), 110, 112),
        ((51.5074, -0.1278), (48.8566, 2.3522), 340, 350), ((90.0, 0.0), (-90.0, 0.0), 20000, 20100),
    ],
)
def test_haversine(column, a, b, lo, hi):
    schema = "p double, q double, r double, s double"
    there = column([(*a, *b)], schema, geo.haversine_km("p", "q", "r", "s"))[0]
    back = column([(*b, *a)], schema, geo.haversine_km("p", "q", "r", "s"))[0]
    assert lo <= there <= hi and there == pytest.approx(back)


def test_positions(column):
    rows = [("41.88", -87.63), ("0", 0.0), ("41.88", 87.63), (None, None), ("x", -87.0), ("18.46", -66.1), ("21.3", -157.8), ("64.8", -147.7), ("15", -87.0)]
    assert column(rows, "a string, b double", geo.is_valid_latlon("a", "b")) == [True, False, False, False, False, True, True, True, False]


def test_grid(column):
    cell = column([(41.0, -87.0)], "a double, b double", geo.grid_key("a", "b", 8))[0]
    center = column([(41.0, -87.0)], "a double, b double", geo.grid_center(geo.grid_key("a", "b", 8)))[0]
    assert abs(center["lat"] - 41) <= geo.cell_size(8) and abs(center["lon"] + 87) <= geo.cell_size(8)
    parent = column([(41.0, -87.0)], "a double, b double", geo.grid_parent(geo.grid_key("a", "b", 8), 5))[0]
    direct = column([(41.0, -87.0)], "a double, b double", geo.grid_key("a", "b", 5))[0]
    assert tuple(parent) == tuple(direct)
    ring = column([(41.0, -87.0)], "a double, b double", geo.grid_ring(geo.grid_key("a", "b", 8), 2))[0]
    assert len(ring) == 25 and cell in ring
    assert geo.level_for_area(1e9) == 0 and geo.level_for_area(1) > geo.level_for_area(100)


def test_text(column):
    assert column([("weakest_pillar",)], "x string", text.prettify("x")) == ["Weakest Pillar"]
    assert column([("a , b,c",)], "x string", text.split_list("x")) == [["a", "b", "c"]]
    assert column([("{bad",), ('{"a":{"b":3}}',)], "x string", text.json_text("x", "$.a.b")) == [None, "3"]
    assert column([("n", None)], "a string, b string", text.record_line({"A": "a", "B": "b"})) == ["A: n"]
    filled = text.fill_template("{a} has {b}", {"a": ("a", "?"), "b": ("b", "N/A")})
    assert column([("n", None)], "a string, b string", filled) == ["n has N/A"]


def test_predicates(column):
    rows = [("Springfield", "IL"), ("100%", "TX"), (None, "il")]
    assert column(rows, "a string, b string", F.coalesce(matches_any("IL", ["a", "b"]), F.lit(False))) == [True, False, True]
    assert column(rows, "a string, b string", F.coalesce(matches_any("0%", ["a"]), F.lit(False))) == [False, True, False]
    assert column([("Proposed Withdrawn",), ("ok",), (None,)], "x string", lacks_text("x", "withdrawn")) == [False, True, None]
    assert column([(None,), (40.0,), (39.0,)], "x double", null_or_at_least("x", 40)) == [True, True, False]
    some = build_filters(equals={"a": "x", "b": None}, at_least={"n": 2}, member_of={"n": (2, 3)}, between={"n": (1, 2)})
    assert column([("x", "q", 2), ("x", "q", 3), ("y", "q", 2)], "a string, b string, n int", some) == [True, False, False]
    assert column([("x",)], "a string", build_filters()) == [True]
