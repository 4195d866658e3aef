"""Pages of the order-statistics index against a plain sort."""

import pytest

from indicraft.operators.page_index import PageIndex

ORDER = {"score": True, "id": False}


@pytest.fixture(scope="module")
def world(spark, tmp_path_factory):
    # one group holds most rows, scores tie often, some are missing, one group has no name
    rows = [(k, None if k % 97 == 0 else float(k * 7919 % 60), ("big" if k % 10 else "small") if k % 333 else None) for k in range(4_000)]
    df = spark.createDataFrame(rows, "id long, score double, grp string")
    path = str(tmp_path_factory.mktemp("pages"))
    return rows, PageIndex.build(df, f"{path}/all", ORDER, slice_rows=300), PageIndex.build(df, f"{path}/by", ORDER, ["grp"], slice_rows=300)


def ordered(rows):
    return sorted(rows, key=lambda r: (r[1] is None, -(r[1] or 0.0), r[0]))


def ids(df):
    return [r["id"] for r in df.collect()]


@pytest.mark.parametrize("number", [1, 2, 7, 40, 57, 58, 59])
def test_page_equals_sorted_slice(world, number):
    rows, index, _ = world
    want = [r[0] for r in ordered(rows)][(number - 1) * 70 : number * 70]
    assert ids(index.page(number, 70)) == want
    assert index.pages(70) == 58 and index.total() == 4_000


def test_a_page_wider_than_slices(world):
    rows, index, _ = world
    assert ids(index.page(2, 1_500)) == [r[0] for r in ordered(rows)][1_500:3_000]


@pytest.mark.parametrize("group", ["big", "small", None, "absent"])
def test_groups_have_pages_of_their_own(world, group):
    rows, _, index = world
    mine = [r[0] for r in ordered([r for r in rows if r[2] == group])]
    assert index.total(grp=group) == len(mine)
    last = index.pages(30, grp=group)
    got = [ids(index.page(n, 30, grp=group)) for n in (1, max(1, last))]
    assert got == [mine[:30], mine[max(0, last - 1) * 30 :]]


def test_a_page_reads_its_own_slices_only(world):
    _, index, _ = world
    plan = index.page(30, 70)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "_slice" in plan.split("PartitionFilters: [")[1].split("]")[0]
    assert index.slices().count() == 14
    assert index.rows().groupBy("_slice").count().agg({"count": "max"}).first()[0] < 1_000


def test_empty_table_and_misuse(spark, tmp_path, world):
    _, index, grouped = world
    none = PageIndex.build(spark.createDataFrame([], "id long, score double"), str(tmp_path / "none"), ORDER)
    assert (none.total(), none.pages(), ids(none.page(1))) == (0, 0, [])
    with pytest.raises(ValueError):
        grouped.page(1)
    with pytest.raises(ValueError):
        PageIndex.build(spark.createDataFrame([], "id long, score double, _slice int"), str(tmp_path / "clash"), ORDER)
