"""Every registered query against its SQL, and a few whole-table invariants."""

from collections import Counter

import duckdb
import pytest

from __spark_entry__ import entry, oracle_sql, queries
from catalog import QUERIES
from catalog.base import TABLES
from catalog.gold_tables import medallion, raw
from check import compare


@pytest.fixture(scope="session")
def duck(sf_dir):
    con = duckdb.connect()
    con.sql("set timezone = 'UTC'")
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, duck, sf_dir, name):
    message, ok, _ = compare(spark, duck, name, queries()[name], oracle_sql().get(name), sf_dir)
    assert ok, message


def test_entry(spark):
    out = entry(spark)
    assert out.count() > 0 and "wellbeing_score" in out.columns


def test_scores_are_bounded_and_ranks_dense(spark, sf_dir):
    ranks = queries()["gold_school_rankings"](spark, sf_dir).toPandas()
    assert ranks.wellbeing_score.between(0, 100).all()
    assert ranks.national_rank.min() == 1 and (ranks.national_rank <= ranks.national_total).all()
    assert (ranks.national_total == len(ranks)).all()


def test_no_cross_join_in_the_flagship_plan(spark, sf_dir):
    plan = queries()["gold_resource_gaps"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


@pytest.mark.parametrize("name", ["air_quality", "crime"])
def test_gold_tables_read_stored_county_counts(spark, sf_dir, name):
    landed = medallion(spark, sf_dir).raw[name]
    assert not any("orders" in f or "customer" in f for f in landed.inputFiles())
    assert Counter(map(tuple, landed.collect())) == Counter(map(tuple, raw(spark, sf_dir, name).collect()))
    assert landed.dtypes == raw(spark, sf_dir, name).dtypes
