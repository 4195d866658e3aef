"""Data-quality operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from indicraft.operators import quality as q
from indicraft.operators.checked_write import write_checked
from indicraft.operators.quality import Check
from indicraft.plans.suites import SUITES, publish, run_column_tests, run_suites
from indicraft.session import scratch_path

from . import model_sql as sql
from .base import query, rnd, table
from .gold_tables import medallion

def _as_of():
    return F.lit("2024-02-01 00:00:00").cast("timestamp")


@query(
    "quality_run_checks",
    f"""with m as (select count(*)::double as n, count(*) filter (event_id % 4 = 0)::double as missing, count(distinct user_id)::double as users, avg(value) as mean, stddev(value) as sd, min(value) as lo, max(value) as hi,
    count(*) filter (value > 60)::double as bad, count(*) filter (event_id % 4 <> 0 and length(event_type) <> 5)::double as len_bad, epoch_us(timestamp '2024-02-01') - epoch_us(max(ts)) as age from events),
  u as (select count(*)::double as dup from (select user_id from events group by 1 having count(*) > 1) g)
select * from (select unnest(['row_count', 'missing_count(kind)', 'missing_percent(kind)', 'duplicate_count(event_id)', 'duplicate_count(user_id)', 'distinct_count(user_id)', 'invalid_count(value)', 'invalid_percent(value)', 'invalid_count(kind)', 'avg(value)', 'stddev(value)', 'min(value)', 'max(value)', 'freshness(ts)']) as check_name,
  unnest([null, 'kind', 'kind', 'event_id', 'user_id', 'user_id', 'value', 'value', 'kind', 'value', 'value', 'value', 'value', 'ts']) as column_name,
  unnest([{', '.join(rnd(e, 4) for e in ('n', 'missing', 'missing / n * 100', '0', 'dup', 'users', 'bad', 'bad / n * 100', 'len_bad', 'mean', 'sd', 'lo', 'hi', 'age / 86400000000.0'))}]) as value,
  unnest(['pass', 'fail', 'warn', 'pass', 'fail', case when users < 50 then 'warn' else 'pass' end, case when bad > 0 then 'fail' else 'pass' end, 'pass', case when len_bad > 10 then 'warn' else 'pass' end, case when mean between 0 and 20 then 'pass' else 'warn' end, 'pass', 'pass', 'pass', case when age > 172800000000 then 'warn' else 'pass' end]) as status from m, u) r""",
)
def run_checks(spark, d):
    e = table(spark, d, "events").withColumn("kind", F.when(F.col("event_id") % 4 != 0, F.col("event_type")))
    return q.run_checks(
        e,
        [
            Check("row_count", fail=("<", 1)),
            Check("missing_count", "kind", fail=(">", 0)),
            Check("missing_percent", "kind", warn=(">", 20), fail=(">", 30)),
            Check("duplicate_count", "event_id", fail=(">", 0)),
            Check("duplicate_count", "user_id", fail=(">", 0)),
            Check("distinct_count", "user_id", warn=("<", 50)),
            Check("invalid_count", "value", fail=(">", 0), options={"high": 60}),
            Check("invalid_percent", "value", fail=(">", 90), options={"high": 60}),
            Check("invalid_count", "kind", warn=(">", 10), options={"length": 5}),
            Check("avg", "value", warn=("not between", (0, 20))),
            Check("stddev", "value", warn=("<", 1)),
            Check("min", "value", fail=("<", -1000)),
            Check("max", "value", fail=(">", 1e9)),
            Check("freshness", "ts", warn=(">", 2), fail=(">", 90)),
        ],
        _as_of(),
    )


@query("quality_duplicate_keys", "select l_orderkey, l_linenumber, count(*) as occurrences from lineitem group by 1, 2 having count(*) > 1")
def duplicate_keys(spark, d):
    return q.duplicate_keys(table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("quality_failing_rows", "select o_orderkey, o_totalprice from orders where o_totalprice > 490000 or o_orderpriority not in ('1-URGENT', '2-HIGH', '3-MEDIUM', '5-LOW')")
def failing_rows(spark, d):
    ok = q.valid("o_totalprice", high=490000) & q.valid("o_orderpriority", values=("1-URGENT", "2-HIGH", "3-MEDIUM", "5-LOW"))
    return q.failing_rows(table(spark, d, "orders"), ~ok, "o_orderkey", "o_totalprice")


def _rules(spark, d):
    e = table(spark, d, "events").withColumn("empty", F.lit(None).cast("double"))
    first = q.table_rules(e, "events", 10, ["event_id", "absent"], {"user_id": 0}, {"value": (0, 50), "empty": (0, 1)})
    c = q.table_rules(table(spark, d, "customer"), "customer", 10**9, ["c_custkey"], {"c_custkey": 0}, {"c_acctbal": (-1000, 10000)})
    return first.unionByName(c)


RULES = f"""(select 'events' as table_name, unnest(['row_count', 'required:event_id', 'required:absent', 'null_pct:user_id', 'range:value', 'range:empty']) as rule,
  unnest([n::double, null, null, 0, case when lo < 0 then lo else hi end, null]) as observed, unnest(['pass', 'pass', 'fail', 'pass', case when lo >= 0 and hi <= 50 then 'pass' else 'fail' end, 'warn']) as status
  from (select count(*) as n, min(value) as lo, max(value) as hi from events) e
union all select 'customer', unnest(['row_count', 'required:c_custkey', 'null_pct:c_custkey', 'range:c_acctbal']), unnest([n::double, null, 0, case when lo < -1000 then lo else hi end]),
  unnest(['fail', 'pass', 'pass', case when lo >= -1000 and hi <= 10000 then 'pass' else 'fail' end]) from (select count(*) as n, min(c_acctbal) as lo, max(c_acctbal) as hi from customer) c)"""


@query("quality_table_rules", f"select * from {RULES} r")
def table_rules(spark, d):
    return _rules(spark, d)


@query(
    "quality_report",
    f"""select *, case when failed = 0 then 'healthy' else 'degraded' end as status from (select table_name, count(*) filter (status <> 'warn') as total_checks, count(*) filter (status = 'pass') as passed,
  count(*) filter (status = 'fail') as failed, count(*) filter (status = 'warn') as warnings, {rnd("count(*) filter (status = 'pass') * 100.0 / count(*) filter (status <> 'warn')", 1)} as pass_rate from {RULES} r group by 1) t""",
)
def report(spark, d):
    return q.quality_report(_rules(spark, d), ["table_name"])


@query(
    "quality_new_failures",
    f"""select layer, cast(sum(failed) as bigint) as failed, max(checked_at) as last_checked_at from (
  select case table_name when 'events' then 'raw' else 'gold' end as layer, count(*) filter (status = 'fail') as failed, case table_name when 'events' then timestamp '2024-01-10' else timestamp '2024-01-20' end as checked_at
  from {RULES} r group by table_name) l where checked_at > timestamp '2024-01-15' and failed > 0 group by 1""",
)
def new_failures(spark, d):
    rules = _rules(spark, d)
    at = lambda s: F.lit(s).cast("timestamp")
    log = q.result_log(rules.filter("table_name = 'events'"), "raw", at("2024-01-10 00:00:00")).unionByName(
        q.result_log(rules.filter("table_name = 'customer'"), "gold", at("2024-01-20 00:00:00"))
    )
    return q.new_failures(log, at("2024-01-15 00:00:00"))


@query(
    "quality_distribution",
    sql.gold(
        f"""select n as row_count, mean, std, mode_pct, case when mean between 20 and 80 then 'pass' else 'fail' end as mean_status, case when std > 1 then 'pass' else 'fail' end as std_status,
  case when mode_pct <= 25 then 'pass' else 'fail' end as mode_status from (select count(*) as n, {rnd('avg(wellbeing_score)')} as mean, {rnd('stddev(wellbeing_score)')} as std,
  (select {rnd('max(c) * 100.0 / cast(sum(c) as double)')} from (select count(*) as c from scores group by wellbeing_score) m) as mode_pct from scores) x"""
    ),
)
def distribution(spark, d):
    return q.distribution_check(medallion(spark, d).scores, "wellbeing_score")


@query(
    "quality_freshness",
    f"select max(ts) as latest, {rnd('(epoch_us(timestamp \'2024-02-01\') - epoch_us(max(ts))) / 86400000000.0', 1)} as age_days, 'warn' as status from events",
)
def freshness(spark, d):
    return q.freshness(table(spark, d, "events"), "ts", _as_of(), 1, 90)


@query(
    "quality_freshness_report",
    f"""select 'events' as table_name, max(ts) as latest, {rnd('(epoch_us(timestamp \'2024-02-01\') - epoch_us(max(ts))) / 86400000000.0', 1)} as age_days, 30.0::double as max_age_days, 'fresh' as status from events
union all select 'orders', max(o_orderdate), {rnd('(epoch_us(timestamp \'2024-02-01\') - epoch_us(max(o_orderdate))) / 86400000000.0', 1)}, 90.0, 'stale' from orders
union all select 'customer', null, null, 7.0, 'unknown' union all select 'nowhere', null, null, 7.0, 'missing'""",
)
def freshness_report(spark, d):
    t = lambda n: table(spark, d, n)
    return q.freshness_report(
        spark, {"events": (t("events"), "ts", 30), "orders": (t("orders"), "o_orderdate", 90), "customer": (t("customer"), None, 7), "nowhere": (None, "ts", 7)}, _as_of()
    )


@query(
    "quality_suspicious_sample",
    sql.gold(
        """, base as (select t.*, s.education_score, s.health_score, s.environment_score, s.safety_score, md5(s.nces_school_id || '#42') as draw,
    abs(s.wellbeing_score - (coalesce(s.education_score, 0) + coalesce(s.health_score, 0) + coalesce(s.environment_score, 0) + coalesce(s.safety_score, 0))
      / ((s.education_score is not null)::int + (s.health_score is not null)::int + (s.environment_score is not null)::int + (s.safety_score is not null)::int)) > 2 as odd
  from (select nces_school_id, wellbeing_score, math_proficiency_change, reading_proficiency_change from trends) t join scores s using (nces_school_id)),
a as (select *, 0 as prio, 'extreme' as stratum from base where wellbeing_score < 30 or wellbeing_score > 70 order by draw, nces_school_id limit 20),
b as (select *, 1, 'large_change' from base where abs(math_proficiency_change) > 25 or abs(reading_proficiency_change) > 25 order by draw, nces_school_id limit 20),
c as (select *, 2, 'inconsistent' from base where odd order by draw, nces_school_id limit 15),
picks as (select * from (select * from a union all select * from b union all select * from c) u qualify row_number() over (partition by nces_school_id order by prio, draw) = 1),
f as (select *, md5(nces_school_id || '#43') as draw2 from base where nces_school_id not in (select nces_school_id from picks)),
g as (select *, row_number() over (order by draw2, nces_school_id) as place from f),
uniq as (select nces_school_id, wellbeing_score, stratum from picks union all select nces_school_id, wellbeing_score, 'random' from g where place <= 60 - (select count(*) from picks))
select nces_school_id, wellbeing_score, stratum from uniq"""
    ),
)
def suspicious(spark, d):
    m = medallion(spark, d)
    base = m.trends.select(
        "nces_school_id", "wellbeing_score", "math_proficiency_change", "reading_proficiency_change", "education_score", "health_score", "environment_score", "safety_score"
    )
    out = q.sample_suspicious(
        base,
        "nces_school_id",
        60,
        "wellbeing_score",
        ["math_proficiency_change", "reading_proficiency_change"],
        ["education_score", "health_score", "environment_score", "safety_score"],
        extremes=(30, 70),
        mismatch=2,
    )
    return out.select("nces_school_id", "wellbeing_score", "stratum")


def _status(value: str, warn: str | None, fail: str) -> str:
    return f"case when {fail.format(v=value)} then 'fail' " + (f"when {warn.format(v=value)} then 'warn' " if warn else "") + "else 'pass' end"


def _suite_sql() -> str:
    rows = [("row_count", None, "count(*)", "{v} < 100000", "{v} < 60000"), ("missing_count", "nces_school_id", "count(*) filter (where nces_school_id is null)", None, "{v} > 0"),
            ("duplicate_count", "nces_school_id", "max((select count(*) from (select 1 from scores where nces_school_id is not null group by nces_school_id having count(*) > 1) q))", None, "{v} > 0")]
    rows += [("invalid_count", c, f"count(*) filter (where {c} < 0 or {c} > 100)", None, "{v} > 0") for c in ("wellbeing_score", "education_score", "health_score", "environment_score", "safety_score")]
    rows += [
        ("avg", "wellbeing_score", "avg(wellbeing_score)", "{v} not between 35 and 75", "{v} not between 20 and 85"),
        ("stddev", "wellbeing_score", "stddev(wellbeing_score)", "{v} < 8", "{v} < 3"),
        ("missing_count", "wellbeing_category", "count(*) filter (where wellbeing_category is null)", None, "{v} > 0"),
        ("avg", "pillars_with_data", "avg(pillars_with_data)", "{v} < 3", "{v} < 2.5"),
        ("missing_percent", "latitude", "count(*) filter (where latitude is null) * 100.0 / count(*)", "{v} > 3", "{v} > 10"),
        ("distinct_count", "state_abbr", "count(distinct state_abbr)", "{v} < 50", "{v} < 45"),
    ]
    one = "select 'scores' as table_name, '{k}' as check_name, {c} as column_name, {v} as value, {s} as status from scores"
    return " union all ".join(
        one.format(k=f"{k}({c})" if c else k, c=f"'{c}'" if c else "null::varchar", v=rnd(v, 4), s=_status(v, warn, fail)) for k, c, v, warn, fail in rows
    )


@query("quality_gold_suite", sql.gold(_suite_sql()))
def gold_suite(spark, d):
    """The declared checks of the score table, run over the scored schools."""
    return run_suites({"scores": medallion(spark, d).scores}, {"scores": SUITES["scores"]})


@query("quality_suite_on_write", sql.gold(_suite_sql()))
def suite_on_write(spark, d):
    """The same checks, measured by the write that publishes the score table."""
    done = publish(medallion(spark, d).scores, "scores", scratch_path(spark, "published"))
    return done.results.select(F.lit("scores").alias("table_name"), "check_name", "column_name", "value", "status")


@query(
    "quality_keys_on_write",
    """with dup as (select count(*)::double as n from (select o_custkey from orders group by 1 having count(*) > 1) q), m as (select count(*)::double as rows, count(distinct o_custkey)::double as customers, count(distinct o_orderpriority)::double as priorities from orders)
select unnest(['row_count', 'duplicate_count(o_orderkey)', 'duplicate_count(o_custkey)', 'distinct_count(o_custkey)', 'distinct_count(o_orderpriority)']) as check_name, unnest([null, 'o_orderkey', 'o_custkey', 'o_custkey', 'o_orderpriority']) as column_name,
  unnest([rows, 0, n, customers, priorities]) as value, unnest(['pass', 'pass', case when n > 0 then 'fail' else 'pass' end, case when customers < 100 then 'warn' else 'pass' end, case when priorities < 6 then 'fail' else 'pass' end]) as status from m, dup""",
)
def keys_on_write(spark, d):
    """Keys by the sketch of the write; repeated customers are counted on the stored key column."""
    checks = [
        Check("row_count", fail=("<", 1)),
        Check("duplicate_count", "o_orderkey", fail=(">", 0)),
        Check("duplicate_count", "o_custkey", fail=(">", 0)),
        Check("distinct_count", "o_custkey", warn=("<", 100)),
        Check("distinct_count", "o_orderpriority", fail=("<", 6)),
    ]
    return write_checked(table(spark, d, "orders"), scratch_path(spark, "orders"), checks).results.drop("measured_by")


def _column_test_sql() -> str:
    """One row per test: table name, CTE, then the tests by kind. Written apart from the specs they are compared with."""
    category = "('Thriving', 'Moderate', 'At Risk', 'Critical', 'Insufficient Data')"
    trend = "('Improving', 'Declining', 'Stable')"
    key = "nces_school_id"
    ctes = {"profiles": "profiles", "health_context": "health", "environment": "environment", "safety": "safety", "resources": "resources", "areas": "community",
            "scores": "scores", "rankings": "rankings", "gaps": "gaps", "trends": "trends", "counties": "summary"}
    rows = []
    for name in ctes:
        k = "county_fips" if name in ("areas", "counties") else key
        rows += [(name, "duplicate_count", k, f"(select count(*) from (select {k} from {{t}} where {k} is not null group by 1 having count(*) > 1) q)", "fail")]
        rows += [(name, "missing_count", k, f"(select count(*) from {{t}} where {k} is null)", "fail")]
    for name, cols in {"profiles": "school_name state_abbr county_fips", "areas": "school_count", "scores": "wellbeing_score", "rankings": "national_rank state_rank", "counties": "avg_wellbeing_score"}.items():
        rows += [(name, "missing_count", c, f"(select count(*) from {{t}} where {c} is null)", "fail") for c in cols.split()]
    rows += [("scores", "missing_count", c, f"(select count(*) from {{t}} where {c} is null)", "warn") for c in ("latitude", "longitude")]
    for name, c, bad, severity in [
        ("profiles", "latitude", "not between 17 and 72", "warn"), ("profiles", "longitude", "not between -180 and -64", "warn"), ("profiles", "total_enrollment", "not between 0 and 15000", "warn"),
        ("profiles", "math_proficiency_pct", "not between 0 and 100", "warn"), ("profiles", "reading_proficiency_pct", "not between 0 and 100", "warn"), ("health_context", "child_poverty_rate", "not between 0 and 100", "warn"),
        ("environment", "median_aqi", "not between 0 and 500", "warn"), ("areas", "school_count", "not between 1 and 5000", "fail"), ("scores", "wellbeing_score", "not between 0 and 100", "fail"),
        ("scores", "education_score", "not between 0 and 100", "warn"), ("scores", "health_score", "not between 0 and 100", "warn"), ("scores", "environment_score", "not between 0 and 100", "warn"),
        ("scores", "safety_score", "not between 0 and 100", "warn"), ("scores", "wellbeing_category", f"not in {category}", "fail"), ("scores", "pillars_with_data", "not between 1 and 4", "fail"),
        ("gaps", "gap_count", "not between 1 and 4", "fail"), ("gaps", "intervention_priority", "not in ('High Priority', 'Critical Need', 'Moderate Need')", "fail"),
        ("gaps", "weakest_pillar", "not in ('Education', 'Health', 'Environment', 'Safety')", "fail"), ("trends", "math_trend", f"not in {trend}", "fail"), ("trends", "reading_trend", f"not in {trend}", "fail"),
        ("counties", "avg_wellbeing_score", "not between 0 and 100", "fail"), ("counties", "county_category", f"not in {category}", "fail"),
    ]:
        rows.append((name, "invalid_count", c, f"(select count(*) from {{t}} where {c} is not null and {c} {bad})", severity))
    for name, parent in (("health_context", "profiles"), ("environment", "profiles"), ("safety", "profiles"), ("resources", "profiles"), ("rankings", "scores")):
        rows.append((name, "orphan_count", key, f"(select count(*) from {{t}} where {key} not in (select {key} from {parent}))", "fail"))
    one = "select '{n}' as table_name, '{k}({c})' as check_name, '{c}' as column_name, {v}::double as value, case when {v} > 0 then '{s}' else 'pass' end as status"
    return " union all ".join(one.format(n=n, k=k, c=c, v=v.format(t=ctes[n]), s=s) for n, k, c, v, s in rows)


@query("quality_column_tests", sql.gold(_column_test_sql()))
def column_tests(spark, d):
    """The column tests of all silver and gold models: unique, present, in range, one of, with a parent."""
    m = medallion(spark, d)
    contexts = {n: m.wide for n in ("health_context", "environment", "safety", "resources")}
    return run_column_tests(
        {"profiles": m.profiles, **contexts, "areas": m.community, "scores": m.scores, "rankings": m.rankings, "gaps": m.gaps, "trends": m.trends, "counties": m.counties}
    )
