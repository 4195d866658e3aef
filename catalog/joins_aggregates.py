"""Joins with context tables and grouped summaries."""

from __future__ import annotations

from pyspark.sql import functions as F

from indicraft.functions.cleaning import round_half_up
from indicraft.operators import aggregates as ag
from indicraft.operators import joins as jn
from indicraft.operators.windows import union_by_priority, union_tagged
from indicraft.session import attach_stats
from indicraft.sources.sinks import upsert, upsert_latest

from .base import query, rnd, table


@query(
    "enrich_left_contexts",
    f"""select c_custkey, n_name, s.n_suppliers, coalesce(s.n_suppliers, 0) as n_suppliers_or_zero, {rnd('o.spend')} as spend from customer
left join nation on n_nationkey = c_nationkey left join (select s_nationkey, count(*) as n_suppliers from supplier group by 1) s on s_nationkey = c_nationkey
left join (select user_id, sum(value) as spend from events group by 1) o on user_id = c_custkey""",
)
def enrich_contexts(spark, d):
    nation = table(spark, d, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    suppliers = table(spark, d, "supplier").groupBy(F.col("s_nationkey").alias("c_nationkey")).agg(F.count(F.lit(1)).alias("n_suppliers"))
    # many customers have no events
    orders = table(spark, d, "events").groupBy(F.col("user_id").alias("c_custkey")).agg(F.sum("value").alias("spend"))
    out = jn.enrich(
        table(spark, d, "customer").select("c_custkey", "c_nationkey"),
        [(nation, "c_nationkey"), (suppliers.withColumn("n_suppliers_or_zero", F.col("n_suppliers")), "c_nationkey"), (orders, "c_custkey")],
        {"n_suppliers_or_zero": 0},
        check_unique=True,
    )
    return out.drop("c_nationkey").withColumn("spend", round_half_up("spend", 2))


@query("join_inner", "select event_id, c_name, event_type from events join customer on c_custkey = user_id")
def join_inner(spark, d):
    cust = table(spark, d, "customer").select(F.col("c_custkey").alias("user_id"), "c_name")
    return table(spark, d, "events").join(cust, "user_id").select("event_id", "c_name", "event_type")


PERIODS = "select o_custkey, year(o_orderdate) as yr, count(*) as n, sum(o_totalprice) as spend from orders group by 1, 2"


@query(
    "period_over_period",
    f"select a.o_custkey, a.n - b.n as n_change, {rnd('a.spend - b.spend')} as spend_change from ({PERIODS}) a left join ({PERIODS}) b on b.o_custkey = a.o_custkey and b.yr = 1999 where a.yr = 2000",
)
def period_change(spark, d):
    yearly = table(spark, d, "orders").groupBy("o_custkey", F.year("o_orderdate").alias("yr")).agg(F.count(F.lit(1)).alias("n"), F.sum("o_totalprice").alias("spend"))
    out = jn.period_over_period(yearly, "o_custkey", "yr", ["n", "spend"], 2000, 1999)
    return out.select("o_custkey", "n_change", round_half_up("spend_change", 2).alias("spend_change"))


@query("join_flagged_by_both", "select distinct o_custkey from orders where o_totalprice > 400000 and o_custkey in (select c_custkey from customer where c_acctbal < 2000)")
def both_flags(spark, d):
    a = table(spark, d, "orders").filter("o_totalprice > 400000").select("o_custkey")
    b = table(spark, d, "customer").filter("c_acctbal < 2000").select(F.col("c_custkey").alias("o_custkey"))
    return jn.flagged_by_both(a, b, "o_custkey")


@query("join_not_yet_done", "select c_custkey, c_name from customer where c_custkey not in (select user_id from events)")
def not_done(spark, d):
    done = table(spark, d, "events").select(F.col("user_id").alias("c_custkey"))
    return jn.not_yet_done(table(spark, d, "customer").select("c_custkey", "c_name"), done, "c_custkey")


@query("referential_orphans", "select doc_id, count(*) as child_rows from documents where doc_id not in (select doc_id from labels) group by 1")
def orphans(spark, d):
    return jn.orphan_keys(table(spark, d, "documents").select("doc_id"), table(spark, d, "labels"), "doc_id")


@query(
    "one_row_thresholds",
    "select s_suppkey, s_acctbal < lo as below, s_acctbal >= hi as above from supplier, (select avg(s_acctbal) - 1000 as lo, avg(s_acctbal) + 1000 as hi from supplier) t",
)
def thresholds(spark, d):
    s = table(spark, d, "supplier")
    stats = s.agg((F.avg("s_acctbal") - 1000).alias("lo"), (F.avg("s_acctbal") + 1000).alias("hi"))
    x = F.col("s_acctbal")
    return attach_stats(s, stats, "t").select("s_suppkey", (x < F.col("t.lo")).alias("below"), (x >= F.col("t.hi")).alias("above"))


_stats = ", ".join(f"{rnd(f'{fn}({c})')} as {fn}_{c}" for c in ("l_quantity", "l_extendedprice") for fn in ("avg", "min", "max", "stddev", "sum"))


@query("rollup_statistics", f"select l_returnflag, l_linestatus, count(*) as row_count, {_stats} from lineitem group by 1, 2")
def rollup_statistics(spark, d):
    return ag.rollup_stats(table(spark, d, "lineitem"), ["l_returnflag", "l_linestatus"], ["l_quantity", "l_extendedprice"], stats=("avg", "min", "max", "stddev", "sum"))


@query("category_counts", "select c_nationkey, count(*) filter (c_mktsegment = 'BUILDING') as building, count(*) filter (c_mktsegment = 'MACHINERY') as machinery from customer group by 1")
def categories(spark, d):
    return ag.category_counts(table(spark, d, "customer"), ["c_nationkey"], "c_mktsegment", {"BUILDING": "building", "MACHINERY": "machinery"})


@query("banded_counts", "select count(*) as row_count, count(*) filter (o_totalprice <= 100000) as low, count(*) filter (o_totalprice > 100000 and o_totalprice <= 300000) as mid, count(*) filter (o_totalprice > 300000) as high from orders")
def banded(spark, d):
    p = F.col("o_totalprice")
    return ag.banded_counts(table(spark, d, "orders"), [], {"low": p <= 100000, "mid": (p > 100000) & (p <= 300000), "high": p > 300000})


_piv = ", ".join(f"{rnd(f'''avg(value) filter (event_type = '{m}')''', 4)} as {m}_avg" for m in ("click", "view", "purchase", "error", "signup"))


@query("pivot_long_measures", f"select user_id, {_piv} from events group by 1")
def pivot_long(spark, d):
    return ag.pivot_measures(table(spark, d, "events"), ["user_id"], "event_type", "value", {m: f"{m}_avg" for m in ("click", "view", "purchase", "error", "signup")}, digits=4)


@query("conditional_max", "select l_suppkey, max(l_quantity) filter (l_returnflag = 'A') as a_max, max(l_quantity) filter (l_returnflag = 'R') as r_max from lineitem group by 1")
def conditional_max(spark, d):
    return ag.pivot_measures(table(spark, d, "lineitem"), ["l_suppkey"], "l_returnflag", "l_quantity", {"A": "a_max", "R": "r_max"}, agg="max")


@query("flag_any_row", "select user_id, bool_or(event_type = 'error') as has_error, bool_or(value > 50) as has_large from events group by 1")
def flag_any_row(spark, d):
    return ag.flag_any(table(spark, d, "events"), ["user_id"], {"has_error": F.col("event_type") == "error", "has_large": F.col("value") > 50})


@query("share_of_rows", f"select o_orderpriority, {rnd('''avg(case when o_orderstatus = 'F' then 1.0 else 0.0 end) * 100''', 1)} as pct_done from orders group by 1")
def share_of_rows(spark, d):
    return table(spark, d, "orders").groupBy("o_orderpriority").agg(ag.share_true(F.col("o_orderstatus") == "F").alias("pct_done"))


@query("distinct_counts", "select count(distinct l_partkey) as distinct_l_partkey, count(distinct l_suppkey) as distinct_l_suppkey from lineitem")
def distinct_counts(spark, d):
    return ag.distinct_counts(table(spark, d, "lineitem"), ["l_partkey", "l_suppkey"])


@query("distinct_counts_sketch", "select 2::bigint as columns, true as all_within_a_tenth")
def distinct_sketch(spark, d):
    """Sketched counts next to exact ones."""
    names = ["l_partkey", "l_suppkey"]
    lines = table(spark, d, "lineitem")
    sketch, exact = ag.distinct_counts(lines, names, approx=True), ag.distinct_counts(lines, names)
    both = attach_stats(attach_stats(sketch, exact, "exact"), sketch, "sketch")
    near = [F.abs(F.col(f"sketch.{c}") - F.col(f"exact.{c}")) <= 0.1 * F.col(f"exact.{c}") for c in sketch.columns]
    return both.select(F.lit(len(near)).cast("long").alias("columns"), F.forall(F.array(*near), lambda x: x).alias("all_within_a_tenth"))


@query("ordered_series", f"select cast(yr as integer) as yr, n_regionkey, {rnd('avg(o_totalprice)')} as avg_o_totalprice, count(*) as row_count from (select year(o_orderdate) as yr, n_regionkey, o_totalprice from orders join customer on c_custkey = o_custkey join nation on n_nationkey = c_nationkey) q group by 1, 2 order by 1, 2")
def ordered_series(spark, d):
    cust = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("n_nationkey") == F.col("c_nationkey")).select(F.col("c_custkey").alias("o_custkey"), "n_regionkey")
    joined = table(spark, d, "orders").select("o_custkey", F.year("o_orderdate").alias("yr"), "o_totalprice").join(cust, "o_custkey")
    return ag.ordered_series(joined, ["yr", "n_regionkey"], "o_totalprice")


@query("global_totals", f"select count(*) as row_count, {rnd('sum(l_quantity)')} as sum_l_quantity, {rnd('avg(l_extendedprice)')} as avg_l_extendedprice, {rnd('median(l_discount)')} as median_l_discount from lineitem")
def global_totals(spark, d):
    return ag.totals(table(spark, d, "lineitem"), ["l_quantity"], ["l_extendedprice"], ["l_discount"])


@query("percentile_rollup", f"select o_orderpriority, {rnd('quantile_cont(o_totalprice, 0.1)')} as o_totalprice_p10, {rnd('quantile_cont(o_totalprice, 0.5)')} as o_totalprice_p50, {rnd('quantile_cont(o_totalprice, 0.9)')} as o_totalprice_p90 from orders group by 1")
def percentile_rollup(spark, d):
    return ag.percentile_rollup(table(spark, d, "orders"), ["o_orderpriority"], "o_totalprice")


@query("mode_and_share", f"select l_quantity as mode_value, n as mode_count, {rnd('n * 100.0 / sum_n')} as mode_pct from (select l_quantity, count(*) as n, cast(sum(count(*)) over () as double) as sum_n from lineitem group by 1 order by n desc, l_quantity limit 1) q")
def mode_and_share(spark, d):
    return ag.mode_share(table(spark, d, "lineitem"), "l_quantity")


@query("mode_of_text", f"select o_orderpriority as mode_value, n as mode_count, {rnd('n * 100.0 / sum_n')} as mode_pct from (select o_orderpriority, count(*) as n, cast(sum(count(*)) over () as double) as sum_n from orders group by 1 order by n desc, o_orderpriority limit 1) q")
def mode_of_text(spark, d):
    return ag.mode_share(table(spark, d, "orders"), "o_orderpriority")


@query("value_counts", "select p_brand, p_type, count(*) as row_count from part group by 1, 2")
def value_counts(spark, d):
    return ag.value_counts(table(spark, d, "part"), "p_brand", "p_type")


@query("null_rates", f"select unnest(['user_id', 'half', 'value']) as column_name, unnest([a, b, c]) as nulls, unnest([{rnd('a * 100.0 / n')}, {rnd('b * 100.0 / n')}, {rnd('c * 100.0 / n')}]) as null_pct from (select count(*) filter (user_id is null) as a, count(*) filter (event_id % 2 = 0) as b, count(*) filter (value is null) as c, count(*) as n from events) q")
def null_rates(spark, d):
    e = table(spark, d, "events").withColumn("half", F.when(F.col("event_id") % 2 != 0, F.col("value")))
    return ag.null_rates(e, ["user_id", "half", "value"])


@query("max_timestamp_and_states", "select lang, max(doc_id) as newest from documents group by 1")
def newest(spark, d):
    return table(spark, d, "documents").groupBy("lang").agg(F.max("doc_id").alias("newest"))


@query("distinct_list", "select distinct c_mktsegment from customer order by 1")
def distinct_list(spark, d):
    return ag.distinct_list(table(spark, d, "customer"), "c_mktsegment")


@query("deviation_from_group_mean", f"select p_partkey, {rnd('p_retailprice - avg(p_retailprice) over (partition by p_brand)')} as off from part")
def deviation(spark, d):
    return ag.deviation_from_group_mean(table(spark, d, "part"), ["p_brand"], "p_retailprice", "off").select("p_partkey", "off")


@query(
    "diagonal_union",
    "select s_suppkey as id, s_acctbal as balance, null::varchar as segment, 'supplier' as origin from supplier union all select c_custkey, c_acctbal, c_mktsegment, 'customer' from customer",
)
def diagonal_union(spark, d):
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_acctbal").alias("balance"))
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("segment"), F.col("c_acctbal").alias("balance"))
    return union_tagged({"supplier": s, "customer": c}, "origin")


@query(
    "union_by_priority",
    "select coalesce(a.o_custkey, b.o_custkey) as o_custkey, coalesce(a.why, b.why) as why from (select distinct o_custkey, 'large' as why from orders where o_totalprice > 450000) a full join (select distinct o_custkey, 'urgent' as why from orders where o_orderpriority = '1-URGENT') b using (o_custkey)",
)
def priority_union(spark, d):
    o = table(spark, d, "orders")
    a = o.filter("o_totalprice > 450000").select("o_custkey", F.lit("large").alias("why"))
    b = o.filter("o_orderpriority = '1-URGENT'").select("o_custkey", F.lit("urgent").alias("why"))
    return union_by_priority([a, b], "o_custkey")


@query(
    "sink_upsert",
    "select c_custkey, case when c_mktsegment = 'BUILDING' then c_acctbal + 1 else c_acctbal end as c_acctbal from customer",
)
def upsert_rows(spark, d):
    c = table(spark, d, "customer")
    changed = c.filter("c_mktsegment = 'BUILDING'").select("c_custkey", (F.col("c_acctbal") + 1).alias("c_acctbal"))
    return upsert(c.select("c_custkey", "c_acctbal"), changed, ["c_custkey"])


@query(
    "sink_upsert_latest",
    "select o_custkey, o_orderkey from orders qualify row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey desc) = 1",
)
def upsert_newest(spark, d):
    o = table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderdate")
    old, new = o.filter(F.year("o_orderdate") < 2000), o.filter(F.year("o_orderdate") >= 2000)
    return upsert_latest(old, new, ["o_custkey"], ["o_orderdate", "o_orderkey"]).select("o_custkey", "o_orderkey")
