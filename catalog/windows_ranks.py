"""Latest rows, lags, ranks, percentiles and the scoring operators on generic metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from indicraft.functions import scoring as sc
from indicraft.functions.cleaning import round_half_up
from indicraft.operators.bounds import grouped_median, percentile_bounds
from indicraft.operators.ranking import percent, rank_columns, rank_levels, state_ranking
from indicraft.operators.scoring import Metric, ScoreSpec, score_table, weights_from_table
from indicraft.operators.trends import change_zscore
from indicraft.operators.windows import dedup_first, lag_features, latest_per_key, rolling_mean, topk_per_group
from indicraft.session import attach_stats, materialize

from .base import duck, query, rnd, shared, table
from .model_sql import blended, labelled, scaled

# Customers with order and event metrics: event metrics are missing for most customers.
ENTITIES = """
select c_custkey, c_nationkey, n_regionkey, c_acctbal, coalesce(n_orders, 0) as n_orders, spend, e_value, e_errors
from {customer} join {nation} on n_nationkey = c_nationkey
left join (select o_custkey, count(*) as n_orders, cast(sum(cast(round(o_totalprice * 100) as bigint)) / 100.0 as double) as spend from {orders} group by o_custkey) o on o_custkey = c_custkey
left join (select user_id, cast(sum(cast(round(value * 100) as bigint)) / 100.0 as double) as e_value, sum(case when event_type = 'error' then 1 else 0 end) as e_errors from {events} group by user_id) e on user_id = c_custkey
"""


def entities(spark, d):
    orders = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(
        F.count(F.lit(1)).alias("n_orders"), (F.sum(F.round(F.col("o_totalprice") * 100).cast("bigint")) / 100.0).alias("spend")
    )
    events = table(spark, d, "events").groupBy(F.col("user_id").alias("c_custkey")).agg(
        (F.sum(F.round(F.col("value") * 100).cast("bigint")) / 100.0).alias("e_value"),
        F.count_if(F.col("event_type") == "error").alias("e_errors"),
    )
    nation = table(spark, d, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_regionkey")
    return (
        table(spark, d, "customer")
        .select("c_custkey", "c_nationkey", "c_acctbal")
        .join(nation, "c_nationkey")
        .join(orders, "c_custkey", "left")
        .join(events, "c_custkey", "left")
        .withColumn("n_orders", F.coalesce("n_orders", F.lit(0)))
    )


SPEC = ScoreSpec(
    metrics=(
        Metric("balance_score", "c_acctbal"),
        Metric("spend_score", "spend"),
        Metric("activity_score", "n_orders"),
        Metric("event_score", "e_value"),
        Metric("error_score", "e_errors", invert=True),
    ),
    pillars={
        "money_score": [("balance_score", 0.4), ("spend_score", 0.6)],
        "usage_score": [("event_score", 0.7), ("error_score", 0.3)],
        "order_score": [("activity_score", 1.0)],
    },
    weights={"money_score": 0.5, "usage_score": 0.3, "order_score": 0.2},
    categories={"composite_score": "category"},
)
_M = (("balance_score", "c_acctbal", False), ("spend_score", "spend", False), ("activity_score", "n_orders", False), ("event_score", "e_value", False), ("error_score", "e_errors", True))
_B = ", ".join(f"quantile_cont(cast({m} as double), 0.05) as {s}_lo, quantile_cont(cast({m} as double), 0.95) as {s}_hi" for s, m, _ in _M)
_S = ", ".join(f"{scaled(f'cast({m} as double)', f'{s}_lo', f'{s}_hi', inv)} as {s}" for s, m, inv in _M)
ENTITY_SCORES = f"""
with base as (select * from {duck(ENTITIES)} e), b as (select {_B} from base), s as (select base.*, {_S} from base, b),
p as (select *, {blended('balance_score .4, spend_score .6')} as money_score, {blended('event_score .7, error_score .3')} as usage_score,
  {rnd('activity_score')} as order_score from s),
scores as (select *, {blended('money_score .5, usage_score .3, order_score .2')} as composite_score from p)
"""


def entity_scores(spark, d):
    return score_table(materialize(entities(spark, d), "entities"), SPEC)


@query(
    "score_entities",
    ENTITY_SCORES + f"select c_custkey, balance_score, spend_score, activity_score, event_score, error_score, money_score, usage_score, order_score, composite_score, {labelled('composite_score')} as category, (money_score is not null)::int + (usage_score is not null)::int + (order_score is not null)::int as pillars_with_data from scores",
)
def score_entities(spark, d):
    cols = [m.score for m in SPEC.metrics] + list(SPEC.pillars)
    return entity_scores(spark, d).select("c_custkey", *cols, "composite_score", "category", "pillars_with_data")


@query(
    "score_with_weight_table",
    ENTITY_SCORES + f"select c_custkey, {blended('money_score .2, usage_score .5, order_score .3')} as reweighted from scores",
)
def score_with_weight_table(spark, d):
    # the weights come from the region table: key 0, 1, 2 → 0.2, 0.5, 0.3, no pillar for the others
    at = F.col("r_regionkey") + 1
    weights = table(spark, d, "region").select(
        F.try_element_at(F.array(*map(F.lit, SPEC.pillars)), at).alias("pillar"),
        F.try_element_at(F.array(F.lit(0.2), F.lit(0.5), F.lit(0.3)), at).alias("weight"),
    )
    return weights_from_table(entity_scores(spark, d), weights, list(SPEC.pillars), "reweighted").select("c_custkey", "reweighted")


@query(
    "rank_entities",
    ENTITY_SCORES
    + f"""select c_custkey, composite_score, rank() over (order by composite_score desc) as national_rank, count(*) over () as national_total,
  {rnd('percent_rank() over (order by composite_score) * 100', 1)} as national_percentile, rank() over (partition by n_regionkey order by composite_score desc) as state_rank,
  count(*) over (partition by n_regionkey) as state_total, {rnd('percent_rank() over (partition by n_regionkey order by composite_score) * 100', 1)} as state_percentile,
  rank() over (partition by c_nationkey order by composite_score desc) as county_rank, count(*) over (partition by c_nationkey) as county_total,
  rank() over (order by usage_score desc nulls last) as usage_rank, rank() over (order by money_score desc nulls last) as money_rank from scores""",
)
def rank_entities(spark, d):
    s = materialize(entity_scores(spark, d).select("c_custkey", "n_regionkey", "c_nationkey", "composite_score", "usage_score", "money_score"), "scores")
    levels = {"national": [], "state": ["n_regionkey"], "county": ["c_nationkey"]}
    ranked = rank_levels(s, "composite_score", levels, percentiles=["national", "state"])
    ranked = rank_columns(ranked, {"usage_score": "usage_rank", "money_score": "money_rank"})
    return ranked.withColumn("national_percentile", percent("national_percentile")).withColumn("state_percentile", percent("state_percentile")).drop(
        "usage_score", "money_score", "n_regionkey", "c_nationkey"
    )


@query(
    "rank_any_values",
    f"""select o_orderkey, rank() over (order by o_totalprice desc) as national_rank, count(*) over () as national_total, {rnd('percent_rank() over (order by o_totalprice)', 6)} as national_percentile,
  rank() over (partition by o_orderpriority order by o_totalprice desc) as group_rank, count(*) over (partition by o_orderpriority) as group_total,
  {rnd('percent_rank() over (partition by o_orderpriority order by o_totalprice)', 6)} as group_percentile from orders""",
)
def rank_any_values(spark, d):
    base = table(spark, d, "orders").select("o_orderkey", "o_orderpriority", "o_totalprice")
    out = rank_levels(base, "o_totalprice", {"national": [], "group": ["o_orderpriority"]})
    return out.withColumns({c: round_half_up(c, 6) for c in ("national_percentile", "group_percentile")}).drop("o_orderpriority", "o_totalprice")


@query(
    "percentile_bounds_exact",
    "select " + ", ".join(f"{rnd(f'quantile_cont({c}, {q})', 4)} as {c}_p{int(q * 100)}" for c in ("l_extendedprice", "l_quantity", "l_discount", "l_tax") for q in (0.05, 0.5, 0.95)) + " from lineitem",
)
def percentile_bounds_exact(spark, d):
    out = percentile_bounds(table(spark, d, "lineitem"), ["l_extendedprice", "l_quantity", "l_discount", "l_tax"], (0.05, 0.5, 0.95))
    return out.select(*[round_half_up(c, 4).alias(c) for c in out.columns])


@query(
    "percentile_bounds_bracketed",
    "select " + ", ".join(f"{rnd(f'quantile_cont({c}, {q})', 4)} as {c}_p{int(q * 100)}" for c in ("o_totalprice", "o_custkey") for q in (0.05, 0.95)) + " from orders",
)
def percentile_bounds_bracketed(spark, d):
    """The path for inputs of any size, taken here from 1,000 rows on."""
    out = percentile_bounds(table(spark, d, "orders"), ["o_totalprice", "o_custkey"], accuracy=100)
    return out.select(*[round_half_up(c, 4).alias(c) for c in out.columns])


@query(
    "percentile_bounds_bracketed_groups",
    f"select o_orderpriority, {rnd('quantile_cont(o_totalprice, 0.25)', 4)} as o_totalprice_p25, {rnd('quantile_cont(o_totalprice, 0.75)', 4)} as o_totalprice_p75 from orders group by 1",
)
def percentile_bounds_bracketed_groups(spark, d):
    out = percentile_bounds(table(spark, d, "orders"), ["o_totalprice"], (0.25, 0.75), ["o_orderpriority"], accuracy=100)
    return out.select("o_orderpriority", *[round_half_up(c, 4).alias(c) for c in out.columns[1:]])


@query(
    "percentile_bounds_empty_group",
    f"select n_name, {rnd('quantile_cont(case when n_regionkey > 0 then spend end, 0.25)', 4)} as spend_p25, {rnd('quantile_cont(case when n_regionkey > 0 then spend end, 0.75)', 4)} as spend_p75 from nation left join customer on c_nationkey = n_nationkey left join (select o_custkey, sum(o_totalprice) as spend from orders group by 1) o on o_custkey = c_custkey group by 1",
)
def percentile_bounds_empty_group(spark, d):
    """Nations of one region have no value at all and keep a row of nulls."""
    spend = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.sum("o_totalprice").alias("spend"))
    nation = table(spark, d, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name", "n_regionkey")
    joined = nation.join(table(spark, d, "customer").select("c_custkey", "c_nationkey"), "c_nationkey", "left").join(spend, "c_custkey", "left")
    out = percentile_bounds(joined.withColumn("spend", F.when(F.col("n_regionkey") > 0, F.col("spend"))), ["spend"], (0.25, 0.75), ["n_name"], accuracy=50)
    return out.select("n_name", *[round_half_up(c, 4).alias(c) for c in out.columns[1:]])


@query("percentile_bounds_sketch", "select 'l_extendedprice' as metric, true as p5_close, true as p95_close union all select 'l_quantity', true, true")
def percentile_bounds_sketch(spark, d):
    """Ranks of the sketch's values are within 1 / accuracy of those asked for."""
    lines = table(spark, d, "lineitem").select("l_extendedprice", "l_quantity")
    sketch = percentile_bounds(lines, ["l_extendedprice", "l_quantity"], approx=True, accuracy=1_000)
    tagged = attach_stats(lines, sketch, "s")
    n = F.count(F.lit(1))

    def close(c: str, p: int):
        at = F.col(f"s.{c}_p{p}")
        return (F.count_if(F.col(c) < at) / n <= p / 100 + 0.001) & (F.count_if(F.col(c) <= at) / n >= p / 100 - 0.001)

    names = ("l_extendedprice", "l_quantity")
    checked = tagged.agg(*[close(c, p).alias(f"{c}_{p}") for c in names for p in (5, 95)])
    cells = [F.struct(F.lit(c).alias("metric"), F.col(f"{c}_5").alias("p5_close"), F.col(f"{c}_95").alias("p95_close")) for c in names]
    return checked.select(F.inline(F.array(*cells)))


@query(
    "median_per_group",
    f"select l_suppkey, {rnd('median(l_extendedprice)', 4)} as l_extendedprice, {rnd('median(l_quantity)', 4)} as l_quantity from lineitem group by 1",
)
def median_per_group(spark, d):
    out = grouped_median(table(spark, d, "lineitem"), ["l_suppkey"], ["l_extendedprice", "l_quantity"])
    return out.select("l_suppkey", *[round_half_up(c, 4).alias(c) for c in ("l_extendedprice", "l_quantity")])


@query(
    "normalize_metric_variants",
    f"""select c_custkey, {scaled('c_acctbal', '1000.0', '9000.0')} as plain, {scaled('c_acctbal', '1000.0', '9000.0', True)} as inverted,
  case when c_acctbal <= 5000 then 0.0::double else 100.0::double end as flat, case when c_custkey % 3 = 0 then 0.0::double else 100.0::double end as penalty,
  case when c_custkey % 5 <> 0 then greatest(0.0::double, 100.0 - c_custkey % 40 * 4.0::double) end as linear, 50.0::double as degenerate from customer""",
)
def normalize_metric_variants(spark, d):
    k, x = F.col("c_custkey"), F.col("c_acctbal")
    low, high, mid = F.lit(1000.0), F.lit(9000.0), F.lit(5000.0)
    return table(spark, d, "customer").select(
        "c_custkey",
        sc.normalize_metric(x, low, high).alias("plain"),
        sc.normalize_metric(x, low, high, invert=True).alias("inverted"),
        sc.normalize_metric(x, mid, mid).alias("flat"),
        sc.penalty_score(F.when(k % 3 == 0, True).when(k % 3 == 1, False)).alias("penalty"),
        sc.linear_score(F.when(k % 5 != 0, k % 40), 4).alias("linear"),
        sc.normalize_metric(x, mid, mid, degenerate=50.0).alias("degenerate"),
    )


@query(
    "score_labels",
    f"""select o_orderkey, {labelled('s')} as category, case when s is null then null when s <= 25 then 'Critical' when s <= 50 then 'At Risk' when s <= 75 then 'Moderate' else 'Thriving' end as band,
  case when ch > 10 then 'Improving' when ch < -10 then 'Declining' else 'Stable' end as trend, case when ch > 10 then 'Declining' when ch < -10 then 'Improving' else 'Stable' end as inverse_trend,
  case when ch > 0 then 'improvement' when ch < 0 then 'decline' end as kind, s is null or coalesce(ch < 60, false) as low_confidence
from (select o_orderkey, case when o_custkey % 10 = 0 then null else {rnd('o_totalprice / 5000')} end as s, case when o_custkey % 7 = 0 then null else (o_custkey % 61 - 30)::double end as ch from orders) q""",
)
def score_labels(spark, d):
    k = F.col("o_custkey")
    base = table(spark, d, "orders").select(
        "o_orderkey",
        F.when(k % 10 != 0, round_half_up(F.col("o_totalprice") / 5000, 2)).alias("s"),
        F.when(k % 7 != 0, (k % 61 - 30).cast("double")).alias("ch"),
    )
    return base.select(
        "o_orderkey",
        sc.score_category("s").alias("category"),
        sc.score_band("s").alias("band"),
        sc.direction("ch", 10).alias("trend"),
        sc.direction("ch", 10, invert=True).alias("inverse_trend"),
        sc.signed_label("ch").alias("kind"),
        sc.low_confidence("s", "ch").alias("low_confidence"),
    )


@query(
    "best_and_worst_pillar",
    ENTITY_SCORES
    + """select c_custkey, case when coalesce(money_score, 0) >= greatest(coalesce(usage_score, 0), coalesce(order_score, 0)) then 'Money' when coalesce(usage_score, 0) >= coalesce(order_score, 0) then 'Usage' else 'Order' end as best,
  case when coalesce(money_score, 0) <= least(coalesce(usage_score, 0), coalesce(order_score, 0)) then 'Money' when coalesce(usage_score, 0) <= coalesce(order_score, 0) then 'Usage' else 'Order' end as worst,
  """
    + rnd("greatest(coalesce(money_score, 0), coalesce(usage_score, 0), coalesce(order_score, 0)) - least(coalesce(money_score, 100), coalesce(usage_score, 100), coalesce(order_score, 100))", 1)
    + " as width from scores",
)
def best_and_worst_pillar(spark, d):
    pillars = {"Money": "money_score", "Usage": "usage_score", "Order": "order_score"}
    return entity_scores(spark, d).select(
        "c_custkey",
        sc.argmax_label(pillars, null_as=0).alias("best"),
        sc.argmin_label(pillars, null_as=0).alias("worst"),
        round_half_up(sc.spread(list(pillars.values())), 1).alias("width"),
    )


@query(
    "change_zscore",
    f"""select c_custkey, case when sd > 0 then {rnd('(c_acctbal - mu) / sd')} else 0.0::double end as z, coalesce(sd > 0 and abs((c_acctbal - mu) / sd) > 1.5, false) as flagged
from (select *, avg(c_acctbal) over () as mu, stddev(c_acctbal) over () as sd from customer) q""",
)
def zscore_of_change(spark, d):
    return change_zscore(table(spark, d, "customer"), "c_acctbal", "z", "flagged", 1.5).select("c_custkey", "z", "flagged")


@query(
    "latest_per_key",
    "select o_custkey, o_orderkey, o_totalprice from orders qualify row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey desc) = 1",
)
def latest(spark, d):
    return latest_per_key(table(spark, d, "orders"), "o_custkey", ["o_orderdate", "o_orderkey"]).select("o_custkey", "o_orderkey", "o_totalprice")


@query(
    "latest_per_key_filtered",
    "select o_custkey, o_orderkey, o_totalprice from orders where o_totalprice is null or o_totalprice >= 100000 qualify row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey desc) = 1",
)
def latest_filtered(spark, d):
    from indicraft.functions.predicates import null_or_at_least

    where = null_or_at_least("o_totalprice", 100000)
    return latest_per_key(table(spark, d, "orders"), "o_custkey", ["o_orderdate", "o_orderkey"], where).select("o_custkey", "o_orderkey", "o_totalprice")


@query(
    "dedup_first_ordered",
    "select text, doc_id, source from (select left(md5(text), 12) as text, doc_id, source from documents) q qualify row_number() over (partition by text order by doc_id) = 1",
)
def dedup_ordered(spark, d):
    docs = table(spark, d, "documents").select(F.substring(F.md5("text"), 1, 12).alias("text"), "doc_id", "source")
    return dedup_first(docs, "text", [F.col("doc_id")])


@query(
    "top_rows_per_group",
    "select c_nationkey, c_custkey, c_acctbal, row_number() over (partition by c_nationkey order by c_acctbal desc, c_custkey) as place from customer qualify place <= 5",
)
def top_rows(spark, d):
    order = [F.col("c_acctbal").desc(), F.col("c_custkey")]
    return topk_per_group(table(spark, d, "customer"), "c_nationkey", order, 5, "place").select("c_nationkey", "c_custkey", "c_acctbal", "place")


YEARLY = "select o_custkey, year(o_orderdate) as yr, count(*) as n, cast(sum(cast(round(o_totalprice * 100) as bigint)) / 100.0 as double) as spend from {orders} group by o_custkey, year(o_orderdate)"


@query(
    "lagged_values",
    f"select a.o_custkey, cast(a.yr as integer) as yr, "
    + ", ".join(f"l{k}.{c} as {c}_lag{k}" for c in ("n", "spend") for k in (1, 2, 3))
    + f" from {duck(YEARLY)} a "
    + " ".join(f"left join {duck(YEARLY)} l{k} on l{k}.o_custkey = a.o_custkey and l{k}.yr = a.yr - {k}" for k in (1, 2, 3)),
)
def lagged_values(spark, d):
    out = lag_features(shared(spark, d, YEARLY), "o_custkey", "yr", ["n", "spend"])
    return out.drop("n", "spend")


@query(
    "rolling_mean_three",
    f"select o_custkey, cast(yr as integer) as yr, {rnd('avg(spend) over (partition by o_custkey order by yr range between 2 preceding and current row)', 4)} as spend_mean3 from {duck(YEARLY)} q",
)
def rolling_three(spark, d):
    out = rolling_mean(shared(spark, d, YEARLY), "o_custkey", "yr", ["spend"])
    return out.select("o_custkey", "yr", round_half_up("spend_mean3", 4).alias("spend_mean3"))


@query(
    "state_ranking",
    ENTITY_SCORES
    + f"""select n_regionkey, school_count, avg_score, min_score, max_score, critical_schools, rank() over (order by avg_score desc) as state_rank from (
  select n_regionkey, count(*) as school_count, {rnd('avg(composite_score)', 1)} as avg_score, {rnd('min(composite_score)', 1)} as min_score, {rnd('max(composite_score)', 1)} as max_score,
    count(*) filter (composite_score <= 25) as critical_schools from scores group by 1) q""",
)
def rank_states(spark, d):
    return state_ranking(entity_scores(spark, d), "n_regionkey", "composite_score")


@query(
    "global_statistics_attached",
    f"select c_custkey, {rnd('c_acctbal - avg(c_acctbal) over ()', 4)} as off_mean, count(*) over () as total from customer",
)
def global_statistics(spark, d):
    cust = table(spark, d, "customer")
    stats = cust.agg(F.avg("c_acctbal").alias("mean"), F.count(F.lit(1)).alias("rows"))
    out = attach_stats(cust, stats, "_s")
    return out.select("c_custkey", round_half_up(F.col("c_acctbal") - F.col("_s.mean"), 4).alias("off_mean"), F.col("_s.rows").alias("total"))


@query(
    "sql_functions",
    f"""select c_custkey, lpad(c_custkey::varchar, 5, '0') as padded, left(lpad((c_custkey + 1001020000)::varchar, 11, '0'), 5) as county, {scaled('c_acctbal', '1000.0', '9000.0')} as placed,
  {scaled('c_acctbal', '1000.0', '9000.0', True)} as inverted, {labelled('(c_acctbal / 100)')} as category,
  {blended('ed .3, he .3, en .2, sa .2')} as composite
from (select *, case when c_custkey % 3 = 0 then null else c_acctbal / 100 end as ed, c_acctbal / 200 as he, 50.0::double as en, null::double as sa from customer) q""",
)
def sql_functions(spark, d):
    from indicraft.functions.sql_functions import register_sql_functions

    register_sql_functions(spark)
    return table(spark, d, "customer").selectExpr(
        "c_custkey",
        "pad_code(cast(c_custkey as string), 5) as padded",
        "tract_to_county(cast(c_custkey + 1001020000 as string)) as county",
        "normalize_metric(c_acctbal, 1000, 9000) as placed",
        "normalize_metric_inverted(c_acctbal, 1000, 9000) as inverted",
        "score_category(c_acctbal / 100) as category",
        "composite_score(if(c_custkey % 3 = 0, null, c_acctbal / 100), c_acctbal / 200, 50, cast(null as double)) as composite",
    )
