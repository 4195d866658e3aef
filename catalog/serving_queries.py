"""Read queries over the gold tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from indicraft.functions.cleaning import round_half_up
from indicraft.functions.predicates import build_filters
from indicraft.operators import serving as sv
from indicraft.operators.aggregates import category_counts, value_counts
from indicraft.operators.page_index import PageIndex
from indicraft.session import scratch_path

from . import model_sql as sql
from .base import query, rnd, table
from .gold_tables import medallion

BAND = "case when wellbeing_score <= 25 then 'Critical' when wellbeing_score <= 50 then 'At Risk' when wellbeing_score <= 75 then 'Moderate' else 'Thriving' end"
SCHOOL = "nces_school_id, school_name, state_abbr, wellbeing_score, total_enrollment"
SCHOOL_COLS = SCHOOL.split(", ")


@query("serve_school_list", sql.gold(f"select {SCHOOL}, {BAND} as category from scores where wellbeing_score between 20 and 60 and state_abbr = 'AS' order by wellbeing_score, nces_school_id limit 20 offset 20"))
def school_list(spark, d):
    s = medallion(spark, d).scores.select(*SCHOOL_COLS)
    filters = dict(equals={"state_abbr": "AS", "school_name": None}, at_least={"wellbeing_score": 20}, at_most={"wellbeing_score": 60})
    return sv.entity_list(s, "wellbeing_score", "nces_school_id", 2, 20, **filters)


@query("serve_page_counts", sql.gold("select count(*) as total, ceil(count(*) / 50.0)::bigint as pages from scores where wellbeing_score <= 50"))
def page_counts(spark, d):
    s = medallion(spark, d).scores.filter(build_filters(at_most={"wellbeing_score": 50}))
    return sv.page(s, [F.col("wellbeing_score"), F.col("nces_school_id")])[1]


@query("serve_keyset_page", sql.gold(f"select {SCHOOL} from scores where wellbeing_score > 45.5 or (wellbeing_score = 45.5 and nces_school_id > '000000000100') order by wellbeing_score, nces_school_id limit 30"))
def keyset(spark, d):
    s = medallion(spark, d).scores.select(*SCHOOL_COLS)
    return sv.page_after(s, "wellbeing_score", "nces_school_id", (45.5, "000000000100"), 30)


@query("serve_school_detail", sql.gold("select s.nces_school_id, s.wellbeing_score, r.national_rank, r.state_rank, p.math_proficiency_pct, x.child_poverty_rate from scores s join rankings r using (nces_school_id) join profiles p using (nces_school_id) join health x using (nces_school_id) where nces_school_id = '000000000003'").replace("x.child_poverty_rate from", f"{rnd('x.child_poverty_rate', 4)} as child_poverty_rate from"))
def detail(spark, d):
    m = medallion(spark, d)
    key = "nces_school_id"
    one = sv.entity_detail(m.scores.select(key, "wellbeing_score"), key, "000000000003")
    out = one.join(m.rankings.select(key, "national_rank", "state_rank"), key).join(m.wide.select(key, "math_proficiency_pct", "child_poverty_rate"), key)
    return out.withColumn("child_poverty_rate", round_half_up("child_poverty_rate", 4))


@query("serve_ranking_list", sql.gold("select s.nces_school_id, s.school_name, s.wellbeing_score, r.state_rank from scores s join rankings r using (nces_school_id) where s.state_abbr = 'EU' order by r.state_rank, nces_school_id limit 25"))
def ranking(spark, d):
    m = medallion(spark, d)
    return sv.ranking_list(m.rankings, m.scores, "nces_school_id", "state_rank", ["school_name", "wellbeing_score"], 1, 25, equals={"state_abbr": "EU"})


@query("serve_anomaly_list", sql.gold("select nces_school_id, education_change_zscore, case when combined_education_change > 0 then 'improvement' when combined_education_change < 0 then 'decline' end as kind from trends order by abs(education_change_zscore) desc, nces_school_id limit 30"))
def anomalies(spark, d):
    from indicraft.functions.scoring import signed_label

    t = medallion(spark, d).trends.withColumn("kind", signed_label("combined_education_change"))
    return sv.by_magnitude(t, "education_change_zscore", "nces_school_id", 30).select("nces_school_id", "education_change_zscore", "kind")


@query("serve_search", sql.gold(f"select {SCHOOL} from scores where (school_name ilike '%#00000001%' or county_name ilike '%nation_1%' or state_abbr ilike '%am%') and state_abbr <> 'ZZ'".replace("%nation_1%", "%nation\\_1%").replace("ilike '%nation\\_1%'", "ilike '%nation\\_1%' escape '\\'")))
def search(spark, d):
    s = medallion(spark, d).scores
    parts = [sv.search(s, t, [c]) for t, c in (("#00000001", "school_name"), ("Nation_1", "county_name"), ("aM", "state_abbr"))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).select(*SCHOOL_COLS).distinct()


@query("serve_search_any_column", "select p_partkey, p_name, p_brand from part where p_name ilike '%RED%' or p_brand ilike '%RED%' or p_type ilike '%RED%'")
def search_any(spark, d):
    return sv.search(table(spark, d, "part"), "RED", ["p_name", "p_brand", "p_type"]).select("p_partkey", "p_name", "p_brand")


@query("serve_county_list", sql.gold(f"select county_fips, county_name, avg_wellbeing_score, total_school_count from summary where total_school_count >= 30 order by avg_wellbeing_score, county_fips limit 10"))
def counties(spark, d):
    c = medallion(spark, d).counties.select("county_fips", "county_name", "avg_wellbeing_score", "total_school_count")
    return sv.entity_list(c, "avg_wellbeing_score", "county_fips", 1, 10, at_least={"total_school_count": 30}).drop("category")


def _briefs(spark, d):
    """Nations with recent large customers have a written brief; some have several versions."""
    o = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("c_custkey") == F.col("o_custkey"))
    n = table(spark, d, "nation")
    return (
        o.filter("o_totalprice > 490000")
        .join(n, F.col("n_nationkey") == F.col("c_nationkey"))
        .select(
            F.concat(F.lpad((F.col("n_regionkey") + 1).cast("string"), 2, "0"), F.lpad(F.col("n_nationkey").cast("string"), 3, "0")).alias("county_fips"),
            F.concat(F.lit("brief "), F.col("o_orderkey").cast("string")).alias("brief_text"),
            (F.unix_timestamp(F.col("o_orderdate").cast("timestamp")) * 1000000 + F.col("o_orderkey")).alias("generated_at"),
        )
    )


BRIEFS = """(select lpad((n_regionkey + 1)::varchar, 2, '0') || lpad(n_nationkey::varchar, 3, '0') as county_fips, 'brief ' || o_orderkey as brief_text, epoch(o_orderdate)::bigint * 1000000 + o_orderkey as generated_at
  from orders join customer on c_custkey = o_custkey join nation on n_nationkey = c_nationkey where o_totalprice > 490000)"""
LATEST_BRIEF = f"(select county_fips, brief_text from {BRIEFS} b qualify row_number() over (partition by county_fips order by generated_at desc) = 1)"


@query("serve_county_detail", sql.gold(f"select county_fips, avg_wellbeing_score, national_rank, total_counties, brief_text from summary left join {LATEST_BRIEF} l using (county_fips)"))
def county_detail(spark, d):
    c = medallion(spark, d).counties.select("county_fips", "avg_wellbeing_score", "national_rank", "total_counties")
    return sv.county_detail(c, _briefs(spark, d))


@query("serve_schools_of_counties", sql.gold("select county_fips, nces_school_id, wellbeing_score, row_number() over (partition by county_fips order by wellbeing_score, nces_school_id) as place from scores qualify place <= 50"))
def schools_of_counties(spark, d):
    s = medallion(spark, d).scores.select("county_fips", "nces_school_id", "wellbeing_score")
    return sv.worst_per_area(s, "county_fips", "wellbeing_score", "nces_school_id", 50)


@query("serve_platform_stats", sql.gold(f"select count(*) as total_schools, count(distinct county_fips) as total_counties, {rnd('avg(wellbeing_score)', 1)} as avg_score, {rnd('min(wellbeing_score)', 1)} as min_score, {rnd('max(wellbeing_score)', 1)} as max_score, count(*) filter (wellbeing_score <= 25) as critical_count, count(*) filter (wellbeing_score > 25 and wellbeing_score <= 50) as at_risk_count, count(*) filter (wellbeing_score > 50 and wellbeing_score <= 75) as moderate_count, count(*) filter (wellbeing_score > 75) as thriving_count from scores"))
def stats(spark, d):
    return sv.platform_stats(medallion(spark, d).scores, "wellbeing_score", "county_fips")


@query("serve_pillar_means", sql.gold(f"select {rnd('avg(education_score)', 1)} as education, {rnd('avg(health_score)', 1)} as health, {rnd('avg(environment_score)', 1)} as environment, {rnd('avg(safety_score)', 1)} as safety from scores"))
def pillars(spark, d):
    return sv.pillar_means(medallion(spark, d).scores, {p: f"{p}_score" for p in ("education", "health", "environment", "safety")})


@query("serve_map_areas", sql.gold(f"select county_fips, {rnd('avg(latitude)', 4)} as centroid_lat, {rnd('avg(longitude)', 4)} as centroid_lon, {rnd('avg(wellbeing_score)')} as avg_score, count(*) as row_count from scores where wellbeing_score between 30 and 70 group by 1"))
def map_areas(spark, d):
    return sv.area_markers(medallion(spark, d).scores, "county_fips", "latitude", "longitude", "wellbeing_score", 30, 70)


@query("serve_gap_counts", sql.gold("select intervention_priority, weakest_pillar, count(*) as row_count from gaps group by 1, 2"))
def gap_counts(spark, d):
    return value_counts(medallion(spark, d).gaps, "intervention_priority", "weakest_pillar")


@query("serve_gaps_by_state", sql.gold("select state_abbr, count(*) filter (intervention_priority = 'High Priority') as high, count(*) filter (intervention_priority = 'Critical Need') as critical from gaps group by 1"))
def gaps_by_state(spark, d):
    return category_counts(medallion(spark, d).gaps, ["state_abbr"], "intervention_priority", {"High Priority": "high", "Critical Need": "critical"})


@query("serve_resource_gap_page", sql.gold("select nces_school_id, gap_count, pillar_spread from gaps order by gap_count desc, pillar_spread desc, nces_school_id limit 40"))
def gap_page(spark, d):
    g = medallion(spark, d).gaps.select("nces_school_id", "gap_count", "pillar_spread")
    return sv.page(g, [F.col("gap_count").desc(), F.col("pillar_spread").desc(), F.col("nces_school_id")], 1, 40)[0]


@query("serve_top_movers", sql.gold("select * from ((select nces_school_id, math_proficiency_change, 'up' as direction from trends where math_proficiency_change > 0 order by math_proficiency_change desc, nces_school_id limit 10) union all (select nces_school_id, math_proficiency_change, 'down' from trends where math_proficiency_change < 0 order by math_proficiency_change, nces_school_id limit 10)) m").replace("select nces_school_id, math_proficiency_change,", f"select nces_school_id, {rnd('math_proficiency_change', 4)} as math_proficiency_change,"))
def movers(spark, d):
    t = medallion(spark, d).trends.select("nces_school_id", "math_proficiency_change")
    return sv.top_movers(t, "math_proficiency_change", "nces_school_id").withColumn("math_proficiency_change", round_half_up("math_proficiency_change", 4))


@query("serve_best_and_worst", sql.gold("select * from ((select county_fips, avg_wellbeing_score, 'top' as side from summary order by avg_wellbeing_score desc, county_fips limit 10) union all (select county_fips, avg_wellbeing_score, 'bottom' from summary order by avg_wellbeing_score, county_fips limit 10)) b"))
def extremes(spark, d):
    c = medallion(spark, d).counties.select("county_fips", "avg_wellbeing_score")
    return sv.best_and_worst(c, "avg_wellbeing_score", "county_fips")


@query("serve_top_groups_series", "select c_mktsegment, yr, n from (select c_mktsegment, cast(year(o_orderdate) as integer) as yr, count(*) as n from orders join customer on c_custkey = o_custkey group by 1, 2) s where c_mktsegment in (select c_mktsegment from customer group by 1 order by avg(c_acctbal) desc, 1 limit 3)")
def top_groups(spark, d):
    c = table(spark, d, "customer")
    keep = sv.top_groups(c, "c_mktsegment", "c_acctbal", 3).select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment")
    return table(spark, d, "orders").join(keep, "o_custkey").groupBy("c_mktsegment", F.year("o_orderdate").alias("yr")).agg(F.count(F.lit(1)).alias("n"))


@query("serve_compare", sql.gold("select nces_school_id, wellbeing_score, education_score from scores where nces_school_id in ('000000000001', '000000000003', '000000000009')"))
def compare(spark, d):
    return sv.compare(medallion(spark, d).scores, "nces_school_id", ["000000000001", "000000000003", "000000000009"]).select("nces_school_id", "wellbeing_score", "education_score")


@query(
    "serve_county_report",
    sql.gold(
        f"""select m.county_fips, m.avg_wellbeing_score, s.low_ids, g.gap_ids, b.brief_text from summary m
left join (select county_fips, string_agg(nces_school_id, ',' order by wellbeing_score, nces_school_id) as low_ids from (select * from scores qualify row_number() over (partition by county_fips order by wellbeing_score, nces_school_id) <= 50) x group by 1) s using (county_fips)
left join (select county_fips, string_agg(nces_school_id, ',' order by gap_count desc, pillar_spread desc, nces_school_id) as gap_ids from (select * from gaps qualify row_number() over (partition by county_fips order by gap_count desc, pillar_spread desc, nces_school_id) <= 20) y group by 1) g using (county_fips)
left join {LATEST_BRIEF} b using (county_fips)"""
    ),
)
def county_report(spark, d):
    m = medallion(spark, d)
    out = sv.report_dataset(m.counties.select("county_fips", "avg_wellbeing_score"), m.scores, m.gaps, _briefs(spark, d))
    ids = lambda c: F.array_join(F.col(f"{c}.nces_school_id"), ",")
    return out.select("county_fips", "avg_wellbeing_score", ids("schools").alias("low_ids"), ids("gaps").alias("gap_ids"), "brief_text")


@query("serve_brief_queue", sql.gold(f"select county_fips from summary where county_fips not in (select county_fips from {BRIEFS} b where generated_at >= 950000000000000)"))
def brief_queue(spark, d):
    return sv.brief_queue(medallion(spark, d).counties.select("county_fips"), _briefs(spark, d), "county_fips", F.lit(950000000000000))


@query(
    "serve_prediction_list",
    "select c_custkey, p as predicted_change, p < -5 as risk_flag from (select c_custkey, c_nationkey, c_acctbal / 200 - 20 as p from customer) q where p < -5 and c_nationkey = 4 order by p, c_custkey limit 50",
)
def predictions(spark, d):
    from indicraft.operators.model import risk_and_level

    p = table(spark, d, "customer").select("c_custkey", "c_nationkey", (F.col("c_acctbal") / 200 - 20).alias("predicted_change"), F.lit(50.0).alias("now"))
    kept = risk_and_level(p, "predicted_change", "now").filter(build_filters(equals={"c_nationkey": 4}, is_true=["risk_flag"]))
    return sv.page(kept, [F.col("predicted_change"), F.col("c_custkey")])[0].select("c_custkey", "predicted_change", "risk_flag")


@query("serve_confident_flags", "select doc_id, quality, toxic, n_chars / 20000.0::double as confidence from labels join documents using (doc_id) where n_chars / 20000.0 >= 0.1 order by confidence desc, doc_id limit 100")
def confident_flags(spark, d):
    """Flags joined to their entity, above a confidence threshold, strongest first."""
    docs = table(spark, d, "documents").select("doc_id", (F.col("n_chars") / 20000.0).alias("confidence"))
    flags = table(spark, d, "labels").join(docs, "doc_id").filter(build_filters(at_least={"confidence": 0.1}))
    return sv.page(flags, [F.col("confidence").desc(), F.col("doc_id")], 1, 100)[0].select("doc_id", "quality", "toxic", "confidence")


@query("serve_chosen_sort", sql.gold("select nces_school_id, total_enrollment from scores order by total_enrollment desc nulls last, nces_school_id limit 25"))
def chosen_sort(spark, d):
    s = medallion(spark, d).scores.select("nces_school_id", "total_enrollment")
    return sv.page(s, [sv.sort_key("total_enrollment", ["wellbeing_score", "total_enrollment"], descending=True), F.col("nces_school_id")], 1, 25)[0]


@query("serve_school_trend", "select cast(school_year as integer) as yr, cast(sum(total_enrollment) as bigint) as enrollment, count(*) as schools from (" + sql.STG["schools"] + ") s group by 1")
def school_trend(spark, d):
    from .gold_tables import staged

    s = staged(spark, d, "schools")
    return s.groupBy(F.col("school_year").cast("int").alias("yr")).agg(F.sum("total_enrollment").alias("enrollment"), F.count(F.lit(1)).alias("schools"))


@query(
    "filter_conditions",
    """select o_orderkey from orders where o_orderstatus = 'F' and o_totalprice between 50000 and 400000 and o_orderpriority in ('1-URGENT', '2-HIGH')
  and (o_totalprice is null or o_totalprice >= 60000) and lower(o_orderpriority) not like '%low%' and o_orderkey >= 5""",
)
def filter_conditions(spark, d):
    from indicraft.functions.predicates import lacks_text, null_or_at_least

    cond = build_filters(
        equals={"o_orderstatus": "F", "o_custkey": None},
        at_least={"o_orderkey": 5},
        between={"o_totalprice": (50000, 400000)},
        member_of={"o_orderpriority": ["1-URGENT", "2-HIGH"]},
    )
    return table(spark, d, "orders").filter(cond & null_or_at_least("o_totalprice", 60000) & lacks_text("o_orderpriority", "LOW")).select("o_orderkey")


ORDER_COLS = "o_orderkey, o_custkey, o_totalprice, o_orderpriority"


@query("serve_index_last_page", f"select {ORDER_COLS} from orders order by o_totalprice desc, o_orderkey limit 50 offset (select (count(*) - 1) // 50 * 50 from orders)")
def index_last_page(spark, d):
    """The last page of all orders, read from one slice."""
    o = table(spark, d, "orders").select(*ORDER_COLS.split(", "))
    index = PageIndex.build(o, scratch_path(spark, "pages"), {"o_totalprice": True, "o_orderkey": False}, slice_rows=20_000)
    return index.page(index.pages(50), 50)


@query(
    "serve_index_group_pages",
    f"""select {ORDER_COLS}, place // 40 + 1 as page from (select *, row_number() over (partition by o_orderpriority order by o_totalprice desc, o_orderkey) - 1 as place, count(*) over (partition by o_orderpriority) as total from orders) q
where place // 40 + 1 = greatest(1, (total + 39) // 40 // 2)""",
)
def index_group_pages(spark, d):
    """The middle page of each priority: groups have page numbers of their own."""
    o = table(spark, d, "orders").select(*ORDER_COLS.split(", "))
    index = PageIndex.build(o, scratch_path(spark, "pages"), {"o_totalprice": True, "o_orderkey": False}, ["o_orderpriority"], slice_rows=20_000)
    out = None
    for (priority,) in sorted(o.select("o_orderpriority").distinct().collect()):
        number = max(1, index.pages(40, o_orderpriority=priority) // 2)
        page = index.page(number, 40, o_orderpriority=priority).withColumn("page", F.lit(number).cast("bigint"))
        out = page if out is None else out.unionByName(page)
    return out
