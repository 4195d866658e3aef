"""Hexagonal cells, the vector index, stored statistics and the versioned table."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import functions as F

from indicraft.functions import hexgrid as hx
from indicraft.functions.cleaning import round_half_up
from indicraft.operators import retrieval as rt
from indicraft.operators import vector_index as vi
from indicraft.operators.stored_stats import StatsStore
from indicraft.operators.text_index import TextIndex
from indicraft.session import scratch_path
from indicraft.sources.excel import ExcelSource
from indicraft.sources.versioned import VersionedTable

from .base import duck, query, rnd, shared, table
from .text_geo import CUSTOMER_PLACES, HITS, SUPPLIER_PLACES, _centroids


def hex_sql(places: str, key: str, resolution: int) -> str:
    """(key, q, r) of the positions of `places`, by the formulas of the plane and the lattice."""
    side, turn = hx.cell_side(resolution), resolution * hx.TURN
    flat = math.cos(hx.TRUE_LATITUDE)
    return f"""(select {key}, case when far_q then -rr - rs else rq end::bigint as q, case when not far_q and dr > ds then -rq - rs else rr end::bigint as r from (
  select *, dq > dr and dq > ds as far_q from (
  select *, abs(rq - fq) as dq, abs(rr - fr) as dr, abs(rs - fs) as ds from (
  select *, floor(fq + 0.5::double) as rq, floor(fr + 0.5::double) as rr, floor(fs + 0.5::double) as rs from (
  select *, -fq - fr as fs from (
  select *, px / {math.sqrt(3) * side!r}::double - fr / 2 as fq from (
  select *, py / {1.5 * side!r}::double as fr from (
  select {key}, east * {math.cos(turn)!r}::double - north * {math.sin(turn)!r}::double as px, east * {math.sin(turn)!r}::double + north * {math.cos(turn)!r}::double as py from (
  select {key}, radians(longitude) * {6371.0 * flat!r}::double as east, sin(radians(latitude)) * {6371.0 / flat!r}::double as north from {duck(places)} p)))))))))"""


def parent_sql(cells: str, key: str) -> str:
    """(key, q, r, pq, pr): cells with their parents, by cube rounding of sevenths."""
    return f"""(select {key}, q, r, case when dq > dr and dq > ds then -rr - rs else rq end::bigint as pq, case when not (dq > dr and dq > ds) and dr > ds then -rq - rs else rr end::bigint as pr from (
  select *, abs(rq - fq) as dq, abs(rr - fr) as dr, abs(rs - fs) as ds from (
  select *, floor(fq + 0.5::double) as rq, floor(fr + 0.5::double) as rr, floor(fs + 0.5::double) as rs from (
  select {key}, q, r, (3 * q + r) / 7.0::double as fq, (2 * r - q) / 7.0::double as fr, -((3 * q + r) / 7.0::double) - (2 * r - q) / 7.0::double as fs from {cells} c))))"""


_SIDE7, _TURN7 = hx.cell_side(7), 7 * hx.TURN
_FLAT = math.cos(hx.TRUE_LATITUDE)


@query(
    "geo_hex_cells",
    f"""select c_custkey, q, r, pq as parent_q, pr as parent_r,
  {rnd(f"degrees(asin(greatest(-1, least(1, (py * {math.cos(_TURN7)!r}::double - px * {math.sin(_TURN7)!r}::double) * {_FLAT / 6371.0!r}::double))))", 4)} as center_lat,
  {rnd(f"degrees((px * {math.cos(_TURN7)!r}::double + py * {math.sin(_TURN7)!r}::double) / {6371.0 * _FLAT!r}::double)", 4)} as center_lon, 19 as ring_cells, 2::bigint as ring_steps
from (select *, {_SIDE7 * math.sqrt(3)!r}::double * (q + r / 2.0::double) as px, {_SIDE7 * 1.5!r}::double * r as py from {parent_sql(hex_sql(CUSTOMER_PLACES, "c_custkey", 7), "c_custkey")} a) b""",
)
def hex_cells(spark, d):
    p = shared(spark, d, CUSTOMER_PLACES).select("c_custkey", hx.hex_cell("latitude", "longitude", 7).alias("cell"))
    p = p.withColumns({"at": hx.hex_parts("cell"), "up": hx.hex_parts(hx.hex_parent("cell", 6)), "m": hx.hex_center("cell"), "ring": hx.hex_ring("cell", 2)})
    steps = F.array_max(F.transform("ring", lambda n: hx.hex_distance("cell", n)))
    return p.select(
        "c_custkey", "at.q", "at.r", F.col("up.q").alias("parent_q"), F.col("up.r").alias("parent_r"), round_half_up("m.lat", 4).alias("center_lat"),
        round_half_up("m.lon", 4).alias("center_lon"), F.size(F.array_distinct("ring")).alias("ring_cells"), steps.alias("ring_steps"),
    )


@query(
    "geo_hex_nearby",
    f"""with c as (select q, r, count(*) as n_left from {hex_sql(CUSTOMER_PLACES, "c_custkey", 4)} a group by 1, 2), s as (select q, r, count(*) as n from {hex_sql(SUPPLIER_PLACES, "s_suppkey", 4)} a group by 1, 2),
m as (select * from (values (0, 0), (1, 0), (-1, 0), (0, 1), (0, -1), (1, -1), (-1, 1)) v(dq, dr))
select c.q, c.r, c.n_left, coalesce(sum(s.n), 0)::bigint as n_right from c cross join m left join s on s.q = c.q + dq and s.r = c.r + dr group by 1, 2, 3""",
)
def hex_nearby(spark, d):
    near = hx.hex_nearby(shared(spark, d, CUSTOMER_PLACES), shared(spark, d, SUPPLIER_PLACES), "latitude", "longitude", 4)
    return near.withColumn("at", hx.hex_parts("cell")).select("at.q", "at.r", "n_left", "n_right")


def _index(spark, d):
    e = table(spark, d, "embeddings")
    return e, vi.write_index(e, scratch_path(spark, "vector-index"), "vec_id", lists=32)


@query("vector_index_topk", f"select q_label, vec_id, {rnd('score', 6)} as score, place from {HITS} h")
def index_topk(spark, d):
    _, index = _index(spark, d)
    out = vi.search(index, _centroids(spark, d), "q_label", "vec_id", probes=4, exact=True)
    return out.select("q_label", "vec_id", round_half_up("score", 6).alias("score"), "place")


_ROW_HITS = """(select q.vec_id as q_id, e.vec_id from embeddings q, embeddings e where q.vec_id % 100 = 0
  and list_dot_product(q.embedding::double[], e.embedding::double[]) / sqrt(list_dot_product(q.embedding::double[], q.embedding::double[])) / sqrt(list_dot_product(e.embedding::double[], e.embedding::double[])) >= 0.35
  qualify row_number() over (partition by q.vec_id order by list_dot_product(q.embedding::double[], e.embedding::double[]) / sqrt(list_dot_product(e.embedding::double[], e.embedding::double[])) desc, e.vec_id) <= 20)"""


@query("vector_index_recall", f"select count(*) as wanted, true as recall_reached, (select count(*) from embeddings) as indexed, true as reads_less from {_ROW_HITS} h")
def index_recall(spark, d):
    """Recall of 20 of 32 lists against the exact search, for every row whose id is divisible by 100. These vectors have no
    clusters, so most lists must be read; clustered ones need few (see the tests)."""
    e, index = _index(spark, d)
    queries = e.filter("vec_id % 100 = 0").select(F.col("vec_id").alias("q_id"), "embedding")
    truth = rt.cosine_topk(queries, e, "q_id", "vec_id")
    found = vi.search(index, queries, "q_id", "vec_id", probes=20)
    one = np.array(queries.orderBy("q_id").select(rt.l2_normalize("embedding")).first()[0])
    # what one search reads: folders of other lists are pruned
    less = vi.rows_read(index, vi.probed(index, one[None, :], 20)) < int(index.sizes.sum())
    totals = truth.agg(F.count("*").alias("wanted"))
    reached = (vi.recall(found, truth, "q_id", "vec_id") >= 0.9).alias("recall_reached")
    return totals.select("wanted", reached, index.vectors().agg(F.count("*")).scalar().alias("indexed"), F.lit(less).alias("reads_less"))


_METRICS = ("o_totalprice", "o_custkey")


def _yearly(spark, d):
    """Statistics of all order years, added year by year."""
    orders = table(spark, d, "orders")
    store = StatsStore(spark, scratch_path(spark, "order-stats"))
    years = sorted(r[0] for r in orders.select(F.year("o_orderdate")).distinct().collect() if r[0] is not None)
    for y in years:
        store.add(orders.filter(F.year("o_orderdate") == y), str(y), list(_METRICS))
    return store


@query(
    "stored_percentiles",
    " union all ".join(f"select '{m}' as metric, {q}::double as q, {rnd(f'quantile_cont({m}::double, {q})', 4)} as value from orders" for m in _METRICS for q in (0.05, 0.5, 0.95)),
)
def stored_percentiles(spark, d):
    return _yearly(spark, d).percentiles((0.05, 0.5, 0.95)).select("metric", "q", round_half_up("value", 4).alias("value"))


@query("stored_distinct", " union all ".join(f"select '{m}' as metric, count({m}) as n, count(distinct {m}) as n_exact, true as estimate_near from orders" for m in _METRICS))
def stored_distinct(spark, d):
    got = _yearly(spark, d).distinct()
    orders = table(spark, d, "orders")
    exact = None
    for m in _METRICS:
        one = orders.agg(F.countDistinct(m).alias("n_exact")).withColumn("metric", F.lit(m))
        exact = one if exact is None else exact.unionByName(one)
    return got.join(exact, "metric").select("metric", "n", "n_exact", (F.abs(F.col("n_distinct") - F.col("n_exact")) <= 0.04 * F.col("n_exact")).alias("estimate_near"))


def _merged(spark, d) -> VersionedTable:
    """Orders in 16 buckets, then two merges: new prices and new orders in buckets 3 and 5, and others in bucket 5."""
    orders = table(spark, d, "orders").select("o_orderkey", F.col("o_totalprice").cast("double").alias("price"))
    out = VersionedTable(spark, scratch_path(spark, "orders-versions"), ["o_orderkey"], 16, F.pmod("o_orderkey", F.lit(16)))
    out.create(orders)
    some = orders.filter(F.pmod("o_orderkey", F.lit(16)).isin(3, 5))
    fresh = some.select((-F.col("o_orderkey") * 16 + F.pmod("o_orderkey", F.lit(16))).alias("o_orderkey"), F.lit(1.0).alias("price"))
    out.merge(some.select("o_orderkey", (F.col("price") + 100).alias("price")).unionByName(fresh))
    out.merge(orders.filter("pmod(o_orderkey, 16) = 5").select("o_orderkey", F.lit(0.0).alias("price")))
    return out


_STATES = """(with o as (select o_orderkey, o_totalprice::double as price, o_orderkey % 16 as b from orders)
select 1 as version, o_orderkey, price, b, 1 as written_in from o
union all select 2, o_orderkey, price + case when b in (3, 5) then 100 else 0 end, b, case when b in (3, 5) then 2 else 1 end from o
union all select 2, -o_orderkey * 16 + b, 1.0, b, 2 from o where b in (3, 5)
union all select 3, o_orderkey, case when b = 5 then 0 when b = 3 then price + 100 else price end, b, case when b = 5 then 3 when b = 3 then 2 else 1 end from o
union all select 3, -o_orderkey * 16 + b, 1.0, b, case when b = 5 then 3 else 2 end from o where b in (3, 5))"""


@query("sink_merge_rows", f"select o_orderkey, {rnd('price')} as price, written_in from {_STATES} s where version = 3")
def merge_rows(spark, d):
    """The newest rows, each with the version that wrote its file: buckets without incoming keys keep their first files."""
    out = _merged(spark, d)
    files = out.manifest().select("bucket", "written_in").distinct()
    rows = out.read().withColumn("bucket", F.pmod("o_orderkey", F.lit(16)).cast("int"))
    return rows.join(F.broadcast(files), "bucket").select("o_orderkey", round_half_up("price", 2).alias("price"), "written_in")


@query("sink_merge_versions", f"select version, count(*) as n, {rnd('sum(cast(price as decimal(18,2)))')} as total, count(distinct b) filter (where written_in < version) as buckets_kept, true as files_kept from {_STATES} s group by 1")
def merge_versions(spark, d):
    """Every version is still readable, and kept files have the names, sizes and times they had."""
    out = _merged(spark, d)
    result, before = None, None
    for v in out.versions():
        files = out.manifest(v)
        kept = files.filter(F.col("written_in") < v)
        same = F.lit(True) if before is None else (kept.join(before, ["bucket", "path", "bytes", "modified", "written_in"], "left_anti").agg(F.count("*") == 0)).scalar()
        n_kept = kept.agg(F.countDistinct("bucket")).scalar()
        row = out.read(v).agg(F.count("*").alias("n"), F.sum(F.col("price").cast("decimal(18,2)")).alias("total"))
        row = row.select(F.lit(v).alias("version"), "n", round_half_up("total", 2).alias("total"), n_kept.alias("buckets_kept"), same.alias("files_kept"))
        result, before = row if result is None else result.unionByName(row), files
    return result


#: Needles of one to thirty characters from the tables themselves, in another case than the texts.
_NEEDLES = """(select distinct upper(substr(p_name, 1 + p_size % 4, 1 + p_size % 30)) as needle from {part} where substr(p_name, 1 + p_size % 4, 1 + p_size % 30) <> ''
  union select distinct lower(substr(c_mktsegment, 1 + c_nationkey % 5, 3 + c_nationkey)) from {customer} where c_mktsegment is not null union select substr(s_name, 9) from {supplier} union select 'no such text' from {region})"""


@query("search_index_parts", f"select n.needle, count(*) as n, min(p_partkey) as least_key, sum(p_partkey)::bigint as key_sum from {duck(_NEEDLES)} n join part p on contains(lower(p_name), lower(needle)) or contains(lower(p_brand), lower(needle)) or contains(lower(p_type), lower(needle)) group by 1")
def search_index_parts(spark, d):
    """All parts indexed in two segments; every needle's whole result, told by number and keys."""
    parts = table(spark, d, "part")
    index = TextIndex(spark, scratch_path(spark, "text-index"), "p_partkey", ["p_name", "p_brand", "p_type"], buckets=16)
    index.add(parts.filter("p_size < 25"))
    index.add(parts.filter("p_size >= 25 or p_size is null"))
    found = index.find_all(shared(spark, d, "select * from " + _NEEDLES))
    return found.groupBy("needle").agg(F.count("*").alias("n"), F.min("p_partkey").alias("least_key"), F.sum("p_partkey").alias("key_sum"))


@query("search_index_customers", f"select n.needle, c_custkey from {duck(_NEEDLES)} n join customer c on contains(lower(c_name), lower(needle)) or contains(lower(c_mktsegment), lower(needle)) where length(needle) >= 3")
def search_index_customers(spark, d):
    index = TextIndex(spark, scratch_path(spark, "text-index"), "c_custkey", ["c_name", "c_mktsegment"], buckets=16)
    index.add(table(spark, d, "customer"))
    return index.find_all(shared(spark, d, "select * from " + _NEEDLES + " n where length(needle) >= 3")).select("needle", "c_custkey")


@query("search_index_one", "select c_custkey, c_name from customer where c_name ilike '%r#00000000%' or c_mktsegment ilike '%r#00000000%' union all select p_partkey, p_name from part where p_name ilike '%ED w%'")
def search_index_one(spark, d):
    """Single needles: their grams prune postings and rows at planning."""
    customers = TextIndex(spark, scratch_path(spark, "text-index"), "c_custkey", ["c_name", "c_mktsegment"], buckets=16)
    customers.add(table(spark, d, "customer"))
    parts = TextIndex(spark, scratch_path(spark, "text-index"), "p_partkey", ["p_name"], buckets=16)
    parts.add(table(spark, d, "part"))
    found = parts.find("ED w").select(F.col("p_partkey").alias("c_custkey"), F.col("p_name").alias("c_name"))
    return customers.find("r#00000000").select("c_custkey", "c_name").unionByName(found)


@query("source_excel_orders", f"select o_orderkey, o_custkey, o_orderstatus, {rnd('o_totalprice')} as o_totalprice, cast(o_orderdate as date) as o_orderdate, o_orderpriority, o_totalprice > 100000 as large from orders")
def excel_orders(spark, d):
    """All orders written as Excel sheets by tasks, and read back with types by row ranges."""
    spark.dataSource.register(ExcelSource)
    folder = scratch_path(spark, "orders-xlsx")
    orders = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", F.to_date("o_orderdate").alias("o_orderdate"), "o_orderpriority", (F.col("o_totalprice") > 100000).alias("large"))
    orders.repartition("o_orderkey").write.format("xlsx").option("sheet", "Orders").mode("append").save(folder)
    back = spark.read.format("xlsx").option("sheet", "Orders").option("taskRows", 20_000).schema(orders.schema).load(folder)
    return back.withColumn("o_totalprice", round_half_up("o_totalprice", 2))
