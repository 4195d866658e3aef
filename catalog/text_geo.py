"""Documents, vectors and positions."""

from __future__ import annotations

from pyspark.sql import functions as F

from indicraft.functions import geo
from indicraft.functions.cleaning import round_half_up
from indicraft.operators import retrieval as rt
from indicraft.operators import spatial as sp
from indicraft.operators import text as tx

from .base import duck, query, rnd, shared, table


@query("text_usable_documents", "select doc_id, left(md5(text), 12) as doc_hash from documents where length(trim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))) >= 50")
def usable(spark, d):
    return tx.usable_documents(table(spark, d, "documents"), "text").select("doc_id", "doc_hash")


@query(
    "text_chunk_windows",
    """select doc_id, cast(i as integer) as chunk_index, md5(trim(substr(text, i * 1848 + 1, 2048), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))) as digest from (
  select doc_id, text, unnest(range(0, greatest(ceil((length(text) - 200) / 1848.0), 1)::bigint)) as i from documents where length(text) > 0) q
where length(trim(substr(text, i * 1848 + 1, 2048), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))) >= 20""",
)
def windows(spark, d):
    out = tx.chunk_windows(table(spark, d, "documents"), "doc_id", "text")
    return out.select("doc_id", "chunk_index", F.md5("chunk_text").alias("digest"))


@query(
    "text_chunk_boundaries",
    "select doc_id, substr(md5(text), 1, 12) as doc_hash, source, true as sizes_bounded, true as all_in_text, true as words_covered from documents where length(trim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))) >= 20",
)
def boundaries(spark, d):
    """Every chunk is a piece of its text, none is too long, and together they hold nearly all of it."""
    docs = table(spark, d, "documents")
    chunks = tx.chunk_text(docs, "doc_id", "text", "source").join(docs.select("doc_id", "text"), "doc_id")
    size = F.length("chunk_text")
    out = chunks.groupBy("doc_id", "doc_hash", "source").agg(
        F.max(size).alias("longest"), F.bool_and(F.col("text").contains(F.col("chunk_text"))).alias("all_in_text"), F.sum(size).alias("held"), F.count(F.lit(1)).alias("n"), F.max(F.length("text")).alias("n_chars")
    )
    # at most a short rest (under 20 characters) and trimmed space are left out per cut
    covered = F.col("held") >= F.col("n_chars") * 0.9 - 40
    return out.select("doc_id", "doc_hash", "source", (F.col("longest") <= tx.CHUNK_CHARS).alias("sizes_bounded"), "all_in_text", covered.alias("words_covered"))


@query("vector_normalize", f"select vec_id, {rnd('embedding[1] / sqrt(list_dot_product(embedding::double[], embedding::double[]))', 6)} as first_part, 1.0::double as length from embeddings")
def normalize(spark, d):
    e = table(spark, d, "embeddings").withColumn("u", rt.l2_normalize("embedding"))
    return e.select("vec_id", round_half_up(F.col("u")[0], 6).alias("first_part"), round_half_up(rt.l2_norm("u"), 6).alias("length"))


def _centroids(spark, d):
    """Mean vector per label: ten queries that depend on every vector."""
    e = table(spark, d, "embeddings").select("label", F.posexplode("embedding").alias("i", "v"))
    means = e.groupBy("label", "i").agg(F.avg("v").alias("v"))
    packed = means.groupBy("label").agg(F.array_sort(F.collect_list(F.struct("i", "v"))).alias("p"))
    return packed.select(F.col("label").alias("q_label"), F.col("p.v").alias("embedding"))


COSINES = """(with m as (select label as q_label, i, avg(v) as v from (select label, unnest(range(1, len(embedding) + 1)) as i, unnest(embedding)::double as v from embeddings) u group by 1, 2),
c as (select q_label, list(v order by i) as q from m group by 1)
select q_label, vec_id, label, list_dot_product(q, embedding::double[]) / sqrt(list_dot_product(q, q)) / sqrt(list_dot_product(embedding::double[], embedding::double[])) as score from embeddings, c)"""
HITS = f"(select *, row_number() over (partition by q_label order by score desc, vec_id) as place from {COSINES} s where score >= 0.35 qualify place <= 20)"


@query("vector_cosine_topk", f"select q_label, vec_id, {rnd('score', 6)} as score, place from {HITS} h")
def topk(spark, d):
    out = rt.cosine_topk(_centroids(spark, d), table(spark, d, "embeddings"), "q_label", "vec_id")
    return out.select("q_label", "vec_id", round_half_up("score", 6).alias("score"), "place")


def _reranked(spark, d):
    e = table(spark, d, "embeddings")
    hits = rt.cosine_topk(_centroids(spark, d), e, "q_label", "vec_id")
    tagged = hits.join(e.select("vec_id", F.concat(F.lit("src"), (F.col("vec_id") % 3).cast("string")).alias("source")), "vec_id")
    return rt.diversity_rerank(tagged, "q_label", "source", "vec_id")


RERANKED = f"""(select q_label, source, vec_id, score, row_number() over (partition by q_label order by score desc, vec_id) as place from (
  select q_label, source, vec_id, case when n < max(n) over (partition by q_label) then score * 1.05 else score end as score
  from (select *, count(*) over (partition by q_label, source) as n from (select *, 'src' || (vec_id % 3) as source from {HITS} h) a) b) r qualify place <= 5)"""


@query("vector_diversity_rerank", f"select q_label, source, vec_id, {rnd('score', 6)} as score, place from {RERANKED} x")
def rerank(spark, d):
    return _reranked(spark, d).select("q_label", "source", "vec_id", round_half_up("score", 6).alias("score"), "place")


@query(
    "vector_context_text",
    f"select q_label, string_agg('[Source: ' || source || ' | Relevance: ' || printf('%.2f', score) || ']' || chr(10) || 'vector ' || vec_id, chr(10) || chr(10) || '---' || chr(10) || chr(10) order by place) as context from {RERANKED} x group by 1",
)
def context(spark, d):
    hits = _reranked(spark, d).withColumn("text", F.concat(F.lit("vector "), F.col("vec_id").cast("string")))
    return rt.assemble_context(hits, "q_label", "source", "text")


CUSTOMER_PLACES = "select c_custkey, cast(20.0 + (c_custkey * 37 % 5000) / 100.0 as double) as latitude, cast(-160.0 + (c_custkey * 91 % 9000) / 100.0 as double) as longitude from {customer}"
SUPPLIER_PLACES = "select s_suppkey, cast(20.0 + (s_suppkey * 53 % 5000) / 100.0 as double) as latitude, cast(-160.0 + (s_suppkey * 29 % 9000) / 100.0 as double) as longitude from {supplier}"


def hav(a: str, b: str, c: str, e: str) -> str:
    return f"(12742.0 * asin(least(1.0, sqrt(power(sin((radians({c}) - radians({a})) / 2), 2) + cos(radians({a})) * cos(radians({c})) * power(sin(radians({e} - {b}) / 2), 2)))))"


@query("geo_haversine", f"select c_custkey, {rnd(hav('latitude', 'longitude', '41.8781', '-87.6298'), 4)} as km from {duck(CUSTOMER_PLACES)} p")
def haversine(spark, d):
    p = shared(spark, d, CUSTOMER_PLACES)
    return p.select("c_custkey", round_half_up(geo.haversine_km("latitude", "longitude", F.lit(41.8781), F.lit(-87.6298)), 4).alias("km"))


@query("geo_nearest_to_point", f"select c_custkey, {rnd(hav('41.8781', '-87.6298', 'latitude', 'longitude'), 4)} as distance_km from {duck(CUSTOMER_PLACES)} p order by distance_km, c_custkey limit 25")
def nearest_point(spark, d):
    out = sp.nearest_to_point(shared(spark, d, CUSTOMER_PLACES), 41.8781, -87.6298, "c_custkey", 25)
    return out.select("c_custkey", round_half_up("distance_km", 4).alias("distance_km"))


@query(
    "geo_nearest_join",
    f"select c_custkey, place, {rnd('km', 4)} as distance_km from (select c_custkey, km, row_number() over (partition by c_custkey order by km, s_suppkey) as place from (select c_custkey, s_suppkey, {hav('c.latitude', 'c.longitude', 's.latitude', 's.longitude')} as km from {duck(CUSTOMER_PLACES)} c, {duck(SUPPLIER_PLACES)} s) x) y where place <= 3",
)
def nearest_join(spark, d):
    out = sp.nearest(shared(spark, d, CUSTOMER_PLACES), shared(spark, d, SUPPLIER_PLACES), "c_custkey", "s_suppkey", 3)
    return out.select("c_custkey", "place", round_half_up("distance_km", 4).alias("distance_km"))


# nine of ten orders lie in one cell of a hundredth of a degree
ORDER_PLACES = "select o_orderkey, cast(case when o_orderkey % 10 > 0 then 41.87 + cast(o_orderkey % 997 as double) / cast(99700 as double) else 20.0 + (o_orderkey * 37 % 5000) / 100.0 end as double) as latitude, cast(case when o_orderkey % 10 > 0 then -87.63 + cast(o_orderkey % 1009 as double) / cast(100900 as double) else -160.0 + (o_orderkey * 91 % 9000) / 100.0 end as double) as longitude from {orders}"


@query(
    "geo_nearest_crowded",
    f"select o_orderkey, {rnd('min(km)', 4)} as distance_km from (select o_orderkey, {hav('o.latitude', 'o.longitude', 's.latitude', 's.longitude')} as km from {duck(ORDER_PLACES)} o, {duck(SUPPLIER_PLACES)} s) x group by 1",
)
def nearest_crowded(spark, d):
    out = sp.nearest(shared(spark, d, ORDER_PLACES), shared(spark, d, SUPPLIER_PLACES), "o_orderkey", "s_suppkey")
    return out.select("o_orderkey", round_half_up("distance_km", 4).alias("distance_km"))


@query("geo_nearest_within_radius", f"select c_custkey, {rnd('min(km)', 4)} as distance_km from (select c_custkey, {hav('c.latitude', 'c.longitude', 's.latitude', 's.longitude')} as km from {duck(CUSTOMER_PLACES)} c, {duck(SUPPLIER_PLACES)} s) x where km <= 150 group by 1")
def nearest_radius(spark, d):
    out = sp.nearest(shared(spark, d, CUSTOMER_PLACES), shared(spark, d, SUPPLIER_PLACES), "c_custkey", "s_suppkey", 1, max_km=150)
    return out.select("c_custkey", round_half_up("distance_km", 4).alias("distance_km"))


@query(
    "geo_grid_cells",
    """select c_custkey, y, x, floor(y / 8)::bigint as parent_y, floor(x / 8)::bigint as parent_x, cast((y + 0.5) * 180.0 / 1024 - 90 as double) as center_lat, cast((x + 0.5) * 180.0 / 1024 - 180 as double) as center_lon, 9 as ring_size
from (select c_custkey, floor((latitude + 90) / (180.0 / 1024))::bigint as y, floor((longitude + 180) / (180.0 / 1024))::bigint as x from """
    + duck(CUSTOMER_PLACES)
    + " p) q",
)
def grid_cells(spark, d):
    p = shared(spark, d, CUSTOMER_PLACES).withColumn("cell", geo.grid_key("latitude", "longitude", 10))
    p = p.withColumn("parent", geo.grid_parent("cell", 7)).withColumn("center", geo.grid_center("cell"))
    return p.select(
        "c_custkey", "cell.y", "cell.x", F.col("parent.y").alias("parent_y"), F.col("parent.x").alias("parent_x"),
        F.col("center.lat").alias("center_lat"), F.col("center.lon").alias("center_lon"), F.size(geo.grid_ring("cell")).alias("ring_size"),
    )


@query("geo_valid_positions", "select c_custkey, coalesce(lat between 17 and 72 and lon between -180 and -65, false) as ok from (select c_custkey, try_cast(case when c_custkey % 7 = 0 then 'x' else (c_custkey % 90)::varchar end as double) as lat, -(c_custkey % 200)::double as lon from customer) q")
def valid_positions(spark, d):
    k = F.col("c_custkey")
    lat = F.when(k % 7 == 0, "x").otherwise((k % 90).cast("string"))
    return table(spark, d, "customer").select("c_custkey", geo.is_valid_latlon(lat, -(k % 200)).alias("ok"))


@query("geo_group_centroid", f"select c_nationkey, {rnd('avg(latitude)', 4)} as centroid_lat, {rnd('avg(longitude)', 4)} as centroid_lon from {duck(CUSTOMER_PLACES)} p join customer using (c_custkey) group by 1")
def centroid(spark, d):
    p = shared(spark, d, CUSTOMER_PLACES).join(table(spark, d, "customer").select("c_custkey", "c_nationkey"), "c_custkey")
    return sp.group_centroid(p, "c_nationkey").withColumns({c: round_half_up(c, 4) for c in ("centroid_lat", "centroid_lon")})


@query("geo_map_click", f"select c_custkey, {rnd('abs(latitude - 40) + abs(longitude + 100)', 4)} as grid_distance from {duck(CUSTOMER_PLACES)} p order by grid_distance, c_custkey limit 1")
def map_click(spark, d):
    out = sp.nearest_by_grid_distance(shared(spark, d, CUSTOMER_PLACES), 40, -100, "c_custkey")
    return out.select("c_custkey", round_half_up("grid_distance", 4).alias("grid_distance"))
