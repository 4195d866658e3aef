"""Readers and writers, round-tripping the driver tables through each format."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from indicraft.session import scratch_path
from indicraft.sources import readers as rd
from indicraft.sources import sinks as sk
from indicraft.sources.registry import load_source

from .base import ORACLES, query, shared, table
from .cleaning import DIRECTORY

#: Alerts in one landed file: 50 MB of text.
ALERT_FILE_ROWS = 10_000


@query("source_csv_scan", "select c_custkey, c_name, case when c_custkey % 5 = 0 then null else c_acctbal end as c_acctbal from customer")
def csv_scan(spark, d):
    """A fifth of the balances is bad text, which reads as null."""
    path = scratch_path(spark, "csv")
    bal = F.when(F.col("c_custkey") % 5 == 0, "n/a").otherwise(F.col("c_acctbal").cast("string"))
    table(spark, d, "customer").select("c_custkey", "c_name", bal.alias("c_acctbal")).write.option("header", "true").csv(path)
    return rd.read_csv(spark, path, "c_custkey long, c_name string, c_acctbal double")


@query("source_csv_ragged", "select n_nationkey, n_name from nation")
def csv_ragged(spark, d):
    """Every second line has surplus fields."""
    path = scratch_path(spark, "ragged")
    n = table(spark, d, "nation")
    line = F.concat_ws(",", F.col("n_nationkey").cast("string"), "n_name", F.when(F.col("n_nationkey") % 2 == 0, "extra,extra"))
    n.select(line.alias("value")).write.text(path)
    return rd.read_csv(spark, path, "n_nationkey int, n_name string", header="false")


@query("source_csv_encoding", "select n_nationkey, 'Ñandú ' || n_name as n_name from nation")
def csv_encoding(spark, d):
    path = scratch_path(spark, "latin")
    n = table(spark, d, "nation").select("n_nationkey", F.concat(F.lit("Ñandú "), "n_name").alias("n_name"))
    n.write.option("header", "true").option("encoding", "iso-8859-1").csv(path)
    return rd.read_csv_any_encoding(spark, path, "n_nationkey int, n_name string")


@query("source_csv_mixed_charsets", "select c_custkey, 'Ñandú ' || c_name as c_name from customer")
def csv_mixed(spark, d):
    """UTF-8 and Latin-1 files in one folder."""
    path = scratch_path(spark, "mixed")
    c = table(spark, d, "customer").select("c_custkey", F.concat(F.lit("Ñandú "), "c_name").alias("c_name"))
    for rest, encoding in ((0, "UTF-8"), (1, "iso-8859-1")):
        c.filter(F.col("c_custkey") % 2 == rest).write.mode("append").option("header", "true").option("encoding", encoding).csv(path)
    return rd.read_csv_any_encoding(spark, path, "c_custkey long, c_name string")


@query("source_tagged_union", "select event_id, case when event_type = 'click' then user_id end as user_id, event_type as kind from events")
def tagged(spark, d):
    """One folder per event type, only one of them with the user column."""
    e, paths = table(spark, d, "events"), {}
    for kind in [r[0] for r in e.select("event_type").distinct().collect()]:  # a handful of types
        cols = ["event_id", "user_id"] if kind == "click" else ["event_id"]
        paths[kind] = scratch_path(spark, f"tag-{kind}")
        e.filter(F.col("event_type") == kind).select(*cols).write.option("header", "true").csv(paths[kind])
    out = rd.read_tagged(spark, paths, "kind")
    return out.select(F.col("event_id").cast("long").alias("event_id"), F.col("user_id").cast("long").alias("user_id"), "kind")


@query("source_json_records", "select p_partkey, p_name, p_size from part")
def json_records(spark, d):
    path = scratch_path(spark, "json")
    p = table(spark, d, "part")
    packed = p.groupBy(F.floor(F.col("p_partkey") / 100).alias("g")).agg(F.to_json(F.collect_list(F.struct("p_partkey", "p_name", "p_size"))).alias("value"))
    packed.select("value").write.text(path)
    return rd.read_json_records(spark, path, "p_partkey long, p_name string, p_size int", multi_line=False)


@query("source_json_files", "select s_suppkey, s_name from supplier")
def json_files(spark, d):
    path = scratch_path(spark, "jsonl")
    table(spark, d, "supplier").select("s_suppkey", "s_name").write.json(path)
    return spark.read.schema("s_suppkey long, s_name string").json(path)


@query("source_header_row_json", "select c_custkey::varchar as id, c_name as name, null::varchar as absent from customer")
def header_row(spark, d):
    """Arrays of rows under a header row whose column order differs between payloads."""
    c = table(spark, d, "customer")
    key, name = F.col("c_custkey").cast("string"), F.col("c_name")
    flip = F.col("c_custkey") % 2
    row = F.when(flip == 0, F.array(key, name)).otherwise(F.array(name, key))
    head = F.when(F.col("flip") == 0, F.array(F.array(F.lit("id"), F.lit("name")))).otherwise(F.array(F.array(F.lit("name"), F.lit("id"))))
    packs = c.groupBy(flip.alias("flip"), F.floor(F.col("c_custkey") / 100).alias("g")).agg(F.collect_list(row).alias("rows"))
    payload = packs.select(F.to_json(F.concat(head, "rows")).alias("payload"))
    return rd.header_row_table(payload, "payload", ["id", "name", "absent"])


@query("sink_replace_partition", "select o_orderkey, o_orderstatus, case when o_orderstatus = 'F' then 'new' else 'old' end as version from orders")
def replace_partition(spark, d):
    """Replacing one partition leaves the others alone."""
    path = scratch_path(spark, "parts")
    o = table(spark, d, "orders").select("o_orderkey", "o_orderstatus")
    sk.write_replace(o.withColumn("version", F.lit("old")), path, ["o_orderstatus"])
    sk.write_replace(o.filter("o_orderstatus = 'F'").withColumn("version", F.lit("new")), path, ["o_orderstatus"])
    return spark.read.parquet(path)


@query("sink_append_history", "select s_suppkey, run from supplier, (select unnest([1, 2]) as run) r")
def append_history(spark, d):
    path = scratch_path(spark, "history")
    s = table(spark, d, "supplier").select("s_suppkey")
    for run in (1, 2):
        sk.write_append(s.withColumn("run", F.lit(run)), path)
    return spark.read.parquet(path)


@query("sink_layers_and_views", "select c_mktsegment, count(*) as n from customer group by 1")
def layers(spark, d):
    root = scratch_path(spark, "layers")
    sk.materialize_layer(table(spark, d, "customer"), "staging", "customers", root)
    silver = spark.sql("select c_mktsegment, count(*) as n from staging_customers group by 1")
    sk.materialize_layer(silver, "silver", "segments", root)
    return spark.sql("select * from silver_segments")


@query("source_csv_views", "select n_regionkey::varchar as n_regionkey, count(*) as n from nation group by 1")
def views(spark, d):
    path = scratch_path(spark, "view")
    table(spark, d, "nation").write.option("header", "true").csv(path)
    rd.csv_views(spark, {"nation_file": path})
    return spark.sql("select n_regionkey, count(*) as n from nation_file group by 1")


@query("source_registry_load", f"select count(*) as n from ({ORACLES['clean_directory']}) c where regexp_full_match(state_abbr, '[A-Z]{{2}}') and coalesce(latitude between 17 and 72, true) and longitude between -180 and -65")
def registry_load(spark, d):
    path = scratch_path(spark, "registry")
    shared(spark, d, DIRECTORY).write.option("header", "true").csv(path)
    valid, _, _ = load_source(spark, "nces_ccd", path)
    return valid.agg(F.count(F.lit(1)).alias("n"))


@query(
    "source_load_census",
    "select count(*) as n, sum(case when c_custkey % 3 = 0 then null else c_custkey % 1000 end)::bigint as universe, min(lpad((c_nationkey + 1)::varchar, 2, '0')) as first_state from customer",
)
def load_census(spark, d):
    """Header-row arrays, one per line, column order differing; the missing-value mark becomes null."""
    path = scratch_path(spark, "census")
    c, k = table(spark, d, "customer"), F.col("c_custkey")
    cells = {"B17001_001E": F.when(k % 3 == 0, F.lit("-666666666")).otherwise((k % 1000).cast("string")), "state": (F.col("c_nationkey") + 1).cast("string"), "county": F.lit("31"), "tract": (k % 900_000 + 100).cast("string")}
    order = list(cells)
    packs = c.groupBy(F.floor(k / 50).alias("g"), (k % 2).alias("flip"))
    rows = packs.agg(F.collect_list(F.when(k % 2 == 0, F.array(*cells.values())).otherwise(F.array(*[cells[x] for x in reversed(order)]))).alias("rows"))
    head = lambda names: F.array(F.array(*[F.lit(x.upper()) for x in names]))
    line = F.to_json(F.concat(F.when(F.col("flip") == 0, head(order)).otherwise(head(order[::-1])), "rows"))
    rows.select(line.alias("value")).write.text(path)
    valid, _, _ = load_source(spark, "census_acs", path)
    return valid.agg(F.count(F.lit(1)).alias("n"), F.sum("poverty_universe").cast("long").alias("universe"), F.min("state_fips").alias("first_state"))


@query(
    "source_load_places",
    "select trim(c_mktsegment) as locationname, count(*) as n, sum(c_custkey)::bigint as population, count(case when c_custkey % 5 > 0 then 1 end) as n_values from customer where c_custkey % 7 > 0 group by 1",
)
def load_places(spark, d):
    """Records, one per line; those without a measure are rejected."""
    path = scratch_path(spark, "places")
    k = F.col("c_custkey")
    cells = F.struct(
        F.lit("2021").alias("year"), F.lit("IL").alias("stateabbr"), F.concat(F.col("c_mktsegment"), F.lit(" ")).alias("locationname"), F.when(k % 7 > 0, "Asthma").alias("measure"),
        F.when(k % 5 > 0, k.cast("string")).otherwise("n/a").alias("data_value"), k.cast("string").alias("totalpopulation"),
    )
    table(spark, d, "customer").select(F.to_json(cells).alias("value")).write.text(path)
    valid, _, _ = load_source(spark, "cdc_places", path)
    return valid.groupBy("locationname").agg(F.count(F.lit(1)).alias("n"), F.sum("totalpopulation").alias("population"), F.count("data_value").alias("n_values"))


@query("source_load_env_health", "select event_type as geo_name, count(*) as n, count(case when event_id % 7 > 0 then value end) as n_values, cast(max(user_id % 50 + 1) as integer) as last_measure from events group by 1")
def load_env_health(spark, d):
    """Objects with field names of two releases."""
    path = scratch_path(spark, "env")
    k = F.col("event_id")
    value = F.when(k % 7 > 0, F.col("value").cast("string")).otherwise("*")
    measure = (F.col("user_id") % 50 + 1).cast("string").alias("measureId")
    old = F.struct(k.cast("string").alias("geo_id"), F.col("event_type").alias("geoName"), value.alias("value"), measure)
    new = F.struct(k.cast("string").alias("geoId"), F.concat("event_type", F.lit(" ")).alias("geo"), value.alias("dataValue"), measure)
    table(spark, d, "events").select(F.when(k % 2 == 0, F.to_json(old)).otherwise(F.to_json(new)).alias("value")).write.text(path)
    valid, _, _ = load_source(spark, "cdc_env_health", path, geo_type=3, area="Air", default_year="2021")
    return valid.groupBy("geo_name").agg(F.count(F.lit(1)).alias("n"), F.count("data_value").alias("n_values"), F.max("measure_id").alias("last_measure"))


@query("source_load_alerts", "select event_type as event, count(*) as n, sum(5000 + event_id % 10)::bigint as description_chars, count(case when event_id % 3 > 0 then 1 end) as n_wi from events group by 1")
def load_alerts(spark, d):
    """Feature collections, one per line, with long descriptions.

    Keys alone are shuffled into packs, the long texts are made where they are written, and the files are gzipped.
    """
    path = scratch_path(spark, "alerts")
    events = table(spark, d, "events").select("event_id", "event_type", F.floor(F.col("event_id") / 20).alias("g"))

    def feature(e):
        k = e["event_id"]
        text = F.concat(F.repeat(F.lit("x"), 5000), F.repeat(F.lit("y"), (k % 10).cast("int")))
        codes = F.struct(F.when(k % 3 > 0, F.array(F.lit("WIC001"))).alias("UGC")).alias("geocode")
        return F.struct(F.struct(F.concat(F.lit("urn:"), k.cast("string")).alias("id"), e["event_type"].alias("event"), F.lit("Severe").alias("severity"), text.alias("description"), codes).alias("properties"))

    # the keys are small and the lines long: the number of files follows the rows, as merged partitions would be too few
    files = max(1, math.ceil(events.count() / ALERT_FILE_ROWS))
    packs = events.repartition(files, "g").groupBy("g").agg(F.collect_list(F.struct("event_id", "event_type")).alias("e"))
    packs.select(F.to_json(F.struct(F.transform("e", feature).alias("features"))).alias("value")).write.option("compression", "gzip").text(path)
    valid, _, _ = load_source(spark, "noaa_nws_alerts", path, ingested_at=F.lit("2024-01-01").cast("timestamp"))
    return valid.groupBy("event").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("description")).alias("description_chars"), F.count_if(F.col("state") == "WI").alias("n_wi"))


@query("source_table_scan", "select r_regionkey, r_name from region")
def table_scan(spark, d):
    table(spark, d, "region").createOrReplaceTempView("region_table")
    by_name, by_path = rd.read_table(spark, "region_table"), rd.read_table(spark, f"{d}/region.parquet")
    return by_name.intersect(by_path)
