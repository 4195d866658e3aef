"""Scalar functions, source cleaning and row contracts."""

from __future__ import annotations

from pyspark.sql import functions as F

from indicraft.functions import cleaning as c
from indicraft.functions import codes, text
from indicraft.operators.joins import lookup
from indicraft.sources.contracts import CONTRACTS, contract_from_json_schema, validate, violation_counts
from indicraft.sources.readers import alert_features
from indicraft.sources.registry import REGISTRY, clean_source, env_health_records, parse_alerts

from .base import duck, query, rnd, shared, table
from .raw import RAW


@query(
    "scalar_codes",
    """
select c_custkey, lpad(c_custkey::varchar, 5, '0') as padded, case when length(c_custkey::varchar) < 3 then lpad(c_custkey::varchar, 3, '0') else c_custkey::varchar end as zfilled,
  left(lpad((c_custkey * 7919 + 1000000000)::varchar, 11, '0'), 5) as county, lpad(c_nationkey::varchar, 2, '0') || lpad((c_custkey % 1000)::varchar, 3, '0') as built,
  left(code, 2) as state_part, case when length(code) in (5, 11) then substr(code, 3, 3) end as county_part, case when length(code) = 11 then substr(code, 6) end as tract_part,
  case when length(code) not in (2, 5, 11) then substr(code, 3) end as rest, regexp_full_match(code, '[0-9]{2,11}') as valid
from (select *, case c_custkey % 4 when 0 then (10 + c_custkey % 90)::varchar when 1 then (10000 + c_custkey)::varchar when 2 then (10000000000 + c_custkey)::varchar else c_name end as code from customer) t
""",
)
def scalar_codes(spark, d):
    k = F.col("c_custkey")
    code = (
        F.when(k % 4 == 0, (k % 90 + 10).cast("string"))
        .when(k % 4 == 1, (k + 10000).cast("string"))
        .when(k % 4 == 2, (k + 10000000000).cast("string"))
        .otherwise(F.col("c_name"))
    )
    parsed = codes.parse_code("code")
    return table(spark, d, "customer").withColumn("code", code).select(
        "c_custkey",
        codes.pad_code(k, 5).alias("padded"),
        codes.pad_code(k, 3, truncate=False).alias("zfilled"),
        codes.tract_to_county(k * 7919 + 1000000000).alias("county"),
        codes.format_code("c_nationkey", k % 1000).alias("built"),
        parsed["state"].alias("state_part"),
        parsed["county"].alias("county_part"),
        parsed["tract"].alias("tract_part"),
        parsed["remainder"].alias("rest"),
        codes.is_valid_code("code").alias("valid"),
    )


@query(
    "scalar_code_to_state",
    f"select c_custkey, coalesce(s.state_name, 'region ' || n_regionkey) as state_name from customer join nation on n_nationkey = c_nationkey left join {duck(RAW['states'])} s on s.fips_code = lpad((n_regionkey + 1)::varchar, 2, '0')",
)
def code_to_state(spark, d):
    nation = table(spark, d, "nation")
    coded = table(spark, d, "customer").join(nation, F.col("n_nationkey") == F.col("c_nationkey")).select(
        "c_custkey",
        codes.pad_code(F.col("n_regionkey") + 1, 2).alias("state_fips"),
        F.concat(F.lit("region "), F.col("n_regionkey").cast("string")).alias("fallback"),
    )
    states = shared(spark, d, RAW["states"])
    return lookup(coded, "state_fips", states, "fips_code", "state_name", "state_name", "fallback").select("c_custkey", "state_name")


@query(
    "scalar_nulls_and_rates",
    f"""
select o_orderkey, nullif(o_custkey % 7, 3) as no_three, case when o_totalprice - 200000 >= 0 then o_totalprice - 200000 end as no_negative,
  case when o_custkey % 5 = 0 then null else {rnd('o_totalprice / cast(o_custkey % 5 as double) * 100.0')} end as rate,
  case when o_custkey % 5 > 0 then {rnd('o_totalprice / cast(o_custkey % 5 as double) * 100000.0', 1)} end as per_100k,
  coalesce(nullif(trim(case when o_custkey % 3 = 0 then '  ' else o_orderpriority end), ''), 'Unknown') as tidy,
  case o_orderstatus when 'F' then true when 'O' then false end as flag, case o_orderstatus when 'F' then 'Filled' when 'O' then 'Open' else 'Other' end as label,
  case when o_totalprice between 100000 and 300000 then o_totalprice end as kept, least(o_totalprice, 250000) as capped,
  least(greatest(o_totalprice / 3000, 10), 90) as clamped, cast(round(o_totalprice / 1000) as integer) as thousands,
  try_cast(left(o_orderpriority, 1 + (o_custkey % 2)::int) as integer) as lenient,
  coalesce(nullif(o_custkey % 7, 3), 0) + o_totalprice as total_present
from orders
""",
)
def nulls_and_rates(spark, d):
    price, cust = F.col("o_totalprice"), F.col("o_custkey")
    return table(spark, d, "orders").select(
        "o_orderkey",
        c.null_sentinels(cust % 7, (3,)).alias("no_three"),
        c.null_sentinels(price - 200000, negative=True).alias("no_negative"),
        c.safe_rate(price, cust % 5).alias("rate"),
        c.positive_rate(price, cust % 5, 100_000, 1).alias("per_100k"),
        c.tidy_name(F.when(cust % 3 == 0, "  ").otherwise(F.col("o_orderpriority"))).alias("tidy"),
        c.yes_no("o_orderstatus", "F", "O").alias("flag"),
        c.code_label("o_orderstatus", {"F": "Filled", "O": "Open"}, "Other").alias("label"),
        c.within(price, 100000, 300000).alias("kept"),
        c.cap(price, 250000.0).alias("capped"),
        c.clamp(price / 3000, 10.0, 90.0).alias("clamped"),
        c.to_int(price / 1000).alias("thousands"),
        c.lenient(F.substring("o_orderpriority", F.lit(1), (F.lit(1) + cust % 2).cast("int")), "int").alias("lenient"),
        c.sum_present(c.null_sentinels(cust % 7, (3,)), price).alias("total_present"),
    )


@query(
    "scalar_json_path",
    "select event_id, cast(json_extract_string(props, '$.k') as integer) as k, json_extract_string(props, '$.missing') as missing from events",
)
def json_path(spark, d):
    return table(spark, d, "events").select(
        "event_id",
        c.lenient(text.json_text("props", "$.k"), "int").alias("k"),
        text.json_text("props", "$.missing").alias("missing"),
    )


@query(
    "scalar_text",
    """
select p_partkey, left(md5(p_name), 12) as digest, concat_ws(' | ', 'Name: ' || p_name, case when p_size > 25 then 'Size: ' || p_size end, 'Brand: ' || p_brand) as line,
  'Part ' || p_name || ' of brand ' || coalesce(case when p_size > 10 then p_brand end, 'N/A') || '.' as sentence,
  trim(p_name) || '/' || trim(p_type) as items,
  lower(replace(trim(p_type), ' ', '_')) as snake,
  'Main ' || upper(p_type[1]) || lower(p_type[2:]) as pretty
from part
""",
)
def scalar_text(spark, d):
    size, brand = F.col("p_size"), F.col("p_brand")
    return table(spark, d, "part").select(
        "p_partkey",
        text.text_hash("p_name").alias("digest"),
        text.record_line({"Name": "p_name", "Size": F.when(size > 25, size), "Brand": "p_brand"}).alias("line"),
        text.fill_template(
            "Part {name} of brand {brand}.", {"name": ("p_name", "?"), "brand": (F.when(size > 10, brand), "N/A")}
        ).alias("sentence"),
        text.join_list(text.split_list(F.concat_ws(" , ", "p_name", "p_type")), "/").alias("items"),
        F.lower(F.replace(F.trim("p_type"), F.lit(" "), F.lit("_"))).alias("snake"),
        text.prettify(F.concat(F.lit("main_"), F.lower("p_type"))).alias("pretty"),
    )


@query(
    "scalar_age_days",
    f"select event_id, {rnd('''epoch_us(timestamp '2024-02-01 00:00:00') - epoch_us(ts)''', 0)} / 86400000000.0 as age from events",
)
def age(spark, d):
    return table(spark, d, "events").select("event_id", c.age_days("ts", F.lit("2024-02-01 00:00:00").cast("timestamp")).alias("age"))


DIRECTORY = """
select cast(c_custkey as string) as NCESSCH, c_name as SCHNAM, c_mktsegment as LEANM, substring(upper(n_name), 1, 2) as STABR,
  cast(n_regionkey + 1 as string) as FIPST, cast((n_regionkey + 1) * 1000 + n_nationkey as string) as CONUM,
  case when c_custkey % 9 = 0 then 'n/a' else cast(20 + c_custkey % 40 as string) end as LATCOD, cast(-70 - c_custkey % 50 as string) as LONCOD,
  cast(c_custkey % 7 as string) as SCHOOL_TYPE, cast(c_custkey % 900 - 20 as string) as MEMBER, cast(c_custkey % 50 - 9 as string) as FRL,
  'x' as IGNORED
from {customer} join {nation} on n_nationkey = c_nationkey
"""


@query(
    "clean_directory",
    f"""
select lpad("NCESSCH", 12, '0') as ncessch, "SCHNAM" as school_name, "LEANM" as lea_name, "STABR" as state_abbr, lpad("FIPST", 2, '0') as state_fips,
  lpad("CONUM", 5, '0') as county_fips, try_cast("LATCOD" as double) as latitude, try_cast("LONCOD" as double) as longitude,
  cast("SCHOOL_TYPE" as integer) as school_type, case when cast("MEMBER" as bigint) >= 0 then cast("MEMBER" as bigint) end as enrollment,
  case when cast("FRL" as bigint) >= 0 then cast("FRL" as bigint) end as free_reduced_lunch
from {duck(DIRECTORY)} t where "SCHOOL_TYPE" in ('1', '2', '3', '4')
""",
)
def clean_directory(spark, d):
    return clean_source(shared(spark, d, DIRECTORY), REGISTRY["nces_ccd"])


LOCATIONS = """
select cast(c_custkey as string) as NCESSCH, cast(c_custkey % 90 as string) as LAT, cast(c_custkey % 150 - 190 as string) as LON, c_mktsegment as CITY,
  cast(c_nationkey as string) as CNTY_FIPS from {customer}
"""


@query(
    "clean_locations",
    f"""select lpad("NCESSCH", 12, '0') as ncessch, case when cast("LAT" as double) between 17 and 72 then cast("LAT" as double) end as latitude,
  case when cast("LON" as double) <= -65 then cast("LON" as double) end as longitude, "CITY" as city, lpad("CNTY_FIPS", 5, '0') as county_fips from {duck(LOCATIONS)} t""",
)
def clean_locations(spark, d):
    return clean_source(shared(spark, d, LOCATIONS), REGISTRY["nces_edge"])


CENSUS_API = """
select cast(n_regionkey + 1 as string) as state, cast(n_nationkey as string) as county, cast(c_custkey % 1000000 as string) as tract,
  cast(c_custkey % 400 as string) as B17001_001E, case when c_custkey % 12 = 0 then '-666666666' else cast(c_custkey % 90 as string) end as B17001_002E,
  cast(c_custkey % 5 as string) as B27001_005E, case when c_custkey % 8 = 0 then null else cast(c_custkey % 6 as string) end as B27001_008E,
  cast(c_custkey % 300 + 1 as string) as B15003_001E, cast(c_custkey % 40 as string) as B15003_022E, case when c_custkey % 10 = 0 then '-666666666.0' else cast(c_custkey % 20 as string) end as B15003_023E,
  cast(c_custkey * 11 as string) as B19013_001E, cast(c_custkey as string) as B01003_001E
from {customer} join {nation} on n_nationkey = c_nationkey
"""


@query(
    "clean_census_api",
    f"""
select *, state_fips || county_fips || tract_fips as full_fips, {rnd('poverty_below_total / nullif(poverty_universe, 0) * 100')} as poverty_rate,
  cast(coalesce(uninsured_male_under6, 0) + coalesce(uninsured_male_6to18, 0) as bigint) as uninsured_children,
  {rnd('(coalesce(edu_bachelors, 0) + coalesce(edu_masters, 0)) / nullif(edu_universe, 0) * 100')} as pct_bachelors_plus
from (
  select lpad(state, 2, '0') as state_fips, lpad(county, 3, '0') as county_fips, lpad(tract, 6, '0') as tract_fips,
    nullif(cast("B17001_001E" as double), -666666666) as poverty_universe, nullif(cast("B17001_002E" as double), -666666666) as poverty_below_total,
    cast("B27001_005E" as double) as uninsured_male_under6, cast("B27001_008E" as double) as uninsured_male_6to18,
    cast("B15003_001E" as double) as edu_universe, cast("B15003_022E" as double) as edu_bachelors, nullif(cast("B15003_023E" as double), -666666666) as edu_masters,
    cast("B19013_001E" as bigint) as median_hh_income, cast("B01003_001E" as bigint) as total_population
  from {duck(CENSUS_API)} t
) q
""",
)
def clean_census_api(spark, d):
    return clean_source(shared(spark, d, CENSUS_API), REGISTRY["census_acs"])


AIR_FILE = """
select n_name as state, r_name as county, cast(n_regionkey as string) as state_code, cast(n_nationkey as string) as county_code, '2022' as yr,
  cast(n_nationkey * 9 as string) as good_days, cast(case when n_nationkey % 4 = 0 then -999 else n_nationkey * 3 end as string) as max_aqi,
  case when n_nationkey % 6 = 1 then 'low' else cast(n_nationkey as string) end as median_aqi
from {nation} join {region} on r_regionkey = n_regionkey
"""


@query(
    "clean_air_summary",
    f"""select state as state_name, county as county_name, lpad(state_code, 2, '0') as state_code, lpad(county_code, 3, '0') as county_code, cast(yr as integer) as year,
  cast(good_days as integer) as good_days, case when cast(max_aqi as integer) >= 0 then cast(max_aqi as integer) end as max_aqi, try_cast(median_aqi as integer) as median_aqi,
  lpad(state_code, 2, '0') || lpad(county_code, 3, '0') as county_fips from {duck(AIR_FILE)} t""",
)
def clean_air_summary(spark, d):
    named = shared(spark, d, AIR_FILE).toDF("State", "County", "State Code", "County Code", "Year", "Good Days", "Max AQI", "Median AQI")
    return clean_source(named, REGISTRY["epa_airnow"])


SHORTAGE_FILE = """
select concat('S', cast(s_suppkey as string)) as source_id, s_name as hpsa_name, cast(n_regionkey as string) as common_state_fips_code, cast(n_nationkey as string) as common_county_fips_code,
  case when s_suppkey % 3 = 0 then 'PC' when s_suppkey % 3 = 1 then 'DH' else 'XX' end as discipline_code,
  case when s_suppkey % 7 = 0 then 'Proposed Withdrawn' when s_suppkey % 13 = 0 then null else 'Designated' end as status_code,
  cast(s_suppkey % 26 + 0.5 as string) as hpsa_score
from {supplier} join {nation} on n_nationkey = s_nationkey
"""


@query(
    "clean_shortage_file",
    f"""select source_id as hpsa_id, hpsa_name, lpad(common_state_fips_code, 2, '0') as state_fips, lpad(common_county_fips_code, 3, '0') as county_fips_3, discipline_code,
  status_code as hpsa_status, cast(round(cast(hpsa_score as double)) as integer) as hpsa_score, lpad(common_state_fips_code, 2, '0') || lpad(common_county_fips_code, 3, '0') as county_fips,
  case discipline_code when 'PC' then 'Primary Care' when 'DH' then 'Dental Health' when 'MH' then 'Mental Health' else discipline_code end as discipline
from {duck(SHORTAGE_FILE)} t where lower(status_code) not like '%withdrawn%'""",
)
def clean_shortage_file(spark, d):
    return clean_source(shared(spark, d, SHORTAGE_FILE), REGISTRY["hrsa_hpsa"])


UNDERSERVED_FILE = """
select concat('M', cast(s_suppkey as string)) as source_id, case when s_suppkey % 4 = 0 then concat('MUP ', s_name) else s_name end as area_name,
  cast(n_regionkey as string) as state_fips_code, cast(n_nationkey as string) as county_fips_code,
  case when s_suppkey % 6 = 0 then 'none' else cast(s_suppkey % 100 as string) end as imu_score, case when s_suppkey % 9 = 0 then 'WITHDRAWN' else 'Designated' end as st
from {supplier} join {nation} on n_nationkey = s_nationkey
"""


@query(
    "clean_underserved_file",
    f"""select source_id as mua_source_id, area_name as mua_name, lpad(state_fips_code, 2, '0') as state_fips, lpad(county_fips_code, 3, '0') as county_fips_3,
  try_cast(imu_score as double) as imu_score, st as status, lpad(state_fips_code, 2, '0') || lpad(county_fips_code, 3, '0') as county_fips,
  coalesce(try_cast(imu_score as double) <= 62, true) as medically_underserved, case when area_name like '%MUP%' then 'MUP' else 'MUA' end as designation_type
from {duck(UNDERSERVED_FILE)} t where st = 'Designated'""",
)
def clean_underserved_file(spark, d):
    df = shared(spark, d, UNDERSERVED_FILE).withColumnRenamed("st", "MUA/P Status")
    return clean_source(df, REGISTRY["hrsa_mua"])


FOOD_ALL = """
select cast(cast(1000000000 + p_partkey % 1500 as double) as string) as CensusTract, p_type as State, cast(cast(p_size % 2 as double) as string) as Urban,
  cast(p_size * 2.5 as string) as PovertyRate, cast(p_size % 3 as string) as LowIncomeTracts, cast(p_partkey % 1500 as string) as POP2010
from {part}
"""


@query(
    "clean_food_atlas",
    f"""select lpad(cast(cast(cast("CensusTract" as double) as bigint) as varchar), 11, '0') as census_tract, min(cast("POP2010" as bigint)) as total_pop, count(distinct "CensusTract") as tracts
from {duck(FOOD_ALL)} t group by 1""",
)
def clean_food_atlas(spark, d):
    clean = clean_source(shared(spark, d, FOOD_ALL), REGISTRY["usda_food_access"])
    return clean.groupBy("census_tract").agg(F.min("total_pop").alias("total_pop"), F.count(F.lit(1)).alias("tracts"))


@query(
    "clean_food_flags",
    """select lpad(cast(2000000000 + p_partkey as varchar), 11, '0') as census_tract, p_type as state, least(p_size * 2.5::double, 100.0::double) as poverty_rate, p_size % 3 = 1 as low_income,
  p_partkey as total_pop, p_size % 2 = 1 as urban from part""",
)
def clean_food_flags(spark, d):
    raw = shared(
        spark,
        d,
        "select cast(cast(2000000000 + p_partkey as double) as string) as CensusTract, p_type as State, cast(cast(p_size % 2 as double) as string) as Urban, cast(p_size * 2.5 as string) as PovertyRate, cast(p_size % 3 as string) as LowIncomeTracts, cast(p_partkey as string) as POP2010 from {part}",
    )
    return clean_source(raw, REGISTRY["usda_food_access"])


HAZARD_FILE = """
select cast(n_regionkey as string) as STATEFIPS, concat(' ', r_name) as STATE, concat(n_name, ' ') as COUNTY, cast(n_nationkey as string) as STCOFIPS,
  case when n_nationkey % 5 = 0 then '*' when n_nationkey % 5 = 1 then concat(cast(n_nationkey as string), '.5*') else concat(' ', cast(n_nationkey as string)) end as RISK_SCORE,
  cast(n_nationkey * 100 as string) as POPULATION, 'Very Low' as RISK_RATNG from {nation} join {region} on r_regionkey = n_regionkey
"""


@query(
    "clean_hazard_index",
    f"""select lpad("STATEFIPS", 2, '0') as state_fips, trim("STATE") as state_name, trim("COUNTY") as county_name, lpad("STCOFIPS", 5, '0') as county_fips,
  try_cast(trim(replace("RISK_SCORE", '*', '')) as double) as risk_score, cast("POPULATION" as bigint) as population, "RISK_RATNG" as risk_rating from {duck(HAZARD_FILE)} t""",
)
def clean_hazard_index(spark, d):
    return clean_source(shared(spark, d, HAZARD_FILE), REGISTRY["fema_nri"])


CRIME_FILE = """
select cast(n_regionkey as string) as fips_state, cast(n_nationkey as string) as fips_county, concat(n_name, ' ') as county_name,
  cast(n as string) as violent_crime_total, cast(n * 3 as string) as property_crime_total, case when n_nationkey % 8 = 0 then '0' else cast(n * 70 as string) end as population, '2021' as year
from (select n_regionkey, n_nationkey, n_name, count(*) as n from {customer} join {nation} on n_nationkey = c_nationkey group by n_regionkey, n_nationkey, n_name) g
"""


@query(
    "clean_crime_counts",
    f"""select fips_state as state_fips_raw, fips_county as county_fips_raw, trim(county_name) as county_name, cast(violent_crime_total as bigint) as violent_crime,
  cast(property_crime_total as bigint) as property_crime, cast(population as bigint) as population, cast(year as integer) as year, lpad(fips_state, 2, '0') as state_fips,
  lpad(fips_state, 2, '0') || lpad(fips_county, 3, '0') as county_fips,
  case when cast(population as bigint) > 0 then {rnd('cast(violent_crime_total as double) / cast(population as double) * 100000.0', 1)} end as violent_crime_rate,
  case when cast(population as bigint) > 0 then {rnd('cast(property_crime_total as double) / cast(population as double) * 100000.0', 1)} end as property_crime_rate
from {duck(CRIME_FILE)} t""",
)
def clean_crime_counts(spark, d):
    return clean_source(shared(spark, d, CRIME_FILE), REGISTRY["fbi_ucr"])


PLACES = """
select cast(year(ts) as string) as Year, concat(event_type, '  ') as LocationName, cast(user_id as string) as TotalPopulation,
  case when event_id % 20 = 0 then 'N/A' else cast(value as string) end as Data_Value from {events}
"""


@query(
    "clean_health_records",
    f"""select cast("Year" as integer) as year, trim("LocationName") as locationname, cast("TotalPopulation" as bigint) as totalpopulation, try_cast("Data_Value" as double) as data_value from {duck(PLACES)} t""",
)
def clean_health_records(spark, d):
    return clean_source(shared(spark, d, PLACES), REGISTRY["cdc_places"])


@query(
    "clean_env_health_json",
    """select event_id, case when event_id % 2 = 0 then user_id::varchar else 'g' || user_id end as geo_id, 3 as geo_type, trim(event_type || ' ') as geo_name, cast(user_id as integer) as measure_id,
  '' as measure_name, 'Air' as content_area, case when event_id % 3 = 0 then '2019' else '2021' end as year, case when event_id % 7 = 0 then null else value end as data_value, '' as data_value_unit, '' as confidence_interval from events""",
)
def clean_env_health_json(spark, d):
    e = table(spark, d, "events")
    k = F.col("event_id")
    value = F.when(k % 7 == 0, F.lit("*")).otherwise(F.col("value").cast("string"))
    doc = F.when(
        k % 2 == 0,
        F.to_json(F.struct(F.col("user_id").cast("string").alias("geoId"), F.concat("event_type", F.lit(" ")).alias("geo"), F.when(k % 3 == 0, "2019").alias("year"), value.alias("dataValue"))),
    ).otherwise(
        F.to_json(F.struct(F.concat(F.lit("g"), F.col("user_id").cast("string")).alias("geo_id"), F.concat("event_type", F.lit(" ")).alias("geoName"), F.when(k % 3 == 0, "2019").alias("temporal"), value.alias("value")))
    )
    rows = e.select("event_id", doc.alias("doc"), F.col("user_id").cast("string").alias("measure"))
    return env_health_records(rows, "doc", "measure", 3, "Air", "2021", keep=["event_id"])


def _alert_payloads(spark, d):
    """Events as GeoJSON alert features, ten to a collection."""
    k = F.col("event_id")
    severity = F.when(F.col("event_type") == "error", "Extreme").when(F.col("event_type") == "click", "Severe").when(
        F.col("event_type") == "view", "Odd"
    )
    feature = F.struct(
        F.struct(
            F.concat(F.lit("urn:"), k.cast("string")).alias("id"),
            F.col("event_type").alias("event"),
            severity.alias("severity"),
            F.repeat("event_type", F.when(k % 10 == 0, 500).otherwise(1)).alias("description"),
            F.when(k % 2 == 0, "Cook, IL").alias("areaDesc"),
            F.array(F.lit("https://x/zones/ILC031"), F.concat(F.lit("https://x/zones/Z"), F.col("user_id").cast("string"))).alias("affectedZones"),
            F.struct(F.when(k % 3 == 0, F.array(F.lit("WIC001"))).when(k % 3 == 1, F.array(F.lit("9XC001"))).alias("UGC")).alias("geocode"),
        ).alias("properties")
    )
    groups = table(spark, d, "events").groupBy(F.floor(k / 10).alias("g")).agg(F.collect_list(feature).alias("features"))
    return groups.select(F.to_json(F.struct("features")).alias("payload"))


@query(
    "clean_alert_features",
    """select 'urn:' || event_id as alert_id, event_type as event, case event_type when 'error' then 'Extreme' when 'click' then 'Severe' when 'view' then 'Odd' else 'Unknown' end as severity,
  case event_type when 'error' then 5 when 'click' then 4 else 1 end as severity_rank, length(repeat(event_type, case when event_id % 10 = 0 then 500 else 1 end)) as description_chars, length(left(repeat(event_type, case when event_id % 10 = 0 then 500 else 1 end), 2000)) as short_chars,
  case when event_id % 2 = 0 then 'Cook, IL' end as area_desc, 'ILC031,Z' || user_id as affected_zones,
  case when event_id % 3 = 0 then 'WI' when event_id % 2 = 0 then 'IL' end as state from events""",
)
def clean_alert_features(spark, d):
    flat = parse_alerts(alert_features(_alert_payloads(spark, d), "payload"), F.lit("2024-01-01").cast("timestamp"), state_filter="IL")
    return flat.select(
        "alert_id", "event", "severity", "severity_rank", F.length("description").alias("description_chars"), F.length("description_short").alias("short_chars"), "area_desc", "affected_zones", "state"
    )


@query(
    "contract_directory_summary",
    f"""select 'nces_ccd' as contract, count(*) as total, count(*) filter (not ok) as dropped, {rnd('count(*) filter (not ok) * 100.0 / count(*)', 1)} as dropped_pct from (
  select regexp_full_match("STABR", '[A-Z]{{2}}') and coalesce(try_cast("LATCOD" as double) between 17 and 72, true) and cast("LONCOD" as double) between -180 and -65 as ok
  from {duck(DIRECTORY)} t where "SCHOOL_TYPE" in ('1', '2', '3', '4')) q""",
)
def contract_directory_summary(spark, d):
    clean = clean_source(shared(spark, d, DIRECTORY), REGISTRY["nces_ccd"])
    return validate(clean, CONTRACTS["nces_ccd"])[2]


ORDER_SCHEMA = {
    "required": ["o_orderkey", "o_orderstatus"],
    "properties": {
        "o_orderkey": {"type": "integer", "minimum": 10},
        "o_orderstatus": {"type": "string", "enum": ["F", "O", None]},
        "o_totalprice": {"type": ["number", "null"], "minimum": 0, "maximum": 450000},
        "o_orderpriority": {"type": "string", "pattern": "^[1-4]-"},
    },
}


@query(
    "contract_from_json_schema_violations",
    """select violation, count(*) as row_count from (
  select unnest([case when o_orderkey < 10 then 'o_orderkey:minimum' end, case when o_orderstatus not in ('F', 'O') then 'o_orderstatus:enum' end,
    case when o_totalprice > 450000 then 'o_totalprice:maximum' end, case when not regexp_matches(o_orderpriority, '^[1-4]-') then 'o_orderpriority:pattern' end]) as violation from orders
) q where violation is not null group by 1""",
)
def json_schema_violations(spark, d):
    return violation_counts(table(spark, d, "orders"), contract_from_json_schema("orders", ORDER_SCHEMA))


@query(
    "contract_valid_rows",
    """select o_orderkey, o_orderstatus, o_totalprice from orders where o_orderkey >= 10 and o_orderstatus in ('F', 'O') and o_totalprice between 0 and 450000 and o_orderpriority[1] in ('1', '2', '3', '4')""",
)
def contract_valid_rows(spark, d):
    valid, _, _ = validate(table(spark, d, "orders"), contract_from_json_schema("orders", ORDER_SCHEMA))
    return valid.select("o_orderkey", "o_orderstatus", "o_totalprice")
