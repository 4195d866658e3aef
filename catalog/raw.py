"""Raw source tables derived from the driver tables by SQL both engines read alike.

Customers stand for schools and census tracts, nations for counties, regions for
states, order years for survey years, suppliers for shortage areas, parts for
food-access tracts and events for health measures.
"""


SCHOOLS = """
select cast(c_custkey as string) as ncessch, c_name as sch_name, concat('District ', c_mktsegment) as lea_name,
  cast(n_nationkey * 7 + 3 as string) as leaid, cast(n_regionkey + 1 as string) as fipst,
  concat(' ', lower(substring(r_name, 1, 2)), ' ') as stabr,
  cast((n_regionkey + 1) * 1000 + n_nationkey as string) as cnty, concat(n_name, '   ') as coname,
  case when c_custkey % 29 = 0 then null else 25.0 + (c_custkey * 37 % 2300) / 100.0 end as latitude,
  case when c_custkey % 29 = 0 then null else -120.0 + (c_custkey * 53 % 5000) / 100.0 end as longitude,
  n_orders * 120 - 130 as member, n_open * 60 - 40 as free_lunch, n_done * 25 - 10 as reduced_lunch,
  cast(n_orders * 7 as double) as total_staff, cast(c_custkey % 4 as int) as title_i_status,
  cast(c_custkey % 6 as int) as sch_type, cast(case when c_custkey % 17 = 0 then 2 when c_custkey % 19 = 0 then 6 when c_custkey % 3 = 0 then 3 else 1 end as int) as updated_status,
  case when c_custkey % 5 = 0 then null else '01' end as g_lograde, case when c_custkey % 7 = 0 then null else '08' end as g_higrade,
  cast(yr as string) as school_year,
  case when c_custkey % 11 = 0 then -1.0 else floor(avg_price / 500.0) / 10.0 end as math_proficiency,
  case when c_custkey % 13 = 0 then -1.0 else floor(max_price / 500.0) / 10.0 end as reading_proficiency,
  case when c_custkey % 10 = 0 then -1.0 else floor(min_price / 1000.0) / 10.0 end as chronic_absenteeism_rate,
  last_date as _loaded_at
from (
  select o_custkey, year(o_orderdate) as yr, count(*) as n_orders,
    sum(case when o_orderstatus = 'O' then 1 else 0 end) as n_open,
    sum(case when o_orderstatus = 'F' then 1 else 0 end) as n_done,
    sum(cast(round(o_totalprice * 100) as bigint)) / 100.0 / count(*) as avg_price,
    max(o_totalprice) as max_price, min(o_totalprice) as min_price, max(o_orderdate) as last_date
  from {orders} group by o_custkey, year(o_orderdate)
) y join {customer} on c_custkey = o_custkey join {nation} on n_nationkey = c_nationkey join {region} on r_regionkey = n_regionkey
"""

STATES = """
select case when r_regionkey <> 4 then lpad(cast(r_regionkey + 1 as string), 2, '0') end as fips_code, upper(substring(r_name, 1, 2)) as state_abbr, r_name as state_name
from {region}
"""

HEALTH = """
select case when user_id % 9 = 8 then cast(n_nationkey as string)
    else cast((cast(n_regionkey as bigint) + 1) * 1000000000 + cast(n_nationkey as bigint) * 1000000 + user_id % 1000000 as string) end as locationid,
  concat(' ', c_name, ' ') as locationname, lower(substring(r_name, 1, 2)) as stateabbr,
  concat(upper(event_type), ' ') as measureid, concat('measure ', event_type) as measure, 'Crude prevalence' as data_value_type,
  'Outcomes' as category, case when event_id % 50 = 0 then null else value end as data_value,
  value - 1.0 as low_confidence_limit, value + 1.0 as high_confidence_limit,
  cast(user_id * 10 as int) as totalpopulation, year(ts) as year, ts as _loaded_at
from {events} join {customer} on c_custkey = user_id join {nation} on n_nationkey = c_nationkey join {region} on r_regionkey = n_regionkey
"""

CENSUS = """
select cast(n_regionkey + 1 as string) as state_fips, cast(n_nationkey as string) as county_fips, cast(c_custkey % 1000000 as string) as tract_fips,
  case when c_custkey % 23 = 0 then -666666666 when c_custkey % 31 = 0 then 0 else n_orders * 100 end as total_poverty_universe,
  n_done * 30 as below_poverty_level,
  case when c_custkey % 37 = 0 then -666666666 else n_orders * 40 end as child_poverty_universe,
  n_open * 17 as children_below_poverty,
  case when c_custkey % 41 = 0 then 0 else n_orders * 45 end as child_insurance_universe,
  n_other * 13 as children_uninsured,
  case when c_custkey % 43 = 0 then -666666666 else cast(floor(c_acctbal * 10) as bigint) end as median_household_income,
  case when c_custkey % 47 = 0 then 0 else n_orders * 100 end as total_population,
  2022 as acs_year, last_date as _loaded_at
from (
  select o_custkey, count(*) as n_orders, sum(case when o_orderstatus = 'F' then 1 else 0 end) as n_done,
    sum(case when o_orderstatus = 'O' then 1 else 0 end) as n_open, sum(case when o_orderstatus = 'P' then 1 else 0 end) as n_other,
    max(o_orderdate) as last_date
  from {orders} group by o_custkey
) y join {customer} on c_custkey = o_custkey join {nation} on n_nationkey = c_nationkey
"""

COUNTY_YEARS = """
select n_nationkey, n_regionkey, n_name, year(o_orderdate) as yr, count(*) as n_orders,
  sum(case when o_orderstatus = 'F' then 1 else 0 end) as n_done, sum(case when o_orderstatus = 'O' then 1 else 0 end) as n_open,
  sum(case when o_orderpriority = '1-URGENT' then 1 else 0 end) as n_urgent,
  sum(case when o_totalprice > 400000 then 1 else 0 end) as n_big, sum(case when o_totalprice < 50000 then 1 else 0 end) as n_small,
  max(o_orderdate) as last_date
from {orders} join {customer} on c_custkey = o_custkey join {nation} on n_nationkey = c_nationkey
group by n_nationkey, n_regionkey, n_name, year(o_orderdate)
"""

AIR = f"""
select cast(n_regionkey + 1 as string) as state_code, cast(n_nationkey as string) as county_code, concat(n_name, ' ') as county_name,
  ' ST' as state_abbr, yr as year, case when n_nationkey = 5 or (yr = 2001 and n_nationkey % 3 = 0) then null else 20 + n_done * 50.0 / n_orders end as median_aqi,
  60 + n_open * 50.0 / n_orders as percentile_90_aqi, 100 + n_orders % 97 as max_aqi,
  200 + n_small % 100 as good_days, n_open % 60 as moderate_days, n_done % 20 as unhealthy_sensitive_days,
  n_big % 15 as unhealthy_days, n_urgent % 7 as very_unhealthy_days, n_small % 3 as hazardous_days, 360 as days_with_aqi,
  case when n_nationkey % 4 = 0 then '  ' when n_nationkey % 4 = 1 then ' Ozone ' when n_nationkey % 4 = 2 then 'PM2.5' else null end as main_pollutant,
  last_date as _loaded_at
from ({COUNTY_YEARS}) cy
"""

CRIME = f"""
select cast(n_regionkey + 1 as string) as fips_state, cast(n_nationkey as string) as fips_county, concat(' ', n_name) as county_name,
  ' st ' as state_abbr, yr as year, case when n_nationkey = 7 then null else floor(n_done * 10000.0 / n_orders) / 10.0 end as violent_crime_rate,
  floor(n_open * 20000.0 / n_orders) / 10.0 as property_crime_rate, n_done as violent_crime_count, n_open as property_crime_count,
  n_orders * 100 as population,
  case when n_nationkey % 6 = 0 then 0.0 when yr = 2001 then 30.0 when n_nationkey % 5 = 0 then 50.0 else 80.0 + n_nationkey end as coverage_pct,
  last_date as _loaded_at
from ({COUNTY_YEARS}) cy
"""

SHORTAGE = """
select concat('H', cast(s_suppkey as string)) as hpsa_id, concat(' ', s_name) as hpsa_name,
  case cast(s_suppkey % 3 as int) when 0 then 'Primary Care ' when 1 then ' Dental Health' else 'Mental Health' end as discipline_type,
  'Geographic' as hpsa_type, case when s_suppkey % 5 = 0 or n_nationkey = 11 then 'Withdrawn' when s_suppkey % 11 = 3 then null else ' Designated' end as hpsa_status,
  cast(n_regionkey + 1 as string) as state_fips, cast((n_regionkey + 1) * 1000 + n_nationkey as string) as county_fips,
  ' st' as state_abbr, concat(n_name, ' ') as county_name, cast(s_suppkey % 26 as int) as hpsa_score,
  cast(s_suppkey % 4 as double) * 1000 as provider_ratio, case when s_suppkey % 6 = 0 then 'unknown' else '2020-02-15' end as designation_date,
  timestamp '2024-01-01 00:00:00' as _loaded_at
from {supplier} join {nation} on n_nationkey = s_nationkey
"""

FOOD = """
select case when p_partkey % 101 = 7 or n_nationkey = 13 then null else cast((cast(n_regionkey as bigint) + 1) * 1000000000 + cast(n_nationkey as bigint) * 1000000 + p_partkey % 1000000 as string) end as census_tract,
  cast(n_regionkey + 1 as string) as state_fips, ' st' as state_abbr, n_name as county_name,
  cast(case when p_size % 9 = 0 then null when p_size % 2 = 0 then 1 else 0 end as int) as low_income_flag,
  cast(case when p_partkey % 3 = 0 then 1 else 0 end as int) as la_flag_1mile, cast(p_partkey % 2 as int) as la_flag_10mile,
  cast(p_partkey % 5 as int) as la_flag_half_mile, cast(p_size % 2 as int) as urban_flag, cast(p_size * 100 as int) as population,
  cast(p_size * 10 as int) as low_access_pop_1mile, cast(p_size as int) as low_access_pop_10mile, timestamp '2024-01-01 00:00:00' as _loaded_at
from {part} join {nation} on n_nationkey = p_partkey % 25
"""

HAZARDS = """
select cast((n_regionkey + 1) * 1000 + n_nationkey as string) as stcofips, concat(n_name, ' ') as county, concat(' ', r_name) as state,
  case when n_nationkey = 3 then null else floor(n_sup * 137 % 1000) / 10.0 end as risk_score, 'Very Low' as risk_rating,
  floor(bal * 3) as eal_valt, floor(bal % 1000) / 10.0 as sovi_score, 'Very High' as sovi_ratng, 50.5 as resl_score, 'Low' as resl_ratng,
  n_sup * 1.5 as hwav_ealv, n_sup * 2.5 as trnd_ealv, n_sup * 3.5 as rfld_ealv, n_sup * 4.5 as hrcn_ealv, n_sup * 5.5 as wfir_ealv,
  cast(n_sup * 1000 as int) as population, timestamp '2024-01-01 00:00:00' as _loaded_at
from (
  select n_nationkey, n_regionkey, n_name, r_name, count(s_suppkey) as n_sup, coalesce(floor(sum(cast(round(s_acctbal * 100) as bigint)) / 100.0), 0) + 20000 as bal
  from {nation} join {region} on r_regionkey = n_regionkey left join {supplier} on s_nationkey = n_nationkey
  group by n_nationkey, n_regionkey, n_name, r_name
) h
"""

RAW = {
    "schools": SCHOOLS,
    "health_measures": HEALTH,
    "census": CENSUS,
    "air_quality": AIR,
    "crime": CRIME,
    "hazards": HAZARDS,
    "shortage_areas": SHORTAGE,
    "food_access": FOOD,
    "states": STATES,
}

YEAR, PRIOR_YEAR = "2000", "1999"

# Event types stand for the measure ids.
MEASURES = {"click": "asthma_pct", "view": "poor_mental_health_pct", "purchase": "obesity_pct", "error": "dental_visit_pct"}
