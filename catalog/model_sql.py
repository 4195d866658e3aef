"""Oracle SQL for the staging, silver and gold models, built from small expression helpers."""

from __future__ import annotations

from .base import duck, rnd
from .raw import MEASURES, PRIOR_YEAR, RAW, YEAR


def whole(c: str) -> str:
    return f"cast(round(cast({c} as double)) as integer)"


def rate(part: str, total: str) -> str:
    value = rnd(f"cast({part} as double) / cast({total} as double) * 100.0")
    return f"case when {total} is null or {total} in (0, -666666666) then null else {value} end"


def src(name: str) -> str:
    return duck(RAW[name]) + " r"


def days(*names: str) -> str:
    return ", ".join(f"{whole(n)} as {n}" for n in names)


STG = {
    "schools": f"""
select lpad(ncessch, 12, '0') as nces_school_id, sch_name as school_name, lea_name as district_name, lpad(leaid, 7, '0') as district_id,
  lpad(fipst, 2, '0') as state_fips, upper(trim(stabr)) as state_abbr, lpad(cnty, 5, '0') as county_fips, trim(coname) as county_name,
  cast(latitude as double) as latitude, cast(longitude as double) as longitude,
  case when member >= 0 then {whole('member')} end as total_enrollment,
  case when free_lunch >= 0 then {whole('free_lunch')} end as free_lunch_eligible,
  case when reduced_lunch >= 0 then {whole('reduced_lunch')} end as reduced_lunch_eligible,
  case when total_staff > 0 and member > 0 then {rnd('member / total_staff', 1)} end as student_teacher_ratio,
  case title_i_status when 1 then true when 2 then false end as is_title_i, sch_type as school_type_code,
  coalesce(map {{1: 'Regular', 2: 'Special Education', 3: 'Vocational', 4: 'Alternative'}}[sch_type], 'Other') as school_type,
  'Open' as operational_status, coalesce(g_lograde, 'PK') as lowest_grade, coalesce(g_higrade, '12') as highest_grade, school_year,
  cast(nullif(math_proficiency, -1) as double) as math_proficiency_pct, cast(nullif(reading_proficiency, -1) as double) as reading_proficiency_pct,
  cast(nullif(chronic_absenteeism_rate, -1) as double) as chronic_absenteeism_pct, _loaded_at
from {src('schools')} where ncessch is not null and updated_status in (1, 3)
""",
    "health_measures": f"""
select lpad(locationid, 11, '0') as census_tract_fips, left(lpad(locationid, 11, '0'), 5) as county_fips, trim(locationname) as location_name,
  upper(trim(stateabbr)) as state_abbr, lower(trim(measureid)) as measure_id, trim(measure) as measure_name, data_value,
  low_confidence_limit as ci_low, high_confidence_limit as ci_high, totalpopulation as total_population, data_value_type as value_type,
  cast(year as integer) as data_year, category as measure_category, _loaded_at
from {src('health_measures')} where length(locationid) > 9 and data_value is not null
""",
    "census": f"""
select lpad(state_fips, 2, '0') || lpad(county_fips, 3, '0') || lpad(tract_fips, 6, '0') as census_tract_fips,
  lpad(state_fips, 2, '0') || lpad(county_fips, 3, '0') as county_fips, lpad(state_fips, 2, '0') as state_fips,
  {rate('below_poverty_level', 'total_poverty_universe')} as poverty_rate,
  {rate('children_below_poverty', 'child_poverty_universe')} as child_poverty_rate,
  {rate('children_uninsured', 'child_insurance_universe')} as uninsured_children_rate,
  cast(nullif(median_household_income, -666666666) as integer) as median_household_income,
  cast(nullif(nullif(total_population, -666666666), 0) as integer) as total_population, acs_year, _loaded_at
from {src('census')} where state_fips is not null
""",
    "air_quality": f"""
select lpad(state_code, 2, '0') || lpad(county_code, 3, '0') as county_fips, trim(county_name) as county_name, trim(state_abbr) as state_abbr,
  cast(year as integer) as data_year, {whole('median_aqi')} as median_aqi, {whole('percentile_90_aqi')} as p90_aqi, {whole('max_aqi')} as max_aqi,
  {days('good_days', 'moderate_days', 'unhealthy_sensitive_days', 'unhealthy_days', 'very_unhealthy_days', 'hazardous_days', 'days_with_aqi')},
  coalesce(nullif(trim(main_pollutant), ''), 'Unknown') as dominant_pollutant, _loaded_at
from {src('air_quality')} where median_aqi is not null and state_code is not null and county_code is not null
""",
    "crime": f"""
select lpad(fips_state, 2, '0') || lpad(fips_county, 3, '0') as county_fips, trim(county_name) as county_name, upper(trim(state_abbr)) as state_abbr,
  cast(year as integer) as data_year, cast(violent_crime_rate as double) as violent_crime_rate, cast(property_crime_rate as double) as property_crime_rate,
  {days('violent_crime_count', 'property_crime_count', 'population')},
  case when coverage_pct > 0 then cast(coverage_pct as double) end as agency_coverage_pct, _loaded_at
from {src('crime')} where violent_crime_rate is not null and fips_state is not null and fips_county is not null
""",
    "hazards": f"""
select lpad(stcofips, 5, '0') as county_fips, left(lpad(stcofips, 5, '0'), 2) as state_fips, trim(county) as county_name, trim(state) as state_name,
  cast(risk_score as double) as nri_risk_score, cast(eal_valt as double) as expected_annual_loss, cast(sovi_score as double) as social_vulnerability_score,
  cast(resl_score as double) as community_resilience_score, cast(hwav_ealv as double) as heatwave_loss, cast(trnd_ealv as double) as tornado_loss,
  cast(rfld_ealv as double) as riverine_flood_loss, cast(hrcn_ealv as double) as hurricane_loss, cast(wfir_ealv as double) as wildfire_loss,
  risk_rating as nri_risk_rating, sovi_ratng as social_vulnerability_rating, resl_ratng as community_resilience_rating,
  {whole('population')} as population, _loaded_at
from {src('hazards')} where risk_score is not null and stcofips is not null
""",
    "shortage_areas": f"""
select hpsa_id, trim(hpsa_name) as hpsa_name, lower(trim(discipline_type)) as discipline_type, lower(trim(hpsa_type)) as designation_type,
  hpsa_score, lower(trim(hpsa_status)) as designation_status, lpad(state_fips, 2, '0') as state_fips, lpad(county_fips, 5, '0') as county_fips,
  upper(trim(state_abbr)) as state_abbr, trim(county_name) as county_name, nullif(provider_ratio, 0) as provider_ratio,
  try_cast(designation_date as date) as designation_date, _loaded_at
from {src('shortage_areas')} where lower(trim(hpsa_status)) = 'designated'
""",
    "food_access": f"""
select lpad(census_tract, 11, '0') as census_tract_fips, left(lpad(census_tract, 11, '0'), 5) as county_fips, lpad(state_fips, 2, '0') as state_fips,
  upper(trim(state_abbr)) as state_abbr, trim(county_name) as county_name, coalesce(low_income_flag, 0) = 1 as is_low_income,
  coalesce(la_flag_1mile, 0) = 1 as is_low_access_1mi, coalesce(la_flag_10mile, 0) = 1 as is_low_access_10mi,
  coalesce(la_flag_half_mile, 0) = 1 as is_low_access_half_mi, coalesce(low_income_flag, 0) = 1 and coalesce(la_flag_1mile, 0) = 1 as is_food_desert,
  population as tract_population, low_access_pop_1mile as low_access_pop_1mi, low_access_pop_10mile as low_access_pop_10mi,
  coalesce(urban_flag, 0) = 1 as is_urban, _loaded_at
from {src('food_access')} where census_tract is not null
""",
}

PROFILES = f"""
select n.* exclude (operational_status, state_fips), n.state_fips, coalesce(l.state_name, n.state_abbr) as state_name,
  n.total_enrollment - b.total_enrollment as enrollment_change, n.math_proficiency_pct - b.math_proficiency_pct as math_proficiency_change,
  n.reading_proficiency_pct - b.reading_proficiency_pct as reading_proficiency_change,
  n.chronic_absenteeism_pct - b.chronic_absenteeism_pct as absenteeism_change,
  coalesce(n.free_lunch_eligible, 0) + coalesce(n.reduced_lunch_eligible, 0) as frpl_eligible,
  case when n.total_enrollment > 0 then {rnd('(coalesce(n.free_lunch_eligible, 0) + coalesce(n.reduced_lunch_eligible, 0)) / n.total_enrollment * 100.0', 1)} end as frpl_pct
from stg_schools n left join stg_schools b on b.nces_school_id = n.nces_school_id and b.school_year = '{PRIOR_YEAR}'
left join {duck(RAW['states'])} l on l.fips_code = n.state_fips where n.school_year = '{YEAR}'
"""

CENSUS_COUNTY = """
select county_fips, avg(poverty_rate) as poverty_rate, avg(child_poverty_rate) as child_poverty_rate, avg(uninsured_children_rate) as uninsured_children_rate,
  avg(median_household_income) as median_household_income, sum(total_population) as county_population from stg_census group by 1
"""

MEASURE_COUNTY = (
    "select county_fips, "
    + ", ".join(f"avg(data_value) filter (measure_id = '{m}') as {c}" for m, c in MEASURES.items())
    + " from stg_health_measures group by 1"
)

AIR_LATEST = """
select county_fips, median_aqi, p90_aqi, good_days as aqi_good_days, unhealthy_days + very_unhealthy_days + hazardous_days as bad_air_days,
  days_with_aqi, dominant_pollutant, data_year as aqi_year from stg_air_quality
qualify row_number() over (partition by county_fips order by data_year desc) = 1
"""


def crime_latest(where: str) -> str:
    return f"""
select county_fips, violent_crime_rate, property_crime_rate, violent_crime_count, property_crime_count, agency_coverage_pct as crime_coverage_pct,
  data_year as crime_year from stg_crime where {where} qualify row_number() over (partition by county_fips order by data_year desc) = 1
"""


SHORTAGE_COUNTY = (
    "select county_fips, "
    + ", ".join(
        f"max(hpsa_score) filter (discipline_type = '{d}') as hpsa_{s}_score, bool_or(discipline_type = '{d}') as has_{s}_shortage"
        for d, s in (("primary care", "primary_care"), ("mental health", "mental_health"), ("dental health", "dental"))
    )
    + ", max(hpsa_score) as max_hpsa_score from stg_shortage_areas group by 1"
)

FOOD_COUNTY = f"""
select county_fips, {rnd('avg(case when is_food_desert then 1.0 else 0.0 end) * 100', 1)} as pct_tracts_food_desert,
  coalesce(sum(tract_population) filter (is_food_desert), 0) as food_desert_population, count(*) filter (is_food_desert) as food_desert_tract_count,
  count(*) as county_tract_count from stg_food_access group by 1
"""

HEALTH_CONTEXT = (
    "select p.nces_school_id, c.* exclude (county_fips), m.* exclude (county_fips) "
    "from profiles p left join census_county c using (county_fips) left join measure_county m using (county_fips)"
)

HAZARD_COLS = (
    "nri_risk_score, nri_risk_rating, expected_annual_loss, f.social_vulnerability_score, f.social_vulnerability_rating, "
    "f.community_resilience_score, heatwave_loss, tornado_loss, wildfire_loss"
)
ENVIRONMENT = (
    f"select p.nces_school_id, a.* exclude (county_fips), {HAZARD_COLS} "
    "from profiles p left join air_latest a using (county_fips) left join stg_hazards f on f.county_fips = p.county_fips"
)
SAFETY = (
    "select p.nces_school_id, k.* exclude (county_fips), f.social_vulnerability_score, f.social_vulnerability_rating, f.community_resilience_score, "
    "k.violent_crime_rate is null or coalesce(k.crime_coverage_pct < 60, false) as low_confidence_crime "
    "from profiles p left join crime_latest k using (county_fips) left join stg_hazards f on f.county_fips = p.county_fips"
)
NO_SHORTAGE = ", ".join(
    f"coalesce(h.has_{s}_shortage, false) as has_{s}_shortage" for s in ("primary_care", "mental_health", "dental")
)
RESOURCES = (
    "select p.nces_school_id, h.hpsa_primary_care_score, h.hpsa_mental_health_score, h.hpsa_dental_score, "
    f"{NO_SHORTAGE}, coalesce(h.has_primary_care_shortage, false) or coalesce(h.has_mental_health_shortage, false) as is_hpsa_designated, "
    "d.* exclude (county_fips), coalesce(d.pct_tracts_food_desert, 0) > 30 as is_food_desert_area "
    "from profiles p left join shortage_county h using (county_fips) left join food_county d using (county_fips)"
)
COMMUNITY = """
select s.*, c.poverty_rate as avg_poverty_rate, c.child_poverty_rate as avg_child_poverty_rate, c.uninsured_children_rate as avg_uninsured_rate,
  c.median_household_income as avg_median_income, c.county_population as total_population, a.median_aqi, a.bad_air_days, f.nri_risk_score,
  f.social_vulnerability_score, f.community_resilience_score, f.expected_annual_loss, k.violent_crime_rate, k.property_crime_rate,
  coalesce(h.has_primary_care_shortage, false) as has_primary_care_shortage, coalesce(h.has_mental_health_shortage, false) as has_mental_health_shortage,
  h.max_hpsa_score, d.pct_tracts_food_desert as pct_food_desert
from (
  select county_fips, state_abbr, county_name, state_name, count(*) as school_count, sum(total_enrollment) as total_enrollment,
    count(*) filter (is_title_i) as title_i_count, avg(math_proficiency_pct) as avg_math_proficiency, avg(reading_proficiency_pct) as avg_reading_proficiency,
    avg(chronic_absenteeism_pct) as avg_chronic_absenteeism, avg(student_teacher_ratio) as avg_student_teacher_ratio, avg(frpl_pct) as avg_frpl_pct,
    avg(math_proficiency_change) as avg_math_change, avg(reading_proficiency_change) as avg_reading_change
  from profiles group by all
) s left join census_county c using (county_fips) left join air_latest a using (county_fips) left join stg_hazards f on f.county_fips = s.county_fips
left join crime_any k on k.county_fips = s.county_fips left join shortage_county h on h.county_fips = s.county_fips left join food_county d on d.county_fips = s.county_fips
"""

# (sub-score, column, inverted) of the sub-scores placed between percentiles
BOUNDED = (
    ("math_proficiency_score", "math_proficiency_pct", False),
    ("reading_proficiency_score", "reading_proficiency_pct", False),
    ("chronic_absenteeism_score", "chronic_absenteeism_pct", True),
    ("student_teacher_ratio_score", "student_teacher_ratio", True),
    ("child_poverty_score", "child_poverty_rate", True),
    ("uninsured_children_score", "uninsured_children_rate", True),
    ("food_desert_score", "pct_tracts_food_desert", True),
    ("aqi_score", "median_aqi", True),
    ("fema_hazard_score", "expected_annual_loss", True),
    ("violent_crime_score", "violent_crime_rate", True),
    ("social_vulnerability_inv_score", "social_vulnerability_score", True),
    ("property_crime_score", "property_crime_rate", True),
)
PILLAR_PARTS = {
    "education_score": "math_proficiency_score .3, reading_proficiency_score .3, chronic_absenteeism_score .2, student_teacher_ratio_score .1, title_i_score .1",
    "health_score": "child_poverty_score .25, uninsured_children_score .2, hpsa_score .2, food_desert_score .15, mua_score .1, clinic_distance_score .1",
    "environment_score": "aqi_score .4, fema_hazard_score .3, cdc_env_health_score .3",
    "safety_score": "violent_crime_score .5, social_vulnerability_inv_score .3, property_crime_score .2",
}
COMPOSITE_PARTS = "education_score .3, health_score .3, environment_score .2, safety_score .2"


def scaled(x: str, lo: str, hi: str, inverted: bool = False) -> str:
    """SQL of a 0-100 placement between two bounds."""
    share = f"({x} - {lo}) / nullif({hi} - {lo}, 0)"
    low, high, mid = ("100.0", "0.0", f"(1.0 - {share}) * 100.0") if inverted else ("0.0", "100.0", f"{share} * 100.0")
    return f"case when {x} is null then null when {x} <= {lo} then {low} when {x} >= {hi} then {high} else {rnd(mid)} end"


def blended(parts: str) -> str:
    """SQL of a null-safe weighted mean from `column weight, ...`."""
    pairs = [p.split() for p in parts.split(", ")]
    top = " + ".join(f"coalesce({c} * 0{w}, 0)" for c, w in pairs)
    bottom = " + ".join(f"(case when {c} is null then 0.0 else 0{w} end)" for c, w in pairs)
    top = top.replace(" * 0.", " * cast(0.").replace(", 0)", " as double), 0)")
    bottom = bottom.replace("else 0.", "else cast(0.").replace(" end)", " as double) end)").replace("then 0.0", "then cast(0 as double)")
    return rnd(f"({top}) / nullif({bottom}, 0)")


def labelled(c: str) -> str:
    return f"case when {c} is null then 'Insufficient Data' when {c} < 26 then 'Critical' when {c} < 51 then 'At Risk' when {c} < 76 then 'Moderate' else 'Thriving' end"


_bounds = ", ".join(f"quantile_cont(cast({c} as double), 0.05) as {s}_lo, quantile_cont(cast({c} as double), 0.95) as {s}_hi" for s, c, _ in BOUNDED)
_subs = ", ".join(f"{scaled(f'cast({c} as double)', f'{s}_lo', f'{s}_hi', inv)} as {s}" for s, c, inv in BOUNDED)
_pillars = ", ".join(f"{blended(p)} as {name}" for name, p in PILLAR_PARTS.items())
_labels = ", ".join(f"{labelled(c)} as {c.replace('_score', '_category')}" for c in ("wellbeing_score", *PILLAR_PARTS))
_present = " + ".join(f"({c} is not null)::int" for c in PILLAR_PARTS)
SCORE_CTES = f"""
inputs as (
  select p.*, x.child_poverty_rate, x.uninsured_children_rate, x.asthma_pct, e.median_aqi, e.expected_annual_loss, k.violent_crime_rate,
    k.property_crime_rate, k.social_vulnerability_score, z.is_hpsa_designated, z.has_primary_care_shortage, z.hpsa_primary_care_score, z.pct_tracts_food_desert
  from profiles p left join health x using (nces_school_id) left join environment e using (nces_school_id)
  left join safety k using (nces_school_id) left join resources z using (nces_school_id)
), bounds as (select {_bounds} from inputs),
subs as (
  select i.*, {_subs}, case when is_title_i then 0.0 else 100.0 end as title_i_score, case when is_hpsa_designated then 0.0 else 100.0 end as hpsa_score,
    case when has_primary_care_shortage then 0.0 else 100.0 end as mua_score,
    case when hpsa_primary_care_score is not null then greatest(0.0, 100.0 - hpsa_primary_care_score * 4.0) end as clinic_distance_score,
    case when asthma_pct is not null then greatest(0.0, 100.0 - asthma_pct) end as cdc_env_health_score
  from inputs i, bounds
), pillars as (select *, {_pillars} from subs),
composite as (select *, {blended(COMPOSITE_PARTS)} as wellbeing_score from pillars),
scores as (
  select nces_school_id, school_name, state_abbr, county_fips, county_name, latitude, longitude, total_enrollment, school_type,
    education_score, health_score, environment_score, safety_score, wellbeing_score, {_labels}, math_proficiency_score, reading_proficiency_score,
    chronic_absenteeism_score, child_poverty_score, uninsured_children_score, aqi_score, violent_crime_score, {_present} as pillars_with_data
  from composite where wellbeing_score is not null
)
"""

_order = "education_score health_score environment_score safety_score".split()
_ranks = ", ".join(f"rank() over (order by {c} desc nulls last) as {c.replace('_score', '')}_national_rank" for c in _order)
RANKINGS = f"""
select nces_school_id, school_name, state_abbr, county_fips, county_name, total_enrollment, school_type, wellbeing_score, wellbeing_category,
  {', '.join(_order)}, pillars_with_data, rank() over (order by wellbeing_score desc) as national_rank, count(*) over () as national_total,
  percent_rank() over (order by wellbeing_score) as national_percentile,
  rank() over (partition by state_abbr order by wellbeing_score desc) as state_rank, count(*) over (partition by state_abbr) as state_total,
  percent_rank() over (partition by state_abbr order by wellbeing_score) as state_percentile,
  rank() over (partition by county_fips order by wellbeing_score desc) as county_rank, count(*) over (partition by county_fips) as county_total,
  {_ranks}, {rnd('percent_rank() over (order by wellbeing_score) * 100', 1)} as national_percentile_pct,
  {rnd('percent_rank() over (partition by state_abbr order by wellbeing_score) * 100', 1)} as state_percentile_pct
from scores
"""

_q = ", ".join(f"quantile_cont({c}, 0.25) as {c}_q1, quantile_cont({c}, 0.5) as {c}_q2" for c in _order)
_gap = {c: f"{c} < {c}_q1" for c in _order}
_width = f"greatest({', '.join(f'coalesce({c}, 0)' for c in _order)}) - least({', '.join(f'coalesce({c}, 100)' for c in _order)})"
_lowest = f"least({', '.join(f'coalesce({c}, 999)' for c in _order)})"
_weakest = " ".join(f"when coalesce({c}, 999) = {_lowest} then '{c.split('_')[0].title()}'" for c in _order)


def gap_priority(policy: str) -> str:
    if policy == "severity":
        return "case when gap_count >= 3 then 'Critical Need' when gap_count >= 2 or width > 30 then 'High Priority' when gap_count >= 1 then 'Moderate Need' else 'No Gaps Identified' end"
    return "case when gap_count = 0 then 'No Gaps Identified' when pillars_above_median > 0 then 'High Priority' when gap_count > 1 then 'Critical Need' else 'Moderate Need' end"


def gaps_sql(policy: str = "sql") -> str:
    return f"""
select * exclude (width), {rnd('width', 1)} as pillar_spread, {gap_priority(policy)} as intervention_priority from (
  select nces_school_id, school_name, state_abbr, county_fips, county_name, total_enrollment, wellbeing_score, wellbeing_category, {', '.join(_order)},
    {', '.join(f"{g} as has_{c.split('_')[0]}_gap" for c, g in _gap.items())},
    {' + '.join(f'coalesce(({g})::int, 0)' for g in _gap.values())} as gap_count,
    {' + '.join(f'coalesce(({c} >= {c}_q2)::int, 0)' for c in _order)} as pillars_above_median,
    case {_weakest} end as weakest_pillar, {_width} as width
  from scores, (select {_q} from scores) q
) g where gap_count >= 1
"""


def moved(c: str, t: int, up: str = "Improving", down: str = "Declining") -> str:
    return f"case when {c} > {t} then '{up}' when {c} < -{t} then '{down}' else 'Stable' end"


TRENDS = f"""
select * exclude (mu, sd), case when sd > 0 then {rnd('(combined_education_change - mu) / sd')} else 0.0 end as education_change_zscore,
  coalesce(sd > 0 and abs((combined_education_change - mu) / sd) > 2.5, false) as is_anomalous
from (
  select *, {moved('combined_education_change', 4)} as education_trend, avg(combined_education_change) over () as mu, stddev(combined_education_change) over () as sd
  from (
    select s.nces_school_id, s.school_name, s.state_abbr, s.county_fips, s.county_name, wellbeing_score, {', '.join(_order)}, wellbeing_category,
      math_proficiency_change, reading_proficiency_change, absenteeism_change, enrollment_change,
      {moved('math_proficiency_change', 2)} as math_trend, {moved('reading_proficiency_change', 2)} as reading_trend,
      {moved('absenteeism_change', 2, 'Declining', 'Improving')} as absenteeism_trend,
      {rnd('coalesce(math_proficiency_change, 0) + coalesce(reading_proficiency_change, 0)', 6)} as combined_education_change
    from scores s left join profiles p using (nces_school_id)
  ) t
) u
"""

_means = ", ".join(f"{rnd(f'avg({c})')} as avg_{c}" for c in _order)
_counts = ", ".join(f"count(*) filter (wellbeing_category = '{v}') as {n}_count" for v, n in (("Thriving", "thriving"), ("Moderate", "moderate"), ("At Risk", "at_risk"), ("Critical", "critical")))
SUMMARY = f"""
select *, rank() over (order by avg_wellbeing_score desc) as national_rank, count(*) over () as total_counties,
  rank() over (partition by state_abbr order by avg_wellbeing_score desc) as state_rank,
  {rnd('percent_rank() over (order by avg_wellbeing_score) * 100', 1)} as national_percentile
from (
  select c.* exclude (school_count, title_i_count, avg_student_teacher_ratio), c.school_count as total_school_count, t.* exclude (county_fips),
    coalesce(g.schools_with_gaps, 0) as schools_with_gaps, coalesce(g.avg_gap_count, 0) as avg_gap_count, {labelled('avg_wellbeing_score')} as county_category
  from community c join (
    select county_fips, count(*) as scored_school_count, {rnd('avg(wellbeing_score)')} as avg_wellbeing_score, {rnd('min(wellbeing_score)')} as min_wellbeing_score,
      {rnd('max(wellbeing_score)')} as max_wellbeing_score, {rnd('stddev(wellbeing_score)')} as stddev_wellbeing_score, {_means}, {_counts}
    from scores group by 1
  ) t using (county_fips)
  left join (select county_fips, count(*) as schools_with_gaps, avg(gap_count) as avg_gap_count from gaps group by 1) g using (county_fips)
) j
"""

_ctes = [(f"stg_{k}", v) for k, v in STG.items()] + [
    ("profiles", PROFILES),
    ("census_county", CENSUS_COUNTY),
    ("measure_county", MEASURE_COUNTY),
    ("air_latest", AIR_LATEST),
    ("crime_latest", crime_latest("agency_coverage_pct is null or agency_coverage_pct >= 40")),
    ("crime_any", crime_latest("true")),
    ("shortage_county", SHORTAGE_COUNTY),
    ("food_county", FOOD_COUNTY),
    ("health", HEALTH_CONTEXT),
    ("environment", ENVIRONMENT),
    ("safety", SAFETY),
    ("resources", RESOURCES),
    ("community", COMMUNITY),
]
SILVER_WITH = "with " + ", ".join(f"{n} as ({s})" for n, s in _ctes)
GOLD_WITH = SILVER_WITH + ", " + SCORE_CTES + f", rankings as ({RANKINGS}), gaps as ({gaps_sql()}), trends as ({TRENDS}), summary as ({SUMMARY})"


def silver(body: str) -> str:
    return SILVER_WITH + " " + body


def gold(body: str) -> str:
    return GOLD_WITH + " " + body
