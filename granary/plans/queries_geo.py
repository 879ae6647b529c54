"""Distances, gaps, zones and equity."""

from __future__ import annotations

from granary.operators import geo as ge
from granary.operators import reports as rp
from granary.operators.alerts import max_score
from granary.plans import inputs
from granary.plans.memo import remembered
from granary.plans.queries_fraud import ALERT_CTES, rule_and_statistical_alerts
from granary.plans.queries_scores import DEMAND, GAPS, MIX, gaps
from granary.plans.registry import query
from granary.plans.sql import FEATURE_CTES, MEMBERS, OUTLETS, with_
from granary.plans.sql import half_even as r
from granary.sources import fixtures

# Most test members live more than 5 km from an outlet; 10 km gives a mix.
REACH = 10.0


def _km(lat1: str, lon1: str, lat2: str, lon2: str) -> str:
    return (
        f"(2 * 6371.0::double * asin(least(1.0::double, sqrt(pow(sin(radians({lat2} - {lat1}) / 2), 2) + cos(radians({lat1}))"
        f" * cos(radians({lat2})) * pow(sin(radians({lon2} - {lon1}) / 2), 2)))))"
    )


NEAR = f"""dist as (select m.*, d.distance_km from members m join (
   select qlat, qlon, min({_km("qlat", "qlon", "latitude", "longitude")}) as distance_km
   from (select distinct latitude as qlat, longitude as qlon from members), (select distinct latitude, longitude from outlets where is_active)
   group by 1, 2) d on m.latitude = d.qlat and m.longitude = d.qlon)"""
NEAR_CTES = (OUTLETS, MEMBERS, NEAR)


@remembered
def distances(spark, d):
    return inputs.keep(ge.nearest_outlet(fixtures.members(spark, d), fixtures.outlets(spark, d)))


@query(
    "nearest_outlet_distance",
    "H1 H2 J9 F5",
    with_(*NEAR_CTES) + "select member_id, distance_km from dist",
    doubles=["distance_km"],
    digits=6,
)
def q_nearest(spark, d):
    return distances(spark, d).select("member_id", "distance_km")


@query(
    "access_summary",
    "H3 H11",
    with_(*NEAR_CTES)
    + f"""select count(*) as members, count(distance_km) as known, count(*) filter (distance_km > 10) as underserved, cast(0 as bigint) as unknown,
      {r("1.0::double - count(*) filter (distance_km > 10) / count(*)::double", 3)} as accessibility,
      {r("count(*) filter (distance_km <= 10) / count(*)::double * 100.0::double", 1)} as pct_in_reach from dist""",
)
def q_access(spark, d):
    return ge.access_summary(distances(spark, d), REACH)


@query(
    "access_gap_list",
    "H4",
    with_(*NEAR_CTES)
    + f"""select member_id, region, latitude, longitude, {r("distance_km", 2)} as distance_km, members_count as affected,
      {r("members_count / greatest(distance_km, 0.1::double)", 2)} as priority from dist where distance_km > 10""",
)
def q_gaps(spark, d):
    return ge.gap_list(ge.access_gaps(distances(spark, d), REACH))


@query(
    "farthest_access_gaps",
    "H4 K5",
    with_(*NEAR_CTES)
    + f"""select member_id, {r("distance_km", 2)} as distance_km from dist where distance_km > 10 order by 2 desc, 1 limit 100""",
)
def q_far(spark, d):
    return ge.gap_list(ge.access_gaps(distances(spark, d), REACH), 100).select("member_id", "distance_km")


@query(
    "region_accessibility",
    "H10 V15",
    with_(*NEAR_CTES)
    + f"""select region, count(distance_km) as known, count(*) filter (distance_km <= 10) as served,
       {r("count(*) filter (distance_km <= 10) / count(distance_km)::double", 3)} as accessibility from dist group by 1""",
)
def q_region_access(spark, d):
    return ge.region_accessibility(distances(spark, d), REACH)


@query("new_sites", "H5 G14")
def q_sites(spark, d):
    return ge.new_sites(ge.access_gaps(distances(spark, d), REACH), n=5, restarts=3)


def _clip_sql(corners: str, planes: str) -> str:
    """A polygon [[x, y], ...] cut by half-planes [[a, b, c]]: a * x + b * y <= c."""
    p, q = "g[i]", "g[i % len(g) + 1]"
    s, t = (f"(h[1][1] * {v}[1] + h[1][2] * {v}[2] - h[1][3])" for v in (p, q))
    cross = "[" + ", ".join(f"{p}[{k}] + ({q}[{k}] - {p}[{k}]) * ({s} / ({s} - {t}))" for k in (1, 2)) + "]"
    edge = f"case when {s} <= 0 and {t} <= 0 then [{p}] when {s} <= 0 then [{p}, {cross}] when {t} <= 0 then [{cross}] else []::double[][] end"
    return f"list_reduce({planes}, lambda g, h: flatten(list_transform(range(1, len(g) + 1), lambda i: {edge})), {corners})"


def _area_sql(g: str) -> str:
    cross = f"({g}[i][1] - lon) * ({g}[i % len({g}) + 1][2] - lat) - ({g}[i % len({g}) + 1][1] - lon) * ({g}[i][2] - lat)"
    return f"abs(list_sum(list_transform(range(1, len({g}) + 1), lambda i: {cross}))) * (111.0::double * 105.0::double / 2)"


ZONES = f"""pts as (select latitude as lat, longitude as lon, min(outlet_id) as target from outlets where is_active group by 1, 2),
box as (select min(lat) as a0, max(lat) as a1, min(lon) as o0, max(lon) as o1, 1000 * greatest(max(lat) - min(lat), 1e-9::double) as da,
   1000 * greatest(max(lon) - min(lon), 1e-9::double) as dob from pts),
shapes as (select p.target, any_value(p.lat) as lat, any_value(p.lon) as lon,
   list([[q.lon - p.lon, q.lat - p.lat, ((q.lon - p.lon) * (q.lon + p.lon) + (q.lat - p.lat) * (q.lat + p.lat)) / 2]] order by q.target) as planes
  from pts p join pts q on p.target <> q.target group by 1),
zones as (select target, lat, lon, a0, a1, o0, o1, da, dob,
   {_clip_sql("[[o0 - dob, a0 - da], [o1 + dob, a0 - da], [o1 + dob, a1 + da], [o0 - dob, a1 + da]]", "planes")} as g from shapes, box),
inner_zones as (select *, {_clip_sql("g", "[[[1.0::double, 0.0, o1]], [[-1.0::double, 0.0, -o0]], [[0.0::double, 1.0, a1]], [[0.0::double, -1.0, -a0]]]")} as inside,
   len(list_filter(g, lambda v: abs(v[1] - o0) > 0.999 * dob or abs(v[2] - a0) > 0.999 * da)) > 0 as open from zones)"""


@query(
    "service_zones",
    "H6",
    with_(OUTLETS, ZONES)
    + f"""select o.outlet_id, coalesce(len(g), 0)::integer as corners, coalesce(open, false) as open,
       case when target is null then 0.0::double when not open then {r(_area_sql("g"), 2)} end as area_km2,
       coalesce({r(_area_sql("inside"), 2)}, 0.0::double) as clipped_km2
      from (select distinct outlet_id from outlets where is_active) o left join inner_zones on target = o.outlet_id""",
)
def q_zones(spark, d):
    return ge.service_zones(fixtures.outlets(spark, d))


USE = """used as (select o.*, coalesce(collection_rate, 0.0::double) as utilisation, coalesce(f.total_cards, 0) as total_cards
   from outlets o left join features f using (outlet_id))"""


@remembered
def used(spark, d):
    return inputs.keep(ge.utilisation(fixtures.outlets(spark, d), inputs.features(spark, d)))


@query(
    "underused_outlets",
    "H7 J10",
    with_(*FEATURE_CTES, OUTLETS, USE)
    + f"""select a.outlet_id, a.region, {r("a.utilisation", 2)} as utilisation, a.total_cards,
      {r(f"min({_km('a.latitude', 'a.longitude', 'b.latitude', 'b.longitude')})", 2)} as nearest_km
     from used a join used b on a.outlet_id <> b.outlet_id and b.is_active where a.utilisation < 0.3
     group by a.outlet_id, a.region, a.utilisation, a.total_cards
     having min({_km("a.latitude", "a.longitude", "b.latitude", "b.longitude")}) <= 6""",
)
def q_underused(spark, d):
    """The test network is sparse, so an alternative may be 6 km away."""
    return ge.underused_outlets(used(spark, d), within_km=6.0)


@query(
    "load_equity",
    "H8 G15 G16",
    with_(*FEATURE_CTES, OUTLETS, USE)
    + f""", s as (select total_cards::double as v, row_number() over (order by total_cards) as i from used),
      g as (select (2 * sum(i * v) - (count(*) + 1) * sum(v)) / (count(*) * sum(v)) as g from s)
     select {r("g", 3)} as gini, case when g < 0.2 then 'highly equitable' when g < 0.35 then 'moderately equitable'
        when g < 0.5 then 'moderately inequitable' else 'highly inequitable' end as wording,
       (select count(*) from used) as outlets, {r("(select avg(total_cards) from used)", 1)} as mean_cards,
       {r("(select stddev_pop(total_cards) from used)", 1)} as std_cards,
       cast(floor((select quantile_cont(total_cards, 0.1) from used)) as integer) as p10_cards,
       cast(floor((select quantile_cont(total_cards, 0.9) from used)) as integer) as p90_cards from g""",
)
def q_equity(spark, d):
    return ge.load_equity(used(spark, d))


@query(
    "region_load_equity",
    "G15",
    with_(*FEATURE_CTES, OUTLETS, USE)
    + f""", s as (select region, total_cards::double as v, row_number() over (partition by region order by total_cards) as i from used)
     select region, {r("(2 * sum(i * v) - (count(*) + 1) * sum(v)) / (count(*) * sum(v))", 3)} as gini from s group by 1""",
)
def q_region_equity(spark, d):
    return ge.region_equity(used(spark, d))


VULNERABLE = f"""top as (select outlet_id, max(score) as alert_score from alerts group by 1),
vul as (select u.outlet_id, case when u.total_cards < 50 then 60.0::double else 30.0::double end as isolation,
   least(abs(coalesce(g.gap_pct, 0.0::double)), 100.0::double) * 0.5::double as supply_risk, coalesce(t.alert_score, 0.0::double) * 100.0::double as fraud_risk
  from used u left join gaps g using (outlet_id) left join top t using (outlet_id)),
vulnerable as (select *, case when vulnerability <= 20 then 'Low' when vulnerability <= 40 then 'Moderate' when vulnerability <= 60 then 'High' else 'Critical' end as vulnerability_band
  from (select *, {r("0.5::double * isolation + 0.25::double * supply_risk + 0.25::double * fraud_risk", 1)} as vulnerability from vul))"""
VULNERABLE_CTES = (*ALERT_CTES, MIX, DEMAND, GAPS, OUTLETS, USE, VULNERABLE)


@remembered
def vulnerable(spark, d):
    return ge.vulnerability(used(spark, d), gaps(spark, d), max_score(rule_and_statistical_alerts(spark, d)))


@query(
    "outlet_vulnerability",
    "H9",
    with_(*VULNERABLE_CTES)
    + "select outlet_id, isolation, supply_risk, fraud_risk, vulnerability, vulnerability_band from vulnerable",
    doubles=["supply_risk", "fraud_risk"],
)
def q_vulnerable(spark, d):
    return vulnerable(spark, d).select(
        "outlet_id", "isolation", "supply_risk", "fraud_risk", "vulnerability", "vulnerability_band"
    )


@query(
    "vulnerability_summary",
    "H11",
    with_(*VULNERABLE_CTES)
    + """select count(*) as outlets, count(*) filter (vulnerability_band = 'Low') as low, count(*) filter (vulnerability_band = 'Moderate') as moderate,
      count(*) filter (vulnerability_band = 'High') as high, count(*) filter (vulnerability_band = 'Critical') as critical,
      (select coalesce(list(outlet_id order by outlet_id), []) from (select outlet_id from vulnerable where vulnerability_band = 'Critical' order by outlet_id limit 20)) as critical_ids
     from vulnerable""",
)
def q_vul_summary(spark, d):
    return ge.vulnerability_summary(vulnerable(spark, d))


@query(
    "kpi_row_with_access",
    "V1 H11",
    with_(*NEAR_CTES)
    + f"""select (select count(*) from outlets) as outlets, count(*) as members,
       {r("count(*) filter (distance_km <= 10) / count(*)::double * 100.0::double", 1)} as pct_in_reach from dist""",
)
def q_kpi_access(spark, d):
    tables = (
        fixtures.outlets(spark, d),
        fixtures.members(spark, d),
        fixtures.lifts(spark, d),
        rule_and_statistical_alerts(spark, d),
        ge.access_summary(distances(spark, d), REACH),
    )
    return inputs.keep(rp.kpis(*tables).select("outlets", "members", "pct_in_reach"), *tables[1:])
