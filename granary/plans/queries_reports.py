"""Card-level rules and dashboard tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from granary.operators import alerts as al
from granary.operators import cards as ca
from granary.operators import reports as rp
from granary.plans import inputs
from granary.plans.queries_fraud import ALERT_CTES, rule_and_statistical_alerts
from granary.plans.registry import query
from granary.plans.sql import LIFTS, MEMBERS, OUTLETS, with_
from granary.plans.sql import half_even as r
from granary.sources import fixtures

EVENTS = """card_lifts as (
  select event_id as lift_id, cast(user_id as varchar) as card_id, json_extract_string(props, '$.k') as outlet_id,
         value as quantity, ts as lift_ts, event_type <> 'error' as verified from events)"""


@query(
    "cards_at_several_outlets_in_month",
    "X1",
    with_(EVENTS)
    + """select card_id, cast(date_trunc('month', lift_ts) as date) as month, count(distinct outlet_id) as outlets,
      'duplicate_use' as pattern, 'High' as severity, 0.85::double as score from card_lifts group by 1, 2 having count(distinct outlet_id) > 1""",
)
def q_x1(spark, d):
    return ca.several_outlets_in_month(fixtures.card_events(spark, d))


@query(
    "after_hours_outlets",
    "X2",
    with_(EVENTS)
    + """select outlet_id, count(*) as lifts, 'after_hours' as pattern, 'Medium' as severity, 0.65::double as score
      from card_lifts where hour(lift_ts) < 8 or hour(lift_ts) >= 20 group by 1 having count(*) >= 5""",
)
def q_x2(spark, d):
    return ca.after_hours(fixtures.card_events(spark, d))


@query(
    "month_end_bulk_lifts",
    "X3",
    with_(EVENTS)
    + """, days as (select outlet_id, cast(lift_ts as date) as day, count(*) as n from card_lifts group by 1, 2),
      m as (select outlet_id, cast(date_trunc('month', day) as date) as month, max(day) as last_day,
        max_by(n, day) as last_day_lifts, cast(sum(n) as bigint) as lifts from days group by 1, 2)
      select *, last_day_lifts / lifts as share, 'month_end_bulk' as pattern, 'High' as severity, 0.75::double as score
      from m where last_day_lifts / lifts > 0.04""",
    doubles=["share"],
)
def q_x3(spark, d):
    """Events are spread evenly over the month, so the share is lowered."""
    return ca.month_end_bulk(fixtures.card_events(spark, d), share=0.04)


@query(
    "low_verification_outlets",
    "X4",
    with_(EVENTS)
    + """, s as (select outlet_id, count(*) as lifts, avg(case when verified then 1.0::double else 0.0::double end) as verified_share
        from card_lifts group by 1)
      select *, 'low_verification' as pattern, case when verified_share < 0.5 then 'Critical' else 'High' end as severity,
        1.0::double - verified_share as score from s where lifts >= 10 and verified_share < 0.8""",
    doubles=["verified_share", "score"],
)
def q_x4(spark, d):
    return ca.low_verification(fixtures.card_events(spark, d))


@query(
    "cards_at_many_outlets",
    "X5",
    with_(EVENTS)
    + """select card_id, count(distinct outlet_id) as outlets, 'card_at_many_outlets' as pattern, 'Critical' as severity,
      least(1.0::double, 0.70::double + 0.25::double * (count(distinct outlet_id) - 2)) as score
      from card_lifts group by 1 having count(distinct outlet_id) > 2""",
    doubles=["score"],
)
def q_x5(spark, d):
    return ca.many_outlets(fixtures.card_events(spark, d))


@query(
    "lift_features",
    "X6",
    with_(EVENTS)
    + """, dd as (select outlet_id, cast(lift_ts as date) as day, count(distinct card_id) as cards_same_day, sum(quantity) as v from card_lifts group by 1, 2),
      mm as (select outlet_id, date_trunc('month', lift_ts) as month, avg(quantity) as a from card_lifts group by 1, 2)
      select lift_id, c.outlet_id, card_id, quantity, cast(hour(lift_ts) as integer) as hour, cast(day(lift_ts) as integer) as day_of_month,
        cards_same_day, v as outlet_day_volume, abs(quantity - a) as deviation, cast(not verified as integer) as unverified
      from card_lifts c join dd on c.outlet_id = dd.outlet_id and cast(lift_ts as date) = dd.day
        join mm on c.outlet_id = mm.outlet_id and date_trunc('month', lift_ts) = mm.month""",
    doubles=["outlet_day_volume", "deviation"],
    digits=6,
)
def q_x6(spark, d):
    return ca.lift_features(fixtures.card_events(spark, d))


LATEST = "(select max(date_trunc('month', lift_ts)) from lifts)"


@query(
    "latest_month_items",
    "V2",
    with_(LIFTS) + f"select item, {r('sum(quantity)', 2)} as total from lifts where date_trunc('month', lift_ts) = {LATEST} group by 1",
)
def q_v2(spark, d):
    return rp.latest_month_items(fixtures.lifts(spark, d))


@query(
    "latest_month_lifts",
    "V3",
    with_(LIFTS) + f"select count(*) as lifts from lifts where date_trunc('month', lift_ts) = {LATEST}",
)
def q_v3(spark, d):
    return rp.latest_month_lifts(fixtures.lifts(spark, d))


SHOWN = """shown as (select a.*, coalesce(o.region, nullif(a.region, ''), 'Unknown') as shown_region
  from alerts a left join outlets o using (outlet_id))"""
SHOWN_CTES = (*ALERT_CTES, OUTLETS, SHOWN)


def shown(spark, d):
    return al.alert_regions(rule_and_statistical_alerts(spark, d), fixtures.outlets(spark, d))


@query(
    "top_alert_regions",
    "V4 G18",
    with_(*SHOWN_CTES)
    + """select * from (select shown_region as region, count(*) as alerts from shown group by 1 order by 2 desc, 1 limit 5)
      where region <> 'Unknown'""",
)
def q_v4(spark, d):
    return rp.top_alert_regions(shown(spark, d))


@query("alert_pattern_counts", "G18", with_(*ALERT_CTES) + "select pattern, count(*) as alerts from alerts group by 1")
def q_patterns(spark, d):
    return rp.pattern_counts(rule_and_statistical_alerts(spark, d))


@query(
    "top_patterns_per_region",
    "G18",
    with_(*SHOWN_CTES)
    + """select * from (select shown_region, pattern, count(*) as alerts,
        cast(row_number() over (partition by shown_region order by count(*) desc, pattern) as integer) as place
      from shown group by 1, 2) where place <= 3""",
)
def q_region_patterns(spark, d):
    return rp.top_patterns_per_region(shown(spark, d))


@query(
    "severe_alerts",
    "K6 K5",
    with_(*ALERT_CTES)
    + """select alert_id, outlet_id, pattern, severity, score from alerts where severity in ('Critical', 'High')
      order by score desc, alert_id limit 50""",
)
def q_severe(spark, d):
    return rp.severe_alerts(rule_and_statistical_alerts(spark, d)).select(
        "alert_id", "outlet_id", "pattern", "severity", "score"
    )


@query(
    "outlet_health",
    "V5",
    with_(OUTLETS)
    + f"""select count(*) as total, count(*) filter (is_active) as active, count(*) filter (not is_active) as inactive,
      {r("count(*) filter (is_active) / count(*)::double * 100.0::double", 1)} as active_pct from outlets""",
)
def q_v5(spark, d):
    return rp.outlet_health(fixtures.outlets(spark, d))


@query(
    "region_volumes",
    "V6 K4",
    with_(LIFTS) + f"select region, {r('sum(quantity)', 1)} as total from lifts group by 1 order by 2 desc, 1 limit 15",
)
def q_v6(spark, d):
    return rp.region_volumes(fixtures.lifts(spark, d))


@query("item_breakdown", "V7", with_(LIFTS) + f"select item, {r('sum(quantity)', 1)} as total from lifts group by 1")
def q_v7(spark, d):
    return rp.item_breakdown(fixtures.lifts(spark, d))


@query(
    "monthly_trend",
    "V8 K4 F1",
    with_(LIFTS)
    + f"""select strftime(m, '%Y-%m') as month, lifts, total from (
      select date_trunc('month', lift_ts) as m, count(*) as lifts, {r("sum(quantity)", 1)} as total from lifts group by 1 order by 1 desc limit 24)""",
)
def q_v8(spark, d):
    return rp.monthly_trend(fixtures.lifts(spark, d))


@query(
    "card_type_distribution",
    "V9 B7",
    "select case when c_custkey % 5 > 0 then 'AAY' else 'PHH' end as card_type, count(*) as cards from customer group by 1",
)
def q_v9(spark, d):
    from granary.sources.normalise import card_type

    cards = fixtures.table(spark, d, "customer").select((F.col("c_custkey") % 5).alias("cards_aay"))
    return rp.card_types(cards.withColumn("card_type", card_type("cards_aay")))


@query(
    "top_member_regions",
    "V10 K4",
    with_(MEMBERS) + "select region, count(*) as members from members group by 1 order by 2 desc, 1 limit 10",
)
def q_v10(spark, d):
    return rp.top_member_regions(fixtures.members(spark, d))


@query(
    "region_outlets",
    "V11 K4 V15",
    with_(OUTLETS)
    + "select region, count(*) as total, count(*) filter (is_active) as active from outlets group by 1 order by 2 desc, 1 limit 15",
)
def q_v11(spark, d):
    return rp.region_outlets(fixtures.outlets(spark, d))


@query(
    "stratified_outlet_head",
    "W7",
    with_(OUTLETS)
    + """select outlet_id, region from (select *, row_number() over (partition by region order by outlet_id) as rn,
        (select greatest(1, 60 // count(distinct region)) from outlets) as per from outlets)
      where rn <= per order by region, outlet_id limit 60""",
)
def q_w7(spark, d):
    return rp.stratified_head(fixtures.outlets(spark, d), 60).select("outlet_id", "region")


KPI = f"""kpi as (select (select count(*) from outlets) as outlets, (select count(*) from outlets where is_active) as active_outlets,
  (select count(*) from members) as members, (select count(distinct region) from members) as regions,
  (select count(*) from lifts where date_trunc('month', lift_ts) = {LATEST}) as lifts_latest_month,
  (select count(*) from alerts) as alerts_open, (select count(*) from alerts where severity = 'Critical') as alerts_critical,
  (select count(*) from alerts where model = 'rings') as rings)"""


def kpi_frame(spark, d):
    tables = fixtures.outlets(spark, d), fixtures.members(spark, d), fixtures.lifts(spark, d), rule_and_statistical_alerts(spark, d)
    return inputs.keep(rp.kpis(*tables), *tables[1:])


@query("kpi_row", "V1", with_(*ALERT_CTES, OUTLETS, MEMBERS, KPI) + "select * from kpi")
def q_v1(spark, d):
    return kpi_frame(spark, d)


@query(
    "text_summary",
    "V12",
    with_(*ALERT_CTES, OUTLETS, MEMBERS, KPI)
    + """select alerts_open || ' alerts are open, ' || alerts_critical || ' of them critical, with ' || rings || ' rings. The network has '
      || outlets || ' outlets (' || active_outlets || ' active), ' || members || ' members in ' || regions || ' regions and '
      || lifts_latest_month || ' lifts in the latest month.' as summary from kpi""",
)
def q_v12(spark, d):
    return rp.text_summary(kpi_frame(spark, d))


@query(
    "data_status",
    "A12 A4",
    with_(LIFTS, OUTLETS, MEMBERS)
    + """select 'outlets' as name, count(*) as rows, null::date as first_day, null::date as last_day, 'test tables' as origin from outlets
      union all select 'lifts', count(*), cast(min(lift_ts) as date), cast(max(lift_ts) as date), 'test tables' from lifts
      union all select 'members', count(*), null, null, 'test tables' from members""",
)
def q_status(spark, d):
    return rp.data_status(
        {
            "outlets": (fixtures.outlets(spark, d), None, "test tables"),
            "lifts": (fixtures.lifts(spark, d), "lift_ts", "test tables"),
            "members": (fixtures.members(spark, d), None, "test tables"),
        }
    )
