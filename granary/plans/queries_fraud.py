"""Outlet features, baselines, rules, scores and alerts."""

from __future__ import annotations

from pyspark.sql import functions as F

from granary.operators import alerts as al
from granary.operators import rules as ru
from granary.operators import statistical as st
from granary.operators.features import outlet_features, tukey_share
from granary.plans import inputs
from granary.plans.memo import remembered
from granary.plans.registry import query
from granary.plans.sql import BASE, BASELINE, FEATURE_CTES, LIFTS, OUTLETS, SCORED_CTES, with_
from granary.plans.sql import half_even as sql_round
from granary.sources import fixtures

RUN_DATE = "2001-12-01"

FEATURE_COLUMNS = [
    "outlet_id", "region", "staple_total", "grain_total", "sweet_total", "fuel_total", "item_count", "total_cards",
    "total_transactions", "staple_per_card", "grain_per_card", "sweet_per_card", "fuel_per_card", "basket_total",
    "over_ratio", "collection_rate",
]
RATIOS = ["staple_per_card", "grain_per_card", "sweet_per_card", "fuel_per_card", "over_ratio", "collection_rate"]


@query(
    "outlet_features",
    "D1 G1 G2 G3 G4 J1 J3",
    with_(*FEATURE_CTES) + f"select {', '.join(FEATURE_COLUMNS)} from features",
    doubles=RATIOS,
)
def q_features(spark, d):
    return inputs.features(spark, d).select(*FEATURE_COLUMNS)


@query(
    "outlet_features_proxy_rate",
    "D1",
    with_(LIFTS, BASE)
    + "select outlet_id, region, total_cards, staple_total / greatest(total_cards, 1) as staple_per_card, "
    "least(staple_total / greatest(total_cards, 1) / 5.0::double, 2.0::double) as collection_rate from base",
    doubles=["staple_per_card", "collection_rate"],
)
def q_features_proxy(spark, d):
    """No transaction counts: the rate is estimated from the staple quantity."""
    out = outlet_features(fixtures.lifts(spark, d), items=fixtures.ITEMS, cards=F.count_distinct("card_id"))
    return out.select("outlet_id", "region", "total_cards", "staple_per_card", "collection_rate")


@query(
    "outlet_features_stored_counts",
    "D1 G2",
    with_(LIFTS)
    + """, known as (select *, case when txn_id % 3 <> 0 then txn_id % 40 + 1 end as stored, case when txn_id % 4 <> 0 then 'r' || (txn_id % 5) end as seen from lifts)
    select outlet_id, cast((min({'t': lift_ts, 'v': stored}) filter (stored is not null)).v as bigint) as total_cards,
      (min({'t': lift_ts, 'v': seen}) filter (seen is not null)).v as region from known group by 1""",
)
def q_features_stored(spark, d):
    """Counts and regions as files store them, now and then missing and changing: the first known one counts."""
    rows = fixtures.lifts(spark, d).withColumns(
        {
            "total_cards": F.expr("case when txn_id % 3 <> 0 then txn_id % 40 + 1 end"),
            "region": F.expr("case when txn_id % 4 <> 0 then concat('r', txn_id % 5) end"),
        }
    )
    return outlet_features(rows, items=fixtures.ITEMS).select("outlet_id", "total_cards", "region")


@query(
    "outlet_features_by_month",
    "D1 G2",
    with_(LIFTS)
    + """, m as (select outlet_id, cast(date_trunc('month', lift_ts) as date) as month,
        sum(case when item = 'ECONOMY' then quantity else 0 end) as staple_total,
        count(distinct card_id) as total_cards, count(distinct txn_id) as total_transactions
      from lifts group by 1, 2)
    select outlet_id, month, staple_total, total_cards, total_transactions,
           least(total_transactions / greatest(total_cards, 1), 2.0::double) as collection_rate from m""",
    doubles=["collection_rate"],
)
def q_features_month(spark, d):
    rows = fixtures.lifts(spark, d).withColumn("month", F.trunc(F.to_date("lift_ts"), "month"))
    out = outlet_features(
        rows,
        items=fixtures.ITEMS,
        cards=F.count_distinct("card_id"),
        transactions=F.count_distinct("txn_id"),
        period="month",
    )
    return out.select("outlet_id", "month", "staple_total", "total_cards", "total_transactions", "collection_rate")


BASELINE_COLUMNS = [f"{c}_{p}" for c in ("staple_per_card", "collection_rate", "fuel_per_card", "grain_per_card")
                    for p in ("q1", "med", "q3", "p90", "p95")]


@query(
    "region_baseline",
    "G12 D2 J6",
    with_(*FEATURE_CTES, BASELINE) + f"select region, {', '.join(BASELINE_COLUMNS)}, grain_zero_share from baseline",
    doubles=[*BASELINE_COLUMNS, "grain_zero_share"],
)
def q_baseline(spark, d):
    return inputs.baseline(spark, d).select("region", *BASELINE_COLUMNS, "grain_zero_share")


Z = ["staple_z", "rate_z", "fuel_z", "grain_z"]


@query(
    "robust_z_scores",
    "D2 W6",
    with_(*SCORED_CTES) + f"select outlet_id, region, {', '.join(Z)} from scored",
    doubles=Z,
    digits=6,
)
def q_z(spark, d):
    return inputs.scored_features(spark, d).select("outlet_id", "region", *Z)


@query(
    "composite_anomaly_scores",
    "D3 B11 B13 F7",
    with_(*SCORED_CTES)
    + """select outlet_id, anomaly_score, case when anomaly_score >= 0.55 then 'Critical' when anomaly_score >= 0.38 then 'High'
      when anomaly_score >= 0.22 then 'Medium' else 'Low' end as severity from scored""",
    doubles=["anomaly_score"],
)
def q_composite(spark, d):
    return inputs.scored_features(spark, d).select(
        "outlet_id", "anomaly_score", st.severity().alias("severity")
    )


HARD_SQL = """hard as (
  select outlet_id, region,
    case when collection_rate > 0.5 then 'phantom_transactions'
         when collection_rate < 0.2 and total_cards >= 20 then 'ghost_distribution'
         when staple_per_card > 11 then 'entitlement_breach' end as pattern,
    case when collection_rate > 0.5 then 'Critical'
         when collection_rate < 0.2 and total_cards >= 20 then 'High'
         when staple_per_card > 11 then 'Critical' end as severity,
    case when collection_rate > 0.5 then least(1.0::double, 0.88::double + (collection_rate - 0.5::double) * 0.5::double)
         when collection_rate < 0.2 and total_cards >= 20 then 0.82::double
         when staple_per_card > 11
           then least(1.0::double, 0.85::double + (staple_per_card - 11.0::double) / 11.0::double * 0.10::double) end as score
  from scored where collection_rate > 0.5 or (collection_rate < 0.2 and total_cards >= 20) or staple_per_card > 11)"""


@query(
    "hard_rule_alerts",
    "D4",
    with_(*SCORED_CTES, HARD_SQL) + "select outlet_id, region, pattern, severity, score from hard",
    doubles=["score"],
)
def q_hard(spark, d):
    return st.hard_rules(inputs.scored_features(spark, d), **inputs.LIMITS).select(
        "outlet_id", "region", "pattern", "severity", "score"
    )


# The composite score of the test outlets stays below 0.2: lower cut-offs give some alerts of each kind.
STAT_LIMITS = {"min_score": 0.08, "bands": [(0.15, "Critical"), (0.11, "High"), (0.08, "Medium")]}

STAT_SQL = f"""stat as (
  select outlet_id, region,
    case when over_ratio > 1.2 then 'entitlement_breach' when collection_rate < 0.30 then 'ghost_distribution'
         when abs(staple_z) > abs(rate_z) then 'skimming' else 'low_collection' end as pattern,
    case when anomaly_score >= 0.15 then 'Critical' when anomaly_score >= 0.11 then 'High' else 'Medium' end as severity,
    {sql_round("anomaly_score", 3)} as score,
    'Outlet ' || outlet_id || ': ' || coalesce(nullif(concat_ws('; ',
       case when abs(staple_z) > 2 then 'staple per card is off the region median, z '
            || cast(cast(round_even(staple_z, 0) as bigint) as varchar) end,
       case when abs(rate_z) > 2 then 'collection rate ' || cast(cast(round_even(collection_rate * 100, 0) as bigint) as varchar)
            || '% is off the region norm' end), ''), 'several signals differ a little') as text,
    staple_z, rate_z
  from scored where anomaly_score >= 0.08 and outlet_id not in (select outlet_id from hard))"""


@query(
    "statistical_alerts",
    "D5 D6 D7 J7 U3",
    with_(*SCORED_CTES, HARD_SQL, STAT_SQL)
    + """select outlet_id, region, pattern, severity, score, text,
      case severity when 'Critical' then 'Stop distribution and escalate' when 'High' then 'Field check within two days'
      else 'Review records next cycle' end as action from stat""",
)
def q_stat(spark, d):
    return st.statistical_alerts(inputs.scored_features(spark, d), **STAT_LIMITS, **inputs.LIMITS).select(
        "outlet_id", "region", "pattern", "severity", "score", "text", "action"
    )


RULE_SQL = f"""rule_hits as (
  select outlet_id, region, 'phantom_transactions' as pattern, 'Critical' as severity,
         least(1.0::double, 0.90::double + (collection_rate - 0.5::double) * 0.5::double) as score
    from scored where collection_rate > 0.5
  union all select outlet_id, region, 'entitlement_breach', 'Critical',
         least(1.0::double, 0.85::double + (staple_per_card - 11.0::double) / 11.0::double * 0.15::double)
    from scored where staple_per_card > 11
  union all select outlet_id, region, 'ghost_distribution', 'High', 0.80::double
    from scored where collection_rate < 0.2 and total_cards >= 20
  union all select outlet_id, region, 'above_region_p95', 'High', 0.72::double
    from scored where staple_per_card > staple_per_card_p95 and staple_per_card <= 11
  union all select outlet_id, region, 'low_collection', 'Medium',
         {sql_round("0.55::double + (0.25::double - collection_rate) * 0.30::double", 3)}
    from scored where collection_rate >= 0.2 and collection_rate < 0.25 and total_cards >= 20
  union all select outlet_id, region, 'off_region_item', 'Medium', 0.60::double
    from scored where grain_zero_share > 0.8 and grain_per_card > 0
  union all select outlet_id, region, 'fuel_spike', 'Medium',
         least(0.75::double, 0.55::double + (fuel_per_card / fuel_per_card_p90 - 1.2::double) * 0.10::double)
    from scored where fuel_per_card_p90 >= 0.1 and fuel_per_card > fuel_per_card_p90 * 1.2::double
  union all select outlet_id, region, 'no_distribution', 'Low', 0.35::double
    from scored where staple_total = 0)"""
RULE_SETTINGS = {**inputs.RULE_LIMITS, "absent_share": 0.8}
RULE_IDS = {
    "phantom_transactions": "D8",
    "entitlement_breach": "D9",
    "ghost_distribution": "D10",
    "above_region_p95": "D11",
    "low_collection": "D12",
    "off_region_item": "D13",
    "fuel_spike": "D14",
    "no_distribution": "D15",
}


@query(
    "rule_alerts",
    "D16 D8 D9 D10 D11 D12 D13 D14 D15",
    with_(*SCORED_CTES, RULE_SQL) + "select outlet_id, region, pattern, severity, score from rule_hits",
    doubles=["score"],
)
def q_rules(spark, d):
    return ru.apply_rules(inputs.scored_features(spark, d), **RULE_SETTINGS).select(
        "outlet_id", "region", "pattern", "severity", "score"
    )


def _single_rule(name: str, ids: str) -> None:
    @query(
        f"rule_{name}",
        ids,
        with_(*SCORED_CTES, RULE_SQL)
        + f"select outlet_id, region, severity, score from rule_hits where pattern = '{name}'",
        doubles=["score"],
    )
    def plan(spark, d):
        return ru.apply_rules(inputs.scored_features(spark, d), only=[name], **RULE_SETTINGS).select(
            "outlet_id", "region", "severity", "score"
        )


for _name, _ids in RULE_IDS.items():
    _single_rule(_name, _ids)


@query(
    "tukey_outlier_share",
    "G13",
    with_(*FEATURE_CTES)
    + """, q as (select quantile_cont(staple_per_card, 0.25) as q1, quantile_cont(staple_per_card, 0.75) as q3 from features),
      n as (select count(*) as outlets, cast(count(*) filter (staple_per_card < q1 - 3 * (q3 - q1)
            or staple_per_card > q3 + 3 * (q3 - q1)) as bigint) as outliers from features, q)
      select outlets, outliers, greatest(0.01::double, least(0.15::double, outliers / greatest(outlets, 1))) as share from n""",
    doubles=["share"],
)
def q_tukey(spark, d):
    return tukey_share(inputs.features(spark, d))


@query(
    "quick_report_scores",
    "D31 S1",
    with_(*FEATURE_CTES)
    + f""", s as (select outlet_id,
        case when staple_per_card > 11 then 'entitlement_breach' when collection_rate > 0.5 then 'phantom_transactions' end as rule,
        coalesce(case when staple_per_card > 11
              then least(1.0::double, 0.85::double + (staple_per_card - 11.0::double) / 11.0::double)
             when collection_rate > 0.5 then least(1.0::double, 0.90::double + (collection_rate - 0.5::double) * 0.5::double) end,
             0.0::double) as raw from features)
      select outlet_id, rule, {sql_round("raw", 3)} as score, case when raw >= 0.85 then 'Critical' when raw >= 0.7 then 'High'
        when raw >= 0.5 then 'Medium' else 'Low' end as severity, raw >= 0.6 as is_flagged from s""",
)
def q_quick(spark, d):
    out = ru.quick_score(inputs.features(spark, d), ceiling=inputs.CEILING, phantom_rate=0.5)
    return out.select("outlet_id", "rule", "score", "severity", "is_flagged")


@query(
    "quick_report_scores_with_model",
    "D31 S1",
    with_(*SCORED_CTES)
    + f""", s as (select outlet_id, greatest(anomaly_score, coalesce(case when staple_per_card > 11
              then least(1.0::double, 0.85::double + (staple_per_card - 11.0::double) / 11.0::double)
             when collection_rate > 0.5 then least(1.0::double, 0.90::double + (collection_rate - 0.5::double) * 0.5::double) end, 0.0::double)) as raw from scored)
      select outlet_id, {sql_round("raw", 3)} as score, raw >= 0.6 as is_flagged from s""",
)
def q_quick_model(spark, d):
    """Rules against a model's score of the report; the larger one counts."""
    reports = inputs.scored_features(spark, d).withColumn("model_score", F.col("anomaly_score"))
    return ru.quick_score(reports, ceiling=inputs.CEILING, phantom_rate=0.5).select("outlet_id", "score", "is_flagged")


@remembered
def rule_and_statistical_alerts(spark, d):
    """Canonical, de-duplicated alerts of the two deterministic detectors."""
    scored = inputs.scored_features(spark, d)
    return inputs.keep(
        al.union_alerts(
            [st.detect(scored, **STAT_LIMITS, **inputs.LIMITS), ru.apply_rules(scored, **RULE_SETTINGS)], RUN_DATE
        )
    )


ALERTS_SQL = f"""found as (
  select outlet_id, region, pattern, severity, score, 'statistical' as model, 0 as detector from hard
  union all select outlet_id, region, pattern, severity, score, 'statistical', 0 from stat
  union all select outlet_id, region, pattern, severity, score, 'rules', 1 from rule_hits),
alerts as (
  select sha256(outlet_id || '|' || pattern || '||{RUN_DATE}') as alert_id, outlet_id, region, pattern, severity,
         {sql_round("score", 3)} as score, model
  from (select *, row_number() over (partition by outlet_id, pattern order by detector, score desc) as rn from found)
  where rn = 1)"""
ALERT_CTES = (*SCORED_CTES, HARD_SQL, STAT_SQL, RULE_SQL, ALERTS_SQL)


@query(
    "alerts_deduplicated",
    "D28 D29 W8 U1 F9",
    with_(*ALERT_CTES)
    + "select alert_id, outlet_id, region, pattern, severity, score, model, 'open' as status from alerts",
)
def q_alerts(spark, d):
    return rule_and_statistical_alerts(spark, d).select(
        "alert_id", "outlet_id", "region", "pattern", "severity", "score", "model", "status"
    )


@query(
    "alert_summary",
    "G17",
    with_(*ALERT_CTES)
    + f"""select count(*) as total_alerts, count(*) filter (severity = 'Critical') as critical,
       count(*) filter (severity = 'High') as high, count(*) filter (severity = 'Medium') as medium,
       count(*) filter (severity = 'Low') as low, count(*) filter (model = 'rings') as rings,
       (select count(*) from features) as outlets,
       {sql_round("count(*) / (select count(*) from features)::double", 3)} as alert_rate from alerts""",
)
def q_alert_summary(spark, d):
    return al.alert_summary(rule_and_statistical_alerts(spark, d), inputs.features(spark, d))


@query(
    "alert_max_score_per_outlet",
    "J5",
    with_(*ALERT_CTES) + "select outlet_id, max(score) as alert_score from alerts group by outlet_id",
)
def q_alert_max(spark, d):
    return al.max_score(rule_and_statistical_alerts(spark, d))


@query(
    "alert_region_lookup",
    "J8",
    with_(*ALERT_CTES, OUTLETS)
    + """select alert_id, coalesce(o.region, nullif(a.region, ''), 'Unknown') as shown_region
       from alerts a left join outlets o using (outlet_id)""",
)
def q_alert_region(spark, d):
    shown = al.alert_regions(rule_and_statistical_alerts(spark, d), fixtures.outlets(spark, d))
    return shown.select("alert_id", "shown_region")


@query(
    "alerts_filtered",
    "B10 K5",
    with_(*ALERT_CTES)
    + """select outlet_id, region, pattern, score from alerts where lower(region) = 'nation_7' and lower(severity) = 'high'""",
)
def q_alert_filter(spark, d):
    out = al.filter_alerts(rule_and_statistical_alerts(spark, d), region="Nation_7", severity="HIGH")
    return out.select("outlet_id", "region", "pattern", "score")


@query(
    "critical_escalations",
    "D32 J11",
    with_(*ALERT_CTES)
    + """, history as (select cast(o_custkey as varchar) as outlet_id, o_orderdate as flagged_at
          from orders where o_orderpriority = '1-URGENT')
      select alert_id, a.outlet_id, a.pattern, count(h.outlet_id) as earlier_flags,
        case when count(h.outlet_id) > 0 then 'repeat' else 'first' end as context,
        case when count(h.outlet_id) > 0 then 'Block the outlet and open a case' else 'Send a field officer' end as escalation
      from alerts a left join history h on a.outlet_id = h.outlet_id and h.flagged_at < timestamp '2001-12-01'
      where a.severity = 'Critical' group by alert_id, a.outlet_id, a.pattern""",
)
def q_escalations(spark, d):
    """Urgent orders stand for earlier flags of the outlet."""
    history = (
        fixtures.table(spark, d, "orders")
        .where(F.col("o_orderpriority") == "1-URGENT")
        .select(F.col("o_custkey").cast("string").alias("outlet_id"), F.col("o_orderdate").alias("flagged_at"))
    )
    return al.escalate(rule_and_statistical_alerts(spark, d), history)


@query(
    "features_scaled",
    "D17",
    with_(*FEATURE_CTES)
    + """, s as (select avg(staple_per_card) as m1, stddev_pop(staple_per_card) as s1, avg(collection_rate) as m2,
          stddev_pop(collection_rate) as s2, avg(fuel_per_card) as m3, stddev_pop(fuel_per_card) as s3 from features)
      select outlet_id, (staple_per_card - m1) / case when s1 = 0 then 1 else s1 end as staple_per_card,
        (collection_rate - m2) / case when s2 = 0 then 1 else s2 end as collection_rate,
        (fuel_per_card - m3) / case when s3 = 0 then 1 else s3 end as fuel_per_card from features, s""",
    doubles=["staple_per_card", "collection_rate", "fuel_per_card"],
)
def q_scaled(spark, d):
    from granary.operators.scaling import standard_scale

    cols = ["staple_per_card", "collection_rate", "fuel_per_card"]
    return standard_scale(inputs.features(spark, d), cols).select("outlet_id", *cols)
