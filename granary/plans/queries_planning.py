"""Allocation policies on plan tables made from the lineitems."""

from __future__ import annotations

from pyspark.sql import functions as F

from granary.operators import planning as pl
from granary.plans import inputs
from granary.plans.memo import remembered
from granary.plans.registry import query
from granary.plans.sql import LIFTS, with_
from granary.plans.sql import half_even as r
from granary.sources import fixtures

# The unverified share of the test areas is about a third: inspect above that.
INSPECTION = {"cost": 50.0, "above": 0.42}

PLAN = """plan0 as (
  select 'base' as scenario, cast(date_trunc('month', lift_ts) as date) as period, region as area,
    sum(quantity) as demand_mean, coalesce(stddev_samp(quantity), 0.0::double) * 10.0::double as demand_std,
    avg(case when verified then 0.0::double else 1.0::double end) as risk, min(n_nationkey) as k
  from lifts join nation on region = n_name group by 1, 2, 3),
plan as (select scenario, period, area, demand_mean * ((k * 7) % 10) / 10.0::double as inventory, demand_mean, demand_std, risk,
    0.40::double + 0.011::double * (k * 13 % 280) as unit_cost from plan0),
periods as (select scenario, period, sum(demand_mean) * 0.45::double as supply, 400.0::double as budget from plan group by 1, 2),
planrows as (select * from plan join periods using (scenario, period))"""

PROPORTIONAL = """x_proportional as (select *, case when sum(demand_mean) over p > 0 then demand_mean / sum(demand_mean) over p * supply
   else supply / count(*) over p end as x0 from planrows window p as (partition by scenario, period))"""

FILL = """(select *, case when benefit > 0 then need else 0.0::double end as take,
   sum(case when benefit > 0 then need else 0.0::double end) over (partition by scenario, period order by -benefit, area rows unbounded preceding) as used from {src})"""

OPTIMAL = (
    """o1 as (select *, 0.35::double - (0.25::double * unit_cost / greatest(max(unit_cost) over (partition by scenario, period), 1e-9) + 0.25::double * risk) as benefit,
   least(greatest(demand_mean - inventory, 0.0::double), 2.0::double * greatest(demand_mean, 1.0::double)) as need from planrows),
x_optimized as (select * exclude (benefit, need, take, used), least(greatest(supply - (used - take), 0.0::double), take) as x0 from """
    + FILL.format(src="o1")
    + ")"
)

AVERSE = (
    """a1 as (select *, 0.35::double * (1 + case when demand_mean > 0 then demand_std / demand_mean else 0 end) * 50.0::double
      - (0.25::double * unit_cost + 0.25::double * risk) as benefit,
   least(greatest(demand_mean + 1.645::double * demand_std - inventory, 0.0::double), 2.0::double * greatest(demand_mean + 1.645::double * demand_std, 1.0::double)) as need from planrows),
x_risk_averse as (select * exclude (benefit, need, take, used), least(greatest(supply - (used - take), 0.0::double), take) as x0 from """
    + FILL.format(src="a1")
    + ")"
)

EQUITY = """e1 as (select *, sum(greatest(demand_mean - inventory, 0.0::double)) over p as short, count(*) over p as n
   from planrows window p as (partition by scenario, period)),
e2 as (select *, greatest(0.0::double, least(1.0::double, supply / nullif(short, 0)) * demand_mean - inventory) as xx from e1),
x_equity_first as (select * exclude (short, n, xx), case when short <= 0 then supply / n
   else xx + greatest(0.0::double, supply - sum(xx) over (partition by scenario, period)) / n end as x0 from e2)"""


def _finish(policy: str) -> str:
    return f"""f_{policy} as (select * exclude (x0), least(greatest(x0, 0.0::double), 2.0::double * greatest(demand_mean, 1.0::double)) as x1 from x_{policy}),
g_{policy} as (select * exclude (x1), case when sum(x1) over p > supply and sum(x1) over p > 0 then x1 * supply / sum(x1) over p else x1 end as x
   from f_{policy} window p as (partition by scenario, period)),
h_{policy} as (select *, risk > 0.42 as must, case when x > 0 then risk * x / (50.0::double + unit_cost * x + 1e-9) else 0.0::double end as ret from g_{policy}),
i_{policy} as (select * exclude (must, ret), must or (ret > 0 and count(*) filter (must) over p
   + count(*) filter (not must and ret > 0) over (partition by scenario, period order by case when must or ret <= 0 then 0.0::double else -ret end, area rows unbounded preceding)
   <= floor(budget / 50.0::double)) as inspect from h_{policy} window p as (partition by scenario, period))"""


CTES = {
    "proportional": (LIFTS, PLAN, PROPORTIONAL, _finish("proportional")),
    "optimized": (LIFTS, PLAN, OPTIMAL, _finish("optimized")),
    "equity_first": (LIFTS, PLAN, EQUITY, _finish("equity_first")),
    "risk_averse": (LIFTS, PLAN, AVERSE, _finish("risk_averse")),
}
IDS = {"proportional": "L1 L5 L6 W11", "optimized": "L2 L5 L6 W11", "equity_first": "L3 L5 L6", "risk_averse": "L4 L5 L6"}


@remembered
def plan_tables(spark, d):
    lifts = fixtures.lifts(spark, d)
    nations = fixtures.table(spark, d, "nation").select("n_name", F.col("n_nationkey").alias("k"))
    plan = (
        lifts.groupBy(F.col("region").alias("area"), F.trunc(F.to_date("lift_ts"), "month").alias("period"))
        .agg(
            F.sum("quantity").alias("demand_mean"),
            F.expr("coalesce(stddev_samp(quantity), 0D) * 10D as demand_std"),
            F.expr("avg(case when verified then 0D else 1D end) as risk"),
        )
        .join(nations, F.col("area") == F.col("n_name"))
        .selectExpr(
            "'base' as scenario", "period", "area", "demand_mean * ((k * 7) % 10) / 10D as inventory", "demand_mean",
            "demand_std", "risk", "0.40D + 0.011D * (k * 13 % 280) as unit_cost",
        )
    )
    plan = inputs.keep(plan)
    periods = plan.groupBy("scenario", "period").agg(
        F.expr("sum(demand_mean) * 0.45D as supply"), F.expr("400D as budget")
    )
    return plan, periods


def _policy_query(policy: str) -> None:
    @query(
        f"allocation_{policy}",
        IDS[policy],
        with_(*CTES[policy]) + f"select period, area, x, inspect from i_{policy}",
        doubles=["x"],
        digits=4,
    )
    def plan(spark, d):
        return pl.allocate(*plan_tables(spark, d), [policy], **INSPECTION).select("period", "area", "x", "inspect")


for _policy in pl.POLICIES:
    _policy_query(_policy)


@remembered
def realised(spark, d):
    return inputs.keep(pl.realise(pl.allocate(*plan_tables(spark, d), **INSPECTION)))


REALISED = (
    "allx as ("
    + " union all ".join(
        f"select 'base/{p}' as scenario, * exclude (scenario) from i_{p}" for p in pl.POLICIES
    )
    + """),
r0 as (select *, risk * x as leakage, greatest(inventory + x - risk * x, 0.0::double) as effective from allx),
realised as (select *, greatest(demand_mean - effective, 0.0::double) as stockout,
  case when demand_mean > 0 then least(greatest(effective / demand_mean, 0.0::double), 1.0::double) else 1.0::double end as service,
  greatest(effective - demand_mean, 0.0::double) as next_inventory from r0),
m0 as (select scenario, period, sum(unit_cost * x) as cost_transport, sum(50.0::double * stockout) as cost_stockout,
  sum(leakage) as cost_leakage, var_pop(service) * 1e6 as cost_equity, avg(service) as mean_service, avg(risk) as mean_risk,
  sum(demand_mean) as demand, sum(x) as allocated, count(*) filter (stockout > 1e-7) as stockouts, count(*) filter (inspect) as inspections,
  max(supply) as supply,
  count(*) filter (case when demand_mean > 0 then (inventory + x) / demand_mean else 1 end < 0.7) as under_minimum
  from realised group by 1, 2),
metrics as (select *, 100.0::double * allocated / greatest(supply, 1.0::double) as supply_use_pct,
  0.25::double * cost_transport + 0.35::double * cost_stockout + 0.25::double * cost_leakage + 0.15::double * cost_equity as cost_total from m0)"""
)
ALL_CTES = tuple(dict.fromkeys(part for parts in CTES.values() for part in parts)) + (REALISED,)
METRICS = ["cost_transport", "cost_stockout", "cost_leakage", "cost_equity", "mean_service", "mean_risk", "demand",
           "allocated", "supply_use_pct", "cost_total"]


@query(
    "plan_period_metrics",
    "L7 L8",
    with_(*ALL_CTES) + f"select scenario, period, {', '.join(METRICS)}, inspections, under_minimum from metrics",
    # Service and risk are means of short fractions that can end on a 5: they get more places than the costs.
    doubles={m: 9 if m.startswith("mean_") else 6 for m in METRICS},
)
def q_metrics(spark, d):
    return pl.period_metrics(realised(spark, d)).select("scenario", "period", *METRICS, "inspections", "under_minimum")


SUMMARY = f"""placed as (select *, row_number() over (partition by scenario order by period) - 1 as t,
   row_number() over (partition by scenario order by cost_total, period) as place, count(*) over (partition by scenario) as n from metrics),
summary as (select scenario, {r("sum(pow(0.95::double, t) * cost_total)", 2)} as discounted_cost,
   {r("avg(case when place > ceil(0.95::double * n) or (ceil(0.95::double * n) >= n and place = n) then cost_total end)", 2)} as tail_cost,
   {r("avg(mean_service)", 4)} as mean_service, {r("avg(mean_risk)", 4)} as mean_risk, {r("sum(cost_leakage)", 1)} as leakage,
   {r("sum(greatest(0.0::double, demand - allocated))", 1)} as stockout from placed group by 1)"""


@query("policy_comparison", "L9 L10 G20 G21", with_(*ALL_CTES, SUMMARY) + "select * from summary")
def q_compare(spark, d):
    return pl.plan_summary(pl.period_metrics(realised(spark, d)))


@query(
    "best_policies",
    "V15",
    with_(*ALL_CTES, SUMMARY)
    + f"""select (select scenario from summary order by discounted_cost, scenario limit 1) as cheapest,
       (select scenario from summary order by mean_service desc, scenario limit 1) as best_served,
       {r("(select sum(discounted_cost) from summary)", 2)} as total_cost""",
    doubles=["total_cost"],
    digits=1,
)
def q_best(spark, d):
    return pl.best_policies(pl.plan_summary(pl.period_metrics(realised(spark, d))))


@query(
    "plan_area_totals",
    "L11",
    with_(*ALL_CTES)
    + f"""select scenario, area, {r("avg(service)", 4)} as mean_service, {r("sum(leakage)", 1)} as leakage,
       count(*) filter (inspect) as inspected_periods, {r("max_by(next_inventory, period)", 1)} as final_inventory
      from realised group by 1, 2""",
)
def q_areas(spark, d):
    return pl.area_totals(realised(spark, d))


DEMAND = """areas as (select region as area, sum(quantity) as base, min(n_nationkey) * 13 % 280 as km from lifts join nation on region = n_name group by 1),
dplan as (select area, cast(t as integer) as period,
  greatest(base * 1.10::double * list_extract([1.10, 1.02, 1.12, 0.97, 0.95, 0.94, 1.05, 1.00, 1.03, 1.08, 1.10, 1.05]::double[], (t + 4) % 12 + 1)
    * pow(1.02::double, t // 12), 1.0::double) as demand_mean, 0.40::double + 0.011::double * km as unit_cost from areas, range(0, 36) r(t))"""


def demand(spark, d):
    nations = fixtures.table(spark, d, "nation").selectExpr("n_name", "n_nationkey * 13 % 280 as km")
    areas = (
        fixtures.lifts(spark, d)
        .groupBy(F.col("region").alias("area"))
        .agg(F.sum("quantity").alias("base"))
        .join(nations, F.col("area") == F.col("n_name"))
        .select("area", "base", "km")
    )
    return pl.demand_plan(areas, 36)


@query(
    "demand_plan",
    "L12",
    with_(LIFTS, DEMAND) + "select area, period, demand_mean, demand_mean * 0.15::double as demand_std, unit_cost from dplan",
    doubles=["demand_mean", "demand_std", "unit_cost"],
    digits=5,
)
def q_demand(spark, d):
    return demand(spark, d)


@query(
    "supply_schedule",
    "L12",
    with_(LIFTS, DEMAND)
    + """select period, sum(demand_mean) * case when period < 24 then
       list_extract([0.91, 0.88, 0.87, 0.89, 0.91, 0.93, 0.94, 0.95, 0.93, 0.91, 0.90, 0.91]::double[], period % 12 + 1) else 0.91::double end as supply
      from dplan group by period""",
    doubles=["supply"],
    digits=6,
)
def q_schedule(spark, d):
    return pl.supply_schedule(demand(spark, d))
