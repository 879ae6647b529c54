"""Supply allocation by policy for all scenarios and periods at once.

Plan rows: scenario, period, area, inventory, demand_mean, demand_std, risk, unit_cost.
Period rows: scenario, period, supply, budget.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from granary.functions.columns import half_even
from granary.functions.order_stats import running_total
from granary.session import cut

# Objective weights and limits (defaults).
ALPHA, BETA, GAMMA, DELTA = 0.25, 0.35, 0.25, 0.15
STOCKOUT_PENALTY = 50.0
INSPECTION_COST = 5_000.0
INSPECT_ABOVE = 0.65
MAX_RATIO = 2.0
MIN_SERVICE = 0.70
DISCOUNT = 0.95
TAIL = 0.95
Z_95 = 1.645

KEY = ["scenario", "period"]
POLICIES = ("proportional", "optimized", "equity_first", "risk_averse")


def _with_totals(rows: DataFrame, *aggs) -> DataFrame:
    # Totals by aggregation and join: a window would pull each period into one task.
    keys = ["scenario", "policy", "period"]
    return rows.join(rows.groupBy(*keys).agg(*aggs), keys)


def _prepare(rows: DataFrame) -> DataFrame:
    """Aim, useful amount and net benefit per unit of each area, for the policies that need them.

    ``optimized`` weighs α·relative transport and γ·risk against β; ``risk_averse`` aims at the 95 %
    demand, uses raw costs and punishes shortfall more where demand varies more.
    """
    rows = _with_totals(
        rows,
        F.expr("sum(demand_mean) as __demand"),
        F.expr("count(1) as __areas"),
        F.expr("max(unit_cost) as __max_cost"),
        F.expr("sum(greatest(demand_mean - inventory, 0D)) as __short"),
        F.expr("count_if(__must) as __musts"),
    )
    cv = "case when demand_mean > 0 then demand_std / demand_mean else 0D end"
    aim = f"case policy when 'risk_averse' then demand_mean + {Z_95}D * demand_std else demand_mean end"
    benefit = (
        "case policy "
        f"when 'optimized' then {BETA}D - ({ALPHA}D * unit_cost / greatest(__max_cost, 1e-9D) + {GAMMA}D * risk) "
        f"when 'risk_averse' then {BETA}D * (1 + {cv}) * {STOCKOUT_PENALTY}D - ({ALPHA}D * unit_cost + {GAMMA}D * risk) "
        "else 0D end"
    )
    rows = rows.withColumns({"__aim": F.expr(aim), "__benefit": F.expr(benefit)})
    need = f"least(greatest(__aim - inventory, 0D), {MAX_RATIO}D * greatest(__aim, 1D))"
    return rows.withColumns(
        {"__order": F.expr("-__benefit"), "__take": F.expr(f"case when __benefit > 0 then {need} else 0D end")}
    )


def _amounts(rows: DataFrame) -> DataFrame:
    """Allocation ``x`` of every row by its policy.

    With one shared supply the linear programmes are solved exactly by serving areas in order of
    benefit, so a running total replaces the solver.
    """
    # Every total is a self-join; cutting here keeps the plan from doubling with each of them.
    rows = cut(running_total(_prepare(rows), ["scenario", "policy", "period"], "__order", "area", "__take", "__used", zeros=False))
    level = "least(1D, supply / case when __short > 0 then __short end)"
    rows = rows.withColumn(
        "__even", F.expr(f"case policy when 'equity_first' then greatest(0D, {level} * demand_mean - inventory) end")
    )
    rows = _with_totals(rows, F.expr("sum(__even) as __given"))
    amount = (
        "case policy "
        "when 'proportional' then case when __demand > 0 then demand_mean / __demand * supply else supply / __areas end "
        "when 'equity_first' then case when __short <= 0 then supply / __areas "
        "else __even + greatest(0D, supply - __given) / __areas end "
        "else least(greatest(supply - (__used - __take), 0D), __take) end"
    )
    return rows.withColumn("x", F.expr(amount))


def _fit_to_supply(rows: DataFrame) -> DataFrame:
    """Limit each area to twice its demand, then scale down to the supply."""
    out = rows.withColumn("x", F.expr(f"least(greatest(x, 0D), {MAX_RATIO}D * greatest(demand_mean, 1D))"))
    out = _with_totals(out, F.sum("x").alias("__total"))
    return out.withColumn("x", F.expr("case when __total > supply and __total > 0 then x * supply / __total else x end"))


def _inspections(rows: DataFrame, cost: float) -> DataFrame:
    """Areas to inspect: risky ones always, then by return on cost while the budget lasts."""
    gain = f"case when x > 0 then risk * x / ({cost}D + unit_cost * x + 1e-9D) else 0D end"
    out = rows.withColumn("__gain", F.expr(gain))
    out = out.withColumns(
        {
            "__choice": F.expr("cast(not __must and __gain > 0 as int)"),
            "__rank": F.expr("case when __must or __gain <= 0 then 0D else -__gain end"),
        }
    )
    out = running_total(out, ["scenario", "policy", "period"], "__rank", "area", "__choice", "__place", zeros=False)
    return out.withColumn(
        "inspect", F.expr(f"__must or (__choice = 1 and __musts + __place <= floor(budget / {cost}D))")
    )


def allocate(
    plan: DataFrame,
    periods: DataFrame,
    policies: Sequence[str] = POLICIES,
    cost: float = INSPECTION_COST,
    above: float = INSPECT_ABOVE,
) -> DataFrame:
    """Allocation ``x`` and inspection choice of every plan row under every policy, in one plan.

    The scenario of the result is ``scenario/policy``.
    """
    unknown = set(policies) - set(POLICIES)
    if unknown:
        raise ValueError(f"unknown policies: {sorted(unknown)}")
    rows = plan.join(periods.select(*KEY, "supply", "budget"), KEY).withColumn(
        "policy", F.explode(F.array(*[F.lit(p) for p in policies]))
    )
    rows = rows.withColumn("__must", F.expr(f"risk > {above}D"))
    out = _inspections(cut(_fit_to_supply(_amounts(rows))), cost)
    return out.withColumn("scenario", F.concat_ws("/", "scenario", "policy")).select(
        *plan.columns, "policy", "supply", "budget", "x", "inspect"
    )


def realise(allocated: DataFrame, demand: str = "demand_mean") -> DataFrame:
    """Leakage, shortfall, service and closing stock of each area for a given demand."""
    out = allocated.withColumn("leakage", F.expr("risk * x"))
    out = out.withColumn("effective", F.expr("greatest(inventory + x - leakage, 0D)"))
    return out.withColumns(
        {
            "stockout": F.expr(f"greatest({demand} - effective, 0D)"),
            "service": F.expr(
                f"case when {demand} > 0 then least(greatest(effective / {demand}, 0D), 1D) else 1D end"
            ),
            "next_inventory": F.expr(f"greatest(effective - {demand}, 0D)"),
        }
    )


def period_metrics(realised: DataFrame, demand: str = "demand_mean") -> DataFrame:
    """Costs and service per scenario and period."""
    return (
        realised.groupBy(*KEY)
        .agg(
            F.expr("sum(unit_cost * x) as cost_transport"),
            F.expr(f"sum({STOCKOUT_PENALTY}D * stockout) as cost_stockout"),
            F.expr("sum(leakage) as cost_leakage"),
            F.expr("var_pop(service) * 1e6D as cost_equity"),
            F.expr("avg(service) as mean_service"),
            F.expr("avg(risk) as mean_risk"),
            F.expr(f"sum({demand}) as demand"),
            F.expr("sum(x) as allocated"),
            F.expr("count_if(stockout > 0) as stockouts"),
            F.expr("count_if(inspect) as inspections"),
            F.expr("max(supply) as supply"),
            F.expr(
                f"count_if(case when demand_mean > 0 then (inventory + x) / demand_mean else 1D end < {MIN_SERVICE}D)"
                " as under_minimum"
            ),
        )
        .withColumns(
            {
                "supply_use_pct": F.expr("100D * allocated / greatest(supply, 1D)"),
                "cost_total": F.expr(
                    f"{ALPHA}D * cost_transport + {BETA}D * cost_stockout + {GAMMA}D * cost_leakage + {DELTA}D * cost_equity"
                ),
            }
        )
    )


def plan_summary(metrics: DataFrame) -> DataFrame:
    """Discounted cost, tail cost and service of each scenario. A scenario has one row per period."""
    in_time = Window.partitionBy("scenario").orderBy("period")
    by_cost = Window.partitionBy("scenario").orderBy("cost_total", "period")
    whole = Window.partitionBy("scenario")
    out = metrics.withColumns(
        {
            "__t": F.row_number().over(in_time) - 1,
            "__place": F.row_number().over(by_cost),
            "__periods": F.count(F.lit(1)).over(whole),
        }
    )
    tail = f"__place > ceil({TAIL}D * __periods) or (ceil({TAIL}D * __periods) >= __periods and __place = __periods)"
    return out.groupBy("scenario").agg(
        half_even(F.expr(f"sum(pow({DISCOUNT}D, __t) * cost_total)"), 2).alias("discounted_cost"),
        half_even(F.expr(f"avg(case when {tail} then cost_total end)"), 2).alias("tail_cost"),
        half_even(F.avg("mean_service"), 4).alias("mean_service"),
        half_even(F.avg("mean_risk"), 4).alias("mean_risk"),
        half_even(F.sum("cost_leakage"), 1).alias("leakage"),
        half_even(F.expr("sum(greatest(0D, demand - allocated))"), 1).alias("stockout"),
    )


def compare_policies(plan: DataFrame, periods: DataFrame, **options) -> DataFrame:
    """Every policy on the same plan, one summary row each."""
    return plan_summary(period_metrics(realise(allocate(plan, periods, **options))))


def best_policies(summary: DataFrame) -> DataFrame:
    """Cheapest policy and the one with the best service; ties by name."""
    return summary.agg(
        F.expr("min(struct(discounted_cost, scenario)).scenario as cheapest"),
        F.expr("min(struct(-mean_service, scenario)).scenario as best_served"),
        half_even(F.sum("discounted_cost"), 2).alias("total_cost"),
    )


def area_totals(realised: DataFrame) -> DataFrame:
    return realised.groupBy("scenario", "area").agg(
        half_even(F.avg("service"), 4).alias("mean_service"),
        half_even(F.sum("leakage"), 1).alias("leakage"),
        F.count_if("inspect").alias("inspected_periods"),
        half_even(F.max_by("next_inventory", "period"), 1).alias("final_inventory"),
    )


# Monthly demand factors, January to December.
SEASON_FACTORS = (1.10, 1.02, 1.12, 0.97, 0.95, 0.94, 1.05, 1.00, 1.03, 1.08, 1.10, 1.05)
# Share of the demand that is procured, by period within a year.
SUPPLY_SHARES = (0.91, 0.88, 0.87, 0.89, 0.91, 0.93, 0.94, 0.95, 0.93, 0.91, 0.90, 0.91)
FIRST_MONTH = 4  # period 0 is May
LATE_UPLIFT = 1.10
YEARLY_GROWTH = 1.02
DEMAND_CV = 0.15
COST_BASE, COST_PER_KM = 0.40, 0.011


def demand_plan(areas: DataFrame, periods: int = 24) -> DataFrame:
    """Expected demand and unit cost per area and period from ``areas`` (area, base, km)."""
    factors = "array(" + ", ".join(f"{f}D" for f in SEASON_FACTORS) + ")"
    out = areas.withColumn("period", F.explode(F.sequence(F.lit(0), F.lit(periods - 1))))
    mean = (
        f"greatest(base * {LATE_UPLIFT}D * element_at({factors}, cast((period + {FIRST_MONTH}) % 12 + 1 as int))"
        f" * pow({YEARLY_GROWTH}D, floor(period / 12)), 1D)"
    )
    return out.select(
        "area",
        "period",
        F.expr(f"{mean} as demand_mean"),
        F.expr(f"{mean} * {DEMAND_CV}D as demand_std"),
        F.expr(f"{COST_BASE}D + {COST_PER_KM}D * km as unit_cost"),
    )


def supply_schedule(plan: DataFrame) -> DataFrame:
    """Supply per period as a share of the demand; after two years the base share."""
    shares = "array(" + ", ".join(f"{s}D" for s in SUPPLY_SHARES) + ")"
    share = f"case when period < 24 then element_at({shares}, cast(period % 12 + 1 as int)) else 0.91D end"
    return plan.groupBy("period").agg(F.sum("demand_mean").alias("demand")).select(
        "period", F.expr(f"demand * {share} as supply")
    )
