"""Monthly series, forecasts and their errors."""

from __future__ import annotations

from pyspark.sql import functions as F

from granary.functions.columns import half_even
from granary.operators import forecast as fc
from granary.plans import inputs
from granary.plans.memo import remembered
from granary.plans.queries_scores import GAP_CTES, gaps
from granary.plans.registry import query
from granary.plans.sql import LIFTS, OUTLETS, with_
from granary.plans.sql import half_even as r
from granary.sources import fixtures

ALL_ITEMS = list(fixtures.WIDE_ITEMS.values())
ITEM_ROWS = ", ".join(f"('{i}')" for i in ALL_ITEMS)
SERIES = """series as (
  select outlet_id, item, cast(date_trunc('month', lift_ts) as date) as month, sum(quantity) as quantity,
         count(distinct card_id) as active_cards from lifts group by 1, 2, 3)"""
REGION_SERIES = """region_series as (
  select region, item, cast(date_trunc('month', lift_ts) as date) as month, avg(quantity) as mean_quantity,
         sum(quantity) as quantity, count(distinct card_id) as active_cards from lifts group by 1, 2, 3)"""
FEATS = """feats as (select * from (
  select *, lag(quantity, 1) over w as lag_1, lag(quantity, 2) over w as lag_2,
    avg(quantity) over w3 as rolling_avg_3, stddev_samp(quantity) over w3 as rolling_std_3,
    sin(2 * pi() * month(month) / 12) as month_sin, cos(2 * pi() * month(month) / 12) as month_cos
  from series window w as (partition by outlet_id, item order by month),
    w3 as (partition by outlet_id, item order by month rows between 2 preceding and current row)) where lag_2 is not null)"""
LEVELS = """levels as (
  select outlet_id, item, max(month) as last_month,
    sum(0.3::double * pow(0.7::double, back - 1) * quantity) + pow(0.7::double, count(*)) * max(case when back = 1 then quantity end) as level
  from (select *, row_number() over (partition by outlet_id, item order by month desc) as back from feats)
  where back <= 6 group by 1, 2)"""
SMOOTH = f"""smooth as (
  select outlet_id, item, last_month, cast(m as integer) as month_offset, {r("level", 2)} as predicted,
    {r("level * 0.85::double", 2)} as lower, {r("level * 1.15::double", 2)} as upper from levels, range(1, 4) t(m))"""
GROWN = f"""grown as (
  select outlet_id, item, last_month, cast(m as integer) as month_offset,
    {r("base * pow(1.02::double, m)", 2)} as predicted, {r("base * pow(1.02::double, m) * 0.85::double", 2)} as lower,
    {r("base * pow(1.02::double, m) * 1.15::double", 2)} as upper
  from (select outlet_id, item, max_by(quantity, month) as base, max(month) as last_month from series group by 1, 2), range(1, 4) t(m))"""


@remembered
def series(spark, d):
    return inputs.keep(fc.monthly_series(fixtures.lifts(spark, d)))


@remembered
def regions(spark, d):
    return inputs.keep(fc.region_series(fixtures.lifts(spark, d)))


@query("monthly_series", "G5 P10 F3", with_(LIFTS, SERIES) + "select * from series")
def q_series(spark, d):
    return series(spark, d)


@query("region_monthly_series", "G6", with_(LIFTS, REGION_SERIES) + "select * from region_series", doubles=["mean_quantity"])
def q_regions(spark, d):
    return regions(spark, d)


@query(
    "series_features",
    "P4 W4 W5 F4",
    with_(LIFTS, SERIES, FEATS) + "select * from feats",
    doubles=["rolling_avg_3", "rolling_std_3", "month_sin", "month_cos"],
)
def q_feats(spark, d):
    return fc.series_features(series(spark, d))


@query(
    "series_standardised",
    "P5",
    with_(LIFTS, SERIES, FEATS)
    + """select outlet_id, item, month, (quantity - avg(quantity) over w) / (stddev_pop(quantity) over w + 1e-8) as quantity,
      (lag_1 - avg(lag_1) over w) / (stddev_pop(lag_1) over w + 1e-8) as lag_1 from feats window w as (partition by outlet_id, item)""",
    doubles=["quantity", "lag_1"],
    digits=5,
)
def q_standard(spark, d):
    out = fc.standardise(fc.series_features(series(spark, d)), ["quantity", "lag_1"])
    return out.select("outlet_id", "item", "month", "quantity", "lag_1")


@query(
    "series_sequences",
    "W10",
    with_(LIFTS, SERIES)
    + """select outlet_id, item, month, inputs, quantity as target from (
      select *, list(quantity) over (partition by outlet_id, item order by month rows between 6 preceding and 1 preceding) as inputs
      from series) where len(inputs) = 6""",
)
def q_sequences(spark, d):
    return fc.sequences(series(spark, d))


@query(
    "series_last_values",
    "W12",
    with_(LIFTS, SERIES)
    + "select outlet_id, item, max_by(quantity, month) as base, max(month) as last_month, count(*) as months from series group by 1, 2",
)
def q_last(spark, d):
    return fc.last_values(series(spark, d))


@query(
    "smoothing_forecast",
    "P7",
    with_(LIFTS, SERIES, FEATS, LEVELS, SMOOTH) + "select *, 'smoothing' as model from smooth",
)
def q_smooth(spark, d):
    return fc.smoothing(fc.series_features(series(spark, d)))


SHORT = f"""pairs as (select outlet_id, region, item from outlets, (values {ITEM_ROWS}) v(item)),
own as (select outlet_id, item, max_by(quantity, month) as base, max(month) as last_month, count(*) as months from series group by 1, 2),
reg as (select region, item, max_by(mean_quantity, month) as base, max(month) as last_month from region_series group by 1, 2),
short as (select p.outlet_id, p.item, p.region, coalesce(o.base, g.base, 0) as base,
  case when o.base is not null then o.last_month else g.last_month end as last_month, coalesce(o.months, 0) as months
  from pairs p left join own o using (outlet_id, item) left join reg g on p.region = g.region and p.item = g.item
  where coalesce(o.months, 0) < 3)"""


@query(
    "growth_forecast_short_series",
    "P6",
    with_(LIFTS, OUTLETS, SERIES, REGION_SERIES, SHORT)
    + f"""select outlet_id, item, last_month, cast(m as integer) as month_offset,
       {r("base * pow(1.02::double, m)", 2)} as predicted, {r("base * pow(1.02::double, m) * 0.85::double", 2)} as lower,
       {r("base * pow(1.02::double, m) * 1.15::double", 2)} as upper, 'growth' as model
     from short, range(1, 4) t(m) where base <> 0""",
)
def q_growth(spark, d):
    pairs = fixtures.outlets(spark, d).select(
        "outlet_id", "region", F.explode(F.array(*[F.lit(i) for i in ALL_ITEMS])).alias("item")
    )
    base = fc.short_series_base(pairs, series(spark, d), regions(spark, d))
    return fc.growth(base.where("base <> 0"))


@query(
    "ensemble_combination",
    "P11 J12",
    with_(LIFTS, SERIES, FEATS, LEVELS, SMOOTH, GROWN)
    + f""", b as (select s.outlet_id, s.item, s.month_offset, s.last_month, s.predicted as a_predicted, g.predicted as b_predicted,
        0.4::double * s.predicted + 0.6::double * g.predicted as blend, least(s.lower, g.lower) as low, greatest(s.upper, g.upper) as high
       from smooth s join grown g using (outlet_id, item, month_offset))
      select outlet_id, item, month_offset, last_month, {r("blend", 2)} as predicted, {r("low", 2)} as lower, {r("high", 2)} as upper,
       'ensemble' as model, case when blend < low * 0.7 then 'understock_risk' when blend > high * 1.3 then 'overstock_risk' end as risk_flag,
       a_predicted, b_predicted from b""",
)
def q_ensemble(spark, d):
    s = series(spark, d)
    return fc.combine(fc.smoothing(fc.series_features(s)), fc.growth(fc.last_values(s)))


@query(
    "holiday_days_per_month",
    "P9 U2",
    with_(LIFTS)
    + """, years as (select y from (select min(year(lift_ts)) as a, max(year(lift_ts)) + 1 as b from lifts), range(1900, 2200) t(y) where y between a and b),
      days as (select distinct cast(make_date(y, m, d) + k as date) as day from years,
        (values (1, 26), (8, 15), (12, 25), (1, 15), (10, 2)) h(m, d), (values (-1), (0), (1)) o(k))
      select cast(date_trunc('month', day) as date) as month, count(*) as holiday_days from days group by 1""",
)
def q_holidays(spark, d):
    return fc.holiday_days(fc.fixed_holidays(regions(spark, d)))


PEAKS = f"""peaks as (select 'peak Q' || q as holiday, day from (
    select day, quarter(day) as q, row_number() over (partition by year(day), quarter(day) order by total desc, day) as k
    from (select cast(o_orderdate as date) as day, {r("sum(o_totalprice)", 2)} as total from orders group by 1) where year(day) % 3 = 0) where k = 1)"""
CALENDAR = """years as (select y from (select min(year(lift_ts)) as a, max(year(lift_ts)) + 1 as b from lifts), range(1900, 2200) t(y) where y between a and b),
known_years as (select distinct year(day) as k from peaks),
nearest as (select y, arg_min(k, abs(k - y) * 10000 + k) as k from years, known_years group by y),
feasts as (select distinct holiday, try_cast(lpad(y::varchar, 4, '0') || '-' || strftime(day, '%m-%d') as date) as day from nearest join peaks on year(day) = k),
moved as (select holiday, day from feasts where day is not null),
calendar as (select cast(date_trunc('month', day) as date) as month, count(*) as holiday_days from (
  select distinct cast(make_date(y, m, d) + o as date) as day from years, (values (1, 26), (8, 15), (12, 25), (1, 15), (10, 2)) h(m, d), (values (-1), (0), (1)) t(o)
  union select distinct cast(day + o as date) from moved, (values (-2), (-1), (0), (1)) t(o)) group by 1)"""


def peak_days(spark, d):
    """The day with most ordered value of each quarter, for every third year: feasts that move and are not known for all years."""
    days = fixtures.table(spark, d, "orders").groupBy(F.col("o_orderdate").cast("date").alias("day")).agg(half_even(F.sum("o_totalprice"), 2).alias("total"))
    days = days.where("year(day) % 3 = 0").groupBy(F.year("day"), F.quarter("day").alias("q"))
    best = days.agg(F.min(F.struct((-F.col("total")).alias("t"), "day")).alias("best"))
    return best.select(F.concat(F.lit("peak Q"), F.col("q").cast("string")).alias("holiday"), "best.day")


def all_holidays(spark, d):
    return fc.fixed_holidays(regions(spark, d)).unionByName(fc.movable_holidays(regions(spark, d), peak_days(spark, d)))


@query("movable_holidays", "P9", with_(LIFTS, PEAKS, CALENDAR) + "select holiday, day, 2 as before, 1 as after from moved")
def q_movable(spark, d):
    return fc.movable_holidays(regions(spark, d), peak_days(spark, d))


@query("holiday_days_with_feasts", "P9 U2", with_(LIFTS, PEAKS, CALENDAR) + "select month, holiday_days from calendar")
def q_feasts(spark, d):
    return fc.holiday_days(all_holidays(spark, d))


TEST = """back as (select *, row_number() over (partition by outlet_id, item order by month desc) as b from series),
held as (select outlet_id, item, month, quantity as actual, 3 - b as month_offset from back where b <= 2),
train as (select outlet_id, item, month, quantity from back where b > 2),
tf as (select * from (select *, lag(quantity, 2) over (partition by outlet_id, item order by month) as lag_2 from train) where lag_2 is not null),
tl as (select outlet_id, item,
    sum(0.3::double * pow(0.7::double, k - 1) * quantity) + pow(0.7::double, count(*)) * max(case when k = 1 then quantity end) as level
  from (select *, row_number() over (partition by outlet_id, item order by month desc) as k from tf) where k <= 6 group by 1, 2),
models as (select outlet_id, item, 'smoothing' as model, """ + r("level", 2) + """ as p1, """ + r("level", 2) + """ as p2 from tl
  union all select outlet_id, item, 'growth', """ + r("base * 1.02::double", 2) + """, """ + r("base * pow(1.02::double, 2)", 2) + """
  from (select outlet_id, item, max_by(quantity, month) as base from train group by 1, 2)),
tested as (select h.outlet_id, h.item, month, cast(month_offset as integer) as month_offset, model, actual,
  case when month_offset = 1 then p1 else p2 end as predicted from held h join models using (outlet_id, item))"""  # fmt: skip


@remembered
def tested(spark, d):
    return inputs.keep(fc.backtest(series(spark, d)))


@query("forecast_backtest", "P15", with_(LIFTS, SERIES, TEST) + "select * from tested")
def q_backtest(spark, d):
    return tested(spark, d)


@query(
    "forecast_errors",
    "G19",
    with_(LIFTS, SERIES, TEST)
    + """select model, item, avg(case when actual <> 0 then abs((actual - predicted) / actual) end) as mape
     from tested group by 1, 2""",
    doubles=["mape"],
    digits=7,
)
def q_errors(spark, d):
    return fc.mape(tested(spark, d), ["model", "item"])


ERR = """errs as (select outlet_id, item, model, avg(case when actual <> 0 then abs((actual - predicted) / actual) end) as mape
  from tested group by 1, 2, 3)"""


@query(
    "ensemble_weights",
    "P12",
    with_(LIFTS, SERIES, TEST, ERR)
    + """select a.outlet_id, a.item, a.mape as mape_a, b.mape as mape_b,
       case when a.mape + b.mape < 1e-8 then 0.4::double else b.mape / (a.mape + b.mape) end as weight_a,
       case when a.mape + b.mape < 1e-8 then 0.6::double else a.mape / (a.mape + b.mape) end as weight_b
     from errs a join errs b using (outlet_id, item) where a.model = 'smoothing' and b.model = 'growth'""",
    doubles=["mape_a", "mape_b", "weight_a", "weight_b"],
    digits=7,
)
def q_weights(spark, d):
    errors = fc.mape(tested(spark, d), [*fc.SERIES, "model"])
    return fc.inverse_error_weights(errors.where("model = 'smoothing'"), errors.where("model = 'growth'"), fc.SERIES)


@query(
    "forecast_retrain_list",
    "P13",
    with_(LIFTS, SERIES, TEST, ERR)
    + """, k as (select * from (select distinct outlet_id, item from series), (values ('smoothing'), ('growth')) m(model))
      select k.outlet_id, k.item, k.model, case when e.outlet_id is null then 'never fitted' else 'error too high' end as reason
      from k left join errs e using (outlet_id, item, model) where e.outlet_id is null or coalesce(e.mape, 1) > 0.15""",
)
def q_retrain(spark, d):
    """Every series and model; those with a backtest count as fitted."""
    return fc.retrain_list(series(spark, d), fc.mape(tested(spark, d), [*fc.SERIES, "model"]), ["smoothing", "growth"])


def _seasonal_sql(months: int = 3, ridge: float = 1e-3) -> str:
    """The regression in SQL: elimination on the normal equations, one CTE per pivot."""
    angle = "(2 * pi() * (mi % 12) / 12)"
    terms = ["1.0::double", "((mi - start) / 12.0::double)", f"sin({angle})", f"cos({angle})", f"sin(2 * {angle})", f"cos(2 * {angle})", "days"]
    n = len(terms)
    cells = [f"sum(t{i} * t{j}) + {ridge if i == j and i else 0}::double * count(*) as a{i}_{j}" for i in range(n) for j in range(n)]
    cells += [f"sum(t{i} * quantity) as a{i}_{n}" for i in range(n)]
    parts = [
        """history as (select region, item, year(month) * 12 + month(month) - 1 as mi, quantity::double as quantity from region_series),
ends as (select region, item, min(mi) as start, max(mi) as last from history group by 1, 2),
cal as (select year(month) * 12 + month(month) - 1 as mi, holiday_days from calendar),
points as (select h.*, start, last, coalesce(holiday_days, 0)::double as days from history h join ends using (region, item) left join cal using (mi))""",
        "terms as (select region, item, quantity, " + ", ".join(f"{t} as t{i}" for i, t in enumerate(terms)) + " from points)",
        "e0 as (select region, item, " + ", ".join(cells) + " from terms group by 1, 2)",
    ]
    for k in range(n):
        rows = [
            (f"a{k}_{j} / a{k}_{k}" if i == k else f"a{i}_{j} - a{i}_{k} * a{k}_{j} / a{k}_{k}") + f" as a{i}_{j}"
            for i in range(n) for j in range(k + 1, n + 1)
        ]
        parts.append(f"e{k + 1} as (select region, item, {', '.join(rows)} from e{k})")
    line = " + ".join(f"a{i}_{n} * {t}" for i, t in enumerate(terms))
    some = lambda a, b: " + ".join(f"a{i}_{n} * {terms[i]}" for i in range(a, b))
    parts += [
        f"spreads as (select region, item, 1.645::double * sqrt(avg(pow(quantity - ({line}), 2))) as spread from points join e{n} using (region, item) group by 1, 2)",
        f"""ahead as (select region, item, start, last, last + m as mi, cast(m as integer) as month_offset, coalesce(holiday_days, 0)::double as days
  from ends, range(1, {months + 1}) t(m) left join cal on cal.mi = last + m)""",
        f"""seasons as (select region, item, month_offset, greatest({line}, 0) as predicted, greatest({line} - spread, 0) as lower, greatest({line} + spread, 0) as upper,
  {some(0, 2)} as trend, {some(2, 6)} as season, {some(6, 7)} as holiday_effect from ahead join e{n} using (region, item) join spreads using (region, item))""",
    ]
    return ",\n".join(parts)


SEASONS = _seasonal_sql()


@query(
    "seasonal_forecast",
    "P8 P9",
    with_(LIFTS, REGION_SERIES, PEAKS, CALENDAR, SEASONS) + "select * from seasons",
    doubles=["predicted", "lower", "upper", "trend", "season", "holiday_effect"],
    digits=3,
)
def q_seasonal(spark, d):
    return fc.seasonal(regions(spark, d), fc.holiday_days(all_holidays(spark, d)))


FORECASTS = f"""own_sums as (select outlet_id, item, sum(quantity) as own, region from series join outlets using (outlet_id) group by 1, 2, 4),
all_sums as (select region, item, sum(own) as all_outlets from own_sums group by 1, 2),
shared as (select outlet_id, item, month_offset, {", ".join(r(f"{c} * case when all_outlets > 0 then own / all_outlets else 0 end", 2) + f" as {c}" for c in ("predicted", "lower", "upper"))}
  from own_sums join all_sums using (region, item) join seasons using (region, item)),
blended as (select s.outlet_id, s.item, s.last_month, s.month_offset, 0.4::double * s.predicted + 0.6::double * g.predicted as blend,
  least(s.lower, g.lower) as low, greatest(s.upper, g.upper) as high from smooth s join shared g using (outlet_id, item, month_offset)),
told as (
  select outlet_id, item, last_month, month_offset, {r("blend", 2)} as predicted, {r("low", 2)} as lower, {r("high", 2)} as upper, 'ensemble' as model,
    case when blend < low * 0.7::double then 'understock_risk' when blend > high * 1.3::double then 'overstock_risk' end as risk_flag from blended
  union all select outlet_id, item, last_month, cast(m as integer), {r("base * pow(1.02::double, m)", 2)}, {r("base * pow(1.02::double, m) * 0.85::double", 2)},
    {r("base * pow(1.02::double, m) * 1.15::double", 2)}, 'growth', null from short, range(1, 4) t(m) where base <> 0
  union all select outlet_id, item, null, null, null, null, null, 'no_data', null from short where base = 0),
forecasts as (select t.* exclude (last_month), region, cast(last_month + to_months(month_offset) as date) as forecast_month from told t left join outlets using (outlet_id))"""
FORECAST_CTES = (LIFTS, OUTLETS, SERIES, REGION_SERIES, FEATS, LEVELS, SMOOTH, SHORT, PEAKS, CALENDAR, SEASONS, FORECASTS)


@remembered
def forecasts(spark, d):
    lifts = fixtures.lifts(spark, d)
    days = fc.holiday_days(all_holidays(spark, d))
    return inputs.keep(fc.forecast_run(fixtures.outlets(spark, d), lifts, ALL_ITEMS, holidays=days))


@query("forecast_run", "P14", with_(*FORECAST_CTES) + "select * from forecasts", doubles=["predicted", "lower", "upper"], digits=1)
def q_run(spark, d):
    return forecasts(spark, d)


@query(
    "risk_flags",
    "V14 P14",
    with_(*FORECAST_CTES, *GAP_CTES)
    + f"""select outlet_id, region, item, month_offset, risk_flag, null::double as gap_pct, model from forecasts where month_offset <= 1 and risk_flag is not null
     union all select outlet_id, region, item, month_offset, flag, null, 'entitlement' from (
       select f.outlet_id, f.region, item, month_offset, case when predicted < expected_staple * 0.7::double then 'understock_risk'
         when predicted > expected_staple * 1.3::double then 'overstock_risk' end as flag
       from forecasts f join gaps g on g.outlet_id = f.outlet_id where item = '{fixtures.ITEMS["staple"]}' and month_offset <= 1) where flag is not null
     union all select outlet_id, region, null, null, 'over_supplied', gap_pct, 'entitlement' from gaps where supply_status = 'over_supplied'""",
)
def q_flags(spark, d):
    return fc.risk_flags(forecasts(spark, d), gaps(spark, d), fixtures.ITEMS["staple"])
