"""Monthly demand series and forecasts. Every step handles all series in one plan."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from granary.functions.columns import half_even
from granary.session import stored

SERIES = ["outlet_id", "item"]
SMOOTHING = 0.3
SMOOTHED_ROWS = 6
BAND = 0.15
GROWTH = 0.02
MIN_HISTORY = 3
RETRAIN_AT = 0.15
ENSEMBLE = {"smoothing": 0.4, "seasonal": 0.6}
Z_90 = 1.645


def monthly_series(lifts: DataFrame) -> DataFrame:
    """Quantity and active cards per outlet, item and month: one grouping for all series."""
    return (
        lifts.where("outlet_id is not null and lift_ts is not null")
        .groupBy(*SERIES, F.trunc(F.to_date("lift_ts"), "month").alias("month"))
        .agg(F.sum("quantity").alias("quantity"), F.count_distinct("card_id").alias("active_cards"))
    )


def region_series(lifts: DataFrame) -> DataFrame:
    """Per region, item and month: mean per lift row, total, active cards."""
    return (
        lifts.where("region is not null and lift_ts is not null")
        .groupBy("region", "item", F.trunc(F.to_date("lift_ts"), "month").alias("month"))
        .agg(
            F.avg("quantity").alias("mean_quantity"),
            F.sum("quantity").alias("quantity"),
            F.count_distinct("card_id").alias("active_cards"),
        )
    )


def _in_order(keys: Sequence[str]) -> Window:
    # A series has one row per month, so its window stays small however many lifts there are.
    return Window.partitionBy(*keys).orderBy("month")


def series_features(series: DataFrame, keys: Sequence[str] = SERIES) -> DataFrame:
    """Season, lags and rolling statistics; rows without a full history of three months are dropped."""
    w = _in_order(keys)
    last3 = w.rowsBetween(-2, 0)
    full = F.count("quantity").over(last3) == 3
    return (
        series.withColumns(
            {
                "lag_1": F.lag("quantity", 1).over(w),
                "lag_2": F.lag("quantity", 2).over(w),
                "rolling_avg_3": F.when(full, F.avg("quantity").over(last3)),
                "rolling_std_3": F.coalesce(F.when(full, F.stddev_samp("quantity").over(last3)), F.lit(0.0)),
                "month_sin": F.expr("sin(2 * pi() * month(month) / 12)"),
                "month_cos": F.expr("cos(2 * pi() * month(month) / 12)"),
            }
        )
        .where("quantity is not null and lag_2 is not null and rolling_avg_3 is not null")
    )


def standardise(features: DataFrame, cols: Sequence[str], keys: Sequence[str] = SERIES) -> DataFrame:
    """(x − mean) / deviation inside each series."""
    w = Window.partitionBy(*keys)
    return features.withColumns(
        {c: (F.col(c) - F.avg(c).over(w)) / (F.stddev_pop(c).over(w) + F.lit(1e-8)) for c in cols}
    )


def sequences(series: DataFrame, length: int = 6, keys: Sequence[str] = SERIES) -> DataFrame:
    """Sliding inputs of ``length`` months with the following month as target."""
    before = _in_order(keys).rowsBetween(-length, -1)
    return (
        series.withColumn("inputs", F.collect_list("quantity").over(before))
        .where(F.size("inputs") == length)
        .select(*keys, "month", "inputs", F.col("quantity").alias("target"))
    )


def _offsets(df: DataFrame, months: int) -> DataFrame:
    return df.withColumn("month_offset", F.explode(F.sequence(F.lit(1), F.lit(months))))


def smoothing(features: DataFrame, months: int = 3, keys: Sequence[str] = SERIES) -> DataFrame:
    """Exponential smoothing over the last six feature rows, seeded with the last value, flat ahead.

    Unrolled: the value k steps back has weight α·(1−α)^k and the seed (1−α)^n, so a grouped sum is enough.
    """
    recent = features.withColumn(
        "back", F.row_number().over(Window.partitionBy(*keys).orderBy(F.col("month").desc()))
    ).where(F.col("back") <= SMOOTHED_ROWS)
    keep = 1 - SMOOTHING
    level = (
        recent.groupBy(*keys)
        .agg(
            F.expr(f"sum({SMOOTHING}D * pow({keep}D, back - 1) * quantity) as weighted"),
            F.expr(f"pow({keep}D, count(1)) as seed_weight"),
            F.expr("max(case when back = 1 then quantity end) as seed"),
            F.max("month").alias("last_month"),
        )
        .withColumn("level", F.expr("weighted + seed_weight * seed"))
    )
    return _offsets(level, months).select(
        *keys,
        "last_month",
        "month_offset",
        half_even("level", 2).alias("predicted"),
        half_even(F.expr(f"level * {1 - BAND}D"), 2).alias("lower"),
        half_even(F.expr(f"level * {1 + BAND}D"), 2).alias("upper"),
        F.lit("smoothing").alias("model"),
    )


def growth(base: DataFrame, months: int = 3, rate: float = GROWTH, keys: Sequence[str] = SERIES) -> DataFrame:
    """Compound growth from ``base`` (keys, last_month, base)."""
    grown = f"base * pow({1 + rate}D, month_offset)"
    return _offsets(base, months).select(
        *keys,
        "last_month",
        "month_offset",
        half_even(F.expr(f"greatest({grown}, 0D)"), 2).alias("predicted"),
        half_even(F.expr(f"greatest({grown} * {1 - BAND}D, 0D)"), 2).alias("lower"),
        half_even(F.expr(f"{grown} * {1 + BAND}D"), 2).alias("upper"),
        F.lit("growth").alias("model"),
    )


def last_values(series: DataFrame, keys: Sequence[str] = SERIES, value: str = "quantity") -> DataFrame:
    """Last value of each series and its length."""
    return series.groupBy(*keys).agg(
        F.max_by(value, "month").alias("base"), F.max("month").alias("last_month"), F.count(F.lit(1)).alias("months")
    )


def short_series_base(outlet_items: DataFrame, series: DataFrame, regions: DataFrame) -> DataFrame:
    """Growth base for outlet × item pairs with less than three months.

    Own last value, else the region's last mean; a pair with neither (or zero) has no base.
    ``outlet_items``: outlet_id, region, item.
    """
    own = last_values(series)
    region = last_values(regions, ["region", "item"], "mean_quantity").select(
        "region", "item", F.col("base").alias("region_base"), F.col("last_month").alias("region_month")
    )
    joined = (
        outlet_items.join(own, SERIES, "left")
        .where(F.coalesce(F.col("months"), F.lit(0)) < MIN_HISTORY)
        .join(region, ["region", "item"], "left")
    )
    return joined.select(
        *SERIES,
        "region",
        F.expr("coalesce(base, region_base, 0D) as base"),
        F.expr("case when base is not null then last_month else region_month end as last_month"),
        F.expr("coalesce(months, 0) as months"),
    )


def holiday_days(calendar: DataFrame) -> DataFrame:
    """Number of days under holiday influence per month.

    ``calendar``: holiday, day (date), before, after (days of influence). Movable feasts come as rows.
    """
    return (
        calendar.dropDuplicates(["holiday", "day"])
        .select(F.explode(F.expr("sequence(date_sub(day, before), date_add(day, after))")).alias("day"))
        .distinct()
        .groupBy(F.trunc("day", "month").alias("month"))
        .agg(F.count(F.lit(1)).alias("holiday_days"))
    )


# Holidays on the same date every year (month, day), one day of influence on each side.
FIXED_HOLIDAYS = {
    "Republic Day": (1, 26),
    "Independence Day": (8, 15),
    "Christmas": (12, 25),
    "Sankranti / Pongal": (1, 15),
    "Gandhi Jayanti": (10, 2),
}


def fixed_holidays(months: DataFrame) -> DataFrame:
    """Calendar rows of the fixed holidays for the years in ``months`` (column month) and one more."""
    years = months.agg(F.expr("explode(sequence(year(min(month)), year(max(month)) + 1)) as year"))
    entries = ", ".join(
        f"struct('{name}' as holiday, make_date(year, {m}, {d}) as day)" for name, (m, d) in FIXED_HOLIDAYS.items()
    )
    return years.select(F.expr(f"inline(array({entries}))")).withColumns({"before": F.lit(1), "after": F.lit(1)})


def movable_holidays(months: DataFrame, known: DataFrame, before: int = 2, after: int = 1) -> DataFrame:
    """Calendar rows of the movable feasts for the years in ``months`` (column month) and one more.

    ``known``: holiday, day, for the years of which dates are known. A year without dates takes those of the nearest known
    year, earlier or later, the earlier one of two as near; days that it does not have are left out.
    """
    years = months.agg(F.expr("explode(sequence(year(min(month)), year(max(month)) + 1)) as year"))
    # One row of as many numbers as there are known years.
    listed = known.agg(F.collect_set(F.year("day")).alias("y")).scalar()
    near = F.array_min(F.transform("listed", lambda y: F.struct(F.abs(y - F.col("year")).alias("apart"), y.alias("known"))))
    dates = known.select("holiday", F.year("day").alias("known"), F.date_format("day", "MM-dd").alias("month_day")).distinct()
    moved = years.withColumn("listed", listed).withColumn("known", near["known"]).join(dates, "known")
    day = F.expr("try_cast(concat(lpad(cast(year as string), 4, '0'), '-', month_day) as date)")
    return moved.select("holiday", day.alias("day")).where("day is not null").withColumns({"before": F.lit(before), "after": F.lit(after)})


#: Terms of the seasonal regression: level, trend in years, two yearly harmonics, days under holiday influence.
_ANGLE = f"({2 * math.pi!r}D * (month_index % 12) / 12)"
SEASON_TERMS = [
    "1D", "((month_index - start) / 12D)", f"sin({_ANGLE})", f"cos({_ANGLE})", f"sin(2D * {_ANGLE})", f"cos(2D * {_ANGLE})", "holiday_days",
]


def normal_equations(rows: DataFrame, terms: Sequence[str], target: str, keys: Sequence[str], ridge: float) -> DataFrame:
    """keys and b0, b1, ...: the least squares coefficients of every group, with a penalty on all but the first term.

    Products are summed by the grouping; the small system is solved by a Cholesky factorisation in column expressions.
    """
    size = range(len(terms))
    named = rows.select(*keys, target, *[F.expr(t).alias(f"t{i}") for i, t in enumerate(terms)])
    sums = [F.sum(F.col(f"t{i}") * F.col(f"t{j}")).alias(f"m{i}_{j}") for i in size for j in range(i + 1)]
    sums += [F.sum(F.col(f"t{i}") * F.col(target)).alias(f"v{i}") for i in size]
    out = named.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), *sums)

    def less(start: str, products: list[str]) -> str:
        return " - ".join([start, *products])

    for j in size:
        start = f"m{j}_{j}" if j == 0 else f"m{j}_{j} + {ridge!r}D * n"
        out = out.withColumn(f"l{j}_{j}", F.expr(f"sqrt({less(start, [f'l{j}_{k} * l{j}_{k}' for k in range(j)])})"))
        if j + 1 < len(terms):
            out = out.withColumns(
                {f"l{i}_{j}": F.expr(f"({less(f'm{i}_{j}', [f'l{i}_{k} * l{j}_{k}' for k in range(j)])}) / l{j}_{j}") for i in range(j + 1, len(terms))}
            )
    for i in size:
        out = out.withColumn(f"z{i}", F.expr(f"({less(f'v{i}', [f'l{i}_{k} * z{k}' for k in range(i)])}) / l{i}_{i}"))
    for i in reversed(size):
        out = out.withColumn(f"b{i}", F.expr(f"({less(f'z{i}', [f'l{k}_{i} * b{k}' for k in range(i + 1, len(terms))])}) / l{i}_{i}"))
    return out.select(*keys, *[f"b{i}" for i in size])


def seasonal(regions: DataFrame, holidays: DataFrame, months: int = 3, ridge: float = 1e-3) -> DataFrame:
    """Trend, two yearly harmonics and a holiday effect per region × item, with a 90 % band.

    Grouped sums and column expressions only. The first term is not penalised, so residuals have mean 0.
    """
    keys = ["region", "item"]
    index = "(year(month) * 12 + month(month) - 1)"
    calendar = holidays.select(F.expr(f"{index} as month_index"), "holiday_days")
    history = regions.select(*keys, F.expr(f"{index} as month_index"), F.col("quantity").cast("double").alias("quantity")).where("quantity is not null")
    ends = history.groupBy(*keys).agg(F.min("month_index").alias("start"), F.max("month_index").alias("last"))

    def with_days(rows: DataFrame) -> DataFrame:
        return rows.join(calendar, "month_index", "left").withColumn("holiday_days", F.coalesce("holiday_days", F.lit(0)).cast("double"))

    known = with_days(history.join(ends, keys))
    beta = stored(normal_equations(known, SEASON_TERMS, "quantity", keys, ridge), "season")
    line = " + ".join(f"b{i} * {t}" for i, t in enumerate(SEASON_TERMS))
    spread = known.join(beta, keys).groupBy(*keys).agg(F.expr(f"{Z_90!r}D * sqrt(avg(pow(quantity - ({line}), 2))) as spread"))
    ahead = with_days(ends.withColumn("month_index", F.explode(F.sequence(F.col("last") + 1, F.col("last") + months))))
    parts = {"trend": SEASON_TERMS[:2], "season": SEASON_TERMS[2:6], "holiday_effect": SEASON_TERMS[6:]}
    first = {"trend": 0, "season": 2, "holiday_effect": 6}
    sums = [F.expr(" + ".join(f"b{first[n] + i} * {t}" for i, t in enumerate(own))).alias(n) for n, own in parts.items()]
    told = ahead.join(beta, keys).join(spread, keys).select(*keys, (F.col("month_index") - F.col("last")).cast("int").alias("month_offset"), F.expr(f"{line} as line"), "spread", *sums)
    return told.select(
        *keys,
        "month_offset",
        F.greatest("line", F.lit(0.0)).alias("predicted"),
        F.greatest(F.col("line") - F.col("spread"), F.lit(0.0)).alias("lower"),
        F.greatest(F.col("line") + F.col("spread"), F.lit(0.0)).alias("upper"),
        *parts,
    )


def share_out(seasonal_forecast: DataFrame, series: DataFrame, outlets: DataFrame) -> DataFrame:
    """Scale region forecasts to outlets by their share of the region's quantity."""
    own = series.groupBy(*SERIES).agg(F.sum("quantity").alias("own"), F.max("month").alias("last_month"))
    placed = own.join(outlets.select("outlet_id", "region"), "outlet_id")
    region = placed.groupBy("region", "item").agg(F.sum("own").alias("all_outlets"))
    shares = placed.join(region, ["region", "item"]).withColumn(
        "share", F.expr("case when all_outlets > 0 then own / all_outlets else 0D end")
    )
    return shares.join(seasonal_forecast, ["region", "item"]).select(
        *SERIES,
        "last_month",
        "month_offset",
        *[half_even(F.col(c) * F.col("share"), 2).alias(c) for c in ("predicted", "lower", "upper")],
        F.lit("seasonal").alias("model"),
    )


def combine(
    a: DataFrame, b: DataFrame, weight_a: float = ENSEMBLE["smoothing"], weight_b: float = ENSEMBLE["seasonal"],
    weights: DataFrame | None = None,
) -> DataFrame:
    """Blend two forecasts of the same series and month; the band is the wider one.

    ``weights`` (outlet_id, item, weight_a, weight_b) overrides the constants per series.
    """
    key = [*SERIES, "month_offset"]
    left = a.select(*key, "last_month", *[F.col(c).alias(f"a_{c}") for c in ("predicted", "lower", "upper")])
    right = b.select(*key, *[F.col(c).alias(f"b_{c}") for c in ("predicted", "lower", "upper")])
    out = left.join(right, key)
    wa, wb = f"{weight_a}D", f"{weight_b}D"
    if weights is not None:
        out = out.join(weights.select(*SERIES, "weight_a", "weight_b"), SERIES, "left")
        wa, wb = f"coalesce(weight_a, {wa})", f"coalesce(weight_b, {wb})"
    out = out.selectExpr(
        *key, "last_month", "a_predicted", "b_predicted",
        f"{wa} * a_predicted + {wb} * b_predicted as blend",
        "least(a_lower, b_lower) as low", "greatest(a_upper, b_upper) as high",
    )
    flag = "case when blend < low * 0.7D then 'understock_risk' when blend > high * 1.3D then 'overstock_risk' end"
    return out.select(
        *key,
        "last_month",
        half_even("blend", 2).alias("predicted"),
        half_even("low", 2).alias("lower"),
        half_even("high", 2).alias("upper"),
        F.lit("ensemble").alias("model"),
        F.expr(f"{flag} as risk_flag"),
        "a_predicted",
        "b_predicted",
    )


def mape(pairs: DataFrame, keys: Sequence[str], actual: str = "actual", predicted: str = "predicted") -> DataFrame:
    """Mean absolute percentage error over the non-zero actuals; null when there are none."""
    return pairs.groupBy(*keys).agg(
        F.expr(f"avg(case when {actual} <> 0 then abs(({actual} - {predicted}) / {actual}) end) as mape")
    )


def inverse_error_weights(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Weight of each model from the error of the other; no error at all keeps the defaults."""
    both = a.select(*keys, F.col("mape").alias("mape_a")).join(b.select(*keys, F.col("mape").alias("mape_b")), list(keys))
    total = "(mape_a + mape_b)"
    return both.selectExpr(
        *keys,
        "mape_a",
        "mape_b",
        f"case when {total} < 1e-8D then {ENSEMBLE['smoothing']}D else mape_b / {total} end as weight_a",
        f"case when {total} < 1e-8D then {ENSEMBLE['seasonal']}D else mape_a / {total} end as weight_b",
    )


def backtest(series: DataFrame, horizon: int = 2, keys: Sequence[str] = SERIES) -> DataFrame:
    """Actual and predicted values of the last ``horizon`` months, per model, from the months before."""
    back = series.withColumn("__back", F.row_number().over(Window.partitionBy(*keys).orderBy(F.col("month").desc())))
    held = back.where(F.col("__back") <= horizon).select(
        *keys, "month", F.col("quantity").alias("actual"), (F.lit(horizon + 1) - F.col("__back")).alias("month_offset")
    )
    train = back.where(F.col("__back") > horizon).drop("__back")
    models = smoothing(series_features(train, keys), horizon, keys).unionByName(
        growth(last_values(train, keys), horizon, keys=keys)
    )
    return held.join(models, [*keys, "month_offset"]).select(*keys, "month", "month_offset", "model", "actual", "predicted")


def retrain_list(series: DataFrame, errors: DataFrame, models: Sequence[str], threshold: float = RETRAIN_AT) -> DataFrame:
    """Series and models to fit again: never fitted, or error above the threshold.

    ``errors``: outlet_id, item, model, mape of the fitted ones.
    """
    keys = [*SERIES, "model"]
    wanted = series.select(*SERIES).distinct().withColumn("model", F.explode(F.array(*map(F.lit, models))))
    fitted = errors.select(*keys, "mape", F.lit(True).alias("fitted"))
    reason = (
        "case when fitted is null then 'never fitted' "
        f"when coalesce(mape, 1D) > {threshold}D then 'error too high' end as reason"
    )
    return wanted.join(fitted, keys, "left").select(*keys, F.expr(reason)).where("reason is not null")


def forecast_run(
    outlets: DataFrame, lifts: DataFrame, items: Sequence[str], months: int = 3, holidays: DataFrame | None = None
) -> DataFrame:
    """Forecast of every outlet × item: ensemble with three months of history, growth with less.

    Pairs without any base give one row with model ``no_data`` and no forecast month.
    """
    wanted = lifts.where(F.col("item").isin(*items))
    pairs = outlets.select("outlet_id", "region", F.explode(F.array(*[F.lit(i) for i in items])).alias("item"))
    # Both are read several times below; stored, the lifts are scanned once for each.
    series, regions = stored(monthly_series(wanted), "series"), stored(region_series(wanted), "regions")
    if holidays is None:
        holidays = holiday_days(fixed_holidays(regions))
    smooth = smoothing(series_features(series), months)
    season = share_out(seasonal(regions, holidays, months), series, outlets)
    columns = [*SERIES, "last_month", "month_offset", "predicted", "lower", "upper", "model", "risk_flag"]
    long_history = combine(smooth, season).select(*columns)
    base = short_series_base(pairs, series, regions)
    short = growth(base.where("base <> 0"), months).withColumn("risk_flag", F.lit(None).cast("string")).select(*columns)
    nothing = base.where("base = 0").select(
        *SERIES,
        F.lit(None).cast("date").alias("last_month"),
        F.lit(None).cast("int").alias("month_offset"),
        *[F.lit(None).cast("double").alias(c) for c in ("predicted", "lower", "upper")],
        F.lit("no_data").alias("model"),
        F.lit(None).cast("string").alias("risk_flag"),
    )
    return (
        long_history.unionByName(short)
        .unionByName(nothing)
        .join(outlets.select("outlet_id", "region"), "outlet_id", "left")
        .withColumn("forecast_month", F.expr("cast(add_months(last_month, month_offset) as date)"))
        .drop("last_month")
    )


def entitlement_flags(forecasts: DataFrame, demand: DataFrame, staple: str) -> DataFrame:
    """Staple forecasts far from the monthly entitlement of the outlet.

    An ensemble value always lies inside its own band, so the band alone can never flag it.
    """
    flag = (
        "case when predicted < expected_staple * 0.7D then 'understock_risk' "
        "when predicted > expected_staple * 1.3D then 'overstock_risk' end"
    )
    return (
        forecasts.where((F.col("item") == staple) & F.col("predicted").isNotNull())
        .join(demand.select("outlet_id", "expected_staple"), "outlet_id")
        .withColumn("risk_flag", F.expr(flag))
    )


def risk_flags(
    forecasts: DataFrame, gaps: DataFrame, staple: str, months: int = 1, region: str | None = None
) -> DataFrame:
    """Forecasts up to ``months`` ahead that leave their band or the entitlement, and over-supplied outlets."""
    near = forecasts.where(F.col("month_offset") <= months)
    columns = ["outlet_id", "region", "item", "month_offset", "risk_flag", "gap_pct", "model"]
    no_gap = F.lit(None).cast("double").alias("gap_pct")
    parts = [
        near.withColumn("gap_pct", no_gap).select(*columns),
        entitlement_flags(near, gaps, staple).withColumns({"gap_pct": no_gap, "model": F.lit("entitlement")}).select(*columns),
        gaps.where("supply_status = 'over_supplied'").select(
            "outlet_id",
            "region",
            F.lit(None).cast("string").alias("item"),
            F.lit(None).cast("int").alias("month_offset"),
            F.lit("over_supplied").alias("risk_flag"),
            "gap_pct",
            F.lit("entitlement").alias("model"),
        ),
    ]
    out = parts[0].unionByName(parts[1]).unionByName(parts[2]).where("risk_flag is not null")
    return out.where(F.col("region") == region) if region else out
