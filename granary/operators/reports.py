"""Dashboard tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from granary.functions.columns import half_even


def _latest_month_only(lifts: DataFrame) -> DataFrame:
    """Lifts of the last month that has data (not of today's month)."""
    known = lifts.where("lift_ts is not null").withColumn("month", F.trunc(F.to_date("lift_ts"), "month"))
    return known.where(F.col("month") == known.agg(F.max("month")).scalar())


def latest_month_items(lifts: DataFrame) -> DataFrame:
    return _latest_month_only(lifts).groupBy("item").agg(half_even(F.sum("quantity"), 2).alias("total"))


def latest_month_lifts(lifts: DataFrame) -> DataFrame:
    return _latest_month_only(lifts).agg(F.count(F.lit(1)).alias("lifts"))


def outlet_health(outlets: DataFrame) -> DataFrame:
    return outlets.agg(
        F.expr("count(1) as total"),
        F.expr("count_if(is_active) as active"),
        F.expr("count_if(not is_active) as inactive"),
        half_even(F.expr("count_if(is_active) / cast(greatest(count(1), 1) as double) * 100D"), 1).alias("active_pct"),
    )


def region_volumes(lifts: DataFrame, n: int = 15) -> DataFrame:
    return (
        lifts.where("region is not null")
        .groupBy("region")
        .agg(half_even(F.sum("quantity"), 1).alias("total"))
        .orderBy(F.col("total").desc(), "region")
        .limit(n)
    )


def item_breakdown(lifts: DataFrame) -> DataFrame:
    return lifts.where("item is not null").groupBy("item").agg(half_even(F.sum("quantity"), 1).alias("total"))


def monthly_trend(lifts: DataFrame, months: int = 24) -> DataFrame:
    return (
        lifts.where("lift_ts is not null")
        .groupBy(F.trunc(F.to_date("lift_ts"), "month").alias("month"))
        .agg(F.count(F.lit(1)).alias("lifts"), half_even(F.sum("quantity"), 1).alias("total"))
        .orderBy(F.col("month").desc())
        .limit(months)
        .orderBy("month")
        .select(F.date_format("month", "yyyy-MM").alias("month"), "lifts", "total")
    )


def card_types(members: DataFrame) -> DataFrame:
    return members.where("card_type is not null").groupBy("card_type").agg(F.count(F.lit(1)).alias("cards"))


def top_member_regions(members: DataFrame, n: int = 10) -> DataFrame:
    return (
        members.where("region is not null")
        .groupBy("region")
        .agg(F.count(F.lit(1)).alias("members"))
        .orderBy(F.col("members").desc(), "region")
        .limit(n)
    )


def region_outlets(outlets: DataFrame, n: int = 15) -> DataFrame:
    return (
        outlets.where("region is not null")
        .groupBy("region")
        .agg(F.count(F.lit(1)).alias("total"), F.count_if("is_active").alias("active"))
        .orderBy(F.col("total").desc(), "region")
        .limit(n)
    )


def top_alert_regions(alerts_with_region: DataFrame, n: int = 5) -> DataFrame:
    """Regions with most alerts; the Unknown bucket is dropped after the cut, so fewer can remain."""
    return (
        alerts_with_region.groupBy(F.col("shown_region").alias("region"))
        .agg(F.count(F.lit(1)).alias("alerts"))
        .orderBy(F.col("alerts").desc(), "region")
        .limit(n)
        .where("region <> 'Unknown'")
    )


def pattern_counts(alerts: DataFrame) -> DataFrame:
    return alerts.groupBy("pattern").agg(F.count(F.lit(1)).alias("alerts"))


def top_patterns_per_region(alerts_with_region: DataFrame, n: int = 3) -> DataFrame:
    counts = alerts_with_region.groupBy("shown_region", "pattern").agg(F.count(F.lit(1)).alias("alerts"))
    order = Window.partitionBy("shown_region").orderBy(F.col("alerts").desc(), "pattern")
    return counts.withColumn("place", F.row_number().over(order)).where(F.col("place") <= n)


def severe_alerts(alerts: DataFrame, n: int | None = 50) -> DataFrame:
    """Critical and high alerts, the ``n`` with the highest score or all."""
    severe = alerts.where(F.col("severity").isin("Critical", "High"))
    return severe if n is None else severe.orderBy(F.col("score").desc(), "alert_id").limit(n)


def stratified_head(outlets: DataFrame, cap: int) -> DataFrame:
    """At most ``cap`` outlets with every region represented: the first ``cap // regions`` of each."""
    regions = outlets.agg(F.count_distinct("region")).scalar()
    per_region = F.greatest(F.lit(1), F.floor(F.lit(cap) / F.greatest(F.lit(1), regions)))
    order = Window.partitionBy("region").orderBy("outlet_id")
    # A constant bound lets Spark cut each region before the shuffle; the exact share is applied after it.
    return (
        outlets.withColumn("__place", F.row_number().over(order))
        .where(F.col("__place") <= cap)
        .where(F.col("__place") <= per_region)
        .orderBy("region", "outlet_id")
        .limit(cap)
        .drop("__place")
    )


def kpis(
    outlets: DataFrame, members: DataFrame, lifts: DataFrame, alerts: DataFrame, access: DataFrame | None = None
) -> DataFrame:
    """One row of headline numbers. ``access`` is the one-row result of the access summary."""
    out = outlets.agg(F.expr("count(1) as outlets"), F.expr("count_if(is_active) as active_outlets"))
    singles = {
        "members": members.agg(F.count(F.lit(1))),
        "regions": members.agg(F.count_distinct("region")),
        "lifts_latest_month": latest_month_lifts(lifts),
        "alerts_open": alerts.agg(F.count_if(F.col("status") == "open")),
        "alerts_critical": alerts.agg(F.count_if(F.col("severity") == "Critical")),
        "rings": alerts.agg(F.count_if(F.col("model") == "rings")),
    }
    if access is not None:
        singles["pct_in_reach"] = access.select("pct_in_reach")
    return out.withColumns({name: frame.scalar() for name, frame in singles.items()})


def text_summary(kpi_row: DataFrame) -> DataFrame:
    """Plain sentences from the headline numbers."""
    return kpi_row.select(
        F.format_string(
            "%d alerts are open, %d of them critical, with %d rings. The network has %d outlets (%d active), %d members "
            "in %d regions and %d lifts in the latest month.",
            "alerts_open", "alerts_critical", "rings", "outlets", "active_outlets", "members", "regions",
            "lifts_latest_month",
        ).alias("summary")
    )


def data_status(tables: dict[str, tuple[DataFrame, str | None, str]]) -> DataFrame:
    """Rows, first and last day and origin of each table: name → (frame, timestamp column or None, origin)."""
    parts = []
    for name, (frame, ts, origin) in tables.items():
        day = F.to_date(ts) if ts else F.lit(None).cast("date")
        parts.append(
            frame.agg(
                F.count(F.lit(1)).alias("rows"), F.min(day).alias("first_day"), F.max(day).alias("last_day")
            ).withColumns({"name": F.lit(name), "origin": F.lit(origin)})
        )
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
