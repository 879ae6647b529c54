"""Card-level rules on single lifts (card_id, outlet_id, lift_ts, quantity, verified)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_MONTH = "trunc(to_date(lift_ts), 'month')"


def _known(lifts: DataFrame) -> DataFrame:
    return lifts.where("card_id is not null and outlet_id is not null and lift_ts is not null")


def several_outlets_in_month(lifts: DataFrame) -> DataFrame:
    """Cards seen at two or more outlets in one calendar month."""
    return (
        _known(lifts)
        .groupBy("card_id", F.expr(_MONTH).alias("month"))
        .agg(F.count_distinct("outlet_id").alias("outlets"))
        .where("outlets > 1")
        .selectExpr("*", "'duplicate_use' as pattern", "'High' as severity", "0.85D as score")
    )


def after_hours(lifts: DataFrame, opens: int = 8, closes: int = 20, minimum: int = 5) -> DataFrame:
    """Outlets with several lifts outside opening hours."""
    return (
        _known(lifts)
        .where(f"hour(lift_ts) < {opens} or hour(lift_ts) >= {closes}")
        .groupBy("outlet_id")
        .agg(F.count(F.lit(1)).alias("lifts"))
        .where(F.col("lifts") >= minimum)
        .selectExpr("*", "'after_hours' as pattern", "'Medium' as severity", "0.65D as score")
    )


def month_end_bulk(lifts: DataFrame, share: float = 0.40) -> DataFrame:
    """Outlet months with most lifts on the last active day. Days are counted first, so months stay small."""
    days = (
        _known(lifts)
        .groupBy("outlet_id", F.expr("to_date(lift_ts)").alias("day"))
        .agg(F.count(F.lit(1)).alias("lifts"))
    )
    return (
        days.groupBy("outlet_id", F.trunc("day", "month").alias("month"))
        .agg(
            F.max("day").alias("last_day"),
            F.max_by("lifts", "day").alias("last_day_lifts"),
            F.sum("lifts").alias("lifts"),
        )
        .withColumn("share", F.expr("last_day_lifts / cast(lifts as double)"))
        .where(F.col("share") > share)
        .selectExpr("*", "'month_end_bulk' as pattern", "'High' as severity", "0.75D as score")
    )


def low_verification(lifts: DataFrame, share: float = 0.80, critical: float = 0.50, minimum: int = 10) -> DataFrame:
    """Outlets that verify too few of their lifts."""
    return (
        _known(lifts)
        .groupBy("outlet_id")
        .agg(F.count(F.lit(1)).alias("lifts"), F.expr("avg(cast(coalesce(verified, true) as int)) as verified_share"))
        .where((F.col("lifts") >= minimum) & (F.col("verified_share") < share))
        .selectExpr(
            "*",
            "'low_verification' as pattern",
            f"case when verified_share < {critical}D then 'Critical' else 'High' end as severity",
            "1D - verified_share as score",
        )
    )


def many_outlets(lifts: DataFrame, limit: int = 2) -> DataFrame:
    """Cards seen at more than ``limit`` outlets at all."""
    return (
        _known(lifts)
        .groupBy("card_id")
        .agg(F.count_distinct("outlet_id").alias("outlets"))
        .where(F.col("outlets") > limit)
        .selectExpr(
            "*",
            "'card_at_many_outlets' as pattern",
            "'Critical' as severity",
            f"least(1D, 0.70D + 0.25D * (outlets - {limit})) as score",
        )
    )


def lift_features(lifts: DataFrame) -> DataFrame:
    """Features of each lift: time, load of the outlet that day, distance from the outlet's monthly mean.

    Aggregates are joined back instead of windows over raw rows: a busy outlet is then no single task.
    """
    rows = _known(lifts).selectExpr("*", "to_date(lift_ts) as day", f"{_MONTH} as month")
    daily = rows.groupBy("outlet_id", "day").agg(
        F.count_distinct("card_id").alias("cards_same_day"), F.sum("quantity").alias("outlet_day_volume")
    )
    monthly = rows.groupBy("outlet_id", "month").agg(F.avg("quantity").alias("outlet_month_mean"))
    return (
        rows.join(daily, ["outlet_id", "day"])
        .join(monthly, ["outlet_id", "month"])
        .select(
            "lift_id",
            "outlet_id",
            "card_id",
            "quantity",
            F.hour("lift_ts").alias("hour"),
            F.dayofmonth("lift_ts").alias("day_of_month"),
            "cards_same_day",
            "outlet_day_volume",
            F.abs(F.col("quantity") - F.col("outlet_month_mean")).alias("deviation"),
            F.expr("cast(not coalesce(verified, true) as int) as unverified"),
        )
    )
