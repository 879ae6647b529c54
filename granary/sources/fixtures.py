"""Domain tables derived from the TPC-H-like test tables (see FIXTURES.md, part B).

Customers play the outlets, suppliers the cards, orders the members, part types the items.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.session import unsent

# Roles of the items in the feature table.
ITEMS = {"staple": "ECONOMY", "grain": "PROMO", "sweet": "SMALL", "fuel": "STANDARD"}

# Wide column of each item, as a monthly file would have it.
WIDE_ITEMS = {
    "economy_kg": "ECONOMY",
    "promo_kg": "PROMO",
    "small_kg": "SMALL",
    "standard_kg": "STANDARD",
    "medium_kg": "MEDIUM",
    "large_kg": "LARGE",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def outlets(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("c_custkey")
    return (
        table(spark, sf_dir, "customer")
        .join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
        .select(
            key.cast("string").alias("outlet_id"),
            F.col("n_name").alias("region"),
            F.concat_ws(" ", "n_name", F.lit("outlet"), key.cast("string")).alias("outlet_name"),
            (F.col("c_acctbal") >= 0).alias("is_active"),
            (F.lit(16.0) + ((key * 6101) % 1000) / F.lit(250.0)).alias("latitude"),
            (F.lit(77.0) + ((key * 3571) % 997) / F.lit(249.25)).alias("longitude"),
        )
    )


def lifts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per lineitem. PROMO is an item most regions do not get: there its quantity is 0,
    but for a few stray rows.

    The tables that grow are never broadcast, and the regions are joined to the orders, which are fewer. The lineitems meet
    their orders last, so that the rows of a transaction lie together for whoever counts them."""
    sold_by = (
        table(spark, sf_dir, "orders")
        .join(unsent(table(spark, sf_dir, "customer")), F.col("o_custkey") == F.col("c_custkey"))
        .join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    )
    stray = (F.col("p_type") == "PROMO") & (F.col("n_nationkey") % 3 != 0) & (F.col("l_orderkey") % 97 != 0)
    return (
        table(spark, sf_dir, "lineitem")
        .join(unsent(table(spark, sf_dir, "part")), F.col("l_partkey") == F.col("p_partkey"))
        .join(unsent(sold_by), F.col("l_orderkey") == F.col("o_orderkey"))
        .select(
            F.col("o_custkey").cast("string").alias("outlet_id"),
            F.col("n_name").alias("region"),
            F.col("p_type").alias("item"),
            F.col("l_suppkey").cast("string").alias("card_id"),
            F.col("l_orderkey").alias("txn_id"),
            F.when(stray, 0.0).otherwise(F.col("l_quantity")).alias("quantity"),
            F.col("l_shipdate").alias("lift_ts"),
            (F.col("l_returnflag") != "R").alias("verified"),
        )
    )


def lifts_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outlet × month with one column per item."""
    month = F.trunc(F.to_date("lift_ts"), "month")
    sums = [
        F.sum(F.when(F.col("item") == item, F.col("quantity"))).alias(column) for column, item in WIDE_ITEMS.items()
    ]
    return (
        lifts(spark, sf_dir)
        .groupBy("outlet_id", F.year(month).alias("year"), F.month(month).alias("month"))
        .agg(*sums)
    )


def members(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("o_orderkey")
    return (
        table(spark, sf_dir, "orders")
        .join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
        .join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
        .select(
            key.cast("string").alias("member_id"),
            F.col("o_custkey").cast("string").alias("outlet_id"),
            F.col("n_name").alias("region"),
            (F.lit(1) + key % 6).cast("int").alias("members_count"),
            (F.lit(16.0) + ((key * 7919) % 1000) / F.lit(250.0)).alias("latitude"),
            (F.lit(77.0) + ((key * 104729) % 997) / F.lit(249.25)).alias("longitude"),
        )
    )


def card_mix(spark: SparkSession, sf_dir: str, totals: DataFrame) -> DataFrame:
    """Card counts by type per outlet; ``totals`` has outlet_id and total_cards."""
    aay = F.col("c_custkey") % 5
    return (
        table(spark, sf_dir, "customer")
        .select(F.col("c_custkey").cast("string").alias("outlet_id"), aay.alias("cards_aay"))
        .join(totals.select("outlet_id", "total_cards"), "outlet_id")
        .select(
            "outlet_id",
            "cards_aay",
            F.greatest(F.col("total_cards") - F.col("cards_aay"), F.lit(0).cast("bigint")).alias("cards_phh"),
        )
    )


def card_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Card-level lifts with a time of day."""
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("lift_id"),
        F.col("user_id").cast("string").alias("card_id"),
        F.get_json_object("props", "$.k").alias("outlet_id"),
        F.col("value").alias("quantity"),
        F.col("ts").alias("lift_ts"),
        F.col("event_type").alias("kind"),
        (F.col("event_type") != "error").alias("verified"),
    )
