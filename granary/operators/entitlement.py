"""Demand from entitlements: what an outlet needs for the cards it serves."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.functions.columns import half_even

# Monthly entitlement rates. AAY per card; PHH staple and sweet per person, fuel per card.
AAY_PER_CARD = {"staple": 35.0, "sweet": 1.0, "fuel": 3.0}
PHH_PER_PERSON = {"staple": 5.0, "sweet": 0.5}
PHH_PER_CARD = {"fuel": 3.0}
HOUSEHOLD_SIZE = 3.4
TURNOUT = 0.88

# Share of AAY cards when the card types are unknown.
AAY_SHARE = 0.10


def expected_demand(df: DataFrame, household_size: float = HOUSEHOLD_SIZE, turnout: float = TURNOUT) -> DataFrame:
    """Monthly demand from cards_aay and cards_phh, in total and after the usual absence."""
    aay, persons = "coalesce(cards_aay, 0)", f"coalesce(cards_phh, 0) * {household_size}D"
    staple_aay, staple_phh = f"{aay} * {AAY_PER_CARD['staple']}D", f"{persons} * {PHH_PER_PERSON['staple']}D"
    sweet_aay, sweet_phh = f"{aay} * {AAY_PER_CARD['sweet']}D", f"{persons} * {PHH_PER_PERSON['sweet']}D"
    fuel = f"{aay} * {AAY_PER_CARD['fuel']}D + coalesce(cards_phh, 0) * {PHH_PER_CARD['fuel']}D"

    def tenth(text: str):
        return half_even(F.expr(text), 1)

    return df.withColumns(
        {
            "expected_staple": tenth(f"{staple_aay} + {staple_phh}"),
            "expected_staple_adjusted": tenth(f"({staple_aay} + {staple_phh}) * {turnout}D"),
            "expected_sweet": tenth(f"{sweet_aay} + {sweet_phh}"),
            "expected_fuel": tenth(fuel),
            "breakdown": F.struct(
                tenth(staple_aay).alias("staple_aay"),
                tenth(staple_phh).alias("staple_phh"),
                tenth(sweet_aay).alias("sweet_aay"),
                tenth(sweet_phh).alias("sweet_phh"),
            ),
        }
    )


def with_card_types(features: DataFrame, card_counts: DataFrame | None = None) -> DataFrame:
    """Attach cards_aay and cards_phh; without counts assume the usual mix."""
    if card_counts is not None:
        # One row per outlet, or the join would multiply outlets.
        single = card_counts.groupBy("outlet_id").agg(F.max("cards_aay").alias("cards_aay"), F.max("cards_phh").alias("cards_phh"))
        return features.join(single, "outlet_id", "left")
    if "cards_aay" in features.columns:
        return features
    return features.withColumns(
        {
            "cards_aay": F.expr(f"cast(rint(total_cards * {AAY_SHARE}D) as bigint)"),
            "cards_phh": F.expr(f"cast(rint(total_cards * {1 - AAY_SHARE}D) as bigint)"),
        }
    )


def supply_gap(features: DataFrame, card_counts: DataFrame | None = None) -> DataFrame:
    """Expected minus distributed staple, in kg and per cent, with a status."""
    out = expected_demand(with_card_types(features, card_counts))
    out = out.withColumn("gap_kg", half_even(F.expr("expected_staple - staple_total"), 1))
    out = out.withColumn("gap_pct", half_even(F.expr("gap_kg / greatest(expected_staple, 1D) * 100D"), 1))
    status = (
        "case when gap_pct > 80 then 'critically_under_supplied' when gap_pct > 20 then 'under_supplied' "
        "when gap_pct < -10 then 'over_supplied' else 'normal' end"
    )
    return out.withColumn("supply_status", F.expr(status))


def region_supply(gaps: DataFrame) -> DataFrame:
    sums = ["staple_total", "expected_staple", "gap_kg", "fuel_total", "expected_fuel", "total_cards", "cards_aay", "cards_phh"]
    return (
        gaps.where("region is not null")
        .groupBy("region")
        .agg(F.count(F.lit(1)).alias("outlets"), *[F.sum(c).alias(c) for c in sums])
        .withColumn("gap_pct", half_even(F.expr("gap_kg / greatest(expected_staple, 1D) * 100D"), 1))
    )


def supply_totals(gaps: DataFrame) -> DataFrame:
    return gaps.agg(
        F.expr("count(1) as outlets"),
        F.expr("count_if(supply_status = 'under_supplied') as under_supplied"),
        F.expr("count_if(supply_status = 'over_supplied') as over_supplied"),
        F.expr("count_if(supply_status = 'critically_under_supplied') as critically_under"),
        half_even(F.sum("expected_staple"), 1).alias("expected_staple"),
        half_even(F.sum("staple_total"), 1).alias("staple_total"),
    )


def project(demand: DataFrame, months: int = 3) -> DataFrame:
    """Constant monthly demand for the next months with an absence and an over-draw bound."""
    return demand.select(
        "outlet_id",
        F.explode(F.sequence(F.lit(1), F.lit(months))).alias("month_offset"),
        F.col("expected_staple").alias("predicted"),
        half_even(F.expr("expected_staple * 0.85D"), 1).alias("lower"),
        half_even(F.expr("expected_staple * 1.02D"), 1).alias("upper"),
        F.lit("entitlement").alias("model"),
    )


def over_capacity(gaps: DataFrame, tolerance: float = 1.05) -> DataFrame:
    """Outlets that distributed more than their cards can legally draw."""
    return gaps.where(F.col("staple_total") > F.col("expected_staple") * tolerance)
