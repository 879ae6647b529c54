"""Deterministic outlet rules. All rules are evaluated in one pass over the features."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.functions.columns import bands_left_closed, half_even, percent_text

# Default thresholds; pass keyword arguments to override.
DEFAULTS = {
    "ceiling": 35.0,
    "phantom_rate": 1.05,
    "ghost_rate": 0.05,
    "ghost_min_cards": 100,
    "low_rate": 0.40,
    "low_min_cards": 50,
    "spike_factor": 2.0,
    "spike_floor": 0.1,
    "absent_share": 0.95,
}

SCORE_BANDS = [(0.85, "Critical"), (0.70, "High"), (0.50, "Medium")]


def severity_of(score: Column | str) -> Column:
    return bands_left_closed(score, SCORE_BANDS, "Low")


def _config(overrides: dict) -> dict:
    unknown = set(overrides) - set(DEFAULTS)
    if unknown:
        raise ValueError(f"unknown rule settings: {sorted(unknown)}")
    return {**DEFAULTS, **overrides}


def _finding(pattern: str, severity: str, score: Column, text: Column, action: str) -> Column:
    return F.struct(
        F.lit(pattern).alias("pattern"),
        F.lit(severity).alias("severity"),
        score.cast("double").alias("score"),
        text.alias("text"),
        F.lit(action).alias("action"),
    )


def rule_columns(**overrides) -> dict[str, Column]:
    """Rule name → struct column, null where the rule does not fire.

    Needs the columns of ``with_baseline``; the first five need only the plain features.
    """
    cfg = _config(overrides)
    rate, cards = F.col("collection_rate"), F.col("total_cards")
    staple, grain, fuel = F.col("staple_per_card"), F.col("grain_per_card"), F.col("fuel_per_card")
    outlet, region = F.col("outlet_id"), F.col("region")
    over = (staple - cfg["ceiling"]) / F.lit(float(cfg["ceiling"]))
    p95, p90 = F.col("staple_per_card_p95"), F.col("fuel_per_card_p90")
    spike = fuel / p90
    text = F.concat
    rules = {
        "phantom_transactions": (
            rate > cfg["phantom_rate"],
            "Critical",
            F.least(F.lit(1.0), F.lit(0.90) + (rate - cfg["phantom_rate"]) * 0.50),
            text(F.lit("Outlet "), outlet, F.lit(" reports "), percent_text(rate), F.lit(" as many lifts as cards")),
            "Suspend the outlet and audit its device",
        ),
        "entitlement_breach": (
            staple > cfg["ceiling"],
            "Critical",
            F.least(F.lit(1.0), F.lit(0.85) + over * 0.15),
            text(F.lit("Outlet "), outlet, F.lit(" is "), percent_text(over), F.lit(" above the limit per card")),
            "Compare with warehouse dispatch records",
        ),
        "ghost_distribution": (
            (rate < cfg["ghost_rate"]) & (cards >= cfg["ghost_min_cards"]),
            "High",
            F.lit(0.80),
            text(F.lit("Outlet "), outlet, F.lit(" served "), percent_text(rate), F.lit(" of its cards")),
            "Visit the outlet within two days",
        ),
        "low_collection": (
            (rate >= cfg["ghost_rate"]) & (rate < cfg["low_rate"]) & (cards >= cfg["low_min_cards"]),
            "Medium",
            half_even(F.lit(0.55) + (F.lit(cfg["low_rate"]) - rate) * 0.30, 3),
            text(F.lit("Outlet "), outlet, F.lit(" collects for only "), percent_text(rate), F.lit(" of its cards")),
            "Inform members and check access",
        ),
        "no_distribution": (
            F.col("staple_total") == 0,
            "Low",
            F.lit(0.35),
            text(F.lit("Outlet "), outlet, F.lit(" handed out no staple for "), cards.cast("string"), F.lit(" cards")),
            "Check whether the outlet is open",
        ),
        "above_region_p95": (
            (staple > p95) & (staple <= cfg["ceiling"]),
            "High",
            F.lit(0.72),
            text(F.lit("Outlet "), outlet, F.lit(" is above the 95th percentile of "), region),
            "Check the member list",
        ),
        "off_region_item": (
            (F.col("grain_zero_share") > cfg["absent_share"]) & (grain > 0),
            "Medium",
            F.lit(0.60),
            text(F.lit("Outlet "), outlet, F.lit(" hands out an item that "), region, F.lit(" does not get")),
            "Check the item allocation list",
        ),
        "fuel_spike": (
            (p90 >= cfg["spike_floor"]) & (fuel > p90 * cfg["spike_factor"]),
            "Medium",
            F.least(F.lit(0.75), F.lit(0.55) + (spike - cfg["spike_factor"]) * 0.10),
            text(F.lit("Outlet "), outlet, F.lit(" gives far more fuel per card than its peers in "), region),
            "Audit the fuel stock",
        ),
    }
    return {
        name: F.when(condition, _finding(name, severity, score, message, action))
        for name, (condition, severity, score, message, action) in rules.items()
    }


BASELINE_RULES = ("above_region_p95", "off_region_item", "fuel_spike")


def apply_rules(features: DataFrame, only: list[str] | None = None, **overrides) -> DataFrame:
    """One row per outlet and rule that fires. One scan, whatever the number of rules."""
    rules = rule_columns(**overrides)
    chosen = [rules[name] for name in (only or rules)]
    return (
        features.select("outlet_id", "region", F.explode(F.array_compact(F.array(*chosen))).alias("hit"))
        .select("outlet_id", "region", "hit.*")
        .withColumn("model", F.lit("rules"))
    )


def region_allowed(outlets_with_grain: DataFrame, share: float = DEFAULTS["absent_share"]) -> DataFrame:
    """Regions that effectively do not receive the grain item."""
    return (
        outlets_with_grain.where(F.col("region").isNotNull())
        .groupBy("region")
        .agg(F.avg((F.col("grain_per_card") == 0).cast("double")).alias("zero_share"))
        .where(F.col("zero_share") > share)
    )


def quick_score(reports: DataFrame, ceiling: float = 35.0, phantom_rate: float = 1.05, flag_at: float = 0.6) -> DataFrame:
    """Stateless score of single outlet reports, usable on a batch or a stream.

    ``model_score`` (0..1), when present, is an isolation-forest score and competes with the rules.
    """
    staple = F.coalesce(F.col("staple_per_card"), F.lit(0.0))
    rate = F.coalesce(F.col("collection_rate"), F.lit(0.5))
    rule_score = F.when(
        staple > ceiling, F.least(F.lit(1.0), F.lit(0.85) + (staple - ceiling) / F.lit(float(ceiling)))
    ).when(rate > phantom_rate, F.least(F.lit(1.0), F.lit(0.90) + (rate - phantom_rate) * 0.5))
    rule = F.when(staple > ceiling, "entitlement_breach").when(rate > phantom_rate, "phantom_transactions")
    model = F.col("model_score") if "model_score" in reports.columns else F.lit(0.0)
    best = F.greatest(F.coalesce(rule_score, F.lit(0.0)), F.coalesce(model, F.lit(0.0)))
    return reports.withColumns(
        {
            "rule": rule,
            "score": half_even(best, 3),
            "severity": severity_of(best),
            "is_flagged": best >= flag_at,
        }
    )
