"""Outlet features and region baselines: the table every detector and score reads."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.functions.columns import clip
from granary.functions.order_stats import quantiles
from granary.session import unsent

DEFAULT_ITEMS = {"staple": "rice", "grain": "wheat", "sweet": "sugar", "fuel": "kerosene"}
ENTITLEMENT_CEILING = 35.0
PROXY_PER_CARD = 5.0
Z_FACTOR = 0.6745
Z_FEATURES = {
    "staple_z": "staple_per_card",
    "rate_z": "collection_rate",
    "fuel_z": "fuel_per_card",
    "grain_z": "grain_per_card",
}
BASELINE_PROBS = {"q1": 0.25, "med": 0.5, "q3": 0.75, "p90": 0.9, "p95": 0.95}


def first_known(c: str) -> Column:
    """The earliest value that is not null; the smallest of those with the same time."""
    return F.min(F.when(F.col(c).isNotNull(), F.struct("lift_ts", c)))[c]


def outlet_features(
    lifts: DataFrame,
    outlets: DataFrame | None = None,
    card_counts: DataFrame | None = None,
    items: Mapping[str, str] = DEFAULT_ITEMS,
    cards: Column | None = None,
    transactions: Column | None = None,
    ceiling: float = ENTITLEMENT_CEILING,
    period: str | None = None,
) -> DataFrame:
    """One row per outlet (and period) from long lifts, in one aggregation.

    ``cards`` and ``transactions`` are aggregate expressions over the lifts. Without ``cards``
    the earliest known ``total_cards`` of the outlet counts, like its region; without ``transactions`` the
    collection rate is estimated from the staple quantity. ``outlets`` supplies the region
    (else it is taken from the lifts); ``card_counts`` adds cards_aay and cards_phh.
    """
    keys = ["outlet_id"] + ([period] if period else [])
    rows = lifts.where(F.col("outlet_id").isNotNull())
    if cards is None:
        cards = first_known("total_cards")
    quantity = F.coalesce(F.col("quantity"), F.lit(0.0))
    sums = [
        F.sum(F.when(F.col("item") == item, quantity).otherwise(0.0)).alias(f"{role}_total")
        for role, item in items.items()
    ]
    distinct_items = F.count_distinct(F.when(quantity > 0, F.col("item"))).alias("item_count")
    aggs = [*sums, distinct_items, cards.cast("bigint").alias("total_cards")]
    if transactions is not None:
        aggs.append(transactions.cast("bigint").alias("total_transactions"))
    if outlets is None:
        aggs.append((first_known("region") if "lift_ts" in lifts.columns else F.min("region")).alias("region"))
    out = rows.groupBy(*keys).agg(*aggs)
    if outlets is not None:
        out = out.join(unsent(outlets.select("outlet_id", "region")), "outlet_id", "left")

    held = F.greatest(F.coalesce(F.col("total_cards"), F.lit(0).cast("bigint")), F.lit(1).cast("bigint"))
    for role in items:
        out = out.withColumn(f"{role}_per_card", F.col(f"{role}_total") / held)
    if transactions is not None:
        rate = clip(F.col("total_transactions") / held, high=2.0)
    else:
        rate = clip(F.col("staple_per_card") / PROXY_PER_CARD, 0.0, 2.0)
    out = out.withColumns(
        {
            "basket_total": F.col("staple_total") + F.col("grain_total") + F.col("sweet_total"),
            "over_ratio": F.col("staple_per_card") / F.lit(float(ceiling)),
            "collection_rate": rate,
        }
    )
    if card_counts is not None:
        out = out.join(card_counts.select("outlet_id", "cards_aay", "cards_phh"), "outlet_id", "left")
    return out


def region_baseline(features: DataFrame) -> DataFrame:
    """Quantiles of the fraud signals per region and the share of outlets without the grain item."""
    values = features.select(
        "region", *[F.coalesce(F.col(c), F.lit(0.0)).alias(c) for c in Z_FEATURES.values()]
    )
    no_grain = (
        features.where(F.col("region").isNotNull())
        .groupBy("region")
        .agg(F.avg((F.col("grain_per_card") == 0).cast("double")).alias("grain_zero_share"))
    )
    return quantiles(values, ["region"], list(Z_FEATURES.values()), BASELINE_PROBS).join(no_grain, "region")


def robust_z(c: str) -> Column:
    """Distance from the region median in robust deviations; needs the baseline columns of ``c``."""
    return F.expr(f"{Z_FACTOR}D * (coalesce({c}, 0D) - {c}_med) / ({c}_q3 - {c}_q1 + 1e-8D)")


def with_baseline(features: DataFrame, baseline: DataFrame | None = None) -> DataFrame:
    """Features plus the baseline of their region and the robust z of each signal."""
    if baseline is None:
        baseline = region_baseline(features)
    joined = features.join(baseline, "region", "left")
    return joined.withColumns({z: robust_z(c) for z, c in Z_FEATURES.items()})


def tukey_share(features: DataFrame, value: str = "staple_per_card") -> DataFrame:
    """Share of rows outside q1 − 3·IQR .. q3 + 3·IQR, limited to 1 %..15 %."""
    rows = features.select(F.coalesce(F.col(value), F.lit(0.0)).alias("v"), F.lit("all").alias("scope"))
    fences = quantiles(rows, ["scope"], ["v"], {"q1": 0.25, "q3": 0.75})
    iqr = F.col("v_q3") - F.col("v_q1")
    outside = (F.col("v") < F.col("v_q1") - 3 * iqr) | (F.col("v") > F.col("v_q3") + 3 * iqr)
    return (
        rows.join(fences, "scope")
        .agg(F.count(F.lit(1)).alias("outlets"), F.sum(outside.cast("bigint")).alias("outliers"))
        .withColumn("share", clip(F.col("outliers") / F.greatest(F.col("outlets"), F.lit(1)), 0.01, 0.15))
    )
