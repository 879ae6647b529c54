"""Region-baseline anomaly scores and hard rules on outlet features."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.functions.columns import bands_left_closed, clip, half_even, percent_text

# Weights of the composite score; they sum to 1.
WEIGHTS = {"staple_z": 0.35, "rate_z": 0.25, "fuel_z": 0.10, "grain_z": 0.10}
OVER_WEIGHT = 0.20
Z_CAP = 6.0
SEVERITY_BANDS = [(0.55, "Critical"), (0.38, "High"), (0.22, "Medium")]

ACTIONS = {
    "Critical": "Stop distribution and escalate",
    "High": "Field check within two days",
    "Medium": "Review records next cycle",
    "Low": "Watch for two months",
}


def composite_score() -> Column:
    """0..1 from the capped |z| of four signals and the excess over the entitlement ceiling."""
    total = sum(WEIGHTS.values()) + OVER_WEIGHT
    parts = F.lit(OVER_WEIGHT) * clip(F.col("over_ratio") - 1.0, low=0.0) * 3.0
    for z, weight in WEIGHTS.items():
        parts = parts + F.lit(weight) * clip(F.abs(F.col(z)), high=Z_CAP)
    return clip(parts / F.lit(Z_CAP * total), 0.0, 1.0)


def severity(bands: Sequence[tuple[float, str]] = SEVERITY_BANDS) -> Column:
    return bands_left_closed("anomaly_score", bands, "Low")


def likely_pattern() -> Column:
    return (
        F.when(F.col("over_ratio") > 1.2, "entitlement_breach")
        .when(F.col("collection_rate") < 0.30, "ghost_distribution")
        .when(F.abs("staple_z") > F.abs("rate_z"), "skimming")
        .otherwise("low_collection")
    )


def action_for(level: Column | str) -> Column:
    lookup = F.create_map(*[F.lit(x) for pair in ACTIONS.items() for x in pair])
    return F.coalesce(lookup[F.col(level) if isinstance(level, str) else level], F.lit("Review by hand"))


def explanation() -> Column:
    reasons = F.concat_ws(
        "; ",
        F.when(
            F.abs("staple_z") > 2.0,
            F.concat(F.lit("staple per card is off the region median, z "), F.rint("staple_z").cast("bigint").cast("string")),
        ),
        F.when(
            F.abs("rate_z") > 2.0,
            F.concat(F.lit("collection rate "), percent_text("collection_rate"), F.lit(" is off the region norm")),
        ),
    )
    return F.concat(
        F.lit("Outlet "),
        F.col("outlet_id"),
        F.lit(": "),
        F.when(reasons != "", reasons).otherwise("several signals differ a little"),
    )


def score_outlets(features: DataFrame) -> DataFrame:
    """Adds anomaly_score; needs the columns of ``with_baseline``."""
    return features.withColumn("anomaly_score", composite_score())


def _finding(pattern: Column, level: Column, score: Column, text: Column) -> Column:
    return F.struct(
        pattern.alias("pattern"),
        level.alias("severity"),
        score.alias("score"),
        text.alias("text"),
        action_for(level).alias("action"),
    )


def hard_finding(
    ceiling: float = 35.0, phantom_rate: float = 1.05, ghost_rate: float = 0.05, ghost_min_cards: int = 100
) -> Column:
    """The first physical limit the outlet passes, null when there is none."""
    rate, staple = F.col("collection_rate"), F.col("staple_per_card")
    cards = F.greatest(F.col("total_cards"), F.lit(1).cast("bigint"))
    over = (staple - ceiling) / F.lit(float(ceiling))

    def finding(pattern: str, level: str, score: Column) -> Column:
        text = F.concat(F.lit("Outlet "), "outlet_id", F.lit(f": physical limit passed, {pattern}"))
        return _finding(F.lit(pattern), F.lit(level), score, text)

    return (
        F.when(
            rate > phantom_rate,
            finding("phantom_transactions", "Critical", F.least(F.lit(1.0), F.lit(0.88) + (rate - phantom_rate) * 0.5)),
        )
        .when((rate < ghost_rate) & (cards >= ghost_min_cards), finding("ghost_distribution", "High", F.lit(0.82)))
        .when(
            staple > ceiling,
            finding("entitlement_breach", "Critical", F.least(F.lit(1.0), F.lit(0.85) + over * 0.10)),
        )
    )


def statistical_finding(
    min_score: float = 0.20, bands: Sequence[tuple[float, str]] = SEVERITY_BANDS
) -> Column:
    """Notable composite score; needs anomaly_score."""
    level = severity(bands)
    notable = (F.col("anomaly_score") >= min_score) & (level != "Low")
    return F.when(notable, _finding(likely_pattern(), level, half_even("anomaly_score", 3), explanation()))


def _rows(features: DataFrame, finding: Column) -> DataFrame:
    return features.select("outlet_id", "region", F.inline(F.array_compact(F.array(finding)))).withColumn(
        "model", F.lit("statistical")
    )


def hard_rules(features: DataFrame, **limits) -> DataFrame:
    """At most one physical-limit finding per outlet; the first rule that matches wins."""
    return _rows(features, hard_finding(**limits))


def statistical_alerts(
    scored: DataFrame, min_score: float = 0.20, bands: Sequence[tuple[float, str]] = SEVERITY_BANDS, **limits
) -> DataFrame:
    """Outlets with a notable composite score that no hard rule names already."""
    free = F.when(hard_finding(**limits).isNull(), statistical_finding(min_score, bands))
    return _rows(scored, free)


def detect(
    scored: DataFrame, min_score: float = 0.20, bands: Sequence[tuple[float, str]] = SEVERITY_BANDS, **limits
) -> DataFrame:
    """Hard-rule findings, else statistical ones: one pass, no join, at most one row per outlet."""
    return _rows(scored, F.coalesce(hard_finding(**limits), statistical_finding(min_score, bands)))
