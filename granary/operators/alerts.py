"""Canonical alert rows: union of detector outputs, de-duplication, summaries, escalation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from granary.functions.columns import half_even, stable_id
from granary.functions.schemas import ALERT, RING
from granary.operators.rules import severity_of

# Order in which detectors win when two report the same outlet and pattern.
DETECTOR_ORDER = ("statistical", "rules", "isolation_forest", "clusters", "rings")


def _detector_rank() -> Column:
    ranks = F.create_map(*[F.lit(x) for i, name in enumerate(DETECTOR_ORDER) for x in (name, i)])
    return F.coalesce(ranks[F.col("model")], F.lit(len(DETECTOR_ORDER)))


def canonical(findings: DataFrame, run_date: str) -> DataFrame:
    """Any detector output → the alert schema; severity and text get defaults.

    ``group_key`` (a ring or cluster id) names findings that belong to no single outlet.
    """
    have = set(findings.columns)

    def known(name: str, kind: str = "string") -> Column:
        return F.col(name).cast(kind) if name in have else F.lit(None).cast(kind)

    score = F.coalesce(known("score", "double"), F.lit(0.5))
    pattern = F.coalesce(known("pattern"), F.lit("unknown"))
    group = known("group_key")
    ring = F.col("ring") if "ring" in have else F.lit(None).cast(RING)
    columns = {
        "alert_id": stable_id("outlet_id", pattern, group, F.lit(run_date)),
        "outlet_id": F.col("outlet_id"),
        "region": F.coalesce(known("region"), F.lit("")),
        "card_id": known("card_id"),
        "severity": F.coalesce(known("severity"), severity_of(score)),
        "pattern": pattern,
        "score": half_even(score, 3),
        "model": F.coalesce(known("model"), F.lit("ensemble")),
        "status": F.lit("open"),
        "text": F.coalesce(known("text"), F.lit("Unusual values")),
        "action": F.coalesce(known("action"), F.lit("Review by hand")),
        "group_key": group,
        "detected_at": F.lit(run_date).cast("date").cast("timestamp_ntz"),
        "ring": ring,
    }
    return findings.select(*[columns[f.name].alias(f.name) for f in ALERT.fields])


def deduplicate(alerts: DataFrame) -> DataFrame:
    """First alert per (outlet, pattern), detectors in order; rings and clusters by their own key."""
    key = Window.partitionBy("alert_id").orderBy(
        _detector_rank(), F.col("score").desc(), F.col("severity"), F.col("text")
    )
    return alerts.withColumn("__pick", F.row_number().over(key)).where("__pick = 1").drop("__pick")


def union_alerts(parts: Sequence[DataFrame], run_date: str) -> DataFrame:
    frames = [canonical(part, run_date) for part in parts]
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame)
    return deduplicate(out)


def alert_summary(alerts: DataFrame, features: DataFrame) -> DataFrame:
    """One row: counts by severity, alerts per outlet, number of rings."""

    def level(name: str) -> Column:
        return F.count_if(F.col("severity") == name).alias(name.lower())

    outlets = features.agg(F.count(F.lit(1)).alias("n")).scalar()
    return (
        alerts.agg(
            F.count(F.lit(1)).alias("total_alerts"),
            *[level(s) for s in ("Critical", "High", "Medium", "Low")],
            F.count_if(F.col("model") == "rings").alias("rings"),
        )
        .withColumn("outlets", outlets)
        .withColumn(
            "alert_rate", half_even(F.col("total_alerts") / F.greatest(F.col("outlets"), F.lit(1)).cast("double"), 3)
        )
    )


def max_score(alerts: DataFrame) -> DataFrame:
    """Highest alert score per outlet."""
    return alerts.where(F.col("outlet_id").isNotNull()).groupBy("outlet_id").agg(F.max("score").alias("alert_score"))


def alert_regions(alerts: DataFrame, outlets: DataFrame, prefer: str = "outlet") -> DataFrame:
    """Alerts with a display region from the outlet master or the alert itself, in either order."""
    master = outlets.select("outlet_id", F.col("region").alias("__master"))
    own = F.when(F.col("region") != "", F.col("region"))
    order = (F.col("__master"), own) if prefer == "outlet" else (own, F.col("__master"))
    return (
        alerts.join(master, "outlet_id", "left")
        .withColumn("shown_region", F.coalesce(*order, F.lit("Unknown")))
        .drop("__master")
    )


def escalate(alerts: DataFrame, history: DataFrame) -> DataFrame:
    """Critical alerts with the number of earlier flags of the outlet.

    ``history``: outlet_id, flagged_at. Only flags before the alert count.
    """
    critical = alerts.where(F.col("severity") == "Critical").select("alert_id", "outlet_id", "pattern", "detected_at")
    earlier = (
        critical.join(history.groupBy("outlet_id", "flagged_at").agg(F.count(F.lit(1)).alias("flags")), "outlet_id")
        .where(F.col("flagged_at") < F.col("detected_at"))
        .groupBy("alert_id")
        .agg(F.sum("flags").alias("earlier_flags"))
    )
    count = F.coalesce(F.col("earlier_flags"), F.lit(0).cast("bigint"))
    return critical.join(earlier, "alert_id", "left").select(
        "alert_id",
        "outlet_id",
        "pattern",
        count.alias("earlier_flags"),
        F.when(count > 0, "repeat").otherwise("first").alias("context"),
        F.when(count > 0, "Block the outlet and open a case").otherwise("Send a field officer").alias("escalation"),
    )


def filter_alerts(
    alerts: DataFrame, region: str | None = None, severity: str | None = None, outlet_id: str | None = None
) -> DataFrame:
    """Request filters, without regard to case."""
    out = alerts
    if region:
        out = out.where(F.lower("region") == region.lower())
    if severity:
        out = out.where(F.lower("severity") == severity.lower())
    if outlet_id:
        out = out.where(F.col("outlet_id") == outlet_id)
    return out
