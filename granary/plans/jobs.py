"""The full pipeline: detection, forecasts, access and scores, one result table each per run date."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from granary.operators import alerts as al
from granary.operators import density, entitlement, forecast, forest, geo, graph, reports, rules, scoring, statistical
from granary.operators.features import with_baseline
from granary.operators.scaling import standard_scale
from granary.session import cut
from granary.sources import runs

CLUSTER_COLUMNS = ["staple_per_card", "collection_rate", "fuel_per_card"]


def detect_with_members(
    features: DataFrame,
    lifts: DataFrame,
    run_date: str,
    limits: dict | None = None,
    rule_limits: dict | None = None,
    min_edge_weight: int = 1,
    threshold: float = 0.6,
) -> tuple[DataFrame, dict[str, DataFrame]]:
    """Alerts of all five detectors in the canonical schema, de-duplicated; and all members of rings and clusters."""
    scored = cut(statistical.score_outlets(with_baseline(features)))
    parts = [statistical.detect(scored, **(limits or {})), rules.apply_rules(scored, **(rule_limits or {}))]
    model = forest.train(scored, "outlet_id")
    if model is not None:
        placed = scored.join(forest.training_scores(model, "outlet_id"), "outlet_id")
        parts.append(forest.findings(placed, threshold))
    groups = cut(density.cluster(standard_scale(features, CLUSTER_COLUMNS), "outlet_id", CLUSTER_COLUMNS))
    parts.append(density.cluster_findings(groups, features))
    edges = cut(graph.card_outlet_edges(lifts, min_edge_weight))
    communities = cut(graph.graph_communities(edges))
    rings = cut(graph.ring_scores(edges, communities))
    parts.append(graph.ring_alerts(rings, communities))
    members = {
        "ring_members": communities.join(rings.select("community"), "community", "left_semi").select("community", "vertex"),
        "cluster_members": groups.where("cluster is not null").select("cluster", "outlet_id"),
    }
    return al.union_alerts(parts, run_date), members


def detect_all(features: DataFrame, lifts: DataFrame, run_date: str, **detection) -> DataFrame:
    """The alerts of ``detect_with_members``."""
    return detect_with_members(features, lifts, run_date, **detection)[0]


def run_pipeline(
    outlets: DataFrame,
    members: DataFrame,
    lifts: DataFrame,
    features: DataFrame,
    card_counts: DataFrame | None,
    items: Sequence[str],
    run_date: str,
    folder: str,
    reach_km: float = geo.REACH_KM,
    merge_km: float = geo.MERGE_KM,
    staple: str | None = None,
    **detection,
) -> dict[str, str]:
    """Run everything and publish the result tables at once; a repeated run date replaces its own tables.

    ``features`` are the outlet features of the period. Returns table name → path; ``granary.sources.runs`` reads them.
    """
    spark = outlets.sparkSession
    features = cut(features)
    alerts, members_of = detect_with_members(features, lifts, run_date, **detection)
    alerts = cut(alerts)
    gaps = cut(entitlement.supply_gap(features, card_counts))
    distances = cut(geo.nearest_outlet(members, outlets))
    scored = cut(scoring.score_outlets(gaps, al.max_score(alerts)))
    with_cards = geo.utilisation(outlets, features)
    access = geo.access_summary(distances, reach_km)
    forecasts = cut(forecast.forecast_run(outlets, lifts, items))
    far = geo.access_gaps(distances, reach_km)
    tables = {
        "alerts": alerts,
        "alert_summary": al.alert_summary(alerts, features),
        "forecasts": forecasts,
        "risk_flags": forecast.risk_flags(forecasts, gaps, staple or items[0]),
        "supply_gaps": gaps.drop("breakdown"),
        "region_supply": entitlement.region_supply(gaps),
        "access": access,
        "access_gaps": geo.gap_list(far),
        "new_sites": geo.new_sites(far),
        "service_zones": geo.service_zones(outlets),
        "underused_outlets": geo.underused_outlets(with_cards, within_km=merge_km),
        "region_access": geo.region_accessibility(distances, reach_km),
        "load_equity": geo.load_equity(with_cards),
        "vulnerability": geo.vulnerability(with_cards, gaps, al.max_score(alerts)),
        "outlet_scores": scoring.rank_outlets(scored).drop("breakdown"),
        "region_scores": scoring.score_regions(scored, alerts),
        "kpis": reports.kpis(outlets, members, lifts, alerts, access),
        **members_of,
    }
    return runs.publish(spark, folder, run_date, tables)
