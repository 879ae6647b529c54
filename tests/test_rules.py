"""Rules, baselines and de-duplication on small hand-made frames."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from granary.operators import alerts, features, rules, scoring, statistical


def make(spark, rows):
    """Feature rows: (outlet, region, staple per card, rate, cards)."""
    return spark.createDataFrame(
        [(o, r, float(s), float(c), int(n)) for o, r, s, c, n in rows],
        "outlet_id string, region string, staple_per_card double, collection_rate double, total_cards bigint",
    ).selectExpr(
        "*",
        "staple_per_card * total_cards as staple_total",
        "0D as grain_per_card",
        "0D as fuel_per_card",
        "staple_per_card / 35D as over_ratio",
        "3L as item_count",
        "0D as sweet_per_card",
    )


def fired(df):
    return {(r.outlet_id, r.pattern): r.score for r in df.collect()}


@pytest.fixture(scope="module")
def frame(spark):
    rows = [
        ("at_phantom", "A", 10, 1.05, 200),
        ("over_phantom", "A", 10, 1.06, 200),
        ("at_ghost", "A", 10, 0.05, 100),
        ("ghost", "A", 10, 0.049, 100),
        ("small_ghost", "A", 10, 0.049, 99),
        ("at_low", "B", 10, 0.40, 50),
        ("low", "B", 10, 0.39, 50),
        ("small_low", "B", 10, 0.39, 49),
        ("at_ceiling", "B", 35, 0.9, 100),
        ("breach", "B", 42, 0.9, 100),
        ("none", "B", 0, 0.9, 100),
    ]
    return features.with_baseline(make(spark, rows))


def test_thresholds(frame):
    hits = fired(rules.apply_rules(frame))
    assert ("over_phantom", "phantom_transactions") in hits
    assert ("at_phantom", "phantom_transactions") not in hits
    assert {o for o, p in hits if p == "ghost_distribution"} == {"ghost"}
    assert {o for o, p in hits if p == "low_collection"} == {"at_ghost", "low"}
    assert {o for o, p in hits if p == "entitlement_breach"} == {"breach"}
    assert {o for o, p in hits if p == "no_distribution"} == {"none"}
    assert hits[("breach", "entitlement_breach")] == pytest.approx(0.85 + 0.2 * 0.15)
    assert hits[("over_phantom", "phantom_transactions")] == pytest.approx(0.90 + 0.01 * 0.5)


def test_unknown_setting(frame):
    with pytest.raises(ValueError):
        rules.apply_rules(frame, no_such_limit=1)


def test_hard_rule_wins_over_statistics(frame):
    found = statistical.detect(statistical.score_outlets(frame), min_score=0.0, bands=[(0.0, "Medium")])
    rows = {r.outlet_id: r.pattern for r in found.collect()}
    assert rows["over_phantom"] == "phantom_transactions"
    assert found.groupBy("outlet_id").count().where("count > 1").isEmpty()


def test_score_range_and_shift_invariance(spark):
    base = [(f"o{i}", "A", 5 + (i * 7) % 11, 0.3 + (i % 5) / 10, 100) for i in range(30)]
    one = features.with_baseline(make(spark, base))
    scores = statistical.score_outlets(one).select("outlet_id", "anomaly_score", "staple_z")
    low, high = scores.agg(F.min("anomaly_score"), F.max("anomaly_score")).first()
    assert 0 <= low <= high <= 1
    moved = features.with_baseline(make(spark, [(o, r, s + 3, c, n) for o, r, s, c, n in base]))
    a = {r.outlet_id: r.staple_z for r in scores.collect()}
    b = {r.outlet_id: r.staple_z for r in moved.select("outlet_id", "staple_z").collect()}
    assert all(a[k] == pytest.approx(b[k], abs=1e-6) for k in a)


def test_single_outlet_region_and_no_spread(spark):
    df = features.with_baseline(make(spark, [("x", "Lone", 10, 0.5, 10), ("y", None, 10, 0.5, 10)]))
    rows = {r.outlet_id: r for r in df.collect()}
    assert rows["x"].staple_z == 0.0
    assert rows["y"].staple_z is None


def test_deduplication_is_idempotent_and_prefers_first_detector(spark):
    rows = spark.createDataFrame(
        [("o1", "R", "p", 0.9, "rules"), ("o1", "R", "p", 0.5, "statistical"), ("o1", "R", "q", 0.4, "rules")],
        "outlet_id string, region string, pattern string, score double, model string",
    )
    once = alerts.union_alerts([rows], "2024-01-01")
    kept = {(r.pattern, r.model, r.severity) for r in once.collect()}
    assert kept == {("p", "statistical", "Medium"), ("q", "rules", "Low")}
    assert alerts.deduplicate(once).count() == 2


def test_zero_cards_and_unknown_quantity(spark):
    lifts = spark.createDataFrame(
        [("o1", "R", "rice", None, 0, 0), ("o2", "R", "rice", 70.0, 2, 1), (None, "R", "rice", 1.0, 1, 1)],
        "outlet_id string, region string, item string, quantity double, total_cards int, total_transactions int",
    ).withColumn("lift_ts", F.lit("2024-01-01").cast("timestamp_ntz"))
    out = {r.outlet_id: r for r in features.outlet_features(lifts, transactions=F.max("total_transactions")).collect()}
    assert set(out) == {"o1", "o2"}
    assert out["o1"].staple_per_card == 0.0 and out["o1"].item_count == 0
    assert out["o2"].staple_per_card == 35.0 and out["o2"].collection_rate == 0.5


def test_bands_are_right_closed(spark):
    df = spark.createDataFrame([(30.0,), (30.1,), (100.0,)], "total_score double")
    from granary.functions.columns import bands_right_closed

    got = [r[0] for r in df.select(bands_right_closed("total_score", *scoring.OUTLET_BANDS)).collect()]
    assert got == ["Critical", "Below Average", "Exemplary"]


def test_half_even(spark):
    from granary.functions.columns import half_even

    row = spark.range(1).select(half_even(F.lit(2.5)), half_even(F.lit(3.5)), half_even(F.lit(0.125), 2)).first()
    assert list(row) == [2.0, 4.0, 0.12]
