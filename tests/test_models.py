"""Forest, ranks and communities against planted structure and plain versions."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from granary.operators import forecast, forest, graph
from granary.plans import inputs, jobs
from granary.sources import fixtures
from granary.streaming import reports
from tests.parity import DATA


def test_planted_outliers_score_highest(spark):
    rng = np.random.default_rng(0)
    rows = [(f"o{i}", *map(float, rng.normal(size=3))) for i in range(3000)] + [(f"x{i}", 9.0 + i, -9.0, 9.0) for i in range(8)]
    df = spark.createDataFrame(rows, "outlet_id string, a double, b double, c double")
    model = forest.train(df, "outlet_id", ["a", "b", "c"], n_trees=60)
    scores = {r.outlet_id: r.forest_score for r in forest.training_scores(model, "outlet_id").collect()}
    assert len(scores) == len(rows) and min(scores.values()) == 0.0 and max(scores.values()) > 0.99
    assert {k for k, _ in sorted(scores.items(), key=lambda e: -e[1])[:8]} == {f"x{i}" for i in range(8)}
    again = {r.outlet_id: r.forest_score for r in forest.score(model, df, "outlet_id").collect()}
    assert all(abs(again[k] - scores[k]) < 1e-12 for k in scores)
    assert forest.train(df.limit(5), "outlet_id", ["a", "b", "c"]) is None


def edges(spark, pairs):
    return spark.createDataFrame(
        [(c, s, w, float(w), 1, 0) for c, s, w in pairs], "card_id string, outlet_id string, weight long, quantity double, days long, unverified long"
    )


def test_ranks_against_the_linear_system(spark):
    rng = np.random.default_rng(1)
    pairs = {(f"{rng.integers(30)}", f"{rng.integers(8)}"): int(rng.integers(1, 9)) for _ in range(90)}
    table = edges(spark, [(c, s, w) for (c, s), w in pairs.items()])
    parts = graph.graph_components(table)
    got = {r.vertex: r for r in graph.community_rank(graph._inner_edges(table, parts)).collect()}
    names = sorted(got)
    place = {v: i for i, v in enumerate(names)}
    w = np.zeros((len(names), len(names)))
    for (c, s), x in pairs.items():
        w[place[f"c:{c}"], place[f"s:{s}"]] = w[place[f"s:{s}"], place[f"c:{c}"]] = x
    size = {k: sum(r.community == k for r in got.values()) for k in {r.community for r in got.values()}}
    start = np.array([1 / size[got[v].community] for v in names])
    want = np.linalg.solve(np.eye(len(names)) - graph.DAMPING * (w / w.sum(axis=1, keepdims=True)).T, (1 - graph.DAMPING) * start)
    assert np.abs(want - [got[v].rank for v in names]).max() < 1e-11


def test_communities_settle_on_separate_groups(spark):
    pairs = [(f"{g}-{c}", f"{g}-{s}", 3) for g in range(4) for c in range(5) for s in range(3)] + [("0-0", "1-0", 1)]
    found = {r.vertex: r.community for r in graph.label_communities(edges(spark, pairs)).collect()}
    groups = {g: {v for k, v in found.items() if k[2] == str(g)} for g in range(4)}
    assert all(len(v) == 1 for v in groups.values()) and len(set.union(*groups.values())) == 4


def test_flags_are_counted_past_a_hundred(spark, tmp_path):
    rows = [(f"a{i:04d}", i) for i in range(250)]
    df = spark.createDataFrame(rows, "alert_id string, s int").selectExpr(
        "'1' as outlet_id", "alert_id", "timestamp_seconds(1700000000 + s * 60) as detected_at"
    )
    for k in range(5):
        df.where(f"cast(substr(alert_id, 2) as int) div 50 = {k}").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = reports.file_stream(spark, f"{tmp_path}/in", df.schema, files_per_trigger=1)
    reports.drain(
        reports.repeat_flags(stream).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/c")
    )
    out = spark.read.parquet(f"{tmp_path}/out").orderBy("alert_id").collect()
    assert [r.earlier_flags for r in out] == list(range(250))


def test_all_members_of_rings_and_clusters_are_given(spark, monkeypatch):
    d = f"{DATA}/sf0.001"
    features = inputs.features(spark, d)
    monkeypatch.setattr(graph, "LISTED", 1)
    found, members = jobs.detect_with_members(features, fixtures.lifts(spark, d), "2024-06-01")
    rings = {r.community: set() for r in members["ring_members"].collect()}
    for r in members["ring_members"].collect():
        rings[r.community].add(r.vertex)
    alerts = [r.ring for r in found.where("pattern = 'coordinated_ring'").select("ring").collect()]
    assert alerts and {a.ring_id: a.n_cards + a.n_outlets for a in alerts} == {k: len(v) for k, v in rings.items()}
    sizes = {r.cluster: r["count"] for r in members["cluster_members"].groupBy("cluster").count().collect()}
    shown = {r.group_key: int(r.text.split()[0]) for r in found.where("pattern = 'similar_outlets'").collect()}
    assert shown == {k: n for k, n in sizes.items() if n >= 5}


def test_every_model_is_judged(spark):
    series = spark.createDataFrame([("1", "a"), ("2", "a")], "outlet_id string, item string")
    errors = spark.createDataFrame([("1", "a", "x", 0.1), ("1", "a", "y", 0.9), ("2", "a", "x", None)], "outlet_id string, item string, model string, mape double")
    got = sorted(map(tuple, forecast.retrain_list(series, errors, ["x", "y"]).collect()))
    assert got == [("1", "a", "y", "error too high"), ("2", "a", "x", "error too high"), ("2", "a", "y", "never fitted")]
