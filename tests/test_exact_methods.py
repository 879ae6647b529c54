"""Distributed algorithms against brute force."""

from __future__ import annotations

import datetime as dt
import itertools
import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from granary.functions.nearest import Pyramid, distinct_points
from granary.functions.order_stats import gini, quantiles, rank_descending, running_total
from granary.operators import density, forecast, forest, geo, graph, planning
from granary.plans.catalog import QUERIES


def km(a, b):
    la, lo, lb, lp = (math.radians(v) for v in (*a, *b))
    h = math.sin((lb - la) / 2) ** 2 + math.cos(la) * math.cos(lb) * math.sin((lp - lo) / 2) ** 2
    return 2 * 6371 * math.asin(min(1, math.sqrt(h)))


def test_quantiles_match_pandas(spark):
    rng = np.random.default_rng(1)
    # One group holds most rows, with ties, zeros and negative values.
    groups = np.where(rng.random(3000) < 0.7, "big", "small")
    values = np.round(rng.normal(0, 5, 3000), 1)
    pdf = pd.DataFrame({"g": groups, "v": values})
    pdf.loc[::50, "v"] = np.nan
    got = quantiles(spark.createDataFrame(pdf), ["g"], ["v"], {"p10": 0.1, "med": 0.5, "p95": 0.95}).toPandas().set_index("g")
    want = pdf.groupby("g")["v"].quantile([0.1, 0.5, 0.95]).unstack()
    assert np.allclose(got.loc[want.index, ["v_p10", "v_med", "v_p95"]].to_numpy(), want.to_numpy())


def test_rank_and_gini(spark):
    pdf = pd.DataFrame({"g": ["a"] * 6 + ["b"] * 2, "v": [5.0, 1, 1, 3, 5, 0, 2, 2]})
    df = spark.createDataFrame(pdf)
    ranked = rank_descending(df, ["g"], "v", "r").toPandas().sort_values(["g", "v"])
    want = pdf.assign(r=pdf.groupby("g")["v"].rank(ascending=False, method="min")).sort_values(["g", "v"])
    assert ranked["r"].tolist() == want["r"].astype(int).tolist()
    result = {r.g: r.gini for r in gini(df, ["g"], "v").collect()}
    v = np.sort(pdf[pdf.g == "a"].v.to_numpy())
    i = np.arange(1, len(v) + 1)
    assert result["a"] == pytest.approx((2 * (i * v).sum() - (len(v) + 1) * v.sum()) / (len(v) * v.sum()))
    assert result["b"] == pytest.approx(0.0)


def test_running_total(spark):
    pdf = pd.DataFrame({"g": ["a"] * 50, "o": [float(i % 7) - 3 for i in range(50)], "id": [f"{i:02d}" for i in range(50)], "x": range(50)})
    got = running_total(spark.createDataFrame(pdf), ["g"], "o", "id", "x", "s").toPandas().sort_values(["o", "id"])
    assert got["s"].tolist() == pdf.sort_values(["o", "id"])["x"].cumsum().tolist()


@pytest.mark.parametrize("exclude_self", [False, True])
def test_nearest_equals_all_pairs(spark, exclude_self):
    rng = random.Random(3)
    # A dense town, two remote points, and a desert between them.
    town = [(17 + rng.random() / 500, 78 + rng.random() / 500) for _ in range(400)]
    targets = list(dict.fromkeys(town + [(16.1, 77.2), (19.9, 80.9)]))
    queries = targets if exclude_self else [(15 + 6 * rng.random(), 76 + 6 * rng.random()) for _ in range(150)]
    points = spark.createDataFrame([(a, o, str(i)) for i, (a, o) in enumerate(targets)], "lat double, lon double, target string")
    asked = spark.createDataFrame([(a, o, exclude_self) for a, o in queries], "qlat double, qlon double, mine boolean")
    got = {(r.qlat, r.qlon): r.km for r in Pyramid(points).nearest(asked).collect()}
    for q in queries:
        want = min(km(q, t) for t in targets if not exclude_self or t != q)
        assert got[q] == pytest.approx(want, abs=1e-6)


def test_no_active_outlet_and_unknown_place(spark):
    outlets = spark.createDataFrame([("o", False, 17.0, 78.0)], "outlet_id string, is_active boolean, latitude double, longitude double")
    members = spark.createDataFrame([("m", 17.0, 78.0), ("n", None, None)], "member_id string, latitude double, longitude double")
    assert [r.distance_km for r in geo.nearest_outlet(members, outlets).collect()] == [float("inf")] * 2
    active = outlets.withColumn("is_active", F.lit(True))
    found = {r.member_id: r.distance_km for r in geo.nearest_outlet(members, active).collect()}
    assert found == {"m": 0.0, "n": None}


def brute_dbscan(points, eps, least):
    n = len(points)
    near = [[j for j in range(n) if math.dist(points[i], points[j]) <= eps] for i in range(n)]
    core = {i for i in range(n) if len(near[i]) >= least}
    label = {}
    for start in sorted(core):
        if start in label:
            continue
        stack = [start]
        while stack:
            i = stack.pop()
            if i in label:
                continue
            label[i] = start
            stack.extend(j for j in near[i] if j in core)
    for i in range(n):
        if i not in core:
            options = [label[j] for j in near[i] if j in core]
            label[i] = min(options) if options else None
    return label, core


@pytest.mark.parametrize("seed", [1, 2])
def test_density_clusters_equal_brute_force(spark, seed):
    rng = np.random.default_rng(seed)
    blobs = np.concatenate([rng.normal(c, 0.25, (60, 2)) for c in ((0, 0), (1.4, 0), (5, 5))] + [rng.uniform(-3, 8, (40, 2))])
    label, core = brute_dbscan([tuple(p) for p in blobs], 0.4, 5)
    df = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(blobs)], "id int, a double, b double")
    got = {r.id: (r.cluster, r.is_core) for r in density.cluster(df, "id", ["a", "b"], 0.4, 5).collect()}
    assert {i: c for i, (c, _) in got.items()} == label
    assert {i for i, (_, k) in got.items() if k} == core


def test_components_equal_union_find(spark):
    rng = random.Random(5)
    # A hub with many leaves, a long chain and random pairs.
    pairs = [("hub", f"leaf{i}") for i in range(60)] + [(f"n{i:03d}", f"n{i + 1:03d}") for i in range(40)]
    pairs += [(f"r{rng.randrange(40)}", f"r{rng.randrange(40)}") for _ in range(25)]
    parent: dict[str, str] = {}

    def find(v):
        parent.setdefault(v, v)
        while parent[v] != v:
            v = parent[v]
        return v

    for a, b in pairs:
        if a != b:
            x, y = sorted((find(a), find(b)))
            parent[y] = x
    want = {v: find(v) for v in parent}
    smallest: dict[str, str] = {}
    for v, root in want.items():
        smallest[root] = min(smallest.get(root, v), v)
    got = {r.vertex: r.component for r in graph.connected_components(spark.createDataFrame(pairs, "a string, b string")).collect()}
    assert got == {v: smallest[r] for v, r in want.items()}


def test_thin_points_meet_few_parts_of_a_dense_cell(spark, monkeypatch):
    """100,000 points in one cell, and points around it that see much, little or nothing of it."""
    rng = np.random.default_rng(6)
    side = 0.4 / math.sqrt(2) * (1 - 1e-9)
    dense = rng.uniform(0.01, 0.27, (100_000, 2))
    thin = np.array([[0.3, 0.14], [0.45, 0.14], [0.6, 0.2], [0.66, 0.27], [0.14, -0.39], [-0.2, -0.2], [2.0, 2.0]])
    x = np.vstack([dense, thin])
    assert len({tuple(v) for v in np.floor(dense / side)}) == 1
    df = spark.createDataFrame(pd.DataFrame({"id": np.arange(len(x)), "a": x[:, 0], "b": x[:, 1]}))
    cut, most = density.cut, []

    def watched(frame):
        out = cut(frame)
        if "inside" in out.columns:
            most.append(out.groupBy("p_id").count().agg(F.max("count")).first()[0] or 0)
        return out

    monkeypatch.setattr(density, "cut", watched)
    got = {r.id: (r.cluster, r.is_core) for r in density.cluster(df, "id", ["a", "b"], 0.4, 5).where("id >= 100000").collect()}
    near = (np.linalg.norm(thin[:, None] - x[None], axis=2) <= 0.4).sum(axis=1)
    core = near >= 5
    touches = [any(np.linalg.norm(t - y) <= 0.4 for y in np.vstack([dense, thin[core]])) for t in thin]
    assert got == {100_000 + i: (0 if touches[i] else None, bool(core[i])) for i in range(len(thin))}
    assert core.any() and not core.all() and max(most) <= 64


def test_planted_ring_is_found(spark):
    rows = [(f"c{i}", f"s{j}") for i in range(3) for j in range(2)] * 3 + [("lone", "s9")]
    lifts = spark.createDataFrame([(c, s, 1.0, False) for c, s in rows] + [(None, "s1", 1.0, True)], "card_id string, outlet_id string, quantity double, verified boolean")
    lifts = lifts.withColumn("lift_ts", F.lit("2024-01-01").cast("timestamp_ntz"))
    edges = graph.card_outlet_edges(lifts)
    for communities in (graph.graph_components(edges), graph.label_communities(edges)):
        rings = graph.ring_scores(edges, communities).collect()
        assert [(r.n_cards, r.n_outlets, r.density, r.unverified_share) for r in rings] == [(3, 2, 1.0, 1.0)]
        alert = graph.ring_alerts(graph.ring_scores(edges, communities), communities).first()
        assert alert.ring.cards == ["c0", "c1", "c2"] and alert.outlet_id == "s0"


def plan_rows(spark, areas, supply, budget=10_000.0):
    plan = spark.createDataFrame(
        [("s", 0, f"a{i}", float(inv), float(d), float(sd), float(p), float(c)) for i, (inv, d, sd, p, c) in enumerate(areas)],
        "scenario string, period int, area string, inventory double, demand_mean double, demand_std double, risk double, unit_cost double",
    )
    periods = spark.createDataFrame([("s", 0, float(supply), float(budget))], "scenario string, period int, supply double, budget double")
    return plan, periods


@pytest.mark.parametrize("supply", [0, 5, 9, 40])
def test_allocation_limits_and_optimum(spark, supply):
    areas = [(0, 4, 1, 0.1, 1.0), (2, 3, 0, 0.5, 2.0), (0, 5, 2, 0.3, 3.0), (9, 4, 1, 0.9, 1.5)]
    plan, periods = plan_rows(spark, areas, supply)
    rows = planning.allocate(plan, periods).collect()
    for policy in planning.POLICIES:
        mine = [r for r in rows if r.policy == policy]
        assert sum(r.x for r in mine) <= supply + 1e-6
        assert all(0 <= r.x <= 2 * max(r.demand_mean, 1) + 1e-9 for r in mine)
    # Brute force over whole numbers for the cost-optimal policy.
    cmax = max(a[4] for a in areas)

    def cost(xs):
        return sum(
            (0.25 * c / cmax + 0.25 * p) * x + 0.35 * max(0, d - inv - x) for x, (inv, d, _, p, c) in zip(xs, areas)
        )

    best = min(cost(xs) for xs in itertools.product(range(9), range(7), range(11), range(9)) if sum(xs) <= supply)
    got = [r.x for r in sorted((r for r in rows if r.policy == "optimized"), key=lambda r: r.area)]
    assert cost(got) == pytest.approx(best)


def test_inspections_keep_the_budget(spark):
    areas = [(0, 10, 1, 0.7, 1.0), (0, 10, 1, 0.5, 1.0), (0, 10, 1, 0.4, 1.0), (0, 10, 1, 0.1, 1.0)]
    plan, periods = plan_rows(spark, areas, 40, budget=10_000.0)
    rows = planning.allocate(plan, periods, ["proportional"]).collect()
    assert {r.area for r in rows if r.inspect} == {"a0", "a1"}


def test_seasonal_fit_recovers_a_planted_season(spark):
    months = pd.date_range("2019-01-01", periods=60, freq="MS")
    y = 100 + np.arange(60) * 0.5 + 20 * np.sin(2 * np.pi * (months.month - 1) / 12)
    regions = spark.createDataFrame(pd.DataFrame({"region": "R", "item": "rice", "month": months.date, "quantity": y}))
    calendar = forecast.holiday_days(forecast.fixed_holidays(regions))
    got = forecast.seasonal(regions, calendar, 3).orderBy("month_offset").toPandas()
    want = [100 + (60 + i) * 0.5 + 20 * np.sin(2 * np.pi * i / 12) for i in range(3)]
    assert np.allclose(got.predicted, want, rtol=0.05)
    assert (got.lower <= got.predicted).all() and (got.predicted <= got.upper).all()


def test_seasonal_fit_equals_a_plain_solve(spark):
    """Short, long and constant series, with holidays inside and after them."""
    rng = np.random.default_rng(3)
    months = pd.date_range("2020-01-01", periods=30, freq="MS")
    tables = [pd.DataFrame({"region": f"r{n}", "item": "x", "month": months[:n].date, "quantity": np.full(n, 7.0) if n == 5 else rng.uniform(50, 90, n)}) for n in (1, 2, 5, 12, 30)]
    regions = spark.createDataFrame(pd.concat(tables))
    calendar = forecast.holiday_days(forecast.fixed_holidays(regions))
    days = {r.month: r.holiday_days for r in calendar.collect()}
    got = {(r.region, r.month_offset): r for r in forecast.seasonal(regions, calendar, 3, ridge=0.01).collect()}

    def terms(index, start):
        angle = 2 * np.pi * (index % 12) / 12
        day = [days.get(dt.date(i // 12, i % 12 + 1, 1), 0) for i in index]
        return np.column_stack([np.ones(len(index)), (index - start) / 12, np.sin(angle), np.cos(angle), np.sin(2 * angle), np.cos(2 * angle), day])

    for table in tables:
        n, index = len(table), np.array([m.year * 12 + m.month - 1 for m in table.month])
        x, y = terms(index, index[0]), table.quantity.to_numpy()
        beta = np.linalg.solve(x.T @ x + 0.01 * n * np.diag([0.0] + [1.0] * 6), x.T @ y)
        spread = 1.645 * np.std(y - x @ beta)
        ahead = terms(index[-1] + np.arange(1, 4), index[0]) @ beta
        for k in range(3):
            r = got[table.region[0], k + 1]
            assert np.allclose([r.predicted, r.lower, r.upper], np.maximum([ahead[k], ahead[k] - spread, ahead[k] + spread], 0), rtol=1e-6, atol=1e-6)
            assert r.trend + r.season + r.holiday_effect == pytest.approx(ahead[k], abs=1e-6)


def test_movable_feasts_take_the_nearest_known_year(spark):
    months = spark.createDataFrame([(dt.date(2019, 5, 1),), (dt.date(2024, 1, 1),)], "month date")
    known = [("F", dt.date(2020, 2, 29)), ("G", dt.date(2020, 11, 14)), ("F", dt.date(2023, 3, 8)), ("F", dt.date(2023, 3, 8))]
    got = forecast.movable_holidays(months, spark.createDataFrame(known, "holiday string, day date"))
    want = [("G", dt.date(y, 11, 14)) for y in (2019, 2020, 2021)] + [("F", dt.date(2020, 2, 29))] + [("F", dt.date(y, 3, 8)) for y in (2022, 2023, 2024, 2025)]
    assert sorted(map(tuple, got.collect())) == sorted((h, d, 2, 1) for h, d in want)
    assert forecast.movable_holidays(months, spark.createDataFrame([], "holiday string, day date")).count() == 0


def test_forest_finds_planted_outliers(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(0, 1, (400, 3))
    x[:5] += 8
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)], "id int, a double, b double, c double")
    model = forest.train(df, "id", ["a", "b", "c"], n_trees=40)
    scores = forest.score(model, df, "id").toPandas().set_index("id").forest_score
    assert scores.between(0, 1).all()
    assert scores.loc[:4].min() > scores.loc[5:].quantile(0.95)
    # A single report is placed on the scale of the training rows.
    alone = forest.score(model, df.where("id = 200"), "id").first()
    assert alone.forest_score == pytest.approx(scores.loc[200])
    assert forest.train(df.limit(10), "id", ["a", "b", "c"]) is None


def test_cluster_joins_are_not_broadcast(spark, capsys):
    """Their tables grow with the points; the driver would build and hold each of them."""
    rows = [(i, float(i % 7) / 10, float(i % 5) / 10) for i in range(60)]
    points = spark.createDataFrame(rows, "id long, u double, v double")
    density.cluster(points, "id", ["u", "v"], 0.5, 5).explain()
    assert "Broadcast" not in capsys.readouterr().out


def test_shuffles_are_dealt_by_the_size_of_the_input(spark, tmp_path, monkeypatch):
    from granary import session

    spark.range(1000).write.parquet(f"{tmp_path}/t")
    df = spark.read.parquet(f"{tmp_path}/t")
    size = session.input_bytes(df)
    assert size == sum(f.stat().st_size for f in tmp_path.glob("t/*.parquet")) > 0
    monkeypatch.setattr(session, "INPUT_BYTES", -(-size // 9))
    count = "spark.sql.shuffle.partitions"
    before = spark.conf.get(count)
    with session.small_tasks(df):
        assert spark.conf.get(count) == "9"
        assert spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes") == str(session.TASK_BYTES)
    assert spark.conf.get(count) == before
    assert session.input_bytes(spark.range(3)) == 0


def test_frames_behind_subqueries_count_for_the_partitions(spark, tmp_path):
    from granary import session

    spark.range(1000).write.parquet(str(tmp_path / "big"))
    big = spark.read.parquet(str(tmp_path / "big"))
    row = spark.range(1).withColumn("n", big.agg(F.count(F.lit(1))).scalar())
    key = "spark.sql.shuffle.partitions"
    size = session.INPUT_BYTES
    try:
        session.INPUT_BYTES = 16
        with session.small_tasks(row, [big]):
            assert int(spark.conf.get(key)) >= session.input_bytes(big) // 16 > 64
    finally:
        session.INPUT_BYTES = size


@pytest.mark.parametrize("name", ["region_baseline", "reports_with_master", "forecast_error_monitor", "kpi_row", "kpi_row_with_access"])
def test_results_come_from_small_tasks(spark, name):
    """A join or grouping left to the caller runs with the session's number of partitions, however large the tables."""
    plan = QUERIES[name].plan(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert not any(step in plan for step in ("Join", "Aggregate", "Window", "subquery"))


def _write(spark, folder, name, rows, schema):
    spark.createDataFrame(rows, schema).write.parquet(f"{folder}/{name}.parquet")


def test_lifts_broadcast_nothing_that_grows(spark, tmp_path):
    """Orders, parts and customers grow with the lineitems; only the nations are few. Keys may repeat or be null."""
    from granary.sources import fixtures

    d = str(tmp_path)
    _write(spark, d, "nation", [(0, "N0"), (1, "N1")], "n_nationkey long, n_name string")
    _write(spark, d, "customer", [(1, 0, 1.0), (2, 1, 1.0), (2, 1, -1.0), (None, 0, 0.0)], "c_custkey long, c_nationkey long, c_acctbal double")
    _write(spark, d, "part", [(1, "ECONOMY"), (2, "PROMO"), (2, "SMALL"), (None, "LARGE")], "p_partkey long, p_type string")
    _write(spark, d, "orders", [(10, 1), (11, 2), (12, None), (None, 1)], "o_orderkey long, o_custkey long")
    when = dt.datetime(2000, 1, 2)
    lines = [(10, 1, 5, 2.0, when, "R"), (10, 2, 6, 3.0, when, "N"), (11, 2, 7, 4.0, when, "N"), (12, 1, 5, 1.0, when, "N"), (None, None, None, None, None, None)]
    _write(spark, d, "lineitem", lines, "l_orderkey long, l_partkey long, l_suppkey long, l_quantity double, l_shipdate timestamp, l_returnflag string")
    lifts = fixtures.lifts(spark, d)
    plan = lifts._jdf.queryExecution().executedPlan().toString()
    assert plan.count("BroadcastExchange") == 1 and plan.count("SortMergeJoin") == 3
    got = sorted(tuple(r) for r in lifts.select("outlet_id", "region", "item", "card_id", "txn_id", "quantity", "verified").collect())
    twice = [("2", "N1", "PROMO", "7", 11, 0.0, True), ("2", "N1", "SMALL", "7", 11, 4.0, True)]
    assert got == [
        ("1", "N0", "ECONOMY", "5", 10, 2.0, False), ("1", "N0", "PROMO", "6", 10, 3.0, True), ("1", "N0", "SMALL", "6", 10, 3.0, True),
        *[row for row in twice for _ in range(2)],
    ]


def test_underused_outlets_broadcast_no_outlets(spark):
    """Only the few upper cells of the pyramid are sent to all executors."""
    rng = random.Random(7)
    rows = [(str(i), "r", rng.uniform(10, 11), rng.uniform(70, 71), i % 3 > 0, rng.random(), 5) for i in range(300)]
    used = spark.createDataFrame(rows, "outlet_id string, region string, latitude double, longitude double, is_active boolean, utilisation double, total_cards long")
    found = geo.underused_outlets(used, within_km=6.0)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "strategy=merge" in plan
    physical = found._jdf.queryExecution().executedPlan().toString()
    # Levels 2 and 4 on the way down; all other joins are merged.
    assert physical.count("BroadcastHashJoin") <= 2
    active = [(r[0], r[2:4]) for r in rows if r[4]]
    want = {r[0]: min(km(r[2:4], p) for i, p in active if i != r[0]) for r in rows if r[5] < geo.LOW_USE}
    got = {r.outlet_id: r.nearest_km for r in found.collect()}
    assert got.keys() == {i for i, x in want.items() if x <= 6.0}
    assert all(abs(got[i] - want[i]) < 0.006 for i in got)
