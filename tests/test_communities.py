"""Communities of high modularity against plain greedy merging, on hubs, and the rings on them."""

from __future__ import annotations

import collections

import numpy as np
import pytest

from granary.operators import graph, modularity


def plain_modularity(weights, labels):
    k = weights.sum(axis=1)
    total = k.sum()
    out = 0.0
    for c in set(labels):
        own = [i for i, x in enumerate(labels) if x == c]
        out += weights[np.ix_(own, own)].sum() / total - (k[own].sum() / total) ** 2
    return out


def plain_greedy(weights):
    """Always the merger that gains most, one at a time."""
    share = weights / weights.sum()
    k = share.sum(axis=1)
    alive, members = list(range(len(weights))), {i: [i] for i in range(len(weights))}
    while True:
        gain = share - np.outer(k, k)
        np.fill_diagonal(gain, -1)
        inside = gain[np.ix_(alive, alive)]
        i, j = (alive[x] for x in divmod(int(inside.argmax()), len(alive)))
        if gain[i, j] <= 1e-15:
            break
        share[i] += share[j]
        share[:, i] += share[:, j]
        k[i] += k[j]
        alive.remove(j)
        members[i] += members.pop(j)
    return [next(c for c, own in members.items() if v in own) for v in range(len(weights))]


def planted(rng, n, groups):
    own = rng.integers(0, groups, n)
    return (rng.random((n, n)) < np.where(own[:, None] == own, 0.3, 0.03)) * 1


def bipartite(rng, n):
    out = np.zeros((n, n), dtype=int)
    out[: n // 2, n // 2 :] = (rng.random((n // 2, n - n // 2)) < 5 / n) * rng.integers(1, 5, (n // 2, n - n // 2))
    return out


def found(spark, weights, **options):
    rows = [(f"v{i:03d}", f"v{j:03d}", int(weights[i, j])) for i in range(len(weights)) for j in range(i) if weights[i, j]]
    pairs = spark.createDataFrame(rows, "a string, b string, weight long").repartition(3)
    got = {r.vertex: r.community for r in modularity.communities(pairs, **options).collect()}
    assert all(c == min(v for v, x in got.items() if x == c) for c in set(got.values()))
    return [got.get(f"v{i:03d}", f"v{i:03d}") for i in range(len(weights))]


@pytest.mark.parametrize("kind", ["planted", "bipartite"])
def test_modularity_against_greedy(spark, kind):
    """Above one-by-one merging where groups are planted, and within half a percent of it on sparse two-sided graphs."""
    rng = np.random.default_rng(2)
    weights = planted(rng, 120, 5) if kind == "planted" else bipartite(rng, 150)
    weights = np.triu(weights, 1)
    weights = (weights + weights.T).astype(float)
    share = 1.0 if kind == "planted" else 0.995
    assert plain_modularity(weights, found(spark, weights)) >= share * plain_modularity(weights, plain_greedy(weights))


def test_reported_modularity(spark):
    links = [("a", "b", 2), ("b", "c", 1), ("c", "d", 3)]
    both = spark.createDataFrame(links + [(b, a, w) for a, b, w in links], "a string, b string, w long")
    labels = spark.createDataFrame([("a", "x"), ("b", "x"), ("c", "y"), ("d", "y")], "v string, c string")
    weights = np.array([[0, 2, 0, 0], [2, 0, 1, 0], [0, 1, 0, 3], [0, 0, 3, 0]], dtype=float)
    assert abs(modularity.modularity(both, labels) - plain_modularity(weights, "xxyy")) < 1e-12


def test_hubs_take_their_neighbours_in_few_rounds(spark, monkeypatch):
    """Two stars of 2,000 leaves with a link between their centres."""
    stored, rounds = modularity.stored, collections.Counter()

    def counted(df, name):
        rounds[name] += 1
        return stored(df, name)

    monkeypatch.setattr(modularity, "stored", counted)
    rows = [(f"hub{h}", f"leaf{h}-{i}", 1) for h in range(2) for i in range(2000)] + [("hub0", "hub1", 1), ("x", "x", 5), ("x", "hub0", 0)]
    got = modularity.communities(spark.createDataFrame(rows, "a string, b string, weight long")).groupBy("community").count().collect()
    assert sorted((r.community, r["count"]) for r in got) == [("hub0", 2001), ("hub1", 2001)]
    assert sum(rounds.values()) < 40


def test_no_pairs(spark):
    assert modularity.communities(spark.createDataFrame([], "a string, b string, weight long")).count() == 0


def test_rings_of_two_linked_groups(spark):
    """One component, two communities, two rings with counts that loops give."""
    rows = [(f"c{g}{i}", f"s{g}{j}", 3) for g in range(2) for i in range(4) for j in range(3)] + [("c00", "s10", 1)]
    edges = spark.createDataFrame([(c, s, w, float(w), 1, 1) for c, s, w in rows], "card_id string, outlet_id string, weight long, quantity double, days long, unverified long")
    parts = graph.graph_communities(edges)
    assert graph.graph_components(edges).select("community").distinct().count() == 1
    rings = graph.ring_scores(edges, parts).collect()
    assert sorted((r.n_cards, r.n_outlets, r.n_edges, r.total, r.multi_share, r.density) for r in rings) == [(4, 3, 12, 36, 1.0, 1.0)] * 2
    members = {r.vertex: r.community for r in parts.collect()}
    assert {v[2] for v, c in members.items() if c == members["c:c00"]} == {"c", "s"} and members["c:c00"] != members["s:s10"]


def test_rounds_on_few_vertices_hardly_shuffle(spark, monkeypatch):
    plans, keep = [], modularity.stored

    def spy(df, name):
        if name == "roots":
            plans.append(df._jdf.queryExecution().executedPlan().toString())
        return keep(df, name)

    monkeypatch.setattr(modularity, "stored", spy)
    rows = [(f"v{i:02d}", f"v{j:02d}", 1 + (i * j) % 3) for i in range(9) for j in range(i) if i % 3 == j % 3 or (i + j) % 9 == 0]
    modularity.communities(spark.createDataFrame(rows, "a string, b string, weight long"), passes=0).collect()
    # Only the join with the strengths of the merged communities.
    assert len(plans) > 1 and all(p.count("Exchange hashpartitioning") <= 2 for p in plans)


def test_ranks_shuffle_once_a_round(spark, monkeypatch):
    plans, keep = [], graph.cut

    def spy(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return keep(df)

    monkeypatch.setattr(graph, "cut", spy)
    rows = [("a", "b", "x", 1), ("a", "c", "x", 2), ("c", "d", "x", 1), ("e", "f", "y", 3)]
    ranks = graph.community_rank(spark.createDataFrame(rows, "a string, b string, community string, weight long"), cut_every=5)
    total = {}
    for r in ranks.collect():
        total[r.community] = total.get(r.community, 0.0) + r.rank
    assert {c: round(x, 9) for c, x in total.items()} == {"x": 1.0, "y": 1.0}
    # Five rounds: the ranks that come in, one grouping a round, and the links, which Spark shuffles once and reads again.
    assert len(plans) > 2 and all(p.count("Exchange hashpartitioning") <= 1 + 5 + 5 for p in plans[2:])
