"""Card–outlet graph: edges, components, communities, ring scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from granary.functions.columns import bands_left_closed, half_even, percent_text
from granary.operators import modularity
from granary.session import cut, unsent

MIN_RING = 3
RING_BANDS = [(0.80, "Critical"), (0.65, "High")]
DAMPING = 0.85
LISTED = 20


def card_outlet_edges(lifts: DataFrame, min_weight: int = 1) -> DataFrame:
    """One row per card and outlet that share at least ``min_weight`` lifts."""
    return (
        lifts.where("card_id is not null and outlet_id is not null")
        .groupBy("card_id", "outlet_id")
        .agg(
            F.count(F.lit(1)).alias("weight"),
            half_even(F.sum(F.coalesce("quantity", F.lit(0.0))), 2).alias("quantity"),
            F.count_distinct(F.to_date("lift_ts")).alias("days"),
            F.count_if(~F.coalesce("verified", F.lit(True))).alias("unverified"),
        )
        .where(F.col("weight") >= min_weight)
    )


def _ends(edges: DataFrame) -> DataFrame:
    return edges.select(F.concat(F.lit("c:"), "card_id").alias("a"), F.concat(F.lit("s:"), "outlet_id").alias("b"), "weight")


def connected_components(pairs: DataFrame) -> DataFrame:
    """Smallest vertex of the component for every vertex of the edges (a, b).

    Alternates two steps: link the larger neighbours of a vertex to its smallest neighbour, then link
    the smaller ones. Edges shrink to stars in a number of rounds logarithmic in the graph size; the two steps
    change nothing only when all components are stars.
    """
    edges = cut(pairs.select("a", "b").where("a <> b").distinct())

    def checksum(df: DataFrame):
        return df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()

    def large_star(e: DataFrame) -> DataFrame:
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
        return both.join(unsent(least), "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))

    def small_star(e: DataFrame) -> DataFrame:
        down = e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = down.groupBy("a").agg(F.min("b").alias("m"))
        rest = down.join(unsent(least), "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        return rest.unionByName(least.select("a", F.col("m").alias("b")))

    before = checksum(edges)
    while True:
        # Both steps drop duplicates and self-links on the way.
        edges = cut(small_star(large_star(edges).where("a <> b").distinct()).where("a <> b").distinct())
        after = checksum(edges)
        if after == before:
            break
        before = after
    stars = edges.select(F.col("a").alias("vertex"), F.col("b").alias("component"))
    roots = edges.select(F.col("b").alias("vertex"), F.col("b").alias("component")).distinct()
    return stars.unionByName(roots)


def graph_components(edges: DataFrame) -> DataFrame:
    return connected_components(_ends(edges)).withColumnRenamed("component", "community")


def graph_communities(edges: DataFrame, passes: int = 1) -> DataFrame:
    """Communities of high modularity among cards and outlets."""
    return modularity.communities(_ends(edges), passes)


def label_communities(edges: DataFrame) -> DataFrame:
    """Communities by weighted label propagation.

    Outlets and cards vote in turn, which avoids the flip-flop of bipartite graphs. The label with
    most weight wins, the smallest label on ties. That cannot go in circles: a vote never lowers the weight of the
    edges whose ends agree, and where it leaves it as it is, labels only become smaller.
    """
    ends = cut(_ends(edges))

    def vote(labels: DataFrame, voter: str, target: str) -> DataFrame:
        tally = (
            ends.join(labels.withColumnRenamed("vertex", voter), voter)
            .groupBy(target, "label")
            .agg(F.sum("weight").alias("votes"))
        )
        return tally.groupBy(target).agg(F.min(F.struct((-F.col("votes")).alias("v"), "label")).alias("best")).select(
            F.col(target).alias("vertex"), F.col("best.label").alias("label")
        )

    cards = cut(ends.select(F.col("a").alias("vertex"), F.col("a").alias("label")).distinct())
    while True:
        outlets = cut(vote(cards, "a", "b"))
        fresh = cut(vote(outlets, "b", "a"))
        changed = fresh.join(cards.withColumnRenamed("label", "old"), "vertex").where("label <> old").limit(1).count()
        cards = fresh
        if not changed:
            break
    return cards.unionByName(outlets).withColumnRenamed("label", "community")


def _inner_edges(edges: DataFrame, communities: DataFrame) -> DataFrame:
    """Edges with both ends in one community."""
    left = communities.select(F.col("vertex").alias("a"), "community")
    right = communities.select(F.col("vertex").alias("b"), F.col("community").alias("other"))
    named = edges.withColumns({"a": F.concat(F.lit("c:"), "card_id"), "b": F.concat(F.lit("s:"), "outlet_id")})
    return named.join(left, "a").join(right, "b").where("community = other").drop("other")


def community_rank(inner: DataFrame, tolerance: float = 1e-12, max_rounds: int = 200, cut_every: int = 10) -> DataFrame:
    """Weighted PageRank inside every community at once (no edge leaves a community), to convergence.

    Chebyshev steps: with undirected edges the transition matrix has real eigenvalues within -1..1, so
    the error falls by the factor 0.56 a round instead of 0.85. Stops when no rank moves by more
    than ``tolerance``.
    """
    both = inner.select(F.col("a").alias("src"), F.col("b").alias("dst"), "community", "weight").unionByName(
        inner.select(F.col("b").alias("src"), F.col("a").alias("dst"), "community", "weight")
    )
    strength = both.groupBy("src").agg(F.sum("weight").alias("strength"))
    vertices = both.select("community", "src").distinct()
    size = vertices.groupBy("community").agg(F.count(F.lit(1)).alias("n"))
    # A vertex is linked with itself at weight 0, so the grouping that sums the inflow also hands on its own ranks and size.
    own = vertices.join(size, "community")
    itself = own.select("src", F.col("src").alias("dst"), F.lit(0.0).alias("p"), "n")
    pull = both.join(strength, "src").select("src", "dst", (F.col("weight") / F.col("strength")).alias("p"), F.lit(None).cast("long").alias("n"))
    links = cut(pull.unionByName(itself))
    # Grouped by the vertex alone, the ranks of a round lie where the join of the next one needs them.
    rank = own.select(F.col("src").alias("vertex"), (F.lit(1.0) / F.col("n")).alias("rank"), F.lit(0.0).alias("before"))
    omega = 1.0
    for i in range(1, max_rounds + 1):
        itself = F.col("src") == F.col("dst")
        plain = DAMPING * F.col("inflow") + (1 - DAMPING) / F.col("n")
        rank = (
            links.join(rank.withColumnRenamed("vertex", "src"), "src")
            .groupBy(F.col("dst").alias("vertex"))
            .agg(
                F.sum(F.col("rank") * F.col("p")).alias("inflow"),
                F.max("n").alias("n"),
                F.max(F.when(itself, F.col("rank"))).alias("last"),
                F.max(F.when(itself, F.col("before"))).alias("before"),
            )
            .select("vertex", (omega * (plain - F.col("before")) + F.col("before")).alias("rank"), F.col("last").alias("before"))
        )
        omega = 2 / (2 - DAMPING**2) if i == 1 else 1 / (1 - DAMPING**2 * omega / 4)
        if i % cut_every == 0:
            rank = cut(rank)
            moved = rank.agg(F.max(F.abs(F.col("rank") - F.col("before")))).first()[0]
            if moved is None or moved <= tolerance:
                named = vertices.select(F.col("src").alias("vertex"), "community")
                return named.join(rank, "vertex").select("vertex", "community", "rank")
    raise RuntimeError(f"ranks did not settle in {max_rounds} rounds")


def ring_scores(edges: DataFrame, communities: DataFrame, min_size: int = MIN_RING) -> DataFrame:
    """Score 0..1 of each community with at least ``min_size`` vertices, with its parts and its hub."""
    big = communities.groupBy("community").agg(F.count(F.lit(1)).alias("size")).where(F.col("size") >= min_size)
    members = cut(communities.join(big.select("community"), "community"))
    inner = cut(_inner_edges(edges, members))
    kinds = members.groupBy("community").agg(
        F.count_if(F.col("vertex").startswith("c:")).alias("n_cards"),
        F.count_if(F.col("vertex").startswith("s:")).alias("n_outlets"),
    )
    shared = (
        inner.groupBy("community", "card_id")
        .agg(F.count(F.lit(1)).alias("outlets"))
        .groupBy("community")
        .agg(F.count_if(F.col("outlets") > 1).alias("multi_cards"))
    )
    sums = inner.groupBy("community").agg(
        F.count(F.lit(1)).alias("n_edges"), F.sum("weight").alias("total"), F.sum("unverified").alias("unverified")
    )
    hubs = (
        community_rank(inner)
        .groupBy("community")
        .agg(F.min(F.struct((-half_even("rank", 9)).alias("r"), "vertex")).alias("hub"))
        .select("community", (-F.col("hub.r")).alias("hub_rank"), F.col("hub.vertex").alias("hub"))
    )
    out = kinds.join(sums, "community").join(shared, "community").join(hubs, "community")
    out = out.withColumns(
        {
            "multi_share": F.col("multi_cards") / F.col("n_cards"),
            "unverified_share": F.col("unverified") / F.greatest(F.col("total"), F.lit(1)),
            "density": F.col("n_edges") / (F.col("n_cards") * F.col("n_outlets")),
            "mean_weight": F.col("total") / F.col("n_edges"),
            "hub_score": F.least(F.col("hub_rank") * F.col("n_cards"), F.lit(1.0)),
        }
    )
    score = (
        "0.30D * multi_share + 0.25D * unverified_share + 0.20D * density"
        " + 0.15D * least(mean_weight / 10D, 1D) + 0.10D * hub_score"
    )
    return out.withColumn("score", half_even(F.expr(f"least({score}, 1D)"), 4)).where("score > 0")


def ring_alerts(scores: DataFrame, communities: DataFrame) -> DataFrame:
    """Ring findings for the alert union. Id lists show the first twenty, counts are complete."""
    kind = F.when(F.col("vertex").startswith("c:"), "cards").otherwise("outlets")
    order = Window.partitionBy("community", "kind").orderBy("vertex")
    # The ranked filter keeps twenty rows per ring before they are collected.
    listed = (
        communities.withColumn("kind", kind)
        .withColumn("place", F.row_number().over(order))
        .where(F.col("place") <= LISTED)
        .groupBy("community")
        .agg(
            F.array_sort(F.collect_list(F.when(F.col("kind") == "cards", F.substr("vertex", F.lit(3))))).alias("cards"),
            F.array_sort(F.collect_list(F.when(F.col("kind") == "outlets", F.substr("vertex", F.lit(3))))).alias("outlets"),
        )
    )
    reasons = F.concat_ws(
        "; ",
        F.when(F.col("multi_share") > 0.3, F.concat(F.col("multi_cards").cast("string"), F.lit(" cards use several outlets"))),
        F.when(F.col("unverified_share") > 0.2, F.concat(percent_text("unverified_share"), F.lit(" of lifts are unverified"))),
        F.when(F.col("density") > 0.5, F.lit("nearly every card meets every outlet")),
        F.concat(F.lit("hub "), "hub"),
    )
    ring = F.struct(
        F.col("community").alias("ring_id"),
        "cards",
        "outlets",
        "n_cards",
        "n_outlets",
        "total",
        half_even("multi_share", 3).alias("multi_share"),
        half_even("unverified_share", 3).alias("unverified_share"),
        half_even("density", 3).alias("density"),
        F.when(F.col("hub").startswith("c:"), "card").otherwise("outlet").alias("hub_type"),
        F.substr("hub", F.lit(3)).alias("hub_id"),
    )
    return scores.join(listed, "community").select(
        F.element_at("outlets", 1).alias("outlet_id"),
        F.col("community").alias("group_key"),
        F.lit("coordinated_ring").alias("pattern"),
        bands_left_closed("score", RING_BANDS, "Medium").alias("severity"),
        "score",
        F.concat(F.lit("Ring of cards and outlets: "), reasons).alias("text"),
        F.lit("Audit the outlets and hold the cards").alias("action"),
        F.lit("rings").alias("model"),
        ring.alias("ring"),
    )


def graph_summary(edges: DataFrame, components: DataFrame) -> DataFrame:
    """Nodes, edges, density and number of components of the whole graph."""
    return (
        edges.agg(
            F.count(F.lit(1)).alias("edges"),
            F.count_distinct("card_id").alias("cards"),
            F.count_distinct("outlet_id").alias("outlets"),
        )
        .withColumn("nodes", F.col("cards") + F.col("outlets"))
        .withColumn("components", components.agg(F.count_distinct("community")).scalar())
        .withColumn("density", half_even(F.expr("2D * edges / (cast(nodes as double) * (nodes - 1))"), 4))
    )
