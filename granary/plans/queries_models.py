"""Forest, density clusters, card–outlet graph and the full detection run."""

from __future__ import annotations

from pyspark.sql import functions as F

from granary.operators import alerts as al
from granary.operators import density as de
from granary.operators import forest as fo
from granary.operators import graph as gr
from granary.operators import rules as ru
from granary.operators import statistical as st
from granary.operators.scaling import standard_scale
from granary.plans import inputs
from granary.plans.memo import remembered
from granary.plans.queries_fraud import RULE_SETTINGS, RUN_DATE, STAT_LIMITS
from granary.plans.queries_reports import EVENTS
from granary.plans.registry import query
from granary.plans.sql import FEATURE_CTES, LIFTS, with_
from granary.plans.sql import half_even as r
from granary.sources import fixtures


def spread_labels(name: str, edges: str, rounds: int) -> str:
    """CTEs that pass the smallest label along the edges (a, b, both directions) for some rounds."""
    parts = [f"{name}0 as materialized (select a as v, a as l from {edges} union select b, b from {edges})"]
    for i in range(rounds):
        parts.append(
            f"{name}{i + 1} as materialized (select v, min(l) as l from (select v, l from {name}{i} union all "
            f"select e.b, x.l from {name}{i} x join {edges} e on e.a = x.v) group by 1)"
        )
    return ",\n".join(parts)


PURCHASES = """edges as (select card_id, outlet_id, count(*) as weight, round_even(sum(quantity) * 100, 0) / 100 as quantity,
    count(distinct cast(lift_ts as date)) as days, count(*) filter (not verified) as unverified
  from card_lifts where card_id is not null and outlet_id is not null group by 1, 2)"""
LINKS = """links as (select 'c:' || card_id as a, 's:' || outlet_id as b, weight from edges
  union all select 's:' || outlet_id, 'c:' || card_id, weight from edges)"""
ROUNDS = 40
COMPONENTS = spread_labels("lab", "links", ROUNDS)
GRAPH_CTES = (EVENTS, PURCHASES, LINKS, COMPONENTS)
#: Pairs that meet often: enough of them to split the graph of events into many components.
STRONG = 4
STRONG_CTES = (EVENTS, f"{PURCHASES[:-1]} having count(*) >= {STRONG})", LINKS, COMPONENTS)


@remembered
def edges(spark, d):
    return inputs.keep(gr.card_outlet_edges(fixtures.card_events(spark, d)))


@query(
    "card_outlet_edges",
    "D22",
    with_(LIFTS)
    + """select card_id, outlet_id, count(*) as weight, round_even(sum(quantity) * 100, 0) / 100 as quantity,
       count(distinct cast(lift_ts as date)) as days, count(*) filter (not verified) as unverified
      from lifts group by 1, 2""",
)
def q_edges(spark, d):
    return gr.card_outlet_edges(fixtures.lifts(spark, d))


@query(
    "card_outlet_edges_of_events",
    "D22",
    with_(EVENTS, PURCHASES) + "select * from edges",
    doubles=["quantity"],
    digits=2,
)
def q_event_edges(spark, d):
    return edges(spark, d)


@remembered
def components(spark, d):
    return inputs.keep(gr.graph_components(edges(spark, d)))


@query("graph_components", "D23", with_(*GRAPH_CTES) + f"select v as vertex, l as community from lab{ROUNDS}")
def q_components(spark, d):
    return components(spark, d)


@query(
    "graph_summary",
    "D27",
    with_(*GRAPH_CTES)
    + f"""select count(*) as edges, count(distinct card_id) as cards, count(distinct outlet_id) as outlets,
       count(distinct card_id) + count(distinct outlet_id) as nodes, (select count(distinct l) from lab{ROUNDS}) as components,
       {r("2 * count(*) / ((count(distinct card_id) + count(distinct outlet_id))::double * (count(distinct card_id) + count(distinct outlet_id) - 1))", 4)} as density
      from edges""",
)
def q_graph_summary(spark, d):
    return gr.graph_summary(edges(spark, d), components(spark, d))


@remembered
def communities(spark, d):
    return inputs.keep(gr.graph_communities(edges(spark, d)))


@query("graph_communities", "D23")
def q_communities(spark, d):
    return communities(spark, d)


@query("label_communities", "D23")
def q_label_communities(spark, d):
    return gr.label_communities(edges(spark, d))


RANK_ROUNDS = 60  # Chebyshev rounds: the error falls below 1e-12


def _rank_sql() -> str:
    parts = [
        f"""big as (select l from lab{ROUNDS} group by 1 having count(*) >= 3),
part as (select v, l from lab{ROUNDS} where l in (select l from big)),
sz as (select l, count(*) as n from part group by 1),
st as (select a, sum(weight) as s from links group by 1),
lk as materialized (select k.a as src, k.b as dst, p.l, z.n, k.weight / st.s as p from links k join part p on p.v = k.a join sz z on z.l = p.l join st on st.a = k.a
  union all select v, v, l, n, 0.0::double from part join sz using (l)),
pr0 as materialized (select v, part.l, n, 1.0::double / n as k, 0.0::double as before from part join sz using (l))"""
    ]
    omega, d = 1.0, 0.85
    for i in range(RANK_ROUNDS):
        step = f"{omega!r}::double * ((1 - 0.85::double) / n + 0.85::double * inflow - before) + before"
        parts.append(
            f"pr{i + 1} as materialized (select v, l, n, {step} as k, own as before from (select dst as v, lk.l, lk.n, sum(y.k * p) as inflow, "
            f"max(case when src = dst then y.k end) as own, max(case when src = dst then y.before end) as before "
            f"from lk join pr{i} y on y.v = lk.src group by dst, lk.l, lk.n))"
        )
        omega = 2 / (2 - d * d) if i == 0 else 1 / (1 - d * d * omega / 4)
    return ",\n".join(parts)


RANKS = _rank_sql()


@query(
    "community_pagerank",
    "D25",
    with_(*GRAPH_CTES, RANKS) + f"select v as vertex, l as community, k as rank from pr{RANK_ROUNDS}",
    doubles=["rank"],
    digits=8,
)
def q_rank(spark, d):
    big = components(spark, d).groupBy("community").count().where("count >= 3").select("community")
    members = components(spark, d).join(big, "community")
    return gr.community_rank(gr._inner_edges(edges(spark, d), members))


RINGS = f"""ed as (select e.*, p.l from edges e join part p on p.v = 'c:' || e.card_id),
kinds as (select l, count(*) filter (v like 'c:%') as n_cards, count(*) filter (v like 's:%') as n_outlets from part group by 1),
multi as (select l, count(*) filter (c > 1) as multi_cards from (select l, card_id, count(*) as c from ed group by 1, 2) group by 1),
sums as (select l, count(*) as n_edges, cast(sum(weight) as bigint) as total, cast(sum(unverified) as bigint) as unverified from ed group by 1),
hubs as (select l, arg_min(v, [-round_even(k * 1e9, 0)::varchar::double, row]) as hub, max(round_even(k * 1e9, 0) / 1e9) as hub_rank
  from (select *, row_number() over (partition by l order by round_even(k * 1e9, 0) desc, v) as row from pr{RANK_ROUNDS}) group by 1),
rings as (select l as community, n_cards, n_outlets, n_edges, total, multi_cards / n_cards as multi_share, unverified / greatest(total, 1) as unverified_share,
   n_edges / (n_cards * n_outlets) as density, total / n_edges as mean_weight, hub, least(hub_rank * n_cards, 1.0::double) as hub_score
  from kinds join multi using (l) join sums using (l) join hubs using (l))"""


@remembered
def strong_components(spark, d):
    return inputs.keep(gr.graph_components(edges(spark, d).where(F.col("weight") >= STRONG)))


@remembered
def component_rings(spark, d):
    return inputs.keep(gr.ring_scores(edges(spark, d).where(F.col("weight") >= STRONG), strong_components(spark, d)))


@remembered
def rings(spark, d):
    return inputs.keep(gr.ring_scores(edges(spark, d), communities(spark, d)))


RING_COLUMNS = ["community", "n_cards", "n_outlets", "n_edges", "total", "multi_share", "unverified_share", "density", "mean_weight"]
RING_SCORE = r(
    "least(0.3::double * multi_share + 0.25::double * unverified_share + 0.2::double * density"
    " + 0.15::double * least(mean_weight / 10.0::double, 1.0::double) + 0.1::double * hub_score, 1.0::double)",
    4,
)


@query(
    "component_ring_scores",
    "D24 D25",
    with_(*STRONG_CTES, RANKS, RINGS) + f"select {', '.join(RING_COLUMNS)}, hub_score, {RING_SCORE} as score from rings",
    doubles=["multi_share", "unverified_share", "density", "mean_weight", "hub_score"],
    digits=7,
)
def q_component_rings(spark, d):
    """Rings of the components of strong edges, the form that SQL can follow."""
    return component_rings(spark, d).select(*RING_COLUMNS, "hub_score", "score")


@query("ring_scores", "D24 D25")
def q_rings(spark, d):
    return rings(spark, d).select(*RING_COLUMNS, "hub_score", "score")


ALERT_COLUMNS = [
    "group_key", "outlet_id", "pattern", "score", "severity", "text", "action", "ring.cards", "ring.outlets", "ring.n_cards", "ring.n_outlets",
    "ring.total", "ring.hub_type", "ring.hub_id",
]


def _listed_sql(kind: str) -> str:
    return f"list(substr(v, 3) order by v) filter (v like '{kind}:%')"


@query(
    "component_ring_alerts",
    "D26",
    with_(*STRONG_CTES, RANKS, RINGS)
    + f""", lst as (select l as community, {_listed_sql('c')}[:20] as cards, {_listed_sql('s')}[:20] as outlets, count(*) filter (v like 'c:%') as n_cards,
        count(*) filter (v like 's:%') as n_outlets from part group by 1),
      scored as (select *, {RING_SCORE} as score from (select * exclude (n_cards, n_outlets) from rings) join lst using (community))
      select community as group_key, outlets[1] as outlet_id, 'coordinated_ring' as pattern, score,
        case when score >= 0.8 then 'Critical' when score >= 0.65 then 'High' else 'Medium' end as severity,
        'Ring of cards and outlets: ' || concat_ws('; ', case when multi_share > 0.3 then round(multi_share * n_cards)::bigint || ' cards use several outlets' end,
          case when unverified_share > 0.2 then round_even(unverified_share * 100, 0)::bigint || '% of lifts are unverified' end,
          case when density > 0.5 then 'nearly every card meets every outlet' end, 'hub ' || hub) as text,
        'Audit the outlets and hold the cards' as action, cards, outlets, n_cards, n_outlets, total,
        case when hub like 'c:%' then 'card' else 'outlet' end as hub_type, substr(hub, 3) as hub_id
      from scored""",
)
def q_component_ring_alerts(spark, d):
    return gr.ring_alerts(component_rings(spark, d), strong_components(spark, d)).select(*ALERT_COLUMNS)


@query("ring_alerts", "D26")
def q_ring_alerts(spark, d):
    return gr.ring_alerts(rings(spark, d), communities(spark, d)).select(*ALERT_COLUMNS)


CLUSTER_COLUMNS = ["staple_per_card", "collection_rate", "fuel_per_card"]
EPS, MIN_POINTS = 0.25, 6
SCALED = """moments as (select avg(staple_per_card) as m1, stddev_pop(staple_per_card) as s1, avg(collection_rate) as m2,
   stddev_pop(collection_rate) as s2, avg(fuel_per_card) as m3, stddev_pop(fuel_per_card) as s3 from features),
scaled as materialized (select outlet_id, (staple_per_card - m1) / s1 as x, (collection_rate - m2) / s2 as y, (fuel_per_card - m3) / s3 as z from features, moments),
close as materialized (select p.outlet_id as a, q.outlet_id as b from scaled p join scaled q
   on pow(p.x - q.x, 2) + pow(p.y - q.y, 2) + pow(p.z - q.z, 2) <= 0.0625::double),
core as materialized (select a from close group by 1 having count(*) >= 6),
corelinks as materialized (select a, b from close where a in (select a from core) and b in (select a from core))"""
CORE_LABELS = spread_labels("core_lab", "corelinks", 60)
CLUSTERS = """clusters as (
  select v as outlet_id, l as cluster, true as is_core from core_lab60
  union all select s.outlet_id, min(c.l), false from scaled s left join close e on e.a = s.outlet_id left join core_lab60 c on c.v = e.b
    where s.outlet_id not in (select a from core) group by s.outlet_id)"""
CLUSTER_CTES = (*FEATURE_CTES, SCALED, CORE_LABELS, CLUSTERS)


@remembered
def clusters(spark, d):
    scaled = standard_scale(inputs.features(spark, d), CLUSTER_COLUMNS)
    return inputs.keep(de.cluster(scaled, "outlet_id", CLUSTER_COLUMNS, EPS, MIN_POINTS))


@query("density_clusters", "D20 D17", with_(*CLUSTER_CTES) + "select outlet_id, cluster, is_core from clusters")
def q_clusters(spark, d):
    return clusters(spark, d)


@query(
    "density_cluster_findings",
    "D21 F11",
    with_(*CLUSTER_CTES)
    + f"""select cluster as group_key, count(*) as size, count(distinct region) as regions, {r("avg(staple_per_card)", 2)} as mean_staple,
       case when count(distinct region) > 1 then 'High' else 'Medium' end as severity,
       list_slice(list(outlet_id order by outlet_id), 1, 20) as outlets
      from clusters join features using (outlet_id) where cluster is not null group by 1 having count(*) >= 6""",
)
def q_cluster_findings(spark, d):
    return de.cluster_findings(clusters(spark, d), inputs.features(spark, d), min_points=MIN_POINTS).select(
        "group_key", "size", "regions", "mean_staple", "severity", "outlets"
    )


LIFT_POINTS = """lift_points as (select lift_id, floor(epoch(lift_ts)) / 86400.0::double as d, quantity as q, outlet_id::double as o from card_lifts),
lift_moments as (select avg(d) as m1, stddev_pop(d) as s1, avg(q) as m2, stddev_pop(q) as s2, avg(o) as m3, stddev_pop(o) as s3 from lift_points),
lift_scaled as materialized (select lift_id, (d - m1) / s1 as x, (q - m2) / s2 as y, (o - m3) / s3 as z from lift_points, lift_moments),
lift_close as materialized (select p.lift_id as a, q.lift_id as b from lift_scaled p join lift_scaled q on p.x between q.x - 0.300001 and q.x + 0.300001
   where sqrt(pow(p.x - q.x, 2) + pow(p.y - q.y, 2) + pow(p.z - q.z, 2)) <= 0.3::double),
lift_core as materialized (select a from lift_close group by 1 having count(*) >= 5),
lift_links as materialized (select a, b from lift_close where a in (select a from lift_core) and b in (select a from lift_core))"""
LIFT_LABELS = spread_labels("lift_lab", "lift_links", 60)
LIFT_GROUPS = """lift_groups as (select v as lift_id, l as cluster from lift_lab60
  union all select e.a, min(c.l) from lift_close e join lift_lab60 c on c.v = e.b where e.a not in (select a from lift_core) group by e.a)"""


@query(
    "lift_clusters",
    "X7 D20",
    with_(EVENTS, LIFT_POINTS, LIFT_LABELS, LIFT_GROUPS)
    + """select cluster, count(*) as lifts, count(distinct outlet_id) as outlets, sum(quantity) as quantity, min(lift_ts) as first_lift,
       max(lift_ts) as last_lift from lift_groups join card_lifts using (lift_id) group by 1""",
    doubles=["quantity"],
    digits=6,
)
def q_lift_clusters(spark, d):
    """Card lifts close in time, quantity and outlet number."""
    rows = fixtures.card_events(spark, d).selectExpr(
        "lift_id", "unix_seconds(cast(lift_ts as timestamp)) / 86400D as day", "quantity", "cast(outlet_id as double) as outlet_no"
    )
    scaled = standard_scale(rows, ["day", "quantity", "outlet_no"])
    found = de.cluster(scaled, "lift_id", ["day", "quantity", "outlet_no"], 0.3, 5)
    lifts = fixtures.card_events(spark, d)
    return (
        found.where("cluster is not null")
        .join(lifts, "lift_id")
        .groupBy("cluster")
        .agg(
            F.count(F.lit(1)).alias("lifts"),
            F.count_distinct("outlet_id").alias("outlets"),
            F.sum("quantity").alias("quantity"),
            F.min("lift_ts").alias("first_lift"),
            F.max("lift_ts").alias("last_lift"),
        )
    )


@remembered
def forest_scores(spark, d):
    features = inputs.scored_features(spark, d)
    forest = fo.train(features, "outlet_id")
    return inputs.keep(features.join(fo.training_scores(forest, "outlet_id"), "outlet_id"))


@query("isolation_forest_scores", "D18")
def q_forest(spark, d):
    return forest_scores(spark, d).select("outlet_id", "region", "forest_score")


@query("isolation_forest_alerts", "D19")
def q_forest_alerts(spark, d):
    return fo.findings(forest_scores(spark, d), ceiling=inputs.CEILING)


@remembered
def all_alerts(spark, d):
    """All five detectors, canonical and de-duplicated."""
    scored = inputs.scored_features(spark, d)
    return inputs.keep(
        al.union_alerts(
            [
                st.detect(scored, **STAT_LIMITS, **inputs.LIMITS),
                ru.apply_rules(scored, **RULE_SETTINGS),
                fo.findings(forest_scores(spark, d), ceiling=inputs.CEILING),
                de.cluster_findings(clusters(spark, d), inputs.features(spark, d), min_points=MIN_POINTS),
                gr.ring_alerts(rings(spark, d), communities(spark, d)),
            ],
            RUN_DATE,
        )
    )


@query("full_detection_run", "D30 U1")
def q_all(spark, d):
    return all_alerts(spark, d)
