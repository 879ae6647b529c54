"""SQL building blocks for the parity checks (DuckDB dialect)."""

from __future__ import annotations

def with_(*parts: str) -> str:
    """``with`` clause from CTE texts, each CTE once."""
    seen: list[str] = []
    for part in parts:
        if part not in seen:
            seen.append(part)
    return "with " + ",\n".join(seen) + "\n"


def half_even(expr: str, digits: int = 0) -> str:
    if digits == 0:
        return f"round_even(({expr})::double, 0)"
    return f"(round_even(({expr}) * 1e{digits}, 0) / 1e{digits})"


LIFTS = """lifts as (
  select cast(o_custkey as varchar) as outlet_id, n_name as region, p_type as item,
         cast(l_suppkey as varchar) as card_id, l_orderkey as txn_id,
         case when p_type = 'PROMO' and n_nationkey % 3 <> 0 and l_orderkey % 97 <> 0 then 0.0::double
              else l_quantity end as quantity,
         l_shipdate as lift_ts, l_returnflag <> 'R' as verified
  from lineitem join orders on l_orderkey = o_orderkey
       join part on l_partkey = p_partkey
       join customer on o_custkey = c_custkey
       join nation on c_nationkey = n_nationkey)"""

OUTLETS = """outlets as (
  select cast(c_custkey as varchar) as outlet_id, n_name as region,
         n_name || ' outlet ' || cast(c_custkey as varchar) as outlet_name,
         c_acctbal >= 0 as is_active,
         16.0::double + ((c_custkey * 6101) % 1000) / 250.0::double as latitude,
         77.0::double + ((c_custkey * 3571) % 997) / 249.25::double as longitude
  from customer join nation on c_nationkey = n_nationkey)"""

MEMBERS = """members as (
  select cast(o_orderkey as varchar) as member_id, cast(o_custkey as varchar) as outlet_id, n_name as region,
         cast(1 + o_orderkey % 6 as integer) as members_count,
         16.0::double + ((o_orderkey * 7919) % 1000) / 250.0::double as latitude,
         77.0::double + ((o_orderkey * 104729) % 997) / 249.25::double as longitude
  from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey)"""

BASE = """base as (
  select outlet_id, min(region) as region,
         sum(case when item = 'ECONOMY' then quantity else 0 end) as staple_total,
         sum(case when item = 'PROMO' then quantity else 0 end) as grain_total,
         sum(case when item = 'SMALL' then quantity else 0 end) as sweet_total,
         sum(case when item = 'STANDARD' then quantity else 0 end) as fuel_total,
         count(distinct case when quantity > 0 then item end) as item_count,
         count(distinct card_id) as total_cards,
         count(distinct txn_id) as total_transactions
  from lifts group by outlet_id)"""

FEATURES = """features as (
  select *, staple_total / greatest(total_cards, 1) as staple_per_card,
         grain_total / greatest(total_cards, 1) as grain_per_card,
         sweet_total / greatest(total_cards, 1) as sweet_per_card,
         fuel_total / greatest(total_cards, 1) as fuel_per_card,
         staple_total + grain_total + sweet_total as basket_total,
         staple_total / greatest(total_cards, 1) / 11.0::double as over_ratio,
         least(total_transactions / greatest(total_cards, 1), 2.0::double) as collection_rate
  from base)"""

_SIGNALS = {
    "staple_z": "staple_per_card",
    "rate_z": "collection_rate",
    "fuel_z": "fuel_per_card",
    "grain_z": "grain_per_card",
}
_PROBS = {"q1": 0.25, "med": 0.5, "q3": 0.75, "p90": 0.9, "p95": 0.95}

BASELINE = (
    "baseline as (\n  select region, "
    + ",\n         ".join(
        f"quantile_cont({c}, {p}) as {c}_{label}" for c in _SIGNALS.values() for label, p in _PROBS.items()
    )
    + ",\n         avg(case when grain_per_card = 0 then 1.0::double else 0.0::double end) as grain_zero_share"
    + "\n  from features group by region)"
)

SCORED = (
    "zs as (\n  select f.*, b.* exclude (region), "
    + ", ".join(f"0.6745::double * ({c} - {c}_med) / ({c}_q3 - {c}_q1 + 1e-8) as {z}" for z, c in _SIGNALS.items())
    + "\n  from features f join baseline b using (region)),\n"
    "scored as (\n  select *, greatest(0.0::double, least(1.0::double,\n"
    "    (0.2::double * greatest(over_ratio - 1.0::double, 0.0::double) * 3.0::double\n"
    "     + 0.35::double * least(abs(staple_z), 6.0::double) + 0.25::double * least(abs(rate_z), 6.0::double)\n"
    "     + 0.10::double * least(abs(fuel_z), 6.0::double) + 0.10::double * least(abs(grain_z), 6.0::double))\n"
    "    / 6.0::double)) as anomaly_score\n  from zs)"
)

FEATURE_CTES = (LIFTS, BASE, FEATURES)
SCORED_CTES = (*FEATURE_CTES, BASELINE, SCORED)
