"""Normalisation, file periods and exports, on raw-looking tables made from the test tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from granary.functions.columns import coordinates_known, finite_or_null, half_even
from granary.plans.registry import QUERIES, query
from granary.plans.sql import LIFTS, OUTLETS, with_
from granary.session import shared_dir
from granary.sources import files, fixtures, normalise

# Published name of each item column in the raw-looking wide table.
RAW_ITEMS = {
    "riceAfsc": "ECONOMY", "riceFsc": "SMALL", "wheat": "PROMO", "sugar": "STANDARD", "rgdal": "MEDIUM", "kerosene": "LARGE",
}


def raw_wide(spark, d):
    """Outlet × month as the published files have it: all text."""
    month = F.trunc(F.to_date("lift_ts"), "month")
    sums = [F.sum(F.when(F.col("item") == item, F.col("quantity"))).cast("string").alias(raw) for raw, item in RAW_ITEMS.items()]
    return (
        fixtures.lifts(spark, d)
        .groupBy(
            F.col("outlet_id").alias("shopNo"),
            F.col("region").alias("distName"),
            F.year(month).cast("string").alias("year"),
            F.month(month).cast("string").alias("month"),
        )
        .agg(F.count_distinct("card_id").cast("string").alias("noOfRcs"), *sums)
    )


@query(
    "lifts_from_wide_files",
    "A5 B3 B4 B5 B6",
    with_(LIFTS)
    + """, w as (select outlet_id, region, cast(date_trunc('month', lift_ts) as date) as m, cast(count(distinct card_id) as integer) as cards,
        sum(case when item = 'ECONOMY' then quantity end) as a, sum(case when item = 'SMALL' then quantity end) as b,
        sum(case when item = 'PROMO' then quantity end) as c, sum(case when item = 'STANDARD' then quantity end) as d,
        sum(case when item = 'MEDIUM' then quantity end) as e, sum(case when item = 'LARGE' then quantity end) as f from lifts group by 1, 2, 3),
      u as (select outlet_id, region, m, cards, 'rice' as item, 'rice_a_kg' as src, a as q from w union all
        select outlet_id, region, m, cards, 'rice', 'rice_b_kg', b from w union all select outlet_id, region, m, cards, 'wheat', 'wheat_kg', c from w union all
        select outlet_id, region, m, cards, 'sugar', 'sugar_kg', d from w union all select outlet_id, region, m, cards, 'pulse', 'pulse_kg', e from w union all
        select outlet_id, region, m, cards, 'kerosene', 'kerosene_l', f from w)
     select outlet_id || '_' || item || '_' || src || '_' || strftime(m, '%Y-%m-%d') as lift_id, outlet_id, region, item, outlet_id || '_card' as card_id,
       'completed' as status, q as quantity, cast(m as timestamp) as lift_ts, cards as total_cards, true as verified from u where q > 0""",
)
def q_from_wide(spark, d):
    return normalise.lifts(raw_wide(spark, d)).select(
        "lift_id", "outlet_id", "region", "item", "card_id", "status", "quantity", "lift_ts", "total_cards", "verified"
    )


@query(
    "wide_round_trip",
    "B4 J1",
    with_(LIFTS)
    + """select outlet_id, cast(year(lift_ts) as integer) as year, cast(month(lift_ts) as integer) as month, item, sum(quantity) as quantity
       from lifts group by 1, 2, 3, 4 having sum(quantity) > 0""",
)
def q_round_trip(spark, d):
    """Pivot to wide and back gives the monthly sums again."""
    return normalise.unpivot_items(fixtures.lifts_wide(spark, d), fixtures.WIDE_ITEMS).select(
        "outlet_id", "year", "month", "item", "quantity"
    )


@query(
    "outlets_from_raw",
    "B1 B2 B9 F1",
    """select cast(c_custkey as varchar) as outlet_id, n_name as region, n_name || ' outlet ' || cast(c_custkey as varchar) as outlet_name,
      c_acctbal is null or c_acctbal >= 0 as is_active, cast(0 as integer) as total_cards
      from customer join nation on c_nationkey = n_nationkey""",
)
def q_outlets(spark, d):
    raw = (
        fixtures.table(spark, d, "customer")
        .join(fixtures.table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
        .select(
            F.col("c_custkey").alias("shopNo"),
            F.col("n_name").alias("distName"),
            F.expr("case when c_acctbal >= 0 then ' ACTIVE ' else 'Closed' end as fpsStatus"),
        )
    )
    return normalise.outlets(raw).select("outlet_id", "region", "outlet_name", "is_active", "total_cards")


@query(
    "members_from_raw",
    "B7 B8 B9",
    """select cast(o_custkey as varchar) || '_' || year(o_orderdate) || '_' || month(o_orderdate) as card_id,
       case when count(*) filter (o_orderstatus = 'P') > 0 then 'AAY' else 'PHH' end as card_type, cast(o_custkey as varchar) as outlet_id,
       cast(greatest(1, least(10, round_even(sum(1 + o_orderkey % 6) / count(*), 0))) as integer) as members_count, true as is_active
     from orders group by o_custkey, year(o_orderdate), month(o_orderdate)""",
)
def q_members(spark, d):
    raw = (
        fixtures.table(spark, d, "orders")
        .groupBy(F.col("o_custkey").alias("shopNo"), F.year("o_orderdate").alias("year"), F.month("o_orderdate").alias("month"))
        .agg(
            F.count_if(F.col("o_orderstatus") == "P").alias("rcNfsaAay"),
            F.count(F.lit(1)).alias("totalRcs"),
            F.expr("sum(1 + o_orderkey % 6) as totalUnits"),
        )
    )
    return normalise.members(raw).select("card_id", "card_type", "outlet_id", "members_count", "is_active")


def published(spark, d):
    """A file entry per order, with its period in the address, in the title or nowhere."""
    month, year = "cast(month(o_orderdate) as string)", "cast(year(o_orderdate) as string)"
    return fixtures.table(spark, d, "orders").selectExpr(
        "o_orderkey as entry",
        "o_orderpriority as dataset",
        f"case o_orderstatus when 'O' then concat('http://data.example/details_', {month}, '_', {year}, '.csv') "
        "else 'http://data.example/latest' end as url",
        f"case o_orderstatus when 'F' then concat('Data 01-', {month}, '-', {year}, ' to  28-', {month}, '-', {year}) "
        f"when 'P' then case when o_orderkey % 2 = 0 then concat('Period ', {month}, '-', {year}) else 'no period' end else '' end as title",
    )


@query(
    "file_periods",
    "A6 A9 F2",
    """select o_orderkey as entry, case when o_orderstatus = 'P' and o_orderkey % 2 = 1 then null else cast(month(o_orderdate) as integer) end as month,
      case when o_orderstatus = 'P' and o_orderkey % 2 = 1 then null else cast(year(o_orderdate) as integer) end as year from orders""",
)
def q_periods(spark, d):
    return published(spark, d).select(
        "entry",
        files.period_part(F.col("title"), F.col("url"), "month").alias("month"),
        files.period_part(F.col("title"), F.col("url"), "year").alias("year"),
    )


ENTRIES = """entries as (select distinct o_orderpriority as dataset, cast(year(o_orderdate) as integer) as year, cast(month(o_orderdate) as integer) as month,
   o_orderpriority || '_' || month(o_orderdate) || '_' || year(o_orderdate) || '.csv' as url from orders)"""


def entries(spark, d):
    return (
        fixtures.table(spark, d, "orders")
        .select(
            F.col("o_orderpriority").alias("dataset"), F.year("o_orderdate").alias("year"), F.month("o_orderdate").alias("month")
        )
        .distinct()
        .withColumn("url", F.concat("dataset", F.lit("_"), F.col("month").cast("string"), F.lit("_"), F.col("year").cast("string"), F.lit(".csv")))
    )


@query(
    "latest_files",
    "A7",
    with_(ENTRIES) + "select * from entries where year * 100 + month = (select max(year * 100 + month) from entries e where e.dataset = entries.dataset)",
)
def q_latest(spark, d):
    return files.latest_period(entries(spark, d))


@query(
    "files_in_period_range",
    "A8",
    with_(ENTRIES) + "select * from entries where year * 100 + month between 199604 and 199802",
)
def q_range(spark, d):
    return files.period_range(entries(spark, d), (1996, 4), (1998, 2))


@query(
    "file_manifest",
    "A11",
    with_(ENTRIES)
    + """select dataset, count(*) as total, min(printf('%d-%02d', year, month)) as earliest, max(printf('%d-%02d', year, month)) as latest,
       list_sort(list(url) filter (rn <= 5)) as files, greatest(count(*) - 5, 0) as more
     from (select *, row_number() over (partition by dataset order by url) as rn from entries) group by 1""",
)
def q_manifest(spark, d):
    return files.manifest(entries(spark, d))


@query(
    "outlet_geojson",
    "A13 F8",
    with_(OUTLETS)
    + """select outlet_id, cast(to_json({'type': 'Feature', 'geometry': {'type': 'Point', 'coordinates': [longitude, latitude]},
        'properties': {'outlet_id': outlet_id, 'outlet_name': outlet_name, 'region': region, 'is_active': is_active}}) as varchar) as feature from outlets""",
)
def q_geojson(spark, d):
    return files.geojson_features(fixtures.outlets(spark, d))


@query(
    "finite_values",
    "A14",
    "select o_orderkey as id, case when o_orderstatus = 'P' or o_totalprice > 200000 then null else o_totalprice end as price from orders",
)
def q_finite(spark, d):
    """Prices with NaN and infinity put in come out as null."""
    raw = fixtures.table(spark, d, "orders").selectExpr(
        "o_orderkey as id",
        "case when o_orderstatus = 'P' then double('NaN') when o_totalprice > 200000 then double('Infinity') else o_totalprice end as price",
    )
    return raw.select("id", finite_or_null("price").alias("price"))


@query(
    "known_coordinates",
    "H12",
    """select c_custkey as id from customer where c_acctbal >= 0 and (c_custkey * 6101) % 1000 > 100""",
)
def q_known(spark, d):
    """Outlets with a negative balance get 0/0, the others a latitude from 4.0 up; 5 is the limit."""
    raw = fixtures.table(spark, d, "customer").selectExpr(
        "c_custkey as id",
        "case when c_acctbal >= 0 then 4D + ((c_custkey * 6101) % 1000) / 100D else 0D end as latitude",
        "case when c_acctbal >= 0 then 77D else 0D end as longitude",
    )
    return raw.where(coordinates_known("latitude", "longitude")).select("id")


@query(
    "snapshot_changes",
    "B14 U3",
    """select cast(c_custkey as varchar) as outlet_id, unnest([true, false]) as is_active, unnest(['before', 'after']) as side
     from customer where c_acctbal >= 0 and c_acctbal < 500""",
)
def q_changes(spark, d):
    def snapshot(limit: float):
        return fixtures.table(spark, d, "customer").select(
            F.col("c_custkey").cast("string").alias("outlet_id"), (F.col("c_acctbal") >= limit).alias("is_active")
        )

    return files.snapshot_changes(snapshot(0.0), snapshot(500.0))


LONG_SQL = QUERIES["lifts_from_wide_files"].sql


@query("lifts_from_csv_files", "A1 A2", LONG_SQL)
def q_from_csv(spark, d):
    """The wide table written as CSV files, read back by pattern and normalised."""
    folder = f"{shared_dir(spark)}/csv-{uuid.uuid4().hex}"
    raw_wide(spark, d).write.option("header", True).csv(folder)
    raw = files.read_many(spark, f"{folder}/part-*.csv")
    return normalise.lifts(raw).select(
        "lift_id", "outlet_id", "region", "item", "card_id", "status", "quantity", "lift_ts", "total_cards", "verified"
    )


@query(
    "lifts_from_master_table",
    "A3 A10",
    with_(LIFTS)
    + """select outlet_id, cast(date_trunc('month', lift_ts) as date) as month, count(*) as lifts, sum(quantity) as quantity from lifts group by 1, 2""",
)
def q_from_master(spark, d):
    """Lifts written as a master table by month; the master comes before monthly files."""
    folder = f"{shared_dir(spark)}/master-{uuid.uuid4().hex}"
    lifts = fixtures.lifts(spark, d)
    files.write_master(lifts.withColumns({"year": F.year("lift_ts"), "month": F.month("lift_ts")}), folder, "lifts")
    return (
        files.load_table(spark, folder, "lifts")
        .groupBy("outlet_id", F.trunc(F.to_date("lift_ts"), "month").alias("month"))
        .agg(F.count(F.lit(1)).alias("lifts"), F.sum("quantity").alias("quantity"))
    )


@query(
    "half_even_rounding",
    "F6",
    """select o_orderkey as id, round_even(o_orderkey / 2.0::double, 0) as halves, round_even(o_orderkey / 8.0::double * 100, 0) / 100 as eighths,
       round_even(o_totalprice * 10, 0) / 10 as price from orders""",
)
def q_half_even(spark, d):
    """Ties of halves and eighths go to the even neighbour."""
    return fixtures.table(spark, d, "orders").select(
        F.col("o_orderkey").alias("id"),
        half_even(F.col("o_orderkey") / 2).alias("halves"),
        half_even(F.col("o_orderkey") / 8, 2).alias("eighths"),
        half_even("o_totalprice", 1).alias("price"),
    )
