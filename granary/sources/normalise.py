"""Raw file columns → domain tables."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.functions.columns import active_flag, month_from_parts
from granary.functions.schemas import LIFT, LIFT_DEFAULTS, MEMBER, MEMBER_DEFAULTS, OUTLET, OUTLET_DEFAULTS, conform

# Column names of the published files and their names here.
LIFT_NAMES = {
    "distCode": "region_code",
    "distName": "region",
    "officeCode": "office_code",
    "officeName": "office_name",
    "shopNo": "outlet_id",
    "month": "month",
    "year": "year",
    "noOfRcs": "total_cards",
    "noOfTrans": "total_transactions",
    "riceAfsc": "rice_a_kg",
    "riceFsc": "rice_b_kg",
    "riceAap": "rice_c_kg",
    "wheat": "wheat_kg",
    "sugar": "sugar_kg",
    "rgdal": "pulse_kg",
    "kerosene": "kerosene_l",
    "totalAmount": "total_amount",
    "salt": "salt_kg",
    "otherShopTransCnt": "other_outlet_transactions",
}
CARD_NAMES = {
    "distCode": "region_code",
    "distName": "region",
    "officeCode": "office_code",
    "officeName": "office_name",
    "shopNo": "outlet_id",
    "month": "month",
    "year": "year",
    "rcNfsaAay": "cards_aay",
    "unitsNfsaAay": "units_aay",
    "rcNfsaPhh": "cards_phh",
    "unitsNfsaPhh": "units_phh",
    "totalRcNfsa": "total_cards_national",
    "totalUnitsNfsa": "total_units_national",
    "rcStateAay": "cards_state_aay",
    "unitsStateAay": "units_state_aay",
    "rcStatePhh": "cards_state_phh",
    "unitsStatePhh": "units_state_phh",
    "rcStateAap": "cards_state_aap",
    "unitsStateAap": "units_state_aap",
    "totalRcState": "total_cards_state",
    "totalUnitsState": "total_units_state",
    "totalRcs": "total_cards",
    "totalUnits": "total_units",
    "cardTypeId": "card_type_id",
    "units": "units",
    "gasCylinders": "gas_cylinders",
    "mroAsoApprDate": "approval_date",
    "cardPoolType": "card_pool_type",
}
OUTLET_NAMES = {
    "distCode": "region_code",
    "distName": "region",
    "officeCode": "office_code",
    "officeName": "office_name",
    "shopNo": "outlet_id",
    "address": "address",
    "longitude": "longitude",
    "latitude": "latitude",
    "fpsStatus": "status",
    "fpsType": "outlet_type",
    "dateTime": "last_updated",
}

# Wide item columns and the item each belongs to.
WIDE_ITEMS = {
    "rice_a_kg": "rice",
    "rice_b_kg": "rice",
    "rice_c_kg": "rice",
    "wheat_kg": "wheat",
    "sugar_kg": "sugar",
    "pulse_kg": "pulse",
    "kerosene_l": "kerosene",
    "salt_kg": "salt",
}


def rename(raw: DataFrame, names: Mapping[str, str]) -> DataFrame:
    """Published column names → our names; unknown columns stay."""
    return raw.withColumnsRenamed({old: new for old, new in names.items() if old in raw.columns})


def outlets(raw: DataFrame) -> DataFrame:
    """Outlet master: active flag, string id, a name when none is given."""
    df = rename(raw, OUTLET_NAMES)
    if "is_active" not in df.columns and "status" in df.columns:
        df = df.withColumn("is_active", active_flag("status"))
    df = df.withColumn("outlet_id", F.col("outlet_id").cast("string"))
    if "outlet_name" not in df.columns:
        region = F.col("region") if "region" in df.columns else F.lit("Unknown")
        df = df.withColumn("outlet_name", F.concat_ws(" ", region, F.lit("outlet"), "outlet_id"))
    return conform(df, OUTLET, OUTLET_DEFAULTS, required=("outlet_id",))


def unpivot_items(wide: DataFrame, items: Mapping[str, str] = WIDE_ITEMS) -> DataFrame:
    """One row per outlet, month and item column with a positive quantity; several columns can be one item."""
    columns = [c for c in items if c in wide.columns]
    ids = [c for c in wide.columns if c not in columns]
    lookup = F.create_map(*[F.lit(x) for pair in items.items() for x in pair])
    typed = wide.select(*ids, *[F.col(c).try_cast("double").alias(c) for c in columns])
    return typed.unpivot(ids, columns, "source_column", "quantity").where("quantity > 0").withColumn(
        "item", lookup[F.col("source_column")]
    )


def lifts(raw: DataFrame, items: Mapping[str, str] = WIDE_ITEMS) -> DataFrame:
    """Lifts in long form from a wide monthly file, or from rows that are long already."""
    df = rename(raw, LIFT_NAMES).withColumn("outlet_id", F.col("outlet_id").cast("string"))
    if "lift_ts" not in df.columns:
        year = "year" if "year" in df.columns else "source_year"
        month = "month" if "month" in df.columns else "source_month"
        df = df.withColumn("lift_ts", month_from_parts(year, month).cast("timestamp_ntz"))
    if any(c in df.columns for c in items):
        df = unpivot_items(df, items)
    source = F.col("source_column") if "source_column" in df.columns else F.lit(None).cast("string")
    if "item" not in df.columns:
        df = df.withColumn("item", F.lit(LIFT_DEFAULTS["item"]))
    if "card_id" not in df.columns:
        df = df.withColumn("card_id", F.concat_ws("_", "outlet_id", F.lit("card")))
    if "lift_id" not in df.columns:
        # Columns that share an item need their own name in the id.
        df = df.withColumn("lift_id", lift_id("outlet_id", "item", source, "lift_ts"))
    return conform(df, LIFT, LIFT_DEFAULTS, required=("outlet_id",))


def lift_id(outlet, item, source, ts) -> Column:
    parts = [F.col(p) if isinstance(p, str) else p for p in (outlet, item, source)]
    return F.concat_ws("_", *parts, F.date_format(F.col(ts), "yyyy-MM-dd"))


def card_type(aay_count: Column | str) -> Column:
    count = F.col(aay_count) if isinstance(aay_count, str) else aay_count
    return F.when(count > 0, "AAY").otherwise("PHH")


def household_size(units: Column | str, cards: Column | str) -> Column:
    """Units per card, at least 1 and at most 10."""
    u = F.col(units) if isinstance(units, str) else units
    c = F.col(cards) if isinstance(cards, str) else cards
    per_card = F.rint(u / F.when(c == 0, 1).otherwise(c)).cast("int")
    return F.when(per_card.isNotNull(), F.least(F.greatest(per_card, F.lit(1)), F.lit(10)))


def members(raw: DataFrame) -> DataFrame:
    """Card status rows → members."""
    df = rename(raw, CARD_NAMES).withColumn("outlet_id", F.col("outlet_id").cast("string"))
    if "card_id" not in df.columns:
        parts = [c for c in ("outlet_id", "year", "month") if c in df.columns]
        df = df.withColumn("card_id", F.concat_ws("_", *parts))
    if "card_type" not in df.columns:
        count = F.col("cards_aay").try_cast("int") if "cards_aay" in df.columns else F.lit(0)
        df = df.withColumn("card_type", card_type(count))
    if "members_count" not in df.columns and {"total_units", "total_cards"} <= set(df.columns):
        df = df.withColumn(
            "members_count", household_size(F.col("total_units").try_cast("int"), F.col("total_cards").try_cast("int"))
        )
    return conform(df, MEMBER, MEMBER_DEFAULTS, required=("outlet_id",))
