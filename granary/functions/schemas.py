"""Explicit schemas and the one step that brings a raw frame into them."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


_TYPES = {
    "string": T.StringType(),
    "int": T.IntegerType(),
    "bigint": T.LongType(),
    "double": T.DoubleType(),
    "boolean": T.BooleanType(),
    "date": T.DateType(),
    "timestamp": T.TimestampType(),
    "timestamp_ntz": T.TimestampNTZType(),
    "strings": T.ArrayType(T.StringType()),
}


def _struct(spec: str, *more: T.StructField) -> T.StructType:
    """Schema from "name type" pairs; needs no running session."""
    pairs = [item.split() for item in spec.split(",")]
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in pairs] + list(more))


OUTLET = _struct(
    "outlet_id string, region string, region_code int, outlet_name string, address string, outlet_type string,"
    "latitude double, longitude double, is_active boolean, total_cards int,"
    "source_year int, source_month int, loaded_at timestamp"
)

LIFT_WIDE = _struct(
    "outlet_id string, region string, year int, month int, total_cards int, total_transactions int,"
    "other_outlet_transactions int, rice_a_kg double, rice_b_kg double, rice_c_kg double, wheat_kg double,"
    "sugar_kg double, pulse_kg double, kerosene_l double, salt_kg double, total_amount double"
)

LIFT = _struct(
    "lift_id string, outlet_id string, region string, item string, card_id string, status string,"
    "device_id string, quantity double, lift_ts timestamp_ntz, total_cards int, total_transactions int, verified boolean"
)

MEMBER = _struct(
    "card_id string, card_type string, outlet_id string, region string, cards_aay int, cards_phh int,"
    "total_cards int, total_units int, members_count int, is_active boolean, latitude double, longitude double"
)

RING = _struct(
    "ring_id string, cards strings, outlets strings, n_cards bigint, n_outlets bigint, total bigint,"
    "multi_share double, unverified_share double, density double, hub_type string, hub_id string"
)

ALERT = _struct(
    "alert_id string, outlet_id string, region string, card_id string, severity string, pattern string, score double,"
    "model string, status string, text string, action string, group_key string, detected_at timestamp_ntz",
    T.StructField("ring", RING),
)

FORECAST = _struct(
    "outlet_id string, region string, item string, forecast_month date, predicted double, lower double, upper double,"
    "model string, risk_flag string"
)

CHUNK = _struct(
    "doc_id string, text string, source string, indexed_at timestamp",
    T.StructField("metadata", T.MapType(T.StringType(), T.StringType())),
)

LIFT_DEFAULTS = {"item": "rice", "quantity": 0.0, "status": "completed", "verified": True}
OUTLET_DEFAULTS = {"is_active": True, "total_cards": 0}
MEMBER_DEFAULTS = {"members_count": 3, "is_active": True}

# Allowed values of the coded columns.
CARD_TYPES = ("AAY", "PHH", "NPHH", "Annapurna")
SEVERITIES = ("Critical", "High", "Medium", "Low")
LIFT_STATES = ("completed", "pending", "flagged", "blocked", "reversed")
ALERT_STATES = ("open", "investigating", "resolved", "false_positive", "escalated")


def conform(
    df: DataFrame,
    schema: T.StructType,
    defaults: Mapping[str, object] | None = None,
    required: tuple[str, ...] = (),
) -> DataFrame:
    """Select exactly the schema's columns: cast what is there, fill what is not.

    A value that cannot be cast becomes null; a missing ``required`` column is an error.
    """
    missing = [name for name in required if name not in df.columns]
    if missing:
        raise ValueError(f"required columns are missing: {missing}")
    defaults = defaults or {}
    out = []
    for field in schema.fields:
        fallback = F.lit(defaults.get(field.name)).cast(field.dataType)
        if field.name not in df.columns:
            out.append(fallback.alias(field.name))
            continue
        value = F.col(field.name).try_cast(field.dataType)
        out.append((F.coalesce(value, fallback) if field.name in defaults else value).alias(field.name))
    return df.select(*out)


def invalid_codes(df: DataFrame, column: str, allowed: tuple[str, ...]) -> DataFrame:
    """Values of a coded column outside the allowed list, with their counts."""
    return df.where(~F.col(column).isin(*allowed)).groupBy(column).agg(F.count(F.lit(1)).alias("rows"))
