"""Column expressions shared by the operators. Everything here stays inside the JVM."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_RADIUS_KM = 6371.0


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def half_even(c: Column | str, digits: int = 0) -> Column:
    """Rounding to the even neighbour on the binary value (scale, rint, unscale)."""
    if digits == 0:
        return F.rint(col(c))
    scale = F.lit(10.0**digits)
    return F.rint(col(c) * scale) / scale


def clip(c: Column | str, low: float | None = None, high: float | None = None) -> Column:
    """Limit to a range; null stays null (``greatest``/``least`` would hide it)."""
    value = col(c)
    out = None
    if low is not None:
        out = F.when(value < low, F.lit(low))
    if high is not None:
        out = F.when(value > high, F.lit(high)) if out is None else out.when(value > high, F.lit(high))
    return value if out is None else out.otherwise(value)


def bands_right_closed(c: Column | str, edges: Sequence[float], labels: Sequence[str]) -> Column:
    """``edges[i]`` belongs to ``labels[i]``; values above the last edge are null."""
    value = col(c)
    out = F.when(value <= edges[0], labels[0])
    for edge, label in zip(edges[1:], labels[1:], strict=True):
        out = out.when(value <= edge, label)
    return out


def bands_left_closed(c: Column | str, cuts: Sequence[tuple[float, str]], lowest: str) -> Column:
    """First label whose cut-off is reached, highest cut-off first."""
    value = col(c)
    out = F.when(value >= cuts[0][0], cuts[0][1])
    for cutoff, label in cuts[1:]:
        out = out.when(value >= cutoff, label)
    return out.otherwise(F.when(value.isNotNull(), lowest))


def haversine_km(lat1, lon1, lat2, lon2) -> Column:
    lat1, lon1, lat2, lon2 = (F.radians(col(c)) for c in (lat1, lon1, lat2, lon2))
    half_lat = F.sin((lat2 - lat1) / 2)
    half_lon = F.sin((lon2 - lon1) / 2)
    a = half_lat * half_lat + F.cos(lat1) * F.cos(lat2) * half_lon * half_lon
    return F.lit(2 * EARTH_RADIUS_KM) * F.asin(F.least(F.sqrt(a), F.lit(1.0)))


def month_of(ts: Column | str) -> Column:
    return F.trunc(F.to_date(col(ts)), "month")


def month_from_parts(year: Column | str, month: Column | str) -> Column:
    """First day of the month, null when the parts do not form a date."""
    y, m = col(year).cast("int"), col(month).cast("int")
    valid = y.between(1, 9999) & m.between(1, 12)
    text = F.concat_ws("-", F.lpad(y.cast("string"), 4, "0"), F.lpad(m.cast("string"), 2, "0"), F.lit("01"))
    return F.when(valid, F.try_to_timestamp(text, F.lit("yyyy-MM-dd")).cast("date"))


def active_flag(status: Column | str) -> Column:
    """True when the status text says so; an unknown status counts as active."""
    return F.coalesce(F.lower(F.trim(col(status))) == "active", F.lit(True))


def coordinates_known(lat: Column | str, lon: Column | str, min_lat: float = 5.0, min_lon: float = 60.0) -> Column:
    """Coordinates inside the served area; 0/0 and null are unknown."""
    return F.coalesce((col(lat) > min_lat) & (col(lon) > min_lon), F.lit(False))


def finite_or_null(c: Column | str) -> Column:
    value = col(c)
    return F.when(F.isnan(value) | (F.abs(value) == float("inf")), None).otherwise(value)


def stable_id(*parts: Column | str) -> Column:
    """Same parts, same id: re-runs of a job give the same alerts."""
    return F.sha2(F.concat_ws("|", *(F.coalesce(col(p).cast("string"), F.lit("")) for p in parts)), 256)


def percent_text(c: Column | str) -> Column:
    """Whole percent as text, for messages."""
    return F.concat(F.rint(col(c) * 100).cast("bigint").cast("string"), F.lit("%"))
