"""Named queries and the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.functions.columns import half_even

Plan = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Query:
    name: str
    covers: tuple[str, ...]
    plan: Plan
    sql: str | None


QUERIES: dict[str, Query] = {}


def query(
    name: str, covers: str, sql: str | None = None, doubles: Sequence[str] | Mapping[str, int] = (), digits: int = 9
):
    """Register a plan. ``covers`` lists inventory ids, ``doubles`` the columns rounded on both sides.

    Sums of doubles depend on the order of addition, so they are compared after rounding: to
    ``digits`` decimals, or to those given per column.
    """
    places = dict(doubles) if isinstance(doubles, Mapping) else dict.fromkeys(doubles, digits)

    def wrap(plan: Plan) -> Plan:
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")

        def rounded(spark: SparkSession, sf_dir: str) -> DataFrame:
            df = plan(spark, sf_dir)
            if not places:
                return df
            return df.withColumns({c: half_even(c, n) + F.lit(0.0) for c, n in places.items()})

        text = sql
        if sql is not None and places:
            swaps = ", ".join(f"round_even({c} * 1e{n}, 0) / 1e{n} + 0.0::double as {c}" for c, n in places.items())
            text = f"select * replace ({swaps}) from ({sql}) as result"
        QUERIES[name] = Query(name, tuple(covers.split()), rounded, text)
        return plan

    return wrap
