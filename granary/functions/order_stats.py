"""Exact order statistics without sorting a whole group in one task.

A group (a region, say) can hold a large share of all rows, so ``percentile`` buffers and
``Window.partitionBy(group)`` over raw rows do not scale. Here equal values are first counted,
then every value gets a coarse bucket that keeps the order. A window over the few buckets of a
group and a window inside each bucket together give exact positions.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Buckets per natural-log unit: a bucket spans 0.05 % of the value.
RESOLUTION = 2000
_OFFSET = 2_000_000


def order_bucket(value: Column) -> Column:
    """Monotone map from a double to a long: larger value, larger or equal bucket."""
    size = F.floor(F.ln(F.abs(value)) * RESOLUTION) + F.lit(_OFFSET)
    return F.when(value > 0, size).when(value < 0, -size).otherwise(F.lit(0).cast("bigint"))


def _value_counts(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    return (
        df.where(F.col(value).isNotNull() & ~F.isnan(value))
        .withColumn("bucket", order_bucket(F.col(value)))
        .groupBy(*keys, "bucket", value)
        .agg(F.count(F.lit(1)).alias("held"))
    )


def _bucket_starts(counts: DataFrame, keys: Sequence[str]) -> DataFrame:
    group = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    per_bucket = counts.groupBy(*keys, "bucket").agg(F.sum("held").alias("in_bucket"))
    return per_bucket.select(
        *keys,
        "bucket",
        "in_bucket",
        (F.sum("in_bucket").over(group.orderBy("bucket")) - F.col("in_bucket")).alias("start"),
        F.sum("in_bucket").over(group).alias("n"),
    )


def _place(counts: DataFrame, starts: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    inside = Window.partitionBy(*keys, "bucket").orderBy(value)
    return counts.join(starts, [*keys, "bucket"]).withColumn(
        "below", F.col("start") + F.sum("held").over(inside) - F.col("held")
    )


def value_positions(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """One row per distinct value of a group: ``held`` rows have it, ``below`` rows are smaller, of ``n``."""
    frame = df.select(*keys, F.col(value).cast("double").alias(value))
    for key in keys:
        frame = frame.where(F.col(key).isNotNull())
    counts = _value_counts(frame, keys, value)
    return _place(counts, _bucket_starts(counts, keys), keys, value).select(*keys, value, "held", "below", "n")


def quantiles(df: DataFrame, keys: Sequence[str], cols: Sequence[str], probs: Mapping[str, float]) -> DataFrame:
    """Exact quantiles with linear interpolation, columns named ``{col}_{label}``.

    Only the buckets that hold a wanted position are sorted.
    """
    frame = df.select(*keys, *[F.col(c).cast("double").alias(c) for c in cols])
    for key in keys:
        frame = frame.where(F.col(key).isNotNull())
    long = frame.unpivot(list(keys), list(cols), "metric", "value")
    by = [*keys, "metric"]
    counts = _value_counts(long, by, "value")
    starts = _bucket_starts(counts, by)

    # The expressions are SQL text: one call to the JVM each, where chained Column calls cost one per step.
    ranks = {p: (f"floor({p}D * (n - 1))", f"ceil({p}D * (n - 1))") for p in probs.values()}
    wanted = " or ".join(
        f"({rank} >= start and {rank} < start + in_bucket)" for pair in ranks.values() for rank in sorted(set(pair))
    )
    placed = _place(counts, starts.where(wanted), by, "value")

    aggs, outputs = [], []
    for c in cols:
        aggs.append(F.expr(f"max(case when metric = '{c}' then n end) as `__n_{c}`"))
        for label, p in probs.items():
            low, high = f"`__lo_{c}_{label}`", f"`__hi_{c}_{label}`"
            for name, rank in zip((low, high), ranks[p], strict=True):
                hit = f"metric = '{c}' and below <= {rank} and {rank} < below + held"
                aggs.append(F.expr(f"max(case when {hit} then value end) as {name}"))
            exact = f"{p}D * (`__n_{c}` - 1)"
            outputs.append(f"{low} + ({high} - {low}) * ({exact} - floor({exact})) as `{c}_{label}`")
    return placed.groupBy(*keys).agg(*aggs).selectExpr(*keys, *outputs)


def rank_descending(df: DataFrame, keys: Sequence[str], value: str, name: str) -> DataFrame:
    """Competition rank, 1 for the largest value; equal values share the lowest rank."""
    ranks = value_positions(df, keys, value).select(
        *keys, value, (F.col("n") - F.col("below") - F.col("held") + 1).alias(name)
    )
    return df.join(ranks, [*keys, value], "left")


def gini(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Gini coefficient per group (all rows when ``keys`` is empty); null counts as 0, negative as 0."""
    load = F.greatest(F.coalesce(F.col(value).cast("double"), F.lit(0.0)), F.lit(0.0))
    spots = value_positions(df.select(*keys, load.alias("load")), keys, "load")
    held, below = F.col("held").cast("double"), F.col("below").cast("double")
    # Equal values sit at positions below+1 .. below+held.
    weighted = F.col("load") * (held * below + held * (held + 1) / 2)
    sums = spots.groupBy(*keys).agg(
        F.max("n").cast("double").alias("n"), F.sum(F.col("load") * held).alias("total"), F.sum(weighted).alias("ranked")
    )
    n, total = F.col("n"), F.col("total")
    value_out = F.when(total > 0, (2 * F.col("ranked") - (n + 1) * total) / (n * total)).otherwise(0.0)
    return sums.select(*keys, value_out.alias("gini"))


def running_total(
    df: DataFrame, keys: Sequence[str], order: str, tie: str, amount: str, name: str, zeros: bool = True
) -> DataFrame:
    """Sum of ``amount`` over the rows up to and including this one, by ``order`` then ``tie``.

    Without ``zeros`` the rows of amount 0, which change no total and often share one value of ``order``,
    are dealt out by hash and get the total at the start of their bucket only.
    """
    ready = df.withColumn("bucket", order_bucket(F.col(order).cast("double")))
    group = Window.partitionBy(*keys)
    starts = (
        ready.groupBy(*keys, "bucket")
        .agg(F.sum(amount).alias("in_bucket"))
        .select(
            *keys,
            "bucket",
            (F.sum("in_bucket").over(group.orderBy("bucket")) - F.col("in_bucket")).alias("start"),
        )
    )
    dealt = F.when(F.lit(not zeros) & (F.col(amount) == 0), 1 + F.pmod(F.xxhash64(tie), F.lit(1024))).otherwise(0)
    inside = Window.partitionBy(*keys, "bucket", dealt).orderBy(order, tie).rowsBetween(Window.unboundedPreceding, 0)
    return (
        ready.join(starts, [*keys, "bucket"])
        .withColumn(name, F.col("start") + F.sum(amount).over(inside))
        .drop("bucket", "start")
    )
