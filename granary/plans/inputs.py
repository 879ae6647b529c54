"""Inputs several queries share, kept as Parquet tables: every detector reads the features.

A cache instead would put the whole history of each table into every later plan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.operators.features import outlet_features, region_baseline, with_baseline
from granary.operators.statistical import score_outlets
from granary.plans.memo import remembered
from granary.session import stored
from granary.sources import fixtures

# Thresholds that fire for some but not most outlets of the test tables (FIXTURES.md).
CEILING = 11.0
LIMITS = {"ceiling": CEILING, "phantom_rate": 0.50, "ghost_rate": 0.20, "ghost_min_cards": 20}
RULE_LIMITS = {**LIMITS, "low_rate": 0.25, "low_min_cards": 20, "spike_factor": 1.2}


def keep(df: DataFrame, *reads: DataFrame) -> DataFrame:
    """Materialise in the shared folder; survives the loss of any executor. ``reads``: see ``small_tasks``."""
    return stored(df, reads=reads)


@remembered
def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keep(
        outlet_features(
            fixtures.lifts(spark, sf_dir),
            items=fixtures.ITEMS,
            outlets=fixtures.outlets(spark, sf_dir),
            cards=F.count_distinct("card_id"),
            transactions=F.count_distinct("txn_id"),
            ceiling=CEILING,
        )
    )


@remembered
def baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keep(region_baseline(features(spark, sf_dir)))


@remembered
def scored_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features with the baseline of their region, the robust z of each signal and the composite score."""
    return keep(score_outlets(with_baseline(features(spark, sf_dir), baseline(spark, sf_dir))))
