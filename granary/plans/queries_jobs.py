"""The whole pipeline on the test tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from granary.plans import inputs
from granary.plans.jobs import run_pipeline
from granary.plans.queries_fraud import RULE_SETTINGS, RUN_DATE, STAT_LIMITS
from granary.plans.registry import query
from granary.session import shared_dir
from granary.sources import fixtures, runs


@query("pipeline_snapshot", "V13 D30 H11 R10 V1")
def q_pipeline(spark, d):
    """Rows per result table of one run."""
    features = inputs.features(spark, d)
    folder = f"{shared_dir(spark)}/results-{uuid.uuid4().hex}"
    run_pipeline(
        fixtures.outlets(spark, d),
        fixtures.members(spark, d),
        fixtures.lifts(spark, d),
        features,
        fixtures.card_mix(spark, d, features),
        list(fixtures.WIDE_ITEMS.values()),
        RUN_DATE,
        folder,
        reach_km=10.0,
        merge_km=6.0,
        staple=fixtures.ITEMS["staple"],
        limits={**STAT_LIMITS, **inputs.LIMITS},
        rule_limits=RULE_SETTINGS,
    )
    out = None
    for name in sorted(runs.manifests(spark, folder)[RUN_DATE]):
        part = runs.read(spark, folder, name).groupBy("run_date").agg(F.count(F.lit(1)).alias("rows")).withColumn("table", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out
