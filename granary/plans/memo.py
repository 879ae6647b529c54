"""Inputs that several queries share, remembered while their tables stay as they are."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession


def table_state(spark: SparkSession, folder: str) -> tuple:
    """Name, size and time of change of what lies in a folder, on any file system Spark can read."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    found = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(path)
    return tuple(sorted((s.getPath().getName(), s.getLen(), s.getModificationTime()) for s in found))


def remembered(plan: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    """Build once per application and state of the tables; what another application left is dropped."""
    kept: dict[tuple, DataFrame] = {}

    @wraps(plan)
    def use(spark: SparkSession, folder: str) -> DataFrame:
        app = spark.sparkContext.applicationId
        mark = (app, folder, table_state(spark, folder))
        if mark not in kept:
            for old in [k for k in kept if k[0] != app or k[1] == folder]:
                del kept[old]
            kept[mark] = plan(spark, folder)
        return kept[mark]

    use.cache_clear = kept.clear
    return use
