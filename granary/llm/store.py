"""Tables between the stages of an operator, as Parquet in the shared folder."""

from __future__ import annotations

import gc
import uuid

from pyspark.sql import DataFrame, SparkSession

from granary.session import shared_dir


def unused(columns: list[str], *names: str) -> list[str]:
    """The names, underscored until no column has them."""
    taken, out = {c.lower() for c in columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        out.append(name)
        taken.add(name.lower())
    return out


def shared_path(spark: SparkSession, name: str) -> str:
    """A new place in the folder that driver and executors share."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write the table once and read it back: cuts lineage, keeps columns and statistics."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Scratch:
    """Tables of one job, to be deleted when a later table holds all that is still needed of them."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.paths: dict[str, list[str]] = {}

    def stored(self, df: DataFrame, name: str) -> DataFrame:
        path = shared_path(self.spark, name)
        self.paths.setdefault(name, []).append(path)
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        """Delete the tables with these names, or all; files of shuffles that nothing refers to go too."""
        jvm = self.spark.sparkContext._jvm
        conf = self.spark.sparkContext._jsc.hadoopConfiguration()
        for name in names or list(self.paths):
            for place in self.paths.pop(name, []):
                path = jvm.org.apache.hadoop.fs.Path(place)
                path.getFileSystem(conf).delete(path, True)
        # Spark deletes shuffle files and checkpoints once the driver's collector has seen that their plans are gone.
        gc.collect()
        jvm.System.gc()
