"""Monthly CSV files, master tables and exports."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from granary.sources import normalise


EXTRA = "_extra"


def read_csv(spark: SparkSession, path: str | Sequence[str], schema: T.StructType, audit: bool = False) -> DataFrame:
    """CSV with a header. Rows with too few fields are filled with nulls, rows with too many are dropped.

    With ``audit`` all rows come, those of another length with their text in ``_corrupt_record`` and, if they
    have too many fields, the first surplus one in ``_extra``.
    """
    wide = T.StructType([*schema.fields, T.StructField(EXTRA, T.StringType())])
    found = spark.read.option("header", True).option("mode", "PERMISSIVE").schema(wide).csv(path)
    if not audit:
        # The field after the last is there only in rows that are too long.
        return found.where(F.col(EXTRA).isNull()).drop(EXTRA)
    full = T.StructType([*schema.fields, T.StructField("_corrupt_record", T.StringType())])
    reader = spark.read.option("header", True).option("mode", "PERMISSIVE").option("columnPruning", False)
    marked = reader.option("columnNameOfCorruptRecord", "_corrupt_record").schema(full).csv(path)
    surplus = F.from_csv(F.col("_corrupt_record"), wide.simpleString().removeprefix("struct<").removesuffix(">").replace(":", " "))
    return marked.withColumn(EXTRA, surplus[EXTRA])


def csv_row_counts(audited: DataFrame) -> DataFrame:
    """Rows read, rows with too few and with too many fields, from an audit read."""
    return audited.agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(F.col("_corrupt_record").isNotNull() & F.col(EXTRA).isNull()).alias("short"),
        F.count_if(F.col(EXTRA).isNotNull()).alias("long"),
    )


def list_files(spark: SparkSession, pattern: str) -> list[str]:
    """Paths that match a glob, on any file system Spark can read."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(pattern)
    found = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(path)
    return sorted(status.getPath().toString() for status in found or [])


def _header(spark: SparkSession, file: str) -> tuple[str, ...]:
    """Column names of one file: only its first line is read."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(file)
    stream = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).open(path)
    try:
        line = jvm.java.io.BufferedReader(jvm.java.io.InputStreamReader(stream, "UTF-8")).readLine()
    finally:
        stream.close()
    return tuple(name.strip().strip('"') for name in (line or "").lstrip("﻿").split(",") if name.strip())


def read_many(spark: SparkSession, pattern: str) -> DataFrame | None:
    """All files of a pattern as text columns plus provenance; None when there is no file.

    Files with the same header are one scan; the scans are united by column name, so columns may
    come and go between months. Files without a header are skipped.
    """
    groups: dict[tuple[str, ...], list[str]] = defaultdict(list)
    for file in list_files(spark, pattern):
        header = _header(spark, file)
        if header:
            groups[header].append(file)
    out = None
    for header, files in groups.items():
        schema = T.StructType([T.StructField(name, T.StringType()) for name in header])
        part = with_provenance(read_csv(spark, files, schema))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out


def with_provenance(df: DataFrame) -> DataFrame:
    """Period taken from the file name and the time of loading."""
    name = F.col("_metadata.file_name")
    return df.select(
        "*",
        period_part(F.lit(""), name, "year").alias("source_year"),
        period_part(F.lit(""), name, "month").alias("source_month"),
        F.current_timestamp().alias("loaded_at"),
    )


# Where a month and year can stand in a file address or title, best pattern first.
_IN_URL = r"_(\d{1,2})_(\d{4})\.csv"
_UP_TO_DAY = r"to\s+\d{1,2}-(\d{1,2})-(\d{4})"
_ANYWHERE = r"(\d{1,2})-(\d{4})"


def period_part(title: Column, url: Column, part: str) -> Column:
    """``month`` or ``year`` of a published file, null when neither text has one."""
    group = {"month": 1, "year": 2}[part]
    tries = [(url, _IN_URL), (title, _UP_TO_DAY), (title, _ANYWHERE)]
    found = [F.nullif(F.regexp_extract(text, pattern, group), F.lit("")) for text, pattern in tries]
    return F.coalesce(*found).cast("int")


def latest_period(df: DataFrame, dataset: str = "dataset") -> DataFrame:
    """Rows of the last known period of each data set."""
    last = df.groupBy(dataset).agg(F.max(F.struct("year", "month")).alias("last"))
    return (
        df.join(last, dataset)
        .where((F.col("year") == F.col("last.year")) & (F.col("month") == F.col("last.month")))
        .drop("last")
    )


def period_range(df: DataFrame, first: tuple[int, int], last: tuple[int, int]) -> DataFrame:
    """Rows between two (year, month) bounds; rows of unknown period are left out.

    The year bounds stand alone as well, so that folders by year are pruned.
    """
    key = F.col("year") * 100 + F.col("month")
    return df.where(
        F.col("year").between(first[0], last[0]) & key.between(first[0] * 100 + first[1], last[0] * 100 + last[1])
    )


def manifest(files: DataFrame, shown: int = 5) -> DataFrame:
    """Per data set: number of files, first and last period, the latest few files by name.

    ``files``: dataset, url, year, month.
    """
    period = F.when(
        F.col("year").isNotNull() & F.col("month").isNotNull(), F.format_string("%d-%02d", F.col("year"), F.col("month"))
    )
    order = Window.partitionBy("dataset").orderBy("url")
    first = (
        files.withColumn("place", F.row_number().over(order))
        .where(F.col("place") <= shown)
        .groupBy("dataset")
        .agg(F.array_sort(F.collect_list("url")).alias("files"))
    )
    return (
        files.groupBy("dataset")
        .agg(F.count(F.lit(1)).alias("total"), F.min(period).alias("earliest"), F.max(period).alias("latest"))
        .join(first, "dataset")
        .withColumn("more", F.greatest(F.col("total") - shown, F.lit(0)))
    )


def load_table(spark: SparkSession, folder: str, kind: str) -> DataFrame:
    """Outlets, lifts or members: the master table, else the monthly files.

    Nothing to read is an error; no demo data is made up.
    """
    names = {
        "outlets": ("outlets", "geo_locations_*.csv", normalise.outlets),
        "lifts": ("lifts", "transactions_*.csv", normalise.lifts),
        "members": ("members", "card_status_*.csv", normalise.members),
    }
    master, pattern, prepare = names[kind]
    if list_files(spark, f"{folder}/{master}"):
        return prepare(spark.read.parquet(f"{folder}/{master}"))
    raw = read_many(spark, f"{folder}/{pattern}")
    if raw is None:
        raise FileNotFoundError(f"no {kind} in {folder}")
    return prepare(raw)


def load_all(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Outlets, members and lifts, unread until used."""
    return tuple(load_table(spark, folder, kind) for kind in ("outlets", "members", "lifts"))


def write_master(df: DataFrame, folder: str, kind: str) -> None:
    """Replace the periods present in ``df``, keep the others; tables without periods are replaced whole."""
    by_period = {"year", "month"} <= set(df.columns)
    writer = df.write.mode("overwrite")
    if by_period:
        writer = writer.option("partitionOverwriteMode", "dynamic").partitionBy("year", "month")
    writer.parquet(f"{folder}/{kind}")


def geojson_features(outlets: DataFrame, region: str | None = None) -> DataFrame:
    """One JSON feature per outlet with coordinates, longitude first."""
    rows = outlets.where("latitude is not null and longitude is not null")
    if region:
        rows = rows.where(F.lower("region") == region.lower())
    feature = F.struct(
        F.lit("Feature").alias("type"),
        F.struct(F.lit("Point").alias("type"), F.array("longitude", "latitude").alias("coordinates")).alias("geometry"),
        F.struct("outlet_id", "outlet_name", "region", "is_active").alias("properties"),
    )
    return rows.select("outlet_id", F.to_json(feature).alias("feature"))


def write_geojson(features: DataFrame, path: str) -> None:
    """One feature per line; parts are written by all tasks."""
    features.select("feature").write.mode("overwrite").text(path)


def snapshot_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """Outlets that appeared, vanished or changed their active flag."""
    key = ["outlet_id", "is_active"]
    gone = before.select(*key).exceptAll(after.select(*key)).withColumn("side", F.lit("before"))
    new = after.select(*key).exceptAll(before.select(*key)).withColumn("side", F.lit("after"))
    return gone.unionByName(new)
