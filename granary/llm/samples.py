"""Learning rows: the fold by id, and bounded samples that do not depend on the order of rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def fold(id_col: str, folds: int = 5) -> Column:
    """crc32 of the id as text, modulo ``folds``; null for a null id."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % folds


def sampled_ids(rows: DataFrame, per: str, limit: int) -> list[int]:
    """Up to ``limit`` ids (column doc_id) for each value of ``per``, by smallest hash of the id.

    Of a value with many ids only the share with the smallest hashes is ranked, four times the limit on average, so no
    task gets all ids of a frequent value.
    """
    ids = rows.select("doc_id", F.col(per).alias("label")).distinct().withColumn("spot", F.xxhash64("doc_id"))
    sizes = ids.groupBy(F.col("label").alias("name")).agg(F.count(F.lit(1)).alias("n"))
    share = F.least(F.lit(1.0), 4.0 * limit / F.col("n"))
    few = ids.join(sizes, F.col("label").eqNullSafe(F.col("name"))).where(F.col("spot") / 2.0**64 + 0.5 <= share)
    order = Window.partitionBy("label").orderBy("spot", "doc_id")
    ranked = few.select("doc_id", "label", F.row_number().over(order).alias("rank"))
    return [r.doc_id for r in ranked.where(F.col("rank") <= limit).select("doc_id").distinct().collect()]
