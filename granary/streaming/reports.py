"""Structured Streaming versions of the report, alert and error operators.

The functions take and return DataFrames and work on batches as well, so a backfill and the live
stream share one definition.
"""

from __future__ import annotations

import time
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from granary.functions.columns import half_even
from granary.operators.rules import quick_score

WATERMARK = "2 days"
#: Streams that are joined and have more bytes in their files keep their state on disk. In the heap, state takes many times
#: its bytes in files, but is read and written faster.
HEAP_STATE_BYTES = 512 << 20


def file_stream(
    spark: SparkSession, path: str, schema: T.StructType, kind: str = "parquet", files_per_trigger: int = 100
) -> DataFrame:
    """New files of a folder or glob as a stream."""
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger)
    if kind == "csv":
        reader = reader.option("header", True)
    return reader.format(kind).load(path)


def score_reports(reports: DataFrame, **limits) -> DataFrame:
    """Rule scores of arriving outlet reports; no state."""
    return quick_score(reports, **limits)


def _late(lifts: DataFrame, watermark: str) -> DataFrame:
    return lifts.withWatermark("lift_ts", watermark) if lifts.isStreaming else lifts


def _counts() -> list:
    return [
        F.count(F.lit(1)).alias("lifts"),
        F.sum("quantity").alias("quantity"),
        F.count_if(~F.coalesce("verified", F.lit(True))).alias("unverified"),
    ]


def daily_features(lifts: DataFrame, watermark: str = WATERMARK, size: str = "1 day") -> DataFrame:
    """Counts and quantities per outlet and tumbling window."""
    return (
        _late(lifts, watermark)
        .groupBy("outlet_id", F.window("lift_ts", size).alias("w"))
        .agg(*_counts())
        .select("outlet_id", F.col("w.start").alias("window_start"), "lifts", "quantity", "unverified")
    )


def sliding_share(
    lifts: DataFrame, size: str = "7 days", slide: str = "1 day", watermark: str = WATERMARK
) -> DataFrame:
    """Share of unverified lifts and volume per outlet over a sliding window."""
    return (
        _late(lifts, watermark)
        .groupBy("outlet_id", F.window("lift_ts", size, slide).alias("w"))
        .agg(*_counts())
        .select(
            "outlet_id",
            F.col("w.start").alias("window_start"),
            "lifts",
            "quantity",
            (F.col("unverified") / F.col("lifts")).alias("unverified_share"),
        )
    )


def card_sessions(lifts: DataFrame, gap: str = "12 hours", watermark: str = WATERMARK) -> DataFrame:
    """Bursts of activity of a card: lifts closer together than the gap."""
    return (
        _late(lifts, watermark)
        .groupBy("card_id", F.session_window("lift_ts", gap).alias("w"))
        .agg(F.count(F.lit(1)).alias("lifts"), F.sum("quantity").alias("quantity"))
        .select("card_id", F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "lifts", "quantity")
    )


def with_master(reports: DataFrame, outlets: DataFrame, baseline: DataFrame) -> DataFrame:
    """Reports joined to the outlet master and the baseline of the region (both static)."""
    return reports.join(outlets.select("outlet_id", "region", "is_active"), "outlet_id", "left").join(
        baseline, "region", "left"
    )


def unique_alerts(alerts: DataFrame, watermark: str = WATERMARK) -> DataFrame:
    """First arrival of each alert id; ids are forgotten once the watermark has passed them."""
    if not alerts.isStreaming:
        return alerts.dropDuplicates(["alert_id"])
    return alerts.withWatermark("detected_at", watermark).dropDuplicatesWithinWatermark(["alert_id"])


FLAG_OUTPUT = "outlet_id string, alert_id string, detected_at timestamp, earlier_flags int, context string"
FLAG_STATE = "flags bigint, last bigint"


def repeat_flags(
    alerts: DataFrame, watermark: str = WATERMARK, forget_after_ms: int = 90 * 24 * 3600 * 1000
) -> DataFrame:
    """Each alert with the number of earlier flags of its outlet.

    State per outlet is their number and the time of the last; it is dropped when the watermark is that
    far past it.
    Alerts of one batch are taken in order of event time. The input is de-duplicated alerts, a
    handful per outlet, not raw lifts.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        flags, last = state.get if state.exists else (0, 0)
        rows = pd.concat(list(batches), ignore_index=True).sort_values(["detected_at", "alert_id"])
        counts = np.arange(flags, flags + len(rows))
        last = max(last, int(rows.detected_at.max().timestamp() * 1000))
        state.update((flags + len(rows), last))
        state.setTimeoutTimestamp(max(last, state.getCurrentWatermarkMs()) + forget_after_ms)
        yield pd.DataFrame(
            {
                "outlet_id": key[0],
                "alert_id": rows.alert_id.to_numpy(),
                "detected_at": rows.detected_at.to_numpy(),
                "earlier_flags": pd.Series(counts, dtype="int32").to_numpy(),
                "context": ["repeat" if c else "first" for c in counts],
            }
        )

    return (
        alerts.select("outlet_id", "alert_id", F.col("detected_at").cast("timestamp").alias("detected_at"))
        .withWatermark("detected_at", watermark)
        .groupBy("outlet_id")
        .applyInPandasWithState(step, FLAG_OUTPUT, FLAG_STATE, "append", GroupStateTimeout.EventTimeTimeout)
    )


def write_critical(alerts: DataFrame, path: str, checkpoint: str, severities: tuple[str, ...] = ("Critical",)):
    """Critical alerts to Parquet by day. A repeated batch replaces its own files, so nothing doubles."""

    def save(batch: DataFrame, batch_id: int) -> None:
        (
            batch.where(F.col("severity").isin(*severities))
            .withColumn("day", F.to_date("detected_at"))
            .write.mode("overwrite")
            .partitionBy("day")
            .parquet(f"{path}/batch={batch_id}")
        )

    return alerts.writeStream.foreachBatch(save).option("checkpointLocation", checkpoint)


def error_rows(actuals: DataFrame, forecasts: DataFrame, wait: str = "62 days") -> DataFrame:
    """outlet_id, item, model, forecast_at, error: each actual quantity that meets a forecast of its month.

    ``actuals``: outlet_id, item, actual_at, actual; ``forecasts``: outlet_id, item, model, forecast_at (start of the
    month), predicted. Either may be a stream or a table. As streams they wait for each other: the watermark is the
    latest time of the stream that lags, less ``wait``; rows older than that are dropped, and state is kept only for months it
    has not passed. Actuals of zero have no relative error and are left out.
    """
    told = forecasts.select(
        F.col("outlet_id").alias("f_outlet"), F.col("item").alias("f_item"), "model", "forecast_at", "predicted"
    )
    came = actuals.where("actual <> 0").select("outlet_id", "item", "actual_at", "actual")
    if told.isStreaming:
        told = told.withWatermark("forecast_at", wait)
    if came.isStreaming:
        came = came.withWatermark("actual_at", wait)
    same = (
        "outlet_id = f_outlet and item = f_item and actual_at >= forecast_at and actual_at < forecast_at + interval 31 days"
        " and date_trunc('month', actual_at) = forecast_at"
    )
    return came.join(told, F.expr(same)).select(
        "outlet_id", "item", "model", "forecast_at", F.expr("abs((actual - predicted) / actual) as error")
    )


def error_summary(rows: DataFrame, retrain_above: float = 0.15) -> DataFrame:
    """Mean error of each series and model, with a retrain mark."""
    found = rows.groupBy("outlet_id", "item", "model").agg(F.avg("error").alias("mape"), F.count(F.lit(1)).alias("months"))
    return found.withColumn("retrain", F.col("mape") > retrain_above).withColumn("mape", half_even("mape", 6))


def drain(writer, stalled_s: int = 600) -> None:
    """Process what is there now, then stop; a query in which no task ends for ``stalled_s`` seconds is an error.

    How long the whole takes depends on the input and is not limited.
    """
    running = writer.trigger(availableNow=True).start()
    tracker = SparkSession.active().sparkContext.statusTracker()

    def ended() -> tuple[int, int]:
        """Jobs that began and tasks that ended. A stream's jobs are named by its run."""
        jobs = tracker.getJobIdsForGroup(str(running.runId))
        stages = [s for j in jobs if (job := tracker.getJobInfo(j)) for s in job.stageIds]
        return len(jobs), sum(stage.numCompletedTasks for s in stages if (stage := tracker.getStageInfo(s)))

    before, since = (0, 0), time.monotonic()
    while not running.awaitTermination(min(stalled_s, 10)):
        if (now := ended()) != before:
            before, since = now, time.monotonic()
        elif time.monotonic() - since >= stalled_s:
            running.stop()
            raise TimeoutError("the stream did not finish")


@contextmanager
def state_on_disk(spark: SparkSession) -> Iterator[None]:
    """Streams started meanwhile keep their state in RocksDB, whose memory is bounded, and not as rows in the heap.

    For state that grows with the input, as that of a join of two streams.
    """
    store = "spark.sql.streaming.stateStore"
    wanted = {
        f"{store}.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
        f"{store}.rocksdb.boundedMemoryUsage": "true",
        f"{store}.rocksdb.changelogCheckpointing.enabled": "true",
    }
    before = {key: spark.conf.get(key, None) for key in wanted}
    try:
        for key, value in wanted.items():
            spark.conf.set(key, value)
        yield
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)
