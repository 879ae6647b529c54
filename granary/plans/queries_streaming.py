"""Streaming operators: window results on the batch form, stateful ones by draining a stream of the table."""

from __future__ import annotations

import uuid
from contextlib import nullcontext

from pyspark.sql import functions as F

from granary.operators import forecast as fc
from granary.plans import inputs
from granary.plans.queries_forecast import SERIES, TEST, series, tested
from granary.plans.queries_reports import EVENTS
from granary.plans.registry import QUERIES, query
from granary.plans.sql import BASELINE, FEATURE_CTES, LIFTS, OUTLETS, with_
from granary.session import input_bytes, shared_dir
from granary.sources import fixtures
from granary.streaming import reports as sr


@query(
    "daily_outlet_windows",
    "S2",
    with_(EVENTS)
    + """select outlet_id, cast(date_trunc('day', lift_ts) as timestamp) as window_start, count(*) as lifts, sum(quantity) as quantity,
       count(*) filter (not verified) as unverified from card_lifts group by 1, 2""",
    doubles=["quantity"],
    digits=6,
)
def q_daily(spark, d):
    return sr.daily_features(fixtures.card_events(spark, d))


@query(
    "sliding_unverified_share",
    "S3",
    with_(EVENTS)
    + """select outlet_id, cast(date_trunc('day', lift_ts) - to_days(cast(k as integer)) as timestamp) as window_start, count(*) as lifts, sum(quantity) as quantity,
       count(*) filter (not verified) / count(*) as unverified_share from card_lifts, range(0, 7) t(k) group by 1, 2""",
    doubles=["quantity", "unverified_share"],
    digits=6,
)
def q_sliding(spark, d):
    return sr.sliding_share(fixtures.card_events(spark, d))


@query(
    "card_sessions",
    "S4",
    with_(EVENTS)
    + """, g as (select *, case when lift_ts - lag(lift_ts) over w < interval 12 hours then 0 else 1 end as fresh from card_lifts window w as (partition by card_id order by lift_ts)),
      s as (select *, sum(fresh) over (partition by card_id order by lift_ts rows unbounded preceding) as no from g)
     select card_id, min(lift_ts) as session_start, max(lift_ts) + interval 12 hours as session_end, count(*) as lifts, sum(quantity) as quantity from s group by card_id, no""",
    doubles=["quantity"],
    digits=6,
)
def q_sessions(spark, d):
    return sr.card_sessions(fixtures.card_events(spark, d))


@query(
    "reports_with_master",
    "S7",
    with_(*FEATURE_CTES, BASELINE, OUTLETS)
    + """select f.outlet_id, o.region, o.is_active, f.staple_per_card > b.staple_per_card_p95 as above_p95
       from features f join outlets o using (outlet_id) left join baseline b on b.region = o.region""",
)
def q_master(spark, d):
    features = inputs.features(spark, d)
    joined = sr.with_master(features.drop("region"), fixtures.outlets(spark, d), inputs.baseline(spark, d))
    return inputs.keep(
        joined.select(
            "outlet_id", "region", "is_active", (F.col("staple_per_card") > F.col("staple_per_card_p95")).alias("above_p95")
        )
    )


@query(
    "forecast_error_monitor",
    "S9",
    with_(LIFTS, SERIES, TEST)
    + """select outlet_id, item, model, round_even(avg(abs((actual - predicted) / actual)) * 1e6, 0) / 1e6 as mape, count(*) as months,
       avg(abs((actual - predicted) / actual)) > 0.15 as retrain from tested where actual <> 0 group by 1, 2, 3""",
)
def q_monitor(spark, d):
    return inputs.keep(sr.error_summary(sr.error_rows(*_feeds(spark, d))))


def _feeds(spark, d):
    """Actual quantities and forecasts of the backtest with their times."""
    actuals = series(spark, d).select(*fc.SERIES, F.col("month").cast("timestamp").alias("actual_at"), F.col("quantity").alias("actual"))
    return actuals, tested(spark, d).select(*fc.SERIES, "model", F.col("month").cast("timestamp").alias("forecast_at"), "predicted")


def _event_stream(spark, d):
    """The event table as a file stream of error reports of outlets."""
    schema = fixtures.table(spark, d, "events").schema
    raw = sr.file_stream(spark, f"{d}/events*.parquet", schema)
    return raw.where("event_type = 'error'").select(
        F.get_json_object("props", "$.k").alias("outlet_id"),
        F.col("event_id").cast("string").alias("alert_id"),
        F.col("ts").cast("timestamp").alias("detected_at"),
        F.when(F.col("value") > 50, "Critical").otherwise("Low").alias("severity"),
    )


def _run(spark, stream, mode: str = "append"):
    """Write a stream to a new folder until its input is used up, and read the result."""
    home = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    sr.drain(
        stream.writeStream.outputMode(mode)
        .format("parquet")
        .option("path", f"{home}/data")
        .option("checkpointLocation", f"{home}/checkpoint")
    )
    return spark.read.schema(stream.schema).parquet(f"{home}/data")


ERRORS = """errors as (select json_extract_string(props, '$.k') as outlet_id, cast(event_id as varchar) as alert_id, ts as detected_at,
   case when value > 50 then 'Critical' else 'Low' end as severity from events where event_type = 'error')"""


@query(
    "stream_repeat_flags",
    "S5",
    with_(ERRORS)
    + """select outlet_id, alert_id, cast(row_number() over (partition by outlet_id order by detected_at, alert_id) - 1 as integer) as earlier_flags,
       case when row_number() over (partition by outlet_id order by detected_at, alert_id) = 1 then 'first' else 'repeat' end as context from errors""",
)
def q_repeat(spark, d):
    return _run(spark, sr.repeat_flags(_event_stream(spark, d))).select("outlet_id", "alert_id", "earlier_flags", "context")


@query(
    "stream_unique_alerts",
    "S6",
    with_(ERRORS) + "select distinct outlet_id || '-' || severity as alert_id from errors",
)
def q_unique(spark, d):
    alerts = _event_stream(spark, d).withColumn("alert_id", F.concat_ws("-", "outlet_id", "severity"))
    return _run(spark, sr.unique_alerts(alerts, "60 days")).select("alert_id")


@query(
    "stream_critical_alert_sink",
    "S8 S10",
    with_(ERRORS) + "select alert_id, outlet_id, cast(detected_at as date) as day from errors where severity = 'Critical'",
)
def q_sink(spark, d):
    home = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    sr.drain(sr.write_critical(_event_stream(spark, d), f"{home}/data", f"{home}/checkpoint"))
    return spark.read.parquet(f"{home}/data").select("alert_id", "outlet_id", "day")


@query(
    "stream_daily_outlet_windows",
    "S2 S10",
    with_(EVENTS)
    + """, last as (select date_trunc('day', max(lift_ts) - interval 2 days) as t from card_lifts)
      select outlet_id, cast(date_trunc('day', lift_ts) as timestamp) as window_start, count(*) as lifts, count(*) filter (not verified) as unverified
      from card_lifts, last where date_trunc('day', lift_ts) < last.t group by 1, 2""",
)
def q_stream_daily(spark, d):
    """Windows the watermark has closed; the last days stay open."""
    schema = fixtures.table(spark, d, "events").schema
    lifts = sr.file_stream(spark, f"{d}/events*.parquet", schema).select(
        F.get_json_object("props", "$.k").alias("outlet_id"),
        F.col("ts").cast("timestamp").alias("lift_ts"),
        F.col("value").alias("quantity"),
        (F.col("event_type") != "error").alias("verified"),
    )
    return _run(spark, sr.daily_features(lifts)).select(
        "outlet_id", F.col("window_start").cast("timestamp_ntz").alias("window_start"), "lifts", "unverified"
    )


def _in_parts(spark, df, time: str, parts: int = 4, kind: str = "parquet") -> str:
    """A folder with the table in several files, earlier rows in earlier files, as a feed would leave them."""
    folder = f"{shared_dir(spark)}/feed-{uuid.uuid4().hex}"
    first, last = df.agg(F.min(F.unix_micros(time)), F.max(F.unix_micros(time))).first()
    width = (last - first) // parts + 1
    for k in range(parts):
        part = df.where(F.floor((F.unix_micros(F.col(time)) - first) / width) == k).coalesce(1)
        part.write.mode("append").format(kind).option("header", True).save(folder)
    return folder


def _lift_feed(spark, d, kind: str = "parquet"):
    """Card lifts as a stream of several files, one per batch."""
    lifts = fixtures.card_events(spark, d).select(
        "card_id", "outlet_id", "quantity", F.col("lift_ts").cast("timestamp").alias("lift_ts"), "verified"
    )
    return sr.file_stream(spark, _in_parts(spark, lifts, "lift_ts", kind=kind), lifts.schema, kind, files_per_trigger=1)


CLOSED = "(select max(lift_ts) - interval 2 days as t from card_lifts)"


@query(
    "stream_sliding_unverified_share",
    "S3",
    f"select s.* from ({QUERIES['sliding_unverified_share'].sql}) s, (with {EVENTS} select t from {CLOSED}) c where window_start + interval 7 days <= c.t",
    doubles=["quantity", "unverified_share"],
    digits=6,
)
def q_stream_sliding(spark, d):
    """Windows that the watermark has closed."""
    out = _run(spark, sr.sliding_share(_lift_feed(spark, d)))
    return out.withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


@query(
    "stream_card_sessions",
    "S4",
    f"select s.* from ({QUERIES['card_sessions'].sql}) s, (with {EVENTS} select t from {CLOSED}) c where session_end <= c.t",
    doubles=["quantity"],
    digits=6,
)
def q_stream_sessions(spark, d):
    """Sessions that the watermark has closed."""
    out = _run(spark, sr.card_sessions(_lift_feed(spark, d)))
    return out.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("session_start", "session_end")})


@query("stream_daily_outlet_windows_of_csv", "S2 S10", QUERIES["stream_daily_outlet_windows"].sql)
def q_stream_csv(spark, d):
    """The same windows from several CSV files."""
    return _run(spark, sr.daily_features(_lift_feed(spark, d, "csv"))).select(
        "outlet_id", F.col("window_start").cast("timestamp_ntz").alias("window_start"), "lifts", "unverified"
    )


@query("stream_reports_with_master", "S7", QUERIES["reports_with_master"].sql)
def q_stream_master(spark, d):
    """Reports of outlets as a stream, joined to the static master and baseline."""
    features = inputs.features(spark, d)
    reports = features.drop("region")
    folder = f"{shared_dir(spark)}/feed-{uuid.uuid4().hex}"
    reports.repartition(4, "outlet_id").write.parquet(folder)
    stream = sr.file_stream(spark, folder, reports.schema, files_per_trigger=1)
    joined = sr.with_master(stream, fixtures.outlets(spark, d), inputs.baseline(spark, d))
    return _run(
        spark,
        joined.select("outlet_id", "region", "is_active", (F.col("staple_per_card") > F.col("staple_per_card_p95")).alias("above_p95")),
    )


@query("stream_forecast_errors", "S9", QUERIES["forecast_error_monitor"].sql)
def q_stream_errors(spark, d):
    """Both feeds as streams of several files, joined as they come; the errors found are then summed up."""
    feeds = _feeds(spark, d)
    folders = [_in_parts(spark, df, time) for df, time in zip(feeds, ("actual_at", "forecast_at"))]
    streams = [sr.file_stream(spark, folder, df.schema, files_per_trigger=1) for folder, df in zip(folders, feeds)]
    size = sum(input_bytes(spark.read.schema(df.schema).parquet(folder)) for folder, df in zip(folders, feeds))
    with sr.state_on_disk(spark) if size > sr.HEAP_STATE_BYTES else nullcontext():
        errors = _run(spark, sr.error_rows(*streams))
    return sr.error_summary(errors)


@query("stream_quick_report_scores", "S1 D31", QUERIES["quick_report_scores"].sql)
def q_stream_scores(spark, d):
    """Rule scores of reports that come in several files."""
    features = inputs.features(spark, d)
    folder = f"{shared_dir(spark)}/feed-{uuid.uuid4().hex}"
    features.repartition(3, "outlet_id").write.parquet(folder)
    stream = sr.file_stream(spark, folder, features.schema, files_per_trigger=1)
    scored = sr.score_reports(stream, ceiling=inputs.CEILING, phantom_rate=0.5)
    return _run(spark, scored.select("outlet_id", "rule", "score", "severity", "is_flagged"))
