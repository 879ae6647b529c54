"""Files and streams end to end."""

from __future__ import annotations

import datetime as dt
import time

import pytest
from pyspark.sql import functions as F

from granary.sources import files, normalise
from granary.streaming import reports


@pytest.fixture()
def folder(tmp_path):
    (tmp_path / "transactions_5_2024.csv").write_text(
        "distName,shopNo,year,month,noOfRcs,riceFsc,wheat\nNorth,1,2024,5,10,100,0\nNorth,2,2024,5,20,abc,7\nbroken,row\nNorth,3,,5,5,8,1\n"
    )
    (tmp_path / "transactions_6_2024.csv").write_text(
        "distName,shopNo,year,month,noOfRcs,riceFsc,kerosene\nSouth,1,2024,6,10,-4,3.5\n"
    )
    (tmp_path / "geo_locations_6_2024.csv").write_text(
        "distName,shopNo,fpsStatus,latitude,longitude\nNorth,1, ACTIVE ,17.1,78.2\nNorth,2,closed,0,0\n"
    )
    (tmp_path / "card_status_6_2024.csv").write_text(
        "distName,shopNo,year,month,rcNfsaAay,totalRcs,totalUnits\nNorth,1,2024,6,3,10,35\nNorth,2,2024,6,0,0,5\n"
    )
    (tmp_path / "empty_1_2024.csv").write_text("")
    return str(tmp_path)


def test_monthly_files(spark, folder):
    outlets, members, lifts = files.load_all(spark, folder)
    rows = {(r.outlet_id, r.item): (r.quantity, r.lift_ts) for r in lifts.collect()}
    may, june = dt.datetime(2024, 5, 1), dt.datetime(2024, 6, 1)
    # Zero, negative and unreadable quantities are gone; an unknown year gives no date.
    assert rows == {("1", "rice"): (100.0, may), ("2", "wheat"): (7.0, may), ("3", "rice"): (8.0, None),
                    ("3", "wheat"): (1.0, None), ("1", "kerosene"): (3.5, june)}
    assert {r.outlet_id: r.is_active for r in outlets.collect()} == {"1": True, "2": False}
    assert {r.outlet_id: (r.card_type, r.members_count) for r in members.collect()} == {"1": ("AAY", 4), "2": ("PHH", 5)}


def test_provenance_and_missing_files(spark, folder):
    raw = files.read_many(spark, f"{folder}/transactions_*.csv")
    assert {(r.source_year, r.source_month) for r in raw.collect()} == {(2024, 5), (2024, 6)}
    assert files.read_many(spark, f"{folder}/nothing_*.csv") is None
    with pytest.raises(FileNotFoundError):
        files.load_table(spark, f"{folder}/absent", "lifts")


def test_corrupt_rows_are_audited(spark, folder):
    from pyspark.sql import types as T

    names = "distName shopNo year month noOfRcs riceFsc wheat".split()
    schema = T.StructType([T.StructField(n, T.StringType()) for n in names])
    audit = files.read_csv(spark, f"{folder}/transactions_5_2024.csv", schema, audit=True).cache()
    assert audit.where("_corrupt_record is not null").count() == 1
    # The short row is kept with nulls.
    assert files.read_csv(spark, f"{folder}/transactions_5_2024.csv", schema).count() == 4
    assert files.csv_row_counts(audit).first().asDict() == {"rows": 4, "short": 1, "long": 0}


def test_long_rows_are_dropped_and_counted(spark, tmp_path):
    from pyspark.sql import types as T

    (tmp_path / "x.csv").write_text('a,b,c\n1,2,3\n1,2\n1,2,3,4\n"x, y",2,3\n1,2,3,4,5\n')
    schema = T.StructType([T.StructField(n, T.StringType()) for n in "abc"])
    rows = files.read_csv(spark, f"{tmp_path}/x.csv", schema)
    assert sorted(map(tuple, rows.collect()), key=str) == [("1", "2", "3"), ("1", "2", None), ("x, y", "2", "3")]
    assert rows.select("a").count() == 3
    audit = files.read_csv(spark, f"{tmp_path}/x.csv", schema, audit=True).cache()
    assert files.csv_row_counts(audit).first().asDict() == {"rows": 5, "short": 1, "long": 2}


def test_python_stages_find_the_package_from_another_folder(tmp_path):
    import subprocess
    import sys
    from pathlib import Path

    code = (
        f"import sys; sys.path.insert(0, {str(Path(files.__file__).parents[2])!r})\n"
        "from granary.session import build_session\n"
        "from granary.plans.catalog import QUERIES\n"
        "spark = build_session('local[2]', **{'spark.sql.shuffle.partitions': '2', 'spark.ui.showConsoleProgress': 'false'})\n"
        "assert QUERIES['isolation_forest_scores'].plan(spark, '/root/testdata/sf0.001').count() > 0\n"
    )
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env={**__import__("os").environ, "PYTHONPATH": ""}, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr[-2000:]


def test_master_tables_replace_only_their_periods(spark, tmp_path):
    folder = str(tmp_path)
    row = "outlet_id string, item string, quantity double, year int, month int"
    files.write_master(spark.createDataFrame([("1", "rice", 1.0, 2024, 5), ("1", "rice", 2.0, 2024, 6)], row), folder, "lifts")
    files.write_master(spark.createDataFrame([("1", "rice", 9.0, 2024, 6)], row), folder, "lifts")
    kept = {r.month: r.quantity for r in spark.read.parquet(f"{folder}/lifts").collect()}
    assert kept == {5: 1.0, 6: 9.0}
    assert files.load_table(spark, folder, "lifts").count() == 2
    plan = files.period_range(spark.read.parquet(f"{folder}/lifts"), (2024, 6), (2024, 6))
    assert "PartitionFilters: [" in plan._jdf.queryExecution().toString() and plan.count() == 1


def test_required_column(spark):
    with pytest.raises(Exception):
        normalise.lifts(spark.createDataFrame([(1,)], "x int")).collect()


def lift_schema():
    return "outlet_id string, card_id string, lift_ts timestamp, quantity double, verified boolean"


def test_stream_windows_equal_batch_and_late_rows_drop(spark, tmp_path):
    source, sink, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    day = dt.datetime(2024, 1, 1)
    first = [("o", "c", day + dt.timedelta(hours=h), 1.0, h % 2 == 0) for h in range(0, 240, 6)]
    spark.createDataFrame(first, lift_schema()).coalesce(1).write.parquet(f"{source}/part=1")

    def run():
        lifts = reports.file_stream(spark, f"{source}/*", spark.createDataFrame([], lift_schema()).schema)
        writer = (
            reports.daily_features(lifts, "2 days").writeStream.format("parquet").option("path", sink).option("checkpointLocation", state)
        )
        reports.drain(writer, 120)
        return {r.window_start: r.lifts for r in spark.read.parquet(sink).collect()}

    closed = run()
    batch = {r.window_start: r.lifts for r in reports.daily_features(spark.createDataFrame(first, lift_schema())).collect()}
    assert closed and closed == {w: batch[w] for w in closed} and len(closed) < len(batch)
    # Restart from the checkpoint: one row far too late, one row that moves time on.
    spark.createDataFrame([("o", "c", day, 5.0, True), ("o", "c", day + dt.timedelta(days=30), 1.0, True)], lift_schema()).coalesce(
        1
    ).write.parquet(f"{source}/part=2")
    again = run()
    assert again[day] == closed[day]
    assert len(again) == len(batch)


def test_error_stream_equals_batch_and_drops_late_actuals(spark, tmp_path):
    def at(month):
        return dt.datetime(2024 + (month - 1) // 12, (month - 1) % 12 + 1, 1)

    a_schema, f_schema = "outlet_id string, item string, actual_at timestamp, actual double", "outlet_id string, item string, model string, forecast_at timestamp, predicted double"
    actuals = [(f"o{o}", "a", at(m) + dt.timedelta(days=o), 10.0 * (m % 3)) for m in range(1, 13) for o in range(4)]
    forecasts = [(f"o{o}", "a", model, at(m), 9.0 + m) for m in range(1, 13) for o in range(4) for model in ("x", "y")]

    def run(parts, late=()):
        home = tmp_path / f"{parts}-{len(late)}"
        for k in range(parts):
            own = range(12 * k // parts + 1, 12 * (k + 1) // parts + 1)
            more = list(late) if k == parts - 1 else []
            spark.createDataFrame([r for r in actuals if r[2].month in own] + more, a_schema).coalesce(1).write.mode("append").parquet(f"{home}/a")
            spark.createDataFrame([r for r in forecasts if r[3].month in own], f_schema).coalesce(1).write.mode("append").parquet(f"{home}/f")
        feeds = [
            reports.file_stream(spark, f"{home}/{n}", spark.createDataFrame([], schema).schema, files_per_trigger=1)
            for n, schema in (("a", a_schema), ("f", f_schema))
        ]
        writer = reports.error_rows(*feeds, wait="40 days").writeStream.format("parquet").option("path", f"{home}/out")
        reports.drain(writer.option("checkpointLocation", f"{home}/state"), 200)
        return sorted(map(tuple, reports.error_summary(spark.read.parquet(f"{home}/out")).collect()))

    batch = reports.error_summary(reports.error_rows(spark.createDataFrame(actuals, a_schema), spark.createDataFrame(forecasts, f_schema)))
    want = sorted(map(tuple, batch.collect()))
    assert len(want) == 8 and run(1) == run(3) == want
    # January comes again in the last of three files: too late, so nothing changes.
    assert run(3, [("o0", "a", at(1), 1000.0)]) == want


def test_repeat_flags_survive_a_restart(spark, tmp_path):
    source, sink, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    schema = "outlet_id string, alert_id string, detected_at timestamp"

    def run(part, rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{source}/part={part}")
        stream = reports.file_stream(spark, f"{source}/*", spark.createDataFrame([], schema).schema)
        reports.drain(
            reports.repeat_flags(stream).writeStream.format("parquet").option("path", sink).option("checkpointLocation", state), 120
        )
        return {r.alert_id: r.earlier_flags for r in spark.read.parquet(sink).collect()}

    t = dt.datetime(2024, 1, 1)
    assert run(1, [("o", "b", t + dt.timedelta(hours=1)), ("o", "a", t), ("p", "c", t)]) == {"a": 0, "b": 1, "c": 0}
    assert run(2, [("o", "d", t + dt.timedelta(hours=2))])["d"] == 2


def test_escalation_counts_only_earlier_flags(spark):
    from granary.operators.alerts import escalate

    alerts = spark.createDataFrame(
        [("x", "o1", "p", "Critical"), ("y", "o2", "p", "Critical"), ("z", "o1", "q", "Low")],
        "alert_id string, outlet_id string, pattern string, severity string",
    ).withColumn("detected_at", F.lit("2024-06-01").cast("timestamp_ntz"))
    history = spark.sql(
        "select 'o1' as outlet_id, timestamp_ntz'2024-05-01' as flagged_at union all select 'o2', timestamp_ntz'2024-07-01'"
    )
    got = {r.alert_id: (r.earlier_flags, r.context) for r in escalate(alerts, history).collect()}
    assert got == {"x": (1, "repeat"), "y": (0, "first")}


def _months(spark):
    actuals = spark.createDataFrame(
        [("o1", "i", dt.datetime(2024, m, 1), 10.0 * m) for m in range(1, 7)], "outlet_id string, item string, actual_at timestamp, actual double"
    )
    told = spark.createDataFrame(
        [("o1", "i", "m", dt.datetime(2024, m, 1), 8.0 * m) for m in range(3, 7)],
        "outlet_id string, item string, model string, forecast_at timestamp, predicted double",
    )
    return actuals, told


def test_a_stream_may_take_longer_than_a_stall(spark, tmp_path):
    rows = _months(spark)[0]
    for i in range(7):
        rows.coalesce(1).write.mode("append").parquet(str(tmp_path / "feed"))
    seen = []

    def slow(batch, number):
        time.sleep(1.2)
        seen.append(batch.count())

    stream = reports.file_stream(spark, str(tmp_path / "feed"), rows.schema, files_per_trigger=1)
    reports.drain(stream.writeStream.foreachBatch(slow).option("checkpointLocation", str(tmp_path / "state")), 5)
    assert seen == [6] * 7


def test_state_of_a_join_on_disk_gives_the_rows_of_the_batch(spark, tmp_path):
    tables, streams = _months(spark), []
    for i, df in enumerate(tables):
        df.coalesce(1).write.parquet(str(tmp_path / f"feed{i}"))
        streams.append(reports.file_stream(spark, str(tmp_path / f"feed{i}"), df.schema, files_per_trigger=1))
    joined = reports.error_rows(*streams)
    home, key = str(tmp_path / "out"), "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key, None)
    with reports.state_on_disk(spark):
        reports.drain(joined.writeStream.format("parquet").option("path", home).option("checkpointLocation", str(tmp_path / "state")))
    assert spark.conf.get(key, None) == before
    assert (tmp_path / "state" / "state" / "0" / "0").exists() and [*(tmp_path / "state").rglob("*.changelog")] + [*(tmp_path / "state").rglob("*.zip")]
    got = spark.read.schema(joined.schema).parquet(home)
    assert sorted(got.collect()) == sorted(reports.error_rows(*tables).collect()) and got.count() == 4
