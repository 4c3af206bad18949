"""Sources, sinks, table changes, reports, batch and incremental flows."""

import json
import os

import pytest
from helpers import at, readings
from pyspark.sql import functions as F

from tidemark.operators import anomaly, cleaning
from tidemark.operators import timeseries as TS
from tidemark.plans import adapters, batch, reports
from tidemark.sources import readers as R
from tidemark.sources import writers as K
from tidemark.streaming import incremental

SAMPLE = [
    ("S1", "2025-07-16T10:00:00", "temperature", 0.0),
    ("S1", "2025-07-17T10:00:00", "temperature", 25.0),
    ("S2", "2025-07-17T11:00:00", "humidity", None),
    ("S3", "2025-07-18T11:00:00", "humidity", 61.5),
]


@pytest.fixture
def table(spark, tmp_path):
    path = str(tmp_path / "table")
    assert K.append_readings(readings(spark, SAMPLE), path) == 4
    return path


def test_append_keeps_zero_and_fills_defaults(spark, table):
    rows = {r.id: r for r in R.read_readings(spark, table).collect()}
    assert rows[1].value == 0.0 and rows[3].value is None
    assert rows[1].data_quality == "unknown" and rows[1].quality_score == 100.0 and rows[1].processed_timestamp is not None


def test_append_without_id_or_timestamp(spark, tmp_path):
    df = spark.createDataFrame([("S1", None, "t", 1.0)], "sensor_id string, timestamp timestamp_ntz, reading_type string, value double")
    path = str(tmp_path / "t")
    assert K.append_readings(df, path) == 1
    row = R.read_readings(spark, path).first()
    assert row.timestamp is not None and row.id is not None


def test_update_rewrites_only_touched_dates(spark, table):
    before = {p: os.listdir(f"{table}/{p}") for p in os.listdir(table) if p.startswith("date=")}
    changes = spark.createDataFrame([(2, 30.0, None)], "id long, value double, unit string")
    assert K.update_readings(spark, table, changes) == 1
    rows = {r.id: r for r in R.read_readings(spark, table).collect()}
    assert rows[2].value == 30.0 and rows[2].unit is None and rows[1].value == 0.0 and len(rows) == 4
    after = {p: os.listdir(f"{table}/{p}") for p in os.listdir(table) if p.startswith("date=")}
    assert [p for p in before if before[p] != after[p]] == ["date=2025-07-17"]


def test_delete_empties_a_date(spark, table):
    ids = spark.createDataFrame([(1,), (2,)], "id long")
    assert K.delete_readings(spark, table, ids) == 2
    assert sorted(r.id for r in R.read_readings(spark, table).collect()) == [3, 4]


def test_table_by_date_and_sensor(spark, tmp_path):
    path, keys = str(tmp_path / "t"), ("date", "sensor_id")
    rows = K.with_defaults(readings(spark, SAMPLE + [("S 4/x", "2025-07-18T11:00:00", "humidity", 1.0)]))
    assert K.write_readings(rows, path, partition_by=keys)["rows"] == 5
    assert sorted(p for p in os.listdir(f"{path}/date=2025-07-17") if "=" in p) == ["sensor_id=S1", "sensor_id=S2"]
    one = spark.createDataFrame([(3, 9.5)], "id long, value double")
    assert K.update_readings(spark, path, one, keys) == 1
    assert K.delete_readings(spark, path, spark.createDataFrame([(2,), (5,)], "id long"), keys) == 2
    got = {r.id: (r.sensor_id, r.value) for r in R.read_readings(spark, path).collect()}
    assert got == {1: ("S1", 0.0), 3: ("S2", 9.5), 4: ("S3", 61.5)}


def test_absent_ids_change_nothing(spark, table):
    ids = spark.createDataFrame([(999999,)], "id long")
    assert K.delete_readings(spark, table, ids) == 0
    assert K.update_readings(spark, table, ids.withColumn("value", F.lit(1.0))) == 0
    with pytest.raises(ValueError):
        K.update_readings(spark, table, ids.withColumn("timestamp", F.current_timestamp()))


def test_a_hot_date_is_written_by_several_tasks(spark, tmp_path):
    df = spark.range(0, 200000, 1, 8).select(
        "id", F.concat(F.lit("S"), (F.col("id") % 977).cast("string")).alias("sensor_id"),
        F.lit(at("2025-07-16T10:00:00")).cast("timestamp_ntz").alias("timestamp"), F.lit("t").alias("reading_type"), F.rand(1).alias("value"),
    )
    old = spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "500KB")
    try:
        K.write_readings(df, str(tmp_path / "hot"))
    finally:
        spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", old)
    files = [f for f in os.listdir(tmp_path / "hot" / "date=2025-07-16") if f.endswith(".parquet")]
    assert len(files) > 2
    assert spark.read.parquet(str(tmp_path / "hot")).count() == 200000


def test_master_index_skips_its_own_file(spark, tmp_path):
    path = tmp_path / "json"
    K.write_json(readings(spark, SAMPLE), str(path))
    (path / "index.json").write_text('{"sensor_id": "x"}')
    total = K.master_index(spark, str(path), "json").where("file_path IS NULL").first()
    assert total.record_count == 4
    assert R.read_stored_json(spark, str(path)).count() == 4


def test_export(spark, tmp_path):
    df = spark.createDataFrame([(1, 'say "hi", you', None), (2, "", 1.5)], "id long, sensor_id string, value double")
    with pytest.raises(ValueError, match="Unsupported export format: xml"):
        K.export(df, str(tmp_path / "x"), "xml")
    K.export(df, str(tmp_path / "c"), "CSV")
    back = spark.read.option("header", True).option("escape", '"').schema("id long, sensor_id string, value double").csv(str(tmp_path / "c"))
    rows = {r.id: r for r in back.collect()}
    assert rows[1].sensor_id == 'say "hi", you' and rows[1].value is None and rows[2].value == 1.5
    text = "".join((tmp_path / "c" / f).read_text() for f in os.listdir(tmp_path / "c") if f.endswith(".csv"))
    assert '"say ""hi"", you"' in text and text.startswith("id,sensor_id,value")


def test_landing_folder_with_all_kinds_of_files(spark, tmp_path):
    raw = tmp_path / "raw"
    raw.mkdir()
    record = {"sensor_id": "S1", "timestamp": "2025-07-16T10:00:00Z", "reading_type": "temperature", "value": "25.5", "location": {"field": "f9", "latitude": 1.5, "longitude": 2}}
    (raw / "array.json").write_text(json.dumps([record, {**record, "sensor_id": ""}, {**record, "timestamp": "junk"}]))
    (raw / "object.json").write_text(json.dumps({**record, "value": 7}, indent=2))
    (raw / "broken.json").write_text('{"sensor_id": ')
    (raw / "notes.txt").write_text("not data")
    adapters.land_parquet(readings(spark, SAMPLE).coalesce(1), str(raw / "p"))
    (raw / "bad.parquet").write_bytes(b"this is not parquet")
    with pytest.raises(ValueError, match="bad.parquet"):
        R.read_landing(spark, str(raw), skip_bad_files=False)
    landed = R.read_landing(spark, str(raw))
    good = R.ingest(landed)
    assert good.count() == 6
    assert {(r.value, r.field) for r in good.where("source_file LIKE '%json'").collect()} == {(25.5, "f9"), (7.0, "f9")}
    counts = R.ingest_summary(landed).first()
    assert (counts.processed, counts.skipped, counts.errors, counts.files) == (6, 2, 2, 3)
    unread = [r.source_file for r in R.unread_files(spark, str(raw), landed).collect()]
    assert len(unread) == 1 and unread[0].endswith("bad.parquet")


def test_files_are_chosen_by_time(spark, tmp_path):
    for day in (1, 2, 3):
        name = str(tmp_path / f"d{day}")
        adapters.land_parquet(readings(spark, SAMPLE[:day]).coalesce(1), name)
        for f in os.listdir(name):
            os.utime(f"{name}/{f}", (86400 * day, 86400 * day))
    got = R.read_raw_parquet(spark, str(tmp_path), start="1970-01-03 00:00:00", end="1970-01-04 00:00:00")
    assert got.count() == 5
    assert R.read_raw_parquet(spark, str(tmp_path), end="1970-01-02 00:00:00").count() == 1


def test_landing_admission(spark, tmp_path):
    (tmp_path / "a.parquet").write_bytes(b"x" * 50)
    (tmp_path / "b.parquet").write_bytes(b"x" * 500)
    (tmp_path / "c.csv").write_bytes(b"x")
    rows = {r.file_name: r for r in R.landing_files(spark, str(tmp_path), max_bytes=100).collect()}
    assert rows["a.parquet"].reject_reason is None
    assert "larger" in rows["b.parquet"].reject_reason and "parquet" in rows["c.csv"].reject_reason


def test_logs(spark, tmp_path):
    lines = [json.dumps({"level": lv, "message": m, "timestamp": t}) for lv, m, t in (("error", "a", "2025-01-01"), ("info", "error b", "2025-01-02"), ("error", "c", "2025-01-03"))]
    (tmp_path / "l.log").write_text("\n".join([*lines, "plain ERROR text", ""]))
    assert [r.message for r in R.read_logs(spark, str(tmp_path), "error").collect()] == ["c", "a", "plain ERROR text"]
    assert [r.message for r in R.read_logs(spark, str(tmp_path), "error", 1).collect()] == ["c"]
    assert len(R.read_logs(spark, str(tmp_path)).collect()) == 4


def test_reports_are_saved_listed_fetched_and_exported(spark, tmp_path):
    path = str(tmp_path / "r")
    flagged = anomaly.with_range_flag(readings(spark, SAMPLE)).withColumnRenamed("is_range", "anomalous_reading")
    K.save_report(reports.quality_report(flagged), path, "quality_1")
    K.save_report(reports.coverage_report(flagged), path, "coverage_2")
    listed = {r.report_id: r for r in R.report_catalog(spark, path).collect()}
    assert {k: r.type for k, r in listed.items()} == {"quality_1": "Quality Report", "coverage_2": "Coverage Report"}
    assert listed["quality_1"].file_path.endswith("/r/quality_1") and listed["quality_1"].file_size_mb > 0
    assert R.read_report(spark, path, "quality_1", "metrics").count() == 8
    with pytest.raises(ValueError, match="Report none_1 not found"):
        R.read_report(spark, path, "none_1")
    K.export_report(spark, path, "quality_1", str(tmp_path / "q"), "csv")
    head = spark.read.text(str(tmp_path / "q")).first().value
    assert head == "metric,reading_type,sensor_id,value,timestamp"
    K.export_report(spark, path, "coverage_2", str(tmp_path / "c"), "csv")
    assert spark.read.option("header", True).csv(str(tmp_path / "c")).columns == ["report_id", "generated_at", "type"]
    K.export_report(spark, path, "coverage_2", str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j" / "coverage")).count() == 3
    with pytest.raises(ValueError, match="Unsupported export format"):
        K.export_report(spark, path, "quality_1", str(tmp_path / "z"), "pdf")


def test_report_sections_run(spark, tmp_path):
    rows = [("S%d" % (i % 3), f"2025-07-{1 + i // 24:02d}T{i % 24:02d}:00:00", ("temperature", "humidity")[i % 2], 20.0 + i % 5) for i in range(96)]
    rows.append(("S1", "2025-07-04T23:30:00", "temperature", 99.0))
    flagged = anomaly.classify(readings(spark, rows)).withColumn("anomalous_reading", F.col("is_range"))
    kinds = {
        "anomaly_1": reports.anomaly_report(flagged),
        "analytics_1": reports.analytics_report(flagged, [("temperature", "humidity")]),
        "summary_1": reports.summary_report(flagged),
    }
    for name, sections in kinds.items():
        K.save_report(sections, str(tmp_path), name)
    top = R.read_report(spark, str(tmp_path), "anomaly_1", "top_anomalies").first()
    assert (top.sensor_id, top.value, top.expected_range) == ("S1", 99.0, "-10.0-50.0")
    assert R.report_catalog(spark, str(tmp_path)).count() == 3


def test_quality_metrics(spark):
    df = readings(spark, [("S1", "2025-07-16T10:00:00", "t", v) for v in (25.5, None, 150.0, 65.0)])
    q = reports.quality_metrics(df).first()
    assert (q.total_records, q.missing_values, q.outliers, q.completeness) == (4, 1, 1, 0.75)
    assert q.accuracy_rate == pytest.approx(2 / 3)
    empty = reports.quality_metrics(df.limit(0)).first()
    assert all(v == 0 for v in empty)


def test_issue_rows(spark):
    df = readings(spark, [("S1", "2025-07-16T10:00:00", "t", None), ("S1", "2025-07-16T10:00:00", "t", 999.0), ("", "2025-07-16T10:00:00", "t", 1.0)])
    assert sorted(r.type for r in reports.issue_rows(df).collect()) == ["missing_sensor_id", "missing_value", "outlier"]


def test_alerts_and_recommendations(spark):
    rows = [("S1", f"2025-07-16T{h:02d}:00:00", "temperature", None if h < 12 else 20.0) for h in range(24)]
    rows += [("S2", f"2025-07-16T{h:02d}:00:00", "humidity", 200.0 if h < 3 else 50.0) for h in range(24)]
    flagged = anomaly.with_range_flag(readings(spark, rows)).withColumnRenamed("is_range", "anomalous_reading")
    found = {(r.type, r.severity) for r in reports.alerts(flagged).collect()}
    assert found == {("missing_data", "high"), ("anomaly", "medium")}
    advice = {(r.sensor_id, r.category, r.priority) for r in reports.recommendations(flagged).collect()}
    assert advice == {("S1", "connectivity", "high"), ("S2", "calibration", "medium")}
    outliers = readings(spark, [("S3", f"2025-07-16T{h:02d}:00:00", "humidity", 50.0 + h) for h in range(8)]).withColumn("anomalous_reading", F.col("value") > 54)
    assert [(r.category, r.priority) for r in reports.recommendations(outliers).collect()] == [("validation", "low")]
    quiet = reports.alerts(flagged.where("value = 20")).collect()
    assert [r.message for r in quiet] == ["All sensors operating normally"]
    nothing = reports.alerts(flagged.limit(0)).collect()
    assert [r.type for r in nothing] == ["status"]


def test_process_and_store(spark, tmp_path):
    records = [
        {"sensor_id": "S1", "reading_type": "temperature", "value": "invalid_value", "timestamp": "2025-07-16T10:00:00Z"},
        {"value": 20.0},
        {"sensor_id": "S1", "reading_type": "Temperature", "value": "25.5", "timestamp": "2025-07-16T10:00:00Z"},
    ]
    strict = batch.process_and_store(R.records(spark, records), str(tmp_path / "s"), strict=True)
    assert (strict["processed"], strict["stored"], strict["passed"], strict["failed"]) == (1, 1, 1, 2)
    lenient = batch.process_and_store(R.records(spark, records), str(tmp_path / "l"))
    assert (lenient["processed"], lenient["passed"], lenient["failed"], lenient["errors"]) == (3, 1, 2, 4)
    empty = batch.process_and_store(R.records(spark, []), str(tmp_path / "e"))
    assert (empty["processed"], empty["stored"], empty["passed"], empty["failed"]) == (0, 0, 0, 0)
    with pytest.raises(ValueError):
        batch.process_and_store(None, str(tmp_path / "n"))


def test_batch_run_counts(spark, tmp_path):
    rows = readings(spark, SAMPLE + [SAMPLE[1]] + [("", "2025-07-16T10:00:00", "t", 1.0)])
    raw, out = str(tmp_path / "raw"), str(tmp_path / "out")
    adapters.land_parquet(rows.coalesce(2), raw)
    run = batch.run_batch(spark, raw, out)
    assert (run["records_read"], run["records_ingested"], run["records_skipped"]) == (6, 5, 1)
    assert (run["duplicates_removed"], run["records_stored"], run["invalid_records"]) == (1, 3, 2)
    assert run["records_broken"] == 0 and run["files_processed"] >= 1
    stored = R.read_readings(spark, out)
    assert stored.count() == 3 and stored.where("calibrated_value IS NULL").count() == 0
    filled = batch.run_batch(spark, raw, str(tmp_path / "out2"), fill="forward", profile="code")
    assert filled["records_stored"] == 4


def test_incremental_load_equals_batch(spark, tmp_path):
    raw, table, seen, out = (str(tmp_path / n) for n in ("raw", "table", "seen", "avg"))
    day = {d: readings(spark, [(f"S{i % 4}", f"2025-07-{d:02d}T{i % 24:02d}:{i // 24:02d}:00", "t", float(i)) for i in range(120)]).withColumn("id", F.col("id") + d * 1000) for d in (1, 2, 3)}
    touched = []
    for d in (1, 2):
        adapters.land_parquet(day[d], raw)
    load = dict(fill="keep", profile=None)
    batch.run_incremental(spark, raw, table, seen, **load, on_dates=touched.append)
    assert R.read_readings(spark, table).count() == 240
    incremental.refresh_daily_averages(spark, table, out, sorted({x for t in touched for x in t}))
    # The third file brings one late row of day 2 and a copy of day 1.
    late = readings(spark, [("S9", "2025-07-02T23:59:00", "t", 7.0)]).withColumn("id", F.lit(9999))
    adapters.land_parquet(day[3].union(late).union(day[1].withColumn("id", F.col("id") + 50000)), raw)
    touched.clear()
    batch.run_incremental(spark, raw, table, seen, **load, on_dates=touched.append)
    assert R.read_readings(spark, table).count() == 361
    batch.run_incremental(spark, raw, table, seen, **load)
    assert R.read_readings(spark, table).count() == 361
    incremental.refresh_daily_averages(spark, table, out, sorted({x for t in touched for x in t}))
    want = TS.rolling_average(cleaning.drop_duplicates(day[1].union(day[2]).union(day[3]).union(late)))
    key = lambda r: (r.sensor_id, str(r.date))
    got = {key(r): round(r.rolling_avg, 9) for r in spark.read.parquet(out).collect()}
    assert got == {key(r): round(r.rolling_avg, 9) for r in want.collect()}
    # A forced reprocess is a fresh checkpoint: the table stays as it is.
    batch.run_incremental(spark, raw, table, str(tmp_path / "again"), **load)
    assert sorted(r.id for r in R.read_readings(spark, table).collect())[:3] == [1001, 1002, 1003]
    assert R.read_readings(spark, table).count() == 361


def test_incremental_run_cleans_and_enriches_sub_folders(spark, tmp_path):
    raw, table = str(tmp_path / "raw"), str(tmp_path / "table")
    rows = readings(spark, [("S1", "2025-07-01T01:00:00", "temperature", 20.0), ("S1", "2025-07-01T02:00:00", "temperature", 900.0), ("S1", "2025-07-01T03:00:00", "temperature", None)])
    adapters.land_parquet(rows, raw)
    adapters.land_parquet(rows.withColumn("timestamp", F.col("timestamp") + F.expr("interval 1 day")), raw + "/july/more")
    batch.run_incremental(spark, raw, table, str(tmp_path / "seen"), bytes_per_batch=1)
    stored = R.read_readings(spark, table)
    assert stored.count() == 4 and stored.where("calibrated_value is null").count() == 0
    assert [r.value for r in stored.where("anomalous_reading").collect()] == [900.0, 900.0]


def test_side_columns_never_cost_a_json_row(spark, tmp_path):
    record = {"sensor_id": "S1", "timestamp": "2025-07-16T10:00:00Z", "reading_type": "temperature", "value": 1}
    batteries = [87.5, "42", "junk", None, 90]
    rows = [{**record, "sensor_id": f"S{i}", "battery_level": b} for i, b in enumerate(batteries)]
    (tmp_path / "a.json").write_text(json.dumps(rows))
    landed = R.read_landing(spark, str(tmp_path))
    got = {r.sensor_id: r.battery_level for r in R.ingest(landed).collect()}
    assert got == {"S0": 88, "S1": 42, "S2": None, "S3": None, "S4": 90}
    assert R.ingest_summary(landed).first().processed == len(got)


def test_a_second_batch_keeps_what_the_first_stored(spark, tmp_path):
    from tidemark.plans.batch import run_batch

    def folder(name, day):
        (tmp_path / name).mkdir()
        record = {"sensor_id": "S1", "reading_type": "temperature", "value": 20.5}
        rows = [{**record, "timestamp": f"2025-07-{day}T{h:02}:00:00Z"} for h in range(3)]
        (tmp_path / name / "a.json").write_text(json.dumps(rows))
        return str(tmp_path / name)

    for name, day in (("one", 16), ("two", 17), ("again", 16)):
        assert run_batch(spark, folder(name, day), str(tmp_path / "table"))["records_stored"] == 3
    assert R.read_readings(spark, str(tmp_path / "table")).count() == 6


def test_updates_need_unique_ids(spark, tmp_path):
    updates = spark.createDataFrame([(1, 2.0), (1, 3.0)], "id long, value double")
    with pytest.raises(ValueError):
        K.update_readings(spark, str(tmp_path / "none"), updates)
