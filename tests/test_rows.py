"""Row functions and validity rules: zero, blank, null and text edge cases."""

import pytest
from helpers import at, readings
from pyspark.sql import functions as F

from tidemark.functions import scalar as S
from tidemark.functions.validity import error_list, split_valid, validity, with_errors
from tidemark.operators import aggregates as A
from tidemark.plans import batch
from tidemark.schema import require_columns
from tidemark.sources import readers as R


def one(spark, expression, **columns):
    df = spark.range(1).select(*[F.lit(v).alias(k) for k, v in columns.items()], F.lit(0).alias("_"))
    return df.select(expression.alias("x")).first().x


def test_rounding_goes_up_on_ties(spark):
    assert one(spark, S.round_half_up(F.lit(-0.125))) == -0.12
    assert one(spark, S.round_half_up(F.lit(0.125))) == 0.13
    assert one(spark, S.round_half_up(F.lit(1e300))) == 1e300


@pytest.mark.parametrize(
    "kind,value,expected",
    [("temperature", 25.5, 25.51), ("humidity", 200.0, 100.0), ("humidity", -50.0, 0.0), ("soil_moisture", 7.7, 7.7), ("humidity", None, None)],
)
def test_calibration_by_code(spark, kind, value, expected):
    df = spark.createDataFrame([(kind, value)], "reading_type string, value double")
    assert batch.calibrate(df, "code").first().calibrated_value == expected


def test_calibration_falls_back_to_the_sensor_type(spark):
    df = spark.createDataFrame([(None, "temperature", 25.5), ("", "humidity", 200.0)], "reading_type string, sensor_type string, value double")
    got = [r.x for r in df.select(S.calibrate_by_code(sensor_type="sensor_type").alias("x")).collect()]
    assert got == [25.51, 100.0]


def test_calibration_by_config_keeps_unknown_types(spark):
    rows = [("soil_moisture", 50.0), ("light_intensity", 100.0), ("ph_level", 7.0), ("soil_moisture", None)]
    df = spark.createDataFrame(rows, "reading_type string, value double")
    got = {(r.reading_type, r.value): r.calibrated_value for r in batch.calibrate(df).collect()}
    assert got == {("soil_moisture", 50.0): 55.0, ("light_intensity", 100.0): 105.0, ("ph_level", 7.0): 7.0, ("soil_moisture", None): None}


def test_quality_score(spark):
    df = readings(
        spark,
        [("S1", "2025-07-16T10:00:00", "t", 1.0, "f", 80), ("S1", "2025-07-16T10:00:00", "t", None, "f", 10),
         ("", None, "t", None, "f", 0), ("S1", "2025-07-16T10:00:00", "t", 0.0, "f", None), ("S1", "2025-07-16T10:00:00", "t", 0.0, "f", 20)],
    )
    assert [r.x for r in df.select(S.quality_score().alias("x")).collect()] == [100.0, 60.0, 25.0, 100.0, 100.0]


def test_hard_limits(spark):
    df = spark.createDataFrame([(v,) for v in (-100.5, 1000.5, -100.0, 1000.0, None)], "value double")
    assert [r.x for r in df.select(S.outside_hard_limits().alias("x")).collect()] == [True, True, False, False, False]


def test_number_text(spark):
    df = spark.createDataFrame([("25.5",), (" 7 ",), ("invalid_value",), ("",), (None,), ("0",)], "value string")
    assert [r.x for r in df.select(S.to_number("value").alias("x")).collect()] == [25.5, 7.0, None, None, None, 0.0]


def test_timestamps(spark):
    rows = [("2025-07-16T10:00:00Z",), ("2025-07-16",), ("2025-07-16T10:00:00+05:30",), ("invalid_timestamp",), ("",), (None,)]
    df = spark.createDataFrame(rows, "t string")
    got = [r.x for r in df.select(S.to_timestamp_ntz("t").alias("x")).collect()]
    assert got == [at("2025-07-16T10:00:00"), at("2025-07-16T00:00:00"), at("2025-07-16T04:30:00"), None, None, None]
    assert [r.x for r in df.select(S.is_iso_timestamp("t").alias("x")).collect()] == [True, True, True, False, False, False]


def test_local_time_and_texts(spark):
    df = readings(spark, [("S1", "2025-07-16T20:00:00.123456", "t", 1.0)])
    row = df.select(S.to_local_time().alias("l"), S.date_text().alias("d"), S.iso_text().alias("i")).first()
    assert (row.l, row.d, row.i) == (at("2025-07-17T01:30:00.123456"), "2025-07-16", "2025-07-16T20:00:00.123Z")


def test_day_list(spark):
    days = one(spark, S.days_between(F.lit("2025-07-30"), F.lit("2025-08-02")))
    assert [d.isoformat() for d in days] == ["2025-07-30", "2025-07-31", "2025-08-01", "2025-08-02"]


def test_file_date_and_report_type(spark):
    df = spark.createDataFrame([("2025-07-16.parquet", "quality_1"), ("export.parquet", "other_1")], "n string, report_id string")
    rows = df.select(S.file_date("n").alias("d"), F.current_date().alias("today"), S.report_type().alias("t")).collect()
    assert rows[0].d.isoformat() == "2025-07-16" and rows[1].d == rows[1].today
    assert [r.t for r in rows] == ["Quality Report", "Unknown"]


def test_location_is_flattened_with_fallback(spark):
    shape = "field string, location struct<field: string, latitude: double, longitude: double>"
    df = spark.createDataFrame([("top", ("inner", 1.0, 2.0)), ("top", None), ("top", (None, 0.0, 0.0))], shape)
    got = [(r.field, r.latitude) for r in S.flatten_location(df).collect()]
    assert got == [("inner", 1.0), ("top", None), ("top", 0.0)]


RECORDS = [
    {"sensor_id": "S1", "reading_type": "Temperature", "value": "25.5", "timestamp": "2025-07-16T10:00:00Z", "extra_field": 1},
    {"sensor_id": "S1", "reading_type": "temperature", "value": "invalid_value", "timestamp": "2025-07-16T10:00:00Z"},
    {"sensor_id": "", "reading_type": "temperature", "value": 25.5, "timestamp": "2025-07-16T10:00:00Z"},
    {"value": 20.0},
    {"sensor_id": "S1", "reading_type": "temperature", "value": None, "timestamp": "invalid_timestamp"},
]


def test_error_lists(spark):
    rows = R.records(spark, RECORDS)
    got = [r.e for r in rows.select(error_list(rows).alias("e")).collect()]
    assert got == [
        [],
        ["value must be numeric"],
        ["Missing required field: sensor_id"],
        ["Missing required field: sensor_id", "Missing required field: reading_type", "Missing required field: timestamp"],
        ["Missing required field: value", "Invalid timestamp format"],
    ]


def test_sensor_id_must_be_text(spark):
    df = spark.createDataFrame([(7, "t", 1.0, "2025-07-16")], "sensor_id int, reading_type string, value double, timestamp string")
    assert with_errors(df).first().errors == ["Sensor ID must be a string"]


def test_rule_sets_differ(spark):
    shape = "sensor_id string, timestamp string, reading_type string, value string, battery_level int"
    rows = [
        ("S1", "2025-07-16", "temperature", None, 50),
        ("S1", "junk", "temperature", "1", 50),
        ("S1", "2025-07-16", "ph_level", "1", 50),
        ("S1", "2025-07-16", "temperature", "1", 101),
        ("S1", "2025-07-16", "temperature", "1", 50),
    ]
    df = spark.createDataFrame(rows, shape)
    got = {n: [r.x for r in df.select(validity(df, n).alias("x")).collect()] for n in ("ingest", "basic", "pipeline", "strict")}
    assert got == {
        "ingest": [True, False, True, True, True],
        "basic": [False, True, True, True, True],
        "pipeline": [False, False, True, True, True],
        "strict": [False, False, False, False, True],
    }
    with pytest.raises(ValueError):
        validity(df, "none")


def test_strict_mode_drops_and_lenient_mode_keeps(spark):
    rows = R.records(spark, RECORDS)
    assert [f.count() for f in split_valid(rows, strict=True)] == [1, 4]
    assert [f.count() for f in split_valid(rows)] == [5, 4]


def test_transformed_record(spark):
    out, _ = batch.process_records(R.records(spark, RECORDS[:1]))
    row = out.first()
    assert (row.value, row.reading_type, row.processing_version, row.anomalous_reading) == (25.5, "temperature", "2.0", False)
    assert "extra_field" not in out.columns


def test_counters(spark):
    assert A.validation_counters(R.records(spark, RECORDS)).first().asDict() == {"processed": 5, "passed": 1, "failed": 4, "errors": 7}
    empty = R.records(spark, [])
    assert A.validation_counters(empty).first().asDict() == {"processed": 0, "passed": 0, "failed": 0, "errors": 0}
    assert A.validation_totals(empty).first().quality_score == 0.0
    with pytest.raises(ValueError):
        R.records(spark, None)


def test_required_columns():
    assert require_columns(["sensor_id", "timestamp", "reading_type", "value", "x"])
    with pytest.raises(ValueError, match="Missing required column: reading_type"):
        require_columns(["sensor_id", "timestamp"])
