"""Filters, paging, directories, summaries and daily figures on golden inputs."""

import random

import pytest
from helpers import at, plan, readings
from pyspark.sql import functions as F

from tidemark.operators import aggregates as A
from tidemark.operators import filters


def test_value_range_keeps_only_the_middle(spark):
    df = readings(spark, [("S1", "2025-07-16T10:00:00", "temperature", v) for v in (15.0, 25.0, 35.0, None)])
    assert [r.value for r in filters.filter_readings(df, min_value=20, max_value=30).collect()] == [25.0]


def test_anomaly_filter(spark):
    df = spark.createDataFrame([(1, "S1", 25.0, True), (2, "S2", 26.0, False)], "id long, sensor_id string, value double, anomalous_reading boolean")
    assert [r.id for r in filters.filter_readings(df, anomalous=True).collect()] == [1]
    assert [r.id for r in filters.filter_readings(df, anomalous=False).collect()] == [2]


def test_absent_filters_keep_everything_and_unknown_ones_are_ignored(spark):
    df = readings(spark, [("S1", "2025-07-16T10:00:00", "temperature", 0.0)])
    assert filters.filter_readings(df, colour="red").count() == 1


def test_time_range_is_inclusive_and_prunes_the_date_partition(spark, tmp_path):
    df = readings(spark, [("S1", f"2025-07-{d:02d}T10:00:00", "temperature", 1.0) for d in range(1, 11)])
    df.withColumn("date", F.to_date("timestamp")).write.partitionBy("date").parquet(str(tmp_path / "t"))
    table = spark.read.parquet(str(tmp_path / "t"))
    out = filters.time_range(table, "2025-07-03T10:00:00", "2025-07-05T10:00:00")
    assert out.count() == 3
    assert filters.time_range(table, at("2025-07-03T10:00:00"), at("2025-07-05T10:00:00")).count() == 3
    text = plan(out)
    assert "PartitionFilters: [isnotnull(date" in text and "PushedFilters: [IsNotNull(timestamp)" in text


def test_directory(spark):
    df = readings(
        spark,
        [
            ("S1", "2025-07-16T10:00:00", "temperature", 25.0, "field_1"),
            ("S1", "2025-07-16T11:00:00", "humidity", 60.0, ""),
            ("S1", "2025-07-16T10:30:00", "humidity", 60.0, "field_1"),
            ("S2", "2025-07-16T10:30:00", "temperature", 24.0, "field_2"),
        ],
    )
    rows = {r.sensor_id: r for r in A.sensor_directory(df).collect()}
    assert len(rows) == 2
    assert rows["S1"].reading_types == ["humidity", "temperature"]
    assert rows["S1"].fields == ["field_1"]
    assert rows["S1"].latest_reading == at("2025-07-16T11:00:00") and rows["S1"].total_readings == 3


def test_sensor_summary_and_empty_summary(spark):
    df = readings(
        spark,
        [("S1", "2025-07-16T10:00:00", "temperature", 25.0), ("S1", "2025-07-16T11:00:00", "temperature", 26.0),
         ("S1", "2025-07-16T12:00:00", "temperature", None), ("S1", "2025-07-16T12:00:00", "humidity", None)],
    )
    one = A.sensor_summary(df, "S1").first()
    assert (one.total_readings, one.reading_types) == (4, ["humidity", "temperature"])
    (stats,) = A.summary_by_type(df).collect()
    assert (stats["count"], stats["min"], stats["max"], stats.avg) == (2, 25.0, 26.0, 25.5)
    assert stats.latest_value is None and stats.latest_timestamp == at("2025-07-16T12:00:00")
    none = A.sensor_summary(df, "S9").first()
    assert (none.total_readings, none.reading_types, none.first_reading) == (0, [], None)


def test_daily_aggregation(spark):
    df = readings(
        spark,
        [("S1", "2025-07-16T10:00:00", "temperature", 25.0), ("S1", "2025-07-16T11:00:00", "temperature", 26.0),
         ("S1", "2025-07-17T10:00:00", "temperature", 24.0), ("S1", "2025-07-17T11:00:00", "temperature", None)],
    )
    first, second = A.daily_aggregation(df).orderBy("date").collect()
    assert (first["count"], first["min"], first["max"], first.avg, first["sum"]) == (2, 25.0, 26.0, 25.5, 51.0)
    assert (second["count"], second.avg) == (2, 24.0)


def test_pages_cover_the_whole_set_once(spark):
    rng = random.Random(7)
    rows = [("S%d" % rng.randrange(5), f"2025-07-{rng.randrange(1, 28):02d}T10:00:00", "temperature", float(i % 9)) for i in range(230)]
    df = readings(spark, rows)
    for by, order in (("timestamp", "desc"), ("value", "asc"), ("sensor_id", "desc")):
        whole = [r.id for r in df.orderBy(*filters.sort_keys(by, order)).collect()]
        shallow = [r.id for p in range(1, 4) for r in filters.page(df, p, 100, by, order).collect()]
        deep = [r.id for p in range(1, 4) for r in filters.page(df, p, 100, by, order, top_k_rows=0).collect()]
        assert shallow == whole and deep == whole


def test_deep_page_with_null_sort_values(spark):
    df = readings(spark, [("S1", "2025-07-16T10:00:00", "temperature", None if i % 3 else float(i)) for i in range(60)])
    want = [r.id for r in filters.page(df, 2, 25, "value", "asc").collect()]
    assert [r.id for r in filters.page(df, 2, 25, "value", "asc", top_k_rows=0).collect()] == want


def test_page_totals(spark):
    df = readings(spark, [("S1", "2025-07-16T10:00:00", "temperature", 1.0)] * 101)
    assert filters.page_totals(df, 1, 100).first()["pages"] == 2
    assert filters.offset_totals(df, 100, 0).first().has_more is True
    assert filters.offset_totals(df, 100, 1).first().has_more is False


@pytest.mark.parametrize(
    "bad",
    [{"reading_type": "ph_level"}, {"start": "2025/07/01"}, {"page": 0}, {"limit": 1001}, {"limit": 0}, {"sort_by": "unit"}, {"sort_order": "up"}],
)
def test_bad_arguments_are_refused(bad):
    with pytest.raises(ValueError):
        filters.check_arguments(**bad)


def test_newest_first_is_a_top_k_plan(spark):
    df = readings(spark, [("S1", f"2025-07-16T10:{m:02d}:00", "temperature", 1.0) for m in range(50)])
    top = filters.newest_first(df, 10)
    assert "TakeOrderedAndProject" in plan(top)
    assert [r.id for r in top.collect()] == list(range(50, 40, -1))


def test_table_stats_has_total_and_types(spark):
    df = readings(spark, [("S1", "2025-07-16T10:00:00", k, 1.0) for k in ("temperature", "temperature", "humidity")])
    rows = {(r.is_total, r.reading_type): r.readings for r in A.table_stats(df).collect()}
    assert rows == {(True, None): 3, (False, "temperature"): 2, (False, "humidity"): 1}


def test_statistics_and_median_by_rank(spark):
    df = readings(spark, [("S1", "2025-07-16T10:00:00", "temperature", v) for v in (20.0, 25.0, 30.0, 22.0, 28.0, None)])
    for bound in (100, 0):
        row = A.statistics(df, max_rows=bound).first()
        assert (row["count"], row["mean"], row["median"], row["min"], row["max"]) == (5, 25.0, 25.0, 20.0, 30.0)
        assert row.std_dev == pytest.approx(17**0.5)


def test_median_of_a_group_spread_over_many_files(spark):
    rng = random.Random(3)
    rows = [("HOT" if rng.random() < 0.4 else "S%d" % rng.randrange(30), "2025-07-16T10:00:00", "temperature", float(rng.randrange(50)) if rng.random() < 0.9 else None) for _ in range(2000)]
    df = readings(spark, rows)
    want = {r.sensor_id: r.median for r in A.median(df, ["sensor_id"]).collect()}
    got = {r.sensor_id: r.median for r in A.median(df, ["sensor_id"], max_rows=0).collect()}
    assert got == want


def test_trend_labels(spark):
    rows = [("S1", f"2025-07-16T{h:02d}:00:00", "temperature", 20 + 0.5 * h) for h in range(10)]
    rows += [("S2", f"2025-07-16T{h:02d}:00:00", "temperature", 5.0) for h in range(10)]
    out = {r.sensor_id: r for r in A.trend(readings(spark, rows)).collect()}
    assert out["S1"].slope == pytest.approx(0.5) and out["S1"].correlation == pytest.approx(1.0)
    assert (out["S1"].direction, out["S1"].strength) == ("increasing", "strong")
    assert out["S2"].direction == "stable"


def test_custom_report_checks_metrics(spark):
    df = readings(spark, [("S1", "2025-07-16T10:00:00", "temperature", 1.0), ("S2", "2025-07-16T12:00:00", "temperature", 3.0)])
    row = A.custom_report(df, ["average", "maximum"], "daily", ["S1", "S2"]).first()
    assert (row.average, row.maximum) == (2.0, 3.0)
    with pytest.raises(ValueError):
        A.custom_report(df, ["unknown"])
    with pytest.raises(ValueError):
        A.custom_report(df, ["average"], "never")


def test_profile_counts_nulls_and_distinct(spark):
    df = readings(spark, [("S1", "2025-07-16T10:00:00", "temperature", v) for v in (1.0, None, 2.0, 2.0)])
    rows = {r.column_name: r for r in A.profile(df, exact=True).collect()}
    assert (rows["value"].nulls, rows["value"].distinct_values, rows["value"].max_value) == (1, 2, "2.0")
    assert rows["value"].column_type == "double"
