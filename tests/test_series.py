"""Windows over series, anomalies and coverage, checked against plain Python."""

import random
from collections import defaultdict
from datetime import timedelta

import pytest
from helpers import at, plan, readings
from pyspark.sql import functions as F

from tidemark.operators import anomaly, cleaning
from tidemark.operators import timeseries as TS


@pytest.fixture(scope="module")
def skewed(spark):
    """A hot series with a third of the rows, copies of keys, nulls and long pauses."""
    rng = random.Random(11)
    rows = []
    for _ in range(1500):
        sensor = "HOT" if rng.random() < 0.35 else "S%d" % rng.randrange(12)
        time = at("2025-07-01T00:00:00") + timedelta(minutes=rng.randrange(0, 60 * 24 * 12, 7))
        rows.append((sensor, time.isoformat(), rng.choice(["temperature", "humidity"]), None if rng.random() < 0.2 else round(rng.gauss(50, 10), 2)))
    return readings(spark, rows).cache()


def series_of(rows):
    out = defaultdict(list)
    for r in rows:
        out[(r.sensor_id, r.reading_type)].append(r)
    return {k: sorted(v, key=lambda r: (r.timestamp, r.id)) for k, v in out.items()}


def test_dedup_keeps_the_first_id_and_limits_before_the_shuffle(spark, skewed):
    unique = cleaning.drop_duplicates(skewed)
    best = {}
    for r in skewed.collect():
        key = (r.sensor_id, r.timestamp, r.reading_type)
        best[key] = min(best.get(key, r.id), r.id)
    assert sorted(r.id for r in unique.collect()) == sorted(best.values())
    text = plan(cleaning.drop_duplicates(skewed))
    assert "row_number(), 1, Partial" in text and "row_number(), 1, Final" in text
    again = cleaning.drop_duplicates(unique)
    assert again.count() == unique.count()
    counts = cleaning.duplicate_count(skewed).first()
    assert counts.total_rows - counts.unique_rows == counts.duplicates_removed and counts.unique_rows == len(best)


def test_forward_fill_both_ways(spark, skewed):
    want = {}
    for rows in series_of(skewed.collect()).values():
        last = None
        for r in rows:
            last = r.value if r.value is not None else last
            want[r.id] = last
    for bound in (10**6, 0):
        got = {r.id: r.value for r in cleaning.forward_fill(skewed, series_rows=bound).collect()}
        assert got == want


def test_forward_fill_across_files_with_an_all_null_stretch(spark):
    rows = [("S1", (at("2025-07-01T00:00:00") + timedelta(minutes=i)).isoformat(), "t", 5.0 if i == 0 else None) for i in range(400)]
    rows += [("S2", (at("2025-07-01T00:00:00") + timedelta(minutes=i)).isoformat(), "t", None) for i in range(50)]
    got = cleaning.forward_fill(readings(spark, rows), series_rows=0).collect()
    assert {r.value for r in got if r.sensor_id == "S1"} == {5.0}
    assert {r.value for r in got if r.sensor_id == "S2"} == {None}


def test_gaps_match_consecutive_readings(spark, skewed):
    for hours in (1, 3):
        want = []
        for (s, k), rows in series_of(skewed.collect()).items():
            for a, b in zip(rows, rows[1:]):
                if b.timestamp - a.timestamp > timedelta(hours=hours):
                    want.append((s, k, a.timestamp, b.timestamp, (b.timestamp - a.timestamp) // timedelta(hours=1)))
        got = [tuple(r) for r in TS.gaps(skewed, min_gap_hours=hours).collect()]
        assert sorted(got) == sorted(want)


def test_spine_and_missing_hours(spark, skewed):
    rows = skewed.collect()
    lo = min(r.timestamp for r in rows).replace(minute=0, second=0)
    hi = max(r.timestamp for r in rows).replace(minute=0, second=0)
    counts = defaultdict(int)
    for r in rows:
        counts[(r.sensor_id, r.reading_type, r.timestamp.replace(minute=0, second=0))] += 1
    want = {}
    for s, k in series_of(rows):
        h = lo
        while h <= hi:
            want[(s, k, h)] = counts.get((s, k, h), 0)
            h += timedelta(hours=1)
    spine = TS.hourly_spine(skewed).collect()
    assert len(spine) == len(want) and {(r.sensor_id, r.reading_type, r.hour): r.readings for r in spine} == want
    missing = {(r.sensor_id, r.reading_type, r.missing_hour) for r in TS.missing_hours(skewed).collect()}
    assert missing == {k for k, n in want.items() if n == 0}


def test_coverage_golden_percentages(spark):
    def hours(sensor, n):
        return [(sensor, (at("2023-06-01T00:00:00") + timedelta(hours=i)).isoformat(), "temperature", 1.0) for i in range(n)]

    df = readings(spark, hours("S1", 698) + hours("S2", 715))
    got = {r.sensor_id: r for r in TS.coverage(df, "2023-06-01 00:00:00", "2023-06-30 23:00:00").collect()}
    assert (got["S1"].expected_readings, got["S1"].actual_readings, got["S1"].coverage_percentage) == (720, 698, 96.9)
    assert got["S2"].coverage_percentage == 99.3
    total = TS.coverage_summary(df, "2023-06-01 00:00:00", "2023-06-30 23:00:00").first()
    assert total.overall_coverage == 98.1 and total.total_gaps == 0


def test_coverage_never_above_100(spark, skewed):
    assert TS.coverage(skewed).where("coverage_percentage > 100").count() == 0


def test_rolling_average_counts_calendar_days(spark):
    days = {"2025-07-01": 10.0, "2025-07-02": 20.0, "2025-07-09": 40.0}
    df = readings(spark, [("S1", f"{d}T10:00:00", "t", v) for d, v in days.items()])
    got = {r.date.isoformat(): r.rolling_avg for r in TS.rolling_average(df).collect()}
    assert got == {"2025-07-01": 10.0, "2025-07-02": 15.0, "2025-07-09": 40.0}


def test_zscore_small_group(spark):
    df = readings(spark, [("S1", "2025-07-16T10:00:00", "t", v) for v in (20.0, 21.0, 22.0, 9999999.0, 23.0, 24.0)])
    assert anomaly.with_zscore(df, threshold=2.0).where("is_statistical").count() == 1
    assert anomaly.with_zscore(df).where("is_statistical").count() == 0


def test_zscore_of_constant_values_is_null(spark):
    df = readings(spark, [("S1", "2025-07-16T10:00:00", "t", 5.0)] * 20)
    assert {r.zscore for r in anomaly.with_zscore(df).collect()} == {None}


def test_zscore_is_broadcast_when_small_and_shuffled_when_not(spark, skewed):
    small = anomaly.with_zscore(skewed)
    assert "BroadcastHashJoin" in plan(small) and "Window" not in plan(small)
    from tidemark.operators.lookup import join_statistics

    stats = skewed.groupBy("sensor_id").agg(F.avg("value").alias("m"))
    big = join_statistics(skewed, stats, ["sensor_id"], max_rows=3)
    assert big.count() == skewed.count()


def test_temporal_flag_leaves_the_current_day_out(spark):
    rows = [("S1", f"2025-07-{d:02d}T{h:02d}:00:00", "t", 10.0 + (h % 3)) for d in range(1, 8) for h in range(24)]
    rows.append(("S1", "2025-07-08T00:00:00", "t", 500.0))
    out = anomaly.with_temporal_flag(readings(spark, rows))
    assert [r.value for r in out.where("is_temporal").collect()] == [500.0]


def test_classes_add_up(spark, skewed):
    flagged = anomaly.classify(cleaning.drop_missing(cleaning.drop_duplicates(skewed)))
    t = anomaly.anomaly_totals(flagged).first()
    assert t.total_anomalies == t.statistical_outliers + t.range_violations + t.temporal_anomalies
    assert t.total_anomalies == t.low + t.medium + t.high
    parts = anomaly.anomaly_breakdown(flagged).agg(F.sum("anomalies").alias("n")).first().n
    assert (parts or 0) == t.total_anomalies
    assert flagged.count() == t.total_records


def test_top_anomalies_shape(spark):
    rows = [("S1", f"2025-07-{d:02d}T{h:02d}:00:00", "temperature", 20.0 + h % 2) for d in range(1, 4) for h in range(24)]
    rows.append(("S9", "2025-07-03T12:30:00", "temperature", 65.2))
    top = anomaly.top_anomalies(anomaly.classify(readings(spark, rows)), 1).first()
    assert (top.sensor_id, top.expected_range, top.severity) == ("S9", "-10.0-50.0", "high")


@pytest.fixture
def tiny_skew_limits(spark):
    """Lower the AQE limits so that small fixtures show how a skewed join is treated."""
    settings = {
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "2KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "1KB",
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
    }
    old = {k: spark.conf.get(k, None) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    yield
    for k, v in old.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def hot_day(spark):
    hot = [("HOT", f"2025-07-02T10:{i // 60 % 60:02d}:{i % 60:02d}", "t", float(i % 7)) for i in range(3000)]
    cold = [(f"S{i}", "2025-07-02T10:00:00", "t", 1.0) for i in range(200)]
    return readings(spark, hot + cold).repartition(8)


def test_skewed_temporal_join_is_split(spark, tiny_skew_limits):
    """AQE splits the hot day of a hot series instead of leaving it to one task."""
    out = anomaly.with_temporal_flag(hot_day(spark))
    assert len(out.collect()) == 3200
    assert "skew=true" in plan(out)


def test_skewed_join_of_many_statistics_is_split(spark, tiny_skew_limits):
    from tidemark.operators.lookup import join_statistics

    df = hot_day(spark)
    stats = df.groupBy("sensor_id").agg(F.avg("value").alias("m"))
    out = join_statistics(df, stats, ["sensor_id"], max_rows=50)
    assert len(out.collect()) == 3200
    assert "skew=true" in plan(out)


def test_latest_per_series_is_a_hash_aggregate(spark, skewed):
    text = plan(TS.latest_per_series(skewed))
    assert "HashAggregate" in text and "SortAggregate" not in text and "ObjectHash" not in text


def test_statistics_of_large_values_and_of_null_types(spark):
    from datetime import datetime, timedelta

    from tidemark.operators import anomaly, timeseries

    start = datetime(2025, 7, 1)
    data = [("S", "t", start + timedelta(days=d, hours=h), 1e8 + (0.01 if h % 2 else -0.01)) for d in range(9) for h in range(4)]
    df = spark.createDataFrame(data, "sensor_id string, reading_type string, timestamp timestamp_ntz, value double")
    spread = [r.baseline_std for r in timeseries.rolling_baseline(df).orderBy("date").collect()][1:]
    assert all(0.009 < x < 0.012 for x in spread)
    nulls = spark.createDataFrame([(i, None, 10.0 + i % 3 if i else 100_000.0) for i in range(50)], "id int, reading_type string, value double")
    assert anomaly.with_zscore(nulls).where("is_statistical").count() == 1
