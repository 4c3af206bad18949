"""Every operator on frames without rows, without values, and with constant values."""

import pytest
from helpers import plan, readings
from pyspark.sql import functions as F

from tidemark.operators import aggregates as A
from tidemark.operators import anomaly, cleaning, filters
from tidemark.operators import timeseries as TS
from tidemark.operators.lookup import measured, with_rules
from tidemark.plans import batch, reports
from tidemark.sources import readers as R

DAYS = [f"2025-07-{d:02d}T10:00:00" for d in range(1, 6)]
MIXED = [
    *[("NO VALUES", t, "temperature", None) for t in DAYS],
    *[("CONSTANT", t, "temperature", 5.0) for t in DAYS],
    ("ONE ROW", DAYS[0], "ph_level", 7.0),
    *[("ONE TIME", DAYS[0], "humidity", float(v)) for v in range(5)],
    (None, "2025-07-16T10:00:00", None, 1.0),
    (None, "2025-07-16T15:00:00", None, 2.0),
]
FRAMES = {"empty": [], "mixed": MIXED}
OPERATORS = {
    "page": lambda d: filters.page(d, 2, 2),
    "deep page": lambda d: filters.page(d, 2, 2, top_k_rows=0),
    "page totals": filters.page_totals,
    "directory": A.sensor_directory,
    "summary by type": A.summary_by_type,
    "daily": A.daily_aggregation,
    "statistics": A.statistics,
    "median by rank": lambda d: A.median(d, ["sensor_id"], max_rows=0),
    "trend": A.trend,
    "correlations": lambda d: A.type_correlations(d, [("temperature", "humidity")]),
    "custom": lambda d: A.custom_report(d, ["average", "trend", "count"]),
    "profile": A.profile,
    "rolling": TS.rolling_average,
    "gaps": TS.gaps,
    "coverage": TS.coverage,
    "coverage summary": TS.coverage_summary,
    "spine": TS.hourly_spine,
    "latest": TS.latest_per_series,
    "z-score": anomaly.with_zscore,
    "temporal": anomaly.with_temporal_flag,
    "totals": lambda d: anomaly.anomaly_totals(anomaly.classify(d)),
    "top": lambda d: anomaly.top_anomalies(anomaly.classify(d)),
    "dedup": cleaning.drop_duplicates,
    "fill": cleaning.forward_fill,
    "fill by file": lambda d: cleaning.forward_fill(d, series_rows=0),
    "quality metrics": reports.quality_metrics,
    "quality rows": lambda d: reports.quality_rows(d, "flag"),
    "alerts": lambda d: reports.alerts(d, "flag"),
    "summary": lambda d: reports.summary(d, "flag"),
    "insights": lambda d: reports.insights(anomaly.classify(d)),
    "enrich": batch.enrich,
}


@pytest.mark.parametrize("frame", FRAMES)
def test_operators_run_on_edge_frames(spark, frame):
    df = readings(spark, FRAMES[frame]).withColumn("flag", F.lit(False))
    for name, op in OPERATORS.items():
        try:
            rows = op(df).collect()
        except Exception as error:
            raise AssertionError(f"{name} fails on {frame}: {str(error)[:600]}") from error
        if name in ("page totals", "quality metrics", "totals", "coverage summary", "statistics"):
            assert len(rows) == 1, name
        if name in ("z-score", "temporal", "fill", "fill by file", "enrich"):
            assert len(rows) == len(FRAMES[frame]), name


def test_values_on_edge_series(spark):
    df = readings(spark, MIXED)
    trends = {r.sensor_id: r for r in A.trend(df).collect()}
    assert trends["CONSTANT"].direction == "stable" and trends["CONSTANT"].correlation is None
    assert trends["ONE TIME"].slope is None and trends["NO VALUES"].slope is None
    latest = {r.sensor_id: r.latest_value for r in TS.latest_per_series(df).collect()}
    assert latest["NO VALUES"] is None and latest[None] == 2.0
    assert cleaning.drop_duplicates(df).count() == len(MIXED) - 4
    filled = {r.sensor_id: r.value for r in cleaning.forward_fill(df, series_rows=0).collect()}
    assert filled["NO VALUES"] is None and filled["CONSTANT"] == 5.0


def test_text_that_only_looks_like_numbers_and_times(spark):
    df = spark.createDataFrame([("NaN", "T10:00:00"), ("25.5d", "10:00:00"), ("1e3", "2025-07"), ("Infinity", "2025"), ("1", "1:30-08:00"), ("2", "9:00")], "value string, timestamp string")
    rows = R.typed(df).collect()
    assert [r.value for r in rows] == [None, None, 1000.0, float("inf"), 1.0, 2.0]
    assert [str(r.timestamp) for r in rows] == ["None", "None", "2025-07-01 00:00:00", "2025-01-01 00:00:00", "None", "None"]
    nan = spark.createDataFrame([(float("nan"), None)], "value double, timestamp timestamp_ntz")
    assert R.typed(nan).first().value is None


def test_small_tables_start_no_tasks(spark):
    df = readings(spark, MIXED)
    assert "LocalTableScan" in plan(with_rules(df))
    assert "LocalTableScan" in plan(measured(df.groupBy("sensor_id").count()))
