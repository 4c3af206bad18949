"""Pages, ranks and slices over repeated rows and hot values; records without optional columns."""

import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from tidemark.operators import aggregates as A
from tidemark.operators import filters
from tidemark.operators.layout import COPIES, counted_layout
from tidemark.plans import batch
from tidemark.sources import readers as R

SHAPE = "id long, sensor_id string, timestamp timestamp_ntz, reading_type string, value double"


def repeated_rows(spark):
    """Few times and ids, so most rows tie; some rows are equal in all columns, some lack id, time or value."""
    pick = random.Random(5)
    times = [datetime(2025, 7, 1) + timedelta(hours=h) for h in range(3)] + [None]
    rows = [
        (pick.choice([1, 2, 3, None]), "S1", pick.choice(times), "humidity", pick.choice([1.0, 2.0, None]))
        for _ in range(120)
    ]
    return spark.createDataFrame(rows, SHAPE)


def test_both_page_plans_agree_on_ties(spark):
    df = repeated_rows(spark).cache()
    seen = []
    for offset in range(0, 125, 25):
        top = [tuple(r) for r in filters.offset_page(df, 25, offset).collect()]
        deep = [tuple(r) for r in filters.offset_page(df, 25, offset, top_k_rows=0).collect()]
        assert deep == top
        seen += deep
    assert len(seen) == 120
    assert sorted(map(str, seen)) == sorted(str(tuple(r)) for r in df.collect())
    assert filters.offset_page(df.limit(0), 25, 0, top_k_rows=0).collect() == []


def test_median_of_a_hot_value(spark):
    rows = spark.range(20_000).select(
        F.when(F.col("id") % 3 == 0, "a").when(F.col("id") % 3 == 1, "b").alias("kind"),
        F.when(F.col("id") % 10 > 0, 7.0).otherwise(F.col("id").cast("double")).alias("value"),
    )
    by_rank = {r.kind: r.median for r in A.median(rows, ["kind"], max_rows=0).collect()}
    assert by_rank == {r.kind: r.median for r in A.median(rows, ["kind"]).collect()}
    assert A.median(rows, max_rows=0).first()[0] == A.median(rows).first()[0]
    layout = counted_layout(rows, [])
    assert layout.where("value = 7.0").count() == 3
    assert layout.agg(F.sum(COPIES)).first()[0] == 20_000


def test_repeated_log_lines(spark, tmp_path):
    lines = ["same line"] * 40 + [f"line {i}" for i in range(10)] + ['{"level":"error","message":"m","timestamp":"t"}'] * 5
    spark.createDataFrame([(x,) for x in lines], "value string").write.text(str(tmp_path / "logs"))
    entries = R.read_logs(spark, str(tmp_path / "logs"), lines=None)
    keys = [F.col("timestamp").desc_nulls_last(), F.col("message").desc()]
    for limit, offset in ((7, 0), (30, 3), (100, 20)):
        top = filters.ordered_slice(entries, keys, limit, offset).collect()
        assert filters.ordered_slice(entries, keys, limit, offset, top_k_rows=0).collect() == top


def test_order_by_expression(spark, tmp_path):
    spark.createDataFrame([(1, 5.0), (2, None), (3, -9.0)], "id long, value double").write.parquet(str(tmp_path / "t"))
    rows = R.read_parquet(spark, str(tmp_path / "t"), order_by="coalesce(abs(value), 7) desc, id")
    assert [r.id for r in rows.collect()] == [3, 2, 1]
    rows = R.read_parquet(spark, str(tmp_path / "t"), order_by="value desc nulls first", limit=2)
    assert [r.id for r in rows.collect()] == [2, 1]


def test_flat_records_and_bad_times(spark, tmp_path):
    shape = "sensor_id string, reading_type string, value string, timestamp string"
    rows = [("S1", "humidity", "5", "not a time"), ("S1", "humidity", "6", None), ("S1", "humidity", "7", "2025-07-01T00:00:00Z")]
    done = batch.process_and_store(spark.createDataFrame(rows, shape), str(tmp_path / "t"))
    assert (done["stored"], done["passed"], done["failed"]) == (2, 1, 2)
    assert {r.value for r in R.read_readings(spark, str(tmp_path / "t")).collect()} == {6.0, 7.0}


def test_names_with_blanks_are_read(spark, tmp_path):
    spark.range(3).select(F.lit("S").alias("sensor_id")).coalesce(1).write.parquet(str(tmp_path / "w"))
    part = next((tmp_path / "w").glob("*.parquet"))
    (tmp_path / "in").mkdir()
    for name in ("good file.parquet", "a+b%20c.parquet"):
        (tmp_path / "in" / name).write_bytes(part.read_bytes())
    raw = R.read_raw_parquet(spark, str(tmp_path / "in"))
    assert R.unread_files(spark, str(tmp_path / "in"), raw).collect() == []
