"""Stored hour counts, hour masks and sketches: against plain answers, and kept right by loads."""

import random
from datetime import datetime, timedelta

import pytest
from helpers import at, readings
from pyspark.sql import functions as F

from tidemark.operators import filters, masks, pages, sketches
from tidemark.sources import readers as R
from tidemark.sources import writers as K


@pytest.fixture(scope="module")
def rows(spark):
    rnd = random.Random(1)
    start = datetime(2025, 7, 1)
    times = [start + timedelta(minutes=rnd.randrange(60 * 24 * 9)) for _ in range(500)] + [start + timedelta(hours=30)] * 200
    return readings(spark, [(f"S{i % 3}", t.isoformat(), "t", float(i)) for i, t in enumerate(times)]).cache()


def test_pages_by_hour_are_the_offset_pages(spark, rows):
    for newest in (True, False):
        want = [r.id for r in rows.orderBy(*filters.sort_keys("timestamp", "desc" if newest else "asc")).collect()]
        for offset, limit in ((0, 5), (95, 30), (310, 300), (699, 10), (700, 10)):
            got = [r.id for r in pages.page_by_hours(rows, limit, offset, newest_first=newest).collect()]
            assert got == want[offset : offset + limit]
        assert [r.id for r in pages.page_by_hours(rows, 100, 250, newest_first=newest, top_k_rows=3).collect()] == want[250:350]
    untimed = rows.withColumn("timestamp", F.when(F.col("id") > 20, F.col("timestamp")))
    want = [r.id for r in untimed.orderBy(*filters.sort_keys()).collect()]
    assert [r.id for r in pages.page_by_hours(untimed, 30, 670).collect()] == want[670:700]


def test_pages_behind_a_row(spark, rows):
    for newest in (True, False):
        want = [r.id for r in rows.orderBy(*filters.sort_keys("timestamp", "desc" if newest else "asc")).collect()]
        page, got = pages.rows_after(rows, 300, newest_first=newest).collect(), []
        while page:
            got += [r.id for r in page]
            page = pages.rows_after(rows, 300, page[-1].timestamp, page[-1].id, newest).collect()
        assert got == want


def test_stored_counts_follow_the_table_and_prune_it(spark, tmp_path, rows):
    table, index = str(tmp_path / "table"), str(tmp_path / "hours")
    K.append_readings(rows, table)
    pages.refresh_hour_counts(spark, R.read_readings(spark, table), index)
    days = [at("2025-07-03").date(), at("2025-07-04").date()]
    K.delete_readings(spark, table, R.read_readings(spark, table).where(F.col("date").isin(days)).select("id"))
    stored = R.read_readings(spark, table)
    pages.refresh_hour_counts(spark, stored, index, days)
    counts = pages.read_hour_counts(spark, index)
    assert counts.agg(F.sum("n")).first()[0] == stored.count()
    want = [r.id for r in stored.orderBy(*filters.sort_keys()).collect()]
    page = pages.page_by_hours(stored, 20, 100, counts)
    assert [r.id for r in page.collect()] == want[100:120]
    assert "PartitionFilters: [isnotnull(date" in page._jdf.queryExecution().executedPlan().toString()


def test_masks_against_hours(spark, tmp_path):
    rnd = random.Random(2)
    present = {s: sorted(rnd.sample(range(24 * 12), 60)) for s in ("A", "B")}
    start = datetime(2025, 7, 1)
    data = [(s, (start + timedelta(hours=h, minutes=rnd.randrange(60))).isoformat(), "t", 1.0) for s, own in present.items() for h in own for _ in range(2)]
    df = readings(spark, data)

    def check(found, hours):
        cover = {r.sensor_id: r for r in masks.mask_coverage(found).collect()}
        gaps = {}
        for r in masks.mask_gaps(found).collect():
            gaps.setdefault(r.sensor_id, set()).add((r.gap_start, r.hours))
        for s, own in hours.items():
            assert (cover[s].actual_readings, cover[s].expected_readings) == (len(own), own[-1] - own[0] + 1)
            assert gaps.get(s, set()) == {(start + timedelta(hours=a + 1), b - a - 1) for a, b in zip(own, own[1:]) if b - a > 1}

    check(masks.daily_masks(df), present)
    # A clock of 1970 changes its own series only.
    odd = df.union(df.limit(1).withColumns({"sensor_id": F.lit("B"), "timestamp": F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")}))
    found = {r.sensor_id: r.expected_readings for r in masks.mask_coverage(masks.daily_masks(odd)).collect()}
    assert found["A"] == present["A"][-1] - present["A"][0] + 1 and found["B"] > 400_000
    assert masks.mask_gaps(masks.daily_masks(odd)).where("hours > 400000").count() == 1
    # Two loads, the second of which fills hours of the first.
    table, path = str(tmp_path / "table"), str(tmp_path / "masks")
    K.append_readings(df.where("sensor_id = 'A'"), table)
    masks.refresh_masks(spark, R.read_readings(spark, table), path)
    K.append_readings(df.where("sensor_id = 'B'"), table)
    masks.refresh_masks(spark, R.read_readings(spark, table), path, [r[0] for r in df.where("sensor_id = 'B'").select(F.to_date("timestamp")).distinct().collect()])
    check(masks.read_masks(spark, path), present)


def test_profiles_from_sketches(spark):
    df = readings(spark, [(f"S{i % 37}", f"2025-07-{1 + i % 9:02}T{i % 24:02}:00:00", "t", None if i % 10 == 0 else float(i % 500), "f", i % 100) for i in range(6000)])
    one = sketches.daily_sketches(df)
    two = sketches.daily_sketches(df.where("day(timestamp) < 4")).unionByName(sketches.daily_sketches(df.where("day(timestamp) >= 4")))
    results = [{r.column_name: r for r in sketches.merged_profile(s).collect()} for s in (one, two)]
    for got in results:
        assert got["value"].nulls == 600 and got["value"].rows == 6000 and (got["value"].min_number, got["value"].max_number) == (1.0, 499.0)
        assert abs(got["sensor_id"].distinct_values - 37) <= 1 and abs(got["id"].distinct_values - 6000) < 150
        assert abs(got["value"].q50 - 250) < 15 and got["sensor_id"].q50 is None
    assert all(abs(results[0][c].distinct_values - results[1][c].distinct_values) <= 0.03 * results[0][c].distinct_values for c in results[0])
