"""Odd landing files, and loads in several steps against one batch run over all files."""

import json
import random

import pytest
from helpers import at, readings
from pyspark.sql import functions as F

from tidemark.operators import moments
from tidemark.plans import adapters, batch, load, runs
from tidemark.session import written
from tidemark.sources import landing
from tidemark.sources import readers as R
from tidemark.sources import writers as K

RECORD = {"id": 1, "sensor_id": "S1", "timestamp": "2025-07-16T10:00:00Z", "reading_type": "temperature", "value": 1.5}


@pytest.mark.parametrize(
    "odd, column, seen",
    [
        ({"id": "abc"}, "id", None), ({"id": 1.5}, "id", None), ({"id": "12"}, "id", 12), ({"id": 7.0}, "id", 7), ({"location": "field_1"}, "field", None),
        ({"location": {"field": "f", "latitude": "12.5"}}, "latitude", 12.5), ({"location": [1]}, "latitude", None), ({"latitude": "x"}, "latitude", None),
        ({"battery_level": 87.5}, "battery_level", 88), ({"battery_level": {"a": 1}}, "battery_level", None), ({"sensor_id": 5}, "sensor_id", "5"),
        ({"value": "n/a"}, "value", None), ({"value": True}, "value", None), ({"value": None}, "value", None), ({"unit": ["C"]}, "unit", '["C"]'),
    ],
)
def test_an_odd_field_costs_only_itself(spark, tmp_path, odd, column, seen):
    rows = [{**RECORD, **odd, "reading_type": "odd"}] + [{**RECORD, "id": i, "timestamp": f"2025-07-16T10:{i:02}:00Z"} for i in range(5)]
    (tmp_path / "a.json").write_text(json.dumps(rows))
    landed = R.read_landing(spark, str(tmp_path))
    got = R.ingest(landed).collect()
    counts = R.ingest_summary(landed).first()
    assert len(got) == counts.processed == R.ingest(landed).count() == 6 and counts.errors == 0
    assert [r[column] for r in got if r.reading_type == "odd"] == [seen]


def test_json_files_of_every_kind(spark, tmp_path):
    files = {
        "array": "\n " + json.dumps([RECORD, None, 5, "x", [], {}]), "object": json.dumps(RECORD, indent=1), "empty_list": "[]", "empty": "", "blank": " \n",
        "cut": '[{"id": 1', "two": json.dumps(RECORD) * 2, "bom": "﻿" + json.dumps([RECORD]), "twice": '{"id": 1, "id": 2, ' + json.dumps(RECORD)[9:],
    }
    for name, text in files.items():
        (tmp_path / f"{name}.json").write_text(text, encoding="utf-8")
    raw = R.read_raw_json(spark, str(tmp_path))
    broken = {r.source_file.split("/")[-1][:-5] for r in raw.where(F.col(landing.CORRUPT).isNotNull()).collect()}
    assert broken == {"cut", "two", "blank"}
    counts = R.ingest_summary(raw).first()
    assert (counts.processed, counts.skipped) == (4, 5) and counts.errors == 3
    (tmp_path / "l.jsonl").write_text("\n".join([json.dumps(RECORD), "", "{", json.dumps({**RECORD, "id": "x"})]))
    lines = R.read_raw_json(spark, str(tmp_path), lines=True)
    counts = R.ingest_summary(lines).first()
    assert (counts.processed, counts.skipped, counts.errors) == (2, 0, 1)


def test_parquet_files_of_every_type(spark, tmp_path):
    base = readings(spark, [("S1", "2025-07-16T10:00:00", "t", 2.5, "f", 50)]).withColumn("signal_strength", F.lit(3))
    kinds = [
        ("battery_level", "double"), ("battery_level", "bigint"), ("battery_level", "string"), ("value", "string"), ("value", "float"), ("value", "decimal(9,2)"),
        ("value", "int"), ("timestamp", "string"), ("timestamp", "timestamp"), ("timestamp", "date"), ("id", "int"), ("id", "string"), ("sensor_id", "binary"), ("field", "int"),
    ]
    for i, (column, kind) in enumerate(kinds):
        base.withColumn(column, F.col(column).try_cast(kind) if column != "field" else F.lit(7)).coalesce(1).write.parquet(str(tmp_path / f"p{i:02}"))
    base.drop("field", "battery_level").withColumn("more", F.lit(1)).coalesce(1).write.parquet(str(tmp_path / "few"))
    (tmp_path / "junk.parquet").write_bytes(b"PAR1 this is none PAR1")
    landed = R.read_landing(spark, str(tmp_path))
    counts = R.ingest_summary(landed).first()
    got = R.ingest(landed).collect()
    assert len(got) == counts.processed == len(kinds) + 1 and (counts.skipped, counts.errors, counts.files) == (0, 1, len(kinds) + 1)
    assert {(r.id, r.sensor_id) for r in got} == {(1, "S1")}
    assert sorted({r.value for r in got}) == [2.0, 2.5] and {r.timestamp for r in got} == {at("2025-07-16T10:00:00"), at("2025-07-16T00:00:00")}
    assert {r.battery_level for r in got} == {50, None} and {r.field for r in got} == {"f", "7", None}
    groups, bad = landing.parquet_groups(spark, str(tmp_path))
    assert len(bad) == 1 and sum(len(files) for _, files in groups) == len(kinds) + 1


def test_a_damaged_file_is_counted_and_the_run_goes_on(spark, tmp_path):
    raw, table = tmp_path / "raw", str(tmp_path / "table")
    rows = readings(spark, [(f"S{i}", "2025-07-16T10:00:00", "t", float(i)) for i in range(3000)])
    for name in ("a", "b"):
        adapters.land_parquet(rows.withColumn("reading_type", F.lit(name)).coalesce(1), str(raw / name))
    file = next((raw / "b").glob("*.parquet"))
    data = bytearray(file.read_bytes())
    data[4:400] = b"\xff" * 396  # pages, not the footer
    file.write_bytes(data)
    (raw / "c.json").write_text(json.dumps([RECORD, {**RECORD, "id": "abc", "sensor_id": "S2"}]))
    run = batch.run_batch(spark, str(raw), table)
    assert run["files_cut_short"] == 1 and run["records_stored"] == R.read_readings(spark, table).count() == run["records_ingested"] - run["duplicates_removed"] >= 3002


def plain(spark, table):
    rows = R.read_readings(spark, table).select("id", "sensor_id", "timestamp", "reading_type", "value", "calibrated_value", "quality_score", "anomalous_reading", "date")
    return sorted(map(str, rows.collect()))


def land(spark, rows, path, as_json=False):
    df = spark.createDataFrame(rows, "id long, sensor_id string, timestamp timestamp_ntz, reading_type string, value double, field string, battery_level int")
    if as_json:
        df.withColumn("timestamp", F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss'Z'")).coalesce(1).write.json(path + "_lines")
        text = [json.loads(x) for x in spark.read.text(path + "_lines").toPandas()["value"]]
        with open(path + ".json", "w") as f:
            json.dump(text, f)
    else:
        adapters.land_parquet(df.coalesce(1), path)


@pytest.mark.parametrize("fill", ["drop", "forward"])
def test_several_loads_give_what_one_gives(spark, tmp_path, fill):
    rnd = random.Random(fill)
    rows, number = [], 0
    for sensor in "AB":
        for kind in ("temperature", "humidity"):
            for day in range(1, 5):
                for hour in range(rnd.randrange(4)):
                    for _ in range(rnd.choice((1, 1, 1, 2))):  # copies of a key
                        number += 1
                        value = None if rnd.random() < 0.4 else rnd.choice((20.0, 21.5, 60.0, 900.0, rnd.gauss(20, 3)))
                        rows.append([number, sensor, at(f"2025-07-{day:02}T{hour:02}:00:00"), kind, value, "f", 50])
    rnd.shuffle(rows)
    for i, row in enumerate(rows):  # ids in no order of time or load
        row[0] = i
    raw, table, once = (str(tmp_path / n) for n in ("raw", "table", "once"))
    (tmp_path / "raw").mkdir()
    for k in range(3):
        land(spark, rows[k::3], f"{raw}/{k}", as_json=k == 1)
        batch.run_incremental(spark, raw, table, str(tmp_path / "seen"), fill=fill)
    batch.run_batch(spark, raw, once, fill=fill)
    assert plain(spark, table) == plain(spark, once)
    if fill == "forward":
        batch.run_incremental(spark, raw, table, str(tmp_path / "anew"), fill=fill)  # everything again
        assert plain(spark, table) == plain(spark, once)


def test_a_late_reading_is_carried_into_later_days(spark, tmp_path):
    table = str(tmp_path / "table")

    def step(name, *rows):
        land(spark, [(i, "S", at(t), "temperature", v, "f", 50) for i, t, v in rows], str(tmp_path / name))
        batch.run_batch(spark, str(tmp_path / name), table, fill="forward")
        return {r.id: (r.value, r.calibrated_value) for r in R.read_readings(spark, table).collect()}

    assert step("a", (1, "2025-07-01T01:00:00", 5.0), (2, "2025-07-03T01:00:00", None), (3, "2025-07-04T01:00:00", None))[3] == (5.0, 5.0)
    assert step("b", (4, "2025-07-05T01:00:00", None))[4] == (5.0, 5.0)
    got = step("c", (5, "2025-07-02T01:00:00", 7.0))
    assert [got[i][0] for i in (1, 5, 2, 3, 4)] == [5.0, 7.0, 7.0, 7.0, 7.0] and got[4] == (7.0, 7.0)
    got = step("d", (6, "2025-07-03T02:00:00", 9.0))
    assert [got[i][0] for i in (2, 6, 3, 4)] == [7.0, 9.0, 9.0, 9.0]


def test_a_fill_reads_its_rows_once(spark, tmp_path, monkeypatch):
    seen, fill_days = spark.sparkContext.accumulator(0), load.fill_days

    @F.udf("double")
    def counted(value):
        seen.add(1)
        return value

    def fill_counted(rows, *rest):
        return fill_days(rows.withColumn("value", counted.asNondeterministic()("value")), *rest)

    monkeypatch.setattr(load, "fill_days", fill_counted)
    values = {1: 5.0, 2: None, 3: None, 4: 6.0, 5: None}
    rows = [("S", f"2025-07-0{d}T01:00:00", "temperature", v) for d, v in values.items()] + [(None, "2025-07-02T01:00:00", "temperature", None)]
    load.merge_load(written(readings(spark, rows)), str(tmp_path / "table"), fill="forward")
    got = {(r.sensor_id, r.timestamp.day): r.value for r in R.read_readings(spark, str(tmp_path / "table")).collect()}
    assert got == {("S", 1): 5.0, ("S", 2): 5.0, ("S", 3): 5.0, ("S", 4): 6.0, ("S", 5): 6.0, (None, 2): None}
    assert seen.value == len(rows)


def test_new_values_move_the_limits_of_stored_ones(spark, tmp_path):
    table = str(tmp_path / "table")
    first = [(i, "S", at(f"2025-07-01T00:{i:02}:00"), "odd", float(i % 5), "f", 50) for i in range(40)] + [(90, "S", at("2025-07-02T00:00:00"), "odd", 40.0, "f", 50)]
    land(spark, first, str(tmp_path / "a"))
    batch.run_batch(spark, str(tmp_path / "a"), table)
    assert [r.id for r in R.read_readings(spark, table).where("anomalous_reading").collect()] == [90]
    land(spark, [(100 + i, "S", at(f"2025-07-03T00:{i:02}:00"), "odd", 50.0, "f", 50) for i in range(40)], str(tmp_path / "b"))
    batch.run_batch(spark, str(tmp_path / "b"), table)
    assert R.read_readings(spark, table).where("anomalous_reading").count() == 0


def test_a_table_without_side_tables_is_taken_up(spark, tmp_path):
    table = str(tmp_path / "table")
    K.append_readings(readings(spark, [("S", f"2025-07-01T00:{i:02}:00", "odd", float(i % 5)) for i in range(40)]), table)
    land(spark, [(900, "S", at("2025-07-02T00:00:00"), "odd", None, "f", 50), (901, "S", at("2025-07-02T01:00:00"), "odd", 90.0, "f", 50)], str(tmp_path / "a"))
    batch.run_batch(spark, str(tmp_path / "a"), table, fill="forward")
    got = {r.id: (r.value, r.anomalous_reading) for r in R.read_readings(spark, table).collect()}
    assert got[900] == (4.0, False) and got[901] == (90.0, True) and len(got) == 42 and got[1][1] is None


def test_a_correction_wins_if_asked_for(spark, tmp_path):
    row = ("S", at("2025-07-01T00:00:00"), "temperature")
    for keep, value in (("smallest_id", 1.0), ("newest", 2.0)):
        table = str(tmp_path / keep)
        for i, v in ((5, 1.0), (6, 2.0)):
            land(spark, [(i, *row, v, "f", 50)], str(tmp_path / f"{keep}{i}"))
            batch.run_batch(spark, str(tmp_path / f"{keep}{i}"), table, keep=keep)
        assert [r.value for r in R.read_readings(spark, table).collect()] == [value]
    with pytest.raises(ValueError):
        load.merge_load(R.read_readings(spark, table), table, keep="oldest")


def test_a_row_without_value_empties_a_date(spark, tmp_path):
    table = str(tmp_path / "table")
    for i, v in ((6, 2.0), (5, None)):
        land(spark, [(i, "S", at("2025-07-01T00:00:00"), "temperature", v, "f", 50)], str(tmp_path / str(i)))
        batch.run_batch(spark, str(tmp_path / str(i)), table)
    assert R.read_readings(spark, table).count() == 0


def test_moments_keep_their_digits(spark):
    rows = [("S", f"2025-07-{1 + i % 9:02}T00:{i % 60:02}:{i // 60:02}", "t", 1e9 + i % 7) for i in range(500)] + [("S", "2025-07-20T00:00:00", "u", 1.0)]
    df = readings(spark, rows)
    got = {r.reading_type: r for r in moments.deviations(moments.merged_moments(moments.daily_moments(df))).collect()}
    want = df.where("reading_type = 't'").agg(F.avg("value").alias("m"), F.stddev_samp("value").alias("s")).first()
    assert abs(got["t"].group_mean - want.m) < 1e-6 and abs(got["t"].group_std - want.s) < 1e-7
    assert got["u"].group_std is None


def test_run_table(spark, tmp_path):
    raw, table = str(tmp_path / "raw"), str(tmp_path / "table")
    land(spark, [(i, "S", at(f"2025-07-01T{i:02}:00:00"), "t", float(i), "f", 50) for i in range(5)], f"{raw}/a")
    batch.run_incremental(spark, raw, table, str(tmp_path / "seen"))
    land(spark, [(9, "S", at("2025-07-01T00:00:00"), "t", 0.0, "f", 50), (10, "", at("2025-07-01T00:00:00"), "t", 0.0, "f", 50)], f"{raw}/b")
    batch.run_incremental(spark, raw, table, str(tmp_path / "seen"))
    home = load.state_home(table)
    totals = {r.metric: r.total for r in runs.run_counters(runs.read_runs(spark, home)).collect()}
    assert (totals["records_read"], totals["records_ingested"], totals["records_skipped"], totals["records_stored"]) == (7, 6, 1, 5)
    assert {(r.stage, r.completed, r.failed) for r in runs.stage_status(runs.read_runs(spark, home)).collect()} == {(s, 2, 0) for s in ("ingestion", "cleaning", "storage")}
    run = runs.Run(spark, home, "fails")
    with pytest.raises(RuntimeError), run.stage("cleaning"):
        raise RuntimeError
    assert [r.failed for r in runs.stage_status(runs.read_runs(spark, home)).where("stage = 'cleaning'").collect()] == [1]
    assert runs.read_runs(spark, str(tmp_path / "none")).count() == 0
