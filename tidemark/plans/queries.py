"""Registered queries: each reads the given tables whole and returns one DataFrame.

Averages, sums and other float aggregates are rounded to six decimals here, so
that a second engine adding the same numbers in another order agrees.
"""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalar as S
from ..functions.validity import RULE_SETS, split_valid, validity, with_errors
from ..operators import aggregates as A
from ..operators import anomaly, cleaning, filters, masks, pages, sketches
from ..operators import timeseries as TS
from ..operators.lookup import with_rules
from ..schema import require_columns
from ..session import scratch_dir, written
from ..sources import readers as R
from ..sources import writers as K
from ..streaming import incremental
from . import adapters as V
from . import batch, load, reports, runs

BASE = ["id", "sensor_id", "timestamp", "reading_type", "value", "field", "battery_level"]
HALF = "2024-01-16 00:00:00"
START, END = "2024-01-05 00:00:00", "2024-01-20 12:00:00"
SENSOR, TYPE = "SENSOR_000008", "temperature"
QUERIES: dict = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def r6(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in columns})


def joined(df: DataFrame, *columns: str) -> DataFrame:
    """Arrays as comma-separated text, for comparison with another engine."""
    return df.withColumns({c: F.array_join(c, ",") for c in columns})


def flags(spark: SparkSession, d: str) -> DataFrame:
    """Damaged readings with the range flag as the anomaly flag."""
    return anomaly.with_range_flag(V.readings_dirty(spark, d)).withColumn("anomalous_reading", F.col("is_range"))


def cleaned(spark: SparkSession, d: str) -> DataFrame:
    """Unique readings with values. Written once: the anomaly steps read it three times."""
    return written(batch.clean(V.readings_dirty(spark, d)), "clean")


# --- sources ----------------------------------------------------------------
@query
def table_scan(spark, d):
    path = scratch_dir(spark, "table")
    K.append_readings(V.readings(spark, d), path)
    return filters.newest_first(R.read_readings(spark, path)).select(*BASE)


@query
def parquet_scan(spark, d):
    return R.read_parquet(
        spark, f"{d}/events.parquet", where="value > 50 AND event_type = 'click'", order_by="value desc, event_id", limit=500
    )


@query
def parquet_ingest(spark, d):
    path = V.land_parquet(V.readings_dirty(spark, d), scratch_dir(spark, "landing"))
    return R.ingest(R.read_raw_parquet(spark, path)).select(*BASE, "latitude", "longitude")


@query
def parquet_ingest_counts(spark, d):
    path = V.land_parquet(V.readings_dirty(spark, d), scratch_dir(spark, "landing"))
    return R.ingest_summary(R.read_raw_parquet(spark, path)).drop("files")


@query
def json_ingest(spark, d):
    path = V.land_json(V.readings_dirty(spark, d), scratch_dir(spark, "landing"))
    return R.ingest(R.read_raw_json(spark, path, glob="*.txt")).select(*BASE, "latitude", "longitude")


@query
def mixed_folder_ingest(spark, d):
    rows, path = V.readings_dirty(spark, d), scratch_dir(spark, "landing")
    V.land_parquet(rows.where(F.col("timestamp") < HALF), f"{path}/columnar")
    V.land_json(rows.where(F.col("timestamp") >= HALF), path)
    return R.ingest(R.read_landing(spark, path, json_glob="*.txt")).select(*BASE)


@query
def odd_json_ingest(spark, d):
    """Records with an odd id, location, latitude or battery level; each costs only its field, the cut file only itself."""
    path = V.land_odd_json(V.readings_dirty(spark, d), scratch_dir(spark, "landing"))
    return R.ingest(R.read_raw_json(spark, path, glob="*.txt")).select(*BASE, "latitude", "longitude")


@query
def odd_parquet_ingest(spark, d):
    """Files whose columns have other types than usual."""
    path = V.land_odd_parquet(V.readings_dirty(spark, d), scratch_dir(spark, "landing"))
    return R.ingest(R.read_raw_parquet(spark, path)).select(*BASE, "latitude", "longitude")


def _odd_folder(spark, d) -> str:
    rows, path = V.readings_dirty(spark, d), scratch_dir(spark, "landing")
    V.land_odd_parquet(rows.where(F.col("timestamp") < HALF), f"{path}/columnar")
    V.land_odd_json(rows.where(F.col("timestamp") >= HALF), path)
    return path


@query
def odd_landing_counts(spark, d):
    """Counters of a folder of odd files of both kinds."""
    return R.ingest_summary(R.read_landing(spark, _odd_folder(spark, d), json_glob="*.txt")).drop("files")


@query
def files_by_time(spark, d):
    """Files changed in a window: of two landed parts only the second is chosen, by the change times of its files."""
    rows, path = V.readings(spark, d), scratch_dir(spark, "landing")
    V.land_parquet(rows.where(F.col("timestamp") < HALF), f"{path}/first")
    time.sleep(1.1)  # change times are told apart by whole seconds on some file systems
    V.land_parquet(rows.where(F.col("timestamp") >= HALF), f"{path}/second")
    changed = R.landing_files(spark, f"{path}/second", "*.parquet").agg(F.min("modified").alias("start"), F.max("modified").alias("end")).first()
    found = R.read_raw_parquet(spark, path, start=changed["start"], end=changed["end"])
    return found.select("id", "sensor_id", "timestamp", "value", F.col("location.field").alias("field"))


@query
def required_columns(spark, d):
    rows = V.readings_dirty(spark, d)
    require_columns(rows.columns)
    return rows.agg(*[F.count(c).alias(f"{c}_present") for c in ("sensor_id", "timestamp", "reading_type", "value")])


@query
def landing_files(spark, d):
    return R.landing_files(spark, d)


def _logs(spark, d) -> str:
    """Log lines from events: JSON entries, and plain text for views."""
    path = scratch_dir(spark, "logs")
    e = spark.read.parquet(f"{d}/events.parquet")
    level = F.when(F.col("event_type") == "error", "error").when(F.col("event_type") == "signup", "warn").otherwise("info")
    entry = F.struct(
        level.alias("level"),
        F.concat(F.lit("event "), F.col("event_id").cast("string")).alias("message"),
        S.iso_micros("ts").alias("timestamp"),
    )
    plain = F.concat(F.lit("Error seen by view "), F.col("event_id").cast("string"))
    e.select(F.when(F.col("event_type") == "view", plain).otherwise(F.to_json(entry)).alias("value")).write.text(path)
    return path


@query
def log_query(spark, d):
    return R.read_logs(spark, _logs(spark, d), level="warn", lines=200)


@query
def log_query_all_errors(spark, d):
    return R.read_logs(spark, _logs(spark, d), level="error", lines=None)


@query
def report_catalog(spark, d):
    path = scratch_dir(spark, "reports")
    df = flags(spark, d)
    K.save_report({"metrics": reports.quality_rows(df)}, path, "quality_1704067200000")
    K.save_report({"coverage": TS.coverage(df)}, path, "coverage_1704067200001")
    listed = R.report_catalog(spark, path).select("report_id", "type", F.explode("sections").alias("section"))
    rows = R.read_report(spark, path, "quality_1704067200000", "metrics").select(
        F.lit("quality_1704067200000").alias("report_id")
    ).unionByName(
        R.read_report(spark, path, "coverage_1704067200001", "coverage").select(
            F.lit("coverage_1704067200001").alias("report_id")
        )
    )
    return listed.join(rows.groupBy("report_id").agg(F.count("*").alias("rows")), "report_id")


@query
def stored_files(spark, d):
    path = scratch_dir(spark, "stored")
    K.write_json(V.readings_text(spark, d), path)
    return R.read_stored_json(spark, path).select("id", "sensor_id", "timestamp", "reading_type", "value")


# --- sinks and table changes --------------------------------------------------
@query
def append_defaults(spark, d):
    path = scratch_dir(spark, "table")
    K.append_readings(V.nested(V.readings_dirty(spark, d)), path)
    return R.read_readings(spark, path).select(*BASE, "data_quality", "quality_score", "latitude", "longitude", "date")


def _table(spark, d) -> str:
    path = scratch_dir(spark, "table")
    K.append_readings(V.readings(spark, d), path)
    return path


@query
def keyed_update(spark, d):
    path = _table(spark, d)
    changes = V.readings(spark, d).where("value > 100").select(
        "id", (F.col("value") / 2).alias("value"), F.lit("checked").alias("data_quality")
    )
    K.update_readings(spark, path, changes)
    return R.read_readings(spark, path).select(*BASE, "data_quality")


@query
def keyed_delete(spark, d):
    path = _table(spark, d)
    # Every reading of one day, and the large ones of all days.
    ids = V.readings(spark, d).where("value > 100 OR CAST(timestamp AS DATE) = DATE '2024-01-10'").select("id")
    K.delete_readings(spark, path, ids)
    return R.read_readings(spark, path).select(*BASE)


@query
def transformed_backup(spark, d):
    path = scratch_dir(spark, "transformed")
    out = batch.calibrate(V.readings_dirty(spark, d), "code").withColumn("quality_score", S.quality_score())
    K.write_json(out, path)
    shape = "id long, sensor_id string, value double, calibrated_value double, quality_score double"
    return spark.read.schema(shape).json(path)


@query
def daily_lines(spark, d):
    path = scratch_dir(spark, "daily")
    K.write_daily_lines(V.readings(spark, d), path)
    shape = "id long, sensor_id string, value double, field string, date date"
    return spark.read.schema(shape).json(path)


@query
def partitioned_table(spark, d):
    path = _table(spark, d)
    return R.read_readings(spark, path).groupBy("date").agg(
        F.count("*").alias("rows"), F.min("timestamp").alias("first"), F.max("timestamp").alias("last")
    )


@query
def master_index(spark, d):
    files = K.master_index(spark, _table(spark, d))
    day = F.coalesce(F.regexp_extract("file_path", r"date=([0-9-]+)", 1), F.lit("total"))
    return files.groupBy(day.alias("day")).agg(F.sum("record_count").alias("record_count"))


def _export(spark, d, fmt):
    return K.export(V.readings_dirty(spark, d), scratch_dir(spark, "export"), fmt)


EXPORT_SHAPE = (
    "id long, sensor_id string, timestamp timestamp_ntz, reading_type string, value double, field string, battery_level int"
)


@query
def export_csv(spark, d):
    back = spark.read.schema(EXPORT_SHAPE).option("header", True).option("escape", '"').csv(_export(spark, d, "csv"))
    return back.withColumn("sensor_id", F.coalesce("sensor_id", F.lit("")))


@query
def export_json(spark, d):
    return spark.read.schema(EXPORT_SHAPE).json(_export(spark, d, "json"))


@query
def export_parquet(spark, d):
    return spark.read.parquet(_export(spark, d, "parquet"))


@query
def report_export(spark, d):
    path, out = scratch_dir(spark, "reports"), scratch_dir(spark, "export")
    K.save_report(reports.quality_report(flags(spark, d)), path, "quality_1704067200000")
    K.export_report(spark, path, "quality_1704067200000", out, "csv")
    shape = "metric string, reading_type string, sensor_id string, value double, timestamp timestamp_ntz"
    back = r6(spark.read.schema(shape).option("header", True).csv(out), "value")
    return back.withColumn("sensor_id", F.coalesce("sensor_id", F.lit("")))


@query
def validation_saved(spark, d):
    path = scratch_dir(spark, "validation")
    K.write_json(A.validation_totals(V.readings_dirty(spark, d)), f"{path}/quality_1704067200000")
    shape = "total_records long, valid_records long, invalid_records long, quality_score double"
    return r6(spark.read.schema(shape).json(f"{path}/quality_1704067200000"), "quality_score")


# --- filters, order, paging ---------------------------------------------------
@query
def filter_equality(spark, d):
    return filters.filter_readings(V.readings(spark, d), sensor_id=SENSOR, reading_type=TYPE, unknown="x")


@query
def filter_time(spark, d):
    return filters.filter_readings(V.readings(spark, d), start=START, end=END, field="field_1")


@query
def filter_value(spark, d):
    return filters.filter_readings(V.readings_dirty(spark, d), min_value=20, max_value=30)


@query
def filter_anomalous(spark, d):
    return filters.filter_readings(flags(spark, d), anomalous=True).select(*BASE)


@query
def filter_not_anomalous(spark, d):
    return filters.filter_readings(flags(spark, d), anomalous=False).select(*BASE)


@query
def filter_stored_files(spark, d):
    text = V.readings_text(spark, d)
    return filters.filter_stored(text, start=START, end=END, reading_type=TYPE).select(
        "id", "sensor_id", "timestamp", "reading_type", "value"
    )


@query
def filter_transformed(spark, d):
    out = batch.calibrate(V.readings_dirty(spark, d), "code")
    return filters.filter_readings(out, sensor_id=SENSOR, reading_type=TYPE).select("id", "value", "calibrated_value")


@query
def table_columns_only(spark, d):
    extra = V.readings(spark, d).withColumn("extra_field", F.lit("x"))
    return K.with_defaults(extra).drop("processed_timestamp", "created_at").select(*BASE, "data_quality")


@query
def checked_request(spark, d):
    filters.check_arguments("humidity", "2024-01-05", "2024-01-20", 1, 1000, "value", "asc")
    rows = filters.filter_readings(V.readings(spark, d), reading_type="humidity", start="2024-01-05", end="2024-01-20")
    return filters.page(rows, 1, 1000, "value", "asc")


@query
def newest_readings(spark, d):
    return filters.newest_first(V.readings(spark, d), 25)


@query
def sorted_by_value(spark, d):
    return filters.page(V.readings_dirty(spark, d), 1, 500, "value", "asc")


@query
def sorted_by_sensor(spark, d):
    return filters.page(V.readings(spark, d), 2, 500, "sensor_id", "desc")


@query
def page_three(spark, d):
    return filters.page(V.readings(spark, d), 3, 100)


@query
def page_totals(spark, d):
    return filters.page_totals(V.readings(spark, d), 3, 128)


@query
def deep_page(spark, d):
    """A deep page in time order: rows per hour say where it lies, only its hours are ordered."""
    return pages.page_by_hours(V.readings(spark, d), 1000, 8000)


@query
def deep_page_stored(spark, d):
    """The same from a stored table with its stored hour counts, oldest first."""
    path, index = _table(spark, d), scratch_dir(spark, "hours")
    table = R.read_readings(spark, path)
    pages.refresh_hour_counts(spark, table, index)
    return pages.page_by_hours(table, 1000, 8000, pages.read_hour_counts(spark, index), newest_first=False).select(*BASE)


@query
def deep_page_by_rank(spark, d):
    """A page cut by rank from a sorted table, for orders without an index."""
    return filters.page(V.readings(spark, d), 9, 1000, "value", "asc", top_k_rows=0)


@query
def page_after_key(spark, d):
    """The page behind the reading with id 500: no count and no offset."""
    rows = V.readings(spark, d)
    last = rows.where("id = 500").first()
    return pages.rows_after(rows, 1000, last["timestamp"], last["id"])


@query
def offset_page(spark, d):
    return filters.offset_page(V.readings(spark, d), 700, 150)


@query
def offset_totals(spark, d):
    return filters.offset_totals(V.readings(spark, d), 1000, 500)


# --- aggregations -------------------------------------------------------------
@query
def table_stats(spark, d):
    return A.table_stats(V.readings(spark, d)).withColumn("reading_type", F.coalesce("reading_type", F.lit("TOTAL")))


@query
def filtered_count(spark, d):
    rows = filters.filter_readings(V.readings(spark, d), reading_type=TYPE, start=START)
    return rows.agg(F.count("*").alias("total"))


@query
def sensor_directory(spark, d):
    return joined(A.sensor_directory(V.readings(spark, d)), "reading_types", "fields")


@query
def sensor_summary(spark, d):
    return joined(A.sensor_summary(V.readings_dirty(spark, d)), "reading_types")


@query
def one_sensor_summary(spark, d):
    return joined(A.sensor_summary(V.readings(spark, d), SENSOR), "reading_types")


@query
def absent_sensor_summary(spark, d):
    return joined(A.sensor_summary(V.readings(spark, d), "SENSOR_NONE"), "reading_types")


@query
def summary_by_type(spark, d):
    return r6(A.summary_by_type(cleaning.drop_duplicates(V.readings_dirty(spark, d))), "avg")


@query
def daily_aggregation(spark, d):
    return r6(A.daily_aggregation(V.readings_dirty(spark, d)), "avg", "sum").orderBy("date")


@query
def daily_by_sensor_type(spark, d):
    return r6(A.daily_aggregation(V.readings_dirty(spark, d), ("sensor_id", "reading_type")), "avg", "sum")


@query
def validation_totals(spark, d):
    return r6(A.validation_totals(V.readings_dirty(spark, d)), "quality_score")


@query
def ingest_counters(spark, d):
    return A.ingest_counters(V.readings_text(spark, d))


@query
def error_counts(spark, d):
    return A.error_counts(V.readings_text(spark, d))


@query
def validation_counters(spark, d):
    return A.validation_counters(V.readings_text(spark, d))


@query
def quality_metrics(spark, d):
    return r6(
        reports.quality_metrics(V.readings_dirty(spark, d)), "completeness", "accuracy_rate", "overall_quality_score"
    )


@query
def quality_rows(spark, d):
    return r6(reports.quality_rows(flags(spark, d)), "value")


@query
def gap_rows(spark, d):
    return reports.gap_rows(V.readings(spark, d))


@query
def descriptive_statistics(spark, d):
    return r6(A.statistics(V.readings_dirty(spark, d)), "mean", "median", "std_dev")


@query
def statistics_by_type(spark, d):
    return r6(A.statistics(V.readings_dirty(spark, d), ["reading_type"]), "mean", "median", "std_dev")


@query
def median_by_rank(spark, d):
    """Exact medians by counts over narrowing ranges."""
    return r6(A.median(V.readings_dirty(spark, d), ["sensor_id", "reading_type"], max_rows=0), "median")


@query
def trends(spark, d):
    return r6(A.trend(V.readings(spark, d)), "slope", "correlation")


@query
def type_correlations(spark, d):
    pairs = [("temperature", "humidity"), ("humidity", "soil_moisture")]
    return r6(A.type_correlations(V.readings(spark, d), pairs), "correlation")


@query
def summary_report(spark, d):
    return r6(reports.summary(flags(spark, d)), "value")


@query
def processing_report(spark, d):
    """Counters of one batch run; its seconds are in ``run_timings``."""
    path, table = scratch_dir(spark, "landing"), scratch_dir(spark, "table")
    V.land_parquet(V.readings_dirty(spark, d), path)
    metrics = batch.run_batch(spark, path, table)
    timed = [name for name in metrics if "second" in name]
    report = batch.processing_report(spark, metrics)
    return report.where(~F.col("metric").isin(*timed, "files_processed"))


@query
def coverage(spark, d):
    return TS.coverage(V.readings(spark, d))


@query
def coverage_in_range(spark, d):
    return TS.coverage(V.readings(spark, d), "2024-01-05 00:00:00", "2024-01-14 23:00:00")


@query
def coverage_summary(spark, d):
    return TS.coverage_summary(V.readings(spark, d))


def _stored_masks(spark, d):
    """Hour masks of a table that is loaded in two steps, the second of which adds hours to days of the first."""
    path, index, rows = scratch_dir(spark, "table"), scratch_dir(spark, "masks"), V.readings(spark, d)
    first = F.col("id") % 2 == 0
    K.append_readings(rows.where(first), path)
    masks.refresh_masks(spark, R.read_readings(spark, path), index)
    K.append_readings(rows.where(~first), path)
    dates = load.touched_dates(rows.where(~first))
    masks.refresh_masks(spark, R.read_readings(spark, path), index, dates)
    return masks.read_masks(spark, index)


@query
def coverage_by_mask(spark, d):
    """Coverage of each series over its own span."""
    return masks.mask_coverage(_stored_masks(spark, d))


@query
def gaps_by_mask(spark, d):
    """Runs of hours without a reading, within the span of their series."""
    return masks.mask_gaps(_stored_masks(spark, d))


@query
def anomaly_totals(spark, d):
    return r6(anomaly.anomaly_totals(anomaly.classify(cleaned(spark, d))), "anomaly_percentage")


@query
def anomaly_breakdown(spark, d):
    return anomaly.anomaly_breakdown(anomaly.classify(cleaned(spark, d)))


@query
def affected_sensors(spark, d):
    return anomaly.affected_sensors(anomaly.classify(cleaned(spark, d)))


@query
def top_anomalies(spark, d):
    return r6(anomaly.top_anomalies(anomaly.classify(cleaned(spark, d)), 20), "zscore")


@query
def custom_report(spark, d):
    out = A.custom_report(V.readings(spark, d), ["average", "maximum", "minimum", "count", "sum", "trend"], "daily")
    return r6(out, "average", "sum", "trend")


@query
def custom_report_by_sensor(spark, d):
    rows = filters.filter_readings(V.readings(spark, d), start=START, end=END)
    out = A.custom_report(rows, ["average", "maximum"], "weekly", keys=("sensor_id",))
    return r6(out, "average")


@query
def data_profile(spark, d):
    """All columns; numbers with decimals and times as text of a fixed form."""
    rows = V.readings_dirty(spark, d).withColumns(
        {"timestamp": F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss.SSSSSS"), "value": F.col("value").cast("decimal(20,6)")}
    )
    return A.profile(rows, exact=True)


@query
def profile_from_loads(spark, d):
    """Profile merged from the daily sketches of two loads: rows and nulls exact, the estimates within 5 % of the true figures."""
    rows = V.readings_dirty(spark, d)
    columns = ["id", "sensor_id", "reading_type", "value", "field", "battery_level"]
    parts = [sketches.daily_sketches(rows.where(c), [*columns, "timestamp"]) for c in (F.col("timestamp") < HALF, F.col("timestamp") >= HALF)]
    found = written(sketches.merged_profile(written(parts[0].unionByName(parts[1]), "sketches")), "profile")
    at = {r["column_name"]: r for r in found.collect()}  # a row per column
    exact = rows.agg(
        *[F.count_distinct(F.col(c)).alias(c) for c in at],
        *[f(F.col(c) <= F.lit(at[c]["q50"])).alias(f"{c}.upto") for c in ("id", "value", "battery_level") for f in (F.count_if,)],
        *[F.count_if(F.col(c) < F.lit(at[c]["q50"])).alias(f"{c}.below") for c in ("id", "value", "battery_level")],
        *[F.count(c).alias(f"{c}.n") for c in ("id", "value", "battery_level")],
    ).first()
    checks = []
    for c, r in at.items():
        near = abs(r["distinct_values"] - exact[c]) <= max(1, 0.05 * exact[c])
        middle = f"{c}.n" not in exact or (exact[f"{c}.upto"] >= 0.45 * exact[f"{c}.n"] and exact[f"{c}.below"] <= 0.55 * exact[f"{c}.n"])
        checks.append((c, near, middle))
    verdicts = spark.createDataFrame(checks, "column_name string, distinct_close boolean, median_close boolean")
    return found.select("column_name", "rows", "nulls").join(F.broadcast(verdicts), "column_name")


@query
def data_profile_sketch(spark, d):
    return A.profile(V.readings_dirty(spark, d))


# --- series -------------------------------------------------------------------
@query
def zscore_outliers(spark, d):
    scored = anomaly.with_zscore(V.readings(spark, d))
    return r6(scored.select("id", "reading_type", "value", "zscore", "is_statistical"), "zscore")


@query
def zscore_by_series(spark, d):
    scored = anomaly.with_zscore(V.readings(spark, d), ("sensor_id", "reading_type"))
    return r6(scored.select("id", "sensor_id", "reading_type", "zscore", "is_statistical"), "zscore")


@query
def rolling_average(spark, d):
    return r6(TS.rolling_average(V.readings_dirty(spark, d)), "daily_avg", "rolling_avg")


@query
def temporal_anomalies(spark, d):
    return anomaly.with_temporal_flag(V.readings(spark, d)).select("id", "is_temporal")


@query
def temporal_anomalies_shifted(spark, d):
    """Values around ten million with the same small spread: the flags must not change."""
    rows = V.readings(spark, d).withColumn("value", F.col("value") + 1e7)
    return anomaly.with_temporal_flag(rows).select("id", "is_temporal")


@query
def gaps(spark, d):
    return TS.gaps(V.readings(spark, d))


@query
def longest_gaps(spark, d):
    return TS.longest_gaps(V.readings(spark, d), min_gap_hours=24)


@query
def latest_reading(spark, d):
    return TS.latest_per_series(V.readings(spark, d))


@query
def drop_missing(spark, d):
    return cleaning.drop_missing(V.readings_dirty(spark, d))


@query
def forward_fill(spark, d):
    rows = cleaning.forward_fill(cleaning.drop_duplicates(V.readings_dirty(spark, d)))
    return rows.select("id", "sensor_id", "reading_type", "value")


@query
def forward_fill_by_file(spark, d):
    """Forward fill with values carried between sorted files."""
    rows = cleaning.forward_fill(cleaning.drop_duplicates(V.readings_dirty(spark, d)), series_rows=0)
    return rows.select("id", "sensor_id", "reading_type", "value")


@query
def deduplicate(spark, d):
    return cleaning.drop_duplicates(V.readings_dirty(spark, d))


@query
def duplicate_count(spark, d):
    return cleaning.duplicate_count(V.readings_dirty(spark, d))


@query
def concatenate(spark, d):
    a = V.readings(spark, d)
    b = V.readings_dirty(spark, d).drop("battery_level")
    return cleaning.concatenate(a, b)


@query
def rule_lookup(spark, d):
    return with_rules(V.readings(spark, d)).select(
        "id", "reading_type", "multiplier", "offset", "min_value", "max_value"
    )


@query
def hourly_spine(spark, d):
    """Readings per expected hour, summed per series and day to keep the result readable."""
    spine = TS.hourly_spine(V.readings(spark, d))
    return spine.groupBy("sensor_id", "reading_type", F.to_date("hour").alias("day")).agg(
        F.count("*").alias("expected"), F.count_if(F.col("readings") == 0).alias("missing"), F.sum("readings").alias("readings")
    )


@query
def missing_hours(spark, d):
    """Missing hours, counted per series and day."""
    return TS.missing_hours(V.readings(spark, d)).groupBy(
        "sensor_id", "reading_type", F.to_date("missing_hour").alias("day")
    ).agg(F.count("*").alias("missing"), F.min("missing_hour").alias("first"), F.max("missing_hour").alias("last"))


# --- row functions and rules --------------------------------------------------
@query
def calibrate_by_code(spark, d):
    return batch.calibrate(V.readings_dirty(spark, d), "code").select("id", "reading_type", "value", "calibrated_value")


@query
def calibrate_by_config(spark, d):
    return batch.calibrate(V.readings_dirty(spark, d), "config").select("id", "reading_type", "value", "calibrated_value")


@query
def quality_score(spark, d):
    return V.readings_dirty(spark, d).select("id", S.quality_score().alias("quality_score"))


@query
def range_anomalies(spark, d):
    return anomaly.with_range_flag(V.readings_dirty(spark, d)).select("id", "value", "is_range")


@query
def hard_limit_anomalies(spark, d):
    return V.readings_dirty(spark, d).select("id", S.outside_hard_limits().alias("anomalous_reading"))


@query
def numeric_text(spark, d):
    return V.readings_text(spark, d).select("id", S.to_number("value").alias("number"))


@query
def lower_types(spark, d):
    return V.readings_text(spark, d).select("id", S.normal_type().alias("reading_type"))


@query
def timestamp_text(spark, d):
    return V.readings_text(spark, d).select(
        "id", S.to_timestamp_ntz("timestamp").alias("parsed"), S.is_iso_timestamp("timestamp").alias("is_iso")
    )


@query
def local_time(spark, d):
    return V.readings(spark, d).select("id", S.to_local_time().alias("local_time"))


@query
def date_text(spark, d):
    return V.readings(spark, d).select("id", S.date_text().alias("day"), S.iso_text().alias("iso"))


@query
def day_list(spark, d):
    bounds = V.readings(spark, d).agg(F.min("timestamp").alias("lo"), F.max("timestamp").alias("hi"))
    return bounds.select(F.explode(S.days_between("lo", "hi")).alias("day"))


@query
def processing_version(spark, d):
    return S.with_processing_metadata(V.readings(spark, d)).select("id", "processing_version")


@query
def flatten_location(spark, d):
    return S.flatten_location(V.nested(V.readings(spark, d))).select("id", "field", "latitude", "longitude")


@query
def report_labels(spark, d):
    prefix = F.element_at(
        F.array(*[F.lit(p) for p in ("quality", "processing", "coverage", "anomaly", "analytics", "summary", "custom", "other")]),
        (F.col("id") % 8 + 1).cast("int"),
    )
    ids = V.readings(spark, d).select(F.concat(prefix, F.lit("_"), F.col("id").cast("string")).alias("report_id"))
    return ids.select("report_id", S.report_type().alias("type"))


@query
def file_dates(spark, d):
    names = V.readings(spark, d).select("id", F.concat(S.date_text(), F.lit(".parquet")).alias("name"))
    return names.select("id", S.file_date("name").alias("file_date"))


@query
def validity_rules(spark, d):
    rows = V.readings_text(spark, d)
    return rows.select("id", *[validity(rows, name).alias(f"{name}_ok") for name in RULE_SETS])


@query
def validation_errors(spark, d):
    return joined(with_errors(V.readings_text(spark, d)), "errors").select("id", "errors", "is_valid")


@query
def strict_split(spark, d):
    kept, bad = split_valid(V.readings_text(spark, d), strict=True)
    return kept.select("id", F.lit("kept").alias("part")).unionByName(bad.select("id", F.lit("quarantine").alias("part")))


@query
def rule_compliance(spark, d):
    return reports.rule_compliance(flags(spark, d))


@query
def threshold_breaches(spark, d):
    return r6(reports.threshold_breaches(flags(spark, d)), "value")


@query
def issue_rows(spark, d):
    return reports.issue_rows(V.readings_dirty(spark, d)).fillna({"expected_range": ""})


@query
def recommendations(spark, d):
    """Advice from range violations and z-score outliers; some sensors breach by the one, some by the other."""
    rows = anomaly.with_range_flag(anomaly.with_zscore(V.readings_dirty(spark, d), threshold=1.5))
    return reports.recommendations(rows.withColumn("anomalous_reading", F.col("is_range") | F.col("is_statistical")))


def _classified(spark, d):
    return anomaly.classify(cleaned(spark, d))


def _sections(parts: dict[str, DataFrame], shapes: dict[str, list]) -> DataFrame:
    """Sections of a report as rows: section, key and value, for comparison with another engine."""
    found = [parts[name].select(F.lit(name).alias("section"), F.concat_ws("/", *[F.col(k).cast("string") for k in keys]).alias("key"), F.round(F.col(value).cast("double"), 6).alias("value")) for name, (keys, value) in shapes.items()]
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


@query
def anomaly_report(spark, d):
    parts = reports.anomaly_report(_classified(spark, d))
    return _sections(parts, {"totals": ([], "total_anomalies"), "breakdown": (["anomaly_class", "severity"], "anomalies"), "sensors": (["sensor_id"], "anomalies"), "top_anomalies": (["id", "severity"], "zscore")})


@query
def coverage_report(spark, d):
    parts = reports.coverage_report(V.readings(spark, d))
    return _sections(parts, {"coverage": (["sensor_id", "reading_type"], "coverage_percentage"), "gaps": (["sensor_id", "reading_type", "gap_end"], "gap_hours"), "summary": (["sensors_with_gaps", "total_gaps"], "longest_gap_hours")})


@query
def analytics_report(spark, d):
    parts = reports.analytics_report(_classified(spark, d), [("temperature", "humidity")])
    return _sections(parts, {"statistics": (["count"], "median"), "trends": (["sensor_id", "reading_type", "direction"], "slope"), "correlations": (["pair"], "correlation"), "insights": (["reading_type", "type", "impact"], "confidence")})


@query
def quality_report(spark, d):
    parts = reports.quality_report(flags(spark, d))
    parts["recommendations"] = parts["recommendations"].withColumn("one", F.lit(1))
    return _sections(parts, {"quality_metrics": (["missing_values", "outliers"], "completeness"), "metrics": (["metric", "sensor_id", "reading_type"], "value"), "issues": (["id", "type"], "id"), "recommendations": (["sensor_id", "reading_type", "category"], "one")})


@query
def alerts(spark, d):
    return reports.alerts(flags(spark, d))


@query
def quiet_alerts(spark, d):
    """No reading is flagged, so the single status row is left."""
    return reports.alerts(V.readings(spark, d).withColumn("anomalous_reading", F.lit(False)))


@query
def insights(spark, d):
    return r6(reports.insights(anomaly.classify(cleaned(spark, d))), "confidence")


# --- flows ----------------------------------------------------------------------
@query
def process_records(spark, d):
    out, _ = batch.process_records(V.readings_text(spark, d))
    return out.select(
        "id", "sensor_id", "timestamp", "reading_type", "value", "quality_score", "anomalous_reading", "processing_version"
    )


@query
def process_records_strict(spark, d):
    path = scratch_dir(spark, "table")
    batch.process_and_store(V.readings_text(spark, d), path, strict=True)
    return R.read_readings(spark, path).select(
        "id", "sensor_id", "timestamp", "reading_type", "value", "quality_score", "anomalous_reading"
    )


@query
def process_records_lenient(spark, d):
    """Stored rows of a lenient run. A missing time is stored as the load time; it is shown as null."""
    path = scratch_dir(spark, "table")
    batch.process_and_store(V.readings_text(spark, d), path)
    return R.read_readings(spark, path).select(
        "id",
        "sensor_id",
        F.nullif(F.col("timestamp"), F.col("created_at")).alias("timestamp"),
        "reading_type",
        "value",
        "quality_score",
        "anomalous_reading",
    )


@query
def batch_run(spark, d):
    path, table = scratch_dir(spark, "landing"), scratch_dir(spark, "table")
    V.land_parquet(V.readings_dirty(spark, d), path)
    batch.run_batch(spark, path, table)
    return R.read_readings(spark, table).select(*BASE, "calibrated_value", "quality_score", "anomalous_reading", "date")


def _load_twice(spark, d, load, **options):
    raw, table, seen = (scratch_dir(spark, n) for n in ("landing", "table", "progress"))
    rows = V.readings_dirty(spark, d)
    V.land_parquet(rows.where(F.col("id") < V.COPY_ID), raw)
    load(spark, raw, table, seen, **options)
    # The second load brings copies of rows that are already stored.
    V.land_parquet(rows.where(F.col("id") >= V.COPY_ID), raw)
    load(spark, raw, table, seen, **options)
    return table


@query
def incremental_load(spark, d):
    table = _load_twice(spark, d, batch.run_incremental)
    return R.read_readings(spark, table).select(*BASE, "calibrated_value", "quality_score", "anomalous_reading", "date")


@query
def odd_batch_run(spark, d):
    """A batch run over odd files of both kinds stores every good row."""
    table = scratch_dir(spark, "table")
    batch.run_batch(spark, _odd_folder(spark, d), table, json_glob="*.txt")
    kept = R.read_readings(spark, table)
    return kept.select("sensor_id", "timestamp", "reading_type", "value", "calibrated_value", "anomalous_reading", "date")


def _three_loads(spark, d, **options) -> str:
    """The second half of the days first, then the first half as JSON, then the copies: late rows and mixed files."""
    raw, table, seen = (scratch_dir(spark, n) for n in ("landing", "table", "progress"))
    rows = V.readings_dirty(spark, d)
    own, late = rows.where(F.col("id") < V.COPY_ID), F.col("timestamp") < HALF
    V.land_parquet(own.where(~late), f"{raw}/a")
    batch.run_incremental(spark, raw, table, seen, json_glob="*.txt", **options)
    V.land_json(own.where(late), f"{raw}/b")
    batch.run_incremental(spark, raw, table, seen, json_glob="*.txt", **options)
    V.land_parquet(rows.where(F.col("id") >= V.COPY_ID), f"{raw}/c")
    batch.run_incremental(spark, raw, table, seen, json_glob="*.txt", **options)
    return table


@query
def incremental_forward_fill(spark, d):
    """Three loads with late rows, filled forward: values and flags are those of one run over all files."""
    table = _three_loads(spark, d, fill="forward")
    return R.read_readings(spark, table).select(*BASE, "calibrated_value", "quality_score", "anomalous_reading", "date")


@query
def correction_load(spark, d):
    """The second load corrects readings of the first under larger ids; with ``keep="newest"`` it wins."""
    raw, table, seen = (scratch_dir(spark, n) for n in ("landing", "table", "progress"))
    rows = V.readings(spark, d)
    V.land_parquet(rows, raw)
    batch.run_incremental(spark, raw, table, seen, fill="keep", profile=None, keep="newest")
    changed = rows.where("value > 100").withColumns({"id": F.col("id") + V.COPY_ID, "value": F.col("value") / 2})
    V.land_parquet(changed, raw)
    batch.run_incremental(spark, raw, table, seen, fill="keep", profile=None, keep="newest")
    return R.read_readings(spark, table).select(*BASE)


@query
def load_counters(spark, d):
    """Counters of all micro-batches, added up from the run table."""
    table = _load_twice(spark, d, batch.run_incremental)
    counters = runs.run_counters(runs.read_runs(spark, load.state_home(table)))
    return counters.where(~F.col("metric").isin("files_processed", "dates_written"))


@query
def run_timings(spark, d):
    """Seconds and status per stage of the run table (wall clock)."""
    path, table = scratch_dir(spark, "landing"), scratch_dir(spark, "table")
    V.land_parquet(V.readings_dirty(spark, d), path)
    batch.run_batch(spark, path, table)
    return runs.stage_status(runs.read_runs(spark, load.state_home(table)))


@query
def incremental_averages(spark, d):
    out = scratch_dir(spark, "averages")
    touched: set = set()
    table = _load_twice(spark, d, batch.run_incremental, fill="keep", profile=None, on_dates=touched.update)
    incremental.refresh_daily_averages(spark, table, out, sorted(touched))
    back = spark.read.parquet(out)
    return r6(back, "daily_avg", "rolling_avg").withColumn("date", F.col("date").cast("date"))


@query
def volume_daily(spark, d):
    return r6(A.daily_aggregation(V.volume(spark, d), ("reading_type",)), "avg", "sum")


@query
def volume_rolling(spark, d):
    return r6(TS.rolling_average(V.volume(spark, d)), "daily_avg", "rolling_avg")


@query
def volume_zscore(spark, d):
    scored = anomaly.with_zscore(V.volume(spark, d))
    return scored.groupBy("reading_type").agg(
        F.count("*").alias("rows"),
        F.count_if("is_statistical").alias("outliers"),
        F.round(F.max(F.abs("zscore")), 6).alias("largest"),
    )
