"""Batch flows: records in, cleaned, scored and flagged readings out."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalar as S
from ..functions.scalar import is_blank
from ..functions.validity import split_valid, timestamp_parses, validity
from ..operators import anomaly, cleaning
from ..operators.aggregates import validation_counters
from ..session import written
from ..sources.landing import CORRUPT, short_files
from ..sources.readers import ingest_summary, read_landing, typed
from ..sources.writers import append_readings
from ..streaming.incremental import load_new_files
from .load import calibrate, merge_load, state_home
from .runs import Run

__all__ = ["calibrate", "clean", "enrich", "load_files", "process_and_store", "process_records", "processing_report", "run_batch", "run_incremental"]


def transform_records(df: DataFrame) -> DataFrame:
    """Per-row changes: numeric value, lower-case type, score, hard-limit flag, metadata."""
    out = df.drop("extra_field", "errors", "is_valid")
    if "battery_level" not in out.columns:  # flat records may come without one
        out = out.withColumn("battery_level", F.lit(None).cast("string"))
    scored = out.withColumn("quality_score", S.quality_score())
    ready = typed(scored).withColumns(
        {"reading_type": S.normal_type(), "anomalous_reading": S.outside_hard_limits()}
    )
    return S.with_processing_metadata(ready)


def process_records(df: DataFrame | None, strict: bool = False) -> tuple[DataFrame, DataFrame]:
    """(transformed rows, quarantine) of a record batch. Nothing runs until a result is used."""
    if df is None:
        raise ValueError("no records given")
    kept, bad = split_valid(df, strict)
    return transform_records(kept), bad


def process_and_store(df: DataFrame | None, path: str, strict: bool = False) -> dict:
    """Validate, transform and append a record batch; returns the counters.

    The batch is written once for both. A missing time becomes the current one; a row whose time does not
    parse is not stored, it stays in the quarantine of ``process_records``.
    """
    if df is None:
        raise ValueError("no records given")
    batch = written(df, "records")
    timed = batch.where(is_blank("timestamp") | timestamp_parses(batch))
    out, _ = process_records(timed, strict)
    stored = append_readings(out.drop("processed_at"), path)
    totals = validation_counters(batch).first()
    return {
        "processed": stored,
        "stored": stored,
        "passed": totals["passed"],
        "failed": totals["failed"],
        "errors": totals["errors"],
    }


def clean(df: DataFrame, fill: str = "drop") -> DataFrame:
    """Drop duplicate keys, then drop or forward-fill missing values."""
    unique = cleaning.drop_duplicates(df)
    if fill == "drop":
        return cleaning.drop_missing(unique)
    if fill == "forward":
        return cleaning.forward_fill(unique)
    raise ValueError(f"Unknown fill policy: {fill}")


def enrich(df: DataFrame, profile: str = "config") -> DataFrame:
    """Calibrated value, quality score and the range and z-score flags of cleaned rows, within this frame."""
    scored = calibrate(df, profile).withColumn("quality_score", S.quality_score())
    flagged = anomaly.with_range_flag(anomaly.with_zscore(scored))
    return flagged.withColumn("anomalous_reading", F.col("is_range") | F.col("is_statistical"))


def load_files(
    spark: SparkSession,
    path: str | list[str],
    table_path: str,
    run: Run,
    fill: str = "drop",
    profile: str | None = "config",
    keep: str = "smallest_id",
    start=None,
    end=None,
    json_glob: str | None = None,
) -> dict:
    """Landing files (a folder or a list) into the table, with counters of every stage; see ``merge_load``.

    The files are parsed once: rows, counters and the choice of copies all come from that written frame.
    """
    with run.stage("ingestion") as seen:
        raw = read_landing(spark, path, start, end, json_glob=json_glob)
        verdicts = {"_ok": validity(raw, "ingest") & F.col(CORRUPT).isNull(), "_basic": validity(raw, "basic")}
        parsed = written(raw.withColumns(verdicts), "parsed")
        counts = ingest_summary(parsed, F.count_if("_basic").alias("valid")).first()
        total = counts["processed"] + counts["skipped"] + counts["errors"]
        seen |= {
            "files_processed": counts["files"],
            "records_read": total,
            "records_ingested": counts["processed"],
            "records_skipped": counts["skipped"],
            "records_broken": counts["errors"],
            "invalid_records": total - counts["valid"],
            "files_cut_short": short_files(spark, path, parsed, start, end).count(),
        }
    with run.stage("cleaning") as seen:
        good = parsed.where("_ok").drop("_ok", "_basic", CORRUPT)
        keys = good.select(*cleaning.DEDUP_KEY).distinct().count()
        seen |= {"duplicates_removed": counts["processed"] - keys, "records_transformed": keys}
    with run.stage("storage") as seen:
        stored = merge_load(good.drop("source_file"), table_path, fill, profile, keep)
        seen |= {"records_stored": stored["rows"], "outliers_detected": stored["outliers"], "dates_written": len(stored["dates"])}
    run.save()
    return stored


def run_incremental(
    spark: SparkSession, raw_path: str, table_path: str, checkpoint: str, fill: str = "drop", profile: str | None = "config",
    keep: str = "smallest_id", json_glob: str | None = None, on_dates=None, bytes_per_batch: int | None = None,
) -> None:
    """``run_batch`` for the JSON and Parquet files that the checkpoint has not seen, sub-folders included.

    The table is then what one batch run over all files would give. Each micro-batch is a run in the run table.
    """

    def load(paths: list[str], name: str) -> None:
        stored = load_files(spark, paths, table_path, Run(spark, state_home(table_path), name), fill, profile, keep, json_glob=json_glob)
        if on_dates and stored["dates"]:
            on_dates(stored["dates"])

    load_new_files(spark, raw_path, checkpoint, load, json_glob, bytes_per_batch)


def run_batch(
    spark: SparkSession,
    raw_path: str,
    table_path: str,
    fill: str = "drop",
    profile: str | None = "config",
    start=None,
    end=None,
    json_glob: str | None = None,
    keep: str = "smallest_id",
) -> dict:
    """Folder in, partitioned table out: ingest, clean, enrich, validate and merge into the table.

    Dates without new rows stay as they are, but for anomaly flags and filled values that the new rows change. Of equal keys the
    smallest id stays (of equal ids the newest load), or with ``keep="newest"`` the newest load. Counters come from the one
    parsed frame or are observed on the final write; times are the driver's clock.
    """
    run = Run(spark, state_home(table_path), f"batch-{uuid.uuid4().hex}")
    load_files(spark, raw_path, table_path, run, fill, profile, keep, start, end, json_glob)
    metrics = {metric: value if metric == "seconds" else int(value) for _, metric, value, _ in run.rows}
    seconds = sum(run.seconds(stage) for stage in ("ingestion", "cleaning", "storage"))
    return {
        **{k: v for k, v in metrics.items() if k != "seconds"},
        "validation_seconds": run.seconds("ingestion"),
        "cleaning_seconds": run.seconds("cleaning"),
        "storage_seconds": run.seconds("storage"),
        "processing_time_seconds": seconds,
        "average_records_per_second": metrics["records_stored"] / seconds,
    }


def processing_report(spark: SparkSession, metrics: dict) -> DataFrame:
    """Run metrics as rows (name, value)."""
    return spark.createDataFrame([(k, float(v)) for k, v in metrics.items()], "metric string, value double")
