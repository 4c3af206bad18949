"""Writing readings, exports, reports, indexes, and keyed table changes."""

from __future__ import annotations

from urllib.parse import unquote

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..functions.scalar import flatten_location, now_ntz, report_type
from ..operators.lookup import measured
from ..schema import ERROR_EXPORT, EXPORT_FORMATS, METRICS, READINGS
from ..session import remove_path, written
from .readers import HEADER, read_readings, read_report

# Text sinks cut times to milliseconds unless told otherwise.
TEXT_TIME = {"timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}


def with_defaults(df: DataFrame) -> DataFrame:
    """Fill the insert defaults and fit the columns to the table; zero stays zero."""
    flat = flatten_location(df)
    have = set(flat.columns)

    def known(name):
        kind = READINGS[name].dataType
        return F.col(name).cast(kind) if name in have else F.lit(None).cast(kind)

    fill = {f.name: known(f.name) for f in READINGS.fields}
    fill["timestamp"] = F.coalesce(fill["timestamp"], now_ntz())
    fill["data_quality"] = F.coalesce(fill["data_quality"], F.lit("unknown"))
    fill["processed_timestamp"] = F.coalesce(fill["processed_timestamp"], now_ntz())
    fill["created_at"] = F.coalesce(fill["created_at"], now_ntz())
    fill["quality_score"] = F.coalesce(fill["quality_score"], F.lit(100.0))
    out = flat.select(*[c.alias(name) for name, c in fill.items()])
    # Rows that bring no id get one from their key. A 64-bit hash is stable, but among n rows
    # about n^2 / 2^65 pairs share a value: tables of trillions of rows should bring their ids.
    key = F.xxhash64("sensor_id", "timestamp", "reading_type")
    return out.withColumn("id", F.coalesce("id", key))


def write_readings(
    df: DataFrame,
    path: str,
    mode: str = "append",
    partition_by=("date",),
    overwrite_dates: bool = False,
    counters: dict | None = None,
    without: tuple[str, ...] = (),
) -> dict:
    """Date-partitioned snappy Parquet, sorted by sensor and time within each file.

    The rebalance step gathers the rows of a date and lets AQE cut a large date
    into several even files, so no date is written by a single task. ``counters`` may use the columns
    ``without``, which are not stored.
    """
    dated = df.withColumn("date", F.to_date("timestamp"))
    keys = list(partition_by)
    order = keys + [c for c in ("sensor_id", "timestamp") if c not in keys]
    seen, named = Observation(), {"rows": F.count(F.lit(1)), **(counters or {})}
    laid_out = dated.hint("rebalance", *keys).sortWithinPartitions(*order)
    laid_out = laid_out.observe(seen, *[c.alias(k) for k, c in named.items()]).drop(*without)
    writer = laid_out.write.mode(mode).partitionBy(*keys).option("compression", "snappy")
    if overwrite_dates:
        writer = writer.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    writer.parquet(path)
    return observed(seen, **dict.fromkeys(named, 0))


def observed(seen: Observation, **defaults) -> dict:
    """Observed counters as integers. A plan that Spark folds to an empty one leaves no counters."""
    try:
        found = {k: v for k, v in seen.get.items() if v is not None}
    except Py4JJavaError as error:
        if "toPyRow" not in str(error):
            raise
        found = {}
    return {k: int(v) for k, v in {**defaults, **found}.items()}


def append_readings(df: DataFrame, path: str) -> int:
    """Insert with defaults; returns the number of rows written."""
    return write_readings(with_defaults(df), path)["rows"]


def _hits(table: DataFrame, keys: DataFrame, partition_by: list[str]) -> dict[tuple, int]:
    """Rows to change per partition: at most one entry per table partition reaches the driver."""
    columns = list(dict.fromkeys(["id", "date", *partition_by]))
    hit = table.select(*columns).join(measured(keys), "id", "left_semi")
    return {tuple(r)[:-1]: r["n"] for r in hit.groupBy(*partition_by).agg(F.count("*").alias("n")).collect()}


def _dates(hits: dict[tuple, int], partition_by: list[str]) -> list:
    return sorted({key[partition_by.index("date")] for key in hits})


def update_readings(spark: SparkSession, path: str, updates: DataFrame, partition_by=("date",)) -> int:
    """Set the columns of ``updates`` on rows with the same id; a null keeps the old value.

    Only the date partitions that hold such rows are rewritten. The ids of
    ``updates`` must be unique; the frame is evaluated once. Returns the number of rows changed.
    """
    fixed = {"timestamp", *partition_by} & set(updates.columns)
    if fixed:
        raise ValueError(f"{sorted(fixed)} decide the partition: delete and append instead")
    updates = written(updates, "updates")
    if updates.groupBy("id").count().where("count > 1").take(1):
        raise ValueError("several updates have the same id")
    keys = list(partition_by)
    table = read_readings(spark, path)
    hits = _hits(table, updates.select("id"), keys)
    if not hits:
        return 0
    columns = [c for c in updates.columns if c != "id"]
    new = updates.select("id", *[F.col(c).alias(f"_new_{c}") for c in columns])
    joined = table.where(F.col("date").isin(_dates(hits, keys))).join(measured(new), "id", "left")
    changed = joined.withColumns({c: F.coalesce(f"_new_{c}", c) for c in columns}).select(*table.columns)
    write_readings(changed, path, partition_by=keys, overwrite_dates=True)
    return sum(hits.values())


def delete_readings(spark: SparkSession, path: str, ids: DataFrame, partition_by=("date",)) -> int:
    """Remove rows by id; rewrites the touched dates and empties partitions left without rows."""
    keys = list(partition_by)
    table = read_readings(spark, path)
    doomed = ids.select("id").distinct()
    hits = _hits(table, doomed, keys)
    if not hits:
        return 0
    touched = table.where(F.col("date").isin(_dates(hits, keys)))
    # Rows per partition come from file footers.
    folder = F.min(F.regexp_replace(F.col("_metadata.file_path"), "/[^/]+$", ""))
    held = touched.groupBy(*keys).agg(folder.alias("folder"), F.count("*").alias("n")).collect()
    emptied = [unquote(r["folder"]) for r in held if hits.get(tuple(r)[:-2]) == r["n"]]
    if len(emptied) < len(held):
        kept = touched.join(measured(doomed), "id", "left_anti")
        write_readings(kept, path, partition_by=keys, overwrite_dates=True)
    for folder in emptied:
        # A partition without rows is not part of a dynamic overwrite; removing it takes no job.
        remove_path(spark, folder)
    return sum(hits.values())


def write_daily_lines(df: DataFrame, path: str) -> None:
    """Append to one JSON-lines folder per day."""
    dated = df.withColumn("date", F.to_date("timestamp"))
    dated.hint("rebalance", "date").write.mode("append").options(**TEXT_TIME).partitionBy("date").json(path)


def write_json(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).options(**TEXT_TIME).option("ignoreNullFields", False).json(path)


def export(df: DataFrame, path: str, fmt: str) -> str:
    """Write as csv, json or parquet. Files are written in parallel, one per partition."""
    kind = fmt.lower()
    if kind not in EXPORT_FORMATS:
        raise ValueError(f"{ERROR_EXPORT}{fmt}")
    writer = df.write.mode("overwrite").options(**TEXT_TIME)
    if kind == "csv":
        writer.option("header", True).option("escape", '"').csv(path)
    elif kind == "json":
        writer.option("ignoreNullFields", False).json(path)
    else:
        writer.parquet(path)
    return path


def master_index(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """Per file: size, change time and rows, plus one total row. Index files are not counted.

    Row counts need no column: Parquet answers them from its footers.
    """
    reader = spark.read.option("recursiveFileLookup", True)
    df = reader.format(fmt).schema("sensor_id string").load(path)
    files = df.groupBy(
        F.col("_metadata.file_path").alias("file_path"),
        F.col("_metadata.file_size").alias("size_bytes"),
        F.col("_metadata.file_modification_time").alias("modified"),
    ).agg(F.count("*").alias("record_count"))
    files = files.where(~F.col("file_path").endswith("/index.json"))
    return files.rollup("file_path").agg(
        F.sum("record_count").alias("record_count"),
        F.sum("size_bytes").alias("size_bytes"),
        F.count("*").alias("file_count"),
        F.max("modified").alias("modified"),
    )


def save_report(sections: dict[str, DataFrame], path: str, report_id: str) -> None:
    """One folder per report: a one-row header and one folder of JSON lines per section."""
    for name, rows in sections.items():
        write_json(rows, f"{path}/{report_id}/{name}")
    spark = next(iter(sections.values())).sparkSession
    head = spark.range(1).select(
        F.lit(report_id).alias("report_id"),
        report_type(F.lit(report_id)).alias("type"),
        F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'").alias("generated_at"),
        F.array(*[F.lit(name) for name in sections]).alias("sections"),
    )
    write_json(head.coalesce(1), f"{path}/{report_id}/{HEADER}")


def export_report(spark: SparkSession, path: str, report_id: str, out: str, fmt: str = "json") -> str:
    """A saved report as JSON sections, or as CSV of its metric rows (else id, time and type)."""
    head = read_report(spark, path, report_id)
    if fmt.lower() == "csv":
        if "metrics" in head.first()["sections"]:
            return export(read_report(spark, path, report_id, "metrics", METRICS), out, fmt)
        return export(head.select("report_id", "generated_at", "type"), out, fmt)
    if fmt.lower() != "json":
        raise ValueError(f"{ERROR_EXPORT}{fmt}")
    for name in head.first()["sections"]:
        export(read_report(spark, path, report_id, name), f"{out}/{name}", "json")
    return out
