"""Reading landing files, stored tables, logs and saved reports."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalar import flatten_location, number_or_null, to_number, to_timestamp_ntz
from ..functions.validity import validity
from ..operators.filters import ordered_slice
from ..schema import MAX_LANDING_BYTES, RAW, READINGS, require_columns
from .landing import CORRUPT, plain_name, read_raw_json, read_raw_parquet, rounded


def read_readings(spark: SparkSession, path: str) -> DataFrame:
    """The stored readings table; the ``date`` partition column is kept for pruning."""
    schema = T.StructType([*READINGS.fields, T.StructField("date", T.DateType())])
    return spark.read.schema(schema).parquet(path)


def read_parquet(
    spark: SparkSession, path: str, where: str | None = None, order_by: str | None = None, limit: int | None = None
) -> DataFrame:
    """Ad-hoc scan: filter, then order (any SQL sort list), then limit, each optional."""
    df = spark.read.parquet(path)
    if where:
        df = df.where(F.expr(where))
    if order_by:
        clause = order_by.replace("{", "{{").replace("}", "}}")
        df = spark.sql("SELECT * FROM {found} ORDER BY " + clause, found=df)
    return df if limit is None else df.limit(limit)


def typed(df: DataFrame) -> DataFrame:
    """Raw text columns to reading types; what does not convert becomes null."""
    out = flatten_location(df)
    changes = {}
    if isinstance(out.schema["timestamp"].dataType, T.StringType):
        changes["timestamp"] = to_timestamp_ntz("timestamp")
    if isinstance(out.schema["value"].dataType, T.StringType):
        changes["value"] = to_number("value")
    elif isinstance(out.schema["value"].dataType, T.DoubleType):
        changes["value"] = number_or_null("value")
    for name in ("battery_level", "signal_strength"):
        # A side column never costs the row: what is no number becomes null, fractions are rounded.
        if name in out.columns and isinstance(out.schema[name].dataType, T.StringType):
            changes[name] = rounded(F.col(name))
    return out.withColumns(changes)


def read_landing(
    spark: SparkSession, path: str | list[str], start=None, end=None, skip_bad_files: bool = True, json_glob: str | None = None
) -> DataFrame:
    """All JSON and Parquet files of a mixed folder (or a list of files) as typed rows; other files are not read.

    A broken file stays visible as a row with a corrupt text and costs nothing else. Without ``skip_bad_files`` broken Parquet
    stops the run.
    """
    columnar = read_raw_parquet(spark, path, start=start, end=end, skip_bad_files=skip_bad_files)
    text = read_raw_json(spark, path, start=start, end=end, glob=json_glob)
    return typed(columnar).unionByName(typed(text), allowMissingColumns=True)


def ingest(raw: DataFrame) -> DataFrame:
    """Rows that pass the ``ingest`` rules, typed and flattened."""
    require_columns(raw.columns)
    good = raw.where(F.col(CORRUPT).isNull()) if CORRUPT in raw.columns else raw
    return typed(good.where(validity(good, "ingest"))).drop(CORRUPT)


def ingest_summary(raw: DataFrame, *extra: Column) -> DataFrame:
    """Processed, skipped and broken rows and the number of files, in one pass."""
    broken = F.col(CORRUPT).isNotNull() if CORRUPT in raw.columns else F.lit(False)
    ok = validity(raw, "ingest") & ~broken
    return raw.agg(
        F.count_if(ok).alias("processed"),
        F.count_if(~ok & ~broken).alias("skipped"),
        F.count_if(broken).alias("errors"),
        F.count_distinct(F.when(~broken, F.col("source_file"))).alias("files"),
        *extra,
    )


def records(spark: SparkSession, rows: list[dict] | dict | None, schema: T.StructType = RAW) -> DataFrame:
    """A batch of records held by the caller, as a raw DataFrame."""
    if rows is None:
        raise ValueError("no records given")
    rows = [rows] if isinstance(rows, dict) else rows
    text = {f.name for f in schema.fields if isinstance(f.dataType, T.StringType)}

    def cell(row, name):
        v = row.get(name)
        return str(v) if name in text and v is not None else v

    return spark.createDataFrame([tuple(cell(r, f.name) for f in schema.fields) for r in rows], schema)


def landing_files(spark: SparkSession, path: str, glob: str = "*", max_bytes: int = MAX_LANDING_BYTES) -> DataFrame:
    """Files of a landing folder with size and reject reason; contents are not read."""
    files = (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", glob)
        .option("recursiveFileLookup", True)
        .load(path)
        .select("path", "length", "modificationTime")
    )
    return files.select(
        "path",
        F.element_at(F.split("path", "/"), -1).alias("file_name"),
        F.col("length").alias("size_bytes"),
        (F.col("length") / F.lit(1048576.0)).alias("size_mb"),
        F.col("modificationTime").alias("modified"),
        F.when(~F.col("path").endswith(".parquet"), "Only .parquet files are accepted")
        .when(F.col("length") > max_bytes, F.lit(f"File is larger than {max_bytes} bytes"))
        .alias("reject_reason"),
    )


def unread_files(spark: SparkSession, path: str, raw: DataFrame, glob: str = "*.parquet") -> DataFrame:
    """Files of the folder that gave no row (corrupt or empty). Only footers are read for it."""
    listed = landing_files(spark, path, glob).select(F.col("path").alias("source_file"))
    good = raw.where(F.col(CORRUPT).isNull()) if CORRUPT in raw.columns else raw
    # The row metadata encodes blanks and other signs in names, the listing does not.
    seen = good.select(plain_name("source_file").alias("source_file")).distinct()
    return listed.join(seen, "source_file", "left_anti")


def read_logs(spark: SparkSession, path: str, level: str | None = None, lines: int | None = 100) -> DataFrame:
    """Newest log entries, or all with ``lines=None``. JSON lines match the level exactly, other lines when they contain it."""
    shape = "level string, message string, timestamp string"
    entry = F.from_json("value", shape)
    text = spark.read.text(path).where(F.trim("value") != "").select("value", entry.alias("e"))
    parsed = text.select(
        F.col("e.level").alias("level"),
        F.coalesce("e.message", "value").alias("message"),
        F.col("e.timestamp").alias("timestamp"),
        F.col("e.level").isNull().alias("is_text"),
    )
    if level is not None:
        hit = F.when(F.col("is_text"), F.lower("message").contains(level.lower())).otherwise(F.col("level") == level)
        parsed = parsed.where(hit)
    entries = parsed.drop("is_text")
    newest = [F.col("timestamp").desc_nulls_last(), F.col("message").desc(), F.col("level").asc()]
    return entries.orderBy(*newest) if lines is None else ordered_slice(entries, newest, lines)


HEADER = "header"


def report_catalog(spark: SparkSession, path: str) -> DataFrame:
    """Saved reports with type, time, path and size, newest first.

    Reads the one-row headers and the file listing; report rows are not read.
    """
    shape = "report_id string, type string, generated_at string, sections array<string>"
    heads = spark.read.schema(shape).json(f"{path}/*/{HEADER}")
    files = landing_files(spark, path, "*.json")
    # <path>/<report id>/<section>/<file>
    sizes = files.groupBy(F.element_at(F.split("path", "/"), -3).alias("report_id")).agg(
        F.min(F.regexp_replace("path", "/[^/]+/[^/]+$", "")).alias("file_path"),
        F.sum("size_mb").alias("file_size_mb"),
    )
    listed = heads.join(sizes, "report_id")
    return listed.select("report_id", "type", "generated_at", "sections", "file_path", "file_size_mb").orderBy(
        F.col("generated_at").desc(), "report_id"
    )


def read_report(
    spark: SparkSession, path: str, report_id: str, section: str = HEADER, schema: str | T.StructType | None = None
) -> DataFrame:
    """One section of a saved report; a missing report is an error."""
    try:
        return (spark.read.schema(schema) if schema else spark.read).json(f"{path}/{report_id}/{section}")
    except AnalysisException as error:
        raise ValueError(f"Report {report_id} not found") from error


def read_stored_json(spark: SparkSession, path: str, schema: T.StructType = RAW, lines: bool = True) -> DataFrame:
    """All stored JSON files of a folder but its index."""
    df = (
        spark.read.schema(schema)
        .option("recursiveFileLookup", True)
        .option("multiLine", not lines)
        .json(path)
    )
    return df.where(F.col("_metadata.file_name") != "index.json")
