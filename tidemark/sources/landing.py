"""Landing files in which one odd field, record or file costs only itself.

JSON: every record is a VARIANT, and each column is taken from it by a conversion that gives null where it fails. Parquet: the files
are grouped by their own column types, found from the footers in parallel, and each group is read as it is before the cast. A file
that cannot be read becomes one corrupt row, so the counters come from the same rows as the data.
"""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalar import number_or_null, to_number, to_timestamp_ntz
from ..schema import RAW, RAW_PARQUET

CORRUPT = "_corrupt_record"
# Footer jobs that run at the same time when the files of a folder do not agree.
FOOTER_JOBS = 8


def whole_number(text: Column) -> Column:
    """Text to bigint; what is no whole number becomes null instead of being cut or rounded."""
    number = text.try_cast("double")
    exact = (number == F.floor(number)) & (F.abs(number) < 2.0**53)
    return F.coalesce(F.when(text.rlike(r"^\s*[+-]?\d+\s*$"), text.try_cast("bigint")), F.when(exact, number.cast("bigint")))


def rounded(text: Column) -> Column:
    """Text or number to int, fractions rounded; junk becomes null."""
    return F.floor(text.try_cast("double") + 0.5).try_cast("int")


def in_window(df: DataFrame, start, end) -> DataFrame:
    """Files by modification time, both ends inclusive; open ends take everything."""
    changed = F.col("_metadata.file_modification_time")
    if start is not None:
        df = df.where(changed >= F.lit(start).cast("timestamp"))
    if end is not None:
        df = df.where(changed <= F.lit(end).cast("timestamp"))
    return df


# --- JSON ---
def json_records(text: Column) -> Column:
    """array<variant> of the records of a JSON text, one object or an array; null if the text is no JSON."""
    body = F.regexp_replace(text, "^﻿", "")
    listed = F.when(body.rlike(r"^\s*\["), body).when(body.rlike(r"\S"), F.concat(F.lit("["), body, F.lit("]")))
    return F.from_json(listed, "array<variant>")


def record_columns(record: str = "record") -> list[Column]:
    """The raw columns of a VARIANT record. Numbers and true or false in text columns become their text."""

    def part(path: str, kind: str = "string") -> Column:
        return F.try_variant_get(F.col(record), f"$.{path}", kind)

    made = []
    for f in RAW.fields:
        if f.name == "location":
            column = F.struct(part("location.field").alias("field"), *[to_number(part(f"location.{n}")).alias(n) for n in ("latitude", "longitude")])
        elif isinstance(f.dataType, T.LongType):
            column = whole_number(part(f.name))
        else:
            column = part(f.name)
        made.append(column.alias(f.name))
    return made


def read_raw_json(
    spark: SparkSession, path: str | list[str], start=None, end=None, lines: bool = False, glob: str | None = None
) -> DataFrame:
    """Landing JSON files holding one object or an array, or with ``lines`` one record per line.

    Columns of ``RAW``, ``source_file`` and the corrupt text. A broken file (or line) becomes one corrupt row; a field that does
    not convert is null and costs neither its record nor the file. An array element that is no object is a record without
    fields. A file of no bytes has no row.
    """
    reader = spark.read.option("recursiveFileLookup", True)
    reader = reader.option("pathGlobFilter", glob or ("*.jsonl" if lines else "*.json"))
    text = in_window(reader.text(path, wholetext=not lines), start, end).select("value", F.col("_metadata.file_path").alias("source_file"))
    if lines:
        text = text.where(F.trim("value") != "")
    parsed = text.select("source_file", "value", json_records(F.col("value")).alias("records"))
    broken = F.when(F.col("records").isNull(), F.left("value", F.lit(1000)))
    record = F.explode(F.coalesce("records", F.array(F.lit(None).cast("variant")))).alias("record")
    return parsed.select("source_file", broken.alias(CORRUPT), record).select(*record_columns(), CORRUPT, "source_file")


# --- Parquet ---
def _parquet_reader(spark: SparkSession, tolerant: bool = False):
    return spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet").option("ignoreCorruptFiles", tolerant)


def _common_schema(spark: SparkSession, paths: list[str]) -> tuple[T.StructType | None, str]:
    """Schema of the files if their footers agree (read by a Spark job), else why not. No files: an empty schema."""
    try:
        return _parquet_reader(spark).option("mergeSchema", True).parquet(*paths).schema, ""
    except (PySparkException, Py4JJavaError) as error:
        text = str(error)
        if "UNABLE_TO_INFER_SCHEMA" in text:
            return T.StructType([]), ""
        if "PATH_NOT_FOUND" in text or "PATH_ALREADY" in text:
            raise
        return None, text.split("Caused by: ")[-1].split("\n")[0][:300]


def parquet_groups(spark: SparkSession, path: str | list[str]) -> tuple[list[tuple[T.StructType, list[str]]], dict[str, str]]:
    """([(schema, paths)], {unreadable file: reason}): the files of a folder by the types of their raw columns.

    Files that agree need one job over their footers. Otherwise the sorted list of files is halved until each part agrees; files of
    one origin stand side by side, so the number of jobs grows with the changes of type along the list. The driver holds the names of
    the files, as Spark's own listing does.
    """
    paths = [path] if isinstance(path, str) else [p for p in path if p.endswith(".parquet")]
    if not paths:
        return [], {}
    schema, _ = _common_schema(spark, paths)
    if schema is not None:
        return ([(schema, paths)] if schema.fields else []), {}
    listing = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", True).load(paths)
    todo = [sorted(r.path for r in listing.select("path").toLocalIterator())]
    groups: dict[str, tuple[T.StructType, list[str]]] = {}
    bad: dict[str, str] = {}
    with ThreadPoolExecutor(FOOTER_JOBS) as pool:
        while todo:
            later = []
            for files, (schema, why) in zip(todo, pool.map(lambda own: _common_schema(spark, own), todo), strict=True):
                if schema is not None:
                    known = T.StructType(sorted((f for f in schema.fields if f.name in RAW.names), key=lambda f: f.name))
                    groups.setdefault(known.json(), (known, []))[1].extend(files if schema.fields else [])
                elif len(files) == 1:
                    bad[files[0]] = why
                else:
                    later += [files[: len(files) // 2], files[len(files) // 2 :]]
            todo = later
    return [(schema, files) for schema, files in groups.values() if files], bad


def fitted(name: str, own: T.DataType | None, wanted: T.DataType, column: Column | None = None) -> Column:
    """A column of any type as the wanted one; null where a value does not convert, or where there is no such column."""
    column = F.col(name) if column is None else column
    if own is None or isinstance(own, T.NullType):
        return F.lit(None).cast(wanted)
    if isinstance(wanted, T.StructType):
        parts = {f.name: f.dataType for f in own.fields} if isinstance(own, T.StructType) else {}
        return F.struct(*[fitted(f.name, parts.get(f.name), f.dataType, column[f.name] if f.name in parts else None).alias(f.name) for f in wanted.fields])
    if isinstance(own, (T.StructType, T.ArrayType, T.MapType)):
        return F.to_json(column) if isinstance(wanted, T.StringType) else F.lit(None).cast(wanted)
    if own == wanted:
        return number_or_null(column) if isinstance(wanted, T.DoubleType) else column
    if isinstance(wanted, T.TimestampNTZType):
        if isinstance(own, T.StringType):
            return to_timestamp_ntz(column)
        if isinstance(own, T.TimestampType):
            return F.to_utc_timestamp(column, F.current_timezone()).cast(wanted)
        return column.cast(wanted) if isinstance(own, T.DateType) else F.lit(None).cast(wanted)
    text = column.cast("string")
    if isinstance(wanted, T.LongType):
        return whole_number(text)
    if isinstance(wanted, T.IntegerType):
        return rounded(text)
    return to_number(text) if isinstance(wanted, T.DoubleType) else text


def read_raw_parquet(
    spark: SparkSession, path: str | list[str], schema: T.StructType = RAW_PARQUET, start=None, end=None, skip_bad_files: bool = True
) -> DataFrame:
    """Landing Parquet files of any column types as ``schema``, with ``source_file`` and the corrupt text.

    A file with an unreadable footer becomes one corrupt row; rows behind a damage inside a file are missing from the result, and
    ``short_files`` names that file. Without ``skip_bad_files`` both stop the run.
    """
    groups, bad = parquet_groups(spark, path)
    if bad and not skip_bad_files:
        raise ValueError(f"unreadable Parquet file {min(bad)}: {bad[min(bad)]}")
    nothing = spark.createDataFrame([], T.StructType([*schema.fields, T.StructField(CORRUPT, T.StringType()), T.StructField("source_file", T.StringType())]))
    parts = []
    for own, files in groups:
        kinds = {f.name: f.dataType for f in own.fields}
        needed = T.StructType([f for f in own.fields if f.name in schema.names])
        df = in_window(_parquet_reader(spark, skip_bad_files).schema(needed).parquet(*files), start, end)
        columns = [fitted(f.name, kinds.get(f.name), f.dataType).alias(f.name) for f in schema.fields]
        parts.append(df.select(*columns, F.lit(None).cast("string").alias(CORRUPT), F.col("_metadata.file_path").alias("source_file")))
    if bad:
        rows = [(*[None] * len(schema.fields), why or "unreadable", file) for file, why in sorted(bad.items())]
        parts.append(spark.createDataFrame(rows, nothing.schema))
    if not parts:
        return nothing
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more)
    return out


def plain_name(c: str) -> Column:
    """File name of the row metadata without its encoding of blanks and other signs."""
    return F.expr(f"url_decode(replace({c}, '+', '%2B'))")


def short_files(spark: SparkSession, path: str | list[str], rows: DataFrame, start=None, end=None) -> DataFrame:
    """(source_file, expected, found): Parquet files of which ``rows`` lacks some rows, by the counts in their footers."""
    groups, _ = parquet_groups(spark, path)
    found = rows.where(F.col(CORRUPT).isNull()).groupBy("source_file").agg(F.count(F.lit(1)).alias("found"))
    expected = None
    for own, files in groups:
        df = in_window(_parquet_reader(spark).schema(T.StructType(own.fields[:1])).parquet(*files), start, end)
        # No column is read: Parquet answers from its footers.
        counts = df.groupBy(F.col("_metadata.file_path").alias("source_file")).agg(F.count(F.lit(1)).alias("expected"))
        expected = counts if expected is None else expected.unionByName(counts)
    if expected is None:
        return spark.createDataFrame([], "source_file string, expected long, found long")
    return expected.join(found, "source_file", "left").fillna(0, ["found"]).where(F.col("found") < F.col("expected"))

