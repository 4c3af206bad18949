"""Session settings and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager
from functools import cache

from pyspark.sql import DataFrame, SparkSession

# AQE sizes shuffles, splits skewed joins and skewed write partitions at run time.
SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.optimizeSkewsInRebalancePartitions.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.parquet.compression.codec": "snappy",
    # A JSON record that names a field twice keeps the last value, as other readers of JSON do.
    "spark.sql.variant.allowDuplicateKeys": "true",
}


def build_session(app_name: str = "tidemark", master: str | None = None, **settings) -> SparkSession:
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **settings}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


@cache
def _local_scratch() -> str:
    """One temporary folder per process, for local runs without a configured folder."""
    return tempfile.mkdtemp(prefix="tidemark-")


def scratch_dir(spark: SparkSession, label: str = "stage") -> str:
    """A fresh path below the shared folder named by ``spark.checkpoint.dir``.

    One folder per application, so that a finished run can be cleared as a whole.
    Only a local master may fall back to a temporary folder: on a cluster the
    executors would not see the driver's disk.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors can reach")
        base = _local_scratch()
    return f"{base.rstrip('/')}/{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex}"


# Removes the shuffle files of a query as soon as it has ended.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

# Scratch tables that this process wrote and has not removed.
_tables: list[str] = []


@contextmanager
def shuffles_dropped(spark: SparkSession):
    """Queries that end inside leave no shuffle files; for writes, whose result is read from the table afterwards."""
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(CLEANUP)
        else:
            spark.conf.set(CLEANUP, before)


def written(df: DataFrame, label: str = "stage") -> DataFrame:
    """``df`` as a table in the scratch folder: short lineage, known size, safe when executors are lost.

    The shuffle files of the write go once it has ended; nothing reads them again, as later steps read the table.
    """
    spark = df.sparkSession
    path = scratch_dir(spark, label)
    with shuffles_dropped(spark):
        df.write.parquet(path)
    _tables.append(path)
    return spark.read.schema(df.schema).parquet(path)


def scratch_tables() -> list[str]:
    """Paths of the scratch tables that this process holds."""
    return list(_tables)


def release(spark: SparkSession, paths: list[str], *still_read: DataFrame) -> None:
    """Remove scratch tables, but for those that the given frames read.

    For flows of several steps, each of which is stored before the next one starts.
    """
    names = {name.split("/")[-2] for df in still_read for name in df.inputFiles()}
    for path in set(paths) & set(_tables):
        if path.split("/")[-1] not in names:
            _tables.remove(path)
            remove_path(spark, path)


def _located(spark: SparkSession, path: str):
    found = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return found.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), found


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether the file system of ``path`` has it; no job and no failing read."""
    files, found = _located(spark, path)
    return files.exists(found)


def remove_path(spark: SparkSession, path: str) -> None:
    """Remove a folder with all it holds, by one call of its file system; an absent one is no error."""
    files, found = _located(spark, path)
    files.delete(found, True)
