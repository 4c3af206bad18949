"""New landing files since the last call, and the daily averages of the dates that changed."""

from __future__ import annotations

import zlib
from collections.abc import Callable
from datetime import timedelta
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.timeseries import rolling_average
from ..schema import ROLLING_DAYS
from ..sources.readers import read_readings

LISTING = "path string, modificationTime timestamp, length long, content binary"


def load_new_files(
    spark: SparkSession,
    raw_path: str,
    checkpoint: str,
    load: Callable[[list[str], str], None],
    json_glob: str | None = None,
    bytes_per_batch: int | None = None,
) -> None:
    """Call ``load(paths, name)`` for the JSON and Parquet files not seen before, sub-folders included, and stop.

    The stream only finds the files and remembers them in the checkpoint; it does not read them, so files of any kind and of any column
    types go through one load. ``name`` is the same when a batch is repeated after a failure. A forced reprocess is the same call
    with a fresh checkpoint. ``bytes_per_batch`` splits a long backlog into several batches; no file is left out.
    """
    glob = "{*.parquet," + (json_glob or "*.json") + "}"
    files = spark.readStream.format("binaryFile").schema(LISTING).option("pathGlobFilter", glob).option("recursiveFileLookup", True)
    if bytes_per_batch:
        files = files.option("maxBytesPerTrigger", bytes_per_batch)
    source = f"{zlib.crc32(checkpoint.encode()):08x}"

    def run(batch: DataFrame, number: int) -> None:
        paths = [r["path"] for r in batch.select("path").collect()]  # one name per new file
        if paths:
            load(paths, f"stream-{source}-{number:09d}")

    query = (
        files.load(raw_path)
        .select("path")
        .writeStream.foreachBatch(run)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()


def date_bands(dates: list, before: int, after: int) -> list[tuple]:
    """Merge ``[d - before, d + after]`` of all dates into few non-overlapping ranges."""
    bands: list[list] = []
    for d in sorted(set(dates)):
        lo, hi = d - timedelta(days=before), d + timedelta(days=after)
        if bands and lo <= bands[-1][1] + timedelta(days=1):
            bands[-1][1] = hi
        else:
            bands.append([lo, hi])
    return [tuple(b) for b in bands]


def _within(bands: list[tuple]) -> Column:
    return reduce(lambda a, b: a | b, [F.col("date").between(lo, hi) for lo, hi in bands])


def refresh_daily_averages(spark: SparkSession, table_path: str, out_path: str, dates: list) -> None:
    """Recompute daily and rolling averages of the dates that changed and overwrite those days.

    A changed day moves the rolling average of the following days, and each of
    those needs the days before it: reads and writes stay within that band.
    """
    if not dates:
        return
    reach = ROLLING_DAYS - 1
    near = read_readings(spark, table_path).where(_within(date_bands(dates, reach, reach)))
    averages = rolling_average(near).where(_within(date_bands(dates, 0, reach)))
    averages.hint("rebalance", "date").write.mode("overwrite").option(
        "partitionOverwriteMode", "dynamic"
    ).partitionBy("date").parquet(out_path)
