"""Hourly coverage by bit masks: one 24-bit number per series and day says which hours have a reading.

Masks of the same day are united by a bitwise or, so loads merge them without reading readings again. Every series is
judged over its own span, so a reading with a wrong clock changes its own series only, and no empty hours are made as rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scalar import round_half_up
from ..session import path_exists
from .timeseries import SERIES

MASKS = "sensor_id string, reading_type string, mask int, date date"


def daily_masks(df: DataFrame, keys=SERIES) -> DataFrame:
    """(keys, mask, date): bit h is set if the series has a reading in hour h of the day."""
    bit = F.call_function("shiftleft", F.lit(1), F.hour("timestamp"))
    rows = df.where(F.col("timestamp").isNotNull())
    return rows.groupBy(*keys, F.to_date("timestamp").alias("date")).agg(F.bit_or(bit).alias("mask")).select(*keys, "mask", "date")


def refresh_masks(spark: SparkSession, table: DataFrame, path: str, dates: list | None = None) -> None:
    """Store the masks beside the table; after a load only for the dates that it wrote."""
    masks = daily_masks(table if dates is None else table.where(F.col("date").isin(dates)))
    if dates:
        # A mask of no hours marks each date, so that one that became empty is replaced, too.
        masks = masks.unionByName(spark.createDataFrame([(None, None, 0, d) for d in dates], MASKS))
    masks.hint("rebalance", "date").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("date").parquet(path)


def read_masks(spark: SparkSession, path: str) -> DataFrame:
    df = spark.read.schema(MASKS).parquet(path) if path_exists(spark, path) else spark.createDataFrame([], MASKS)
    return df.where(F.col("mask") != 0)


def _first_hour(mask):
    """Position of the lowest set bit."""
    return F.bit_count(mask.bitwiseAND(-mask) - 1)


def _last_hour(mask):
    """Position of the highest set bit: the logarithm of a number below 2^24 is exact enough for it."""
    return F.floor(F.log2(mask.cast("double"))).cast("int")


def _number(date, hour):
    """Hours since 1970."""
    return F.unix_date(date).cast("long") * 24 + hour


def mask_coverage(masks: DataFrame, keys=SERIES) -> DataFrame:
    """Per series: hours with a reading, hours from its first to its last reading, share in percent."""
    m, d = F.col("mask"), F.col("date")
    spans = masks.groupBy(*keys).agg(
        F.sum(F.bit_count(m)).cast("bigint").alias("actual_readings"),
        F.min(_number(d, _first_hour(m))).alias("lo"),
        F.max(_number(d, _last_hour(m))).alias("hi"),
    )
    out = spans.withColumn("expected_readings", F.col("hi") - F.col("lo") + 1)
    share = round_half_up(F.lit(100.0) * F.col("actual_readings") / F.col("expected_readings"), 1)
    return out.withColumn("coverage_percentage", share).select(*keys, "actual_readings", "expected_readings", "coverage_percentage")


def _inner_gaps(masks: DataFrame):
    """Runs of unset bits between set ones of a mask, as structs of first hour and length."""
    hours = F.filter(F.sequence(F.lit(0), F.lit(23)), lambda h: F.call_function("shiftright", F.col("mask"), h).bitwiseAND(1) == 1)
    pairs = F.transform(F.slice("hours", 2, 24), lambda h, i: F.struct((F.get("hours", i) + 1).alias("start"), (h - F.get("hours", i) - 1).alias("length")))
    return masks.withColumn("hours", hours).withColumn("inner", F.filter(pairs, lambda p: p["length"] > 0))


def mask_gaps(masks: DataFrame, keys=SERIES, min_hours: int = 1) -> DataFrame:
    """(keys, gap_start, hours): runs of at least ``min_hours`` hours without a reading, within the span of the series.

    The window sees one row per series and day with a reading; a gap of any length is one row.
    """
    m, d = F.col("mask"), F.col("date")
    order = W.partitionBy(*keys).orderBy("date")
    # The lag is taken from its own columns: the runs inside a day come first, then the run before its first reading.
    ends = _inner_gaps(masks).withColumns({"first": _number(d, _first_hour(m)), "previous": F.lag(_number(d, _last_hour(m))).over(order)})
    lead = F.when(F.col("previous").isNotNull(), F.struct((F.col("previous") + 1).alias("start"), (F.col("first") - F.col("previous") - 1).alias("length")))
    inner = F.transform("inner", lambda p: F.struct(_number(d, p["start"]).alias("start"), p["length"].cast("long").alias("length")))
    runs = ends.select(*keys, F.explode(F.array_compact(F.concat(inner, F.array(lead)))).alias("run"))
    start = F.timestamp_seconds(F.col("run.start") * 3600)
    start = F.to_utc_timestamp(start, F.current_timezone()).cast("timestamp_ntz")
    return runs.where(F.col("run.length") >= min_hours).select(*keys, start.alias("gap_start"), F.col("run.length").alias("hours"))
