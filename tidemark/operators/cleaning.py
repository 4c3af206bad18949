"""Duplicate removal, missing values and concatenation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .layout import CHUNK, POS, sorted_layout

DEDUP_KEY = ("sensor_id", "timestamp", "reading_type")
# Largest (sensor, type) series that one window task may sort.
SERIES_ROWS = 2_000_000


def drop_duplicates(df: DataFrame, key=DEDUP_KEY, order=("id",)) -> DataFrame:
    """Keep the first row of every key in the given order.

    ``row_number() = 1`` lets Spark keep one row per key on the map side before
    the shuffle, so a key with very many copies never meets in one task.
    """
    first = W.partitionBy(*key).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(first)).where(F.col("_rn") == 1).drop("_rn")


def duplicate_count(df: DataFrame, key=DEDUP_KEY) -> DataFrame:
    """Rows, distinct keys and rows to remove, from counts per key."""
    per_key = df.groupBy(*key).agg(F.count("*").alias("n"))
    return per_key.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("total_rows"),
        F.count("*").alias("unique_rows"),
        F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicates_removed"),
    )


def drop_missing(df: DataFrame) -> DataFrame:
    return df.where(F.col("value").isNotNull())


def forward_fill(df: DataFrame, keys=("sensor_id", "reading_type"), series_rows: int = SERIES_ROWS) -> DataFrame:
    """Replace a null value by the last earlier value of the same series.

    Series sizes are counted first. When one is too large for a single window
    task, the rows are laid out in sorted files, filled within each file, and
    the last value is carried from file to file.
    """
    keys = list(keys)
    sizes = df.groupBy(*keys).agg(F.count("*").alias("n"))
    largest = sizes.agg(F.max("n")).first()[0] or 0
    if largest <= series_rows:
        rows = W.partitionBy(*keys).orderBy("timestamp", "id").rowsBetween(W.unboundedPreceding, 0)
        return df.withColumn("value", F.last("value", ignorenulls=True).over(rows))
    return _fill_by_chunk(df, keys)


def _fill_by_chunk(df: DataFrame, keys: list[str]) -> DataFrame:
    layout = sorted_layout(df, [F.col(c) for c in (*keys, "timestamp", "id")])
    local = W.partitionBy(CHUNK, *keys).orderBy(POS).rowsBetween(W.unboundedPreceding, 0)
    filled = layout.withColumn("value", F.last("value", ignorenulls=True).over(local))
    ends = layout.groupBy(*keys, CHUNK).agg(
        F.max_by("value", F.when(F.col("value").isNotNull(), F.col(POS))).alias("last_value")
    )
    earlier = W.partitionBy(*keys).orderBy(CHUNK).rowsBetween(W.unboundedPreceding, -1)
    carry = ends.withColumn("carry", F.last("last_value", ignorenulls=True).over(earlier))
    # In sorted files only the first series of a file can continue an earlier
    # file: at most one carry row per file, so the table is safe to broadcast.
    carry = carry.where(F.col("carry").isNotNull()).select(CHUNK, *[F.col(k).alias(f"_{k}") for k in keys], "carry")
    same = F.col(f"{CHUNK}") == F.col("_c")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
    out = filled.join(F.broadcast(carry.withColumnRenamed(CHUNK, "_c")), same, "left")
    return out.withColumn("value", F.coalesce("value", "carry")).select(*df.columns)


def concatenate(*frames: DataFrame) -> DataFrame:
    """All rows of all frames, matched by column name; duplicates are kept."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
