"""Deep pages without a full sort: rows per hour say where a page lies, and pages that go on behind a given row."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalar import moment
from ..session import path_exists
from .filters import TOP_K_ROWS, offset_page, row_hash, sort_keys, time_range

HOUR_COUNTS = "hour timestamp_ntz, n long, date date"
TAIL = "_row_hash"


def hour_counts(df: DataFrame) -> DataFrame:
    """(hour, n, date): rows per hour; rows without a time have a null hour."""
    hour = F.date_trunc("hour", F.col("timestamp")).cast("timestamp_ntz").alias("hour")
    return df.groupBy(hour).agg(F.count(F.lit(1)).alias("n")).withColumn("date", F.to_date("hour"))


def refresh_hour_counts(spark: SparkSession, table: DataFrame, path: str, dates: list | None = None) -> None:
    """Store the counts beside the table; after a load only for the dates that it wrote."""
    counts = hour_counts(table if dates is None else table.where(F.col("date").isin(dates)))
    if dates:
        # Dates that became empty are replaced, too.
        marks = spark.createDataFrame([(None, 0, d) for d in dates], HOUR_COUNTS)
        counts = counts.unionByName(marks)
    counts.hint("rebalance", "date").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("date").parquet(path)


def read_hour_counts(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(HOUR_COUNTS).parquet(path) if path_exists(spark, path) else spark.createDataFrame([], HOUR_COUNTS)


def _place(counts: DataFrame, offset: int, limit: int, newest_first: bool) -> tuple | None:
    """(hour, date, rows before that hour): where a page begins, and the date on which it ends. None behind the last row.

    The driver gets one row per day up to the page, and the hours of the day on which it begins.
    """
    def ordered(rows, c):
        return rows.orderBy(F.col(c).desc_nulls_last() if newest_first else F.col(c).asc_nulls_last())

    held = counts.where(F.col("n") > 0)
    before, begin, end = 0, None, None
    for day in ordered(held.groupBy("date").agg(F.sum("n").alias("n")), "date").toLocalIterator():
        if before + day["n"] > offset:
            begin = (day["date"], before) if begin is None else begin
            end = day["date"]
        before += day["n"]
        if before >= offset + limit:
            break
    if begin is None:
        return None
    date, skipped = begin
    hour = None
    for row in ordered(held.where(F.col("date").eqNullSafe(F.lit(date))).groupBy("hour").agg(F.sum("n").alias("n")), "hour").collect():
        hour = row["hour"]
        if skipped + row["n"] > offset:
            break
        skipped += row["n"]
    return hour, end, skipped


def page_by_hours(df: DataFrame, limit: int, offset: int, counts: DataFrame | None = None, newest_first: bool = True, top_k_rows: int = TOP_K_ROWS) -> DataFrame:
    """Offset page in time order (ties by id, then by a hash of the row), from the rows of its own hours only.

    ``counts`` is the stored table of ``hour_counts`` of the same rows; without it, it is counted by one scan of the times. The filter on
    the hours reaches the scan and prunes dates; a top-k plan inside the hours gives the page, unless even they hold more
    than ``top_k_rows`` rows before it: then these rows alone are sorted.
    """
    order = "desc" if newest_first else "asc"
    counts = hour_counts(df) if counts is None else counts
    found = _place(counts, offset, limit, newest_first)
    if found is None:
        return df.limit(0)
    hour, end, skipped = found
    if hour is None or end is None:  # the page reaches into the rows without a time
        return offset_page(df, limit, offset, "timestamp", order, top_k_rows)
    if newest_first:
        near = time_range(df, end, None).where(F.col("timestamp") < moment(hour) + F.expr("interval 1 hour"))
        near = near.where(F.col("date") <= moment(hour).cast("date")) if "date" in df.columns else near
    else:
        near = time_range(df, hour, None).where(F.col("timestamp") < F.date_add(moment(end).cast("date"), 1).cast("timestamp_ntz"))
        near = near.where(F.col("date") <= moment(end).cast("date")) if "date" in df.columns else near
    return offset_page(near, limit, offset - skipped, "timestamp", order, top_k_rows)


def rows_after(df: DataFrame, limit: int, time=None, row_id=None, newest_first: bool = True) -> DataFrame:
    """The page behind the row with this time and id, in the same order as the offset pages; from the start without them.

    It costs the same at any depth, needs no count, and rows that arrive meanwhile do not move it. Rows with equal time and id
    stay together only if all of them fit on the page before: ids should be unique.
    """
    if time is not None:
        at, here = F.col("timestamp"), moment(time)
        beyond = at < here if newest_first else at > here
        df = time_range(df, *((None, time) if newest_first else (time, None)))
        df = df.where(beyond | ((at == here) & (F.col("id") > F.lit(row_id))))
    full = [*sort_keys("timestamp", "desc" if newest_first else "asc"), F.col(TAIL).asc()]
    return df.withColumn(TAIL, row_hash(df)).orderBy(*full).limit(limit).drop(TAIL)
