"""Rolling averages, gaps, hourly coverage and latest readings per series.

Every window here runs over calendar units (days or hours) of a series, never
over its raw rows: rows are first reduced with map-side aggregation, so a
series holding a large share of the table is no more work than any other.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scalar import moment, round_half_up
from ..schema import ROLLING_DAYS

SERIES = ("sensor_id", "reading_type")


def daily_series(df: DataFrame, keys=SERIES) -> DataFrame:
    """Per series and day: rows, non-null values and the sums needed to merge days."""
    v = F.col("value")
    return df.groupBy(*keys, F.to_date("timestamp").alias("date")).agg(
        F.count("*").alias("n_rows"),
        F.count(v).alias("n_values"),
        F.avg(v).alias("daily_avg"),
        F.sum(v).alias("value_sum"),
        (F.var_pop(v) * F.count(v)).alias("value_m2"),
    )


def rolling_average(df: DataFrame, days: int = ROLLING_DAYS, keys=SERIES) -> DataFrame:
    """Daily average and its unweighted mean over the last ``days`` calendar days."""
    frame = W.partitionBy(*keys).orderBy("day_number").rangeBetween(-(days - 1), 0)
    daily = daily_series(df, keys).withColumn("day_number", F.unix_date("date"))
    return daily.withColumn("rolling_avg", F.avg("daily_avg").over(frame)).select(
        *keys, "date", "n_rows", "daily_avg", "rolling_avg"
    )


def rolling_baseline(df: DataFrame, days: int = ROLLING_DAYS, keys=SERIES) -> DataFrame:
    """Mean and sample deviation of the values in the ``days`` days before each day.

    The current day is left out, so that an unusual day cannot hide itself.
    """
    frame = W.partitionBy(*keys).orderBy("day_number").rangeBetween(-days, -1)
    daily = daily_series(df, keys).withColumn("day_number", F.unix_date("date"))
    # Days are merged around the mean of their series, so that large values with a small spread lose no digits.
    whole = W.partitionBy(*keys)
    centre = F.sum("value_sum").over(whole) / F.sum("n_values").over(whole)
    daily = daily.withColumn("centre", centre).withColumn("shift", F.col("daily_avg") - F.col("centre"))
    n, s = F.sum("n_values").over(frame), F.sum(F.col("n_values") * F.col("shift")).over(frame)
    q = F.sum(F.col("value_m2") + F.col("n_values") * F.col("shift") * F.col("shift")).over(frame)
    sums = daily.select(*keys, "date", n.alias("n"), s.alias("s"), q.alias("q"), "centre")
    spread = F.greatest(F.col("q") - F.col("s") * F.col("s") / F.col("n"), F.lit(0.0))
    return sums.select(
        *keys,
        "date",
        F.when(F.col("n") > 0, F.col("centre") + F.col("s") / F.col("n")).alias("baseline_avg"),
        F.when(F.col("n") > 1, F.sqrt(spread / (F.col("n") - 1))).alias("baseline_std"),
    )


def hourly_series(df: DataFrame, keys=SERIES) -> DataFrame:
    """Per series and hour: number of readings, first and last time."""
    hour = F.date_trunc("hour", F.col("timestamp")).cast("timestamp_ntz")
    return df.groupBy(*keys, hour.alias("hour")).agg(
        F.count("*").alias("readings"), F.min("timestamp").alias("first_ts"), F.max("timestamp").alias("last_ts")
    )


def gaps(df: DataFrame, keys=SERIES, min_gap_hours: int = 1) -> DataFrame:
    """Pauses longer than ``min_gap_hours`` between consecutive readings of a series.

    Two readings of one hour are never a gap, so the first and last reading of
    each hour decide: the window sees hours, not readings.
    """
    if min_gap_hours < 1:
        raise ValueError("min_gap_hours must be at least 1")
    by_hour = W.partitionBy(*keys).orderBy("hour")
    pairs = hourly_series(df, keys).select(
        *keys, F.lag("last_ts").over(by_hour).alias("gap_start"), F.col("first_ts").alias("gap_end")
    )
    limit = F.expr(f"interval {min_gap_hours} hours")
    return pairs.where(F.col("gap_start").isNotNull() & (F.col("gap_end") > F.col("gap_start") + limit)).withColumn(
        "gap_hours", F.timestamp_diff("HOUR", F.col("gap_start"), F.col("gap_end"))
    )


def longest_gaps(df: DataFrame, keys=SERIES, min_gap_hours: int = 1) -> DataFrame:
    """Per series: number of gaps and the longest one in hours."""
    return gaps(df, keys, min_gap_hours).groupBy(*keys).agg(
        F.count("*").alias("gap_count"), F.max("gap_hours").alias("longest_gap_hours")
    )


def _span(df: DataFrame, start, end) -> tuple:
    """First and last expected hour: given, or the first and last hour of the data."""
    def hour(c):
        return F.date_trunc("hour", c).cast("timestamp_ntz")

    bounds = df.agg(F.min("timestamp").alias("lo"), F.max("timestamp").alias("hi"))
    lo = moment(start) if start is not None else bounds.select("lo").scalar()
    hi = moment(end) if end is not None else bounds.select("hi").scalar()
    return hour(lo), hour(hi)


def _hours_in_span(df: DataFrame, start, end, keys) -> tuple:
    """Hourly rows inside the span, and its first and last hour."""
    lo, hi = _span(df, start, end)
    if start is not None or end is not None:
        df = df.where(F.date_trunc("hour", "timestamp").cast("timestamp_ntz").between(lo, hi))
    return hourly_series(df, keys), lo, hi


def _percentage(actual, expected):
    return round_half_up(F.lit(100.0) * actual / expected, 1)


def coverage(df: DataFrame, start=None, end=None, keys=SERIES) -> DataFrame:
    """Expected against actual reading hours of each series, in percent.

    The expected number is arithmetic (hours in the range); no spine is built.
    """
    hours, lo, hi = _hours_in_span(df, start, end, keys)
    counted = hours.groupBy(*keys).agg(F.count("*").alias("actual_readings"))
    rows = counted.withColumn("expected_readings", F.timestamp_diff("HOUR", lo, hi) + 1)
    share = _percentage(F.col("actual_readings"), F.col("expected_readings"))
    return rows.withColumn("coverage_percentage", share)


def coverage_summary(df: DataFrame, start=None, end=None, keys=SERIES) -> DataFrame:
    """Overall coverage, total and longest gap, sensors with gaps, as one row.

    Hours and gaps of a series come from the same hourly rows.
    """
    hours, lo, hi = _hours_in_span(df, start, end, keys)
    previous = F.lag("last_ts").over(W.partitionBy(*keys).orderBy("hour"))
    pairs = hours.select(*keys, "first_ts", previous.alias("previous"))
    is_gap = F.col("first_ts") > F.col("previous") + F.expr("interval 1 hour")
    length = F.timestamp_diff("HOUR", F.col("previous"), F.col("first_ts"))
    series = pairs.groupBy(*keys).agg(
        F.count("*").alias("actual"), F.count_if(is_gap).alias("gaps"), F.max(F.when(is_gap, length)).alias("longest")
    )
    return series.agg(
        F.sum("actual").alias("actual"),
        F.count("*").alias("series"),
        F.coalesce(F.sum("gaps"), F.lit(0)).alias("total_gaps"),
        F.coalesce(F.max("longest"), F.lit(0)).alias("longest_gap_hours"),
        F.count_distinct(F.when(F.col("gaps") > 0, F.col("sensor_id"))).alias("sensors_with_gaps"),
    ).select(
        _percentage(F.col("actual"), F.col("series") * (F.timestamp_diff("HOUR", lo, hi) + 1)).alias("overall_coverage"),
        "total_gaps",
        "longest_gap_hours",
        "sensors_with_gaps",
    )


def hourly_spine(df: DataFrame, start=None, end=None, keys=SERIES) -> DataFrame:
    """Every expected hour of every series with its number of readings, 0 when it has none.

    Each hour with readings also brings the empty hours before it (the last one
    those after it, too), so the spine needs no join with the actual hours.
    """
    hours, lo, hi = _hours_in_span(df, start, end, keys)
    one = F.expr("interval 1 hour")
    order = W.partitionBy(*keys).orderBy("hour")
    here = hours.select(
        *keys,
        "hour",
        "readings",
        F.coalesce(F.lag("hour").over(order) + one, lo).alias("from_hour"),
        F.lead("hour").over(order).isNull().alias("is_last"),
    )
    last = F.when(F.col("is_last"), hi).otherwise(F.col("hour"))
    spread = here.withColumn("slot", F.explode(F.sequence("from_hour", last, one)))
    found = F.when(F.col("slot") == F.col("hour"), F.col("readings")).otherwise(F.lit(0).cast("bigint"))
    return spread.select(*keys, F.col("slot").alias("hour"), found.alias("readings"))


def missing_hours(df: DataFrame, start=None, end=None, keys=SERIES) -> DataFrame:
    """Only the expected hours without a reading."""
    empty = hourly_spine(df, start, end, keys).where(F.col("readings") == 0)
    return empty.select(*keys, F.col("hour").alias("missing_hour"))


def latest_per_series(df: DataFrame, keys=SERIES) -> DataFrame:
    """Latest time and value of each series, as a plain hash aggregate.

    Meant for rows without duplicate keys; among equal times any row may win.
    """
    return df.groupBy(*keys).agg(
        F.max("timestamp").alias("latest_timestamp"),
        F.max_by("value", "timestamp").alias("latest_value"),
        F.max_by("id", "timestamp").alias("latest_id"),
    )
