"""Counts, statistics, directories and profiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.validity import validity, with_errors
from .lookup import null_safe_join
from .selection import median_by_selection

# Values one exact-median buffer may hold.
MEDIAN_ROWS = 1_000_000
STRENGTHS = (0.3, 0.7)


def epoch_hours(c: str = "timestamp") -> Column:
    origin = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    return F.timestamp_diff("MICROSECOND", origin, F.col(c)) / F.lit(3.6e9)


def slope(y: Column, x: Column) -> Column:
    """Least-squares slope; null for constant x. (The built-in raises in ANSI mode.)"""
    return F.try_divide(F.covar_pop(y, x), F.var_pop(F.when(y.isNotNull(), x)))


def correlation(a: Column, b: Column) -> Column:
    """Pearson correlation of the complete pairs; null when either side is constant."""
    spread = F.stddev_pop(F.when(b.isNotNull(), a)) * F.stddev_pop(F.when(a.isNotNull(), b))
    return F.try_divide(F.covar_pop(a, b), spread)


def table_stats(df: DataFrame) -> DataFrame:
    """Rows and latest time per reading type plus one total row (``is_total``).

    The rollup expands the few per-type rows, not the table.
    """
    by_type = df.groupBy("reading_type").agg(F.count("*").alias("n"), F.max("timestamp").alias("latest"))
    return by_type.rollup("reading_type").agg(
        (F.grouping("reading_type") == 1).alias("is_total"),
        F.coalesce(F.sum("n"), F.lit(0)).alias("readings"),
        F.max("latest").alias("latest_timestamp"),
    )


def sensor_directory(df: DataFrame) -> DataFrame:
    """Per sensor: types, fields, latest time and number of readings.

    Rows are first counted per (sensor, type, field), so the sets are built
    from a handful of rows per sensor.
    """
    parts = df.groupBy("sensor_id", "reading_type", "field").agg(
        F.count("*").alias("n"), F.max("timestamp").alias("latest")
    )
    return parts.groupBy("sensor_id").agg(
        F.sort_array(F.collect_set("reading_type")).alias("reading_types"),
        F.sort_array(F.collect_set(F.nullif(F.col("field"), F.lit("")))).alias("fields"),
        F.max("latest").alias("latest_reading"),
        F.sum("n").alias("total_readings"),
    )


def summary_by_type(df: DataFrame, keys=("sensor_id", "reading_type")) -> DataFrame:
    """Statistics per sensor and type over non-null values; types with none are left out."""
    return (
        df.groupBy(*keys)
        .agg(
            F.count("value").alias("count"),
            F.min("value").alias("min"),
            F.max("value").alias("max"),
            F.avg("value").alias("avg"),
            F.max_by("value", "timestamp").alias("latest_value"),
            F.max("timestamp").alias("latest_timestamp"),
        )
        .where(F.col("count") > 0)
    )


def sensor_summary(df: DataFrame, sensor_id: str | None = None) -> DataFrame:
    """Totals per sensor. With a sensor id there is always one row, zero when it has no readings."""
    rows = df if sensor_id is None else df.where(F.col("sensor_id") == sensor_id)
    parts = rows.groupBy("sensor_id", "reading_type").agg(
        F.count("*").alias("n"), F.min("timestamp").alias("first"), F.max("timestamp").alias("last")
    )
    grouped = parts.groupBy("sensor_id") if sensor_id is None else parts.groupBy()
    out = grouped.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("total_readings"),
        F.sort_array(F.collect_set("reading_type")).alias("reading_types"),
        F.min("first").alias("first_reading"),
        F.max("last").alias("latest_reading"),
    )
    return out if sensor_id is None else out.select(F.lit(sensor_id).alias("sensor_id"), "*")


def daily_aggregation(df: DataFrame, keys=()) -> DataFrame:
    """Per UTC day: all rows, and min, max, avg and sum over non-null values."""
    return df.groupBy(*keys, F.to_date("timestamp").alias("date")).agg(
        F.count("*").alias("count"),
        F.min("value").alias("min"),
        F.max("value").alias("max"),
        F.avg("value").alias("avg"),
        F.sum("value").alias("sum"),
    )


def validation_totals(df: DataFrame, rules: str = "basic") -> DataFrame:
    valid = F.count_if(validity(df, rules))
    total = F.count("*")
    return df.agg(
        total.alias("total_records"),
        valid.alias("valid_records"),
        (total - valid).alias("invalid_records"),
        F.when(total > 0, F.lit(100.0) * valid / total).otherwise(0.0).alias("quality_score"),
    )


def ingest_counters(df: DataFrame) -> DataFrame:
    ok = validity(df, "ingest")
    return df.agg(F.count_if(ok).alias("processed"), F.count_if(~ok).alias("skipped"))


def error_counts(df: DataFrame) -> DataFrame:
    """How often each error text occurs."""
    errors = with_errors(df).select(F.explode("errors").alias("error"))
    return errors.groupBy("error").agg(F.count("*").alias("rows"))


def validation_counters(df: DataFrame) -> DataFrame:
    marked = with_errors(df)
    return marked.agg(
        F.count("*").alias("processed"),
        F.count_if("is_valid").alias("passed"),
        F.count_if(~F.col("is_valid")).alias("failed"),
        F.coalesce(F.sum(F.size("errors")), F.lit(0)).cast("bigint").alias("errors"),
    )


def median(df: DataFrame, keys=(), value: str = "value", max_rows: int = MEDIAN_ROWS) -> DataFrame:
    """Exact median per group.

    Spark's ``median`` keeps all distinct values of a group in one buffer, so it
    serves only groups up to ``max_rows``; beyond that the middle ranks are found by
    repeated counts over narrowing ranges (``selection.py``).
    """
    keys = list(keys)
    present = df.where(F.col(value).isNotNull())
    largest = present.groupBy(*keys).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    if largest <= max_rows:
        return present.groupBy(*keys).agg(F.median(value).alias("median"))
    return median_by_selection(present, keys, value, max_rows)


def statistics(df: DataFrame, keys=(), max_rows: int = MEDIAN_ROWS) -> DataFrame:
    """count, mean, median, std_dev (sample), min and max of the non-null values."""
    keys = list(keys)
    base = df.groupBy(*keys).agg(
        F.count("value").alias("count"),
        F.avg("value").alias("mean"),
        F.stddev_samp("value").alias("std_dev"),
        F.min("value").alias("min"),
        F.max("value").alias("max"),
    )
    middle = median(df, keys, max_rows=max_rows)
    if keys:
        joined = null_safe_join(base, middle, keys)
    else:
        joined = base.withColumn("median", middle.scalar())
    return joined.select(*keys, "count", "mean", "median", "std_dev", "min", "max")


def trend(df: DataFrame, keys=("sensor_id", "reading_type"), strengths=STRENGTHS, extra=()) -> DataFrame:
    """Slope per hour and correlation with time, with direction and strength labels.

    ``extra`` aggregates ride on the same pass."""
    weak, moderate = strengths
    hours = epoch_hours()
    out = df.groupBy(*keys).agg(
        F.count("value").alias("count"),
        slope(F.col("value"), hours).alias("slope"),
        correlation(F.col("value"), hours).alias("correlation"),
        *extra,
    )
    size = F.abs(F.col("correlation"))
    return out.withColumns(
        {
            "direction": F.when(F.col("slope") > 0, "increasing")
            .when(F.col("slope") < 0, "decreasing")
            .when(F.col("slope") == 0, "stable"),
            "strength": F.when(size < weak, "weak").when(size < moderate, "moderate").when(size.isNotNull(), "strong"),
        }
    )


def type_correlations(df: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """Correlation of the hourly averages of two reading types, per pair.

    All types are averaged side by side in one aggregate per field and hour.
    """
    types = sorted({t for pair in pairs for t in pair})
    hour = F.date_trunc("hour", F.col("timestamp")).alias("hour")
    rows = df.where(F.col("reading_type").isin(types))
    hourly = rows.groupBy("field", hour).agg(
        *[F.avg(F.when(F.col("reading_type") == t, F.col("value"))).alias(t) for t in types]
    )
    wide = hourly.agg(*[correlation(F.col(a), F.col(b)).alias(f"{a}_{b}") for a, b in pairs])
    names = [f"{a}_{b}" for a, b in pairs]
    return wide.unpivot([], names, "pair", "correlation")


METRIC_AGGREGATES = {
    "average": lambda v, h: F.avg(v),
    "maximum": lambda v, h: F.max(v),
    "minimum": lambda v, h: F.min(v),
    "sum": lambda v, h: F.sum(v),
    "count": lambda v, h: F.count(v),
    "trend": slope,
}
GROUP_UNITS = {"hourly": "hour", "daily": "day", "weekly": "week", "monthly": "month"}


def custom_report(
    df: DataFrame, metrics: list[str], group_by: str = "daily", sensors: list[str] | None = None, keys=()
) -> DataFrame:
    """Chosen metrics per period; an unknown metric or period is an error before any job."""
    for name in metrics:
        if name not in METRIC_AGGREGATES:
            raise ValueError(f"Invalid custom report parameters: unknown metric {name}")
    if group_by not in GROUP_UNITS:
        raise ValueError(f"Invalid custom report parameters: unknown period {group_by}")
    if sensors:
        df = df.where(F.col("sensor_id").isin(*sensors))
    hours = epoch_hours()
    period = F.date_trunc(GROUP_UNITS[group_by], F.col("timestamp")).cast("timestamp_ntz")
    return df.groupBy(*keys, period.alias("period")).agg(
        *[METRIC_AGGREGATES[name](F.col("value"), hours).alias(name) for name in metrics]
    )


def profile(df: DataFrame, columns: list[str] | None = None, exact: bool = False) -> DataFrame:
    """One row per column: type, rows, nulls, distinct values, smallest and largest value.

    All columns share one scan. ``exact`` counts distinct values exactly,
    which expands every row by the number of columns; the default is a sketch.
    """
    columns = columns or df.columns
    distinct = F.count_distinct if exact else F.approx_count_distinct
    aggs = [F.count("*").alias("rows")]
    for c in columns:
        aggs += [
            F.count_if(F.col(c).isNull()).alias(f"{c}.nulls"),
            distinct(F.col(c)).alias(f"{c}.distinct"),
            F.min(c).cast("string").alias(f"{c}.min"),
            F.max(c).cast("string").alias(f"{c}.max"),
        ]
    wide = df.agg(*aggs)
    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields if isinstance(f.dataType, T.DataType)}
    rows = F.array(
        *[
            F.struct(
                F.lit(c).alias("column_name"),
                F.lit(kinds[c]).alias("column_type"),
                F.col("rows"),
                F.col(f"`{c}.nulls`").alias("nulls"),
                F.col(f"`{c}.distinct`").alias("distinct_values"),
                F.col(f"`{c}.min`").alias("min_value"),
                F.col(f"`{c}.max`").alias("max_value"),
            )
            for c in columns
        ]
    )
    return wide.select(F.explode(rows).alias("p")).select("p.*")
