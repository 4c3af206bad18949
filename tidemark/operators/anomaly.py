"""Range, statistical and temporal anomalies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import outside_range
from ..schema import OUTLIER_Z, ROLLING_DAYS
from .lookup import join_statistics, null_safe_join, with_rules
from .timeseries import SERIES, rolling_baseline

TEMPORAL_K = 3.0
SEVERITIES = (3.0, 3.5)


def with_zscore(df: DataFrame, keys=("reading_type",), threshold: float = OUTLIER_Z) -> DataFrame:
    """z-score against the mean and sample deviation of the group; null when the deviation is 0.

    Two phases (aggregate, then look up) instead of a window: a handful of
    reading types would otherwise put the table on a handful of tasks.
    """
    keys = list(keys)
    stats = df.groupBy(*keys).agg(
        F.avg("value").alias("group_mean"), F.stddev_samp("value").alias("group_std")
    )
    joined = join_statistics(df, stats, keys)
    z = F.when(F.col("group_std") > 0, (F.col("value") - F.col("group_mean")) / F.col("group_std"))
    return (
        joined.withColumn("zscore", z)
        .withColumn("is_statistical", F.coalesce(F.abs("zscore") > threshold, F.lit(False)))
        .drop("group_mean", "group_std")
    )


def with_temporal_flag(df: DataFrame, days: int = ROLLING_DAYS, k: float = TEMPORAL_K, keys=SERIES) -> DataFrame:
    """Flag values further than k deviations from the rolling average of the days before.

    The join key is (series, day); AQE splits a hot day of a hot series.
    """
    keys = list(keys)
    base = rolling_baseline(df, days, keys)
    joined = null_safe_join(df.withColumn("_day", F.to_date("timestamp")), base.withColumnRenamed("date", "_day"), [*keys, "_day"])
    far = F.abs(F.col("value") - F.col("baseline_avg")) > F.lit(k) * F.col("baseline_std")
    flag = F.coalesce(far & (F.col("baseline_std") > 0), F.lit(False))
    return joined.withColumn("is_temporal", flag).drop("_day")


def with_range_flag(df: DataFrame, keep_rules: bool = False) -> DataFrame:
    out = with_rules(df).withColumn("is_range", outside_range())
    return out if keep_rules else out.drop("multiplier", "offset", "min_value", "max_value")


def anomaly_class() -> Column:
    """One class per row, so that the classes add up to the total."""
    return (
        F.when(F.col("is_range"), "range_violation")
        .when(F.col("is_statistical"), "statistical_outlier")
        .when(F.col("is_temporal"), "temporal_anomaly")
    )


def severity(levels=SEVERITIES) -> Column:
    medium, high = levels
    size = F.coalesce(F.abs(F.col("zscore")), F.lit(0.0))
    return F.when(size >= high, "high").when(size >= medium, "medium").otherwise("low")


def classify(df: DataFrame, z_keys=("reading_type",)) -> DataFrame:
    """All three flags, the class and the severity. The temporal join comes first: it is
    the only shuffle of the rows; the other two look-ups are broadcast on top of it."""
    flagged = with_temporal_flag(df)
    # Group statistics come from the input rows, so they do not repeat the temporal join.
    stats = df.groupBy(*z_keys).agg(F.avg("value").alias("group_mean"), F.stddev_samp("value").alias("group_std"))
    joined = join_statistics(flagged, stats, list(z_keys))
    z = F.when(F.col("group_std") > 0, (F.col("value") - F.col("group_mean")) / F.col("group_std"))
    scored = joined.withColumn("zscore", z).withColumn(
        "is_statistical", F.coalesce(F.abs("zscore") > OUTLIER_Z, F.lit(False))
    )
    return (
        with_range_flag(scored, keep_rules=True)
        .withColumn("anomaly_class", anomaly_class())
        .withColumn("severity", F.when(F.col("anomaly_class").isNotNull(), severity()))
    )


def anomaly_breakdown(flagged: DataFrame) -> DataFrame:
    """Anomalies per class and severity."""
    return (
        flagged.where(F.col("anomaly_class").isNotNull())
        .groupBy("anomaly_class", "severity")
        .agg(F.count("*").alias("anomalies"), F.count_distinct("sensor_id").alias("sensors_affected"))
    )


def anomaly_totals(flagged: DataFrame) -> DataFrame:
    """One row: total, share, count per class and severity, sensors affected."""
    kind, level = F.col("anomaly_class"), F.col("severity")
    hit = kind.isNotNull()
    return flagged.agg(
        F.count("*").alias("total_records"),
        F.count_if(hit).alias("total_anomalies"),
        F.when(F.count("*") > 0, F.lit(100.0) * F.count_if(hit) / F.count("*")).otherwise(0.0).alias(
            "anomaly_percentage"
        ),
        F.count_if(kind == "statistical_outlier").alias("statistical_outliers"),
        F.count_if(kind == "range_violation").alias("range_violations"),
        F.count_if(kind == "temporal_anomaly").alias("temporal_anomalies"),
        F.count_if(level == "low").alias("low"),
        F.count_if(level == "medium").alias("medium"),
        F.count_if(level == "high").alias("high"),
        F.count_distinct(F.when(hit, F.col("sensor_id"))).alias("sensors_affected"),
    )


def affected_sensors(flagged: DataFrame) -> DataFrame:
    return (
        flagged.where(F.col("anomaly_class").isNotNull())
        .groupBy("sensor_id")
        .agg(F.count("*").alias("anomalies"))
    )


def top_anomalies(flagged: DataFrame, k: int = 10) -> DataFrame:
    """The k rows with the largest absolute z-score."""
    low, high = F.col("min_value").cast("string"), F.col("max_value").cast("string")
    return (
        flagged.where(F.col("anomaly_class").isNotNull())
        .orderBy(F.abs("zscore").desc_nulls_last(), F.col("id"))
        .limit(k)
        .select(
            "id",
            "sensor_id",
            "reading_type",
            "timestamp",
            "value",
            F.concat_ws("-", low, high).alias("expected_range"),
            "severity",
            "zscore",
        )
    )
