"""Count, mean and squared deviation per group and day: stored, merged and turned into limits without a rescan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..schema import OUTLIER_Z

MOMENTS = "reading_type string, n long, mean double, m2 double, date date"


def daily_moments(df: DataFrame, keys=("reading_type",)) -> DataFrame:
    """(keys, n, mean, m2, date) of the non-null values, m2 being the sum of squared deviations from the mean."""
    v = F.col("value")
    return df.groupBy(*keys, F.to_date("timestamp").alias("date")).agg(
        F.count(v).alias("n"), F.avg(v).alias("mean"), (F.var_pop(v) * F.count(v)).alias("m2")
    ).select(*keys, "n", "mean", "m2", "date")


def merged_moments(moments: DataFrame, keys=("reading_type",)) -> DataFrame:
    """(keys, n, mean, m2) over all days.

    Deviations are taken from the common mean, so large values with a small spread lose no digits. The window sees one row per
    group and day.
    """
    whole = W.partitionBy(*keys)
    centre = F.sum(F.col("n") * F.col("mean")).over(whole) / F.sum("n").over(whole)
    days = moments.where(F.col("n") > 0).withColumn("centre", centre)
    apart = F.col("mean") - F.col("centre")
    return days.groupBy(*keys).agg(
        F.sum("n").alias("n"), F.first("centre").alias("mean"), F.sum(F.col("m2") + F.col("n") * apart * apart).alias("m2")
    )


def deviations(merged: DataFrame, keys=("reading_type",)) -> DataFrame:
    """(keys, group_mean, group_std) with the sample deviation, as the z-score takes them."""
    spread = F.when(F.col("n") > 1, F.sqrt(F.col("m2") / (F.col("n") - 1)))
    return merged.select(*keys, F.col("mean").alias("group_mean"), spread.alias("group_std"))


def is_outlier(threshold: float = OUTLIER_Z) -> Column:
    """Whether ``value`` lies further than ``threshold`` deviations from the mean of its group."""
    z = F.when(F.col("group_std") > 0, (F.col("value") - F.col("group_mean")) / F.col("group_std"))
    return F.coalesce(F.abs(z) > threshold, F.lit(False))
