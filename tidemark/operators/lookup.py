"""Joins that stay safe at any size: rule tables, measured statistics, keyed changes."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import CALIBRATION, THRESHOLDS
from ..session import written

# Rows a measured statistics table may have to be sent to every executor.
BROADCAST_ROWS = 100_000


def rule_table(spark: SparkSession, calibration=CALIBRATION, thresholds=THRESHOLDS) -> DataFrame:
    """Calibration and threshold values, one row per configured reading type."""
    kinds = sorted(set(calibration) | set(thresholds))
    none = (None, None)
    table = pa.table(
        {
            "reading_type": pa.array(kinds, pa.string()),
            "multiplier": pa.array([calibration.get(k, none)[0] for k in kinds], pa.float64()),
            "offset": pa.array([calibration.get(k, none)[1] for k in kinds], pa.float64()),
            "min_value": pa.array([thresholds.get(k, none)[0] for k in kinds], pa.float64()),
            "max_value": pa.array([thresholds.get(k, none)[1] for k in kinds], pa.float64()),
        }
    )
    # From Arrow this is a local table in the plan: no tasks are started for it.
    return spark.createDataFrame(table)


def with_rules(df: DataFrame, calibration=CALIBRATION, thresholds=THRESHOLDS) -> DataFrame:
    """Left lookup by reading type; types without rules keep null rule columns.

    The rule table is a driver-side dictionary, so its size is known before it is sent.
    """
    rules = rule_table(df.sparkSession, calibration, thresholds)
    if len(set(calibration) | set(thresholds)) <= BROADCAST_ROWS:
        rules = F.broadcast(rules)
    return df.join(rules, "reading_type", "left")


def measured(small: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """``small`` as a broadcast table if it has at most ``max_rows`` rows, else as a written table.

    At most ``max_rows + 1`` rows reach the driver. A written table goes through its
    own shuffle in the join, which is what AQE needs to split hot keys of the other side
    (an aggregate straight below the join would be joined without one).
    """
    head = small.limit(max_rows + 1).toArrow()
    if head.num_rows > max_rows:
        return written(small, "lookup")
    return F.broadcast(small.sparkSession.createDataFrame(head, small.schema))


def join_statistics(df: DataFrame, stats: DataFrame, keys: list[str], max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Left join of an aggregate onto its own rows.

    Planned blindly, this join would shuffle every row by a key with a few hot
    values, so the aggregate is measured before the join is planned. A null key is a group like any other.
    """
    return null_safe_join(df, measured(stats, max_rows), keys)


def null_safe_join(df: DataFrame, other: DataFrame, keys: list[str]) -> DataFrame:
    """Left join in which equal keys include nulls; the keys appear once."""
    renamed = other.withColumnsRenamed({k: f"_key_{k}" for k in keys})
    on = [F.col(k).eqNullSafe(F.col(f"_key_{k}")) for k in keys]
    return df.join(renamed, on, "left").drop(*[f"_key_{k}" for k in keys])
