"""Mergeable profiles: sketches of every column per day, stored and united instead of a rescan.

Per column and day: rows, nulls, smallest and largest value, an HLL sketch of the distinct values and, for numbers and times, a KLL
sketch of their distribution. A profile of any set of days is a merge of these rows, whose size does not depend on the
number of readings.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

HLL_LOG_SIZE = 14  # relative error near 0.8 %
KLL_SIZE = 400  # rank error near 0.7 %
SHAPE = (
    "column_name string, column_type string, rows long, nulls long, min_value string, max_value string, "
    "distinct_sketch binary, value_sketch binary, date date"
)
TEMPORAL = (T.TimestampNTZType, T.TimestampType, T.DateType)


def _as_number(name: str, kind: T.DataType):
    """Numbers as doubles, times as seconds; None for other types."""
    if isinstance(kind, T.NumericType):
        return F.col(name).cast("double")
    if isinstance(kind, TEMPORAL):
        return F.unix_micros(F.col(name).cast("timestamp")) / F.lit(1e6)
    return None


def daily_sketches(df: DataFrame, columns: list[str] | None = None, time: str = "timestamp") -> DataFrame:
    """One row per day and column, from one scan and one shuffle of sketches."""
    columns = [c for c in (columns or df.columns) if c != "date"]
    aggs = [F.count(F.lit(1)).alias("rows")]
    for c in columns:
        number = _as_number(c, df.schema[c].dataType)
        shown = F.col(c).cast("string")
        aggs += [
            F.count_if(F.col(c).isNull()).alias(f"{c}.nulls"),
            F.min(c).cast("string").alias(f"{c}.min"),
            F.max(c).cast("string").alias(f"{c}.max"),
            F.hll_sketch_agg(shown, F.lit(HLL_LOG_SIZE)).alias(f"{c}.distinct"),
            (F.lit(None).cast("binary") if number is None else F.kll_sketch_agg_double(number, F.lit(KLL_SIZE))).alias(f"{c}.values"),
        ]
    wide = df.groupBy(F.to_date(time).alias("date")).agg(*aggs)
    parts = [
        F.struct(
            F.lit(c).alias("column_name"),
            F.lit(df.schema[c].dataType.simpleString()).alias("column_type"),
            F.col("rows"),
            *[F.col(f"`{c}.{part}`").alias(name) for part, name in (("nulls", "nulls"), ("min", "min_value"), ("max", "max_value"), ("distinct", "distinct_sketch"), ("values", "value_sketch"))],
        )
        for c in columns
    ]
    return wide.select("date", F.explode(F.array(*parts)).alias("p")).select("p.*", "date")


def merged_profile(sketches: DataFrame, probabilities=(0.25, 0.5, 0.75)) -> DataFrame:
    """One row per column: rows, nulls, estimated distinct values, extremes and quantiles, from sketches of any days.

    Extremes are those of the column's own order for numbers and times, of its text otherwise.
    """
    number = F.col("value_sketch").isNotNull()
    by_value = {"min": F.min, "max": F.max}
    out = sketches.groupBy("column_name", "column_type").agg(
        F.sum("rows").alias("rows"),
        F.sum("nulls").alias("nulls"),
        F.hll_sketch_estimate(F.hll_union_agg("distinct_sketch")).alias("distinct_values"),
        *[f(F.when(number, F.col(f"{n}_value").try_cast("double"))).alias(f"{n}_number") for n, f in by_value.items()],
        *[f(f"{n}_value").alias(f"{n}_value") for n, f in by_value.items()],
        F.kll_merge_agg_double("value_sketch").alias("values"),
    )
    quantiles = {f"q{round(100 * p)}": F.when(F.kll_sketch_get_n_double("values") > 0, F.kll_sketch_get_quantile_double("values", F.lit(float(p)))) for p in probabilities}
    return out.select("column_name", "column_type", "rows", "nulls", "distinct_values", "min_number", "max_number", "min_value", "max_value", *[q.alias(n) for n, q in quantiles.items()])
