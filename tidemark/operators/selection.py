"""Exact medians by selection: narrow the range that holds the middle ranks, scan by scan, without sorting or writing rows.

Each scan counts the values of a group inside its range, checks the range proposed before, and sketches the values inside for the next
proposal. A proposal that misses the ranks is not taken, so the sketches only decide how fast the ranges shrink. When
a range holds few enough values, or few different ones, its values are counted one by one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .lookup import measured, null_safe_join

SCANS = 4  # scans that narrow the ranges before the last one, which counts values
STEPS = 100
KLL_SIZE = 400  # errs by less than one step in nearly all cases


def _inside(low: str, high: str, value: Column) -> Column:
    return (value >= F.col(low)) & (value <= F.col(high))


def _too_wide(max_rows: int) -> Column:
    """Whether a range still has to shrink."""
    return (F.least("m", "kinds") > max_rows) & (F.col("low") < F.col("high")) & F.col("shrinks")


def _scan(df: DataFrame, ranges: DataFrame | None, keys: list[str], value: str) -> DataFrame:
    """Per group: its range, how many values lie below and inside it, and the next proposal."""
    v = F.col(value)
    if ranges is None:
        rows = df.withColumns({"low": F.lit(float("-inf")), "high": F.lit(float("nan")), "low_p": F.lit(float("-inf")), "high_p": F.lit(float("nan"))})
        rows = rows.withColumns({"below": F.lit(0).cast("long"), "before": F.lit(-1).cast("long"), "n": F.lit(-1).cast("long")})
    else:
        rows = null_safe_join(df, ranges.select(*keys, "low", "high", "below", "n", F.col("m").alias("before"), "low_p", "high_p"), keys)
        rows = rows.where(_inside("low", "high", v))
    proposed = _inside("low_p", "high_p", v)
    found = rows.groupBy(*keys).agg(
        *[F.first(c).alias(c) for c in ("low", "high", "below", "before", "n", "low_p", "high_p")],
        F.count(F.lit(1)).alias("all"),
        F.count_if(v < F.col("low_p")).alias("under"),
        F.count_if(proposed).alias("within"),
        F.approx_count_distinct(F.when(proposed, v)).alias("kinds"),
        F.kll_sketch_agg_double(F.when(proposed & ~F.isnan(v), v), F.lit(KLL_SIZE)).alias("sketch"),
    )
    # The middle one or two ranks, counted from 0 over the whole group.
    found = found.withColumn("n", F.when(F.col("n") < 0, F.col("all")).otherwise(F.col("n")))
    found = found.withColumns({"first_rank": F.floor((F.col("n") - 1) / 2), "last_rank": F.floor(F.col("n") / 2)})
    under = F.col("below") + F.col("under")
    holds = (under <= F.col("first_rank")) & (F.col("last_rank") < under + F.col("within"))
    taken = found.withColumn("holds", holds).select(
        *keys, "n", "first_rank", "last_rank", "sketch", "kinds",
        F.when(F.col("holds"), F.col("low_p")).otherwise(F.col("low")).alias("low"),
        F.when(F.col("holds"), F.col("high_p")).otherwise(F.col("high")).alias("high"),
        F.when(F.col("holds"), under).otherwise(F.col("below")).alias("below"),
        F.when(F.col("holds"), F.col("within")).otherwise(F.col("all")).alias("m"),
        (F.col("holds") & (F.col("before") != F.col("within"))).alias("shrinks"),
    )

    # Quantiles of the sketch at every hundredth; the range ends one to two of them beside the middle ranks.
    grid = F.kll_sketch_get_quantile_double("sketch", F.array(*[F.lit(k / STEPS) for k in range(STEPS + 1)]))
    taken = taken.withColumn("grid", F.when(F.kll_sketch_get_n_double("sketch") > 0, grid))

    def at(rank: str, rounded, margin: int) -> Column:
        step = rounded(F.lit(float(STEPS)) * (F.col(rank) - F.col("below")) / F.col("m")) + margin
        return F.get("grid", F.least(F.lit(STEPS), F.greatest(F.lit(0), step)).cast("int"))

    return taken.withColumns(
        {
            "low_p": F.greatest(F.col("low"), F.coalesce(at("first_rank", F.floor, -1), F.col("low"))),
            "high_p": F.coalesce(at("last_rank", F.ceil, 1), F.col("high")),
        }
    ).drop("sketch", "grid")


def median_by_selection(df: DataFrame, keys: list[str], value: str, max_rows: int) -> DataFrame:
    """Exact median per group of the non-null values; NaN counts as the largest value.

    ``max_rows``: how many different values of a group the last step may rank in one task.
    """
    if not keys:
        whole = df.select(value).withColumn("_all", F.lit(0))
        return median_by_selection(whole, ["_all"], value, max_rows).drop("_all")
    rows = df.select(*keys, F.col(value).cast("double").alias(value))
    ranges = measured(_scan(rows, None, keys, value))
    for _ in range(SCANS - 1):
        if not ranges.where(_too_wide(max_rows)).take(1):
            break
        ranges = measured(_scan(rows, ranges, keys, value))
    near = null_safe_join(rows, ranges.select(*keys, "low", "high", "below", "first_rank", "last_rank"), keys)
    near = near.where(_inside("low", "high", F.col(value)))
    # A frequent value is one row.
    counted = near.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("copies"), *[F.first(c).alias(c) for c in ("below", "first_rank", "last_rank")])
    upto = F.col("below") + F.sum("copies").over(W.partitionBy(*keys).orderBy(value))
    ranked = counted.withColumn("upto", upto)
    held = [(F.col("upto") > F.col(r)) & (F.col("upto") - F.col("copies") <= F.col(r)) for r in ("first_rank", "last_rank")]
    return ranked.where(held[0] | held[1]).groupBy(*keys).agg(F.avg(value).alias("median"))
