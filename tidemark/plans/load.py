"""Loads into the readings table that leave it as one run over all files would.

Three small tables beside the readings carry what a load needs to know of the earlier ones, each partitioned by date and
replaced for the dates that a load touches:

* ``moments``: count, mean and squared deviation per reading type, so that outlier limits are those of the whole table;
* ``last_values``: the last measured value per series, so that a forward fill goes on where the table ends;
* ``missing``: the rows that came without a value. They decide which copy of a key counts, and are filled anew when a late
  reading changes what stands before them.

Every step gives the same result when a load is repeated, so one that is replayed after a failure is harmless.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import scalar as S
from ..operators import anomaly
from ..operators.cleaning import DEDUP_KEY, drop_duplicates
from ..operators.lookup import join_statistics, measured, null_safe_join, with_rules
from ..operators.moments import MOMENTS, daily_moments, deviations, is_outlier, merged_moments
from ..operators.timeseries import SERIES
from ..schema import OUTLIER_Z, READINGS
from ..session import path_exists, remove_path, written
from ..sources.readers import read_readings
from ..sources.writers import with_defaults, write_readings

LOAD, FRESH, DAY = "_load", "_fresh", "_day"
FILLS = ("drop", "forward", "keep")
# Which of several rows with one key stays: that with the smallest id (of equal ids the newest load), or the newest load.
KEEP = {"smallest_id": ("id", LOAD, "value"), "newest": (LOAD, "id", "value")}
LAST = T.StructType([READINGS["sensor_id"], READINGS["reading_type"], T.StructField("last_value", T.DoubleType()), T.StructField("date", T.DateType())])
MISSING = T.StructType([*READINGS.fields, T.StructField("fill", T.DoubleType()), T.StructField("leading", T.BooleanType()), T.StructField("date", T.DateType())])
# Reading types whose changed limits are handed to the scan as ranges of values.
PUSHED_TYPES = 100


def calibrate(df: DataFrame, profile: str = "config") -> DataFrame:
    """Add ``calibrated_value`` by one of the two named profiles."""
    if profile == "code":
        return df.withColumn("calibrated_value", S.calibrate_by_code())
    if profile == "config":
        out = with_rules(df).withColumn("calibrated_value", S.calibrate_linear())
        return out.drop("multiplier", "offset", "min_value", "max_value")
    raise ValueError(f"Unknown calibration profile: {profile}")


def state_home(table_path: str) -> str:
    """Folder of the side tables; readers of the table skip names that start with an underscore."""
    return f"{table_path}/_state"


def touched_dates(rows: DataFrame) -> list:
    """Dates of a load: one value per table partition it writes to."""
    return sorted(r["date"] for r in rows.select(F.to_date("timestamp").alias("date")).distinct().collect())


def read_state(spark: SparkSession, home: str, name: str, shape) -> DataFrame:
    path = f"{home}/{name}"
    return spark.read.schema(shape).parquet(path) if path_exists(spark, path) else spark.createDataFrame([], shape)


def _write_state(df: DataFrame, home: str, name: str, dates: list) -> None:
    """Replace the dates. A row without keys marks each date, so that one that became empty is replaced, too."""
    marks = df.sparkSession.createDataFrame([(d,) for d in dates], "date date")
    out = df.unionByName(marks, allowMissingColumns=True).hint("rebalance", "date")
    out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("date").parquet(f"{home}/{name}")


def _on(dates: list) -> Column:
    return F.col("date").isin(dates) if dates else F.lit(False)


def _known(spark: SparkSession, home: str) -> DataFrame:
    return read_state(spark, home, "missing", MISSING).where(F.col("sensor_id").isNotNull())


def _same(df: DataFrame, other: DataFrame, keys, how: str) -> DataFrame:
    """Semi or anti join in which null keys are equal."""
    renamed = measured(other.select(*[F.col(k).alias(f"_key_{k}") for k in keys]).distinct())
    return df.join(renamed, [F.col(k).eqNullSafe(F.col(f"_key_{k}")) for k in keys], how)


def _stored(spark: SparkSession, table_path: str, home: str, dates: list) -> DataFrame:
    """Rows of the table on the dates with filled values taken back, and the rows that are kept without a value."""
    missing = _known(spark, home).where(_on(dates)).select(*READINGS.names)
    marked = {LOAD: F.lit(1), FRESH: F.lit(True)}
    if not path_exists(spark, table_path):
        return missing.withColumns(marked)
    table = read_readings(spark, table_path).where(_on(dates)).select(*READINGS.names)
    return _same(table, missing, DEDUP_KEY, "left_anti").withColumns({**marked, FRESH: F.lit(False)}).unionByName(missing.withColumns(marked))


def daily_ends(rows: DataFrame) -> DataFrame:
    """Per series and day: its last measured value, and ``open``, whether its first row came without one."""
    at, there = F.struct("timestamp", "id"), F.col("value").isNotNull()
    return rows.groupBy(*SERIES, F.to_date("timestamp").alias("date")).agg(
        F.max_by("value", F.when(there, at)).alias("last_value"), F.min_by(~there, at).alias("open")
    )


def daily_last(ends: DataFrame) -> DataFrame:
    """Last measured value per series and day, from ``daily_ends``."""
    return ends.where(F.col("last_value").isNotNull()).select(*LAST.names)


def carried(points: DataFrame, last: DataFrame) -> DataFrame:
    """``points`` (series, date, ...) with ``carry``: the last value of the series on an earlier day."""
    near = _same(last.where(F.col("sensor_id").isNotNull()), points, SERIES, "left_semi")
    both = points.withColumns({"_kind": F.lit(0), "last_value": F.lit(None).cast("double")}).unionByName(
        near.withColumn("_kind", F.lit(1)), allowMissingColumns=True
    )
    earlier = W.partitionBy(*SERIES).orderBy("date", "_kind").rowsBetween(W.unboundedPreceding, -1)
    with_carry = both.withColumn("carry", F.last("last_value", ignorenulls=True).over(earlier))
    return with_carry.where(F.col("_kind") == 0).select(*points.columns, "carry")


def fill_days(rows: DataFrame, last: DataFrame, ends: DataFrame) -> DataFrame:
    """Forward fill within each day of a series, and from ``last`` at its start; adds ``fill`` and ``leading``.

    A window holds one day of one series, however long the series is. ``ends`` are the ``daily_ends`` of ``rows``: they tell which
    days start without a value, so the window is computed once, for the rows themselves.
    """
    day = W.partitionBy(*SERIES, DAY).orderBy("timestamp", "id").rowsBetween(W.unboundedPreceding, 0)
    local = rows.withColumn(DAY, F.to_date("timestamp")).withColumn("fill", F.last("value", ignorenulls=True).over(day))
    carry = written(carried(ends.where("open").select(*SERIES, "date"), last), "carry").withColumnRenamed("date", DAY)
    out = null_safe_join(local, measured(carry), [*SERIES, DAY]).withColumn("leading", F.col("fill").isNull())
    return out.withColumn("fill", F.coalesce("fill", "carry")).drop("carry", DAY)


def refill_dates(spark: SparkSession, home: str, rows: DataFrame, last: DataFrame, dates: list) -> list:
    """Later dates on which rows without a value now follow another reading than the one that filled them."""
    if not path_exists(spark, f"{home}/missing"):
        return []
    later = _known(spark, home).where("leading").where(~_on(dates) & (F.col("date") > F.lit(min(dates))))
    points = _same(later, rows, SERIES, "left_semi").select(*SERIES, "date", "fill").distinct()
    changed = carried(points, last).where(~F.col("carry").eqNullSafe(F.col("fill")))
    return sorted(r["date"] for r in changed.select("date").distinct().collect())


def ensure_state(spark: SparkSession, table_path: str, home: str, fill: str, profile: str | None) -> None:
    """Side tables of a table that was filled by other means, from one scan of it."""
    if not path_exists(spark, table_path):
        return
    table = None
    for name, wanted, make in (("moments", profile is not None, daily_moments), ("last_values", fill == "forward", daily_last)):
        if wanted and not path_exists(spark, f"{home}/{name}"):
            table = table if table is not None else read_readings(spark, table_path)
            rows = daily_ends(_same(table, _known(spark, home), DEDUP_KEY, "left_anti")) if name == "last_values" else table
            found = written(make(rows), name)
            _write_state(found, home, name, sorted(r["date"] for r in found.select("date").distinct().collect()))


def enriched(kept: DataFrame, profile: str, stats: DataFrame) -> DataFrame:
    """Calibrated value and score of the rows that are new or filled anew; the anomaly flag of all that carry one."""
    before = {c: f"_{c}" for c in ("calibrated_value", "quality_score", "anomalous_reading")}
    out = calibrate(kept.withColumns({new: F.col(c) for c, new in before.items()}), profile)
    out = out.withColumn("quality_score", S.quality_score())
    fresh = F.col(FRESH)
    out = out.withColumns({c: F.when(fresh, F.col(c)).otherwise(F.col(f"_{c}")) for c in ("calibrated_value", "quality_score")})
    flag = F.col("is_range") | is_outlier()
    flagged = join_statistics(anomaly.with_range_flag(out), stats, ["reading_type"])
    keep = fresh | F.col("_anomalous_reading").isNotNull()
    return flagged.withColumn("anomalous_reading", F.when(keep, flag)).drop(*before.values(), "is_range", "group_mean", "group_std")


def _limits(stats: DataFrame) -> dict:
    """reading type -> (low, high) of at most one type more than ``PUSHED_TYPES``."""
    low, high = (F.col("group_mean") + sign * F.lit(OUTLIER_Z) * F.col("group_std") for sign in (-1, 1))
    rows = stats.select("reading_type", low.alias("low"), high.alias("high")).limit(PUSHED_TYPES + 1).collect()
    return {r["reading_type"]: (r["low"], r["high"]) for r in rows}


def _changed_limits(old: DataFrame, new: DataFrame) -> Column | None:
    """Filter on the values that lie between the old and new limits of their type; None if no limit moved."""
    before, after = _limits(old), _limits(new)
    if max(len(before), len(after)) > PUSHED_TYPES:
        return F.lit(True)
    infinite, parts, none = float("inf"), [], (None, None)
    for kind in {**before, **after}:
        for a, b, open_end in zip(before.get(kind, none), after.get(kind, none), (-infinite, infinite), strict=True):
            a, b = (open_end if x is None else x for x in (a, b))
            if a != b:
                slack = 1e-9 * max([abs(x) for x in (a, b) if abs(x) != infinite] or [0.0])
                parts.append(F.col("reading_type").eqNullSafe(F.lit(kind)) & F.col("value").between(min(a, b) - slack, max(a, b) + slack))
    return reduce(lambda a, b: a | b, parts) if parts else None


def refresh_flags(spark: SparkSession, table_path: str, old: DataFrame, new: DataFrame, without: list) -> list:
    """Rewrite the other dates that hold a flag which the new limits change. Returns these dates.

    Only values between the old and the new limits can change; the scan gets these ranges and reads four columns.
    """
    near = _changed_limits(old, new)
    if near is None:
        return []

    def flagged(rows):
        joined = join_statistics(anomaly.with_range_flag(rows), new, ["reading_type"])
        flag = F.when(F.col("anomalous_reading").isNotNull(), F.col("is_range") | is_outlier())
        return joined.withColumn("_flag", flag).drop("is_range", "group_mean", "group_std")

    table = read_readings(spark, table_path)
    others = table.where(~_on(without)).where(near & F.col("anomalous_reading").isNotNull()).select("date", "reading_type", "value", "anomalous_reading")
    differ = flagged(others).where(F.col("_flag") != F.col("anomalous_reading"))
    dates = sorted(r["date"] for r in differ.select("date").distinct().collect())
    if dates:
        rows = flagged(table.where(_on(dates))).withColumn("anomalous_reading", F.col("_flag")).select(*READINGS.names)
        write_readings(rows, table_path, overwrite_dates=True)
    return dates


def merge_load(
    rows: DataFrame, table_path: str, fill: str = "drop", profile: str | None = "config", keep: str = "smallest_id"
) -> dict:
    """Merge readings into the table, fill and enrich them. Only dates whose rows change are rewritten.

    ``rows`` is read twice: have it written. ``fill``: rows without a value are dropped, filled forward or kept as they are. Without a
    ``profile`` nothing is calibrated, scored or flagged. Returns the dates written and the rows and outliers stored of this load.
    """
    if fill not in FILLS:
        raise ValueError(f"Unknown fill policy: {fill}")
    if keep not in KEEP:
        raise ValueError(f"Unknown rule for equal keys: {keep}")
    spark, home = rows.sparkSession, state_home(table_path)
    rows = rows.where(F.col("timestamp").isNotNull())
    dates = touched_dates(rows)
    if not dates:
        return {"dates": [], "rows": 0, "outliers": 0}
    is_new = not path_exists(spark, table_path)
    ensure_state(spark, table_path, home, fill, profile)
    new = with_defaults(rows).withColumns({LOAD: F.lit(0), FRESH: F.lit(True)})
    merged = written(drop_duplicates(new.unionByName(_stored(spark, table_path, home, dates)), order=KEEP[keep]), "merged")
    day, again = F.to_date("timestamp").alias("date"), []
    if fill == "forward":
        ends = written(daily_ends(merged), "ends")
        latest = daily_last(ends)
        last = read_state(spark, home, "last_values", LAST).where(~_on(dates)).unionByName(latest)
        again = refill_dates(spark, home, ends, last, dates)
        if again:
            more = _stored(spark, table_path, home, again)
            merged, ends = merged.unionByName(more), ends.unionByName(daily_ends(more))
        filled = written(fill_days(merged, last, ends), "filled")
        missing = filled.where(F.col("value").isNull()).select(*READINGS.names, "fill", "leading", day)
        kept = filled.withColumn("value", F.coalesce("value", "fill")).drop("fill", "leading")
        _write_state(latest, home, "last_values", dates)
    else:
        kept = merged if fill == "keep" else merged.where(F.col("value").isNotNull())
        nothing = {"fill": F.lit(None).cast("double"), "leading": F.lit(None).cast("boolean")}
        missing = merged.where(F.col("value").isNull() & F.lit(fill == "drop")).withColumns(nothing).select(*READINGS.names, "fill", "leading", day)
    if fill != "keep":
        # Before the readings: a row that was filled must never pass for a measured one.
        _write_state(missing.where(_on(dates)), home, "missing", dates)
    # Dates filled anew go through the same write; their rows without a value are known already.
    written_dates, counters = sorted({*dates, *again}), {"outliers": F.count_if("anomalous_reading")}
    if profile is None:
        out = kept
    else:
        days = written(daily_moments(kept), "moments")
        before = read_state(spark, home, "moments", MOMENTS)
        old, stats = (deviations(merged_moments(m)) for m in (before, before.where(~_on(written_dates)).unionByName(days)))
        stats = measured(stats)
        refreshed = [] if is_new else refresh_flags(spark, table_path, old, stats, written_dates)
        out = enriched(kept, profile, stats)
    mine = F.col(LOAD) == 0
    seen = {"mine": F.count_if(mine), **{k: F.count_if(mine & F.coalesce("anomalous_reading", F.lit(False))) for k in counters}}
    found = write_readings(out.select(*READINGS.names, LOAD), table_path, overwrite_dates=True, counters=seen, without=(LOAD,))
    if fill == "drop" and not is_new:
        for d in sorted(set(dates) - set(touched_dates(kept))):
            remove_path(spark, f"{table_path}/date={d}")  # a partition without rows is not part of a dynamic overwrite
    if again:
        _write_state(missing.where(_on(again)), home, "missing", again)
    if profile is not None:
        _write_state(days, home, "moments", written_dates)
        written_dates = sorted({*written_dates, *refreshed})
    return {"dates": written_dates, "rows": found["mine"], "outliers": found["outliers"]}
