"""Quality, summary, issue, alert and insight reports over readings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import is_blank
from ..functions.validity import validity, with_errors
from ..operators import aggregates, anomaly, timeseries
from ..schema import ALL_NORMAL, MAX_ANOMALY_PCT, MAX_MISSING_PCT, OUTLIER_VALUE
from ..session import written

ACTIVE_HOURS = 24


def _share(part, whole, scale: float = 1.0):
    return F.when(whole > 0, F.lit(scale) * part / whole).otherwise(F.lit(0.0))


def quality_metrics(df: DataFrame, outlier_value: float = OUTLIER_VALUE) -> DataFrame:
    """One row of completeness, accuracy and issue counts; zeros when there are no readings."""
    total, present = F.count(F.lit(1)), F.count("value")
    missing = F.count_if(F.col("value").isNull())
    outliers = F.count_if(F.col("value") > outlier_value)
    return df.agg(
        total.alias("total_records"),
        missing.alias("missing_values"),
        outliers.alias("outliers"),
        F.count_distinct("sensor_id").alias("total_sensors"),
        _share(present, total).alias("completeness"),
        F.when(present > 0, F.lit(1.0) - outliers / present).otherwise(0.0).alias("accuracy_rate"),
        _share(F.count_if(validity(df, "basic")), total, 100.0).alias("overall_quality_score"),
        (missing + outliers + F.count_if(is_blank("sensor_id"))).alias("quality_issues"),
    )


def _per_series(df: DataFrame, flag: str) -> DataFrame:
    return df.groupBy("reading_type", "sensor_id").agg(
        F.count("*").alias("n"),
        F.count_if(F.col("value").isNull()).alias("missing"),
        F.count_if(flag).alias("anomalous"),
        F.count_if(validity(df, "basic")).alias("valid"),
        F.max("timestamp").alias("timestamp"),
    )


def quality_rows(df: DataFrame, flag: str = "anomalous_reading") -> DataFrame:
    """Missing and anomalous percentage per type and sensor, and the overall score, as metric rows.

    The overall row is a second grouping set over the per-series counts.
    """
    series = _per_series(df, flag)
    level = F.grouping_id("reading_type", "sensor_id")
    both = [F.col("reading_type"), F.col("sensor_id")]
    rolled = series.groupingSets([both, []], *both).agg(
        level.alias("level"),
        F.sum("n").alias("n"),
        F.sum("missing").alias("missing"),
        F.sum("anomalous").alias("anomalous"),
        F.sum("valid").alias("valid"),
        F.max("timestamp").alias("timestamp"),
    )
    hundred = F.lit(100.0)
    pair = F.array(
        F.struct(F.lit("missing_percentage").alias("metric"), (hundred * F.col("missing") / F.col("n")).alias("value")),
        F.struct(F.lit("anomaly_percentage").alias("metric"), (hundred * F.col("anomalous") / F.col("n")).alias("value")),
    )
    score = F.array(
        F.struct(F.lit("quality_score").alias("metric"), (hundred * F.col("valid") / F.col("n")).alias("value"))
    )
    overall = F.col("level") == 3
    rows = rolled.withColumn("m", F.explode(F.when(overall, score).otherwise(pair)))
    return rows.select(
        F.col("m.metric").alias("metric"),
        F.when(overall, "overall").otherwise(F.col("reading_type")).alias("reading_type"),
        F.when(overall, "ALL_SENSORS").otherwise(F.col("sensor_id")).alias("sensor_id"),
        F.col("m.value").alias("value"),
        "timestamp",
    )


def gap_rows(df: DataFrame) -> DataFrame:
    """Longest gap in hours per series, as metric rows."""
    return timeseries.gaps(df).groupBy("reading_type", "sensor_id").agg(
        F.max("gap_hours").cast("double").alias("value"), F.max("gap_end").alias("timestamp")
    ).select(F.lit("gap_hours").alias("metric"), "reading_type", "sensor_id", "value", "timestamp")


def threshold_breaches(
    df: DataFrame, flag: str = "anomalous_reading", max_missing=MAX_MISSING_PCT, max_anomaly=MAX_ANOMALY_PCT
) -> DataFrame:
    """Series whose missing or anomalous share is above its limit, one row per breach."""
    limits = F.when(F.col("metric") == "missing_percentage", max_missing).when(
        F.col("metric") == "anomaly_percentage", max_anomaly
    )
    return quality_rows(df, flag).withColumn("limit", limits).where(F.col("value") > F.col("limit"))


def rule_compliance(flagged: DataFrame) -> DataFrame:
    """Rows and failures per rule: each validity error, and the range rule."""
    marked = with_errors(flagged)
    failed = F.concat(
        F.col("errors"), F.when(F.col("is_range"), F.array(F.lit("value out of range"))).otherwise(F.array().cast("array<string>"))
    )
    counted = marked.select(F.explode_outer(F.when(F.size(failed) > 0, failed)).alias("rule"))
    return counted.groupBy(F.coalesce("rule", F.lit("compliant")).alias("rule")).agg(F.count("*").alias("rows"))


def issue_rows(df: DataFrame, outlier_value: float = OUTLIER_VALUE) -> DataFrame:
    """One row per issue of a reading; a narrow plan without a shuffle."""
    kinds = F.array_compact(
        F.array(
            F.when(F.col("value").isNull(), F.lit("missing_value")),
            F.when(F.col("value") > outlier_value, F.lit("outlier")),
            F.when(is_blank("sensor_id"), F.lit("missing_sensor_id")),
        )
    )
    exploded = df.withColumn("type", F.explode(kinds))
    return exploded.select(
        "id",
        "type",
        "sensor_id",
        F.col("reading_type").alias("field"),
        F.when(F.col("type") == "outlier", F.col("value")).alias("value"),
        F.when(F.col("type") == "outlier", F.lit(f"0-{int(outlier_value)}")).alias("expected_range"),
        "timestamp",
    )


def recommendations(
    df: DataFrame, flag: str = "anomalous_reading", max_missing=MAX_MISSING_PCT, max_anomaly=MAX_ANOMALY_PCT
) -> DataFrame:
    """One recommendation per breach of a series.

    Too many missing values ask for a look at the connection. Too many anomalies ask for calibration if at least half of them are
    outside the range of their type, else (outliers within the range) for a review of the rules.
    """
    ranged = df if "is_range" in df.columns else anomaly.with_range_flag(df)
    hit = F.coalesce(F.col(flag), F.lit(False))
    series = ranged.groupBy("sensor_id", "reading_type").agg(
        F.count("*").alias("n"),
        F.count_if(F.col("value").isNull()).alias("missing"),
        F.count_if(hit).alias("anomalous"),
        F.count_if(hit & F.col("is_range")).alias("outside"),
    )
    name, kind = F.col("sensor_id"), F.col("reading_type")

    def advice(category, priority, description, action):
        parts = (F.lit(category), F.lit(priority), description, F.lit(action))
        return F.struct(*[c.alias(n) for c, n in zip(parts, ("category", "priority", "description", "action"), strict=True)])

    lost = F.when(
        F.lit(100.0) * F.col("missing") / F.col("n") > max_missing,
        advice("connectivity", "high", F.concat(F.lit("Check the connection of sensor "), name), "Inspect power, wiring and network"),
    )
    odd = F.when(
        F.lit(100.0) * F.col("anomalous") / F.col("n") > max_anomaly,
        F.when(
            2 * F.col("outside") >= F.col("anomalous"),
            advice("calibration", "medium", F.concat(F.lit("Calibrate the "), kind, F.lit(" sensor "), name), "Run the calibration procedure"),
        ).otherwise(advice("validation", "low", F.concat(F.lit("Review the value rules of sensor "), name), "Update the validation limits")),
    )
    return series.select("sensor_id", "reading_type", F.explode(F.array_compact(F.array(lost, odd))).alias("a")).select("sensor_id", "reading_type", "a.*")


def alerts(df: DataFrame, flag: str = "anomalous_reading") -> DataFrame:
    """One alert per breach, or a single status row when there is none.

    The overall row of the quality rows stands in for the status row, so the
    default needs no second input.
    """
    limits = F.when(F.col("metric") == "missing_percentage", MAX_MISSING_PCT).when(
        F.col("metric") == "anomaly_percentage", MAX_ANOMALY_PCT
    )
    rows = quality_rows(df, flag).withColumn("breach", F.coalesce(F.col("value") > limits, F.lit(False)))
    lost = F.col("metric") == "missing_percentage"
    text = F.concat(F.col("sensor_id"), F.lit(" "), F.col("reading_type"), F.lit(" "), F.col("metric"), F.lit(" above limit"))
    found = rows.where("breach").select(
        F.lit("warning").alias("level"),
        F.when(lost, "high").otherwise("medium").alias("severity"),
        F.when(lost, "missing_data").otherwise("anomaly").alias("type"),
        text.alias("message"),
        "timestamp",
    )
    quiet = rows.agg(F.count_if("breach").alias("breaches"), F.max("timestamp").alias("timestamp")).where("breaches = 0")
    status = quiet.select(
        F.lit("info").alias("level"),
        F.lit("low").alias("severity"),
        F.lit("status").alias("type"),
        F.lit(ALL_NORMAL).alias("message"),
        "timestamp",
    )
    return found.unionByName(status)


def summary(df: DataFrame, flag: str = "anomalous_reading", active_hours: int = ACTIVE_HOURS) -> DataFrame:
    """Overview metrics in long form (metric, key, value).

    Readings are reduced to one row per (sensor, type, field). That reduction is
    written once, so the readings are scanned once for all figures.
    """
    parts = df.groupBy("sensor_id", "reading_type", "field").agg(
        F.count("*").alias("n"),
        F.count("value").alias("present"),
        F.sum("value").alias("value_sum"),
        F.count_if(F.col("value") > OUTLIER_VALUE).alias("outliers"),
        F.count_if(flag).alias("flagged"),
        F.max("timestamp").alias("latest"),
    )
    parts = written(parts, "summary")
    newest = parts.agg(F.max("latest").alias("m")).scalar()
    sensors = parts.groupBy("sensor_id").agg(F.max("latest").alias("latest"), F.sum("flagged").alias("flagged"))
    active = F.col("latest") >= newest - F.expr(f"interval {active_hours} hours")
    states = sensors.agg(
        F.count("*").cast("double").alias("total_sensors"),
        F.count_if(active).cast("double").alias("active_sensors"),
        F.count_if(~active).cast("double").alias("inactive_sensors"),
        F.count_if(F.col("flagged") > 0).cast("double").alias("sensors_with_issues"),
        F.try_divide(F.count_if(active), F.count("*")).alias("timeliness"),
    )
    names = ["total_sensors", "active_sensors", "inactive_sensors", "sensors_with_issues", "timeliness"]
    state_rows = states.unpivot([], names, "metric", "value").select("metric", F.lit("all").alias("key"), "value")

    grouped = parts.groupingSets(
        [[], [F.col("reading_type")], [F.col("field")]], F.col("reading_type"), F.col("field")
    ).agg(
        F.grouping_id("reading_type", "field").alias("level"),
        F.sum("n").cast("double").alias("n"),
        F.sum("present").alias("present"),
        F.sum("value_sum").alias("value_sum"),
        F.sum("outliers").alias("outliers"),
        F.count_distinct("sensor_id").cast("double").alias("sensors"),
    )

    def item(name, value):
        return F.struct(F.lit(name).alias("metric"), value.alias("value"))

    mean = F.try_divide("value_sum", "present")
    per_type = F.array(
        item("sensors_by_type", F.col("sensors")), item("readings_by_type", F.col("n")), item("avg_by_type", mean)
    )
    per_field = F.array(item("sensors_by_field", F.col("sensors")))
    whole = F.array(
        item("data_points", F.col("n")),
        item("completeness", F.try_divide("present", "n")),
        item("accuracy", F.lit(1.0) - F.try_divide("outliers", "present")),
    )
    level = F.col("level")
    picked = F.when(level == 3, whole).when(level == 1, per_type).otherwise(per_field)
    key = F.when(level == 3, "all").when(level == 1, F.col("reading_type")).otherwise(F.col("field"))
    set_rows = grouped.select(key.alias("key"), F.explode(picked).alias("m")).select("m.metric", "key", "m.value")
    return state_rows.unionByName(set_rows)


def insights(flagged: DataFrame) -> DataFrame:
    """Trend, pattern and anomaly findings per reading type with confidence and impact.

    One aggregate per type feeds all three findings.
    """
    shares = aggregates.trend(
        flagged,
        ("reading_type",),
        extra=[
            (F.count_if(~F.col("is_range")) / F.count("*")).alias("in_range"),
            (F.count_if(F.col("anomaly_class").isNotNull()) / F.count("*")).alias("anomalous"),
        ],
    )
    name, anomalous = F.col("reading_type"), F.col("anomalous")

    def finding(kind, confidence, description, impact):
        return F.struct(
            F.lit(kind).alias("type"),
            confidence.alias("confidence"),
            description.alias("description"),
            impact.alias("impact"),
        )

    found = F.array(
        finding(
            "trend",
            F.abs("correlation"),
            F.concat(name, F.lit(" is "), F.col("direction"), F.lit(", "), F.col("strength")),
            F.when(F.col("direction") == "stable", "neutral").otherwise("positive"),
        ),
        finding("pattern", F.col("in_range"), F.concat(name, F.lit(" readings within range")), F.lit("neutral")),
        finding(
            "anomaly",
            F.lit(1.0) - anomalous,
            F.concat(name, F.when(anomalous > 0, " has anomalies").otherwise(" has no anomalies")),
            F.when(anomalous > 0, "negative").otherwise("positive"),
        ),
    )
    return shares.select("reading_type", F.explode(found).alias("f")).select("reading_type", "f.*")


def quality_report(df: DataFrame, flag: str = "anomalous_reading") -> dict[str, DataFrame]:
    return {
        "quality_metrics": quality_metrics(df),
        "metrics": quality_rows(df, flag).unionByName(gap_rows(df)),
        "issues": issue_rows(df),
        "recommendations": recommendations(df, flag),
    }


def coverage_report(df: DataFrame, start=None, end=None) -> dict[str, DataFrame]:
    return {
        "coverage": timeseries.coverage(df, start, end),
        "gaps": timeseries.gaps(df),
        "summary": timeseries.coverage_summary(df, start, end),
    }


def anomaly_report(flagged: DataFrame, k: int = 10) -> dict[str, DataFrame]:
    """Sections over rows from ``anomaly.classify``, which are written once and shared."""
    rows = written(flagged, "classified")
    return {
        "totals": anomaly.anomaly_totals(rows),
        "breakdown": anomaly.anomaly_breakdown(rows),
        "sensors": anomaly.affected_sensors(rows),
        "top_anomalies": anomaly.top_anomalies(rows, k),
    }


def analytics_report(flagged: DataFrame, pairs: list[tuple[str, str]]) -> dict[str, DataFrame]:
    """Sections over rows from ``anomaly.classify``, which are written once and shared."""
    rows = written(flagged, "classified")
    return {
        "statistics": aggregates.statistics(rows),
        "trends": aggregates.trend(rows),
        "correlations": aggregates.type_correlations(rows, pairs),
        "insights": insights(rows),
    }


def summary_report(df: DataFrame, flag: str = "anomalous_reading") -> dict[str, DataFrame]:
    return {"summary": summary(df, flag), "alerts": alerts(df, flag)}
