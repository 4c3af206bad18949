"""Row-validity rule sets, as Boolean columns and as lists of error texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schema import ERROR_MISSING, ERROR_NUMBER, ERROR_SENSOR, ERROR_TIME, READING_TYPES, REQUIRED_FIELDS
from .scalar import is_blank, is_iso_timestamp, parse_time, to_number

RULE_SETS = ("ingest", "basic", "pipeline", "strict")


def timestamp_parses(df: DataFrame) -> Column:
    if isinstance(df.schema["timestamp"].dataType, T.StringType):
        return parse_time("timestamp").isNotNull()
    return F.col("timestamp").isNotNull()


def _timestamp_is_iso(df: DataFrame) -> Column:
    if isinstance(df.schema["timestamp"].dataType, T.StringType):
        return is_iso_timestamp("timestamp")
    return F.col("timestamp").isNotNull()


def validity(df: DataFrame, rules: str) -> Column:
    """Null-safe Boolean for one rule set."""
    keyed = ~is_blank("timestamp") & ~is_blank("sensor_id")
    if rules == "ingest":
        ok = keyed & timestamp_parses(df)
    elif rules == "basic":
        ok = keyed & F.col("value").isNotNull()
    elif rules == "pipeline":
        ok = F.size(error_list(df)) == 0
    elif rules == "strict":
        battery = F.col("battery_level")
        ok = (
            ~is_blank("sensor_id")
            & _timestamp_is_iso(df)
            & F.col("reading_type").isin(*READING_TYPES)
            & to_number("value").isNotNull()
            & battery.between(0, 100)
        )
    else:
        raise ValueError(f"Unknown rule set: {rules}")
    return F.coalesce(ok, F.lit(False))


def error_list(df: DataFrame) -> Column:
    """Error texts of the ``pipeline`` rule set, in their fixed order."""
    checks = [(is_blank(name), f"{ERROR_MISSING}{name}") for name in REQUIRED_FIELDS]
    # An empty text counts as missing only: it reads as the number 0 in the source format.
    junk = ~is_blank("value") & to_number("value").isNull()
    checks.append((junk, ERROR_NUMBER))
    checks.append((~is_blank("timestamp") & ~timestamp_parses(df), ERROR_TIME))
    if not isinstance(df.schema["sensor_id"].dataType, T.StringType):
        checks.append((F.col("sensor_id").isNotNull(), ERROR_SENSOR))
    return F.array_compact(F.array(*[F.when(bad, F.lit(text)) for bad, text in checks]))


def with_errors(df: DataFrame) -> DataFrame:
    return df.withColumn("errors", error_list(df)).withColumn("is_valid", F.size("errors") == 0)


def split_valid(df: DataFrame, strict: bool = False) -> tuple[DataFrame, DataFrame]:
    """(rows to transform, quarantine). Lenient mode transforms every row and only marks it."""
    marked = with_errors(df)
    kept = marked.where("is_valid") if strict else marked
    return kept, marked.where(~F.col("is_valid"))


def is_valid_timestamp(c) -> Column:
    return parse_time(c).isNotNull()


def is_valid_reading(c) -> Column:
    number = F.col(c)
    return F.coalesce(number.isNotNull() & ~F.isnan(number), F.lit(False))
