"""Per-row column expressions. Everything here stays inside whole-stage codegen."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import (
    BATTERY_LIMIT,
    CODE_CALIBRATION,
    FULL_SCORE,
    HARD_LIMITS,
    HUMIDITY_RANGE,
    LOCAL_ZONE,
    LOST_SENSOR,
    LOST_TIMESTAMP,
    LOST_VALUE,
    LOW_BATTERY,
    PROCESSING_VERSION,
    REPORT_TYPES,
)


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def round_half_up(c, digits: int = 2) -> Column:
    """Round towards +infinity on ties (Spark's ``round`` goes away from zero)."""
    scale = float(10**digits)
    x = _col(c)
    # Beyond 1e15 a double carries no decimals, and floor would leave the bigint range.
    return F.when(F.abs(x) < 1e15, F.floor(x * scale + 0.5) / F.lit(scale)).otherwise(x)


def is_blank(c) -> Column:
    return _col(c).isNull() | (_col(c).cast("string") == "")


def number_or_null(c) -> Column:
    """NaN is not a reading."""
    x = _col(c)
    return F.when(~F.isnan(x), x)


def to_number(c) -> Column:
    """Text to double; junk, blank, NaN and null become null, never 0."""
    text = F.trim(_col(c).cast("string"))
    # The cast also takes Java suffixes such as 25.5d, which are no numbers here.
    return number_or_null(F.when(~F.substring(text, -1, 1).isin("d", "D", "f", "F"), text).try_cast("double"))


ISO_STRICT = r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2}(\.\d+)?)?(Z|[+-]\d{2}:?\d{2})?)?$"


def parse_time(c) -> Column:
    """Text that starts with a year. The cast alone would also take a bare time of day and put it
    on the current date, so the first characters are looked at (cheaper than a pattern)."""
    text = _col(c)
    year = ~F.substring(text, 1, 4).contains(":")
    dated = year & ((F.substring(text, 5, 1) == "-") | (F.length(text) == 4))
    return F.when(dated, F.try_to_timestamp(text))


def to_timestamp_ntz(c) -> Column:
    """ISO-8601 text to a zone-less UTC timestamp; null when it does not parse."""
    return F.to_utc_timestamp(parse_time(c), F.current_timezone()).cast("timestamp_ntz")


def is_iso_timestamp(c) -> Column:
    return F.coalesce(_col(c).rlike(ISO_STRICT) & parse_time(c).isNotNull(), F.lit(False))


def calibrate_by_code(value="value", reading_type="reading_type", sensor_type=None) -> Column:
    """Fixed temperature and humidity curves; every other type keeps its value."""
    v = _col(value)
    kind = F.nullif(_col(reading_type), F.lit(""))
    if sensor_type is not None:
        kind = F.coalesce(kind, _col(sensor_type))
    # greatest and least skip nulls, so a null value is settled first.
    out = F.when(v.isNull(), v)
    for name, (multiplier, offset) in CODE_CALIBRATION.items():
        curve = round_half_up(v * multiplier + offset)
        if name == "humidity":
            low, high = HUMIDITY_RANGE
            curve = F.greatest(F.lit(low), F.least(F.lit(high), curve))
        out = out.when(kind == name, curve)
    return out.otherwise(v)


def calibrate_linear(value="value", multiplier="multiplier", offset="offset") -> Column:
    """``value * multiplier + offset``; a type without an entry keeps its raw value."""
    v = _col(value)
    return F.coalesce(v * _col(multiplier) + _col(offset), v)


def quality_score(timestamp="timestamp", value="value", sensor_id="sensor_id", battery="battery_level") -> Column:
    """Full score less the points for what is missing, never below 0. An unknown battery loses nothing."""
    lost = (
        F.when(is_blank(timestamp), LOST_TIMESTAMP).otherwise(0)
        + F.when(_col(value).isNull(), LOST_VALUE).otherwise(0)
        + F.when(is_blank(sensor_id), LOST_SENSOR).otherwise(0)
        + F.when(_col(battery) < BATTERY_LIMIT, LOW_BATTERY).otherwise(0)
    )
    return F.greatest(F.lit(0), F.lit(FULL_SCORE) - lost).cast("double")


def outside_range(value="value", low="min_value", high="max_value") -> Column:
    v = _col(value)
    return F.coalesce((v < _col(low)) | (v > _col(high)), F.lit(False))


def outside_hard_limits(value="value") -> Column:
    low, high = HARD_LIMITS
    return outside_range(value, F.lit(low), F.lit(high))


def normal_type(c="reading_type") -> Column:
    return F.lower(_col(c))


def to_local_time(c="timestamp", zone: str = LOCAL_ZONE) -> Column:
    return F.convert_timezone(F.lit("UTC"), F.lit(zone), _col(c))


def date_text(c="timestamp") -> Column:
    return F.date_format(_col(c), "yyyy-MM-dd")


def iso_text(c="timestamp") -> Column:
    return F.date_format(_col(c), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def iso_micros(c="timestamp") -> Column:
    return F.date_format(_col(c), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")


def days_between(start, end) -> Column:
    """Array of every day from start to end, both included."""
    return F.sequence(F.to_date(_col(start)), F.to_date(_col(end)), F.expr("interval 1 day"))


def moment(value) -> Column:
    """A UTC time given as text, date or naive datetime. It travels as text, since a datetime
    literal would be shifted by the zone of the Python process."""
    return F.lit(value.isoformat() if hasattr(value, "isoformat") else str(value)).cast("timestamp_ntz")


def now_ntz() -> Column:
    return F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()).cast("timestamp_ntz")


def with_processing_metadata(df: DataFrame) -> DataFrame:
    return df.withColumns({"processed_at": now_ntz(), "processing_version": F.lit(PROCESSING_VERSION)})


def flatten_location(df: DataFrame) -> DataFrame:
    """Lift ``location.*`` to the top level; a top-level ``field`` is the fallback."""
    if "location" not in df.columns:
        return df
    plain = F.col("field") if "field" in df.columns else F.lit(None).cast("string")
    return df.withColumns(
        {
            "field": F.coalesce(F.col("location.field"), plain),
            "latitude": F.col("location.latitude"),
            "longitude": F.col("location.longitude"),
        }
    ).drop("location")


def report_type(c="report_id") -> Column:
    label = F.lit("Unknown")
    for prefix, name in REPORT_TYPES.items():
        label = F.when(_col(c).startswith(prefix), name).otherwise(label)
    return label


def file_date(c=None) -> Column:
    """Date in a ``YYYY-MM-DD.parquet`` file name, otherwise the load date."""
    name = _col(c) if c is not None else F.col("_metadata.file_name")
    found = F.regexp_extract(name, r"(\d{4}-\d{2}-\d{2})\.parquet$", 1)
    return F.coalesce(F.nullif(found, F.lit("")).try_cast("date"), F.current_date())
