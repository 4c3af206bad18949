"""Table schemas and the fixed rule values of the readings domain."""

from __future__ import annotations

from pyspark.sql import types as T

# One row per (sensor, time, reading type).
READINGS = T.StructType(
    [
        T.StructField("id", T.LongType()),
        T.StructField("sensor_id", T.StringType()),
        T.StructField("timestamp", T.TimestampNTZType()),
        T.StructField("reading_type", T.StringType()),
        T.StructField("value", T.DoubleType()),
        T.StructField("unit", T.StringType()),
        T.StructField("field", T.StringType()),
        T.StructField("latitude", T.DoubleType()),
        T.StructField("longitude", T.DoubleType()),
        T.StructField("battery_level", T.IntegerType()),
        T.StructField("signal_strength", T.IntegerType()),
        T.StructField("data_quality", T.StringType()),
        T.StructField("processed_timestamp", T.TimestampNTZType()),
        T.StructField("quality_score", T.DoubleType()),
        T.StructField("created_at", T.TimestampNTZType()),
        T.StructField("calibrated_value", T.DoubleType()),
        T.StructField("anomalous_reading", T.BooleanType()),
        T.StructField("processing_version", T.StringType()),
    ]
)

LOCATION = T.StructType(
    [
        T.StructField("field", T.StringType()),
        T.StructField("latitude", T.DoubleType()),
        T.StructField("longitude", T.DoubleType()),
    ]
)

# Read schema of landing files. `value` and `timestamp` stay text until they
# are checked, so one dirty row cannot fail a read.
RAW = T.StructType(
    [
        T.StructField("id", T.LongType()),
        T.StructField("sensor_id", T.StringType()),
        T.StructField("timestamp", T.StringType()),
        T.StructField("reading_type", T.StringType()),
        T.StructField("value", T.StringType()),
        T.StructField("unit", T.StringType()),
        T.StructField("field", T.StringType()),
        T.StructField("location", LOCATION),
        T.StructField("battery_level", T.StringType()),
        T.StructField("signal_strength", T.StringType()),
        T.StructField("data_quality", T.StringType()),
    ]
)

# Landing Parquet files carry typed columns.
_TYPED = {
    "value": T.DoubleType(), "timestamp": T.TimestampNTZType(), "battery_level": T.IntegerType(), "signal_strength": T.IntegerType()
}
RAW_PARQUET = T.StructType([T.StructField(f.name, _TYPED.get(f.name, f.dataType)) for f in RAW.fields])

METRICS = T.StructType(
    [
        T.StructField("metric", T.StringType()),
        T.StructField("reading_type", T.StringType()),
        T.StructField("sensor_id", T.StringType()),
        T.StructField("value", T.DoubleType()),
        T.StructField("timestamp", T.TimestampNTZType()),
    ]
)

# --- fixed values -----------------------------------------------------------
REQUIRED_COLUMNS = ("sensor_id", "timestamp", "reading_type", "value")
REQUIRED_FIELDS = ("sensor_id", "reading_type", "value", "timestamp")
READING_TYPES = ("temperature", "humidity", "soil_moisture", "light_intensity", "battery_level")

# reading type -> (multiplier, offset)
CALIBRATION = {
    "temperature": (1.0, 0.0),
    "humidity": (1.0, 0.0),
    "soil_moisture": (1.2, -5.0),
    "light_intensity": (0.95, 10.0),
    "battery_level": (1.0, 0.0),
}

# reading type -> (min, max)
THRESHOLDS = {
    "temperature": (-10.0, 50.0),
    "humidity": (0.0, 100.0),
    "soil_moisture": (0.0, 100.0),
    "light_intensity": (0.0, 100000.0),
    "battery_level": (0.0, 100.0),
}

# Profile "code": reading type -> (multiplier, offset), rounded to two decimals; humidity stays within 0-100.
CODE_CALIBRATION = {"temperature": (1.02, -0.5), "humidity": (0.98, 1.5)}
HUMIDITY_RANGE = (0.0, 100.0)

# Points a row loses for what it lacks.
FULL_SCORE = 100
LOST_TIMESTAMP = 20
LOST_VALUE = 30
LOST_SENSOR = 15
LOW_BATTERY = 10
BATTERY_LIMIT = 20

ERROR_MISSING = "Missing required field: "
ERROR_NUMBER = "value must be numeric"
ERROR_TIME = "Invalid timestamp format"
ERROR_SENSOR = "Sensor ID must be a string"
ERROR_COLUMN = "Missing required column: "
ERROR_EXPORT = "Unsupported export format: "
ALL_NORMAL = "All sensors operating normally"

HARD_LIMITS = (-100.0, 1000.0)
OUTLIER_Z = 3.0
OUTLIER_VALUE = 100.0
ROLLING_DAYS = 7
MAX_MISSING_PCT = 20.0
MAX_ANOMALY_PCT = 10.0
MAX_LANDING_BYTES = 100 * 1024 * 1024
PROCESSING_VERSION = "2.0"
LOCAL_ZONE = "Asia/Kolkata"

REPORT_TYPES = {
    "quality_": "Quality Report",
    "processing_": "Processing Report",
    "coverage_": "Coverage Report",
    "anomaly_": "Anomaly Report",
    "analytics_": "Analytics Report",
    "summary_": "Summary Report",
    "custom_": "Custom Report",
}
# ---------------------------------------------------------------------------

SORT_COLUMNS = ("timestamp", "sensor_id", "reading_type", "value")
EXPORT_FORMATS = ("csv", "json", "parquet")


def require_columns(columns, required=REQUIRED_COLUMNS) -> bool:
    """Raise for the first required column that is absent (names only, no job)."""
    present = set(columns)
    for name in required:
        if name not in present:
            raise ValueError(f"{ERROR_COLUMN}{name}")
    return True
