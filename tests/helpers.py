"""Small fixtures shared by the tests."""

from datetime import datetime

from tidemark.schema import READINGS

BASE = "id long, sensor_id string, timestamp timestamp_ntz, reading_type string, value double, field string, battery_level int"


def at(text: str) -> datetime:
    return datetime.fromisoformat(text)


def readings(spark, rows):
    """rows of (sensor, time text, type, value[, field[, battery]]); ids count from 1."""
    full = []
    for i, row in enumerate(rows, 1):
        sensor, time, kind, value, *rest = row
        field = rest[0] if rest else "field_1"
        battery = rest[1] if len(rest) > 1 else 80
        full.append((i, sensor, at(time) if time else None, kind, value, field, battery))
    return spark.createDataFrame(full, BASE)


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


__all__ = ["BASE", "READINGS", "at", "plan", "readings"]
