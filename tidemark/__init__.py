"""Sensor-readings analytics on Spark: cleaning, querying, anomaly and coverage reports."""
