"""Views of general event tables as sensor readings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalar import iso_micros, iso_text

# event type -> reading type (fixed mapping of the adapter view)
EVENT_TYPES = {
    "click": "temperature",
    "signup": "humidity",
    "purchase": "soil_moisture",
    "error": "light_intensity",
    "view": "battery_level",
}
COPY_ID = 1_000_000_000


def readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One reading per event."""
    kind = F.lit(None).cast("string")
    for event, reading in EVENT_TYPES.items():
        kind = F.when(F.col("event_type") == event, reading).otherwise(kind)
    return spark.read.parquet(f"{sf_dir}/events.parquet").select(
        F.col("event_id").alias("id"),
        F.concat(F.lit("SENSOR_"), F.lpad(F.col("user_id").cast("string"), 6, "0")).alias("sensor_id"),
        F.col("ts").alias("timestamp"),
        kind.alias("reading_type"),
        "value",
        F.concat(F.lit("field_"), (F.col("user_id") % 3).cast("string")).alias("field"),
        F.get_json_object("props", "$.k").cast("int").alias("battery_level"),
    )


def readings_dirty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All readings with damage added: second copies, null values, blank sensors, large values."""
    clean = readings(spark, sf_dir)
    copies = clean.where(F.col("id") % 50 == 0).withColumn("id", F.col("id") + COPY_ID)
    scaled = F.when(F.col("reading_type") == "light_intensity", F.col("value") * 300).otherwise(F.col("value"))
    return clean.unionByName(copies).withColumns(
        {
            "value": F.when(F.col("id") % 97 == 0, F.lit(None)).otherwise(scaled),
            "sensor_id": F.when(F.col("id") % 211 == 0, F.lit("")).otherwise(F.col("sensor_id")),
        }
    )


def readings_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The damaged readings as untyped text, with numbers and times that do not parse."""
    dirty = readings_dirty(spark, sf_dir)
    number = F.col("value").cast("decimal(20,4)").cast("string")
    return dirty.withColumns(
        {
            "value": F.when(F.col("id") % 13 == 0, "n/a")
            .when(F.col("id") % 17 == 0, F.concat(F.lit("  "), number, F.lit(" ")))
            .otherwise(number),
            "timestamp": F.when(F.col("id") % 19 == 0, "not a time")
            .when(F.col("id") % 23 == 0, F.date_format("timestamp", "yyyy-MM-dd"))
            .when(F.col("id") % 29 == 0, F.lit(None))
            .otherwise(iso_text("timestamp")),
            "reading_type": F.when(F.col("id") % 7 == 0, F.upper("reading_type")).otherwise(F.col("reading_type")),
        }
    )


def nested(df: DataFrame) -> DataFrame:
    """Readings in landing form, with the field inside a ``location`` struct."""
    where = F.struct(
        F.col("field"),
        F.lit(28.5).cast("double").alias("latitude"),
        F.lit(77.25).cast("double").alias("longitude"),
    )
    return df.select(
        "id",
        "sensor_id",
        "timestamp",
        "reading_type",
        "value",
        F.lit("unit").alias("unit"),
        F.lit(None).cast("string").alias("field"),
        where.alias("location"),
        "battery_level",
        F.lit(50).alias("signal_strength"),
        F.lit(None).cast("string").alias("data_quality"),
    )


def land_parquet(df: DataFrame, path: str, mode: str = "append") -> str:
    nested(df).write.mode(mode).parquet(path)
    return path


def land_json(df: DataFrame, path: str, rows_per_file: int = 1000) -> str:
    """JSON files holding one array each. Ids are unique, so an array has at most ``rows_per_file`` rows."""
    rows = nested(df).withColumn("timestamp", iso_micros("timestamp"))
    part = F.floor(F.col("id") / rows_per_file)
    arrays = rows.groupBy(part.alias("part")).agg(F.to_json(F.collect_list(F.struct(*rows.columns))).alias("value"))
    arrays.select("value").write.mode("append").option("maxRecordsPerFile", 1).text(f"{path}/text")
    return path


def land_odd_json(df: DataFrame, path: str, rows_per_file: int = 1000) -> str:
    """JSON arrays in which every tenth id, location, latitude or battery level is not of its usual type, and one cut file.

    Ids ending in 3 are words, in 5 the location is a text, in 7 the latitude is a text, in 9 the battery level has a fraction.
    """
    rows = nested(df).withColumn("timestamp", iso_micros("timestamp"))
    last, text = F.col("id") % 10, F.col("text")
    odd = (
        F.when(last == 3, F.regexp_replace(text, '"id":([0-9]+)', '"id":"x$1"'))
        .when(last == 5, F.regexp_replace(text, '"location":[{][^}]*[}]', '"location":"field_1"'))
        .when(last == 7, F.regexp_replace(text, '"latitude":([0-9.]+)', '"latitude":"$1"'))
        .when(last == 9, F.regexp_replace(text, '"battery_level":([0-9]+)', '"battery_level":$1.4'))
        .otherwise(text)
    )
    records = rows.select("id", F.to_json(F.struct(*rows.columns)).alias("text")).select("id", odd.alias("text"))
    part = F.floor(F.col("id") / rows_per_file)
    arrays = records.groupBy(part.alias("part")).agg(F.concat(F.lit("["), F.array_join(F.collect_list("text"), ","), F.lit("]")).alias("value"))
    cut = arrays.agg(F.min("value").alias("value")).select(F.expr("left(value, length(value) - 1)").alias("value"))
    both = arrays.select("value").unionByName(cut)
    both.write.mode("append").option("maxRecordsPerFile", 1).text(f"{path}/text")
    return path


def land_odd_parquet(df: DataFrame, path: str) -> str:
    """Parquet folders that store battery level, value and time as other types, by the last digit of the id."""
    rows = nested(df)
    kinds = [{"battery_level": "double"}, {"battery_level": "bigint", "id": "int"}, {"value": "string"}, {"timestamp": "string", "battery_level": "string"}]
    for k, changes in enumerate(kinds):
        own = rows.where(F.pmod(F.col("id"), F.lit(len(kinds))) == k)
        own.withColumns({c: F.col(c).cast(t) for c, t in changes.items()}).write.mode("append").parquet(f"{path}/kind{k}")
    return path


def volume(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as readings of one sensor per supplier, for volume runs."""
    return spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("id"),
        F.concat(F.lit("SENSOR_"), F.lpad(F.col("l_suppkey").cast("string"), 6, "0")).alias("sensor_id"),
        F.col("l_shipdate").alias("timestamp"),
        F.col("l_returnflag").alias("reading_type"),
        F.col("l_quantity").alias("value"),
        F.concat(F.lit("field_"), (F.col("l_suppkey") % 3).cast("string")).alias("field"),
        F.lit(100).alias("battery_level"),
    )
