"""Run table: counters, seconds and status of the stages of each load."""

from __future__ import annotations

import time
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import path_exists

RUNS = "stage string, metric string, value double, status string, run string"
SECONDS = "seconds"


class Run:
    """Stages of one load. Saved once at its end, also if a stage fails; saving the same run again replaces it."""

    def __init__(self, spark: SparkSession, home: str, name: str):
        self.spark, self.path, self.rows = spark, f"{home}/runs/run={name}", []

    @contextmanager
    def stage(self, name: str):
        """Counters that the stage puts into the yielded dictionary become rows of the run table."""
        counters, began, status = {}, time.monotonic(), "failed"
        try:
            yield counters
            status = "completed"
        finally:
            counters = {**counters, SECONDS: time.monotonic() - began}
            self.rows += [(name, metric, float(value), status) for metric, value in counters.items()]
            if status == "failed":
                self.save()

    def save(self) -> None:
        shape = RUNS.removesuffix(", run string")
        self.spark.createDataFrame(self.rows, shape).coalesce(1).write.mode("overwrite").parquet(self.path)

    def seconds(self, stage: str) -> float:
        return sum(v for s, m, v, _ in self.rows if s == stage and m == SECONDS)


def read_runs(spark: SparkSession, home: str) -> DataFrame:
    """(run, stage, metric, value, status) of all loads."""
    path = f"{home}/runs"
    if not path_exists(spark, path):
        return spark.createDataFrame([], RUNS).select("run", "stage", "metric", "value", "status")
    return spark.read.schema(RUNS).parquet(path).select("run", "stage", "metric", "value", "status")


def run_counters(runs: DataFrame) -> DataFrame:
    """Counters of all loads, added up per stage; wall-clock figures are left out."""
    return runs.where(F.col("metric") != SECONDS).groupBy("stage", "metric").agg(F.sum("value").cast("bigint").alias("total"))


def stage_status(runs: DataFrame) -> DataFrame:
    """Per stage: runs completed and failed, and seconds spent."""
    marks = runs.where(F.col("metric") == SECONDS)
    return marks.groupBy("stage").agg(
        F.count_if(F.col("status") == "completed").alias("completed"),
        F.count_if(F.col("status") == "failed").alias("failed"),
        F.sum("value").alias("seconds"),
    )
