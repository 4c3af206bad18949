"""Exact medians by selection."""

import random
import statistics

import pytest
from pyspark.sql import functions as F

from tidemark.operators import selection


@pytest.mark.parametrize("max_rows", [0, 50])
def test_medians_equal_plain_ones(spark, max_rows):
    rnd = random.Random(max_rows)
    groups = {
        "one": [5.0], "two": [1.0, 2.0], "hot": [7.0] * 3000 + [1.0], "halves": [1.0] * 500 + [2.0] * 500, "normal": [rnd.gauss(0, 1) for _ in range(2001)],
        "wide": [rnd.choice((-1, 1)) * 10 ** rnd.uniform(-300, 300) for _ in range(2000)], "extremes": [float("-inf")] * 3 + [float("inf")] * 3 + [0.0], None: [3.0, 9.0, 4.0],
        "zeros": [0.0, -0.0, 0.0], "mostly hot": [0.0] * 700 + [rnd.random() for _ in range(800)],
    }
    rows = [(k, v) for k, own in groups.items() for v in own]
    rnd.shuffle(rows)
    df = spark.createDataFrame(rows, "g string, value double").repartition(4)
    got = {r.g: r.median for r in selection.median_by_selection(df, ["g"], "value", max_rows).collect()}
    assert got == {k: statistics.median(own) for k, own in groups.items()}
    whole = selection.median_by_selection(df.where("g = 'normal'"), [], "value", max_rows).collect()
    assert [r.median for r in whole] == [statistics.median(groups["normal"])]
    assert selection.median_by_selection(df.limit(0), ["g"], "value", max_rows).count() == 0


def test_not_a_number_is_the_largest_value(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("a", float("nan")), ("b", float("nan"))], "g string, value double")
    got = {r.g: r.median for r in selection.median_by_selection(df, ["g"], "value", 0).collect()}
    assert got["a"] == 2.0 and got["b"] != got["b"]


def test_ranges_shrink_and_rows_are_neither_sorted_nor_written(spark):
    df = spark.range(200_000).select(F.lit("g").alias("g"), F.rand(7).alias("value"))
    found = selection.median_by_selection(df, ["g"], "value", 1000)
    want = df.agg(F.median("value")).first()[0]
    assert found.first().median == want
    first = selection._scan(df, None, ["g"], "value").first()
    second = selection._scan(df, spark.createDataFrame([first]), ["g"], "value").first()
    assert second.m < 0.1 * first.m and second.below <= second.first_rank < second.below + second.m
