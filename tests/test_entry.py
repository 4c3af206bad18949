"""The driver contract and plan rules that hold for every registered query."""

import re
import sys
from pathlib import Path

import pytest
from helpers import plan

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))

import __spark_entry__ as entry  # noqa: E402

DATA = Path("/root/testdata/sf0.001")
needs_data = pytest.mark.skipif(not DATA.exists(), reason="given tables are not here")
ROWS_ONLY = {"landing_files", "run_timings", "data_profile_sketch"}
LAZY = [
    "filter_equality", "filter_time", "daily_aggregation", "sensor_directory", "summary_by_type", "rolling_average", "gaps",
    "coverage", "hourly_spine", "temporal_anomalies", "quality_rows", "calibrate_by_config", "validity_rules", "deduplicate",
]


def test_every_query_has_a_twin():
    own = set(entry.queries()) - set(entry.CORPUS_QUERIES)
    assert own - set(entry.oracle_sql()) == ROWS_ONLY
    assert set(entry.oracle_sql()) <= set(entry.queries())


@needs_data
def test_flagship(spark):
    df = entry.entry(spark)
    assert df.count() == 30 and df.columns == ["date", "count", "min", "max", "avg", "sum"]


@needs_data
@pytest.mark.parametrize("name", LAZY)
def test_plans_stay_in_the_jvm_and_join_without_products(spark, name):
    text = plan(entry.queries()[name](spark, str(DATA)))
    for word in ("PythonUDF", "BatchEvalPython", "ArrowEvalPython", "CartesianProduct", "BroadcastNestedLoopJoin"):
        assert word not in text


@needs_data
def test_filters_reach_the_scan_and_columns_are_pruned(spark):
    text = plan(entry.queries()["filter_time"](spark, str(DATA)))
    assert "GreaterThanOrEqual(ts" in text and "LessThanOrEqual(ts" in text
    daily = plan(entry.queries()["daily_aggregation"](spark, str(DATA)))
    schemas = set(re.findall(r"ReadSchema: struct<([^>]*)>", daily))
    assert all("props" not in s and "user_id" not in s for s in schemas)


@needs_data
def test_rule_lookup_is_broadcast(spark):
    assert "BroadcastHashJoin" in plan(entry.queries()["calibrate_by_config"](spark, str(DATA)))
