"""Physical plan shape: pruned scans, partial aggregation before the shuffle, and no
cross or nested-loop joins in the relational queries."""

import pytest

import __spark_entry__ as entry
from conftest import SMOKE

RELATIONAL = ["hourly_sales", "hourly_sales_daily", "hourly_merge", "ledger_latest",
              "files_to_process", "promotion_targets", "promotion_days", "fk_orphans",
              "duplicate_keys", "category_mismatch", "tail_forecast", "forecast_gaps",
              "forecast_history_nested", "live_accuracy", "rolling_metrics", "cv_cutoffs",
              "future_with_promos", "all_model_versions"]


def _plan(spark, key):
    return entry.queries()[key](spark, SMOKE)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("key", RELATIONAL)
def test_no_cross_or_nested_loop_joins(spark, key):
    plan = _plan(spark, key)
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_rollup_is_partial_and_pruned(spark):
    df = entry.queries()["hourly_sales_daily"](spark, SMOKE)
    text = df._jdf.queryExecution().explainString(
        spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    assert "partial_sum" in text
    # lineitem is read with 3 of its 11 columns
    assert "ReadSchema: struct<l_partkey:bigint,l_quantity:double,l_shipdate:timestamp_ntz>" in text
