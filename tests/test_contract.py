"""Driver contract: entry() runs on sf0.001; every oracle key is a registered query; the
cheap relational queries match their DuckDB SQL at sf0.001."""

import datetime as dt
import decimal
import math

import duckdb
import pytest

import __spark_entry__ as entry
from conftest import SMOKE
from tidewater.sources.tables import TABLES

FAST = ["hourly_sales", "clean_sales", "ledger_latest", "files_to_process", "dim_promotions",
        "promotion_targets", "promotion_days", "latest_model", "tail_forecast",
        "forecast_gaps", "cv_params", "cv_cutoffs", "future_dates", "live_accuracy",
        "forecast_report", "recent_jobs"]


def test_entry_runs(spark):
    df = entry.entry(spark)
    assert df.count() > 0
    assert df.columns == ["time", "category_id", "total_sales", "total_quantity"]


SURVEY_KEYS = """scan_sales_csv file_quality dim_categories dim_products dim_promotions
training_frame stream_hourly hourly_merge live_forecasts delta_apply archive_forecasts
model_registry ledger_latest forecast_report clean_sales cached_forecast forecast_history
products_by_category promotion_targets latest_model trainable_categories cv_params
forecast_requests future_with_promos files_to_process missing_models fk_orphans
category_mismatch duplicate_keys hourly_sales model_categories last_cached training_metadata
forecast_history_nested backtest_metrics forecast_gaps tail_forecast recent_jobs
recent_etl_jobs list_categories list_promotions model_versions model_performance
all_model_versions job_status promotion_days future_dates cv_cutoffs fit_models
backtest_forecasts forecast delta_forecast refresh_forecasts live_accuracy""".split()


def test_oracle_keys_are_queries():
    q, o = entry.queries(), entry.oracle_sql()
    assert set(o) <= set(q)
    assert set(SURVEY_KEYS) <= set(q), sorted(set(SURVEY_KEYS) - set(q))


def _norm(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    if isinstance(v, decimal.Decimal):
        return round(float(v), 6)
    if isinstance(v, (dt.datetime, dt.date)):
        return v.isoformat()
    return v


@pytest.mark.parametrize("key", FAST)
def test_matches_duckdb(spark, key):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SMOKE}/{t}.parquet')")
    sdf = entry.queries()[key](spark, SMOKE)
    rel = con.sql(entry.oracle_sql()[key])
    assert sorted(sdf.columns) == sorted(rel.columns)
    cols = sorted(sdf.columns)
    s_rows = sorted(repr([_norm(r[c]) for c in cols]) for r in sdf.collect())
    d_idx = [rel.columns.index(c) for c in cols]
    d_rows = sorted(repr([_norm(r[i]) for i in d_idx]) for r in rel.fetchall())
    assert s_rows == d_rows
