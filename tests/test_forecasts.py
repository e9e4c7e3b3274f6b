"""Future frames, cache reads, gaps, delta forecasts, live/archive and report
(M1, M8, M11, O1, A4, A10, S13, S14, S17, X10, X11, Q13, Q16-Q18)."""

import datetime as dt

import pandas as pd
from pyspark.sql import functions as F

from tidewater.operators import forecasts, reads


def _frame(spark, last, gran, n):
    df = spark.createDataFrame([(pd.Timestamp(last).to_pydatetime(), gran, n)],
                               "ds_max timestamp_ntz, granularity string, periods int")
    return [pd.Timestamp(r.ds) for r in forecasts.future_after(df).orderBy("step").collect()]


def _pandas_future(last, freq, n):
    """The library's rule: date_range from the last stamp, keep stamps after it, take n."""
    last = pd.Timestamp(last)
    dates = pd.date_range(start=last, periods=n + 1, freq=freq)
    return list(dates[dates > last][:n])


def test_future_after_matches_date_range(spark):
    for last in ["2024-01-30 23:00:00", "2024-01-31 10:00:00", "2023-12-31 00:00:00",
                 "2024-02-29 05:30:00", "2024-06-15 00:00:00"]:
        assert _frame(spark, last, "daily", 5) == _pandas_future(last, "D", 5)
        assert _frame(spark, last, "monthly", 14) == _pandas_future(last, "ME", 14)
        assert _frame(spark, last, "yearly", 3) == _pandas_future(last, "YE", 3)


def test_future_from_delta_rule(spark):
    for start in ["2024-01-31", "2024-02-01", "2024-12-31", "2024-06-15"]:
        df = spark.createDataFrame([(dt.date.fromisoformat(start), g, 4)
                                    for g in ("daily", "monthly", "yearly")],
                                   "start_date date, granularity string, periods int")
        got = {}
        for r in forecasts.future_from(df).orderBy("granularity", "step").collect():
            got.setdefault(r.granularity, []).append(pd.Timestamp(r.ds))
        s = pd.Timestamp(start)
        assert got["daily"] == list(pd.date_range(s, periods=4, freq="D"))
        assert got["monthly"] == list(pd.date_range(s, periods=4, freq="ME"))
        assert got["yearly"] == list(pd.date_range(s, periods=4, freq="YE"))


def _live(spark):
    rows = []
    for i in range(10):
        d = dt.date(2024, 1, 1) + dt.timedelta(days=i)
        rows.append((1, "C1", d, float(i), i - 1.0, i + 1.0, "daily"))
    rows.append((1, "C1", dt.date(2024, 1, 31), 5.0, 4.0, 6.0, "monthly"))
    return spark.createDataFrame(rows, "model_version_id long, category_id string, "
                                       "forecast_date date, predicted_sales double, "
                                       "lower_bound double, upper_bound double, "
                                       "granularity string")


def test_cache_reads_and_gaps(spark):
    live = _live(spark)
    first = reads.cached_forecast(live, "C1", "daily", 3).collect()
    assert [r.date for r in first] == ["2024-01-01", "2024-01-02", "2024-01-03"]
    req = spark.createDataFrame([("r1", "C1", "daily", 10), ("r2", "C1", "daily", 12),
                                 ("r3", "C1", "daily", 4), ("r4", "C2", "yearly", 2)],
                                "request_id string, category_id string, granularity string, "
                                "period int")
    gaps = {r.request_id: (r.n_cached, r.n_missing, r.last_cached_date)
            for r in reads.forecast_gaps(live, req).collect()}
    assert gaps == {"r1": (10, 0, dt.date(2024, 1, 10)), "r2": (10, 2, dt.date(2024, 1, 10)),
                    "r3": (10, 0, dt.date(2024, 1, 10)), "r4": (0, 2, None)}
    pts = reads.cached_points(live, req.where("request_id = 'r3'"))
    assert pts.count() == 4


def test_delta_apply_refuses_collisions(spark):
    live = _live(spark)
    delta = live.where("forecast_date = date'2024-01-05'")
    _, dups = forecasts.delta_apply(live, delta)
    assert dups.count() == 1
    ok = live.where("forecast_date = date'2024-01-05'").withColumn(
        "forecast_date", F.lit(dt.date(2024, 1, 11)))
    merged, dups = forecasts.delta_apply(live, ok)
    assert dups.count() == 0 and merged.count() == 12


def test_archive_and_refresh(spark):
    live = _live(spark)
    arch = forecasts.archive_forecasts(live, "2024-02-01 00:00:00")
    assert arch.count() == 11 and arch.select("archived_at").distinct().count() == 1
    fresh = live.where("granularity = 'daily'").withColumn("category_id", F.lit("C2"))
    new = forecasts.refreshed_live(live, fresh)
    # C2 replaced/added, C1 kept because it has no new forecast (Q19 deviation)
    assert new.where("category_id = 'C1'").count() == 11
    assert new.where("category_id = 'C2'").count() == 10


def test_report_format(spark):
    pts = spark.createDataFrame([("C1", "2024-01-02", 1234.5, 1000.0, 1500.125),
                                 ("C1", "2024-01-01", 0.005, -1.0, 2.0)],
                                "category_id string, date string, predicted_sales double, "
                                "lower_bound double, upper_bound double")
    lines = [r.line for r in forecasts.forecast_report(pts).orderBy("line_no").collect()]
    assert lines[0] == "Daily Sales Forecast for Category: C1"
    assert lines[1] == "=" * 50 and lines[3] == "-" * 50
    assert lines[2] == f"{'Date':<12} | {'Predicted Sales':>15} | {'Lower Bound':>12} | {'Upper Bound':>12}"
    assert lines[4] == f"{'2024-01-01':<12} | {f'{0.005:.2f}':>15} | {f'{-1.0:.2f}':>12} | {f'{2.0:.2f}':>12}"
    assert lines[5] == f"{'2024-01-02':<12} | {'1234.50':>15} | {'1000.00':>12} | {f'{1500.125:.2f}':>12}"


def test_recent_jobs_limit_parse(spark):
    from tidewater.operators.ingest import _clamp_limit
    assert _clamp_limit(None, 20, 100) == 20
    assert _clamp_limit("500", 20, 100) == 100
    assert _clamp_limit("abc", 20, 100) == 0


def test_performance_rows_at_the_forecast_instant(spark):
    import datetime as _dt
    hist = spark.createDataFrame(
        [(7, "C1", _dt.datetime(2024, 1, 5, 23), 90.0), (7, "C1", _dt.datetime(2024, 1, 9, 23), 0.0), (7, "C1", _dt.datetime(2024, 1, 6, 23), 110.0),
         (7, "C1", _dt.datetime(2024, 2, 1, 23), 50.0)],
        "model_version_id long, category_id string, forecast_ts timestamp_ntz, "
        "predicted_sales double")
    fact = spark.createDataFrame(
        [(_dt.datetime(2024, 1, 5, 23), "C1", 100.0), (_dt.datetime(2024, 1, 6, 23), "C1", 100.0),
         (_dt.datetime(2024, 1, 6, 22), "C1", 999.0), (_dt.datetime(2024, 1, 9, 23), "C1", 0.0)],
        "time timestamp_ntz, category_id string, total_sales double")
    got = {(str(r.evaluation_period_start), r.metric_name): r.metric_value
           for r in forecasts.performance_rows(hist, fact).collect()}
    assert got == {("2024-01-01", "mape"): 0.1, ("2024-01-01", "rmse"): (200 / 3) ** 0.5,
                   ("2024-01-01", "n_points"): 3.0}


def test_latest_model_ties_by_id(spark):
    import datetime as _dt
    v = spark.createDataFrame(
        [(1, "C1", "v1", _dt.datetime(2024, 1, 1)), (2, "C1", "v2", _dt.datetime(2024, 1, 2)),
         (3, "C1", "v3", _dt.datetime(2024, 1, 2)), (4, "C2", "v4", _dt.datetime(2023, 1, 1))],
        "id long, category_id string, version string, training_date_utc timestamp_ntz")
    got = {r.category_id: r.model_version_id for r in reads.latest_model(v).collect()}
    assert got == {"C1": 3, "C2": 4}
    marked = {r.id: r.is_latest for r in reads.mark_latest(v).collect()}
    assert marked == {1: False, 2: False, 3: True, 4: True}
