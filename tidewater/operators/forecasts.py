"""Forecast operators: future frames, the standard cached set, delta forecasts for gaps,
the live table and its archive, refresh, registry rows, live accuracy and the text report
(M1, M7-M12, S12-S15, S17, U1, U2, X8, X10, X11, X13, X16).

A batch of requests is a DataFrame; every request is answered by the same joins, so the
cost is one job for all categories instead of a loop of per-category database calls.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..model import predict as model_predict
from ..model.stats import epoch_s
from ..schemas import GRANULARITIES, STANDARD_SET

POINT_COLS = ["predicted_sales", "lower_bound", "upper_bound"]


# ------------------------------------------------------------------- argument checks
def request_error(granularity: Column, periods: Column) -> Column:
    """Why a request cannot be answered (null if it can): the granularity must be a known one
    and the number of periods a positive integer."""
    # The two messages of the forecast route.
    return (F.when(~F.coalesce(granularity.isin(*GRANULARITIES), F.lit(False)), F.lit(
                "Invalid forecast_horizon. Choose 'daily', 'monthly', or 'yearly'."))
            .when(~F.coalesce(periods > 0, F.lit(False)), F.lit(
                "Period must be a positive integer.")))


def answerable(requests: DataFrame, periods: str = "periods") -> DataFrame:
    """The requests without an argument error."""
    return requests.where(request_error(F.col("granularity"), F.col(periods)).isNull())


# ----------------------------------------------------------------------- future frames
def _tod_s(ts: Column) -> Column:
    return epoch_s(ts) - epoch_s(F.to_date(ts).cast("timestamp_ntz"))


def _at(date: Column, tod: Column) -> Column:
    return F.timestamp_seconds(epoch_s(date.cast("timestamp_ntz")) + tod).cast("timestamp_ntz")


def future_after(last: DataFrame, ts_col: str = "ds_max") -> DataFrame:
    """M1/X10 (model frame): for rows (…, ts_col, granularity, periods) the ``periods``
    stamps strictly after the last observation, keeping its time of day: daily = +i days,
    monthly = month ends, yearly = 31 December (period-end frequencies, Q18)."""
    last_ts = F.col(ts_col)
    base = F.to_date(last_ts)
    m0 = F.trunc(base, "month")
    m_off = F.when(F.last_day(base) > base, F.lit(0)).otherwise(F.lit(1))
    y_off = F.when(F.make_date(F.year(base), F.lit(12), F.lit(31)) > base,
                   F.lit(0)).otherwise(F.lit(1))
    i = F.col("step")
    date_i = (F.when(F.col("granularity") == "daily", F.date_add(base, i))
              .when(F.col("granularity") == "monthly",
                    F.last_day(F.add_months(m0, m_off + i - 1)))
              .otherwise(F.make_date(F.year(base) + y_off + i - 1, F.lit(12), F.lit(31))))
    return (last.withColumn("step", F.explode(F.sequence(F.lit(1),
                                                         F.col("periods").cast("int"))))
            .withColumn("ds", _at(date_i, _tod_s(last_ts))))


def future_from(start: DataFrame, start_col: str = "start_date") -> DataFrame:
    """M8/X10 (delta frame): ``periods`` dates from ``start_col`` inclusive at midnight:
    daily = start + i, monthly = month ends >= start, yearly = 31 December >= start."""
    s = F.col(start_col)
    i = F.col("step")
    date_i = (F.when(F.col("granularity") == "daily", F.date_add(s, i - 1))
              .when(F.col("granularity") == "monthly",
                    F.last_day(F.add_months(F.trunc(s, "month"), i - 1)))
              .otherwise(F.make_date(F.year(s) + i - 1, F.lit(12), F.lit(31))))
    return (start.withColumn("step", F.explode(F.sequence(F.lit(1),
                                                          F.col("periods").cast("int"))))
            .withColumn("ds", date_i.cast("timestamp_ntz")))


def granularity_frame(models: DataFrame, plan=STANDARD_SET) -> DataFrame:
    """(…, granularity, periods) for each model row: the standard set 90/24/5 (M9)."""
    arr = F.array(*[F.struct(F.lit(g).alias("granularity"), F.lit(n).alias("periods"))
                    for g, n in plan])
    return (models.withColumn("_g", F.explode(arr))
            .select("*", F.col("_g.granularity").alias("granularity"),
                    F.col("_g.periods").alias("periods")).drop("_g"))


# -------------------------------------------------------------------------- forecasting
def _output(pred: DataFrame) -> DataFrame:
    return pred.select(
        "category_id", "granularity", F.col("ds").alias("forecast_ts"),
        F.to_date("ds").alias("forecast_date"),
        F.col("yhat").alias("predicted_sales"), F.col("yhat_lower").alias("lower_bound"),
        F.col("yhat_upper").alias("upper_bound"), "model_version_id")


def standard_forecasts(models: DataFrame, promo_feats: DataFrame | None,
                       plan=STANDARD_SET) -> DataFrame:
    """The cached set for every category with a model.

    ``models``: fitted parameters of the latest model per category (fit_id, category_id,
    ds_max, model_version_id, ...)."""
    frame = granularity_frame(
        models.select("fit_id", "category_id", "ds_max", "model_version_id"), plan)
    targets = future_after(frame).select("fit_id", "category_id", "granularity", "ds",
                                         "model_version_id")
    return _output(model_predict.predict(targets, models, promo_feats))


def forecast(models: DataFrame, requests: DataFrame, promo_feats: DataFrame | None) -> DataFrame:
    """M7 for a request table (category_id, granularity, periods): ``periods`` points after
    the last observation, dates as text (the on-demand forecast response). Requests with a
    bad argument get no points (``request_error`` tells why)."""
    frame = (answerable(requests).join(models.select("fit_id", "category_id", "ds_max",
                                         "model_version_id"), "category_id"))
    targets = future_after(frame).select("fit_id", "category_id", "granularity", "ds",
                                         "model_version_id")
    out = _output(model_predict.predict(targets, models, promo_feats))
    return out.select("category_id", "granularity",
                      F.date_format("forecast_date", "yyyy-MM-dd").alias("date"), *POINT_COLS)


def delta_forecast(models: DataFrame, gaps: DataFrame, promo_feats: DataFrame | None,
                   today) -> DataFrame:
    """M8: for each (category, granularity) with missing points, forecast the largest number
    that one of its requests misses, from the day after the last cached date (or after
    ``today`` when the cache is empty). Requests for the same key share those points."""
    need = (answerable(gaps, "period").where(F.col("n_missing") > 0)
            .groupBy("category_id", "granularity")
            .agg(F.max("n_missing").alias("periods"), F.max("last_cached_date").alias("_last"))
            .select("category_id", "granularity", "periods",
                    F.date_add(F.coalesce(F.col("_last"),
                                          F.lit(today).cast("date")), 1).alias("start_date"))
            .join(models.select("fit_id", "category_id", "model_version_id"), "category_id"))
    targets = future_from(need).select("fit_id", "category_id", "granularity", "ds",
                                       "model_version_id")
    return _output(model_predict.predict(targets, models, promo_feats))


# --------------------------------------------------------------------- live and archive
def live_rows(forecasts: DataFrame) -> DataFrame:
    """live_forecasts rows with a stable id (hash of the unique key) and the full forecast
    instant ``forecast_ts`` (Q13; null where the rows do not know it)."""
    ts = F.col("forecast_ts") if "forecast_ts" in forecasts.columns else F.lit(None)
    return forecasts.select(
        F.pmod(F.xxhash64("category_id", "forecast_date", "granularity"),
               F.lit(1 << 62)).alias("id"),
        "model_version_id", "category_id", "forecast_date", *POINT_COLS, "granularity",
        ts.cast("timestamp_ntz").alias("forecast_ts"))


def archive_forecasts(live: DataFrame, archived_at) -> DataFrame:
    """The live rows appended to history with the archive stamp (no dedupe)."""
    return live_rows(live).drop("id").withColumn(
        "archived_at", F.lit(archived_at).cast("timestamp_ntz"))


def delta_apply(live: DataFrame, delta: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Live + delta rows, and the key collisions that must refuse the whole load."""
    merged = live_rows(live).unionByName(live_rows(delta))
    dups = (merged.groupBy("category_id", "forecast_date", "granularity")
            .agg(F.count(F.lit(1)).alias("n_rows")).where(F.col("n_rows") > 1))
    return merged, dups


def refreshed_live(old_live: DataFrame, new_forecasts: DataFrame) -> DataFrame:
    """M10 (Q19 deviation): new live table — categories with a new forecast are replaced,
    the others keep their previous rows."""
    fresh = live_rows(new_forecasts)
    old = live_rows(old_live)
    kept = old.join(fresh.select("category_id").distinct(), "category_id", "left_anti")
    return fresh.unionByName(kept.select(*fresh.columns))


# ---------------------------------------------------------------------------- registry
def registry_rows(models: DataFrame, metadata: DataFrame, metrics_json: DataFrame | None,
                  as_of) -> DataFrame:
    """New model_versions rows: version = run time as yyyyMMddHHmmss, id a
    stable hash of (category, version), parameters as a struct, metadata and metrics as
    JSON text. ``is_latest`` is TRUE for the new rows (older rows are unmarked by
    ``reads.mark_latest``)."""
    ts = F.lit(as_of).cast("timestamp_ntz")
    version = F.date_format(ts, "yyyyMMddHHmmss")
    m = models.where(F.col("status") == "OK").join(metadata, "category_id", "left")
    if metrics_json is not None:
        m = m.join(metrics_json, "category_id", "left")
    else:
        m = m.withColumn("backtesting_metrics", F.lit(None).cast("string"))
    return m.select(
        F.pmod(F.xxhash64("category_id", version), F.lit(1 << 62)).alias("id"),
        "category_id", version.alias("version"),
        F.struct("t0_s", "t_scale_s", "y_scale", "cp_t", "yearly_order", "weekly_order",
                 "daily_order", "hol_names", "sigma", "beta", "lambda_mean", "ds_max")
        .alias("params"),
        ts.alias("training_date_utc"), F.lit(True).alias("is_latest"),
        "metadata", F.coalesce("backtesting_metrics", F.lit("[]")).alias("backtesting_metrics"))


def models_from_registry(registry: DataFrame) -> DataFrame:
    """M7: the stored parameters of registry rows as the model table that ``predict`` takes,
    so a forecast needs no new fit (one row per registry row; give it the latest ones)."""
    return registry.select(F.col("category_id").alias("fit_id"), "category_id",
                           F.col("id").alias("model_version_id"), F.lit("OK").alias("status"),
                           "params.*")


def request_outcomes(gaps: DataFrame, models: DataFrame) -> DataFrame:
    """Per request of a batch: COMPLETED (from the cache, or with the points that a delta
    forecast adds) or FAILED with its message — the status row of each job."""
    known = models.where("status = 'OK'").select("category_id", F.lit(True).alias("_m")).distinct()
    error = F.coalesce(
        request_error(F.col("granularity"), F.col("period")),
        F.when((F.col("n_missing") > 0) & F.col("_m").isNull(), F.concat(
            F.lit("No model for category "), F.coalesce("category_id", F.lit("")))))
    return (gaps.join(known, "category_id", "left").withColumn("error_message", error)
            .select("request_id", "category_id", "granularity", "period", "n_cached",
                    F.when(F.col("error_message").isNull(), F.lit("COMPLETED"))
                    .otherwise(F.lit("FAILED")).alias("status"), "error_message",
                    F.when(F.col("error_message").isNull(), F.col("n_missing"))
                    .otherwise(F.lit(0)).alias("n_forecast")))


# ------------------------------------------------------------------------- live accuracy
def _accuracy_long(j: DataFrame) -> DataFrame:
    """(model_version_id, forecast_date, predicted_sales, actual) -> MAPE, RMSE and the
    number of points per version and calendar month, in long format. A point with an actual
    of zero has no percentage error: it counts for RMSE only."""
    err = F.col("actual") - F.col("predicted_sales")
    agg = (j.groupBy("model_version_id",
                     F.trunc("forecast_date", "month").alias("evaluation_period_start"))
           .agg(F.avg(F.abs(F.try_divide(err, F.col("actual")))).alias("mape"),
                F.sqrt(F.avg(err * err)).alias("rmse"),
                F.count(F.lit(1)).cast("double").alias("n_points")))
    return (agg.select("model_version_id", "evaluation_period_start",
                       F.last_day("evaluation_period_start").alias("evaluation_period_end"),
                       F.explode(F.array(*[F.struct(F.lit(m).alias("metric_name"),
                                                    F.col(m).alias("metric_value"))
                                           for m in ("mape", "rmse", "n_points")])).alias("_m"))
            .select("model_version_id", "evaluation_period_start", "evaluation_period_end",
                    F.col("_m.metric_name").alias("metric_name"),
                    F.col("_m.metric_value").alias("metric_value")))


def live_accuracy(history: DataFrame, fact: DataFrame) -> DataFrame:
    """Accuracy of archived forecasts against the hourly fact at the same instant, per
    model version and calendar month, in the long format of forecast_performance — the model
    forecasts the hourly value at ``forecast_ts``, so a forecast is scored against the fact row
    of that hour (Q13)."""
    actual = fact.select("category_id", F.col("time").alias("forecast_ts"),
                         F.col("total_sales").cast("double").alias("actual"))
    j = (history.join(actual, ["category_id", "forecast_ts"])
         .select("model_version_id", F.to_date("forecast_ts").alias("forecast_date"),
                 "predicted_sales", "actual"))
    return _accuracy_long(j)


def performance_rows(history: DataFrame, fact: DataFrame) -> DataFrame:
    """M12 writer (Q22): the rows of ``live_accuracy`` with a stable id."""
    acc = live_accuracy(history, fact)
    return acc.select(
        F.pmod(F.xxhash64("model_version_id", "evaluation_period_end", "metric_name"),
               F.lit(1 << 62)).alias("id"), *acc.columns)


# ------------------------------------------------------------------------ text report
@F.pandas_udf(T.StringType())
def _fixed2(v: pd.Series) -> pd.Series:
    """``%.2f`` with the exact rounding of the binary value (as the client prints it;
    Java's formatter rounds the shortest decimal instead and differs on ties)."""
    return v.map(lambda x: None if pd.isna(x) else f"{x:.2f}")


def forecast_report(points: DataFrame) -> DataFrame:
    """The fixed-width text report per category, one row per line.

    ``points``: (category_id, date text, predicted_sales, lower_bound, upper_bound).
    Output: (category_id, line_no, line) — header lines 0-3, then one line per point.
    """
    from ..util import ship_package
    ship_package(points.sparkSession)     # the %.2f helper runs in Python workers
    # The report's title, rule widths and column widths.
    title = F.concat(F.lit("Daily Sales Forecast for Category: "), F.col("category_id"))
    header = F.lit(f"{'Date':<12} | {'Predicted Sales':>15} | {'Lower Bound':>12} | "
                   f"{'Upper Bound':>12}")
    cats = points.select("category_id").distinct()
    head = cats.select("category_id", F.explode(F.array(
        F.struct(F.lit(0).alias("line_no"), title.alias("line")),
        F.struct(F.lit(1).alias("line_no"), F.lit("=" * 50).alias("line")),
        F.struct(F.lit(2).alias("line_no"), header.alias("line")),
        F.struct(F.lit(3).alias("line_no"), F.lit("-" * 50).alias("line")),
    )).alias("_l")).select("category_id", "_l.line_no", "_l.line")
    from pyspark.sql import Window
    w = Window.partitionBy("category_id").orderBy("date")
    body = points.select(
        "category_id", (F.row_number().over(w) + 3).alias("line_no"),
        F.format_string("%-12s | %15s | %12s | %12s", F.col("date"),
                        _fixed2("predicted_sales"), _fixed2("lower_bound"),
                        _fixed2("upper_bound")).alias("line"))
    return head.unionByName(body)
