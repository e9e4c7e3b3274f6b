"""Registered live-table, archive, refresh, accuracy and report queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import forecasts, reads
from ..sources.tables import (historical_forecasts_from_orders, jobs_from_orders,
                              live_forecasts_from_orders, read_table)
from .q_model import AS_OF, TODAY, brand_feats, latest_models, steps_sql
from .q_reads import HIST_SQL, JOBS_SQL, LIVE_SQL
from .registry import register

ARCHIVED_AT = "2002-01-01 00:00:00"


def live(spark, sf_dir):
    return live_forecasts_from_orders(read_table(spark, sf_dir, "orders"))


@register("archive_forecasts", f"""
SELECT model_version_id, category_id, forecast_date, predicted_sales, lower_bound,
       upper_bound, granularity, CAST(NULL AS TIMESTAMP) AS forecast_ts, TIMESTAMP '{ARCHIVED_AT}' AS archived_at
FROM ({LIVE_SQL})""")
def q_archive_forecasts(spark, sf_dir):
    """Every live row copied to history with the archive stamp."""
    return forecasts.archive_forecasts(live(spark, sf_dir), ARCHIVED_AT)


@register("live_accuracy", f"""
WITH act AS (SELECT o_orderpriority AS category_id, CAST(o_orderdate AS DATE) AS forecast_date,
                    sum(o_totalprice) AS actual FROM orders GROUP BY 1, 2),
j AS (SELECT h.model_version_id, h.forecast_date, h.predicted_sales, a.actual
      FROM ({HIST_SQL}) h JOIN act a USING (category_id, forecast_date)),
agg AS (SELECT model_version_id, date_trunc('month', forecast_date) AS evaluation_period_start,
               avg(abs((actual - predicted_sales) / actual)) AS mape,
               sqrt(avg((actual - predicted_sales) * (actual - predicted_sales))) AS rmse,
               CAST(COUNT(*) AS DOUBLE) AS n_points
        FROM j GROUP BY 1, 2)
SELECT model_version_id, CAST(evaluation_period_start AS DATE) AS evaluation_period_start,
       last_day(evaluation_period_start) AS evaluation_period_end, metric_name,
       round(metric_value, 4) AS metric_value
FROM agg UNPIVOT (metric_value FOR metric_name IN (mape, rmse, n_points))""")
def q_live_accuracy(spark, sf_dir):
    """Archived forecasts (by model version) against the totals of their day."""
    o = read_table(spark, sf_dir, "orders")
    hist = historical_forecasts_from_orders(o).withColumn(
        "forecast_ts", F.col("forecast_date").cast("timestamp_ntz"))
    fact = (o.groupBy(F.col("o_orderpriority").alias("category_id"),
                      F.to_date("o_orderdate").cast("timestamp_ntz").alias("time"))
            .agg(F.sum("o_totalprice").alias("total_sales")))
    return forecasts.live_accuracy(hist, fact).withColumn(
        "metric_value", F.round("metric_value", 4))


@register("forecast_report", f"""
WITH pts AS (SELECT category_id, strftime(forecast_date, '%Y-%m-%d') AS date, predicted_sales,
                    lower_bound, upper_bound FROM ({LIVE_SQL}) WHERE granularity = 'daily'),
cats AS (SELECT DISTINCT category_id FROM pts)
SELECT category_id, 0 AS line_no, 'Daily Sales Forecast for Category: ' || category_id AS line
FROM cats
UNION ALL SELECT category_id, 1, repeat('=', 50) FROM cats
UNION ALL SELECT category_id, 2, 'Date         | Predicted Sales |  Lower Bound |  Upper Bound'
FROM cats
UNION ALL SELECT category_id, 3, repeat('-', 50) FROM cats
UNION ALL
SELECT category_id, CAST(3 + row_number() OVER (PARTITION BY category_id ORDER BY date) AS INTEGER),
       printf('%-12s | %15s | %12s | %12s', date, printf('%.2f', predicted_sales),
              printf('%.2f', lower_bound), printf('%.2f', upper_bound))
FROM pts""")
def q_forecast_report(spark, sf_dir):
    """Fixed-width text report of the daily cached points per category."""
    pts = (live(spark, sf_dir).where(F.col("granularity") == "daily")
           .select("category_id", F.date_format("forecast_date", "yyyy-MM-dd").alias("date"),
                   "predicted_sales", "lower_bound", "upper_bound"))
    return forecasts.forecast_report(pts)


@register("delta_apply", f"""
SELECT category_id, granularity, COUNT(*) AS n_points, max(CAST(ds AS DATE)) AS last_date,
       CAST(0 AS BIGINT) AS n_colliding_keys
FROM ({steps_sql(120, 30, 7)}) GROUP BY 1, 2""")
def q_delta_apply(spark, sf_dir):
    """Delta forecasts for the gaps of a request batch (two overlapping requests per key)
    appended to the live table, with the all-or-nothing key check."""
    feats = brand_feats(spark, sf_dir)
    models = latest_models(spark, sf_dir, feats=feats)
    live_t = forecasts.live_rows(forecasts.standard_forecasts(models, feats))
    req = (models.select("category_id").distinct()
           .select("category_id", F.explode(F.array(*[
               F.struct(F.lit(g).alias("granularity"), F.lit(n).alias("period"))
               for g, n in (("daily", 120), ("daily", 100), ("monthly", 30), ("monthly", 26),
                            ("yearly", 7), ("yearly", 2))])).alias("r"))
           .select(F.concat_ws(":", "category_id", "r.granularity", F.col("r.period").cast("string"))
                   .alias("request_id"), "category_id", "r.granularity", "r.period"))
    delta = forecasts.delta_forecast(models, reads.forecast_gaps(live_t, req), feats, TODAY)
    merged, dups = forecasts.delta_apply(live_t, delta)
    n_dups = (dups.groupBy("category_id", "granularity")
              .agg(F.count(F.lit(1)).alias("n_colliding_keys")))
    return (merged.groupBy("category_id", "granularity")
            .agg(F.count(F.lit(1)).alias("n_points"), F.max("forecast_date").alias("last_date"))
            .join(n_dups, ["category_id", "granularity"], "left")
            .fillna(0, ["n_colliding_keys"]))


@register("refresh_forecasts", f"""
WITH old AS (SELECT category_id, granularity, COUNT(*) AS n FROM ({LIVE_SQL}) GROUP BY 1, 2),
new AS (SELECT category_id, granularity, COUNT(*) AS n FROM ({steps_sql(90, 24, 5)}) GROUP BY 1, 2)
SELECT coalesce(new.category_id, old.category_id) AS category_id,
       coalesce(new.granularity, old.granularity) AS granularity,
       coalesce(new.n, old.n) AS n_live, old.n AS n_archived
FROM new FULL JOIN old ON new.category_id = old.category_id AND new.granularity = old.granularity""")
def q_refresh_forecasts(spark, sf_dir):
    """Archive the current live table, forecast the standard set from the latest
    models, and build the new live table (categories without a new forecast keep theirs)."""
    feats = brand_feats(spark, sf_dir)
    models = latest_models(spark, sf_dir, feats=feats)
    old_live = live(spark, sf_dir)   # the cache before the refresh (priority categories)
    archive = forecasts.archive_forecasts(old_live, AS_OF)
    fresh = forecasts.standard_forecasts(models, feats)
    new_live = forecasts.refreshed_live(old_live, fresh)
    return (new_live.groupBy("category_id", "granularity")
            .agg(F.count(F.lit(1)).alias("n_live"))
            .join(archive.groupBy("category_id", "granularity")
                  .agg(F.count(F.lit(1)).alias("n_archived")),
                  ["category_id", "granularity"], "full"))


@register("request_outcomes", f"""
WITH stats AS (SELECT category_id, granularity, COUNT(*) AS n FROM ({LIVE_SQL}) GROUP BY 1, 2),
g AS (SELECT j.job_id, j.category_id, j.granularity, j.period, coalesce(s.n, 0) AS n_cached,
             greatest(j.period - coalesce(s.n, 0), 0) AS n_missing
      FROM ({JOBS_SQL}) j LEFT JOIN stats s USING (category_id, granularity)),
e AS (SELECT *, CASE
        WHEN granularity NOT IN ('daily', 'monthly', 'yearly')
          THEN 'Invalid forecast_horizon. Choose ''daily'', ''monthly'', or ''yearly''.'
        WHEN NOT coalesce(period > 0, FALSE) THEN 'Period must be a positive integer.'
        WHEN n_missing > 0 AND category_id = '5-LOW' THEN 'No model for category 5-LOW'
      END AS error_message FROM g)
SELECT job_id AS request_id, category_id, granularity, period, n_cached,
       CASE WHEN error_message IS NULL THEN 'COMPLETED' ELSE 'FAILED' END AS status, error_message,
       CASE WHEN error_message IS NULL THEN n_missing ELSE 0 END AS n_forecast
FROM e""")
def q_request_outcomes(spark, sf_dir):
    """The status of every request of a batch with bad arguments, cache hits, gaps, and a
    category without a model."""
    jobs = reads.parse_requests(jobs_from_orders(read_table(spark, sf_dir, "orders")))
    live_t = live(spark, sf_dir)
    gaps = reads.forecast_gaps(live_t, jobs.withColumnRenamed("job_id", "request_id"))
    models = live_t.select("category_id").distinct().where("category_id <> '5-LOW'").withColumn(
        "status", F.lit("OK"))
    return forecasts.request_outcomes(gaps, models)
