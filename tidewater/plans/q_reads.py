"""Registered reads over registry, forecast cache, archive and jobs (FIXTURES E)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import reads
from ..sources.tables import (historical_forecasts_from_orders, jobs_from_orders,
                              live_forecasts_from_orders, model_versions_from_orders,
                              performance_from_orders, read_table, requests_from_orders)
from .registry import register

VERSIONS_SQL = """
  SELECT o_orderkey AS id, o_orderpriority AS category_id,
         strftime(o_orderdate, '%Y%m%d%H%M%S') || '-' || CAST(o_orderkey AS VARCHAR) AS version,
         o_orderdate AS training_date_utc, o_custkey AS training_data_points
  FROM orders
"""
LATEST_SQL = f"""
  SELECT category_id, id AS model_version_id, version FROM (
    SELECT *, row_number() OVER (PARTITION BY category_id
                                 ORDER BY training_date_utc DESC, id DESC) AS rn
    FROM ({VERSIONS_SQL})) WHERE rn = 1
"""
LIVE_SQL = """
  SELECT category_id, granularity, forecast_date, round(avg(price), 4) AS predicted_sales,
         round(min(price), 4) AS lower_bound, round(max(price), 4) AS upper_bound,
         min(ckey) AS model_version_id
  FROM (
    SELECT o_orderpriority AS category_id, o_totalprice AS price, o_custkey AS ckey,
           'daily' AS granularity, CAST(o_orderdate AS DATE) AS forecast_date FROM orders
    UNION ALL
    SELECT o_orderpriority, o_totalprice, o_custkey, 'monthly',
           last_day(CAST(o_orderdate AS DATE)) FROM orders
    UNION ALL
    SELECT o_orderpriority, o_totalprice, o_custkey, 'yearly',
           make_date(year(o_orderdate), 12, 31) FROM orders)
  GROUP BY 1, 2, 3
"""
HIST_SQL = """
  SELECT o_custkey % 3 AS model_version_id, o_orderpriority AS category_id,
         CAST(o_orderdate AS DATE) AS forecast_date,
         round(avg(o_totalprice), 4) AS predicted_sales,
         round(min(o_totalprice), 4) AS lower_bound, round(max(o_totalprice), 4) AS upper_bound
  FROM orders GROUP BY 1, 2, 3
"""
REQUESTS_SQL = """
  SELECT category_id || ':' || granularity || ':' || CAST(period AS VARCHAR) AS request_id,
         category_id, granularity, period
  FROM (SELECT DISTINCT o_orderpriority AS category_id FROM orders) c,
       (VALUES ('daily'), ('monthly'), ('yearly')) g(granularity),
       (VALUES (5), (5000)) p(period)
"""
JOBS_SQL = """
  SELECT CAST(o_orderkey AS VARCHAR) AS job_id, o_orderpriority AS category_id,
         CASE WHEN o_orderkey % 11 = 0 THEN 'weekly' WHEN o_orderkey % 3 = 0 THEN 'daily'
              WHEN o_orderkey % 3 = 1 THEN 'monthly' ELSE 'yearly' END AS granularity,
         CASE WHEN o_custkey % 17 = 0 THEN NULL WHEN o_custkey % 13 = 0 THEN 0
              ELSE CAST(o_custkey % 30 + 1 AS INTEGER) END AS period,
         CASE o_orderstatus WHEN 'F' THEN 'FAILED' WHEN 'O' THEN 'PENDING' ELSE 'SUCCESS' END
           AS status,
         CASE WHEN o_orderstatus = 'F' THEN 'downstream error' END AS error_message,
         o_orderdate AS created_at, o_orderdate AS updated_at, o_orderkey AS seq
  FROM orders
"""


def live(spark, sf_dir):
    return live_forecasts_from_orders(read_table(spark, sf_dir, "orders"))


def versions(spark, sf_dir):
    return model_versions_from_orders(read_table(spark, sf_dir, "orders"))


@register("latest_model", LATEST_SQL)
def q_latest_model(spark, sf_dir):
    return reads.latest_model(versions(spark, sf_dir))


@register("model_categories", f"SELECT DISTINCT category_id FROM ({LATEST_SQL})")
def q_model_categories(spark, sf_dir):
    """A3: distinct categories that have a latest model."""
    return reads.latest_model(versions(spark, sf_dir)).select("category_id").distinct()


@register("missing_models", f"""
SELECT DISTINCT event_type AS category_id FROM events
WHERE event_type NOT IN (SELECT category_id FROM ({VERSIONS_SQL}))""")
def q_missing_models(spark, sf_dir):
    """Categories of the events fact with no model in the registry."""
    cats = read_table(spark, sf_dir, "events").select(F.col("event_type").alias("category_id"))
    return reads.missing_models(cats, versions(spark, sf_dir))


@register("model_versions", f"""
SELECT * FROM ({VERSIONS_SQL}) WHERE category_id = '1-URGENT'
ORDER BY training_date_utc DESC, id DESC""")
def q_model_versions(spark, sf_dir):
    return reads.model_versions(versions(spark, sf_dir), "1-URGENT")


@register("all_model_versions", f"""
SELECT v.*, (v.id = l.model_version_id) AS is_latest
FROM ({VERSIONS_SQL}) v JOIN ({LATEST_SQL}) l USING (category_id)
ORDER BY training_date_utc DESC, id DESC""")
def q_all_model_versions(spark, sf_dir):
    return reads.all_model_versions(reads.mark_latest(versions(spark, sf_dir)))


@register("model_performance", """
SELECT o_orderkey AS id, o_custkey % 50 AS model_version_id,
       o_orderdate AS evaluation_period_start,
       o_orderdate + INTERVAL 7 DAYS AS evaluation_period_end,
       CASE WHEN o_orderkey % 2 = 0 THEN 'mape' ELSE 'rmse' END AS metric_name,
       o_totalprice / 1000 AS metric_value
FROM orders WHERE o_custkey % 50 = 7""")
def q_model_performance(spark, sf_dir):
    """Metrics of version 7 (a lookup by key over the whole performance table)."""
    return reads.model_performance(performance_from_orders(read_table(spark, sf_dir, "orders")),
                                   7)


@register("cached_forecast", f"""
SELECT strftime(forecast_date, '%Y-%m-%d') AS date, predicted_sales, lower_bound, upper_bound
FROM ({LIVE_SQL}) WHERE category_id = '1-URGENT' AND granularity = 'daily'
ORDER BY forecast_date LIMIT 30""")
def q_cached_forecast(spark, sf_dir):
    return reads.cached_forecast(live(spark, sf_dir), "1-URGENT", "daily", 30)


@register("tail_forecast", f"""
SELECT l.category_id, l.granularity, r.period, l.forecast_date, l.predicted_sales,
       l.lower_bound, l.upper_bound
FROM (SELECT *, row_number() OVER (PARTITION BY category_id, granularity
                                   ORDER BY forecast_date) AS rn FROM ({LIVE_SQL})) l
JOIN (SELECT DISTINCT category_id, granularity, period FROM ({REQUESTS_SQL})) r
  USING (category_id, granularity)
WHERE l.rn <= r.period""")
def q_tail_forecast(spark, sf_dir):
    """W2/O1 in set form: first N cached points for every request."""
    req = requests_from_orders(read_table(spark, sf_dir, "orders"))
    return reads.cached_points(live(spark, sf_dir), req)


@register("last_cached", f"""
SELECT category_id, granularity, max(forecast_date) AS last_cached_date,
       COUNT(*) AS n_cached FROM ({LIVE_SQL}) GROUP BY 1, 2""")
def q_last_cached(spark, sf_dir):
    return reads.last_cached(live(spark, sf_dir))


@register("forecast_gaps", f"""
SELECT r.request_id, r.category_id, r.granularity, r.period,
       COALESCE(s.n_cached, 0) AS n_cached,
       greatest(r.period - COALESCE(s.n_cached, 0), 0) AS n_missing, s.last_cached_date
FROM ({REQUESTS_SQL}) r LEFT JOIN (
  SELECT category_id, granularity, max(forecast_date) AS last_cached_date,
         COUNT(*) AS n_cached FROM ({LIVE_SQL}) GROUP BY 1, 2) s
  USING (category_id, granularity)""")
def q_forecast_gaps(spark, sf_dir):
    req = requests_from_orders(read_table(spark, sf_dir, "orders"))
    return reads.forecast_gaps(live(spark, sf_dir), req)


@register("forecast_history", f"""
SELECT model_version_id, forecast_date, predicted_sales, lower_bound, upper_bound
FROM ({HIST_SQL}) WHERE category_id = '1-URGENT'
  AND forecast_date BETWEEN DATE '1995-01-01' AND DATE '1996-12-31'
ORDER BY model_version_id, forecast_date""")
def q_forecast_history(spark, sf_dir):
    hist = historical_forecasts_from_orders(read_table(spark, sf_dir, "orders"))
    return reads.forecast_history(hist, "1-URGENT", "1995-01-01", "1996-12-31")


@register("forecast_history_nested", f"""
SELECT category_id, model_version_id, COUNT(*) AS n_points,
       string_agg(strftime(forecast_date, '%Y-%m-%d') || '=' || printf('%.4f', predicted_sales),
                  ';' ORDER BY forecast_date, predicted_sales) AS points
FROM ({HIST_SQL}) GROUP BY 1, 2""")
def q_forecast_history_nested(spark, sf_dir):
    """Versions with their nested, date-sorted points (rendered to text to compare)."""
    hist = historical_forecasts_from_orders(read_table(spark, sf_dir, "orders"))
    nested = reads.forecast_history_nested(hist)
    return nested.select(
        "category_id", "model_version_id", F.size("forecasts").cast("long").alias("n_points"),
        F.concat_ws(";", F.transform("forecasts", lambda p: F.concat(
            F.date_format(p["forecast_date"], "yyyy-MM-dd"), F.lit("="),
            F.format_string("%.4f", p["predicted_sales"])))).alias("points"))


@register("forecast_requests", f"""
SELECT job_id, category_id, granularity, period,
       coalesce(granularity IN ('daily', 'monthly', 'yearly') AND period > 0, FALSE) AS valid
FROM ({JOBS_SQL})""")
def q_forecast_requests(spark, sf_dir):
    return reads.parse_requests(jobs_from_orders(read_table(spark, sf_dir, "orders")))


@register("recent_jobs", f"""
SELECT job_id, COALESCE(category_id, '') AS category_id, COALESCE(status, '') AS status,
       COALESCE(error_message, '') AS error_message,
       strftime(created_at, '%Y-%m-%dT%H:%M:%SZ') AS created_at,
       strftime(updated_at, '%Y-%m-%dT%H:%M:%SZ') AS updated_at
FROM ({JOBS_SQL}) ORDER BY created_at DESC, seq DESC LIMIT 20""")
def q_recent_jobs(spark, sf_dir):
    return reads.recent_jobs(jobs_from_orders(read_table(spark, sf_dir, "orders")))


@register("job_status", f"""
SELECT job_id, COALESCE(category_id, '') AS category_id, COALESCE(status, '') AS status,
       COALESCE(error_message, '') AS error_message,
       strftime(created_at, '%Y-%m-%dT%H:%M:%SZ') AS created_at,
       strftime(updated_at, '%Y-%m-%dT%H:%M:%SZ') AS updated_at
FROM ({JOBS_SQL}) WHERE job_id = '42'""")
def q_job_status(spark, sf_dir):
    return reads.job_status(jobs_from_orders(read_table(spark, sf_dir, "orders")), "42")
