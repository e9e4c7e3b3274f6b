"""Registered model queries: training inputs, back-test setup, fits, forecasts, metrics.

Series: FIXTURES B by brand — daily sales of ``lineitem`` x ``part`` per ``p_brand`` (25
categories, about 6.8 years: yearly + weekly seasonality, back-test on), with promotions
from FIXTURES D (category- and product-targeted, both coded by brand). The hourly
``events`` series (29 days: weekly + daily seasonality, back-test skipped) is used too.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..model import backtest, fit, stats
from ..operators import forecasts, ingest, promotions, reads
from ..session import scratch_path
from ..sources.tables import read_table, sales_lines_from_lineitem
from .q_dims import DAYS_SQL, products, promos
from .q_ingest import EV_HOURLY, events_fact
from .registry import register

AS_OF = "2002-01-01 00:00:00"   # the run time parameter of training / refresh
TODAY = "2002-01-01"            # "today" for delta forecasts with an empty cache

BRAND_FACT_SQL = """
  SELECT date_trunc('hour', l.l_shipdate) AS time, p.p_brand AS category_id,
         CAST(SUM(CAST(l.l_quantity AS INTEGER) * CAST(CAST(p.p_retailprice AS DECIMAL(20,8)) AS DECIMAL(26,12)))
              AS DECIMAL(38,12)) AS total_sales
  FROM lineitem l JOIN part p ON l.l_partkey = p.p_partkey
  WHERE CAST(l.l_quantity AS INTEGER) > 0 AND p.p_retailprice > 0
  GROUP BY 1, 2
"""
TRAIN_SQL = f"""
  SELECT category_id, time AS ds, CAST(total_sales AS DOUBLE) AS y FROM ({BRAND_FACT_SQL})
"""
STATS_SQL = f"""
  SELECT category_id, COUNT(*) AS n, min(ds) AS ds_min, max(ds) AS ds_max,
         CAST(floor((epoch(max(ds)) - epoch(min(ds))) / 86400) AS BIGINT) AS span_days
  FROM ({TRAIN_SQL}) GROUP BY 1
"""
CV_PARAMS_SQL = f"""
  SELECT *, span_days >= initial_days + horizon_days AS backtest,
         CAST(horizon_days AS VARCHAR) || ' days' AS horizon,
         CAST(initial_days AS VARCHAR) || ' days' AS initial,
         CAST(period_days AS VARCHAR) || ' days' AS period
  FROM (SELECT *, greatest(90, 3 * horizon_days) AS initial_days,
               greatest(15, CAST(floor(horizon_days / 2) AS BIGINT)) AS period_days
        FROM (SELECT *, greatest(30, CAST(floor(span_days * 0.1) AS BIGINT)) AS horizon_days
              FROM ({STATS_SQL})))
"""


def brand_train(spark, sf_dir):
    raw = sales_lines_from_lineitem(read_table(spark, sf_dir, "lineitem"),
                                    read_table(spark, sf_dir, "part"), "p_brand")
    return stats.training_frame(ingest.hourly_sales(ingest.clean_sales(raw)))


def brand_feats(spark, sf_dir):
    return promotions.promotion_features(promotions.promotion_days(
        promotions.promotion_targets(promos(spark, sf_dir), products(spark, sf_dir))))


def latest_models(spark, sf_dir, train=None, feats=None):
    """Fitted production models with their registry id (as of AS_OF)."""
    train = train if train is not None else brand_train(spark, sf_dir)
    feats = feats if feats is not None else brand_feats(spark, sf_dir)
    m = fit.fit_models(train, feats)
    version = F.date_format(F.lit(AS_OF).cast("timestamp_ntz"), "yyyyMMddHHmmss")
    return m.withColumn("model_version_id",
                        F.pmod(F.xxhash64("category_id", version), F.lit(1 << 62)))


@register("training_frame", TRAIN_SQL)
def q_training_frame(spark, sf_dir):
    return brand_train(spark, sf_dir)


@register("trainable_categories", f"""
SELECT category_id, COUNT(*) AS n_points FROM ({TRAIN_SQL}) GROUP BY 1
HAVING COUNT(*) >= 50""")
def q_trainable_categories(spark, sf_dir):
    return stats.trainable_categories(brand_train(spark, sf_dir))


@register("training_metadata", f"""
SELECT category_id, n AS training_data_points, ds_min AS data_start, ds_max AS data_end,
       '{{"training_data_points":' || CAST(n AS VARCHAR) || ',"data_start_date":"'
         || strftime(ds_min, '%Y-%m-%d %H:%M:%S') || '","data_end_date":"'
         || strftime(ds_max, '%Y-%m-%d %H:%M:%S') || '"}}' AS metadata
FROM ({STATS_SQL})""")
def q_training_metadata(spark, sf_dir):
    return stats.training_metadata(brand_train(spark, sf_dir))


@register("cv_params", CV_PARAMS_SQL)
def q_cv_params(spark, sf_dir):
    return stats.cv_params(brand_train(spark, sf_dir))


@register("cv_params_events", f"""
SELECT category_id, backtest FROM (
  SELECT category_id,
         CAST(floor((epoch(max(time)) - epoch(min(time))) / 86400) AS BIGINT) AS span_days
  FROM ({EV_HOURLY}) GROUP BY 1)
, LATERAL (SELECT greatest(30, CAST(floor(span_days * 0.1) AS BIGINT)) AS h)
, LATERAL (SELECT span_days >= greatest(90, 3 * h) + h AS backtest)""")
def q_cv_params_events(spark, sf_dir):
    """F14 negative case: the 29-day hourly series is too short to back-test."""
    return stats.cv_params(stats.training_frame(events_fact(spark, sf_dir))) \
        .select("category_id", "backtest")


@register("cv_cutoffs", f"""
SELECT category_id, CAST(i AS INTEGER) AS cutoff_index, horizon_days,
       CAST(ds_max - to_days(CAST(horizon_days + i * period_days AS INTEGER)) AS TIMESTAMP)
         AS cutoff
FROM ({CV_PARAMS_SQL}), LATERAL (SELECT unnest(generate_series(0, CAST(floor(
    ((epoch(ds_max) - horizon_days * 86400) - (epoch(ds_min) + initial_days * 86400))
    / (period_days * 86400)) AS BIGINT))) AS i)
WHERE backtest""")
def q_cv_cutoffs(spark, sf_dir):
    train = brand_train(spark, sf_dir)
    return stats.cv_cutoffs(stats.cv_params(train), train)


def steps_sql(daily: int, monthly: int, yearly: int) -> str:
    """SQL of the first so many stamps after each brand's last observation."""
    return f"""
WITH g AS (SELECT * FROM (VALUES ('daily', {daily}), ('monthly', {monthly}), ('yearly', {yearly}))
           t(granularity, periods)),
last AS (SELECT category_id, max(ds) AS ds_max FROM ({TRAIN_SQL}) GROUP BY 1),
steps AS (SELECT category_id, ds_max, granularity, unnest(generate_series(1, periods)) AS step
          FROM last, g)
SELECT category_id, granularity, CAST(step AS INTEGER) AS step,
  CAST(CASE granularity
    WHEN 'daily' THEN CAST(ds_max AS DATE) + CAST(step AS INTEGER)
    WHEN 'monthly' THEN last_day(date_trunc('month', CAST(ds_max AS DATE))
         + to_months(CAST(step - 1 + CASE WHEN last_day(CAST(ds_max AS DATE)) > CAST(ds_max AS DATE)
                                      THEN 0 ELSE 1 END AS INTEGER)))
    ELSE make_date(CAST(year(ds_max) + step - 1 + CASE WHEN make_date(year(ds_max), 12, 31)
                        > CAST(ds_max AS DATE) THEN 0 ELSE 1 END AS BIGINT), 12, 31)
  END AS TIMESTAMP) + (ds_max - CAST(CAST(ds_max AS DATE) AS TIMESTAMP)) AS ds
FROM steps"""


@register("future_dates", steps_sql(90, 24, 5))
def q_future_dates(spark, sf_dir):
    """The standard frame (90 days, 24 month ends, 5 year ends) after each
    category's last observation."""
    last = brand_train(spark, sf_dir).groupBy("category_id").agg(F.max("ds").alias("ds_max"))
    return (forecasts.future_after(forecasts.granularity_frame(last))
            .select("category_id", "granularity", "step", "ds"))


@register("future_with_promos", f"""
WITH tr AS (SELECT category_id, ds FROM ({TRAIN_SQL})),
last AS (SELECT category_id, max(ds) AS ds_max FROM tr GROUP BY 1),
fut AS (SELECT category_id, ds FROM tr
        UNION ALL
        SELECT category_id, CAST(CAST(ds_max AS DATE) + CAST(i AS INTEGER) AS TIMESTAMP)
               + (ds_max - CAST(CAST(ds_max AS DATE) AS TIMESTAMP)) AS ds
        FROM last, LATERAL (SELECT unnest(generate_series(1, 90)) AS i)),
days AS (SELECT category_id, ds AS day, list_sort(list(DISTINCT promotion_name)) AS names
         FROM ({DAYS_SQL}) GROUP BY 1, 2)
SELECT f.category_id, f.ds, array_to_string(d.names, ',') AS promo_names
FROM fut f LEFT JOIN days d ON f.category_id = d.category_id AND CAST(f.ds AS DATE) = d.day""")
def q_future_with_promos(spark, sf_dir):
    """J2 (deduplicated, Q14): history + 90 future days x promotion days, one row per
    date (the model frame includes the history, as the library's future frame does)."""
    train = brand_train(spark, sf_dir)
    last = train.groupBy("category_id").agg(F.max("ds").alias("ds_max"))
    future = forecasts.future_after(last.select(
        "category_id", "ds_max", F.lit("daily").alias("granularity"),
        F.lit(90).alias("periods"))).select("category_id", "ds")
    frame = train.select("category_id", "ds").unionByName(future)
    days = fit.promo_day_names(brand_feats(spark, sf_dir))
    return (frame.join(days, (frame["category_id"] == days["category_id"])
                       & (F.to_date(frame["ds"]) == days["day"]), "left")
            .select(frame["category_id"], "ds",
                    F.array_join("promo_names", ",").alias("promo_names")))


@register("fit_gram", f"""
WITH tr AS (SELECT * FROM ({TRAIN_SQL})),
st AS (SELECT category_id, min(ds) AS ds_min, max(ds) AS ds_max, max(abs(y)) AS ys
       FROM tr GROUP BY 1),
x AS (SELECT tr.category_id, tr.y / st.ys AS yy,
             (epoch(tr.ds) - epoch(st.ds_min)) / (epoch(st.ds_max) - epoch(st.ds_min)) AS t,
             sin(2 * pi() * (epoch(tr.ds) / 86400.0) / 365.25) AS s1
      FROM tr JOIN st USING (category_id))
SELECT category_id, COUNT(*) AS n, round(sum(yy * yy), 6) AS yty, round(sum(yy), 6) AS xty_m,
       round(sum(t * yy), 6) AS xty_k, round(sum(t), 6) AS xtx_mk,
       round(sum(t * t), 6) AS xtx_kk, round(sum(s1 * yy), 6) AS xty_sin1
FROM x GROUP BY 1""")
def q_fit_gram(spark, sf_dir):
    """M3 step 3 checked exactly: entries of the Gram summed over row blocks (the column
    order is [1, t, hinges..., yearly sin/cos...]; the first yearly sine follows the
    changepoint hinges)."""
    train = brand_train(spark, sf_dir)
    ranked = stats.ranked_rows(train)
    rows = fit.fit_rows(ranked, None)
    params = fit.fit_params(rows, ranked, brand_feats(spark, sf_dir), ranked)
    g = fit.partial_grams(ranked, params, brand_feats(spark, sf_dir))
    k = F.lit(2) + F.col("n_cp") + 2 * (F.col("yearly_order") + F.col("weekly_order")
                                        + F.col("daily_order")) + F.col("n_hol")
    s1 = F.lit(2) + F.col("n_cp")
    per = g.select("fit_id", "n", "yty", F.get("xty", F.lit(0)).alias("xty_m"),
                   F.get("xty", F.lit(1)).alias("xty_k"),
                   F.get("xtx", F.lit(1)).alias("xtx_mk"),
                   F.get("xtx", k + 1).alias("xtx_kk"),
                   F.get("xty", s1).alias("xty_sin1"))
    return (per.groupBy(F.col("fit_id").alias("category_id"))
            .agg(F.sum("n").alias("n"), *[F.round(F.sum(c), 6).alias(c) for c in
                 ("yty", "xty_m", "xty_k", "xtx_mk", "xtx_kk", "xty_sin1")]))


def fit_shape_sql(train: str, names: str) -> str:
    """SQL of everything about a fit that does not depend on its coefficients."""
    return f"""
WITH t AS (SELECT * FROM ({train})),
gap AS (SELECT category_id, min(epoch(ds) - epoch(prev)) AS dt FROM (
          SELECT category_id, ds, lag(ds) OVER (PARTITION BY category_id ORDER BY ds) AS prev
          FROM (SELECT DISTINCT category_id, ds FROM t)) GROUP BY 1),
st AS (SELECT category_id, COUNT(*) AS n, epoch(max(ds)) - epoch(min(ds)) AS span FROM t GROUP BY 1),
p AS ({names}),
o AS (SELECT st.category_id, n, least(25, CAST(floor(0.8 * n) AS BIGINT) - 1) AS n_cp,
             CASE WHEN span >= 730 * 86400 THEN 10 ELSE 0 END AS yo,
             CASE WHEN span >= 14 * 86400 AND dt < 7 * 86400 THEN 3 ELSE 0 END AS wo,
             CASE WHEN span >= 2 * 86400 AND dt < 86400 THEN 4 ELSE 0 END AS do_,
             coalesce(p.np, 0) AS np
      FROM st JOIN gap USING (category_id) LEFT JOIN p USING (category_id))
SELECT category_id, 'OK' AS status, n, CAST(2 + n_cp + 2 * (yo + wo + do_) + np AS INTEGER) AS n_coef,
       CAST(n_cp AS INTEGER) AS n_changepoints, yo AS yearly_order, wo AS weekly_order,
       do_ AS daily_order, CAST(np AS INTEGER) AS n_promotions, TRUE AS converged, TRUE AS optimal
FROM o"""


# Largest accepted violation of the optimality conditions, relative to the data term's gradient.
OPTIMAL = 1e-4


def fit_shape(m):
    return m.select("category_id", "status", "n", F.size("beta").alias("n_coef"),
                    F.size("cp_t").alias("n_changepoints"), "yearly_order", "weekly_order",
                    "daily_order", F.size("hol_names").alias("n_promotions"), "converged",
                    (F.col("residual") < OPTIMAL).alias("optimal"))


@register("fit_models", fit_shape_sql(TRAIN_SQL, f"""
SELECT category_id, COUNT(DISTINCT promotion_name) AS np FROM ({DAYS_SQL}) GROUP BY 1"""))
def q_model_fits(spark, sf_dir):
    """One fitted model per category: status, size, and that the solver converged to a
    point that meets the optimality conditions."""
    return fit_shape(fit.fit_models(brand_train(spark, sf_dir), brand_feats(spark, sf_dir)))


@register("fit_models_hourly", fit_shape_sql(f"""
SELECT category_id, time AS ds FROM ({EV_HOURLY})""", """
SELECT NULL AS category_id, 0 AS np WHERE FALSE"""))
def q_model_fits_hourly(spark, sf_dir):
    """M3 on the hourly events series (daily + weekly seasonality, no promotions)."""
    train = stats.training_frame(events_fact(spark, sf_dir))
    empty = (train.select("category_id", F.lit("none").alias("promotion_name"),
                          F.to_date("ds").alias("ds")).where(F.lit(False)))
    return fit_shape(fit.fit_models(train, empty))


CV_ROWS_SQL = f"""
  SELECT c.category_id, c.cutoff, t.ds, t.y
  FROM (SELECT category_id, horizon_days,
               CAST(ds_max - to_days(CAST(horizon_days + i * period_days AS INTEGER)) AS TIMESTAMP)
                 AS cutoff
        FROM ({CV_PARAMS_SQL}), LATERAL (SELECT unnest(generate_series(0, CAST(floor(
            ((epoch(ds_max) - horizon_days * 86400) - (epoch(ds_min) + initial_days * 86400))
            / (period_days * 86400)) AS BIGINT))) AS i) WHERE backtest) c
  JOIN ({TRAIN_SQL}) t ON t.category_id = c.category_id AND t.ds > c.cutoff
   AND epoch(t.ds) <= epoch(c.cutoff) + c.horizon_days * 86400
"""
ORDERED = "yhat_lower <= yhat AND yhat <= yhat_upper"


@register("backtest_forecasts", f"""
SELECT category_id, cutoff, ds, round(y, 6) AS y, TRUE AS bounds_hold FROM ({CV_ROWS_SQL})""")
def q_backtest_forecasts(spark, sf_dir):
    """M5: forecasts at every cutoff for every brand."""
    cv = backtest.backtest_forecasts(brand_train(spark, sf_dir), brand_feats(spark, sf_dir))
    return cv.select("category_id", "cutoff", "ds", F.round("y", 6).alias("y"),
                     F.expr(ORDERED).alias("bounds_hold"))


@register("backtest_metrics", f"""
WITH e AS (SELECT category_id, epoch(ds) - epoch(cutoff) AS h_s, COUNT(*) AS n_h
           FROM ({CV_ROWS_SQL}) GROUP BY 1, 2),
c AS (SELECT *, sum(n_h) OVER (PARTITION BY category_id ORDER BY h_s) AS C,
             sum(n_h) OVER (PARTITION BY category_id) AS N FROM e)
SELECT category_id, CAST(h_s AS DOUBLE) AS h_s,
       CAST(CAST(floor(h_s / 86400) AS BIGINT) AS VARCHAR) || ' days ' ||
         lpad(CAST(CAST(floor((h_s % 86400) / 3600) AS BIGINT) AS VARCHAR), 2, '0') || ':00:00' AS horizon,
       TRUE AS in_range
FROM c WHERE C >= least(greatest(CAST(floor(0.1 * N) AS BIGINT), 1), N)""")
def q_backtest_metrics(spark, sf_dir):
    """Rolling-horizon metrics of the back-test, per brand and horizon (the values are
    held against brute force in pytest and, on given predictions, by ``rolling_metrics``)."""
    cv = backtest.backtest_forecasts(brand_train(spark, sf_dir), brand_feats(spark, sf_dir))
    m = backtest.performance_metrics(cv)
    return m.select("category_id", F.col("h_s").cast("double").alias("h_s"), "horizon", (
        F.col("coverage").between(0, 1) & (F.col("mse") >= 0) & (F.col("smape").between(0, 2))
        & (F.abs(F.col("rmse") * F.col("rmse") - F.col("mse")) <= 1e-6 * F.col("mse")))
        .alias("in_range"))


GIVEN_CV_SQL = """
  SELECT o_orderpriority AS category_id, date_trunc('month', o_orderdate) AS cutoff,
         o_orderdate AS ds, o_totalprice AS y,
         o_totalprice * (1 + ((o_custkey % 7) - 3) / 100.0) AS yhat,
         o_totalprice * (1 + ((o_custkey % 7) - 3) / 100.0) * 0.98 AS yhat_lower,
         o_totalprice * (1 + ((o_custkey % 7) - 3) / 100.0) * 1.02 AS yhat_upper,
         o_orderkey AS okey
  FROM orders
"""


def given_cv(spark, sf_dir):
    o = read_table(spark, sf_dir, "orders")
    yhat = F.col("o_totalprice") * (1 + ((F.col("o_custkey") % 7) - 3) / 100.0)
    return o.select(F.col("o_orderpriority").alias("category_id"),
                    F.date_trunc("month", "o_orderdate").cast("timestamp_ntz").alias("cutoff"),
                    F.col("o_orderdate").alias("ds"), F.col("o_totalprice").alias("y"),
                    yhat.alias("yhat"), (yhat * 0.98).alias("yhat_lower"),
                    (yhat * 1.02).alias("yhat_upper"))


@register("rolling_metrics", f"""
WITH e AS (
  SELECT category_id, cutoff, ds, epoch(ds) - epoch(cutoff) AS h_s,
         (y - yhat) ^ 2 AS mse, abs(y - yhat) AS mae, abs((y - yhat) / y) AS mape,
         coalesce(abs(yhat - y) / ((abs(y) + abs(yhat)) / 2), 0) AS smape,
         CAST(y >= yhat_lower AND y <= yhat_upper AS DOUBLE) AS coverage, abs(y) AS absy
  FROM ({GIVEN_CV_SQL})),
pc AS (SELECT category_id, COUNT(*) AS N,
              least(greatest(CAST(floor(0.1 * COUNT(*)) AS BIGINT), 1), COUNT(*)) AS w,
              min(absy) >= 1e-8 AS pct_ok FROM e GROUP BY 1),
ph AS (SELECT category_id, h_s, COUNT(*) AS n_h, sum(mse) sum_mse, sum(mae) sum_mae,
              sum(mape) sum_mape, sum(smape) sum_smape, sum(coverage) sum_cov FROM e GROUP BY 1, 2),
cum AS (SELECT ph.*, pc.w, pc.pct_ok,
          CAST(sum(n_h) OVER (PARTITION BY category_id ORDER BY h_s) AS BIGINT) AS C,
          sum(sum_mse) OVER (PARTITION BY category_id ORDER BY h_s) AS cum_mse,
          sum(sum_mae) OVER (PARTITION BY category_id ORDER BY h_s) AS cum_mae,
          sum(sum_mape) OVER (PARTITION BY category_id ORDER BY h_s) AS cum_mape,
          sum(sum_smape) OVER (PARTITION BY category_id ORDER BY h_s) AS cum_smape,
          sum(sum_cov) OVER (PARTITION BY category_id ORDER BY h_s) AS cum_cov
        FROM ph JOIN pc USING (category_id)),
rows AS (SELECT e.*, cum.C - cum.n_h + row_number() OVER (
           PARTITION BY e.category_id, e.h_s ORDER BY e.cutoff, e.ds) - 1 AS pos
         FROM e JOIN cum USING (category_id, h_s)),
ready AS (SELECT *, CASE WHEN n_h >= w THEN NULL ELSE C - w END AS p FROM cum WHERE C >= w),
j AS (SELECT r.*, s.C AS C_i, s.n_h AS n_i, s.cum_mse cumi_mse, s.cum_mae cumi_mae, s.cum_mape cumi_mape,
             s.cum_smape cumi_smape, s.cum_cov cumi_cov, s.sum_mse sumi_mse, s.sum_mae sumi_mae,
             s.sum_mape sumi_mape, s.sum_smape sumi_smape, s.sum_cov sumi_cov
      FROM ready r LEFT JOIN rows x ON x.category_id = r.category_id AND x.pos = r.p
      LEFT JOIN cum s ON s.category_id = r.category_id AND s.h_s = x.h_s),
md AS (SELECT r.category_id, r.h_s, median(x.mape) AS mdape
       FROM ready r, LATERAL (SELECT unnest(generate_series(CAST(r.C - greatest(r.w, r.n_h) AS BIGINT),
                                                             CAST(r.C - 1 AS BIGINT))) AS pos) g
       JOIN rows x ON x.category_id = r.category_id AND x.pos = g.pos
       GROUP BY 1, 2)
SELECT category_id, h_s, horizon, round(mse, 2) AS mse, round(rmse, 6) AS rmse,
       round(mae, 6) AS mae, round(mape, 6) AS mape, round(mdape, 6) AS mdape,
       round(smape, 6) AS smape, round(coverage, 6) AS coverage FROM (
SELECT j.category_id, j.h_s,
  CAST(floor(j.h_s / 86400) AS BIGINT) || ' days ' ||
    lpad(CAST(CAST(floor((j.h_s % 86400) / 3600) AS BIGINT) AS VARCHAR), 2, '0') || ':' ||
    lpad(CAST(CAST(floor((j.h_s % 3600) / 60) AS BIGINT) AS VARCHAR), 2, '0') || ':' ||
    lpad(CAST(CAST(j.h_s % 60 AS BIGINT) AS VARCHAR), 2, '0') AS horizon,
  CASE WHEN n_h >= w THEN sum_mse / n_h ELSE (cum_mse - cumi_mse + (C_i - p) * sumi_mse / n_i) / w END AS mse,
  sqrt(CASE WHEN n_h >= w THEN sum_mse / n_h ELSE (cum_mse - cumi_mse + (C_i - p) * sumi_mse / n_i) / w END) AS rmse,
  CASE WHEN n_h >= w THEN sum_mae / n_h ELSE (cum_mae - cumi_mae + (C_i - p) * sumi_mae / n_i) / w END AS mae,
  CASE WHEN pct_ok THEN CASE WHEN n_h >= w THEN sum_mape / n_h ELSE (cum_mape - cumi_mape + (C_i - p) * sumi_mape / n_i) / w END END AS mape,
  CASE WHEN pct_ok THEN md.mdape END AS mdape,
  CASE WHEN n_h >= w THEN sum_smape / n_h ELSE (cum_smape - cumi_smape + (C_i - p) * sumi_smape / n_i) / w END AS smape,
  CASE WHEN n_h >= w THEN sum_cov / n_h ELSE (cum_cov - cumi_cov + (C_i - p) * sumi_cov / n_i) / w END AS coverage
FROM j LEFT JOIN md USING (category_id, h_s))""")
def q_rolling_metrics(spark, sf_dir):
    """A9/W3 on given predictions (so the metric arithmetic has an exact oracle); values
    rounded identically on both sides (mse to 2 decimals, the rest to 6)."""
    m = backtest.performance_metrics(given_cv(spark, sf_dir))
    return m.select("category_id", "h_s", "horizon", F.round("mse", 2).alias("mse"),
                    *[F.round(c, 6).alias(c) for c in
                      ("rmse", "mae", "mape", "mdape", "smape", "coverage")])


# Coefficients of ``predict_given`` per order priority, made from table columns.
GIVEN_PARAMS_SQL = """
  SELECT o_orderpriority AS fit_id, min(epoch(o_orderdate)) AS t0,
         max(epoch(o_orderdate)) - min(epoch(o_orderdate)) AS ts, avg(o_totalprice) AS ys,
         (COUNT(*) % 7) / 10.0 AS m, (COUNT(*) % 5) / 10.0 AS k, (COUNT(*) % 3 - 1) / 4.0 AS d,
         (COUNT(*) % 11) / 20.0 AS a, (COUNT(*) % 13) / 20.0 AS b, (COUNT(*) % 17) / 20.0 AS w
  FROM orders GROUP BY 1
"""


@register("predict_given", f"""
WITH p AS ({GIVEN_PARAMS_SQL}),
x AS (SELECT DISTINCT o_orderpriority AS fit_id, o_orderdate AS ds FROM orders),
z AS (SELECT x.fit_id, ds, (epoch(ds) - t0) / ts AS t, epoch(ds) / 86400.0 AS td, p.* EXCLUDE (fit_id),
             day(ds) = 1 AS promo FROM x JOIN p USING (fit_id))
SELECT fit_id AS category_id, ds, round(yhat, 4) AS yhat,
       round(yhat - 1.2815515655446004 * 0.1 * ys, 4) AS yhat_lower,
       round(yhat + 1.2815515655446004 * 0.1 * ys, 4) AS yhat_upper
FROM (SELECT *, ys * (m + k * t + d * greatest(t - 0.5, 0) + a * sin(2 * pi() * td / 7)
                      + b * cos(2 * pi() * td / 7) + CASE WHEN promo THEN w ELSE 0 END) AS yhat FROM z)""")
def q_predict_given(spark, sf_dir):
    """M7 arithmetic on given coefficients: one changepoint, a weekly wave, and a promotion on
    the first day of each month."""
    from ..model import predict
    o = read_table(spark, sf_dir, "orders").select(
        F.col("o_orderpriority").alias("fit_id"), F.col("o_orderdate").cast("timestamp_ntz")
        .alias("ds"), "o_totalprice")
    n = F.count(F.lit(1))
    ds = stats.epoch_s(F.col("ds"))
    params = o.groupBy("fit_id").agg(
        F.min(ds).alias("t0_s"), (F.max(ds) - F.min(ds)).alias("t_scale_s"),
        F.avg("o_totalprice").alias("y_scale"),
        F.array(n % 7 / 10, n % 5 / 10, (n % 3 - 1) / 4, n % 11 / 20, n % 13 / 20, n % 17 / 20)
        .cast("array<double>").alias("beta")).select(
        "*", F.lit("OK").alias("status"), F.array(F.lit(0.5)).alias("cp_t"),
        F.lit(0).alias("yearly_order"), F.lit(1).alias("weekly_order"), F.lit(0).alias("daily_order"),
        F.array(F.lit("first")).alias("hol_names"), F.lit(0.1).alias("sigma"),
        F.lit(0.0).alias("lambda_mean"))
    targets = o.select("fit_id", F.col("fit_id").alias("category_id"), "ds").distinct()
    feats = targets.where(F.day("ds") == 1).select(
        "category_id", F.lit("first").alias("promotion_name"), F.to_date("ds").alias("ds")).distinct()
    out = predict.predict(targets, params, feats)
    return out.select("category_id", "ds", *[F.round(c, 4).alias(c) for c in
                                             ("yhat", "yhat_lower", "yhat_upper")])


HOLD = "lower_bound <= predicted_sales AND predicted_sales <= upper_bound"
FORECAST_SQL = f"""
SELECT category_id, granularity, strftime(ds, '%Y-%m-%d') AS date, TRUE AS bounds_hold
FROM ({steps_sql(30, 12, 3)})"""


def forecast_requests(models):
    return models.select("category_id").distinct().select(
        "category_id", F.explode(F.array(*[
            F.struct(F.lit(g).alias("granularity"), F.lit(n).alias("periods"))
            for g, n in (("daily", 30), ("monthly", 12), ("yearly", 3), ("weekly", 4),
                         ("daily", 0))])).alias("r")).select("category_id", "r.granularity", "r.periods")


@register("forecast", FORECAST_SQL)
def q_forecast(spark, sf_dir):
    """M7: 30 daily, 12 monthly and 3 yearly points for every brand (requests with a bad
    granularity or no periods get none)."""
    models = latest_models(spark, sf_dir)
    return forecasts.forecast(models, forecast_requests(models), brand_feats(spark, sf_dir)).select(
        "category_id", "granularity", "date", F.expr(HOLD).alias("bounds_hold"))


@register("forecast_from_registry", FORECAST_SQL.replace("TRUE AS bounds_hold",
                                                         "TRUE AS bounds_hold, TRUE AS same"))
def q_forecast_from_registry(spark, sf_dir):
    """M7 from stored parameters: the registry rows are written and read back, and the forecast
    from them equals the one from the fitted models."""
    train, feats = brand_train(spark, sf_dir), brand_feats(spark, sf_dir)
    models = latest_models(spark, sf_dir, train, feats)
    rows = forecasts.registry_rows(models, stats.training_metadata(train), None, AS_OF)
    path = scratch_path(spark, "registry")
    rows.write.parquet(path)
    stored = forecasts.models_from_registry(reads.mark_latest(spark.read.parquet(path)).where("is_latest"))
    req = forecast_requests(models)
    keys = ["category_id", "granularity", "date"]
    fresh = forecasts.forecast(models, req, feats).select(*keys, F.col("predicted_sales").alias("_p"))
    return (forecasts.forecast(stored, req, feats).join(fresh, keys)
            .select(*keys, F.expr(HOLD).alias("bounds_hold"),
                    (F.col("_p") == F.col("predicted_sales")).alias("same")))


@register("live_forecasts", f"""
SELECT category_id, granularity, CAST(ds AS DATE) AS forecast_date, ds AS forecast_ts,
       TRUE AS bounds_hold FROM ({steps_sql(90, 24, 5)})""")
def q_live_forecasts(spark, sf_dir):
    """The standard cached set (90 daily, 24 monthly, 5 yearly) per brand."""
    feats = brand_feats(spark, sf_dir)
    models = latest_models(spark, sf_dir, feats=feats)
    live = forecasts.live_rows(forecasts.standard_forecasts(models, feats))
    return live.select("category_id", "granularity", "forecast_date", "forecast_ts",
                       F.expr(HOLD).alias("bounds_hold"))


@register("delta_forecast", f"""
SELECT category_id, granularity, CAST(ds AS DATE) AS forecast_date, TRUE AS bounds_hold
FROM ({steps_sql(120, 30, 5)}) WHERE (granularity = 'daily' AND step > 90)
   OR (granularity = 'monthly' AND step > 24) OR (granularity = 'yearly' AND step > 5)""")
def q_delta_forecast(spark, sf_dir):
    """Requests (120 daily, 30 monthly, 5 yearly points per brand) against a cache
    holding the standard set; the gaps are forecast from the day after the last cached date."""
    feats = brand_feats(spark, sf_dir)
    models = latest_models(spark, sf_dir, feats=feats)
    # the cache's dates are all that the gaps need
    live = forecasts.future_after(forecasts.granularity_frame(models.select("category_id", "ds_max"))) \
        .select("category_id", "granularity", F.to_date("ds").alias("forecast_date"))
    req = (models.select("category_id").distinct()
           .select("category_id", F.explode(F.array(*[
               F.struct(F.lit(g).alias("granularity"), F.lit(n).alias("period"))
               for g, n in (("daily", 120), ("monthly", 30), ("yearly", 5))])).alias("r"))
           .select(F.concat_ws(":", "category_id", "r.granularity").alias("request_id"),
                   "category_id", "r.granularity", "r.period"))
    gaps = reads.forecast_gaps(live, req)
    return forecasts.delta_forecast(models, gaps, feats, TODAY).select(
        "category_id", "granularity", "forecast_date", F.expr(HOLD).alias("bounds_hold"))


@register("model_registry", f"""
WITH f AS ({fit_shape_sql(TRAIN_SQL, f"SELECT category_id, COUNT(DISTINCT promotion_name) AS np FROM ({DAYS_SQL}) GROUP BY 1")})
SELECT f.category_id, '20020101000000' AS version, TIMESTAMP '{AS_OF}' AS training_date_utc,
       TRUE AS is_latest, f.n_coef, TRUE AS has_metrics,
       '{{"training_data_points":' || CAST(s.n AS VARCHAR) || ',"data_start_date":"'
         || strftime(ds_min, '%Y-%m-%d %H:%M:%S') || '","data_end_date":"'
         || strftime(ds_max, '%Y-%m-%d %H:%M:%S') || '"}}' AS metadata
FROM f JOIN ({STATS_SQL}) s USING (category_id)""")
def q_model_registry(spark, sf_dir):
    """Registry rows of a training run (one joint fit of the production and the
    back-test models: parameters, metadata, metrics)."""
    from .training import train_all
    rows = train_all(brand_train(spark, sf_dir), brand_feats(spark, sf_dir), AS_OF)["registry"]
    return rows.select("category_id", "version", "training_date_utc", "is_latest",
                       F.size("params.beta").alias("n_coef"),
                       (F.length("backtesting_metrics") > 2).alias("has_metrics"), "metadata")
