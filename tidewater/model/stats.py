"""Per-series statistics the model needs before any fit.

A *fit* is one series to train: a category (the production model) or a category truncated
at a back-test cutoff. Everything here is an aggregate or a join over hours x categories;
no series is ever gathered into one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.formatting import timedelta_text
from ..schemas import MIN_TRAINING_POINTS

DAY_S = 86400.0

# Fixed values of the published model defaults: 25 changepoints in the first 80 % of the
# rows; Fourier orders yearly 10 (period 365.25 d), weekly 3 (7 d), daily 4 (1 d); a
# seasonality is on only with at least two periods of history (yearly: 730 days, weekly:
# 14 days, daily: 2 days) and, for weekly and daily, a row spacing below the period.
N_CHANGEPOINTS = 25
CHANGEPOINT_RANGE = 0.8
YEARLY_ORDER, WEEKLY_ORDER, DAILY_ORDER = 10, 3, 4
YEARLY_MIN_SPAN_D, WEEKLY_MIN_SPAN_D, DAILY_MIN_SPAN_D = 730, 14, 2


def epoch_s(ts: Column) -> Column:
    """Seconds since 1970-01-01 of a zone-less stamp (as the model's time axis)."""
    return F.unix_micros(ts.cast("timestamp")) / F.lit(1e6)


def training_frame(fact: DataFrame) -> DataFrame:
    """(category_id, ds, y) from the hourly fact; only three columns are read.
    Missing hours stay missing (Q12). A loaded fact has its totals as doubles of any size."""
    y = "total_value" if "total_value" in fact.columns else "total_sales"
    return fact.select("category_id", F.col("time").cast("timestamp_ntz").alias("ds"),
                       F.col(y).cast("double").alias("y"))


def series_stats(train: DataFrame, keys: list[str]) -> DataFrame:
    """N, first and last stamp and max |y| per fit (partial aggregation)."""
    return (train.groupBy(*keys)
            .agg(F.count(F.lit(1)).alias("n"), F.min("ds").alias("ds_min"),
                 F.max("ds").alias("ds_max"), F.max(F.abs("y")).alias("y_absmax")))


def trainable_categories(train: DataFrame, min_points: int = MIN_TRAINING_POINTS) -> DataFrame:
    """Categories with at least ``min_points`` rows (49 skipped, 50 trained)."""
    return (train.groupBy("category_id").agg(F.count(F.lit(1)).alias("n_points"))
            .where(F.col("n_points") >= min_points))


def training_metadata(train: DataFrame) -> DataFrame:
    """Count, first and last stamp per category, also as the registry's JSON text."""
    st = series_stats(train, ["category_id"])
    return st.select(
        "category_id", F.col("n").alias("training_data_points"),
        F.col("ds_min").alias("data_start"), F.col("ds_max").alias("data_end"),
        F.to_json(F.struct(
            F.col("n").alias("training_data_points"),
            F.date_format("ds_min", "yyyy-MM-dd HH:mm:ss").alias("data_start_date"),
            F.date_format("ds_max", "yyyy-MM-dd HH:mm:ss").alias("data_end_date"),
        )).alias("metadata"))


def span_days(ds_min: Column, ds_max: Column) -> Column:
    """Whole elapsed days between two stamps (floor of seconds / 86400)."""
    return F.floor((epoch_s(ds_max) - epoch_s(ds_min)) / F.lit(DAY_S)).cast("long")


def min_spacing(train: DataFrame) -> DataFrame:
    """Per category, the smallest gap (seconds) between consecutive distinct stamps — the
    row spacing the auto-seasonality rules test — without ordering a whole series:

    * within a calendar day, consecutive stamps are ordered by a window over that day only
      (at most 24 rows for an hourly fact);
    * across days, only the last stamp of a day and the first stamp of the next non-empty
      day can be neighbours, ordered by a window over the per-day table (one row per day).
    """
    d = train.select("category_id", "ds", F.to_date("ds").alias("_d")).distinct()
    w_in = Window.partitionBy("category_id", "_d").orderBy("ds")
    inside = (d.withColumn("_gap", epoch_s(F.col("ds")) - epoch_s(F.lag("ds").over(w_in)))
              .groupBy("category_id").agg(F.min("_gap").alias("_in")))
    days = d.groupBy("category_id", "_d").agg(F.min("ds").alias("_lo"), F.max("ds").alias("_hi"))
    w_day = Window.partitionBy("category_id").orderBy("_d")
    across = (days.withColumn("_gap", epoch_s(F.col("_lo")) - epoch_s(F.lag("_hi").over(w_day)))
              .groupBy("category_id").agg(F.min("_gap").alias("_across")))
    return (inside.join(across, "category_id", "full")
            .select("category_id", F.least("_in", "_across").alias("min_dt_s")))


def seasonality_config(train: DataFrame) -> DataFrame:
    """Fourier orders per category from the auto rules (span and row spacing)."""
    st = series_stats(train, ["category_id"])
    span_s = epoch_s(F.col("ds_max")) - epoch_s(F.col("ds_min"))
    dt = F.coalesce(F.col("min_dt_s"), F.lit(float("inf")))
    return (st.join(min_spacing(train), "category_id", "left")
            .select("category_id",
                    F.when(span_s >= YEARLY_MIN_SPAN_D * DAY_S, F.lit(YEARLY_ORDER))
                    .otherwise(F.lit(0)).alias("yearly_order"),
                    F.when((span_s >= WEEKLY_MIN_SPAN_D * DAY_S) & (dt < 7 * DAY_S),
                           F.lit(WEEKLY_ORDER)).otherwise(F.lit(0)).alias("weekly_order"),
                    F.when((span_s >= DAILY_MIN_SPAN_D * DAY_S) & (dt < DAY_S),
                           F.lit(DAILY_ORDER)).otherwise(F.lit(0)).alias("daily_order")))


# ---------------------------------------------------------------------- back-test setup
def cv_params(train: DataFrame) -> DataFrame:
    """Horizon, initial and period (whole days) per category, and whether the
    history is long enough to back-test (span >= initial + horizon)."""
    st = series_stats(train, ["category_id"])
    span = span_days(F.col("ds_min"), F.col("ds_max"))
    horizon = F.greatest(F.lit(30), F.floor(span * F.lit(0.1)).cast("long"))
    return (st.select("category_id", "n", "ds_min", "ds_max", span.alias("span_days"))
            .withColumn("horizon_days", horizon)
            .withColumn("initial_days", F.greatest(F.lit(90), 3 * F.col("horizon_days")))
            .withColumn("period_days", F.greatest(F.lit(15),
                                                  F.floor(F.col("horizon_days") / 2).cast("long")))
            .withColumn("backtest", F.col("span_days") >= F.col("initial_days")
                        + F.col("horizon_days"))
            .withColumn("horizon", F.concat(F.col("horizon_days").cast("string"), F.lit(" days")))
            .withColumn("initial", F.concat(F.col("initial_days").cast("string"), F.lit(" days")))
            .withColumn("period", F.concat(F.col("period_days").cast("string"), F.lit(" days"))))


def long_gaps(train: DataFrame, params: DataFrame) -> DataFrame:
    """(category_id, gaps): the stretches without data that are longer than the horizon, as
    pairs of the last stamp before and the first one after, in seconds. A horizon is at least a
    tenth of the history, so there are ten of them at most. Only the first and last stamps of
    days are ordered, not the rows of a series."""
    days = train.groupBy("category_id", F.to_date("ds").alias("_d")).agg(
        F.min(epoch_s(F.col("ds"))).alias("_lo"), F.max(epoch_s(F.col("ds"))).alias("_hi"))
    by_day = Window.partitionBy("category_id").orderBy("_d")
    pairs = days.select("category_id", F.lag("_hi").over(by_day).alias("lo"), F.col("_lo").alias("hi"))
    return (pairs.join(params.select(F.col("category_id").alias("_c"), "horizon_days"),
                       F.col("category_id") == F.col("_c"))
            .where(F.col("hi") - F.col("lo") > F.col("horizon_days") * F.lit(DAY_S))
            .groupBy("category_id").agg(F.collect_list(F.struct("lo", "hi")).alias("gaps")))


def cv_cutoffs(params: DataFrame, train: DataFrame) -> DataFrame:
    """M4: cutoffs from ``max - horizon`` down, ``period`` apart, that stay at or after
    ``min + initial``. A cutoff whose horizon window (cutoff, cutoff + horizon] holds no data is
    replaced by the last stamp at or before it minus the horizon, and the steps go on from
    there.

    Such a window lies inside a gap longer than the horizon, so the last stamp is that gap's
    start; the steps of a category run over an array of at most
    (span - initial - horizon) / period + 1 places."""
    p = params.where("backtest").select(
        "category_id", "horizon_days", "ds_min", "ds_max",
        (F.col("horizon_days") * F.lit(DAY_S)).alias("h"),
        (F.col("period_days") * F.lit(DAY_S)).alias("step"),
        (epoch_s(F.col("ds_max")) - F.col("horizon_days") * F.lit(DAY_S)).alias("first"),
        (epoch_s(F.col("ds_min")) + F.col("initial_days") * F.lit(DAY_S)).alias("least"))
    gaps = long_gaps(train, params).select(F.col("category_id").alias("_g"), "gaps")
    none = F.array().cast("array<struct<lo:double,hi:double>>")
    one = (p.join(gaps, F.col("category_id") == F.col("_g"), "left")
           .where(F.col("first") >= F.col("least"))
           .withColumn("gaps", F.coalesce(F.col("gaps").cast("array<struct<lo:double,hi:double>>"), none)))

    def onward(acc: Column, _: Column) -> Column:
        last = F.element_at(acc, -1)
        hole = F.get(F.filter("gaps", lambda g: (g["lo"] <= last - F.col("step")) & (
            g["hi"] > last - F.col("step") + F.col("h"))), F.lit(0))
        # no stamp before the first one to go back to
        back = hole["lo"].isNotNull() & (last - F.col("step") > epoch_s(F.col("ds_min")))
        new = F.when(back, hole["lo"] - F.col("h")).otherwise(last - F.col("step"))
        return F.when(last < F.col("least"), acc).otherwise(F.concat(acc, F.array(new)))

    steps = F.floor((F.col("first") - F.col("least")) / F.col("step")).cast("int") + 1
    cuts = F.filter(F.aggregate(F.sequence(F.lit(1), steps),
                                F.array(F.col("first").cast("double")), onward),
                    lambda c: c >= F.col("least"))
    return (one.select("category_id", "horizon_days", F.posexplode(cuts).alias("cutoff_index", "_c"))
            .select("category_id", "cutoff_index", "horizon_days",
                    F.timestamp_seconds("_c").cast("timestamp_ntz").alias("cutoff")))


# --------------------------------------------------------------------- changepoint stamps
def ranked_rows(train: DataFrame) -> DataFrame:
    """``train`` plus the position (0-based, by ds) of every row within its category,
    without a window over the whole series: counts per (category, month) give offsets,
    and only the rows of one month are ordered together."""
    blk = F.date_trunc("month", F.col("ds")).cast("timestamp_ntz")
    rows = train.withColumn("_blk", blk)
    counts = rows.groupBy("category_id", "_blk").agg(F.count(F.lit(1)).alias("_c"))
    w_off = (Window.partitionBy("category_id").orderBy("_blk")
             .rowsBetween(Window.unboundedPreceding, -1))
    offsets = counts.withColumn("_off", F.coalesce(F.sum("_c").over(w_off), F.lit(0)))
    w_in = Window.partitionBy("category_id", "_blk").orderBy("ds")
    return (rows.join(offsets.select("category_id", "_blk", "_off"), ["category_id", "_blk"])
            .withColumn("pos", F.col("_off") + F.row_number().over(w_in) - 1)
            .drop("_blk", "_off"))


def changepoints(ranked: DataFrame, fits: DataFrame) -> DataFrame:
    """Changepoint stamps per fit: ``n_cp = min(25, floor(0.8 n) - 1)`` rows at the rounded
    even positions ``j (h - 1) / n_cp`` (j = 1..n_cp) of the fit's first ``h = floor(0.8 n)``
    rows. ``fits`` holds (fit_id, category_id, n). Returns (fit_id, cp_ds array)."""
    h = F.floor(F.col("n") * F.lit(CHANGEPOINT_RANGE)).cast("long")
    n_cp = F.least(F.lit(N_CHANGEPOINTS).cast("long"), h - 1)
    targets = (fits.select("fit_id", "category_id", h.alias("_h"), n_cp.alias("_ncp"))
               .where(F.col("_ncp") > 0)
               .select("fit_id", "category_id", "_h", "_ncp",
                       F.explode(F.sequence(F.lit(1).cast("long"), F.col("_ncp"))).alias("_j"))
               .select("fit_id", "category_id", "_j",
                       F.round(F.col("_j") * (F.col("_h") - 1) / F.col("_ncp"))
                       .cast("long").alias("pos")))
    return (targets.join(ranked.select("category_id", "pos", "ds"), ["category_id", "pos"])
            .groupBy("fit_id")
            .agg(F.sort_array(F.collect_list(F.struct("_j", "ds"))).alias("_cps"))
            .select("fit_id", F.transform("_cps", lambda x: x["ds"]).alias("cp_ds")))


def horizon_text(seconds: Column) -> Column:
    """Horizon as the text of a pandas Timedelta."""
    return timedelta_text(seconds)
