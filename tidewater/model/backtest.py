"""Back-test: forecasts at every cutoff and rolling-horizon metrics.

Metrics follow the published library's rules: rows sorted by horizon (ds - cutoff), a
window of w = max(1, floor(0.1 N)) rows; for every horizon the mean over the window that
ends with its last row, where the oldest horizon in the window counts pro rata; the median
(mdape) over all rows of the horizon plus the trailing rows before it. mape and mdape are
left out when some |y| < 1e-8.

Means in set form: per-horizon sums and a cumulative window over horizons (bounded by the
number of distinct horizons, not rows); the start of each window is found by an
equi-join on row position instead of a range lookup. The rolling median selects by rank: the
rows of a category are numbered by horizon and again by value, cut into buckets of a fixed
number of neighbouring values, each bucket counts its rows inside every window, the sums over
the buckets say which one holds a window's middle rows, and that bucket finds them. No task
holds more than one bucket and the windows of its category.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..util import materialize, number_rows, ship_package
from . import fit, predict, stats

METRICS = ["mse", "rmse", "mae", "mape", "mdape", "smape", "coverage"]
ROLLING_WINDOW = 0.1
BUCKET_ROWS = 20_000  # values of a category that one task holds


def backtest_targets(train: DataFrame, cutoffs: DataFrame) -> DataFrame:
    """Rows scored at each cutoff: cutoff < ds <= cutoff + horizon."""
    cuts = cutoffs.select("category_id", "cutoff", "horizon_days")
    return (train.join(cuts, "category_id")
            .where((F.col("ds") > F.col("cutoff"))
                   & (stats.epoch_s(F.col("ds")) <= stats.epoch_s(F.col("cutoff"))
                      + F.col("horizon_days") * F.lit(stats.DAY_S)))
            .select(fit.cv_fit_id().alias("fit_id"), "category_id", "cutoff", "ds", "y"))


def backtest_forecasts(train: DataFrame, promo_feats: DataFrame,
                       params: DataFrame | None = None) -> DataFrame:
    """M5: (category_id, cutoff, ds, y, yhat, yhat_lower, yhat_upper) for every cutoff.

    ``params`` may hold already-fitted cutoff models (from a joint training run)."""
    train = materialize(train.select("category_id", "ds", "y"))
    cutoffs = materialize(stats.cv_cutoffs(stats.cv_params(train), train))
    if params is None:
        params = fit.fit_models(train, promo_feats, cutoffs, include_full=False)
    targets = backtest_targets(train, cutoffs)
    return (predict.predict(targets, params, promo_feats)
            .select("category_id", "cutoff", "ds", "y", "yhat", "yhat_lower", "yhat_upper"))


def error_rows(cv: DataFrame) -> DataFrame:
    """Per scored row: horizon in seconds and each error term."""
    y, yh = F.col("y"), F.col("yhat")
    sape = F.try_divide(F.abs(yh - y), (F.abs(y) + F.abs(yh)) / 2)
    return cv.select(
        "category_id", "cutoff", "ds",
        (stats.epoch_s(F.col("ds")) - stats.epoch_s(F.col("cutoff"))).alias("h_s"),
        ((y - yh) ** 2).alias("mse"),
        F.abs(y - yh).alias("mae"),
        F.abs(F.try_divide(y - yh, y)).alias("mape"),
        F.when(F.isnan(sape) | sape.isNull(), F.lit(0.0)).otherwise(sape).alias("smape"),
        ((y >= F.col("yhat_lower")) & (y <= F.col("yhat_upper"))).cast("double")
        .alias("coverage"),
        F.abs(y).alias("_absy"))


def performance_metrics(cv: DataFrame, rolling_window: float = ROLLING_WINDOW,
                        bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Rolling metrics per (category, horizon).

    Output: category_id, horizon_s, horizon (text), mse, rmse, mae, mape, mdape, smape,
    coverage.
    """
    ship_package(cv.sparkSession)
    # rows of one stamp keep the order of the input
    e = materialize(error_rows(cv).withColumn("_at", F.monotonically_increasing_id()))
    means = ["mse", "mae", "mape", "smape", "coverage"]
    per_cat = (e.groupBy("category_id")
               .agg(F.count(F.lit(1)).alias("N"), F.min("_absy").alias("_miny"))
               .select("category_id", "N",
                       F.least(F.greatest(F.floor(F.lit(rolling_window) * F.col("N")),
                                          F.lit(1)), F.col("N")).cast("long").alias("w"),
                       (F.col("_miny") >= F.lit(1e-8)).alias("_pct_ok")))
    per_h = (e.groupBy("category_id", "h_s")
             .agg(F.count(F.lit(1)).alias("n_h"), *[F.sum(m).alias(f"sum_{m}") for m in means]))
    w_cum = Window.partitionBy("category_id").orderBy("h_s").rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    cum = (per_h.select("*", F.sum("n_h").over(w_cum).alias("C"),
                        *[F.sum(f"sum_{m}").over(w_cum).alias(f"cum_{m}") for m in means])
           .join(per_cat, "category_id"))

    # Row positions in horizon order (ties by cutoff): the window of horizon k starts at
    # position C_k - w; the horizon holding that position is found by an equi-join.
    rows = materialize(number_rows(e.select("category_id", "h_s", "cutoff", "ds", "_at", "mape"),
                                   ["category_id"], ["h_s", "cutoff", "ds", "_at"], "pos"))
    start_h = rows.select("category_id", F.col("pos").alias("p"),
                          F.col("h_s").alias("h_start"))
    starts = cum.select("category_id", F.col("h_s").alias("h_start"),
                        F.col("C").alias("C_i"), F.col("n_h").alias("n_i"),
                        *[F.col(f"cum_{m}").alias(f"cumi_{m}") for m in means],
                        *[F.col(f"sum_{m}").alias(f"sumi_{m}") for m in means])
    ready = cum.where(F.col("C") >= F.col("w")).withColumn(
        "p", F.when(F.col("n_h") >= F.col("w"), F.lit(None).cast("long"))
        .otherwise(F.col("C") - F.col("w")))
    j = (ready.join(start_h, ["category_id", "p"], "left")
         .join(starts, ["category_id", "h_start"], "left"))
    cols = {}
    for m in means:
        partial = ((F.col(f"cum_{m}") - F.col(f"cumi_{m}")
                    + (F.col("C_i") - F.col("p")) * F.col(f"sumi_{m}") / F.col("n_i"))
                   / F.col("w"))
        cols[m] = F.when(F.col("n_h") >= F.col("w"), F.col(f"sum_{m}") / F.col("n_h")) \
            .otherwise(partial)
    rolled = j.select("category_id", "h_s", "_pct_ok", *[cols[m].alias(m) for m in means])

    # mdape: median over positions [C_k - max(w, n_k), C_k - 1].
    windows = ready.select("category_id", "h_s", F.col("C").alias("b"),
                           (F.col("C") - F.greatest("w", "n_h")).alias("a"))
    mdape = window_medians(rows.select("category_id", "pos", F.col("mape").alias("v")), windows,
                           bucket_rows).withColumnRenamed("median", "mdape")
    out = rolled.join(mdape, ["category_id", "h_s"], "left")
    return out.select(
        "category_id", "h_s", stats.horizon_text(F.col("h_s")).alias("horizon"),
        "mse", F.sqrt("mse").alias("rmse"), "mae",
        F.when(F.col("_pct_ok"), F.col("mape")).alias("mape"),
        F.when(F.col("_pct_ok"), F.col("mdape")).alias("mdape"),
        "smape", "coverage")


def window_medians(rows: DataFrame, windows: DataFrame, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Median of ``v`` over the positions a <= pos < b of every window: (category_id, h_s, median).

    ``rows`` holds (category_id, pos, v), ``windows`` (category_id, h_s, a, b). Counts go up as
    (window, bucket) rows, windows times values / ``bucket_rows``; each bucket's rows cross to
    Python twice."""
    # fresh column ids on both sides: rows and windows may descend from one table
    ranked = materialize(number_rows(rows, ["category_id"], ["v", "pos"], "rank").select(
        F.col("category_id").alias("category_id"), F.expr(f"rank div {bucket_rows}").alias("bucket"), "pos", "rank", "v"))
    windows = materialize(windows.select(*[F.col(c).alias(c) for c in windows.columns]))
    last = ranked.groupBy("category_id").agg(F.max("bucket").alias("last"))
    spread = windows.join(last, "category_id").select(
        "category_id", "h_s", "a", "b", F.explode(F.sequence(F.lit(0).cast("long"), "last"))
        .alias("bucket"))
    keys = ["category_id", "bucket"]
    counted = (ranked.select(*keys, "pos").groupBy(*keys).cogroup(spread.groupBy(*keys))
               .applyInArrow(_count_inside, "category_id string, bucket long, h_s double, "
                                            "a long, b long, n long"))
    own = Window.partitionBy("category_id", "h_s").orderBy("bucket")
    m = F.col("b") - F.col("a")
    middle = (counted.withColumn("before", F.sum("n").over(own) - F.col("n"))
              .withColumn("k", F.explode(F.array(F.floor((m - 1) / 2), F.floor(m / 2))))
              .where((F.col("before") <= F.col("k")) & (F.col("k") < F.col("before") + F.col("n")))
              .select(*keys, "h_s", "a", "b", (F.col("k") - F.col("before")).alias("k")))
    picked = (ranked.groupBy(*keys).cogroup(materialize(middle).groupBy(*keys))
              .applyInArrow(_pick_inside, "category_id string, h_s double, v double"))
    return picked.groupBy("category_id", "h_s").agg((F.sum("v") / 2).alias("median"))


def _count_inside(rows, windows):
    """Rows of one bucket inside each window."""
    import numpy as np
    import pyarrow as pa
    pos = np.sort(rows.column("pos").to_numpy())
    a, b = windows.column("a").to_numpy(), windows.column("b").to_numpy()
    n = np.searchsorted(pos, b) - np.searchsorted(pos, a)
    return pa.table({c: windows.column(c) for c in ("category_id", "bucket")}
                    | {"h_s": windows.column("h_s").cast(pa.float64()), "a": a, "b": b, "n": n})


def _pick_inside(rows, windows):
    """The k-th smallest of one bucket's values inside each window, for all windows at once:
    from the whole bucket down, the rows of the lower half inside the window say which half
    holds it."""
    import numpy as np
    import pyarrow as pa
    order = np.argsort(rows.column("rank").to_numpy())
    pos, v = rows.column("pos").to_numpy()[order], rows.column("v").to_numpy()[order]
    a, b, k = (windows.column(c).to_numpy() for c in ("a", "b", "k"))
    k, low, place = k.copy(), np.zeros(len(k), np.int64), np.arange(len(pos))
    span = int(pos.max(initial=0)) + 2
    for level in range(max(len(pos) - 1, 0).bit_length() - 1, -1, -1):
        half = 1 << level
        # positions in order inside each stretch of ``half`` values
        sorted_ = np.sort((place >> level) * span + pos)
        base = (low >> level) * span
        n = np.searchsorted(sorted_, base + np.minimum(b, span - 1)) - np.searchsorted(
            sorted_, base + np.minimum(a, span - 1))
        up = k >= n
        k[up] -= n[up]
        low[up] += half
    return pa.table({"category_id": windows.column("category_id"),
                     "h_s": windows.column("h_s"), "v": v[low] if len(v) else np.zeros(len(k))})


def metrics_json(metrics: DataFrame) -> DataFrame:
    """The metrics of each category as one JSON array (registry column)."""
    rec = F.struct("horizon", *METRICS)
    return (metrics.groupBy("category_id")
            .agg(F.sort_array(F.collect_list(F.struct("h_s", rec.alias("r")))).alias("_m"))
            .select("category_id",
                    F.to_json(F.transform("_m", lambda x: x["r"])).alias("backtesting_metrics")))
