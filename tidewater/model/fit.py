"""Fit the additive model for many series at once.

Plan (all categories and all back-test cutoffs in one job):
  1. fit rows: the fact rows of each fit (a category, or a category up to a cutoff) —
     cutoffs are a small table that Spark broadcasts when its bytes allow it;
  2. fit parameters: n, time origin and scale, y scale, changepoints, seasonal orders and
     promotion names per fit (aggregates and joins over hours x categories);
  3. partial Grams: rows and fit parameters are cogrouped on (category, block of 2000
     consecutive rows); X of every fit that uses the block is built in numpy and only
     X'X, X'y, y'y, n leave the task — each row crosses to Python once;
  4. solve: ``groupBy(fit).applyInPandas`` adds the month Grams of one fit (bounded by
     months x K^2, independent of the number of sale lines) and solves K x K.
A failing fit returns status FAILED with the error text; other fits are unaffected. A block
that cannot be turned into a Gram fails the fits that use it, and a fit whose optimum is not
certified by its duality gap fails too, so that neither is registered or forecast.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..util import materialize, ship_package
from . import stats
from .design import design, map_solve, n_features, prior_terms

GRAM_SCHEMA = T.StructType([
    T.StructField("fit_id", T.StringType()),
    T.StructField("n", T.LongType()),
    T.StructField("yty", T.DoubleType()),
    T.StructField("xty", T.ArrayType(T.DoubleType())),
    T.StructField("xtx", T.ArrayType(T.DoubleType())),
    T.StructField("n_cp", T.IntegerType()),
    T.StructField("yearly_order", T.IntegerType()),
    T.StructField("weekly_order", T.IntegerType()),
    T.StructField("daily_order", T.IntegerType()),
    T.StructField("n_hol", T.IntegerType()),
    T.StructField("error", T.StringType()),
])

SOLUTION_SCHEMA = T.StructType([
    T.StructField("fit_id", T.StringType()),
    T.StructField("status", T.StringType()),
    T.StructField("error", T.StringType()),
    T.StructField("sigma", T.DoubleType()),
    T.StructField("beta", T.ArrayType(T.DoubleType())),
    T.StructField("lambda_mean", T.DoubleType()),
    T.StructField("converged", T.BooleanType()),
    T.StructField("residual", T.DoubleType()),
    T.StructField("gap", T.DoubleType()),
])


# ------------------------------------------------------------------------- fit rows
def fit_rows(train: DataFrame, cutoffs: DataFrame | None,
             include_full: bool = True) -> DataFrame:
    """(fit_id, category_id, cutoff, ds, y[, pos]): every category's full history, plus for
    each back-test cutoff the rows at or before it. Cutoffs are a small table (bounded by
    categories x cutoffs); Spark broadcasts it when its bytes are under the threshold."""
    extra = ["pos"] if "pos" in train.columns else []
    full = train.select(F.col("category_id").alias("fit_id"), "category_id",
                        F.lit(None).cast("timestamp_ntz").alias("cutoff"), "ds", "y", *extra)
    if cutoffs is None:
        return full
    cuts = cutoffs.select("category_id", "cutoff")
    cv = (train.join(cuts, "category_id")
          .where(F.col("ds") <= F.col("cutoff"))
          .select(cv_fit_id().alias("fit_id"), "category_id", "cutoff", "ds", "y", *extra))
    return full.unionByName(cv) if include_full else cv


def cv_fit_id():
    return F.concat_ws("@", F.col("category_id"),
                       F.date_format("cutoff", "yyyy-MM-dd'T'HH:mm:ss"))


def promo_day_names(promo_feats: DataFrame) -> DataFrame:
    """(category_id, day, names): promotion names active on each calendar day."""
    return (promo_feats.groupBy("category_id", F.col("ds").alias("day"))
            .agg(F.sort_array(F.collect_set("promotion_name")).alias("promo_names")))


def fit_params(rows: DataFrame, train: DataFrame, promo_feats: DataFrame,
               ranked: DataFrame | None = None) -> DataFrame:
    """Per fit: n, origin/scale of t, y scale, changepoints (scaled), orders, names."""
    st = (rows.groupBy("fit_id", "category_id", "cutoff")
          .agg(F.count(F.lit(1)).alias("n"), F.min("ds").alias("ds_min"),
               F.max("ds").alias("ds_max"), F.max(F.abs("y")).alias("y_absmax")))
    ranked = ranked if ranked is not None else stats.ranked_rows(train)
    cps = stats.changepoints(ranked, st.select("fit_id", "category_id", "n"))
    cfg = stats.seasonality_config(train)
    names = (promo_feats.groupBy("category_id")
             .agg(F.sort_array(F.collect_set("promotion_name")).alias("hol_names")))
    t0 = stats.epoch_s(F.col("ds_min"))
    t1 = stats.epoch_s(F.col("ds_max"))
    return (st.join(cps, "fit_id", "left").join(cfg, "category_id", "left")
            .join(names, "category_id", "left")
            .select("fit_id", "category_id", "cutoff", "n", "ds_min", "ds_max",
                    t0.alias("t0_s"),
                    F.when(t1 > t0, t1 - t0).otherwise(F.lit(1.0)).alias("t_scale_s"),
                    F.when(F.col("y_absmax") > 0, F.col("y_absmax")).otherwise(F.lit(1.0))
                    .alias("y_scale"),
                    F.transform(F.coalesce("cp_ds", F.array().cast("array<timestamp_ntz>")),
                                lambda c: (stats.epoch_s(c) - t0)
                                / F.when(t1 > t0, t1 - t0).otherwise(F.lit(1.0)))
                    .alias("cp_t"),
                    F.coalesce("yearly_order", F.lit(0)).alias("yearly_order"),
                    F.coalesce("weekly_order", F.lit(0)).alias("weekly_order"),
                    F.coalesce("daily_order", F.lit(0)).alias("daily_order"),
                    F.coalesce("hol_names", F.array().cast("array<string>")).alias("hol_names")))


# --------------------------------------------------------------------- pandas steps
def _gram_blocks(rows: pd.DataFrame, fits: pd.DataFrame) -> pd.DataFrame:
    """One block of one category's rows, and every fit of that category that uses it
    (the full history and each back-test cutoff): X'X, X'y, y'y, n per fit."""
    out = []
    if rows.empty or fits.empty:
        return pd.DataFrame(columns=[f.name for f in GRAM_SCHEMA.fields])
    for f in fits.itertuples(index=False):
        try:
            got = _gram(rows, f)
        except Exception as e:  # noqa: BLE001 — a block that cannot be used fails its fits alone
            got = {"fit_id": f.fit_id, "n": 0, "yty": 0.0, "xty": [], "xtx": [], "n_cp": 0,
                   "yearly_order": 0, "weekly_order": 0, "daily_order": 0, "n_hol": 0,
                   "error": f"{type(e).__name__}: {e}"}
        if got:
            out.append(got)
    return pd.DataFrame(out, columns=[f.name for f in GRAM_SCHEMA.fields])


def _gram(rows: pd.DataFrame, f) -> dict | None:
    """X'X, X'y, y'y, n of one fit over one block; rows with a value that is not finite are an
    error, which names the first of them."""
    ds = rows["ds_s"].to_numpy(float)
    mask = np.ones(len(ds), bool) if pd.isna(f.cutoff_s) else ds <= f.cutoff_s
    if not mask.any():
        return None
    y = rows["y"].to_numpy(float)[mask]
    if not np.isfinite(y).all():
        at = ds[mask][~np.isfinite(y)].min()
        raise ValueError(f"value at {pd.Timestamp(at, unit='s')} is not finite")
    orders = (int(f.yearly_order), int(f.weekly_order), int(f.daily_order))
    cp_t = np.asarray(f.cp_t if f.cp_t is not None else [], dtype=float)
    names = list(f.hol_names) if f.hol_names is not None else []
    x = design(ds[mask], float(f.t0_s), float(f.t_scale_s), cp_t, orders, names,
               [n for n, m in zip(rows["promo_names"].tolist(), mask) if m])
    y = y / float(f.y_scale)
    return {"fit_id": f.fit_id, "n": int(mask.sum()), "yty": float(y @ y),
            "xty": (x.T @ y).tolist(), "xtx": (x.T @ x).ravel().tolist(),
            "n_cp": len(cp_t), "yearly_order": orders[0], "weekly_order": orders[1],
            "daily_order": orders[2], "n_hol": len(names), "error": None}


def _solve_fit(pdf: pd.DataFrame) -> pd.DataFrame:
    fit_id = pdf["fit_id"].iloc[0]
    try:
        failed = pdf["error"].dropna()
        if len(failed):
            raise RuntimeError(min(failed))
        first = pdf.iloc[0]
        n_cp = int(first["n_cp"])
        orders = (int(first["yearly_order"]), int(first["weekly_order"]),
                  int(first["daily_order"]))
        n_hol = int(first["n_hol"])
        k = n_features(n_cp, orders, n_hol)
        xtx = np.zeros((k, k))
        xty = np.zeros(k)
        for a, b in zip(pdf["xtx"], pdf["xty"]):
            xtx += np.asarray(a, dtype=float).reshape(k, k)
            xty += np.asarray(b, dtype=float)
        yty = float(pdf["yty"].sum())
        n = float(pdf["n"].sum())
        ridge, l1 = prior_terms(n_cp, orders, n_hol)
        beta, sigma, converged, residual, gap = map_solve(xtx, xty, yty, n, ridge, l1)
        if not np.all(np.isfinite(beta)) or not np.isfinite(sigma):
            raise FloatingPointError("non-finite solution")
        if not converged:  # never published: see ``status``
            raise ArithmeticError(f"no certified optimum, relative duality gap {gap:.1e}")
        lam = float(np.mean(np.abs(beta[2:2 + n_cp]))) + 1e-8 if n_cp else 1e-8
        return pd.DataFrame({"fit_id": [fit_id], "status": ["OK"], "error": [None],
                             "sigma": [sigma], "beta": [beta.tolist()], "lambda_mean": [lam],
                             "converged": [converged], "residual": [residual], "gap": [gap]})
    except Exception as e:  # noqa: BLE001 — failure isolation per fit (M13)
        return pd.DataFrame({"fit_id": [fit_id], "status": ["FAILED"],
                             "error": [f"{type(e).__name__}: {e}"],
                             "sigma": [None], "beta": [None], "lambda_mean": [None],
                             "converged": [None], "residual": [None], "gap": [None]})


# ------------------------------------------------------------------------ public API
BLOCK_ROWS = 2000


def partial_grams(ranked: DataFrame, params: DataFrame, promo_feats: DataFrame) -> DataFrame:
    """Step 3: X'X, X'y, y'y, n per (fit, block of BLOCK_ROWS consecutive rows).

    ``ranked`` is the fact with row positions (each row once). Rows and fit parameters are
    cogrouped on (category, block): every row crosses to Python once, and the function
    builds the Grams of all fits of the category that use the block (a back-test fit uses
    the rows up to its cutoff). Memory per task: one block x K, whatever the series length.
    """
    spark = ranked.sparkSession
    ship_package(spark)
    days = promo_day_names(promo_feats).withColumnRenamed("category_id", "_dcat")
    blk = F.floor(F.col("pos") / BLOCK_ROWS).cast("long")
    rows = (ranked.withColumn("_blk", blk).withColumn("_day", F.to_date("ds"))
            .join(days, (F.col("category_id") == F.col("_dcat"))
                  & (F.col("_day") == F.col("day")), "left")
            .select(F.col("category_id").alias("category_id"), F.col("_blk").alias("_blk"),
                    stats.epoch_s(F.col("ds")).alias("ds_s"), "y", "promo_names"))
    blocks = (ranked.withColumn("_blk", blk).groupBy("category_id", "_blk")
              .agg(F.min("ds").alias("_first")))
    fits = (params.select(
                "fit_id", "category_id", "cutoff", "t0_s", "t_scale_s", "y_scale", "cp_t",
                "yearly_order", "weekly_order", "daily_order", "hol_names")
            .join(blocks, "category_id")
            .where(F.col("cutoff").isNull() | (F.col("_first") <= F.col("cutoff")))
            # fresh column ids: both cogroup sides descend from the same fact
            .select(F.col("category_id").alias("category_id"), F.col("_blk").alias("_blk"),
                    "fit_id", stats.epoch_s(F.col("cutoff")).alias("cutoff_s"), "t0_s",
                    "t_scale_s",
                    "y_scale", "cp_t", "yearly_order", "weekly_order", "daily_order",
                    "hol_names"))
    return (rows.groupBy("category_id", "_blk")
            .cogroup(fits.groupBy("category_id", "_blk"))
            .applyInPandas(_gram_blocks, GRAM_SCHEMA))


def solve(grams: DataFrame) -> DataFrame:
    """Step 4: one MAP solve per fit from its month Grams."""
    ship_package(grams.sparkSession)
    return grams.groupBy("fit_id").applyInPandas(_solve_fit, SOLUTION_SCHEMA)


def fit_models(train: DataFrame, promo_feats: DataFrame,
               cutoffs: DataFrame | None = None, include_full: bool = True) -> DataFrame:
    """M3 (+M5 fits): parameters of every fit, one row per fit.

    Columns: fit_id, category_id, cutoff, n, ds_min, ds_max, t0_s, t_scale_s, y_scale, cp_t,
    yearly/weekly/daily_order, hol_names, status, error, sigma, beta, lambda_mean,
    converged (the optimum is certified; always true for status OK), residual (optimality
    violation) and gap (duality gap relative to the objective).
    """
    promo_feats = materialize(promo_feats.select("category_id", "promotion_name", "ds"))
    ranked = materialize(stats.ranked_rows(train.select("category_id", "ds", "y")))
    rows = fit_rows(ranked, cutoffs, include_full)
    params = materialize(fit_params(rows, ranked, promo_feats, ranked))
    sol = solve(partial_grams(ranked, params, promo_feats))
    return materialize(params.join(sol, "fit_id", "left").withColumn(
        "status", F.coalesce("status", F.lit("FAILED"))))
