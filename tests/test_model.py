"""The additive model: Gram, solve, prediction, recovery and coverage."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidewater.model import design as D
from tidewater.model import fit, predict, stats


def synthetic(spark, n_days=400, seed=7, cats=("A",), hourly=False, noise=1.0):
    """y = line with one slope change + weekly sine + promotion step + noise."""
    rng = np.random.default_rng(seed)
    freq = "h" if hourly else "D"
    periods = n_days * (24 if hourly else 1)
    ds = pd.date_range("2022-01-01", periods=periods, freq=freq)
    t = np.arange(periods) / (24 if hourly else 1)
    frames = []
    promo_days = pd.date_range("2022-03-01", periods=5, freq="D").union(
        pd.date_range("2022-09-01", periods=5, freq="D"))
    for c in cats:
        trend = 100 + 0.2 * t + np.where(t > n_days / 2, 0.3 * (t - n_days / 2), 0)
        week = 8 * np.sin(2 * np.pi * t / 7)
        promo = np.where(pd.DatetimeIndex(ds.date).isin(promo_days), 25.0, 0.0)
        y = trend + week + promo + rng.normal(0, noise, periods)
        frames.append(pd.DataFrame({"category_id": c, "ds": ds, "y": y}))
    pdf = pd.concat(frames)
    train = spark.createDataFrame(pdf).withColumn("ds", F.col("ds").cast("timestamp_ntz"))
    feats = spark.createDataFrame(pd.DataFrame(
        [{"category_id": c, "promotion_name": "promo", "ds": d.date()}
         for c in cats for d in promo_days]))
    return train, feats, pdf


def test_gram_matches_numpy(spark):
    train, feats, pdf = synthetic(spark, n_days=120)
    ranked = stats.ranked_rows(train)
    rows = fit.fit_rows(ranked, None)
    params = fit.fit_params(rows, ranked, feats, ranked).first()
    grams = fit.partial_grams(ranked, fit.fit_params(rows, ranked, feats, ranked),
                              feats).collect()
    k = D.n_features(len(params.cp_t), (params.yearly_order, params.weekly_order,
                                        params.daily_order), len(params.hol_names))
    xtx = sum(np.array(g.xtx).reshape(k, k) for g in grams)
    promo_days = set(pd.to_datetime(feats.toPandas()["ds"]).dt.date)
    ds_s = (pdf["ds"] - pd.Timestamp("1970-01-01")).dt.total_seconds().to_numpy()
    x = D.design(ds_s, params.t0_s, params.t_scale_s, np.array(params.cp_t),
                 (params.yearly_order, params.weekly_order, params.daily_order),
                 list(params.hol_names),
                 [["promo"] if d.date() in promo_days else None for d in pdf["ds"]])
    assert np.allclose(xtx, x.T @ x, rtol=1e-9, atol=1e-6)


def test_auto_seasonality_and_changepoints(spark):
    train, feats, _ = synthetic(spark, n_days=60, hourly=True)
    cfg = stats.seasonality_config(train).first()
    assert (cfg.yearly_order, cfg.weekly_order, cfg.daily_order) == (0, 3, 4)
    daily, _, _ = synthetic(spark, n_days=800)
    cfg = stats.seasonality_config(daily).first()
    assert (cfg.yearly_order, cfg.weekly_order, cfg.daily_order) == (10, 3, 0)
    # changepoints: 25 rows at rounded even positions in the first 80 %
    fits = spark.createDataFrame([("A", "A", 800)], "fit_id string, category_id string, n long")
    cps = stats.changepoints(stats.ranked_rows(daily), fits).first().cp_ds
    pos = np.linspace(0, int(800 * 0.8) - 1, 26).round().astype(int)[1:]
    expect = pd.Timestamp("2022-01-01") + pd.to_timedelta(pos, unit="D")
    assert [pd.Timestamp(c) for c in cps] == list(expect)


def test_recovery_prediction_and_coverage(spark):
    train, feats, pdf = synthetic(spark, n_days=500, noise=2.0)
    cutoff = pd.Timestamp("2023-03-01")
    tr = train.where(F.col("ds") < F.lit(cutoff).cast("timestamp_ntz"))
    held = train.where(F.col("ds") >= F.lit(cutoff).cast("timestamp_ntz"))
    m = fit.fit_models(tr, feats)
    row = m.first()
    assert row.status == "OK"
    # promotion effect (scaled) recovered within 20 %
    k = 2 + len(row.cp_t) + 2 * (row.yearly_order + row.weekly_order + row.daily_order)
    assert abs(row.beta[k] * row.y_scale - 25.0) < 5.0
    pred = predict.predict(held.withColumn("fit_id", F.col("category_id")), m, feats).toPandas()
    err = pred["y"] - pred["yhat"]
    assert np.sqrt(np.mean(err ** 2)) < 15
    cov = np.mean((pred["y"] >= pred["yhat_lower"]) & (pred["y"] <= pred["yhat_upper"]))
    assert 0.6 <= cov <= 1.0
    # in-sample 80 % band covers about 80 %
    ins = predict.predict(tr.withColumn("fit_id", F.col("category_id")), m, feats).toPandas()
    cov_in = np.mean((ins["y"] >= ins["yhat_lower"]) & (ins["y"] <= ins["yhat_upper"]))
    assert 0.72 <= cov_in <= 0.88


def test_failure_isolation_and_min_points(spark):
    train, feats, _ = synthetic(spark, n_days=100, cats=("A", "B"))
    # B gets an infinite value: its fit fails, A's does not
    bad = train.withColumn("y", F.when((F.col("category_id") == "B")
                                       & (F.dayofmonth("ds") == 5), F.lit(float("inf")))
                           .otherwise(F.col("y")))
    m = {r.category_id: r.status for r in fit.fit_models(bad, feats).collect()}
    assert m == {"A": "OK", "B": "FAILED"}
    few = train.where((F.col("category_id") == "A") & (F.dayofyear("ds") <= 49))
    ok = train.where((F.col("category_id") == "B") & (F.dayofyear("ds") <= 50))
    got = {r.category_id for r in stats.trainable_categories(few.union(ok)).collect()}
    assert got == {"B"}


def test_backtest_skipped_when_history_is_short(spark):
    """a 29-day hourly series is too short (span < initial + horizon): no cutoffs,
    no back-test rows, no metrics — and nothing fails."""
    from tidewater.model import backtest
    from tidewater.plans.q_ingest import events_fact
    from conftest import SMOKE
    train = stats.training_frame(events_fact(spark, SMOKE))
    assert stats.cv_cutoffs(stats.cv_params(train), train).count() == 0
    empty = train.select("category_id", F.lit("none").alias("promotion_name"),
                         F.to_date("ds").alias("ds")).where(F.lit(False))
    cv = backtest.backtest_forecasts(train, empty)
    assert cv.count() == 0
    assert backtest.performance_metrics(cv).count() == 0


def gram_of(seed, kind, n=200, n_cp=20):
    rng = np.random.default_rng(seed)
    ds = np.sort(rng.choice(np.arange(3 * n), n, False)) * 86400.0
    t = (ds - ds[0]) / (ds[-1] - ds[0])
    cp = t[np.round(np.arange(1, n_cp + 1) * (int(0.8 * n) - 1) / n_cp).astype(int)]
    names = ["p0", "p1"]
    lists = [[p for p in names if rng.random() < 0.05] for _ in range(n)]
    x = D.design(ds, ds[0], ds[-1] - ds[0], cp, (0, 3, 0), names, lists)
    y = {"noise": rng.normal(size=n), "flat": np.full(n, 3.0),
         "bend": 5 * t + 3 * np.maximum(t - 0.4, 0), "heavy": np.exp(3 * rng.normal(size=n)),
         "wave": 1 + np.sin(ds / 86400 * 2 * np.pi / 7) + 1e-4 * rng.normal(size=n),
         "zero": np.zeros(n)}[kind]
    y = y / max(np.abs(y).max(), 1e-300)
    return x.T @ x, x.T @ y, float(y @ y), n, *D.prior_terms(n_cp, (0, 3, 0), 2)


@pytest.mark.parametrize("kind", ["noise", "flat", "bend", "heavy", "wave", "zero"])
def test_solver_certifies_an_optimum(kind):
    """The gap is tiny, and no small move of any coefficient or of sigma lowers the objective."""
    xtx, xty, yty, n, ridge, l1 = gram_of(3, kind)
    beta, sigma, certified, residual, gap = D.map_solve(xtx, xty, yty, n, ridge, l1)
    assert certified and gap < 1e-8 and residual < 1e-6

    def value(b, s):
        rss = max(yty - 2 * b @ xty + b @ xtx @ b, 0.0)
        return (rss / (2 * s * s) + n * np.log(s) + 0.5 * np.sum(ridge * b * b)
                + np.sum(l1 * np.abs(b)) + s * s / (2 * D.SIGMA_PRIOR_SD ** 2))

    best = value(beta, sigma)
    if sigma <= 2e-6:  # the floor of a fit without residual
        return
    for step in (1e-3, -1e-3, 1e-5, -1e-5):
        for j in range(len(beta)):
            moved = beta.copy()
            moved[j] += step
            assert value(moved, sigma) >= best - 1e-9 * abs(best)
        assert value(beta, sigma * (1 + step)) >= best - 1e-9 * abs(best)


def test_solver_flags_what_it_cannot_certify():
    """One step is not enough for a heavy-tailed series: the result says so."""
    args = gram_of(3, "heavy")
    assert D.map_solve(*args)[2] and not D.map_solve(*args, max_iter=1)[2]


def test_uncertified_fit_is_not_published(monkeypatch):
    xtx, xty, yty, n, _, _ = gram_of(3, "heavy")
    row = {"fit_id": "a", "n": n, "yty": yty, "xty": xty.tolist(), "xtx": xtx.ravel().tolist(),
           "n_cp": 20, "yearly_order": 0, "weekly_order": 3, "daily_order": 0, "n_hol": 2,
           "error": None}
    good = fit._solve_fit(pd.DataFrame([row])).iloc[0]
    assert good.status == "OK" and good.converged and good.gap < 1e-8
    monkeypatch.setattr(fit, "map_solve", lambda *a: D.map_solve(*a, max_iter=1))
    bad = fit._solve_fit(pd.DataFrame([row])).iloc[0]
    assert bad.status == "FAILED" and "certified" in bad.error and bad.beta is None


def test_a_bad_block_fails_its_own_fits_only(spark):
    """25 fits, one value that is no number: one fit fails, and says where."""
    cats = tuple(f"c{i:02d}" for i in range(25))
    train, feats, _ = synthetic(spark, n_days=70, cats=cats)
    bad = (F.col("category_id") == "c07") & (F.col("ds") == F.lit("2022-02-01").cast("timestamp_ntz"))
    train = train.withColumn("y", F.when(bad, F.lit(float("nan"))).otherwise(F.col("y")))
    got = {r.fit_id: r for r in fit.fit_models(train, feats).collect()}
    assert [c for c in cats if got[c].status != "OK"] == ["c07"]
    assert "2022-02-01" in got["c07"].error and got["c07"].beta is None
    assert all(got[c].gap < 1e-8 for c in cats if c != "c07")


def plain_cutoffs(ds, horizon, initial, period):
    """The published rule, one series at a time (all in days)."""
    out, cut = [], ds.max() - horizon
    while cut >= ds.min() + initial:
        out.append(cut)
        cut = cut - period
        if not ((ds > cut) & (ds <= cut + horizon)).any() and cut > ds.min():
            cut = ds[ds <= cut].max() - horizon
    return out


def test_cutoffs_jump_over_windows_without_data(spark):
    rng = np.random.default_rng(2)
    series = {"dense": np.arange(700), "hole": np.r_[0:400, 490:700], "late": np.r_[0:500, 640:700],
              "two": np.r_[0:150, 260:420, 560:900], "short": np.arange(100)}
    for k in range(8):
        days = np.arange(1000)
        for _ in range(3):
            a = int(rng.integers(0, 900))
            days = days[(days < a) | (days > a + int(rng.integers(60, 200)))]
        series[f"r{k}"] = days
    train = spark.createDataFrame(pd.concat([pd.DataFrame(
        {"category_id": c, "ds": pd.Timestamp("2020-01-01") + pd.to_timedelta(d, unit="D"), "y": 1.0})
        for c, d in series.items()])).withColumn("ds", F.col("ds").cast("timestamp_ntz"))
    params = stats.cv_params(train)
    got = {}
    for r in stats.cv_cutoffs(params, train).orderBy("category_id", "cutoff_index").collect():
        got.setdefault(r.category_id, []).append((r.cutoff - pd.Timestamp("2020-01-01")).days)
    jumped = 0
    for p in params.collect():
        want = plain_cutoffs(series[p.category_id], p.horizon_days, p.initial_days,
                             p.period_days) if p.backtest else []
        assert got.get(p.category_id, []) == want
        jumped += any(a - b != p.period_days for a, b in zip(want, want[1:]))
    assert jumped >= 3 and "short" not in got
