"""Rolling-horizon back-test metrics against a brute-force implementation."""

import numpy as np
import pandas as pd
import pytest

from tidewater.model import backtest


def brute_force(df, rolling_window=0.1):
    """Direct reading of the published rules, one horizon at a time."""
    out = []
    for cat, g in df.groupby("category_id"):
        g = g.assign(h=(g["ds"] - g["cutoff"]).dt.total_seconds())
        g = g.sort_values(["h", "cutoff", "ds"], kind="mergesort").reset_index(drop=True)
        n = len(g)
        w = min(max(int(rolling_window * n), 1), n)
        err = g["y"] - g["yhat"]
        terms = {
            "mse": err ** 2, "mae": err.abs(), "mape": (err / g["y"]).abs(),
            "smape": ((g["yhat"] - g["y"]).abs() / ((g["y"].abs() + g["yhat"].abs()) / 2)).fillna(0),
            "coverage": ((g["y"] >= g["yhat_lower"]) & (g["y"] <= g["yhat_upper"])).astype(float),
        }
        hs = g["h"].unique()
        for h in hs:
            idx = np.where(g["h"] == h)[0]
            end = idx[-1]
            if end + 1 < w:
                continue
            rec = {"category_id": cat, "h_s": h}
            if len(idx) >= w:
                for m, s in terms.items():
                    rec[m] = s.iloc[idx].mean()
                med = g.index[idx]
            else:
                start = end + 1 - w
                hstart = g["h"].iloc[start]
                grp = np.where(g["h"] == hstart)[0]
                n_part = grp[-1] - start + 1
                for m, s in terms.items():
                    full = s.iloc[grp[-1] + 1:end + 1].sum()
                    rec[m] = (full + n_part * s.iloc[grp].mean()) / w
                med = g.index[start:end + 1]
            rec["rmse"] = np.sqrt(rec["mse"])
            rec["mdape"] = float(np.median(terms["mape"].iloc[med]))
            out.append(rec)
    return pd.DataFrame(out)


@pytest.mark.parametrize("seed", [1, 2])
def test_rolling_metrics_match_brute_force(spark, seed):
    rng = np.random.default_rng(seed)
    rows = []
    for cat in ("A", "B"):
        for c in range(6):
            cutoff = pd.Timestamp("2024-01-01") + pd.Timedelta(days=7 * c)
            for h in range(1, rng.integers(5, 15)):
                ds = cutoff + pd.Timedelta(hours=int(rng.integers(1, 48)))
                y = float(rng.normal(100, 10))
                yh = y + float(rng.normal(0, 5))
                rows.append((cat, cutoff, ds, y, yh, yh - 6, yh + 6))
    pdf = pd.DataFrame(rows, columns=["category_id", "cutoff", "ds", "y", "yhat",
                                      "yhat_lower", "yhat_upper"])
    # unique stamps per (cutoff, horizon) to keep the tie order unambiguous
    pdf = pdf.drop_duplicates(["category_id", "cutoff", "ds"])
    cv = spark.createDataFrame(pdf).selectExpr(
        "category_id", "CAST(cutoff AS timestamp_ntz) cutoff", "CAST(ds AS timestamp_ntz) ds",
        "y", "yhat", "yhat_lower", "yhat_upper")
    got = backtest.performance_metrics(cv).toPandas().sort_values(["category_id", "h_s"])
    exp = brute_force(pdf).sort_values(["category_id", "h_s"])
    assert len(got) == len(exp)
    for m in ["mse", "rmse", "mae", "mape", "mdape", "smape", "coverage"]:
        assert np.allclose(got[m].to_numpy(float), exp[m].to_numpy(float), rtol=1e-9), m


def test_horizon_text(spark):
    df = spark.createDataFrame([(86400 * 3 + 3600 * 5 + 61,), (86400 * 30,)], "s long")
    from tidewater.functions.formatting import timedelta_text
    got = [r[0] for r in df.select(timedelta_text(df["s"])).collect()]
    assert got == [str(pd.Timedelta(seconds=86400 * 3 + 3600 * 5 + 61)),
                   str(pd.Timedelta(days=30))]


@pytest.mark.parametrize("bucket_rows", [1, 7, 64, 10_000])
def test_window_medians_match_numpy(spark, bucket_rows):
    """Windows of any length and place, ties among the values, several categories; a bucket
    holds no more rows than asked for."""
    rng = np.random.default_rng(bucket_rows)
    rows, windows, expect = [], [], {}
    for cat, n in (("a", 150), ("b", 1), ("c", 37)):
        v = rng.integers(0, 12, n).astype(float)
        rows += [(cat, i, float(x)) for i, x in enumerate(v)]
        for h in range(15):
            a = int(rng.integers(0, n))
            b = int(rng.integers(a + 1, n + 1))
            windows.append((cat, float(h), a, b))
            expect[cat, float(h)] = float(np.median(v[a:b]))
    got = backtest.window_medians(
        spark.createDataFrame(rows, "category_id string, pos long, v double").repartition(5),
        spark.createDataFrame(windows, "category_id string, h_s double, a long, b long"),
        bucket_rows).collect()
    assert {(r.category_id, r.h_s): r.median for r in got} == expect


def test_rows_are_numbered_without_a_window_over_a_key(spark):
    from tidewater.util import number_rows
    df = spark.range(5000).selectExpr("IF(id % 3 = 0, 'x', 'hot') k", "id * 7919 % 5000 v")
    got = number_rows(df, ["k"], ["v"], "at")
    assert got.count() == 5000
    for k in ("x", "hot"):
        rows = sorted((r.v, r["at"]) for r in got.where(f"k = '{k}'").collect())
        assert [a for _, a in rows] == list(range(len(rows)))
