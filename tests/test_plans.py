"""End to end on the smallest driver tables: train + back-test + register, refresh the
cache twice (archive grows, live swapped), answer a request batch with gaps (E2, E3)."""

from pyspark.sql import functions as F

from conftest import SMOKE
from tidewater import store
from tidewater.operators import forecasts
from tidewater.plans import q_model, requests, training


def test_train_refresh_and_requests(spark, tmpdir_path):
    train = q_model.brand_train(spark, SMOKE)
    feats = q_model.brand_feats(spark, SMOKE)
    out = training.train_all(train, feats, "2002-01-01 00:00:00")
    models = out["models"]
    assert models.where("status = 'OK'").count() == train.select("category_id").distinct().count()
    reg_path = f"{tmpdir_path}/registry"
    training.register_versions(spark, out["registry"], reg_path)
    reg = training.latest_versions(spark, reg_path)
    assert reg.where("is_latest").count() == models.count()
    metrics = out["metrics"].collect()
    assert metrics and all(0.0 <= r.coverage <= 1.0 for r in metrics)
    ids = reg.where("is_latest").select("category_id", F.col("id").alias("model_version_id"))
    live_p, hist_p = f"{tmpdir_path}/live", f"{tmpdir_path}/history"
    training.refresh_cache(spark, models, ids, feats, live_p, hist_p, "2002-01-01 00:00:00")
    live = store.read_current(spark, live_p)
    n_cat = models.count()
    assert live.count() == n_cat * (90 + 24 + 5)
    training.refresh_cache(spark, models, ids, feats, live_p, hist_p, "2002-01-02 00:00:00")
    history = training.read_history(spark, hist_p)
    assert history.count() == n_cat * (90 + 24 + 5)
    # the archive keeps the instants, so its forecasts can be scored against the fact
    fact = history.where("granularity = 'daily'").select(
        F.col("forecast_ts").alias("time"), "category_id", F.lit(100.0).alias("total_sales"))
    perf = f"{tmpdir_path}/performance"
    training.record_performance(spark, hist_p, fact, perf)
    scored = spark.read.parquet(perf).where("metric_name = 'n_points'").agg(F.sum("metric_value"))
    assert scored.first()[0] >= n_cat * 90
    req = (models.select("category_id").distinct()
           .select(F.concat_ws(":", "category_id", F.lit("daily")).alias("request_id"),
                   "category_id", F.lit("daily").alias("granularity"),
                   F.lit(100).alias("period")))
    m = models.join(ids, "category_id")
    res = requests.answer_requests(spark, req, m, feats, live_p, "2002-01-01")
    assert res["delta"].count() == n_cat * 10
    live2 = store.read_current(spark, live_p)
    assert live2.where("granularity = 'daily'").count() == n_cat * 100
    assert live2.where("forecast_ts IS NULL OR id IS NULL").count() == 0
    assert {r.status for r in res["outcomes"].collect()} == {"COMPLETED"}
    stored = forecasts.models_from_registry(reg.where("is_latest"))
    asked = stored.select("category_id", F.lit("daily").alias("granularity"), F.lit(5).alias("periods"))
    a, b = (forecasts.forecast(x, asked, feats).orderBy("category_id", "date").collect()
            for x in (stored, m))
    assert a == b and len(a) == 5 * n_cat
