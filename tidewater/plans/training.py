"""E2 — train every category, back-test, register versions, refresh the forecast cache.

    fact -> training frame -> fits for all categories and all cutoffs (one grouped job)
    -> back-test forecasts -> rolling metrics -> registry rows (append, latest recomputed)
    -> standard 90/24/5 forecasts -> archive the current live table -> new live snapshot.

Deviations kept on purpose: a category whose fit fails keeps its previous live rows (Q19);
the live table is swapped as a snapshot, never emptied first (Q20).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import store
from ..model import backtest, fit, stats
from ..operators import forecasts, reads
from ..schemas import LIVE_FORECAST
from ..util import materialize


def train_all(train: DataFrame, promo_feats: DataFrame, as_of) -> dict:
    """Fit production models and back-test models in one grouped job.

    Returns {"models", "backtest", "metrics", "registry"} DataFrames (models checkpointed).
    """
    train = materialize(train.select("category_id", "ds", "y"))
    trainable = stats.trainable_categories(train)
    train = train.join(trainable.select("category_id"), "category_id", "left_semi")
    cutoffs = materialize(stats.cv_cutoffs(stats.cv_params(train), train))
    params = fit.fit_models(train, promo_feats, cutoffs)          # full + cutoff fits
    models = params.where(F.col("cutoff").isNull())
    cv_params = params.where(F.col("cutoff").isNotNull())
    cv = backtest.backtest_forecasts(train, promo_feats, params=cv_params)
    metrics = backtest.performance_metrics(cv)
    registry = forecasts.registry_rows(models, stats.training_metadata(train),
                                       backtest.metrics_json(metrics), as_of)
    return {"models": models, "backtest": cv, "metrics": metrics, "registry": registry}


def register_versions(spark: SparkSession, registry_rows: DataFrame, registry_path: str) -> int:
    """Append the versions that the registry lacks, by (category, version): a retry or a
    second scheduler adds none twice. ``is_latest`` is derived on read by ``latest_versions``.
    Returns the number of new rows."""
    return store.append_unique(registry_rows.drop("is_latest"), registry_path,
                               ["category_id", "version"])


def latest_versions(spark: SparkSession, registry_path: str) -> DataFrame:
    """The registry with one ``is_latest`` per category."""
    return reads.mark_latest(store.read_current(spark, registry_path))


def refresh_cache(spark: SparkSession, models: DataFrame, model_ids: DataFrame,
                  promo_feats: DataFrame, live_path: str, history_path: str, as_of) -> int:
    """Archive the current live table and publish a new one in which categories with a new
    forecast are replaced, in one commit: a crash leaves both as they were, a retry archives
    once, and a writer that comes in between makes it start again from the new state. Live and
    archive are folders of one parent folder. Returns the number of the commit."""
    (root, live), (other, history) = store._place(live_path), store._place(history_path)
    if root != other:
        raise ValueError("live and archive must be folders of one parent folder")
    m = models.where(F.col("status") == "OK").join(model_ids, "category_id")
    fresh = materialize(forecasts.live_rows(forecasts.standard_forecasts(m, promo_feats)))
    while True:
        base = store.manifest(spark, root)[0]
        old = store.read_current(spark, live_path, LIVE_FORECAST)
        try:
            return store.commit(root, replace={live: forecasts.refreshed_live(old, fresh)},
                                append={history: forecasts.archive_forecasts(old, as_of)}, base=base)
        except store.Conflict:
            continue


def read_history(spark: SparkSession, history_path: str) -> DataFrame:
    """All archived forecasts."""
    return store.read_current(spark, history_path)


def record_performance(spark: SparkSession, history_path: str, fact: DataFrame,
                       performance_path: str) -> int:
    """Score archived forecasts against the fact and append the metrics that are not
    recorded yet, by (model version, period, metric). Returns the number of new rows."""
    return store.append_unique(
        forecasts.performance_rows(read_history(spark, history_path), fact), performance_path,
        ["model_version_id", "evaluation_period_start", "evaluation_period_end", "metric_name"])
