"""Reads over the registry, the forecast cache, its archive and the job table
(O1-O3, O8-O11, A4, A8, A10, F8, F9, F12, J4, W1, W2, X14, X15).

Single-key lookups push their filters into the parquet scan; request tables (many lookups
at once) are joins, never loops. Windows partition only by (category, granularity) over
the forecast cache, whose size per key is the forecast horizon, not the data volume.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.formatting import empty_if_null, iso_date, rfc3339
from ..schemas import REQUEST_PARAMS
from .ingest import _clamp_limit

POINT = ["forecast_date", "predicted_sales", "lower_bound", "upper_bound"]


# ------------------------------------------------------------------------- model registry
def latest_model(versions: DataFrame) -> DataFrame:
    """The one latest version per category — newest training date, then the
    highest version id. ``max_by`` is a hash aggregate: a category with many versions
    is combined map-side, not gathered into one task."""
    return (versions.groupBy("category_id")
            .agg(F.max_by("id", F.struct("training_date_utc", "id")).alias("model_version_id"),
                 F.max_by("version", F.struct("training_date_utc", "id")).alias("version")))


def mark_latest(versions: DataFrame) -> DataFrame:
    """Registry with ``is_latest`` recomputed (one TRUE per category)."""
    latest = latest_model(versions).select(F.col("model_version_id").alias("_latest_id"))
    return (versions.join(latest, F.col("id") == F.col("_latest_id"), "left")
            .withColumn("is_latest", F.col("_latest_id").isNotNull()).drop("_latest_id"))


def missing_models(categories: DataFrame, versions: DataFrame) -> DataFrame:
    """Categories asked for that have no model (the not-found case)."""
    have = versions.select("category_id").distinct()
    return categories.select("category_id").distinct().join(have, "category_id", "left_anti")


def model_versions(versions: DataFrame, category_id: str) -> DataFrame:
    """All versions of one category, newest first (full rows, Q21)."""
    return (versions.where(F.col("category_id") == category_id)
            .orderBy(F.col("training_date_utc").desc(), F.col("id").desc()))


def all_model_versions(versions: DataFrame) -> DataFrame:
    """Every version, newest training first."""
    return versions.orderBy(F.col("training_date_utc").desc(), F.col("id").desc())


def model_performance(performance: DataFrame, model_version_id: int) -> DataFrame:
    """Stored metrics of one version, newest evaluation first."""
    return (performance.where(F.col("model_version_id") == model_version_id)
            .orderBy(F.col("evaluation_period_end").desc(), F.col("metric_name")))


# -------------------------------------------------------------------------- forecast cache
def cached_forecast(live: DataFrame, category_id: str, granularity: str,
                    period: int, from_date=None) -> DataFrame:
    """O1/Q16: the oldest ``period`` cached points of one (category, granularity) by date
    (no ``>= today`` filter, as the reference; ``from_date`` adds one), dates as text."""
    cond = (F.col("category_id") == category_id) & (F.col("granularity") == granularity)
    if from_date is not None:
        cond = cond & (F.col("forecast_date") >= F.lit(from_date).cast("date"))
    return (live.where(cond)
            .orderBy("forecast_date").limit(int(period))
            .select(iso_date(F.col("forecast_date")).alias("date"),
                    "predicted_sales", "lower_bound", "upper_bound"))


def cached_points(live: DataFrame, requests: DataFrame) -> DataFrame:
    """O1 for a request table (category_id, granularity, period): the first ``period``
    points of each requested key (W2 in set form)."""
    w = Window.partitionBy("category_id", "granularity").orderBy("forecast_date")
    req = requests.select("category_id", "granularity", "period").distinct()
    keys = req.select("category_id", "granularity").distinct()
    ranked = (live.join(keys, ["category_id", "granularity"], "left_semi")
              .withColumn("_rn", F.row_number().over(w)))
    return (ranked.join(req, ["category_id", "granularity"])
            .where(F.col("_rn") <= F.col("period"))
            .select("category_id", "granularity", "period", *POINT))


def last_cached(live: DataFrame) -> DataFrame:
    """A4: last cached date per (category, granularity)."""
    return (live.groupBy("category_id", "granularity")
            .agg(F.max("forecast_date").alias("last_cached_date"),
                 F.count(F.lit(1)).alias("n_cached")))


def forecast_gaps(live: DataFrame, requests: DataFrame) -> DataFrame:
    """Per request, how many points the cache holds and how many are missing.

    hit when the cache holds at least ``period`` points; otherwise the missing count is
    ``period - cached`` and a delta forecast is due (one job per miss in the reference).
    """
    stats = last_cached(live)
    return (requests.join(stats, ["category_id", "granularity"], "left")
            .select("request_id", "category_id", "granularity", "period",
                    F.coalesce("n_cached", F.lit(0)).alias("n_cached"),
                    F.greatest(F.col("period") - F.coalesce("n_cached", F.lit(0)),
                               F.lit(0)).alias("n_missing"),
                    "last_cached_date"))


def forecast_history(history: DataFrame, category_id: str, start_date, end_date) -> DataFrame:
    """Archived points of a category in an inclusive date range, by version, date."""
    return (history.where((F.col("category_id") == category_id)
                          & F.col("forecast_date").between(F.lit(start_date).cast("date"),
                                                           F.lit(end_date).cast("date")))
            .orderBy("model_version_id", "forecast_date")
            .select("model_version_id", *POINT))


def forecast_history_nested(history: DataFrame) -> DataFrame:
    """One row per category and model version with its points as a date-sorted array.

    The array is bounded by the version's forecast horizon."""
    return (history.groupBy("category_id", "model_version_id")
            .agg(F.sort_array(F.collect_list(F.struct(*POINT))).alias("forecasts")))


# ------------------------------------------------------------------------------- job table
def parse_requests(jobs: DataFrame) -> DataFrame:
    """Decode ``request_params`` JSON and split valid and invalid requests."""
    p = F.from_json("request_params", REQUEST_PARAMS)
    return (jobs.withColumn("_p", p)
            .select("job_id", "category_id",
                    F.col("_p.granularity").alias("granularity"),
                    F.col("_p.count").alias("period"),
                    F.col("_p.granularity").isin("daily", "monthly", "yearly")
                    .alias("valid_granularity"))
            .withColumn("valid", F.coalesce(F.col("valid_granularity") & (F.col("period") > 0),
                                            F.lit(False)))
            .drop("valid_granularity"))


def recent_jobs(jobs: DataFrame, limit: int | str | None = 20) -> DataFrame:
    """O3: most recent forecast jobs; default 20, cap 100, NULL text -> '' (X15)."""
    n = _clamp_limit(limit, default=20, cap=100)
    return (jobs.orderBy(F.col("created_at").desc(), F.col("seq").desc()).limit(n)
            .select("job_id", empty_if_null(F.col("category_id")).alias("category_id"),
                    empty_if_null(F.col("status")).alias("status"),
                    empty_if_null(F.col("error_message")).alias("error_message"),
                    rfc3339(F.col("created_at")).alias("created_at"),
                    rfc3339(F.col("updated_at")).alias("updated_at")))


def job_status(jobs: DataFrame, job_id: str) -> DataFrame:
    """One job by id."""
    return (jobs.where(F.col("job_id") == job_id)
            .select("job_id", empty_if_null(F.col("category_id")).alias("category_id"),
                    empty_if_null(F.col("status")).alias("status"),
                    empty_if_null(F.col("error_message")).alias("error_message"),
                    rfc3339(F.col("created_at")).alias("created_at"),
                    rfc3339(F.col("updated_at")).alias("updated_at")))
