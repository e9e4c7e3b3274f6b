"""E3 — answer a batch of forecast requests from the cache, filling gaps.

    requests (id, category, granularity, period) -> cache hit or miss (forecast_gaps)
    -> one delta forecast per missed (category, granularity) from the day after the last cached date
    -> all-or-nothing append to the live table (no key may collide) -> commit.
The job queue itself (claim, poll, cancel) is not rebuilt; the batch is a DataFrame.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .. import store
from ..operators import forecasts, reads
from ..schemas import LIVE_FORECAST
from ..util import materialize


def answer_requests(spark: SparkSession, requests: DataFrame, models: DataFrame,
                    promo_feats: DataFrame, live_path: str, today) -> dict:
    """Answers a batch. The new live table is committed against the one that was read; if another
    writer has changed it meanwhile, ``store.Conflict`` is raised and nothing is written."""
    root, name = store._place(live_path)
    base = store.manifest(spark, root)[0]
    live = store.read_current(spark, live_path, LIVE_FORECAST)
    gaps = materialize(reads.forecast_gaps(live, requests))
    delta = materialize(forecasts.delta_forecast(models, gaps, promo_feats, today))
    merged, dups = forecasts.delta_apply(live, delta)
    if not dups.isEmpty():
        raise ValueError("delta forecasts collide with cached keys; nothing written")
    snap = None
    if not delta.isEmpty():
        snap = store.commit(root, replace={name: merged}, base=base)
    return {"gaps": gaps, "delta": delta, "snapshot": snap,
            "outcomes": forecasts.request_outcomes(gaps, models)}
