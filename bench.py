"""Benchmark: headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Each query is forced to completion with a ``noop`` write (full evaluation, no transfer
to the driver). A warm-up query runs first so JVM start-up is not billed to query 1.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tidewater.plans import registry  # noqa: E402
from tidewater.session import build_session  # noqa: E402

HEADLINE = [
    "hourly_sales",          # clean + hourly roll-up of the events stream table
    "hourly_sales_daily",    # clean + roll-up of lineitem x part (largest scan)
    "hourly_merge",          # per-file deltas merged additively
    "stream_hourly",         # the same roll-up as a Structured Streaming query
    "ledger_latest",
    "files_to_process",
    "promotion_days",
    "category_mismatch",
    "tail_forecast",
    "forecast_gaps",
    "rolling_metrics",
    "fit_models",            # additive model, 25 brands
    "backtest_metrics",      # 25 brands x all cutoffs, fit + score + rolling metrics
    "live_forecasts",        # standard 90/24/5 set
    "delta_forecast",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    only = [k for k in sys.argv[1:]]
    spark = build_session(f"local[{cpus}]", int(cpus) * 2, app_name="tidewater-bench",
                          extra={"spark.driver.memory": "16g"})
    registry.load_all()
    keys = [k for k in (only or HEADLINE) if k in registry.QUERIES]
    # warm-up (JVM, parquet footers, Python workers)
    registry.QUERIES["dim_categories"](spark, sf_dir).write.format("noop").mode(
        "overwrite").save()
    times, errors = {}, {}
    for key in keys:
        t0 = time.time()
        try:
            df = registry.QUERIES[key](spark, sf_dir)
            df.write.format("noop").mode("overwrite").save()
            times[key] = round(time.time() - t0, 3)
        except Exception as e:  # noqa: BLE001 — one failing query must not hide the rest
            times[key] = None
            errors[key] = f"{type(e).__name__}: {e}"[:300]
        print(f"# {key}: {times[key]}s", file=sys.stderr, flush=True)
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    done = [v for v in times.values() if v is not None]
    print(json.dumps({"metric": "total_headline_seconds", "value": round(sum(done), 3),
                      "unit": "sec", "queries": times, "sf": sf, "cpus": int(cpus),
                      **({"errors": errors} if errors else {}),
                      "settings": {"spark.sql.shuffle.partitions": int(cpus) * 2,
                                   "spark.sql.adaptive.enabled": True}}))
    spark.stop()


if __name__ == "__main__":
    main()
