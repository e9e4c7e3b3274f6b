"""Audit the executed plan of every registered query: no CartesianProduct and no
BroadcastNestedLoopJoin (no cross joins, no all-pairs). Usage:
python tools/plan_audit.py [sf_dir]"""

from __future__ import annotations

import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from tidewater.plans import registry  # noqa: E402
from tidewater.session import build_session  # noqa: E402

FORBIDDEN = ("CartesianProduct", "BroadcastNestedLoopJoin")


def main() -> None:
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.001"
    spark = build_session("local[8]", 8)
    registry.load_all()
    bad = []
    for key, fn in registry.QUERIES.items():
        plan = fn(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
        hits = [w for w in FORBIDDEN if w in plan]
        print(key, "ok" if not hits else "BAD " + ",".join(hits), flush=True)
        if hits:
            bad.append(key)
    print("SUMMARY", len(registry.QUERIES) - len(bad), "ok;", "bad:", bad)


if __name__ == "__main__":
    main()
