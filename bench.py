"""Benchmark: build the warehouse and run the headline queries.

Env: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8).
Prints one JSON line: {"metric", "value", "unit", "queries", "sf", ...}.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "v_channel_matrix", "funnel_by_origin", "funnel_by_page_month", "ttc_origin", "seller_revenue_by_origin",
    "cohort_revenue", "v_seller_post_signing", "segment_performance", "revenue_sensitivity", "channel_roi",
    "recommendations", "scenario_totals", "chi_square", "km_curve", "logrank_pairwise", "bootstrap_ci",
    "bootstrap_ci_poisson", "heatmap", "measures_by_origin", "measures_monthly", "audit_constraints",
    "audit_status",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    from leadlens.session import get_session
    # the shared folder comes from spark.checkpoint.dir when configured; only an
    # unset local run gets a fresh folder under /tmp (leadlens.session)
    spark = get_session(f"local[{cpus}]", app_name="leadlens-bench", shuffle_partitions=max(8, 2 * cpus),
                        extra={"spark.driver.memory": "8g"})
    from leadlens.plans.context import warehouse_for
    from leadlens.registry import QUERIES

    t0 = time.perf_counter()
    warehouse_for(spark, sf_dir)
    timings = {"warehouse_build": round(time.perf_counter() - t0, 3)}
    for name in HEADLINE:
        t = time.perf_counter()
        QUERIES[name](spark, sf_dir).collect()
        timings[name] = round(time.perf_counter() - t, 3)
    total = round(sum(timings.values()), 3)
    m = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({"metric": "total_sec_warehouse_plus_headline_queries", "value": total, "unit": "sec",
                      "queries": timings, "sf": float(m.group(1)) if m else sf_dir, "cpus": cpus}))
    spark.stop()


if __name__ == "__main__":
    main()
