"""Benchmark: headline queries on the driver's tables.

Runs on ``local[$BENCH_CPUS]`` over ``$BENCH_SF_DIR`` (default sf0.1) and prints
one JSON line: total seconds plus seconds per query. Each query is executed in
full with the ``noop`` sink (every row computed, nothing collected) twice; the
headline numbers are the second (steady-state) runs, the first (cold) runs are
reported beside them. Landing the raw event table and recomputing the mart are
timed apart as ``setup``.
"""
from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from flowgauge.plans.registry import QUERIES, domain  # noqa: E402
from flowgauge.session import build_session  # noqa: E402

HEADLINE = [
    "build_mart",            # Q1-Q7: six metrics x three scopes, as-of joins, medians
    "cockpit_tiles",         # Q8: dashboard read over the mart
    "lead_time_p50",         # Q2 alone: the as-of join
    "change_failure_rate",   # Q3: bounded as-of (48 h)
    "cycle_stages",          # Q11: review stages, org-wide medians
    "reviewer_load",         # Q12: top-10
    "aging_prs_page",        # Q13: paging
    "investment_breakdown",  # Q14: issue-key join + classification
    "investment_by_team",    # Q16
    "ai_spend_kpis",         # Q18
    "ai_impact",             # Q23
    "developer_allocation",  # Q22
    "rebuild_pr_state",      # D5: JSON envelopes -> dedup -> latest state
    "rebuild_issue_state",   # D5 + D3 sticky flag
    "connector_health",      # Q28
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    names = [q for q in (sys.argv[1:] or HEADLINE) if q in QUERIES]
    spark = build_session(f"local[{cpus}]", cpus * 2, extra={
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": os.environ.get("BENCH_DRIVER_MEMORY", "16g"),
    })
    # Setup (timed apart): land the tables the reference keeps materialised -
    # the raw event store and the metric mart - once, as its ingest and
    # recompute jobs would. Queries below read them like the dashboards do.
    t0 = time.perf_counter()
    d = domain(spark, sf_dir)
    d.raw_stored.count()
    setup = {"land_raw_events": round(time.perf_counter() - t0, 3)}
    t0 = time.perf_counter()
    d.stored_mart.count()
    setup["recompute_and_write_mart"] = round(time.perf_counter() - t0, 3)
    QUERIES[names[0]](spark, sf_dir).write.format("noop").mode("overwrite").save()  # warm-up
    times = {}
    cold = {}
    for name in names:
        # first run: cold (plan build, JIT, file listing); second run: steady
        # state, as a dashboard serving repeated requests sees it. Both kept.
        for attempt in (0, 1):
            t0 = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            (cold if attempt == 0 else times)[name] = round(time.perf_counter() - t0, 3)
            spark.catalog.clearCache()
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(json.dumps({"metric": "headline_total_seconds", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "cold_total": round(sum(cold.values()), 3), "cold_queries": cold,
                      "setup": setup,
                      "sf": float(sf) if sf.replace(".", "").isdigit() else sf, "cpus": cpus}))
    spark.stop()


if __name__ == "__main__":
    main()
