"""Headline queries at ``$BENCH_SF_DIR`` on ``local[$BENCH_CPUS]``; prints one JSON line.

    BENCH_SF_DIR=/root/testdata/sf0.1 BENCH_CPUS=8 python bench.py [query ...]
"""

from __future__ import annotations

import json
import os
import sys
import time

from eventwarden import registry
from eventwarden.plans.desk import desk
from eventwarden.session import build_session, clear_work_folder

HEADLINE = [
    "threshold_count", "threshold_distinct", "rule_brute_force_001", "rule_brute_force_003", "rule_lateral_movement_001",
    "match_rules_union", "ioc_match", "baseline_frequencies", "baseline_point_in_time", "rule_valid_account_abuse_001",
    "entity_islands", "incident_clusters", "incident_timeline", "graph_nodes", "graph_edges", "similar_incidents",
    "hunt_failed_then_success", "prd_any_of", "host_profile_topk", "account_summary", "identity_risk", "alert_trend",
    "confusion_matrix", "scenario_recall", "norm_linux_auth", "norm_cloud", "validate_quarantine", "instruction_scan_documents",
    "redact_documents", "order_price_statistics",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    spark = build_session("bench", cores=cores, shuffle_partitions=int(cores))
    queries = registry.queries()
    seconds: dict[str, float] = {}

    # the stored tables are a job of their own: ingest, detect, alert, correlate
    for table in ("events", "evidence", "detections", "scored_alerts", "assigned", "incidents"):
        start = time.time()
        getattr(desk(spark, folder), table).count()
        seconds[f"build_{table}"] = round(time.time() - start, 3)
    for name in names:
        start = time.time()
        queries[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.time() - start, 3)
    clear_work_folder(spark)
    print(json.dumps({
        "metric": "total_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds,
        "sf": float(os.path.basename(folder.rstrip("/")).replace("sf", "") or 0),
    }))


if __name__ == "__main__":
    main()
