"""Times the headline queries and prints one JSON line.

BENCH_SF_DIR: folder of the Parquet tables (default sf0.1). BENCH_CPUS: local cores (default 8).
"""

from __future__ import annotations

import json
import os
import re
import time

from adsight.plans.all_queries import REGISTRY
from adsight.plans.session import build

HEADLINES = (
    "today_kpis", "metric_series", "entity_daily", "level_daily", "kpis",
    "tracking_check_all_dates", "budget_pacing", "rolling_windows", "detect_baseline_change",
    "detect", "group_opportunities", "replay", "evidence_tree", "evaluate_experiments",
    "validate_rows", "ingest_files", "upsert", "alert_episodes", "detection_score",
    "ungrounded_numbers", "weekly_payload",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build("bench", cpus, partitions=int(cpus) if cpus.isdigit() else 8)
    spark.read.parquet(f"{sf_dir}/region.parquet").count()  # start the JVM's workers
    seconds = {}
    for name in HEADLINES:
        started = time.perf_counter()
        REGISTRY[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - started, 3)
    found = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({
        "metric": "headline queries, total wall clock", "value": round(sum(seconds.values()), 3),
        "unit": "sec", "queries": seconds, "sf": float(found.group(1)) if found else None}))


if __name__ == "__main__":
    main()
