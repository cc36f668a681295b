"""Time the headline queries on ``$BENCH_SF_DIR`` with ``local[$BENCH_CPUS]``; prints one JSON line."""

from __future__ import annotations

import json
import os
import re
import time

from tallyloom.catalog import QUERIES
from tallyloom.session import build_session

HEADLINE = (
    "employee_performance", "leader_performance", "performance_snapshot", "live_display", "performance_upsert",
    "sales_by_employee_period", "sales_dedup", "sales_with_assignments", "unmatched_sales", "percentage_calc",
    "normalize_text", "match_employee", "match_employee_many", "keyword_scan", "keyword_scan_many", "notes_per_message",
    "webhook_flatten", "messages_dedup", "customers_upsert", "customer_name_on_arrival",
    "notes_filtered", "notes_stats", "top_labels", "quality_by_label", "quality_by_employee",
    "scoped_performance", "employees_upsert", "targets_replace", "delete_cascade", "fk_orphans",
)
RUNS = 2


def _seconds(spark, name: str, folder: str) -> float:
    start = time.perf_counter()
    QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    spark = build_session("bench", master=f"local[{cpus}]", shuffle_partitions=cpus)
    spark.sparkContext.setLogLevel("ERROR")
    _seconds(spark, "quality_by_label", folder)  # starts the workers; not counted
    found = {name: round(min(_seconds(spark, name, folder) for _ in range(RUNS)), 3) for name in HEADLINE}
    scale = re.search(r"sf([\d.]+)", folder)
    print(json.dumps({"metric": "headline_total", "value": round(sum(found.values()), 3), "unit": "sec",
                      "queries": found, "sf": float(scale[1]) if scale else None}))
    spark.stop()


if __name__ == "__main__":
    main()
