"""Times the headline queries and prints one JSON line.

Reads ``BENCH_SF_DIR`` (default /root/testdata/sf0.1) and runs on ``local[BENCH_CPUS]``. Every query is
executed in full into the no-op sink, after one small warm-up query.
"""

from __future__ import annotations

import json
import os
import sys
import time

from parcelflow.plans import all_queries
from parcelflow.session import build_session

HEADLINE = (
    "flagship_project_report",
    "lots_from_records",
    "validate_lots",
    "agg_sheet_scale",
    "area_check_flags",
    "agg_area_agreement",
    "agg_label_coverage",
    "agg_qa_report",
    "join_point_in_polygon",
    "join_overlap_ratio",
    "join_neighbour_in_direction",
    "pipe_lot_metadata",
    "unit_reconcile_version",
    "unit_bind_plan",
    "availability_apply",
    "outbox_materialize",
    "outbox_claim",
    "stalled_jobs",
    "win_project_workspace",
    "agg_dashboard_metrics",
    "win_sliding_failures",
    "win_idempotent_uploads",
    "lots_batch_patch",
    "st_outbox",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 4))
    names = sys.argv[1:] or list(HEADLINE)
    spark = build_session("parcelflow-bench", f"local[{cpus}]", **{
        "spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "8g"})
    spark.sparkContext.setLogLevel("ERROR")
    all_queries.QUERIES["agg_status_counts"](spark, folder).write.format("noop").mode("overwrite").save()
    seconds = {}
    for name in names:
        start = time.perf_counter()
        all_queries.QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec",
                      "queries": seconds, "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
