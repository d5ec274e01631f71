"""Times the headline queries and prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

from carefold.plans import catalog
from carefold.plans.inputs import Inputs
from carefold.session import build_session

HEADLINES = (
    "trend_summary", "threshold_crossings", "trend_points", "overdue_monitoring",
    "critical_flag", "masked_text", "token_map", "guarded_text", "extracted_entities",
    "sentences", "coded_entities", "reference_bands", "planned_queries", "knowledge_search",
    "ranked_knowledge", "evidence_pool", "verified_insights", "patient_summary", "timeline",
    "review_queue", "stored_entities", "span_offsets",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINES
    spark = build_session("bench", f"local[{cpus}]", **{
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.sql.shuffle.partitions": cpus,
        "spark.driver.memory": "8g",
    })
    spark.sparkContext.setLogLevel("OFF")
    inputs = Inputs(spark, folder)

    def run(name: str) -> float:
        begin = time.time()
        catalog.QUERIES[name](inputs).write.format("noop").mode("overwrite").save()
        return time.time() - begin

    times = {}
    for name in names:
        run(name)  # warm-up
        times[name] = round(run(name), 3)
    print(json.dumps({
        "metric": "headline_queries_total",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "sf": os.path.basename(folder.rstrip("/")),
    }))


if __name__ == "__main__":
    main()
