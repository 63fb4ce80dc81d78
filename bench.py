"""Headline queries at one scale; prints one JSON line. Every result is computed in full (noop sink)."""

from __future__ import annotations

import json
import os
import time

from leeward.plans.catalog import all_queries
from leeward.session import local_session

FOLDER = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
HEADLINE = ("late_split", "dedup_exact", "dedup_paths", "quality_status", "live_alerts", "neighbour_median",
            "device_scd2", "readings_asof_device", "city_exposure", "risk_map_hourly", "validation_metrics",
            "doc_chunks", "knn_top10", "answer_audit", "stream_dedup")


def main() -> None:
    spark = local_session(CPUS, memory=os.environ.get("BENCH_MEMORY", "12g"), app="bench")
    queries = all_queries()
    queries["device_counts"](spark, FOLDER).write.format("noop").mode("overwrite").save()   # start the engine
    seconds: dict[str, float] = {}
    for name in HEADLINE:
        start = time.perf_counter()
        queries[name](spark, FOLDER).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec",
                      "queries": seconds, "sf": os.path.basename(FOLDER.rstrip("/"))}))
    spark.stop()


if __name__ == "__main__":
    main()
