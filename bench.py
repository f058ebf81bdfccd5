"""Times the headline queries; prints one JSON line. BENCH_SF_DIR: tables; BENCH_CPUS: threads. JVM start-up is not counted."""

import json
import os
import time
from pathlib import Path

from ledgerloom.plans import catalogue as plans
from ledgerloom.session import local_session

HEADLINE = ["field_status", "preprocess", "preprocess_with_decisions", "candidate_edges", "scores", "delta_merge", "state_digests", "case_page", "import_issues", "proposals", "matched_pairs", "dense_block"]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(int(os.environ.get("BENCH_CPUS", "8")), "bench", "12g")
    spark.read.parquet(f"{sf_dir}/orders.parquet").count()
    took = {}
    for name in HEADLINE:
        began = time.perf_counter()
        plans.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        took[name] = round(time.perf_counter() - began, 3)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": Path(sf_dir).name.removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
