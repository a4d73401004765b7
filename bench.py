"""Times the headline queries and prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from spanloom.plans import registry as core
from spanloom.session import local_session, ship_package

HEADLINE = ["overlap_counts", "semi_join", "anti_join", "intersection", "merge", "nearest", "coverage_simple", "coverage_mean_overlap", "chip_normalize", "smoothen", "quantile_normalize", "cross_correlation", "run_lengths", "window_map", "kmer_counts", "pwm_max", "sequence_scan"]


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = ship_package(local_session(cpus, int(cpus)))
    spark.sparkContext.setLogLevel("ERROR")
    spark.range(1000).selectExpr("sum(id)").collect()
    took = {}
    for name in HEADLINE:
        start = time.time()
        core.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        took[name] = round(time.time() - start, 3)
    print(json.dumps({"metric": "total seconds of the headline queries", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": sf_dir.rsplit("sf", 1)[-1]}))
    spark.stop()


if __name__ == "__main__":
    main()
