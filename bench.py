"""Times the headline queries and prints one JSON line.

Reads ``BENCH_SF_DIR`` and ``BENCH_CPUS``. Each query runs once untimed, so that
code generation and worker start are not measured, and then ``REPEATS`` times; the
median counts. Every result row is computed and thrown away.
"""

import json
import os
import statistics
import time

from spoorline.driver import QUERIES
from spoorline.session import local_session

HEADLINES = [
    # zero-shot evaluation
    "top1_species",
    "per_species_accuracy",
    "evaluate_job",
    # ranked retrieval
    "rank_by_species",
    "rank_each_species",
    "head_per_species",
    "detect_job",
    # side-by-side comparison
    "union_methods",
    "method_comparison",
    "quality_box_stats",
    "overlays_by_image",
    "compare_job",
    # box selection
    "animal_boxes",
    "best_box",
    "localise_boxes",
    "localise_masks",
    # ground truth and reporting
    "with_ground_truth",
    "enrich_ground_truth",
    "count_accuracy",
    "site_summary",
    "map_points",
    "resolve_paths",
    "validate_images",
]
REPEATS = 3


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), "bench")
    spark.sparkContext.setLogLevel("ERROR")
    seconds = {}
    for name in HEADLINES:
        times = []
        for _ in range(1 + REPEATS):
            start = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - start)
        seconds[name] = round(statistics.median(times[1:]), 4)
    line = {
        "metric": "total seconds of the headline queries",
        "value": round(sum(seconds.values()), 4),
        "unit": "sec",
        "queries": seconds,
        "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
    }
    print(json.dumps(line))
    spark.stop()


if __name__ == "__main__":
    main()
