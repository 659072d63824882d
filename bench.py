"""Time the headline queries: one JSON line with the median of three runs each.

BENCH_SF_DIR: data folder (default /root/testdata/sf0.1), BENCH_CPUS: local cores.
"""

from __future__ import annotations

import json
import logging
import os
import statistics
import time

from plumbline.session import build_session

HEADLINE = (
    "selection_by_condition", "trust_scores", "mixture_realism", "knn_join", "knn_per_attribute", "authenticity",
    "beta_recall", "alpha_precision", "kid_whole_groups", "delta_kid", "kid_null", "decile_report", "global_selection",
    "centroids", "bin_within", "quantile_bins", "detection_summary", "spearman", "make_splits", "stratified_subsample",
    "dedupe_vectors", "anova_top_k", "feature_deltas", "prototype_report", "acceptance_monitor",
)
RUNS = int(os.environ.get("BENCH_RUNS", "3"))


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "bench", f"local[{cpus}]",
        **{"spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "16g", "spark.ui.showConsoleProgress": "false"},
    )
    spark.sparkContext.setLogLevel("OFF")
    logging.disable(logging.CRITICAL)
    from plumbline.plans.catalog import QUERIES

    seconds, cold = {}, {}
    for name in HEADLINE:
        times = []
        for _ in range(RUNS):
            start = time.perf_counter()
            QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - start)
        seconds[name], cold[name] = round(statistics.median(times), 3), round(times[0], 3)
    print(
        json.dumps(
            {
                "metric": "sum of median seconds of the headline queries", "value": round(sum(seconds.values()), 3), "unit": "sec",
                "queries": seconds, "cold": cold, "sf": os.path.basename(folder.rstrip("/")), "cpus": int(cpus),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
