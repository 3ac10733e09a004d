"""Headline timings: BENCH_SF_DIR on local[BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from waymark.checks import load_all
from waymark.checks.base import QUERIES
from waymark.session import local_session

HEADLINE = (
    "p01_recovery_funnel", "p02_centroid_fill", "p03_direct_labels", "p04_evidence_pool",
    "a07_cluster_predictions", "p05_holdout_scores", "p06_record_predictions", "p07_pilot_sample",
    "a23_species_counters", "p08_latest_decisions", "p09_review_order", "p10_selected_occurrences",
    "a08_taxon_summary", "p12_species_split", "m04_threshold_grid", "m02_bootstrap_mean",
    "x07_clean_place_query", "x03_fold_key", "w08_running_share", "r06_stratified_draw",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    only = os.environ.get("BENCH_ONLY", "")
    load_all()
    spark = local_session(cpus, shuffle_partitions=int(cpus) if cpus.isdigit() else 8)
    spark.sparkContext.setLogLevel("ERROR")
    spark.range(1000).selectExpr("sum(id)").collect()
    timings: dict[str, float] = {}
    for name in HEADLINE:
        if only and only not in name:
            continue
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        timings[name] = round(time.perf_counter() - start, 3)
    print(
        json.dumps(
            {
                "metric": "headline_total", "value": round(sum(timings.values()), 3), "unit": "sec",
                "queries": timings, "sf": os.path.basename(sf_dir.rstrip("/")),
            }
        ),
        flush=True,
    )
    spark.stop()


if __name__ == "__main__":
    main()
