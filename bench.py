"""Time the headline queries and print one JSON line.

Every query starts without materialised tables of earlier ones, so one that asks the graph
pays for building it. Each runs once to warm the JVM and the page cache, then ``BENCH_RUNS``
times; the median counts. A run that passes its time budget fails; it reports no partial sum.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

from trialgauge.plans.staging import drop_staged, forget
from trialgauge.queries import registry
from trialgauge.session import local_session

HEADLINE = [
    "n02_study_with_most_issues", "n13_study_with_most_discrepancies", "n21_coded_percentage", "n25_coding_records_of_study",
    "e06_study_metrics", "c10_preprocess_chain", "f10_site_features", "f13_population_statistics",
    "q20_sites_rules", "q20_sites_hybrid", "q20_patients_hybrid", "r01_rank_sites", "r02_rank_within_study",
    "b04_cohort_statistics", "b10_study_benchmark", "a04_local_outlier_factor", "a14_control_chart", "a15_ks_drift",
    "k02_dbscan", "g10_build_statistics", "g18_safety_reviews_by_site", "g21_count_by_nearest_target",
    "t08_entity_retrieval", "t13_vector_top_k", "p06_region_rollup",
    "a02_isolation_forest", "a05_robust_mahalanobis", "k05_gaussian_mixture", "k06_kmeans", "k07_spectral", "k16_silhouette",
    "t13_vector_top_k_many_queries", "t13_vector_bucketed", "g25_beam_expansion",
    "j10_similar_values", "t06_edit_join",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "1"))
    budget = float(os.environ.get("BENCH_BUDGET_SECONDS", "3600"))
    spark = local_session(cores)
    all_queries = registry.queries()
    began = time.time()
    times: dict[str, float] = {}
    for name in HEADLINE:
        if time.time() - began > budget:
            sys.exit(f"budget spent before {name}: no result")
        samples = []
        for attempt in range(runs + 1):
            forget()
            start = time.time()
            all_queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            if attempt:
                samples.append(time.time() - start)
        times[name] = round(statistics.median(samples), 3)
        print(f"{name}: {times[name]}", file=sys.stderr, flush=True)
    drop_staged(spark)
    line = {
        "metric": "total_seconds_headline_queries",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "sf": sf_dir.rstrip("/").rsplit("sf", 1)[-1],
    }
    print(json.dumps(line))


if __name__ == "__main__":
    main()
