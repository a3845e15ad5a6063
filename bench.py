"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Every query is run once to warm up, then BENCH_RUNS times (default 3); the median counts.
Results are written to a sink that reads all rows and keeps none.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

from tests.compare import session

HEADLINE = (
    "a8_normalise_missing",
    "b1_filter_expr",
    "b6_filter_conditions",
    "b8_search_rows",
    "c5_derive",
    "c6_row_median",
    "d3_remove_stopwords",
    "d8_tokenize",
    "d9_tfidf_terms",
    "e2_drop_duplicates_by",
    "e3_duplicate_count",
    "e5_fill_missing_all",
    "e12_clean",
    "f1_column_profile",
    "f2_describe_numeric",
    "f4_histogram",
    "f5_value_counts",
    "f6_text_stats",
    "f8_correlation_matrix",
    "f10_outlier_report",
    "g2_group_means",
    "g3_trend_ends",
    "g7_cluster_zscores",
    "h2_top_n",
    "h4_sample_n",
    "h6_train_test_split",
    "i7_box",
    "i9_density",
    "i13_word_frequency",
    "j2_standardise",
    "k3_knn_predict",
    "k5_classification_metrics",
    "l1_kmeans",
    "l2_dbscan",
    "l4_cluster_metrics",
    "m1_isolation_forest",
    "m2_lof",
    "n1_pca_variance",
    "o1_frequent_itemsets",
    "o2_association_rules",
    "p2_scenario_percent",
    "p4_bootstrap_sum",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    names = sys.argv[1:] or HEADLINE
    spark = session(cpus, int(cpus) if cpus.isdigit() else 8)
    spark.sparkContext.setLogLevel("ERROR")
    from workload import QUERIES

    times: dict[str, float] = {}
    for name in names:
        taken = []
        for i in range(runs + 1):
            start = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            if i:
                taken.append(time.perf_counter() - start)
        times[name] = round(statistics.median(taken), 3)
        print(name, times[name], file=sys.stderr, flush=True)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "sum of median query times",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
