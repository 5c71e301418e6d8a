"""Headline queries on one node: prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) is the data folder, BENCH_CPUS
(default 8) the number of cores, BENCH_RUNS (default 1) the repetitions whose
median is reported, BENCH_QUERIES a comma-separated subset.
"""

from __future__ import annotations

import json
import os
import re
import statistics
import sys
import time

from pyspark.sql import SparkSession

from tabaudit import queries as registry

HEADLINE = (
    "numeric_describe", "corr_pairs", "table_overview", "distinct_counts", "categorical_profile",
    "iqr_outliers_distributed", "exact_quantiles_by_class", "quality_findings", "histogram_by_class",
    "box_stats", "pair_bins", "density_curve", "ttest_two_class", "chi2_independence", "anova_f", "kruskal_h",
    "median_impute", "label_encode", "hash_sample", "join_key_candidates", "fuse_inner", "auc_binary",
    "calibration_curve", "text_rule_scan", "csv_load", "isolation_forest_scores", "rf_importance_topk", "calibrated_audit",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "1"))
    chosen = [q for q in os.environ.get("BENCH_QUERIES", "").split(",") if q] or list(HEADLINE)
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("tabaudit-bench")
        .config("spark.sql.shuffle.partitions", cpus).config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false").config("spark.driver.memory", "12g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", os.environ.get("BENCH_SCRATCH") or "/tmp/tabaudit-bench").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    known = registry.queries()
    # One small query first, so that JVM start-up is not counted.
    known["shape_profile"](spark, sf_dir).collect()
    seconds: dict[str, float] = {}
    for name in chosen:
        taken = []
        for _ in range(runs):
            start = time.perf_counter()
            known[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            taken.append(time.perf_counter() - start)
        seconds[name] = round(statistics.median(taken), 3)
        print(f"{name}: {seconds[name]}", file=sys.stderr)
    spark.stop()
    found = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({
        "metric": "total_wall_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": float(found.group(1)) if found else None, "cpus": int(cpus),
    }))


if __name__ == "__main__":
    main()
