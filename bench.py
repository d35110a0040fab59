"""Headline queries over $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line of seconds."""

from __future__ import annotations

import json
import os
import sys
import time

import entries
from tabwork.session import session

HEADLINE = (
    "iqr_outliers", "profile_numeric", "cardinality", "group_stats", "correlation_matrix", "histogram",
    "quality_score", "column_profile", "label_encode", "frequency_encode", "group_deviation", "percent_rank_avg",
    "rolling_features_keyed", "cumulative_features", "split_ordered", "detect_drift", "forecast_job",
    "csv_round_trip", "text_counts", "keywords", "tfidf", "similar_pairs", "connected_components", "cluster_kmeans", "train_logistic_classifier",
)


def main() -> None:
    path = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    entries.load_all()
    spark = session(
        "bench", f"local[{cpus}]", spark__ui__enabled="false", spark__sql__shuffle__partitions=cpus, spark__driver__memory="16g"
    )
    spark.sparkContext.setLogLevel("OFF")
    spark.read.parquet(f"{path}/lineitem.parquet").groupBy("l_returnflag").count().collect()
    spent = {}
    for name in names:
        start = time.perf_counter()
        entries.QUERIES[name](spark, path).write.format("noop").mode("overwrite").save()
        spent[name] = round(time.perf_counter() - start, 3)
        print(name, spent[name], file=sys.stderr, flush=True)
    total = round(sum(spent.values()), 3)
    print(json.dumps({"metric": "headline_total", "value": total, "unit": "sec", "queries": spent, "sf": os.path.basename(path.rstrip("/"))}))


if __name__ == "__main__":
    main()
