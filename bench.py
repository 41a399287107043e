"""Runs the headline queries at ``$BENCH_SF_DIR`` on ``local[$BENCH_CPUS]`` and prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from tabwright.catalog import all_queries
from tabwright.session import local_session

HEADLINE = (
    "feature_types", "issues_all", "issues_lines", "profile_table", "summary_stats", "missing_by_column",
    "correlation_matrix", "histogram", "eda_outliers_lines", "top_categories", "duplicate_documents",
    "impute_median", "impute_mode", "outlier_cap", "undersample", "oversample", "stratified_split", "stratified_folds",
    "scale_standard", "encode_onehot", "encode_ordinal", "transform_full", "roc_auc", "pr_curve", "metrics_multi",
    "knn_predict", "gnb_predict", "oner_predict", "model_dt", "model_lr", "model_nb", "model_rf", "leaderboard",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(int(os.environ.get("BENCH_CPUS", os.cpu_count() or 4)), "bench")
    spark.sparkContext.setLogLevel("ERROR")
    registered = all_queries()
    registered["class_distribution"](spark, folder).collect()  # starts the engine; not timed
    seconds = {}
    for name in HEADLINE:
        started = time.monotonic()
        registered[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.monotonic() - started, 3)
    spark.stop()
    scale = os.path.basename(folder.rstrip("/")).removeprefix("sf")
    print(json.dumps({"metric": "total_time", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": float(scale)}))


if __name__ == "__main__":
    main()
