"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import re
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from gradeloom.catalog import QUERIES  # noqa: E402
from gradeloom.session import local_session  # noqa: E402
from gradeloom.sources.staging import clear_staged  # noqa: E402

HEADLINE = [
    "preprocessed_text", "text_features", "spelling_errors", "gram_counts", "top_grams",
    "bigram_similarity", "set_similarity", "content_similarity", "bell_curve_grades",
    "filled_essays", "encoded_essays", "stratified_split", "weighted_kappa", "class_report",
    "nearest_neighbours", "neighbour_grades", "describe_lineitem", "lineitem_correlations",
    "price_histogram", "baseline_run", "main_run", "experiment_run", "penalised_logistic_grades",
    "csv_scan",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    names = sys.argv[1:] or HEADLINE
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), "gradeloom-bench")
    # Start the engine and the Python workers; not timed.
    spark.range(1000).mapInPandas(lambda batches: batches, "id long").count()
    seconds = {}
    for name in names:
        begin = time.time()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.time() - begin, 3)
        clear_staged(spark)
        print(f"{name} {seconds[name]}", file=sys.stderr, flush=True)
    scale = re.search(r"sf([0-9.]+)", folder)
    print(json.dumps({
        "metric": "total_query_time", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": float(scale.group(1)) if scale else None}))
    spark.stop()


if __name__ == "__main__":
    main()
