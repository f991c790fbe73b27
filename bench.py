"""Time the headline queries and print one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8) choose data and cores.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from analystry.registry import QUERIES  # noqa: E402
from analystry.session import build_session  # noqa: E402

HEADLINE = [
    "top_customers", "group_sum", "pivot_count", "quantiles", "winsorize", "ks_stats", "auc", "woe_iv", "ks_panel",
    "corr_matrix", "histogram_100", "mahalanobis", "rank_bin", "sort_permutation", "echo_shift_per_user", "poi_rank_by_impact",
    "quadrant_points", "nearest_distances", "city_table", "jsonp_posts", "char_ngrams", "tfidf_word_ngrams", "chi2_terms",
    "html_unescape", "term_index", "model_ridge", "model_linear_svm", "model_ada_boost", "answers_sink",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session("bench", cores=cpus, memory="12g", shuffle_partitions=int(cpus))
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{sf_dir}/nation.parquet").count()  # start the executors before timing
    seconds = {}
    for name in HEADLINE:
        start = time.time()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.time() - start, 3)
    spark.stop()
    print(json.dumps({"metric": "headline_total", "value": round(sum(seconds.values()), 3), "unit": "sec",
                      "queries": seconds, "sf": os.path.basename(sf_dir.rstrip("/")), "cpus": cpus}))


if __name__ == "__main__":
    main()
