"""Times the headline queries and prints one line of JSON."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from nearfield.plans import queries as plans  # noqa: E402
from nearfield.session import session  # noqa: E402

HEADLINES = ("fused_mean_topk", "fused_weighted_topk", "candidate_rerank", "multi_query_mean", "cosine_topk", "chi2_topk", "hamming_topk", "knn_self_included", "knn_self_excluded", "signkey_knn", "ann_rerank", "catalog_upsert", "overlap_at_k", "label_knn_vote")


def main() -> None:
    sf, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = session(f"local[{cpus}]", "bench", **{"spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false", "spark.driver.memory": "6g", "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    all_ = plans.queries()
    run = lambda name: all_[name](spark, sf).write.format("noop").mode("overwrite").save()
    for _ in range(2):  # warm-up
        run("fused_mean_topk")
    took = {}
    for name in HEADLINES:
        times = []
        for _ in range(3):
            begin = time.perf_counter()
            run(name)
            times.append(time.perf_counter() - begin)
        took[name] = round(sorted(times)[1], 4)
    print(json.dumps({"metric": "median seconds of headline queries, summed", "value": round(sum(took.values()), 4), "unit": "sec", "queries": took, "sf": os.path.basename(sf.rstrip("/"))}))


if __name__ == "__main__":
    main()
