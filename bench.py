"""Times the headline queries and prints one JSON line.

``BENCH_SF_DIR`` names the tables, ``BENCH_CPUS`` the cores.  Every query runs
whole, from reading the tables to its last result row, ``BENCH_RUNS`` times
(default 2); the fastest run counts, so code generation is not what is measured.
Nothing is cached between runs.
"""

from __future__ import annotations

import json
import os
import sys
import time

from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from checks.queries import REGISTERED  # noqa: E402
from negmine.shipping import ship  # noqa: E402
from negmine.staging import stage_scope  # noqa: E402

HEADLINE = [
    "read_corpus", "validate_corpus", "extract_text", "with_doc_index",
    "build_query_requests", "query_doc_pairs", "term_freq", "term_stats",
    "bm25_topk", "bm25_topk_block", "mine_bm25_negatives", "zero_score_padding",
    "vector_topk", "knn_blocked", "knn_lsh", "mine_semantic_negatives",
    "encode", "score_samples", "rank_rest", "distillation_rows", "distill_loss",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    ship(spark)
    spark.range(1000).selectExpr("sum(id)").collect()  # session start is not measured
    seconds = {}
    for name in names:
        taken = []
        for _ in range(int(os.environ.get("BENCH_RUNS", "2"))):
            with stage_scope(spark):
                started = time.perf_counter()
                REGISTERED[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
                taken.append(round(time.perf_counter() - started, 3))
        seconds[name] = min(taken)
        print(f"{name}: {taken}", file=sys.stderr, flush=True)
    spark.stop()
    print(json.dumps({"metric": "total_wall_clock", "value": round(sum(seconds.values()), 3), "unit": "sec",
                      "queries": seconds, "sf": sf_dir.rsplit("sf", 1)[-1]}))


if __name__ == "__main__":
    main()
