"""Time the headline queries and print one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default all cores)
choose the data and the cores.  Each query runs once to warm up, then
BENCH_RUNS times (default 3); the median counts.  Results go to a sink that
evaluates every column and keeps nothing.
"""

from __future__ import annotations

import json
import os
import statistics
import time

from pyspark.sql import SparkSession

import workloads

HEADLINE = (
    "facts", "prose_facts", "table_cells", "combined_text", "ratio_metrics", "embed_text",
    "keyword_repair", "keyword_fuzzy", "plan_targets", "dispatch_rows",
    "knn_batch", "knn_batch_partitioned", "knn_lsh", "context_text",
    "request_dedupe", "tool_policy", "turn_actions", "collect_results", "group_complete",
)


def session(cpus: int) -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("factloom-bench")
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "12g"))
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def seconds(query, spark: SparkSession, sf: str) -> float:
    start = time.perf_counter()
    query(spark, sf).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def recall(spark: SparkSession, sf: str, queries) -> float:
    """Share of the exact neighbours that the approximate lookup finds."""
    exact = queries["knn_batch"](spark, sf).select("request_id", "id")
    near = queries["knn_lsh"](spark, sf).select("request_id", "id")
    return exact.join(near, ["request_id", "id"]).count() / exact.count()


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = int(os.environ.get("BENCH_CPUS", os.cpu_count() or 8))
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    spark = session(cpus)
    queries = workloads.queries()
    times = {}
    for name in HEADLINE:
        seconds(queries[name], spark, sf)
        times[name] = round(
            statistics.median(seconds(queries[name], spark, sf) for _ in range(runs)), 3
        )

    def rows(table: str) -> int:
        return spark.read.parquet(f"{sf}/{table}.parquet").count()

    rates = {
        "statements_per_sec": rows("customer") / times["facts"],
        "facts_per_sec": queries["facts"](spark, sf).count() / times["facts"],
        "prose_documents_per_sec": rows("documents") / times["prose_facts"],
        "keywords_per_sec": 18 * rows("part") / times["keyword_repair"],
        "exact_lookups_per_sec": rows("embeddings") / times["knn_batch"],
        "approximate_lookups_per_sec": rows("embeddings") / times["knn_lsh"],
        "approximate_recall_at_5": recall(spark, sf, queries),
        "turns_per_sec": rows("conversations") / times["turn_actions"],
    }
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": sf.rsplit("sf", 1)[-1],
                "cpus": cpus,
                "runs": runs,
                "rates": {k: round(v, 3) for k, v in rates.items()},
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
