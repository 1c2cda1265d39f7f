"""Times the headline queries and prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS choose data and cores.  Each
query is run once to warm up (on the smallest tables) and once timed, its whole result
written to a no-op sink.
"""

import json
import os
import time

from pyspark.sql import SparkSession

from tessera import queries

HEADLINE = ["parent_chunks", "child_windows", "hash_embedding", "bm25_terms", "bm25_topk", "vector_topk", "hash_vector_topk", "full_prompts", "html_strip", "index_plan", "eval_metrics"]


def main() -> None:
    sf, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", str(2 * int(cpus))).config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "12g").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    warm = "/root/testdata/sf0.001"
    took = {}
    for name in HEADLINE:
        query = queries.queries()[name]
        if os.path.isdir(warm):
            query(spark, warm).write.format("noop").mode("overwrite").save()
        began = time.time()
        query(spark, sf).write.format("noop").mode("overwrite").save()
        took[name] = round(time.time() - began, 3)
        spark.catalog.clearCache()
    print(json.dumps({"metric": "total_query_seconds", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": sf.rsplit("sf", 1)[-1]}))


if __name__ == "__main__":
    main()
