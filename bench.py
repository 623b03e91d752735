"""Times the headline queries and prints one JSON line.

BENCH_SF_DIR names the tables (default /root/testdata/sf0.1), BENCH_CPUS the local cores (default 8).
Each query's whole result is computed into Spark's ``noop`` sink, after one warm-up query.
"""

from __future__ import annotations

import json
import os
import re
import time

from pyspark.sql import SparkSession

from segrec import catalog

#: All users' explained top-10, a training window's features, scorers, metrics, audits and clustering.
HEADLINE = (
    "q1_recommend", "r2_global_popularity", "r4_content_based", "r5_item_item", "r11_w8_preference_match", "r12_hybrid", "r13_tiered",
    "m11_by_tier", "a9_user_features", "a8_category_profile", "a6_user_entropy", "v19_report", "w1_last_flag", "j13_item_similarity",
    "st2_chi_square_independence", "ml5_kmeans_segments", "ml6_nearest_centroid",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    catalog.QUERIES["a10_item_popularity"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    times = {}
    for name in HEADLINE:
        began = time.perf_counter()
        catalog.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - began, 3)
    found = re.search(r"sf([\d.]+)", sf_dir)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": float(found[1].rstrip(".")) if found else None}))
    spark.stop()


if __name__ == "__main__":
    main()
