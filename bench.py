"""Times the headline queries and prints one JSON line.

BENCH_SF_DIR and BENCH_CPUS choose data and cores.  Every query starts from
the given tables: shared intermediate tables are forgotten before each one.
"""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession

from catalog import queries as registry

HEADLINE = ["classify_text", "classify", "classify_fast", "seed_hits_text", "ref_kmers_text", "posting_summary", "duplicate_queries"]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    # One small run first, so that start-up is not charged to the first query.
    registry.QUERIES["classify_text"](spark, sf_dir.rsplit("/", 1)[0] + "/sf0.001").write.format("noop").mode("overwrite").save()
    seconds = {}
    for name in HEADLINE:
        registry.clear_stages()
        start = time.perf_counter()
        registry.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    scale = sf_dir.rsplit("sf", 1)[-1]
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": float(scale) if scale.replace(".", "", 1).isdigit() else scale,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
