"""Times the headline queries; prints one JSON line. BENCH_SF_DIR and BENCH_CPUS set the tables and the cores."""

import json
import os
import sys
import time

ROOT = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = ROOT + os.pathsep + os.environ.get("PYTHONPATH", "")

HEADLINE = ("pricing_summary", "filter_project", "group_by_type", "max_by_customer", "top_orders", "lookup_join", "event_ranks", "price_statistics", "price_histogram", "string_cases", "geography", "json_fields", "word_counts", "event_distances", "bm25_search", "object_changes")


def main() -> None:
    from pyspark.sql import SparkSession

    from jotspark.plans.catalog import QUERIES

    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    took = {}
    for name in HEADLINE:
        run = lambda name=name: QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        run()  # compiles
        began = time.time()
        run()
        took[name] = round(time.time() - began, 3)
    print(json.dumps({"metric": "headline_total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": sf_dir.rpartition("sf")[2]}))


if __name__ == "__main__":
    main()
