"""Runs the headline queries over the tables in $BENCH_SF_DIR on local[$BENCH_CPUS] and prints one JSON line."""

import json
import os
import tempfile
import time

from pyspark.sql import SparkSession

from lastrum.plans import price_queries, text_queries, usage_queries

QUERIES = {name: f for module in (price_queries, text_queries, usage_queries) for name, f in module.registry.queries.items()}
#: Listing, trends, comparison, catalogue, statistics, inflation, alerts, texts, duplicates and search.
HEADLINES = """q_price_listing_page q_price_count q_state_rank q_trend_monthly q_dashboard_kpis q_kpis_by_state q_municipal_cube q_item_history
q_stats_by_category q_outliers_iqr q_reference_price q_sample_quality q_corrected_prices q_price_alerts_b q_classify q_dedup_rate q_consolidate_sources
q_tfidf_weights q_semantic_topk q_fulltext q_hybrid q_latency_percentiles q_usage_metering q_rate_limit""".split()


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("bench")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.checkpoint.dir", f"file://{tempfile.mkdtemp(prefix='spark-', dir='/tmp')}")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    price_queries.q_state_rank(spark, sf_dir).collect()  # starts the JVM's compilers
    took = {}
    for name in HEADLINES:
        began = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        took[name] = round(time.perf_counter() - began, 3)
    print(json.dumps({"metric": "total_seconds_of_headline_queries", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
