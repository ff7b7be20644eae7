"""Time the headline queries and print one JSON line."""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession

from lectorium.plans import registry

HEADLINE = [
    "edition_collapse", "picky_rating_events", "work_stats", "global_priors", "user_percentiles", "user_taste", "star_curators", "pct_curators", "deep_curators", "rank_five_rate_bayes", "rank_combo_gem", "rank_cross_five", "rank_curator_pct_love",
    "similar_cosine", "ratio_gate", "duplicate_clusters", "balanced_votes", "pairwise_esteem", "conditional_esteem", "reader_bootstrap", "hits_authority", "pmi_neighbours", "early_late_contrast", "import_bursts",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("lectorium-bench")
        .config("spark.sql.shuffle.partitions", cpus).config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.driver.memory", "8g").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    queries = registry.queries()
    spark.read.parquet(f"{sf_dir}/lineitem.parquet").count()
    took = {}
    for name in HEADLINE:
        began = time.perf_counter()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        took[name] = round(time.perf_counter() - began, 3)
    print(json.dumps({"metric": "headline queries, total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(sf_dir.rstrip("/"))}))
    spark.stop()


if __name__ == "__main__":
    main()
