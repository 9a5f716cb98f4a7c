"""Time the headline queries and print one JSON line.

``BENCH_SF_DIR`` (default sf0.1) and ``BENCH_CPUS`` (default 8) choose data and cores; names as arguments choose queries.
Every query is run in full into a sink that drops the rows.
"""

from __future__ import annotations

import json
import os
import sys
import time

from larkspur.plans.registry import all_queries
from larkspur.session import build_session

HEADLINE = [
    "normalise_articles", "dq_report_articles", "curate_trials", "ingest_roundtrip", "latest_per_key", "duplicate_keys",
    "article_stats", "trial_stats", "feature_lookup_batch", "features_as_of", "outcome_distribution", "outcome_quantiles",
    "sections", "entity_mentions", "cooccurrence", "index_documents", "vector_topk", "search_filters", "answers", "manifests",
    "timeline_steps", "slo_success", "latency_quantiles", "slo_status", "stream_slo",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "bench", f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false", "spark.driver.memory": "16g",
            "spark.ui.showConsoleProgress": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{sf_dir}/region.parquet").count()
    queries = all_queries()
    seconds = {}
    for name in sys.argv[1:] or HEADLINE:
        start = time.perf_counter()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    total = round(sum(seconds.values()), 3)
    print(json.dumps({"metric": "headline_queries_total", "value": total, "unit": "sec", "queries": seconds, "sf": os.path.basename(sf_dir).removeprefix("sf")}))


if __name__ == "__main__":
    main()
