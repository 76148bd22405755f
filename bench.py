"""Benchmark the headline queries; prints ONE JSON line.

env: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8),
     BENCH_QUERIES (optional comma list to override the headline set).
Each query is fully executed with the no-op sink (nothing is collected),
twice: cold (first run) and warm; the headline value is the warm total.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "feature_panel",
    "sentiment_daily_mean",
    "sentiment_firm_day",
    "news_dedupe_capped",
    "news_ticker_mentions",
    "prices_indicators",
    "prices_latest",
    "novelty_firm_day",
    "novelty_text_firm_day",
    "aspect_scores",
    "aspect_firm_day_weighted",
    "filing_index_8k",
    "filing_sections",
    "clean_pages",
    "tfidf_trigrams",
    "fama_macbeth",
    "cluster_bootstrap",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    names = [q for q in os.environ.get("BENCH_QUERIES", "").split(",") if q] or HEADLINE

    from tidemark.plans.catalog import QUERIES
    from tidemark.session import build_session

    spark = build_session(f"local[{cpus}]", max(cpus * 2, 8), app_name="tidemark-bench")
    # the benchmark's files hold one row group each, which a scan cannot split
    spark.conf.set("tidemark.input.partitions", str(cpus))
    # warm the JVM and the parquet reader once (not timed)
    QUERIES["prices_latest"](spark, sf_dir).write.format("noop").mode("overwrite").save()

    # each query runs twice: the first (cold) run includes one-time costs —
    # Janino compilation of the generated code and JIT warm-up — that a
    # cluster pays once per stage, not per byte; the second (warm) run is the
    # steady-state cost.  Both are reported; the headline value is warm.
    cold, warm = {}, {}
    for name in names:
        for bucket in (cold, warm):
            t0 = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            bucket[name] = round(time.perf_counter() - t0, 3)
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(json.dumps({"metric": "headline_queries_total_warm", "value": round(sum(warm.values()), 3),
                      "unit": "sec", "queries": warm, "sf": sf, "cpus": cpus,
                      "cold_total": round(sum(cold.values()), 3), "cold_queries": cold}))
    spark.stop()


if __name__ == "__main__":
    main()
