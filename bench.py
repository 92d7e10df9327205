"""Times the headline queries and prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

HEADLINE = [
    "queue_history", "queue_runs", "queue_page", "listing_detail", "pending_cases", "confirmed_export",
    "listing_state", "persist_balance", "content_changes", "unique_documents",
    "run_stats", "report_ads", "report_headers",
    "eval_quality", "eval_levels", "score_stats", "score_histogram",
    "url_scope", "page_links", "next_frontier", "action_budget",
    "html_text", "term_filter", "prefix_search", "search_terms", "price_tolerant",
    "product_ads", "detail_ads", "selector_fields", "break_rate",
    "score_responses", "explored_ads", "score_keywords",
    "rule_topk", "rule_topk_blocked", "markdown_rules",
    "seal_chain", "verify_chain", "session_log",
    "registry_merge", "extractor_states", "stream_state",
    "report_documents", "search_terms_joined", "surveillance_ads", "action_events", "sealed_actions",
]


def main() -> None:
    sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
    import workload
    from adwatch.session import local_session

    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    workload.load_all()
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), "adwatch-bench")
    for table in ("events", "documents"):  # start the JVM's readers and one Python worker before timing
        spark.read.parquet(f"{folder}/{table}.parquet").limit(10).collect()
    spark.range(8).mapInArrow(lambda batches: batches, "id long").count()
    times = {}
    for name in sys.argv[1:] or HEADLINE:
        started = time.perf_counter()
        workload.QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - started, 3)
    print(json.dumps({
        "metric": "headline queries, wall time", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
        "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
