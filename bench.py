"""Times the headline queries on $BENCH_SF_DIR with $BENCH_CPUS cores and prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from spanguard.plans.queries import QUERIES
from spanguard.session import local_session

HEADLINE = [
    "email_spans", "ip_spans", "arbitrated_spans", "registered_hits", "lexicon_hits", "combined_spans", "policy_eval",
    "final_spans", "redacted_documents", "content_summary", "review_page", "overview_statistics", "model_summary",
    "stage_times", "turn_chain", "replay_split", "dedup_hits", "dedup_usage", "bioes_spans", "viterbi_spans",
    "window_reconcile", "collect_responses", "redacted_requests", "policy_backtest",
]


def run(spark, name: str, directory: str) -> float:
    started = time.perf_counter()
    QUERIES[name](spark, directory).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - started


def main() -> None:
    directory = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 8))
    spark = local_session(cores, partitions=int(cores) if cores.isdigit() else 8)
    run(spark, "redacted_documents", directory)  # warm-up: JVM, code generation, file cache
    seconds = {name: round(run(spark, name, directory), 3) for name in HEADLINE}
    total = round(sum(seconds.values()), 3)
    print(json.dumps({"metric": "total_query_time", "value": total, "unit": "sec", "queries": seconds, "sf": os.path.basename(directory.rstrip("/"))}))


if __name__ == "__main__":
    main()
