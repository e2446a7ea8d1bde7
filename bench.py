"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from lodestone.plans import load  # noqa: E402
from lodestone.runtime import local_session  # noqa: E402

HEADLINE = ["keyword_index", "search_keyword_topk", "search_semantic_topk", "search_hybrid_topk", "search_reranked_topk", "search_cross_collection", "search_filtered", "related_objects", "knn_cross_reference", "stats_grouped", "stats_counts", "upsert_latest_wins", "upsert_merge", "report_parent_child", "history_last_n", "session_ttl_gaps", "single_active_guard", "job_latest_status", "concept_shared_pairs", "object_ids_uuid5", "slugify_titles", "html_gate", "annotate_documents"]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session("bench", os.environ.get("BENCH_CPUS", "8"))
    queries, _ = load()
    took = {}
    for name in HEADLINE:
        runs = []
        for _ in range(int(os.environ.get("BENCH_RUNS", "3"))):
            began = time.perf_counter()
            queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - began)
        took[name] = round(sorted(runs)[len(runs) // 2], 4)
    print(json.dumps({"metric": "sum of median seconds of the headline queries", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": Path(sf_dir).name.removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
