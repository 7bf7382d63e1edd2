"""Time the headline queries: prints one JSON line.

A query's time is the median of three runs. Indexes that searches read are written first; each is timed by
itself and counts in the total.

BENCH_SF_DIR is the data folder, BENCH_CPUS the number of local cores, BENCH_QUERIES an optional
comma-separated list of names.
"""

from __future__ import annotations

import json
import os
import sys
import time
import uuid

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from curul.plans import QUERIES, indexes
from curul.session import local_session

HEADLINE = (
    "scorecard",
    "duplicate_clusters",
    "duplicate_merge_plan",
    "duplicate_merge_pairs",
    "author_variants",
    "safe_author_merges",
    "primary_source_rebalance",
    "status_event_mismatch",
    "status_backfill",
    "source_conflicts",
    "commission_assignments",
    "matched_records",
    "listing_filtered",
    "listing_constrained",
    "keyword_search",
    "topic_search",
    "author_search",
    "vector_topk",
    "detail",
    "timeline",
    "chunk_documents",
    "normalized_documents",
    "page_links",
    "upsert_update",
)


RUNS = 3
#: The indexes that a query reads.
READS = {"keyword_search": ("documents",), "topic_search": ("titles",), "author_search": ("names",), "vector_recall": ("vectors",)}


def timed(run) -> float:
    started = time.perf_counter()
    run()
    return round(time.perf_counter() - started, 3)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    names = os.environ.get("BENCH_QUERIES")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), app="curul-bench")
    took = {}
    spark.read.parquet(f"{folder}/orders.parquet").groupBy("o_orderstatus").count().collect()
    wanted = names.split(",") if names else HEADLINE
    indexes.EDITION = uuid.uuid4().hex  # no index of an earlier run is used
    for name, make in indexes.MAKERS.items():
        if any(name in READS.get(query, ()) for query in wanted):
            took[f"write index: {name}"] = timed(lambda make=make: make(spark, folder))
    for name in wanted:
        run = lambda name=name: QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        took[name] = sorted(timed(run) for _ in range(RUNS))[RUNS // 2]
    scale = os.path.basename(folder.rstrip("/")).removeprefix("sf")
    print(
        json.dumps(
            {"metric": "headline queries, total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": scale}
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
