"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from lectern.plans import registry  # noqa: E402
from lectern.plans.base import corpus  # noqa: E402
from lectern.operators.keyword import write_index  # noqa: E402
from lectern.session import session, work_path  # noqa: E402

HEADLINE = [
    "bm25_topk", "dense_topk", "hybrid_rrf", "multi_collection", "rerank_topn", "kg_expand", "term_graph", "hit_at_k", "hit_by_group",
    "silver_labels", "token_windows", "enrich_chunks", "pack_segments", "merge_tables", "greedy_chunks", "duplicate_groups", "qa_checks",
    "metric_by_group", "chunk_profile", "incremental_ingest", "upsert_chunks", "repeat_query_dedup", "resample",
]


def timed(run) -> float:
    t = time.time()
    run().write.format("noop").mode("overwrite").save()
    return round(time.time() - t, 3)


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = session(
        "lectern-bench", f"local[{cpus}]",
        **{"spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false", "spark.driver.memory": "16g", "spark.ui.showConsoleProgress": "false"},
    )
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{sf}/documents.parquet").limit(1).count()
    times = {}
    t = time.time()
    write_index(corpus(spark, sf), work_path(spark, "bench-index"))
    times["build_index"] = round(time.time() - t, 3)
    known = registry()
    known["bm25_topk"][0](spark, sf).limit(1).count()  # the stored index is made on first use
    for name in HEADLINE:
        times[name] = timed(lambda: known[name][0](spark, sf))
    n = spark.read.parquet(f"{sf}/benchmark.parquet").count()
    print(
        json.dumps(
            {
                "metric": "headline_total_seconds", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": sf.rstrip("/").rsplit("sf", 1)[-1],
                "queries_per_second": {q: round(n / times[q], 2) for q in ("bm25_topk", "hybrid_rrf", "rerank_topn", "kg_expand")},
            }
        )
    )


if __name__ == "__main__":
    main()
