"""Time the headline queries on the local machine and print one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8) choose input and cores.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from pyspark.sql import SparkSession  # noqa: E402

from corpuskit import plans, runtime  # noqa: E402

HEADLINE = (
    "hybrid_topk keyword_topk vector_topk knowledge_search memory_search search_documents chat_retrieval "
    "hash_embedding simhash64 simhash_pairs dedup_simhash_greedy dedup_exact duplicate_reasons "
    "clean_html curate_pages web_citations chunk_text window_chunks extract_keywords ingest_corpus "
    "ingest_user_documents split_markdown_sections build_section_nodes concept_neighbors subtree_chunks "
    "conversation_rounds short_term_window tokenize keyword_score document_listing upsert_chunks append_idempotent"
).split()


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("corpuskit-bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.files.maxPartitionBytes", "4m")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    queries = plans.queries()
    chosen = sys.argv[1:] or HEADLINE
    for warm in ("url_host", "hash_embedding"):  # compiled code, and the Python workers
        queries[warm](spark, sf).write.format("noop").mode("overwrite").save()
    times = {}
    for name in chosen:
        start = time.perf_counter()
        queries[name](spark, sf).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
        runtime.release(spark)
        print(f"{name} {times[name]}", file=sys.stderr, flush=True)
    total = round(sum(times.values()), 3)
    print(json.dumps({"metric": "headline_queries_total", "value": total, "unit": "sec", "queries": times, "sf": sf}))


if __name__ == "__main__":
    main()
