"""Time the headline queries: prints one JSON line.

BENCH_SF_DIR names the tables (default sf0.1), BENCH_CPUS the cores, BENCH_QUERIES a comma list of
query names to run in place of the headline ones.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from quire.plans import registered  # noqa: E402
from quire.session import build_session, use_local_folder  # noqa: E402

HEADLINE = [
    "clean_text", "normalize_text", "split_sentences", "chunk_tokens", "chunk_paragraphs", "scan_document_text", "src_documents",
    "vector_search", "keyword_search", "context_window", "extract_entities", "mention_edges", "document_entities",
    "related_shared_entity_1hop", "infer_related_concepts", "kb_dependency_closure", "link_chunks_to_sections", "course_structure",
    "delete_document_cascade", "similar_documents", "match_citations", "search_analytics", "kb_stats", "library_upsert", "library_bulk",
    "detect_chapters", "merged_text", "reconstruct_lines", "make_embedding_batches", "infer_document_relations", "related_shared_entity_2hop",
]
# a query this quick is run three times, and the median counts
QUICK_SECONDS = 3


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "bench", f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": str(2 * int(cpus)) if cpus.isdigit() else "16",
            "spark.driver.memory": os.environ.get("BENCH_MEMORY", "8g"),
            # the test files are small: as many splits as cores
            "spark.sql.files.maxPartitionBytes": "4m",
            "spark.sql.files.openCostInBytes": "256k",
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    use_local_folder(spark)
    queries = registered()
    names = [n for n in os.environ.get("BENCH_QUERIES", "").split(",") if n] or HEADLINE
    # start the JVM and the Python workers outside the clock
    spark.range(1000).mapInPandas(lambda batches: batches, "id long").count()
    times = {}
    for name in names:
        runs: list[float] = []
        while len(runs) < 3 and (not runs or runs[0] < QUICK_SECONDS):
            start = time.perf_counter()
            queries[name](spark, folder).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - start)
        times[name] = round(statistics.median(runs), 3)
    print(json.dumps({
        "metric": "headline queries, total time", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
        "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"), "cpus": cpus,
    }))
    spark.stop()


if __name__ == "__main__":
    main()
