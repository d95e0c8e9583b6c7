"""Times the headline queries: ``$BENCH_SF_DIR``, ``local[$BENCH_CPUS]``; prints one JSON line."""

import json
import os
import time

from textmill import catalog
from textmill.session import local_session

HEADLINE = [
    "fixed_character_chunking", "fixed_token_chunking", "sliding_window_token_chunking", "sentence_group_chunking", "paragraph_group_chunking", "recursive_chunking", "parent_child_chunking",
    "semantic_embedding_based_chunking", "semantic_variance_adaptive_chunking", "topic_based_chunking", "dynamic_token_size_chunking", "content_density_adaptive_chunking", "length_aware_chunking",
    "llm_boundary_detection_chunking", "hybrid_paragraph_fixed_token_chunking", "strategy_metrics", "unique_contexts", "tfidf_vectors", "dense_topk", "judge_rows",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(int(os.environ.get("BENCH_CPUS", os.cpu_count() or 1)))
    queries = catalog.queries()
    queries["fixed_character_chunking"](spark, sf_dir).limit(1).collect()  # starts the JVM and the workers
    took = {}
    for name in HEADLINE:
        began = time.perf_counter()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        took[name] = round(time.perf_counter() - began, 3)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
