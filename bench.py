"""Headline timings: prints one JSON line.

Indexes are built first and timed on their own (``index_*``, cold), as search latency
never includes them.  Every other number is one full batch of questions with the results
written out, timed on its second run so that start-up and code generation do not count.
"""

from __future__ import annotations

import json
import os
import time

from catalog.fixtures import SENTENCES, fixtures
from catalog.queries import queries
from rankloom.runtime import build_session

FOLDER = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
HEADLINE = (
    "index_tokens", "fixed_chunks", "sentence_window_chunks",
    "bm25_search", "dense_search", "hybrid_rrf", "hybrid_weighted", "bm25_rm3_search",
    "rerank_hybrid", "bm25_sentence_windows", "dense_embeddings",
    "extractive_answers", "faithfulness", "metrics_per_question", "run_summary", "bootstrap_intervals",
)


def timed(action) -> float:
    start = time.perf_counter()
    action()
    return round(time.perf_counter() - start, 3)


def main() -> None:
    spark = build_session(
        "bench", f"local[{CPUS}]",
        **{"spark.sql.shuffle.partitions": str(2 * int(CPUS)), "spark.driver.memory": "16g"})
    spark.sparkContext.setLogLevel("ERROR")
    fx = fixtures(spark, FOLDER)
    seconds = {
        "index_chunks": timed(fx.chunks),
        "index_bm25": timed(fx.bm25),
        "index_dense": timed(fx.dense),
        "index_bm25_sentences": timed(lambda: fx.bm25(SENTENCES)),
        "relevance": timed(lambda: fx.qrels),
    }
    registered = queries()
    for name in HEADLINE:
        for _ in range(2):
            seconds[name] = timed(
                lambda: registered[name](spark, FOLDER).write.format("noop").mode("overwrite").save())
    n_questions = fx.questions.count()
    per_question = {name: round(1000 * seconds[name] / n_questions, 3)
                    for name in ("bm25_search", "dense_search", "hybrid_rrf", "rerank_hybrid")}
    print(json.dumps({
        "metric": "headline_total", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": os.path.basename(FOLDER.rstrip("/")),
        "questions": n_questions, "ms_per_question": per_question,
    }))


if __name__ == "__main__":
    main()
