"""Evaluation harness: several setups over one corpus and question set, and reports."""

from __future__ import annotations

import logging
from collections.abc import Sequence
from datetime import datetime, timezone
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankloom.config import get_config
from rankloom.plans.evaluation import RunEvaluation, compare_runs, evaluate_run
from rankloom.plans.setups import (
    AblationCell,
    RetrievalSetup,
    SharedIndexes,
    ablation_grid,
    default_setups,
    make_setup,
    timed_run,
)
from rankloom.runtime import materialize, scratch_scope
from rankloom.sources import reports
from rankloom.sources.jsonl import qrels_of

log = logging.getLogger(__name__)


def select_setups(names: Sequence[str] | None, available: Sequence[RetrievalSetup] | None = None) -> list[RetrievalSetup]:
    """Setups by name in the order asked for; all of them for None."""
    known = {setup.name: setup for setup in (available or default_setups())}
    wanted = list(known) if names is None else list(names)
    unknown = [name for name in wanted if name not in known]
    if unknown:
        raise ValueError(f"Unknown setups {unknown}; available: {list(known)}")
    return [known[name] for name in wanted]


def evaluate_setup(setup: RetrievalSetup, shared: SharedIndexes, questions: DataFrame, qrels: DataFrame,
                   k: int, rerank_top_k: int) -> RunEvaluation:
    built = setup.build(shared.corpus, shared)  # index time is not part of the latency
    queries = questions.select("qid", "question")
    run, latencies = timed_run(built, queries, k, rerank_top_k)
    return evaluate_run(run, questions, qrels, submitted=latencies)


def _evaluate_all(setups: Sequence[RetrievalSetup], corpus: DataFrame, questions: DataFrame, k: int,
                  rerank_top_k: int) -> dict[str, RunEvaluation]:
    """Evaluation per setup; one that fails is logged and left out."""
    shared = SharedIndexes(corpus)
    questions = materialize(questions, "questions")
    qrels = qrels_of(questions)
    done = {}
    for setup in setups:
        try:
            done[setup.name] = evaluate_setup(setup, shared, questions, qrels, k, rerank_top_k)
        except Exception:
            log.exception("Setup %s failed; it is skipped.", setup.name)
    if not done:
        raise RuntimeError("Every setup failed.")
    return done


def run_harness(corpus: DataFrame, questions: DataFrame, out_dir: str, names: Sequence[str] | None = None,
                k: int = 10, setups: Sequence[RetrievalSetup] | None = None) -> dict[str, Any]:
    """Evaluate setups, compare each with the first that finished, and write the reports; chunks, indexes and runs go.

    delta is reference minus other, so a negative delta favours the other setup.
    """
    config = get_config()
    chosen = select_setups(names, setups)
    with scratch_scope(corpus.sparkSession):
        done = _evaluate_all(chosen, corpus, questions, k, config.rerank_top_k)
        reference = next(iter(done))
        comparisons = {
            name: compare_runs(done[reference].per_query, ev.per_query, "ndcg@5")
            for name, ev in done.items() if name != reference
        }
        results = {name: {"summary": ev.summary_dict(), "latency": ev.latency, "n_queries": ev.n_queries}
                   for name, ev in done.items()}
    metadata = {
        "timestamp": datetime.now(timezone.utc).isoformat(),
        "n_docs": corpus.count(),
        "n_questions": questions.count(),
        "k": k,
        "pipelines_requested": [setup.name for setup in chosen],
        "pipelines_completed": list(done),
        "reference_pipeline": reference,
        "embedding_model": config.embedding_model_name,
        "reranker_model": config.reranker_model_name,
    }
    reports.write_results_json(f"{out_dir}/results.json", results, comparisons, metadata)
    reports.write_text(f"{out_dir}/RESULTS.md", reports.results_markdown(results, comparisons, reference))
    print(reports.console_table(results, comparisons, reference))
    return {"results": results, "comparisons": comparisons, "metadata": metadata}


ABLATION_SCHEMA = ("label string, chunker string, retriever string, rerank boolean, "
                   + ", ".join(f"{m}_{part} double" for m in ("ndcg5", "recall5", "mrr")
                               for part in ("mean", "lo", "hi")) + ", p50_ms double")


def _ablation_row(cell: AblationCell, ev: RunEvaluation) -> tuple:
    summary = ev.summary_dict()
    values = [summary[metric][key] for metric in ("ndcg@5", "recall@5", "mrr")
              for key in ("mean", "ci_lo", "ci_hi")]
    return (cell.label, cell.chunker, cell.retriever, cell.rerank, *values, ev.latency["p50_ms"])


def run_ablation(spark: SparkSession, corpus: DataFrame, questions: DataFrame, out_dir: str,
                 grid: Sequence[AblationCell] | None = None) -> DataFrame:
    """Evaluate the grid at k = 10, best nDCG@5 first; chunks and indexes are shared by its cells."""
    cells = list(grid or ablation_grid())
    setups = [make_setup(cell.label, cell.chunker, cell.retriever, cell.rerank) for cell in cells]
    with scratch_scope(spark):
        done = _evaluate_all(setups, corpus, questions, 10, get_config().rerank_top_k)
        rows = [_ablation_row(cell, done[cell.label]) for cell in cells if cell.label in done]
    ranked = spark.createDataFrame(rows, ABLATION_SCHEMA).orderBy(F.desc("ndcg5_mean"), "label")
    reports.write_csv(ranked, f"{out_dir}/ablation.csv")
    reports.write_text(f"{out_dir}/ABLATION.md",
                       reports.ablation_markdown([row.asDict() for row in ranked.collect()]))
    return ranked
