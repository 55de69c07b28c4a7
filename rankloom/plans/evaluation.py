"""Evaluating runs against relevant documents, and comparing them."""

from __future__ import annotations

import warnings
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankloom.operators import metrics as mt
from rankloom.operators import resampling as rs
from rankloom.runtime import materialize


@dataclass(frozen=True)
class RunEvaluation:
    per_query: DataFrame  # qid and one column per metric
    summary: DataFrame  # metric, mean, ci_lo, ci_hi
    latency: dict[str, float]  # p50_ms, p95_ms, mean_ms
    n_queries: int
    orphans: DataFrame  # qid: searched, but not in the question set

    def summary_dict(self) -> dict[str, dict[str, float]]:
        """A handful of rows, one per metric."""
        return {row["metric"]: {key: row[key] for key in ("mean", "ci_lo", "ci_hi")}
                for row in self.summary.collect()}


def orphan_qids(submitted: DataFrame, questions: DataFrame) -> DataFrame:
    """Question ids of a run that the question set does not know."""
    return submitted.select("qid").distinct().join(questions.select("qid"), "qid", "left_anti")


def latency_summary(latencies: DataFrame) -> dict[str, float]:
    row = mt.summarize(latencies, "latency_ms").first()
    return {"p50_ms": row["p50"], "p95_ms": row["p95"], "mean_ms": row["mean"]}


def evaluate_run(run: DataFrame, questions: DataFrame, qrels: DataFrame,
                 ks: Sequence[int] = mt.DEFAULT_KS, submitted: DataFrame | None = None) -> RunEvaluation:
    """Metrics per question, their means with bootstrap intervals, and latency percentiles.

    *submitted* lists the searched questions as (qid, latency_ms), which also covers those
    that found nothing; it defaults to the whole question set.  Questions outside the
    question set are skipped with a warning.  The bootstrap draws by the questions' place in
    the file where *questions* has a src_pos, else by qid.
    """
    submitted = submitted if submitted is not None else questions.select(
        "qid", F.lit(0.0).alias("latency_ms"))
    orphans = materialize(orphan_qids(submitted.select("qid").unionByName(run.select("qid")), questions), "orphans")
    n_orphans, first = orphans.agg(F.count("*"), F.min("qid")).first()
    if n_orphans:
        warnings.warn(f"{n_orphans} searched questions, the first {first!r}, are not in the question set; they are skipped.",
                      stacklevel=2)
    known = submitted.join(questions.select("qid").distinct(), "qid", "left_semi")
    per_query = materialize(mt.per_query_metrics(run, known, qrels, ks), "per-query")
    values, order = mt.long_metrics(per_query), "qid"
    if "src_pos" in questions.columns:
        values, order = values.join(questions.select("qid", "src_pos"), "qid"), "src_pos"
    summary = materialize(rs.bootstrap_ci(values, by=["metric"], order=order), "summary")
    return RunEvaluation(per_query, summary, latency_summary(known), per_query.count(), orphans)


def compare_all(a: DataFrame, b: DataFrame) -> DataFrame:
    """metric, n, delta = mean(a - b), p_value over the questions that two per-query tables share, all metrics in one job."""
    shared = mt.long_metrics(a).withColumnRenamed("value", "a").join(
        mt.long_metrics(b).withColumnRenamed("value", "b"), ["qid", "metric"])
    return rs.paired_permutation(shared, ["metric"])


def compare_runs(a: DataFrame, b: DataFrame, metric: str) -> dict[str, float]:
    """delta = mean(a - b), p_value and n over the questions two per-query tables share.

    A metric that a table lacks counts as 0.
    """
    def score(per_query: DataFrame, name: str) -> DataFrame:
        value = F.col(f"`{metric}`") if metric in per_query.columns else F.lit(0.0)
        return per_query.select("qid", value.alias(name))

    pairs = score(a, "a").join(score(b, "b"), "qid")
    n, delta = pairs.agg(F.count("*"), F.avg(F.col("a") - F.col("b"))).first()
    if n < 2:
        warnings.warn(f"Only {n} shared question(s) for {metric!r}; p_value is 1.", stacklevel=2)
        return {"delta": delta or 0.0, "p_value": 1.0, "n": n}
    p_value = rs.paired_permutation(pairs).first()["p_value"]
    return {"delta": delta, "p_value": p_value, "n": n}
