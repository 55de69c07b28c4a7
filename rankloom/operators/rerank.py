"""Second-stage reranking of candidates by a pair scorer."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rankloom.functions import scores as sc
from rankloom.operators.encoders import PairScorer, coverage_scorer
from rankloom.schemas import RUN_COLUMNS


def score_pairs(candidates: DataFrame, queries: DataFrame, scorer: PairScorer) -> DataFrame:
    """Candidates (run columns plus text) with the raw logit of (question, text)."""
    pairs = candidates.join(queries.select("qid", "question"), "qid")
    return pairs.withColumn("logit", scorer(F.col("question"), F.col("text")))


class PairReranker:
    """Rescores candidates with sigmoid(logit) and keeps the best *top_k*."""

    def __init__(self, scorer: PairScorer = coverage_scorer) -> None:
        self.scorer = scorer

    def rerank(self, queries: DataFrame, candidates: DataFrame, top_k: int = 5) -> DataFrame:
        order = Window.partitionBy("qid").orderBy(F.desc("score"), F.asc("chunk_id"))
        first_stage = F.when(F.coalesce("retriever", F.lit("")) == "", F.lit("unknown")).otherwise(
            F.col("retriever"))
        return (
            score_pairs(candidates, queries, self.scorer)
            .withColumn("score", sc.ranking_score(sc.sigmoid(F.col("logit"))))
            .withColumn("rank", F.row_number().over(order))
            .filter(F.col("rank") <= top_k)
            .withColumn("retriever", F.concat(F.lit("rerank("), first_stage, F.lit(")")))
            .select(*RUN_COLUMNS, "text")
        )
