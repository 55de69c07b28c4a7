"""Fusion of several ranked lists into one."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rankloom.config import get_config
from rankloom.functions import scores as sc
from rankloom.operators.retriever import Retriever, top_k

OVERFETCH = 3  # each child returns this many times k


def _stack(runs: Sequence[DataFrame]) -> DataFrame:
    tagged = [run.withColumn("child", F.lit(i)) for i, run in enumerate(runs)]
    return reduce(DataFrame.unionByName, tagged)


def fuse_rrf(runs: Sequence[DataFrame], k: int, rrf_k: int = 60) -> DataFrame:
    """Reciprocal rank fusion: sum of 1 / (rrf_k + rank); absent from a list adds nothing."""
    fused = _stack(runs).groupBy("qid", "chunk_id", "doc_id").agg(
        F.sum(sc.rrf(F.col("rank"), rrf_k)).alias("score"))
    return top_k(fused, k, "hybrid_rrf")


def fuse_weighted(runs: Sequence[DataFrame], k: int, weights: Sequence[float] | None = None) -> DataFrame:
    """Weighted sum of scores min-max scaled within each (question, list)."""
    shares = sc.normalized_weights(weights, len(runs))
    weight = F.element_at(F.array(*[F.lit(w) for w in shares]), F.col("child") + 1)
    one_list = Window.partitionBy("qid", "child")
    scaled = _stack(runs).withColumn(
        "scaled",
        sc.min_max(F.col("score"), F.min("score").over(one_list), F.max("score").over(one_list)))
    fused = scaled.groupBy("qid", "chunk_id", "doc_id").agg(
        F.sum(weight * F.col("scaled")).alias("score"))
    return top_k(fused, k, "hybrid_weighted")


class HybridRetriever(Retriever):
    """Searches every child for three times k and fuses the lists."""

    def __init__(self, retrievers: Sequence[Retriever], strategy: str = "rrf",
                 rrf_k: int | None = None, weights: Sequence[float] | None = None) -> None:
        super().__init__()
        if not retrievers:
            raise ValueError("HybridRetriever needs at least one child retriever.")
        if strategy not in ("rrf", "weighted"):
            raise ValueError(f"Unknown fusion strategy {strategy!r}; use 'rrf' or 'weighted'.")
        self.retrievers = list(retrievers)
        self.strategy = strategy
        self.rrf_k = get_config().rrf_k if rrf_k is None else rrf_k
        self.weights = sc.normalized_weights(weights, len(self.retrievers))
        self.name = f"hybrid_{strategy}"
        self._ready = all(child._ready for child in self.retrievers)

    def _build(self, chunks: DataFrame) -> None:
        for child in self.retrievers:
            child.index(chunks)

    def _search(self, queries: DataFrame, k: int) -> DataFrame:
        runs = [child.search(queries, k * OVERFETCH) for child in self.retrievers]
        if self.strategy == "rrf":
            return fuse_rrf(runs, k, self.rrf_k)
        return fuse_weighted(runs, k, self.weights)
