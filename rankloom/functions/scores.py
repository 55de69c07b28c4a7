"""Numeric functions as Column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from rankloom.functions.text import bind

# --- fixed values ---------------------------------------------------------
MIN_MAX_EPSILON = 1e-9
SIGMOID_CLIP = 88.0
ENTAILMENT_POSITION = 2  # 1-based, in [contradiction, entailment, neutral]
# Scores are compared after rounding here, so summation order cannot flip a tie.
SCORE_DIGITS = 9
# --- end of fixed values --------------------------------------------------


def idf(n_chunks: Column | float, df: Column) -> Column:
    n = n_chunks if isinstance(n_chunks, Column) else F.lit(float(n_chunks))
    return F.log((n - df + 0.5) / (df + 0.5) + 1.0)


def tf_norm(tf: Column, dl: Column, avgdl: float, k1: float, b: float) -> Column:
    return tf * (k1 + 1.0) / (tf + k1 * (1.0 - b + b * dl / F.lit(float(avgdl))))


def ranking_score(score: Column) -> Column:
    return F.round(score, SCORE_DIGITS)


def l2_norm(vec: Column) -> Column:
    return F.sqrt(F.aggregate(vec, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double")))


def l2_normalize(vec: Column) -> Column:
    """Unit length; a zero vector stays zero."""
    def scale(v: Column) -> Column:
        norm = l2_norm(v)
        return bind(F.when(norm == 0.0, F.lit(1.0)).otherwise(norm),
                    lambda divisor: F.transform(v, lambda x: x.cast("double") / divisor))

    return bind(vec, scale)


def dot(left: Column, right: Column) -> Column:
    products = F.zip_with(left, right, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)


def sigmoid(logit: Column) -> Column:
    clipped = F.greatest(F.lit(-SIGMOID_CLIP), F.least(F.lit(SIGMOID_CLIP), logit))
    return 1.0 / (1.0 + F.exp(-clipped))


def logit(p: Column) -> Column:
    return F.log(p / (1.0 - p))


def softmax(logits: Column) -> Column:
    def shares(exps: Column) -> Column:
        return bind(F.aggregate(exps, F.lit(0.0), lambda acc, x: acc + x),
                    lambda total: F.transform(exps, lambda x: x / total))

    return bind(bind(F.array_max(logits), lambda top: F.transform(logits, lambda x: F.exp(x - top))), shares)


def entailment_probability(logits: Column) -> Column:
    """P(entailment); 0 when a scorer returns fewer than two logits."""
    return F.when(
        F.size(logits) >= ENTAILMENT_POSITION, F.element_at(softmax(logits), ENTAILMENT_POSITION)
    ).otherwise(F.lit(0.0))


def rrf(rank: Column, rrf_k: int) -> Column:
    return F.lit(1.0) / (F.lit(rrf_k) + rank)


def min_max(score: Column, low: Column, high: Column) -> Column:
    return (score - low) / (high - low + F.lit(MIN_MAX_EPSILON))


def dcg_discount(rank: Column) -> Column:
    return F.lit(1.0) / F.log2(rank + F.lit(1.0))


def normalized_weights(weights: Sequence[float] | None, n: int) -> list[float]:
    """Weights that sum to 1; equal shares when none are given."""
    if weights is None:
        return [1.0 / n] * n
    if len(weights) != n:
        raise ValueError(f"{n} weights are needed, got {len(weights)}")
    total = sum(weights)
    if total <= 0:
        raise ValueError("The weights must have a positive sum.")
    return [w / total for w in weights]
