"""Model hooks: encoders and pair scorers.

A hook is a function of Columns returning a Column.  The built-in ones need no model file: texts are encoded by
latent vectors fitted on the corpus (:mod:`rankloom.operators.latent`), pairs are scored by word and word-pair coverage with
fixed weights or, where judged pairs exist, by weights fitted on them.  ``model_*`` wrap a Python model, loaded
once per task and fed Arrow batches.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankloom.functions import scores as sc
from rankloom.functions import text as tx
from rankloom.runtime import materialize

Encoder = Callable[[Column], Column]
PairScorer = Callable[[Column, Column], Column]

HASH_DIMS = 64
#: Keeps the odds of the entailment scorer finite.
OVERLAP_CLAMP = 1e-6
#: Weights of the features of a pair before any are fitted: constant, words, word pairs, length.
PRIOR_WEIGHTS = (-3.0, 4.0, 3.0, 0.0)
FIT_STEPS = 25
FIT_RATE = 4.0
FIT_RIDGE = 0.001


def hash_counts(text: Column, dims: int = HASH_DIMS) -> Column:
    """Word counts per hash bucket, as doubles: features that need no fitting.  A word's bucket is the first byte of its md5."""
    def count_each(buckets: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.lit(dims - 1)), lambda b: F.size(F.filter(buckets, lambda x: x == b)).cast("double"))

    buckets = F.transform(tx.overlap_tokens(text), lambda word: F.conv(F.left(F.md5(word.cast("binary")), F.lit(2)), 16, 10).cast("int") % dims)
    return tx.bind(buckets, count_each)


def clamped_share(share: Column) -> Column:
    return F.greatest(F.lit(OVERLAP_CLAMP), F.least(F.lit(1.0 - OVERLAP_CLAMP), share))


def _neighbours(words: Column) -> Column:
    """Every two words that follow each other."""
    n = F.greatest(F.size(words) - 1, F.lit(0))
    return F.zip_with(F.slice(words, 1, n), F.slice(words, 2, n), lambda a, b: F.concat_ws(" ", a, b))


def pair_features(query: Column, passage: Column) -> Column:
    """What speaks for a pair, as doubles: 1, and the shares of the query's distinct words and distinct word pairs that the
    passage has (0 without any), and of the query's words among all words of both."""
    def share(asked: Column, held: Column) -> Column:
        return F.coalesce(F.try_divide(F.size(F.array_intersect(asked, held)), F.size(F.array_distinct(asked))), F.lit(0.0))

    def features(words: Column) -> Column:
        q, p = words["q"], words["p"]
        length = F.coalesce(F.try_divide(F.size(q), F.size(q) + F.size(p)), F.lit(0.0))
        return F.array(F.lit(1.0), share(q, p), share(_neighbours(q), _neighbours(p)), length)

    return tx.bind(F.struct(tx.overlap_tokens(query).alias("q"), tx.overlap_tokens(passage).alias("p")), features)


def weighted_scorer(weights: Sequence[float]) -> PairScorer:
    """Log-odds that a passage answers a query, from the features of the pair."""
    def score(query: Column, passage: Column) -> Column:
        terms = F.zip_with(pair_features(query, passage), F.array(*map(F.lit, weights)), lambda x, w: x * w)
        return F.aggregate(terms, F.lit(0.0), lambda total, x: total + x)

    return score


coverage_scorer = weighted_scorer(PRIOR_WEIGHTS)


def fit_pair_weights(pairs: DataFrame, steps: int = FIT_STEPS, rate: float = FIT_RATE, ridge: float = FIT_RIDGE,
                     both_kinds: bool = True) -> list[float]:
    """Weights of a logistic regression on judged *pairs* (question, text, relevant), by gradient ascent from the prior ones.

    A step is one pass over the written features: every task adds up its own rows' gradient, and four sums reach the driver.
    Relevant and other pairs weigh the same in total.  Without pairs the prior weights stay, and so they
    do without both kinds, unless *both_kinds* is false.
    """
    rows = materialize(pairs.select(pair_features(F.col("question"), F.col("text")).alias("x"),
                                    F.col("relevant").cast("int").alias("y")), "pair-features")
    n, hits = rows.agg(F.count("*"), F.coalesce(F.sum("y"), F.lit(0))).first()
    weights = list(PRIOR_WEIGHTS)
    if not n or (both_kinds and not 0 < hits < n):
        return weights
    mass = F.when(F.col("y") == 1, 0.5 / max(hits, 1)).otherwise(0.5 / max(n - hits, 1))
    for _ in range(steps):
        odds = sum((F.col("x")[i] * w for i, w in enumerate(weights)), F.lit(0.0))
        error = mass * (F.col("y") - 1 / (1 + F.exp(-odds)))
        gradient = rows.agg(*(F.sum(error * F.col("x")[i]) for i in range(len(weights)))).first()
        weights = [w + rate * (g - ridge * w) for w, g in zip(weights, gradient, strict=True)]
    return weights


def overlap_nli(premise: Column, hypothesis: Column) -> Column:
    """[contradiction, entailment, neutral] logits from the share of hypothesis words
    found in the premise; all equal when the hypothesis has no words."""
    def score(words: Column) -> Column:
        found = F.size(F.array_intersect(words["h"], words["p"]))
        share = clamped_share(F.coalesce(F.try_divide(found, F.size(words["h"])), F.lit(0.5)))
        return tx.bind(sc.logit(share), lambda odds: F.array(-odds, odds, F.lit(0.0)))

    words = F.struct(F.array_distinct(tx.overlap_tokens(hypothesis)).alias("h"),
                     tx.overlap_tokens(premise).alias("p"))
    return tx.bind(words, score)


def model_encoder(load: Callable[[], Callable[[list[str]], np.ndarray]], batch_size: int = 64) -> Encoder:
    """Encoder from a Python model; *load* runs once per task and returns ``encode(texts)``."""

    @F.pandas_udf("array<double>")
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = load()
        for texts in batches:
            values = texts.fillna("").tolist()
            rows = [row for i in range(0, len(values), batch_size)
                    for row in np.asarray(model(values[i:i + batch_size]), dtype="float64")]
            yield pd.Series(rows)

    return encode


def model_scorer(load: Callable[[], Callable[[list[tuple[str, str]]], Sequence[float]]],
                 batch_size: int = 32) -> PairScorer:
    """Pair scorer (raw logits) from a Python model."""

    @F.pandas_udf("double")
    def score(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        model = load()
        for queries, passages in batches:
            pairs = list(zip(queries, passages))
            yield pd.Series([float(x) for i in range(0, len(pairs), batch_size)
                             for x in model(pairs[i:i + batch_size])], dtype="float64")

    return score
