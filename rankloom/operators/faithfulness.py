"""Faithfulness: mean probability that the evidence entails each answer sentence."""

from __future__ import annotations

import logging
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankloom.functions import scores as sc
from rankloom.functions import text as tx
from rankloom.operators.alignment import alignment_nli
from rankloom.operators.encoders import PairScorer

log = logging.getLogger(__name__)

# --- fixed values ---------------------------------------------------------
PREMISE_CHARS = 1500
MIN_REMAINDER = 20
# --- end of fixed values --------------------------------------------------

# premise, sentences -> logits per sentence
SentenceScorer = Callable[[Column, Column], Column]


def _premise(texts: Column, max_chars: int) -> Column:
    """Join texts with spaces up to a budget.

    The text that would exceed it is cut to what is left if that is worth having, and
    ends the premise; a first text is never cut.
    """
    start = F.struct(F.lit("").alias("text"), F.lit(0).alias("used"), F.lit(False).alias("full"))

    def state(text: Column, used: Column, full: Column) -> Column:
        return F.struct(text.alias("text"), used.alias("used"), full.alias("full"))

    def add(acc: Column, text: Column) -> Column:
        kept = acc["used"] > 0
        room = F.lit(max_chars) - acc["used"]
        overflows = kept & (F.length(text) > room)
        joined = F.when(kept, F.concat(acc["text"], F.lit(" "), text)).otherwise(text)
        cut = F.when(room > MIN_REMAINDER,
                     F.concat(acc["text"], F.lit(" "), F.left(text, room))).otherwise(acc["text"])
        return (F.when(acc["full"] | (text == ""), acc)
                .when(overflows, state(cut, acc["used"], F.lit(True)))
                .otherwise(state(joined, acc["used"] + F.length(text) + 1, F.lit(False))))

    return F.aggregate(texts, start, add, lambda acc: acc["text"])


def premises(evidence: DataFrame, max_chars: int = PREMISE_CHARS) -> DataFrame:
    """qid, premise from the evidence of each question (at most k rows)."""
    ranked = evidence.groupBy("qid").agg(
        F.array_sort(F.collect_list(F.struct("rank", tx.strip(F.col("text")).alias("text")))).alias("ranked"))
    return ranked.select("qid", _premise(F.col("ranked")["text"], max_chars).alias("premise"))


def per_sentence(scorer: PairScorer) -> SentenceScorer:
    """Apply a native pair scorer to every sentence of an answer."""
    return lambda premise, sentences: F.transform(sentences, lambda s: scorer(premise, s))


def model_nli(load: Callable[[], Callable[[list[tuple[str, str]]], list[list[float]]]]) -> SentenceScorer:
    """Python model scoring sentences; loaded once a task, and called with all pairs of a batch.

    If a batch fails, its answers are scored one by one, and only those that fail get null logits.
    """

    @F.pandas_udf("array<array<double>>")
    def score(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        model = load()

        def logits(pairs: list[tuple[str, str]]) -> list[list[float]]:
            return [[float(x) for x in row] for row in model(pairs)] if pairs else []

        def one(pairs: list[tuple[str, str]]) -> list[list[float]] | None:
            try:
                return logits(pairs)
            except Exception as error:  # noqa: BLE001 - any model failure leaves the answer unscored
                log.warning("Entailment scoring failed (%s); the answer stays unscored.", error)
                return None

        for premises_, sentences in batches:
            answers = [[(p, s) for s in parts] for p, parts in zip(premises_, sentences, strict=True)]
            try:
                rows = iter(logits([pair for pairs in answers for pair in pairs]))
                found = [[next(rows) for _ in pairs] for pairs in answers]
            except Exception as error:  # noqa: BLE001 - find the answers that fail
                log.warning("Entailment scoring of a batch failed (%s); scoring its answers one by one.", error)
                found = [one(pairs) for pairs in answers]
            yield pd.Series(found)

    return score


class FaithfulnessScorer:
    """Scores answers (qid, text) against evidence, in [0, 1].

    0 when there is nothing to score (no sentence, no evidence), null when a model failed on the answer.
    """

    def __init__(self, scorer: SentenceScorer | None = None) -> None:
        self.scorer = scorer or alignment_nli

    def score(self, answers: DataFrame, evidence: DataFrame) -> DataFrame:
        """qid, faithfulness for every answer.  Scored inside the row, so only qid is joined."""
        parts = (
            answers.select("qid", tx.answer_sentences(F.col("text")).alias("sentences"))
            .join(premises(evidence), "qid", "left")
            .withColumn("premise", F.coalesce("premise", F.lit("")))
        )
        logits = parts.withColumn("logits", self.scorer(F.col("premise"), F.col("sentences")))
        probs = F.transform("logits", sc.entailment_probability)
        mean = F.try_divide(F.aggregate(probs, F.lit(0.0), lambda acc, p: acc + p), F.size("logits"))
        empty = (F.coalesce(F.size("sentences"), F.lit(0)) == 0) | (F.col("premise") == "")
        return logits.select("qid", F.when(empty, F.lit(0.0)).when(F.col("logits").isNotNull(), F.coalesce(
            mean, F.lit(0.0))).alias("faithfulness"))

    @staticmethod
    def failures(scored: DataFrame) -> DataFrame:
        """n_answers, n_failed: how many answers a model failed on."""
        return scored.agg(F.count("*").alias("n_answers"), F.count_if(F.col("faithfulness").isNull()).alias("n_failed"))

    def attach(self, answers: DataFrame, evidence: DataFrame) -> DataFrame:
        """Answers with their faithfulness filled in."""
        scored = self.score(answers, evidence)
        return answers.drop("faithfulness").join(scored, "qid").select(*answers.columns)
