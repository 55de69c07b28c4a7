"""Answers from retrieved chunks: extractive by default, generated when enabled.

Inputs are *queries* (qid, question) and *evidence*: run columns plus text.
Each question has at most k evidence rows, so per-question arrays stay small.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankloom.config import EngineConfig, get_config
from rankloom.functions import text as tx

# --- fixed values ---------------------------------------------------------
CONTEXT_CHARS = 4000
MAX_ANSWER_TOKENS = 300
# --- end of fixed values --------------------------------------------------

PROMPT = "{context}\n\nWhat the reader asks: {question}\nYour reply:"

GENERATION_RULES = (
    "Answer from the numbered passages alone, in one to three sentences. "
    "If they do not hold the answer, say that you do not know."
)


def sentence_scores(queries: DataFrame, evidence: DataFrame) -> DataFrame:
    """qid, rank, pos, sentence, overlap for every sentence of the evidence."""
    wanted = queries.select("qid", tx.overlap_tokens(F.col("question")).alias("wanted"))
    sentences = evidence.select(
        "qid", "rank", F.posexplode(tx.answer_sentences(F.col("text"))).alias("pos", "sentence"))
    return sentences.join(wanted, "qid").select(
        "qid", "rank", "pos", "sentence",
        tx.jaccard(F.col("wanted"), tx.overlap_tokens(F.col("sentence"))).alias("overlap"))


def best_sentences(scored: DataFrame, n: int) -> DataFrame:
    order = Window.partitionBy("qid").orderBy(F.desc("overlap"), F.asc("rank"), F.asc("pos"))
    return scored.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= n)


def supporting_chunks(evidence: DataFrame) -> DataFrame:
    """qid, supporting_chunks: the evidence rows of a question, in rank order."""
    row = F.struct("rank", "chunk_id", "doc_id", "text", "score", "retriever")
    return evidence.groupBy("qid").agg(F.array_sort(F.collect_list(row)).alias("supporting_chunks"))


def _answer_table(queries: DataFrame, texts: DataFrame, evidence: DataFrame, generator: str) -> DataFrame:
    """One answer row per question; questions without evidence get an empty text."""
    nothing = F.array().cast(supporting_chunks(evidence).schema["supporting_chunks"].dataType)
    return (
        queries.select("qid")
        .join(texts, "qid", "left")
        .join(supporting_chunks(evidence), "qid", "left")
        .select(
            "qid",
            F.coalesce("text", F.lit("")).alias("text"),
            F.coalesce("supporting_chunks", nothing).alias("supporting_chunks"),
            F.lit(generator).alias("generator"),
            F.lit(None).cast("double").alias("faithfulness"),
            F.lit(None).cast("double").alias("latency_ms"),
        )
    )


class ExtractiveAnswerer:
    """Joins the sentences that overlap the question most; best first."""

    name = "extractive"

    def __init__(self, max_sentences: int = 2) -> None:
        if max_sentences < 1:
            raise ValueError(f"max_sentences must be at least 1, got {max_sentences}")
        self.max_sentences = max_sentences

    def texts(self, queries: DataFrame, evidence: DataFrame) -> DataFrame:
        chosen = best_sentences(sentence_scores(queries, evidence), self.max_sentences)
        ordered = F.array_sort(F.collect_list(F.struct("place", "sentence")))
        return chosen.groupBy("qid").agg(F.array_join(ordered["sentence"], " ").alias("text"))

    def answer(self, queries: DataFrame, evidence: DataFrame) -> DataFrame:
        return _answer_table(queries, self.texts(queries, evidence), evidence, self.name)


def _context(entries: Column, max_chars: int) -> Column:
    """Join entries with newlines until the next would exceed the budget; the first always fits."""
    start = F.struct(F.lit("").alias("text"), F.lit(0).alias("used"), F.lit(False).alias("full"))

    def add(acc: Column, entry: Column) -> Column:
        kept = acc["used"] > 0
        full = acc["full"] | (kept & (acc["used"] + F.length(entry) > max_chars))
        return F.when(full, F.struct(acc["text"].alias("text"), acc["used"].alias("used"),
                                     F.lit(True).alias("full"))).otherwise(
            F.struct(F.when(kept, F.concat(acc["text"], F.lit("\n"), entry)).otherwise(entry)
                     .alias("text"),
                     (acc["used"] + F.length(entry) + 1).alias("used"),
                     F.lit(False).alias("full")))

    return F.aggregate(entries, start, add, lambda acc: acc["text"])


def context_blocks(evidence: DataFrame, max_chars: int = CONTEXT_CHARS) -> DataFrame:
    """qid, context: numbered passages within a character budget; blank ones keep their number."""
    entry = F.concat(F.lit("["), F.col("rank").cast("string"), F.lit("] "), tx.strip(F.col("text")))
    ranked = evidence.groupBy("qid").agg(
        F.array_sort(F.collect_list(F.struct("rank", entry.alias("entry")))).alias("ranked"))
    return ranked.select("qid", _context(F.col("ranked")["entry"], max_chars).alias("context"))


class GeneratedAnswerer:
    """Answers written by a language model.

    *load_model* runs once per task and returns ``generate(system, prompt, max_tokens, model)``.
    Off unless the settings enable it and hold a key.
    """

    name = "generated"

    def __init__(self, load_model: Callable[[], Callable[[str, str, int, str], str]] | None = None,
                 config: EngineConfig | None = None, model: str | None = None) -> None:
        self.load_model = load_model
        self.config = config or get_config()
        self.model = model or self.config.generation_model

    def _require_enabled(self) -> None:
        if not self.config.generation_enabled:
            raise RuntimeError("Generation is disabled; set RANKLOOM_GENERATION_ENABLED=true.")
        if not self.config.generation_api_key:
            raise RuntimeError("Generation needs a key; set RANKLOOM_GENERATION_API_KEY.")
        if self.load_model is None:
            raise RuntimeError("Generation needs a model; pass load_model.")

    def answer(self, queries: DataFrame, evidence: DataFrame) -> DataFrame:
        self._require_enabled()
        prompts = (
            queries.select("qid", "question")
            .join(context_blocks(evidence), "qid", "left")
            .withColumn("context", F.coalesce("context", F.lit("")))
        )
        load, model_name = self.load_model, self.model

        def generate(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            model = load()
            for batch in batches:
                texts = [
                    model(GENERATION_RULES, PROMPT.format(context=context, question=question),
                          MAX_ANSWER_TOKENS, model_name).strip()
                    for context, question in zip(batch["context"], batch["question"])
                ]
                yield pd.DataFrame({"qid": batch["qid"], "text": texts})

        texts = prompts.select("qid", "question", "context").mapInPandas(generate, "qid string, text string")
        return _answer_table(queries, texts, evidence, self.name)


def get_answerer(config: EngineConfig | None = None, load_model=None):
    """The generating answerer when it is enabled and has a key, else the extractive one."""
    config = config or get_config()
    if config.generation_enabled and config.generation_api_key:
        return GeneratedAnswerer(load_model, config)
    return ExtractiveAnswerer()
