"""Query expansion by pseudo-relevance feedback."""

from __future__ import annotations

import logging

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rankloom.functions import text as tx
from rankloom.operators.retriever import Retriever, fetch
from rankloom.runtime import materialize

log = logging.getLogger(__name__)


def feedback_terms(run: DataFrame, tokens: DataFrame, queries: DataFrame, fb_terms: int) -> DataFrame:
    """qid, position, term, tf: the terms to append, best first.

    *run* holds the feedback chunks, *tokens* is (chunk_id, tokens).  Terms are ordered by
    frequency over the feedback chunks, then by first sight (chunk rank, then position).
    """
    seen = fetch(tokens, run.select("qid", "rank", "chunk_id"), ["tokens"])
    counted = (
        seen.select("qid", "rank", F.posexplode("tokens").alias("pos", "term"))
        .groupBy("qid", "term")
        .agg(F.count("*").alias("tf"), F.min(F.struct("rank", "pos")).alias("first_seen"))
    )
    own = queries.select("qid", F.explode(tx.tokenize(F.col("question"))).alias("term"))
    order = Window.partitionBy("qid").orderBy(F.desc("tf"), F.asc("first_seen"))
    return (
        counted.join(own, ["qid", "term"], "left_anti")
        .withColumn("position", F.row_number().over(order))
        .filter(F.col("position") <= fb_terms)
        .select("qid", "position", "term", "tf")
    )


def expanded_questions(queries: DataFrame, terms: DataFrame) -> DataFrame:
    """qid, question with the terms appended; unchanged when there are none."""
    joined = terms.groupBy("qid").agg(
        F.array_sort(F.collect_list(F.struct("position", "term"))).alias("added"))
    suffix = F.array_join(F.col("added.term"), " ")
    return queries.join(joined, "qid", "left").select(
        "qid",
        F.when(F.col("added").isNull(), F.col("question"))
        .otherwise(F.concat_ws(" ", "question", suffix)).alias("question"))


class Rm3QueryExpander:
    """Appends the most frequent new terms of the top chunks to each question.

    ``orig_weight`` is carried for information only: terms are appended, not weighted.
    """

    def __init__(self, retriever: Retriever, tokens: DataFrame | None = None, fb_docs: int = 5,
                 fb_terms: int = 8, orig_weight: float = 0.6) -> None:
        self.retriever = retriever
        self.tokens = tokens
        self.fb_docs = fb_docs
        self.fb_terms = fb_terms
        self.orig_weight = orig_weight

    def _tokens(self) -> DataFrame:
        if self.tokens is not None:
            return self.tokens
        tables = getattr(self.retriever, "tables", None)
        if tables is None:
            raise ValueError("Pass tokens=(chunk_id, tokens) for a retriever without an index table.")
        return tables.forward

    def terms(self, queries: DataFrame) -> DataFrame:
        run = materialize(self.retriever.search(queries, self.fb_docs), "feedback")
        return feedback_terms(run, self._tokens(), queries, self.fb_terms)

    def expand(self, queries: DataFrame) -> DataFrame:
        """(qid, question) rows with expanded questions.

        Questions without feedback terms keep their text, and so do all when the feedback retriever was never
        indexed.  What fails in Spark raises: a lost stage must not turn expansion off for a whole batch.
        """
        if not self.retriever._ready:
            log.warning("The feedback retriever has no index; using the original questions.")
            return queries.select("qid", "question")
        return expanded_questions(queries, self.terms(queries))


class ExpandingRetriever(Retriever):
    """Expands the questions, then searches the inner retriever with them."""

    def __init__(self, inner: Retriever, expander) -> None:
        super().__init__()
        self.inner = inner
        self.expander = expander
        self.name = f"rm3+{inner.name}"
        self._ready = inner._ready

    def _build(self, chunks: DataFrame) -> None:
        self.inner.index(chunks)

    def _search(self, queries: DataFrame, k: int) -> DataFrame:
        # written once: the second pass reads the questions more than once
        expanded = materialize(self.expander.expand(queries), "expanded")
        return self.inner.search(expanded, k).withColumn("retriever", F.lit(self.name))
