"""Search and question answering over one corpus."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankloom.config import EngineConfig, get_config
from rankloom.operators.answers import get_answerer
from rankloom.operators.chunking import FixedSizeChunker, chunk_corpus
from rankloom.operators.encoders import Encoder, PairScorer, coverage_scorer
from rankloom.operators.latent import LatentEncoder
from rankloom.operators.faithfulness import FaithfulnessScorer
from rankloom.operators.fusion import OVERFETCH
from rankloom.operators.rerank import PairReranker
from rankloom.operators.retriever import attach_text
from rankloom.plans.setups import default_retriever
from rankloom.runtime import current_scope, materialize, writing_to
from rankloom.sources.jsonl import load_corpus


class Engine:
    """Loads lazily; searches and answers whole batches of questions (or one string).

    Results read intermediate tables: fetch or write them inside a ``scratch_scope`` to have those dropped.
    """

    def __init__(self, spark: SparkSession, config: EngineConfig | None = None, corpus: DataFrame | None = None,
                 encoder: Encoder | LatentEncoder = LatentEncoder(), scorer: PairScorer = coverage_scorer, answerer=None,
                 faithfulness: FaithfulnessScorer | None = None) -> None:
        self.spark = spark
        self.config = config or get_config()
        self.corpus = corpus
        self.encoder = encoder
        self.scorer = scorer
        self.answerer = answerer or get_answerer(self.config)
        self.faithfulness = faithfulness or FaithfulnessScorer()
        self.loaded = False
        self.scope = current_scope()  # the index lives as long as what the engine was made in
        self.reranker: PairReranker | None = None

    def load(self, use_rerank: bool = True) -> "Engine":
        """Chunk and index the corpus once; asking for another reranking mode keeps the index."""
        if not self.loaded:
            documents = self.corpus if self.corpus is not None else load_corpus(
                self.spark, self.config.data_dir)
            with writing_to(self.scope):
                self.chunks = materialize(chunk_corpus(documents, FixedSizeChunker()), "chunks")
                self.retriever = default_retriever(self.chunks, self.config, self.encoder)
            self.loaded = True
        self.reranker = PairReranker(self.scorer) if use_rerank else None
        return self

    def _queries(self, query: str | DataFrame) -> DataFrame:
        if isinstance(query, DataFrame):
            return query.select("qid", "question")
        return self.spark.createDataFrame([("q0", query)], "qid string, question string")

    def search(self, query: str | DataFrame, k: int = 10) -> DataFrame:
        """Run table with text: 3k fused candidates reranked to k, or the fused top k."""
        if not self.loaded:
            self.load()
        queries = self._queries(query)
        if self.reranker is None:
            return attach_text(materialize(self.retriever.search(queries, k), "run"), self.chunks)
        found = materialize(self.retriever.search(queries, k * OVERFETCH), "candidates")
        return self.reranker.rerank(queries, attach_text(found, self.chunks), k)

    def ask(self, query: str | DataFrame, k: int = 5, score_faithfulness: bool = False) -> DataFrame:
        """One answer row per question; latency_ms is the batch time per question."""
        start = time.perf_counter()
        queries = self._queries(query)
        evidence = materialize(self.search(queries, k), "evidence")
        answers = self.answerer.answer(queries, evidence)
        if score_faithfulness:
            answers = self.faithfulness.attach(materialize(answers, "answers"), evidence)
        answers = materialize(answers, "answers")
        per_question = (time.perf_counter() - start) * 1000.0 / max(1, answers.count())
        return answers.withColumn("latency_ms", F.lit(per_question))


_engines: dict[str, Engine] = {}


def get_engine(spark: SparkSession) -> Engine:
    """The loaded engine of this Spark application."""
    app = spark.sparkContext.applicationId
    if app not in _engines:
        _engines[app] = Engine(spark).load()
    return _engines[app]
