"""Retrieval setups: which chunker, which retriever, which second stages."""

from __future__ import annotations

import logging
import time
from collections.abc import Callable, Sequence
from copy import copy
from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankloom.config import EngineConfig, get_config
from rankloom.operators.bm25 import BM25Retriever
from rankloom.operators.chunking import (
    Chunker,
    FixedSizeChunker,
    SentenceWindowChunker,
    chunk_corpus,
)
from rankloom.operators.dense import DenseRetriever
from rankloom.operators.encoders import Encoder, PairScorer, coverage_scorer
from rankloom.operators.latent import LatentEncoder
from rankloom.operators.expansion import ExpandingRetriever, Rm3QueryExpander
from rankloom.operators.fusion import OVERFETCH, HybridRetriever
from rankloom.operators.rerank import PairReranker
from rankloom.operators.retriever import DeepRun, Retriever, attach_text, write_chunks
from rankloom.runtime import materialize
from rankloom.schemas import RUN_COLUMNS

log = logging.getLogger(__name__)

LATENCY_BATCHES = 5
#: Questions a timed batch holds at least, on the mean.
BATCH_QUESTIONS = 20


@dataclass(frozen=True)
class RetrievalSetup:
    name: str
    chunker: Chunker
    retriever_factory: Callable[[], Retriever]
    use_rerank: bool = False
    use_rm3: bool = False
    scorer: PairScorer = coverage_scorer

    def build(self, corpus: DataFrame, shared: "SharedIndexes | None" = None) -> "BuiltSetup":
        """Chunk and index *corpus*.  *shared* reuses chunks and indexes other setups built."""
        shared = shared or SharedIndexes(corpus)
        chunks = shared.chunks(self.chunker)
        retriever = shared.index(self.retriever_factory(), self.chunker)
        if self.use_rm3:
            retriever = ExpandingRetriever(retriever, Rm3QueryExpander(retriever, fb_docs=5, fb_terms=8))
        reranker = PairReranker(self.scorer) if self.use_rerank else None
        return BuiltSetup(self.name, chunks, retriever, reranker)

    def depth(self, k: int = 10) -> int:
        """How deep its word or vector search goes for a run of *k*."""
        fused = isinstance(self.retriever_factory(), HybridRetriever)
        return k * (OVERFETCH if self.use_rerank else 1) * (OVERFETCH if fused else 1)


@dataclass(frozen=True)
class BuiltSetup:
    name: str
    chunks: DataFrame
    retriever: Retriever
    reranker: PairReranker | None = None

    def search(self, queries: DataFrame, k: int = 10, rerank_top_k: int = 5) -> DataFrame:
        return run_retrieval(self.retriever, queries, self.chunks, k, self.reranker, rerank_top_k)


@dataclass
class SharedIndexes:
    """Chunks and indexes of one corpus, each built once however many setups use them; runs too, after :meth:`for_setups`."""

    corpus: DataFrame
    _chunks: dict = field(default_factory=dict)
    _indexes: dict = field(default_factory=dict)
    _queries: DataFrame | None = None
    _depths: dict = field(default_factory=dict)  # by chunker
    _runs: dict = field(default_factory=dict)

    def for_setups(self, setups: Sequence[RetrievalSetup], queries: DataFrame, k: int = 10) -> "SharedIndexes":
        """The same chunks and indexes, on which the *setups* search *queries* for runs of *k*: what several of them ask of an index
        is searched once, as deep as the deepest asks."""
        depths: dict = {}
        for setup in setups:
            key = self._key(setup.chunker)
            depths[key] = max(depths.get(key, 0), setup.depth(k))
        return replace(self, _queries=queries, _depths=depths, _runs={})

    @staticmethod
    def _key(chunker: Chunker) -> tuple:
        return type(chunker), tuple(sorted(vars(chunker).items()))

    def _deep(self, key: tuple, chunker: Chunker) -> DeepRun | None:
        depth = self._depths.get(self._key(chunker))
        if self._queries is None or depth is None:
            return None
        if key not in self._runs:
            self._runs[key] = DeepRun(self._queries, depth)
        return self._runs[key]

    def chunks(self, chunker: Chunker) -> DataFrame:
        key = self._key(chunker)
        if key not in self._chunks:
            self._chunks[key] = write_chunks(chunk_corpus(self.corpus, chunker))
        return self._chunks[key]

    def index(self, retriever: Retriever, chunker: Chunker) -> Retriever:
        """Index *retriever*, or give it the tables of an equal one."""
        if isinstance(retriever, HybridRetriever):
            retriever.retrievers = [self.index(child, chunker) for child in retriever.retrievers]
            retriever._ready = True
            return retriever
        chunks = self.chunks(chunker)
        if isinstance(retriever, BM25Retriever):
            key = (id(chunks), "bm25")  # tables do not depend on k1 and b
            deep = self._deep((*key, retriever.k1, retriever.b), chunker)
        elif isinstance(retriever, DenseRetriever):
            key = (id(chunks), "dense", retriever.encoder)
            deep = self._deep(key, chunker)
        else:
            return retriever.index(chunks)
        if key not in self._indexes:
            lexical = self._indexes.get((id(chunks), "bm25"))
            if isinstance(retriever, DenseRetriever) and lexical is not None:
                retriever.tokens = lexical.tables.forward  # not tokenised again
            self._indexes[key] = copy(retriever.index(chunks))
        built = self._indexes[key]
        for table in ("tables", "vectors", "fitted"):
            if hasattr(built, table):
                setattr(retriever, table, getattr(built, table))
        retriever._ready, retriever.deep = True, deep
        return retriever


def run_retrieval(retriever: Retriever, queries: DataFrame, chunks: DataFrame, k: int = 10,
                  reranker: PairReranker | None = None, rerank_top_k: int = 5) -> DataFrame:
    """Search all questions in one job.

    With a reranker three times k candidates are fetched and min(rerank_top_k, k) kept.
    """
    if reranker is None:
        return retriever.search(queries, k)
    candidates = materialize(retriever.search(queries, k * OVERFETCH), "candidates")
    reranked = reranker.rerank(queries, attach_text(candidates, chunks), min(rerank_top_k, k))
    return reranked.select(*RUN_COLUMNS)


def timed_run(setup: BuiltSetup, queries: DataFrame, k: int, rerank_top_k: int,
              batches: int = LATENCY_BATCHES) -> tuple[DataFrame, DataFrame]:
    """The finished run, and (qid, latency_ms) of every question.

    Questions are dealt by hash to *batches* of ``BATCH_QUESTIONS`` or more that are searched and timed one after another; a
    question carries an equal share of its own batch's wall time, so percentiles are those of measured times.  The first of several
    batches is searched once before, so that compiling plans does not count.
    """
    batches = max(1, min(batches, queries.count() // BATCH_QUESTIONS))
    dealt = materialize(queries.select("qid", "question", F.pmod(F.xxhash64("qid"), F.lit(batches)).alias("batch")), "dealt")
    sizes = dict(dealt.groupBy("batch").count().collect())
    runs, latencies = [], []
    for place, batch in enumerate(sorted(sizes)):
        asked = materialize(dealt.where(F.col("batch") == batch).select("qid", "question"), "asked")
        for _ in range(2 if place == 0 and batches > 1 else 1):
            start = time.perf_counter()
            run = materialize(setup.search(asked, k, rerank_top_k), "run")
            elapsed_ms = (time.perf_counter() - start) * 1000.0
        runs.append(run)
        latencies.append(asked.select("qid", F.lit(elapsed_ms / sizes[batch]).alias("latency_ms")))
        log.info("%s: %d questions in %.0f ms", setup.name, sizes[batch], elapsed_ms)
    if not runs:
        return setup.search(queries, k, rerank_top_k), queries.select("qid", F.lit(0.0).alias("latency_ms"))
    return reduce(DataFrame.unionByName, runs), reduce(DataFrame.unionByName, latencies)


def default_retriever(chunks: DataFrame, config: EngineConfig | None = None,
                      encoder: Encoder | LatentEncoder = LatentEncoder()) -> HybridRetriever:
    """BM25 and dense under reciprocal rank fusion, indexed over *chunks*."""
    if chunks.isEmpty():
        raise ValueError("Cannot build a retriever over zero chunks.")
    config = config or get_config()
    hybrid = HybridRetriever([BM25Retriever(), DenseRetriever(encoder)], "rrf", config.rrf_k)
    hybrid.index(chunks)
    return hybrid


def _factories(encoder: Encoder, rrf_k: int) -> dict[str, Callable[[], Retriever]]:
    return {
        "bm25": BM25Retriever,
        "dense": lambda: DenseRetriever(encoder),
        "hybrid_rrf": lambda: HybridRetriever([BM25Retriever(), DenseRetriever(encoder)], "rrf", rrf_k),
    }


_CHUNKERS: dict[str, Callable[[], Chunker]] = {
    "fixed": lambda: FixedSizeChunker(200, 40),
    "sentwin": lambda: SentenceWindowChunker(3, 2),
}


def make_setup(name: str, chunker: str, retriever: str, use_rerank: bool = False, use_rm3: bool = False,
               encoder: Encoder | LatentEncoder = LatentEncoder(), scorer: PairScorer = coverage_scorer) -> RetrievalSetup:
    factories = _factories(encoder, get_config().rrf_k)
    return RetrievalSetup(name, _CHUNKERS[chunker](), factories[retriever], use_rerank, use_rm3, scorer)


def default_setups(encoder: Encoder | LatentEncoder = LatentEncoder(), scorer: PairScorer = coverage_scorer) -> list[RetrievalSetup]:
    """The six standard setups, in report order."""
    rows = [
        ("bm25_fixed", "fixed", "bm25", False, False),
        ("dense_fixed", "fixed", "dense", False, False),
        ("hybrid_rrf_fixed", "fixed", "hybrid_rrf", False, False),
        ("hybrid_rrf_fixed_rerank", "fixed", "hybrid_rrf", True, False),
        ("hybrid_rrf_sentwin", "sentwin", "hybrid_rrf", False, False),
        ("bm25_rm3_fixed", "fixed", "bm25", False, True),
    ]
    return [make_setup(*row, encoder=encoder, scorer=scorer) for row in rows]


@dataclass(frozen=True)
class AblationCell:
    label: str
    chunker: str
    retriever: str
    rerank: bool


def ablation_grid(chunkers: Sequence[str] = ("fixed", "sentwin"),
                  retrievers: Sequence[str] = ("bm25", "dense", "hybrid_rrf")) -> list[AblationCell]:
    """All 2 × 3 × 2 combinations of chunker, retriever and reranking."""
    return [AblationCell(f"{r}_{c}{'+rerank' if rerank else ''}", c, r, rerank)
            for c in chunkers for r in retrievers for rerank in (False, True)]
