"""Exhaustive cosine search over unit vectors.

The product of questions and vectors is inherent to exact search, so it is done as
block matrix products inside Arrow tasks and never leaves them: vectors are scanned where they lie
and no vector is ever shuffled.

* Questions travel to the vectors as a broadcast matrix of at most ``QUESTION_TILE`` rows, which a task multiplies tile by
  tile.  A larger set is dealt to such matrices by the hash of the question id; they take turns and their results are written one by one.
* Hits are merged at two levels.  Neighbouring splits of the vector table share a task, ``MERGE_TASKS`` at most per core, which keeps
  a running best k per question; only these rows, groups times k per question, reach the last shuffle.

Vectors are stored as 32-bit floats, as models make them; products are taken in 64 bits.  Ties are settled by chunk id
inside the tasks, so copies never pile up.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankloom.functions.scores import SCORE_DIGITS, l2_normalize
from rankloom.operators.encoders import Encoder
from rankloom.operators.latent import LatentEncoder, written_tokens
from rankloom.operators.retriever import Retriever, top_k
from rankloom.runtime import materialize, write_alone

QUESTION_TILE = 4096  # questions sent at a time, and in one product
MERGE_TASKS = 4  # scanning tasks per core
BLOCK = 4096  # vectors per matrix product

_HITS = "qid string, chunk_id string, doc_id string, score double"
_HITS_ARROW = pa.schema([("qid", pa.string()), ("chunk_id", pa.string()),
                         ("doc_id", pa.string()), ("score", pa.float64())])


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1).astype(np.float64, copy=False)


class _BestHits:
    """Running top k per question by (score desc, chunk_id asc)."""

    def __init__(self, qids: list[str], matrix: np.ndarray, k: int) -> None:
        self.qids = qids
        self.matrix = matrix
        self.k = k
        self.hits: list[list[tuple[float, str, str]]] = [[] for _ in qids]
        self.floor = np.full(len(qids), -np.inf)

    def add(self, chunk_ids: list[str], doc_ids: list[str], vectors: np.ndarray) -> None:
        for start in range(0, len(chunk_ids), BLOCK):
            self._add_block(chunk_ids[start:start + BLOCK], doc_ids[start:start + BLOCK],
                            vectors[start:start + BLOCK])

    def _add_block(self, chunk_ids: list[str], doc_ids: list[str], vectors: np.ndarray) -> None:
        scores = np.round(self.matrix @ vectors.T, SCORE_DIGITS)
        for q in np.flatnonzero((scores >= self.floor[:, None]).any(axis=1)):
            row = scores[q]
            cut = self.floor[q]
            if len(row) > self.k:  # ties at the cut are kept and settled by chunk_id below
                cut = max(cut, np.partition(row, -self.k)[-self.k])
            fresh = [(-row[i], chunk_ids[i], doc_ids[i]) for i in np.flatnonzero(row >= cut)]
            self.hits[q] = sorted(self.hits[q] + fresh)[:self.k]
            if len(self.hits[q]) == self.k:
                self.floor[q] = -self.hits[q][-1][0]

    def batch(self) -> pa.RecordBatch:
        flat = [(qid, chunk, doc, -negated)
                for qid, hits in zip(self.qids, self.hits) for negated, chunk, doc in hits]
        columns = list(zip(*flat)) if flat else [[], [], [], []]
        return pa.RecordBatch.from_arrays(
            [pa.array(c, type=f.type) for c, f in zip(columns, _HITS_ARROW)], schema=_HITS_ARROW)


def _scan_hits(vectors: DataFrame, qids: list[str], matrix: np.ndarray, k: int, tile: int) -> DataFrame:
    shared = vectors.sparkSession.sparkContext.broadcast((qids, matrix))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, rows = shared.value
        tiles = [_BestHits(asked[i:i + tile], rows[i:i + tile], k) for i in range(0, len(asked), tile)]
        for batch in batches:
            if batch.num_rows:
                found = batch.column(0).to_pylist(), batch.column(1).to_pylist(), _matrix(batch.column(2))
                for best in tiles:
                    best.add(*found)
        for best in tiles:
            yield best.batch()

    groups = MERGE_TASKS * vectors.sparkSession.sparkContext.defaultParallelism
    return vectors.select("chunk_id", "doc_id", "vec").coalesce(groups).mapInArrow(scan, _HITS)


def dense_hits(vectors: DataFrame, questions: DataFrame, k: int, question_tile: int = QUESTION_TILE) -> DataFrame:
    """Best hits of (qid, vec) against (chunk_id, doc_id, vec); at most groups times k rows per qid."""
    sent = max(question_tile, QUESTION_TILE)
    first = questions.select("qid", "vec").limit(sent + 1).toArrow()
    if first.num_rows == 0:
        return questions.sparkSession.createDataFrame([], _HITS)
    if first.num_rows <= sent:
        return _scan_hits(vectors, first["qid"].to_pylist(), _matrix(first["vec"]), k, question_tile)
    written = materialize(questions.select("qid", "vec"), "dense-questions")
    turns = -(-2 * written.count() // sent)  # half full on the mean
    placed = F.pmod(F.xxhash64("qid"), F.lit(turns))
    hits = None
    for t in range(turns):
        dealt = written.where(placed == t).toArrow()
        for start in range(0, dealt.num_rows, sent):
            part = dealt.slice(start, sent)
            found = materialize(_scan_hits(vectors, part["qid"].to_pylist(), _matrix(part["vec"]), k, question_tile), "tile-hits")
            hits = found if hits is None else hits.unionByName(found)
    return hits


class DenseRetriever(Retriever):
    """Bi-encoder retrieval with an injectable encoder."""

    name = "dense"

    def __init__(self, encoder: Encoder | LatentEncoder = LatentEncoder(), question_tile: int = QUESTION_TILE) -> None:
        super().__init__()
        self.encoder = encoder
        self.question_tile = question_tile
        self.vectors: DataFrame | None = None
        self.fitted: Encoder | None = None  # the encoder as a function of Columns
        self.tokens: DataFrame | None = None  # chunk_id, doc_id, tokens of the chunks to index, where they are written already

    @classmethod
    def over(cls, vectors: DataFrame, **params) -> "DenseRetriever":
        """A retriever on (chunk_id, doc_id, vec) rows whose vectors have unit length."""
        retriever = cls(**params)
        retriever.vectors = vectors
        retriever._ready = True
        return retriever

    def encode(self, texts: DataFrame, text_column: str) -> DataFrame:
        unit = l2_normalize(self.fitted(F.col(text_column)))
        return texts.withColumn("vec", unit.cast("array<float>"))

    def _build(self, chunks: DataFrame) -> None:
        def encoded() -> DataFrame:
            if not isinstance(self.encoder, LatentEncoder):
                self.fitted = self.encoder.fit(chunks) if hasattr(self.encoder, "fit") else self.encoder
                return self.encode(chunks, "text").select("chunk_id", "doc_id", "vec")
            tokens = written_tokens(chunks.select("chunk_id", "doc_id", "text")) if self.tokens is None else self.tokens
            self.fitted, rows = self.encoder.fit_tokens(tokens.select("chunk_id", "doc_id", "tokens"))
            return rows.withColumn("vec", l2_normalize(F.col("vec")).cast("array<float>"))

        _, vectors = write_alone(chunks.sparkSession, "vectors", encoded)  # what the fit wrote goes
        if vectors.isEmpty():
            raise ValueError("Cannot index an empty chunk table.")
        self.vectors = vectors

    def search_vectors(self, questions: DataFrame, k: int = 10) -> DataFrame:
        """Search with ready (qid, vec) rows."""
        hits = dense_hits(self.vectors, questions, k, self.question_tile)
        return top_k(hits, k, self.name)

    def _search(self, queries: DataFrame, k: int) -> DataFrame:
        return self.search_vectors(self.encode(queries, "question").select("qid", "vec"), k)
