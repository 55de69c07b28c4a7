"""A text encoder fitted on the corpus itself: latent semantic vectors.

The matrix A holds a row of normalised term weights, (1 + ln tf) * idf, for every chunk, over the ``features``
terms that most chunks share.  Its leading right singular vectors are found by block power iteration: a start block drawn
from term hashes is multiplied by A'A and orthonormalised, a few times over.  A text's vector is its weight row times that basis,
so texts come close that share a topic's words, and not only the same words.

The fit reads every chunk, whatever their number.  Known terms are looked up once: a coded table holds the places of each chunk's
terms among the features and their counts, a few bytes a term.  Every product A'(A B) is one pass over it: a task multiplies its own chunks
and hands back one block of ``features`` rows.  At most ``tasks`` of them meet on the driver, so what it holds is
bounded by tasks * features * dims numbers (80 MB by default), whatever the corpus.  The basis, the features and
their idf (under 10 MB) are the model that encodes texts inside tasks; the chunks' own vectors come from the coded table.

Draws are md5 words of seed, block and term, so the model is the same however the chunks are partitioned.
Texts without a known term have the zero vector.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from hashlib import md5

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankloom.functions import scores as sc
from rankloom.functions import text as tx
from rankloom.runtime import materialize

DIMS = 32
FEATURES = 20_000
ITERATIONS = 2
SEED = 42
TASKS = 16
WORDS_PER_DIGEST = 4
BLOCK = 1_000  # chunks in one product


def drawn_row(term: str, dims: int, seed: int) -> np.ndarray:
    """Start values of a term between -0.5 and 0.5, four from each digest."""
    words = b"".join(md5(f"{seed}|latent|{b}|{term}".encode()).digest() for b in range(-(-dims // WORDS_PER_DIGEST)))
    return np.frombuffer(words, dtype=">u4")[:dims] / 2.0 ** 32 - 0.5


@dataclass(frozen=True)
class LatentModel:
    index: dict[str, int]
    idf: np.ndarray
    basis: np.ndarray  # features x dims

    def coded(self, token_lists: pa.ListArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """How many distinct known terms every list has, and the features and counts of these, by list and feature."""
        n, width = len(token_lists), max(1, len(self.index))
        sizes = token_lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
        words = token_lists.flatten().dictionary_encode(null_encoding="encode")
        known = pc.index_in(words.dictionary, value_set=pa.array(list(self.index), pa.string())).fill_null(-1).to_numpy()
        code = known[words.indices.to_numpy()]
        place = np.repeat(np.arange(n), sizes)[code >= 0]
        key, tf = np.unique(place * width + code[code >= 0], return_counts=True)
        return np.bincount(key // width, minlength=n), key % width, tf

    def weighted(self, sizes: np.ndarray, at: np.ndarray, tf: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """Blocks of coded lists: how many, and the places within the block, features and normalised weights of their terms,
        ordered by place."""
        n = len(sizes)
        place = np.repeat(np.arange(n), sizes)
        weight = (1 + np.log(tf)) * self.idf[at]
        norm = np.sqrt(np.bincount(place, weight * weight, n))
        weight /= np.where(norm > 0, norm, 1.0)[place]
        cuts = np.searchsorted(place, np.arange(0, n + BLOCK, BLOCK))
        for i, (begin, end) in enumerate(itertools.pairwise(cuts)):
            yield min(BLOCK, n - i * BLOCK), place[begin:end] - i * BLOCK, at[begin:end], weight[begin:end]

    def project(self, n: int, place: np.ndarray, at: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """The vectors of a block."""
        return _sums(n, place, weight[:, None] * self.basis[at])

    def vectors(self, sizes: np.ndarray, at: np.ndarray, tf: np.ndarray) -> np.ndarray:
        """The vectors of coded lists."""
        blocks = [self.project(*block) for block in self.weighted(sizes, at, tf)]
        return np.concatenate([np.zeros((0, self.basis.shape[1])), *blocks])

    def encode(self, token_lists: pa.ListArray | list) -> np.ndarray:
        if not isinstance(token_lists, pa.Array):
            token_lists = pa.array(token_lists, pa.list_(pa.string()))
        return self.vectors(*self.coded(token_lists))


def _sums(n: int, place: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Sums of *rows* by their places, which are in order."""
    total = np.zeros((n, rows.shape[1]))
    if len(place):
        starts = np.flatnonzero(np.diff(place, prepend=-1))
        total[place[starts]] = np.add.reduceat(rows, starts)
    return total


def feature_table(tokens: DataFrame, features: int) -> DataFrame:
    """term, df, idf of the terms that most chunks have, ties by term; from (chunk_id, tokens)."""
    n = tokens.count()
    df = tokens.select(F.explode(F.array_distinct("tokens")).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    return df.orderBy(F.desc("df"), "term").limit(features).withColumn("idf", sc.idf(n, F.col("df")))


def coded_terms(tokens: DataFrame, index: dict[str, int]) -> DataFrame:
    """The other columns of *tokens*, and at and tf: the features of a chunk's distinct known terms, in order, and their counts."""
    kept = [c for c in tokens.columns if c != "tokens"]
    shared = tokens.sparkSession.sparkContext.broadcast(index)
    kinds = "".join(f"`{c}` {tokens.schema[c].dataType.simpleString()}, " for c in kept)

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = LatentModel(shared.value, np.zeros(0), np.zeros((0, 0)))
        for batch in batches:
            sizes, *lists = held.coded(batch.column(len(kept)))
            ends = pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32())
            columns = [pa.ListArray.from_arrays(ends, pa.array(x, pa.int32())) for x in lists]
            yield pa.RecordBatch.from_arrays([*batch.columns[:len(kept)], *columns], [*kept, "at", "tf"])

    return tokens.select(*kept, "tokens").mapInArrow(code, f"{kinds}at array<int>, tf array<int>")


def _lists(at: pa.ListArray, tf: pa.ListArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Coded lists as arrays."""
    return (at.value_lengths().to_numpy(zero_copy_only=False), at.flatten().to_numpy(zero_copy_only=False),
            tf.flatten().to_numpy(zero_copy_only=False))


def power_step(chunks: DataFrame, model: LatentModel, tasks: int) -> np.ndarray:
    """A'(A B) for the basis B of *model*, from a token table or its coded table."""
    coded = chunks if "at" in chunks.columns else coded_terms(chunks, model.index)
    shared = chunks.sparkSession.sparkContext.broadcast((model.idf, model.basis))

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = LatentModel({}, *shared.value)
        total = np.zeros(held.basis.shape)
        for batch in batches:
            for n, place, at, weight in held.weighted(*_lists(batch.column(0), batch.column(1))):
                vectors = held.project(n, place, at, weight)
                order = np.argsort(at, kind="stable")
                if len(order):
                    starts = np.flatnonzero(np.diff(at[order], prepend=-1))
                    total[at[order][starts]] += np.add.reduceat(weight[order, None] * vectors[place[order]], starts)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["block"])

    few = coded.select("at", "tf").coalesce(tasks)
    # Written by all tasks at once; an iterator over the tasks themselves would run them one after another.
    blocks = materialize(few.mapInArrow(multiply, "block binary"), "latent-blocks").coalesce(1).toLocalIterator()
    return sum((np.frombuffer(bytes(r["block"])).reshape(model.basis.shape) for r in blocks), np.zeros(model.basis.shape))


def orthonormal(block: np.ndarray) -> np.ndarray:
    """The Q of the QR decomposition with a positive diagonal, as Gram-Schmidt gives it; null columns stay null."""
    q, r = np.linalg.qr(block)
    sign = np.where(np.diag(r) < 0, -1.0, 1.0)
    return q * sign * (np.abs(np.diag(r)) > 1e-9 * max(1.0, np.abs(r).max()))


def fit_coded(tokens: DataFrame, dims: int = DIMS, features: int = FEATURES, iterations: int = ITERATIONS,
              seed: int = SEED, tasks: int = TASKS) -> tuple[LatentModel, DataFrame]:
    """The model of a token table (chunk_id, tokens), and its coded table; every chunk counts."""
    terms = feature_table(tokens, features).collect()  # bounded by *features*
    index = {r["term"]: i for i, r in enumerate(terms)}
    idf = np.array([r["idf"] for r in terms])
    dims = min(dims, len(index))  # of fewer terms than dims every term keeps a direction of its own
    basis = np.array([drawn_row(t, dims, seed) for t in index]).reshape(len(index), dims)
    coded = materialize(coded_terms(tokens, index), "latent-codes")
    if dims:
        basis = orthonormal(basis)
        for _ in range(iterations):
            basis = orthonormal(power_step(coded, LatentModel(index, idf, basis), tasks))
    return LatentModel(index, idf, basis), coded


def fit_latent(tokens: DataFrame, dims: int = DIMS, features: int = FEATURES, iterations: int = ITERATIONS,
               seed: int = SEED, tasks: int = TASKS) -> LatentModel:
    """The model of a token table (chunk_id, tokens)."""
    return fit_coded(tokens, dims, features, iterations, seed, tasks)[0]


class LatentEncoder:
    """An encoder that is fitted when its retriever is indexed."""

    def __init__(self, dims: int = DIMS, features: int = FEATURES, iterations: int = ITERATIONS, seed: int = SEED) -> None:
        self.dims, self.features, self.iterations, self.seed = dims, features, iterations, seed

    def __eq__(self, other: object) -> bool:
        return isinstance(other, LatentEncoder) and vars(self) == vars(other)

    def __hash__(self) -> int:
        return hash((self.dims, self.features, self.iterations, self.seed))

    def fit(self, chunks: DataFrame):
        """The encoder as a function of Columns, fitted on *chunks* (chunk_id, text)."""
        return self.fit_tokens(written_tokens(chunks.select("chunk_id", "text")))[0]

    def fit_tokens(self, tokens: DataFrame) -> tuple[Callable[[Column], Column], DataFrame]:
        """The encoder as a function of Columns, fitted on a token table (chunk_id, tokens), and the table's other columns with
        the vector (vec) of every row."""
        model, coded = fit_coded(tokens, self.dims, self.features, self.iterations, self.seed)
        others = [c for c in coded.columns if c not in ("at", "tf")]
        return latent_encoder(model), coded.select(*others, coded_vectors(model, F.col("at"), F.col("tf")).alias("vec"))


def written_tokens(chunks: DataFrame) -> DataFrame:
    """*chunks* with their tokens instead of their text."""
    return materialize(chunks.select(*[c for c in chunks.columns if c != "text"], tx.tokenize(F.col("text")).alias("tokens")), "latent-tokens")


def _vector_lists(vectors: np.ndarray) -> pa.ListArray:
    ends = pa.array(np.arange(len(vectors) + 1, dtype=np.int32) * vectors.shape[1], pa.int32())
    return pa.ListArray.from_arrays(ends, pa.array(vectors.ravel(), pa.float64()))


def coded_vectors(model: LatentModel, at: Column, tf: Column) -> Column:
    """The vectors of a coded table's rows."""
    known = LatentModel({}, model.idf, model.basis)

    @F.arrow_udf("array<double>")
    def encode(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for lists in batches:
            yield _vector_lists(known.vectors(*_lists(*lists)))

    return encode(at, tf)


def latent_encoder(model: LatentModel):
    """A fitted model as a function of Columns."""
    @F.arrow_udf("array<double>")
    def encode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for tokens in batches:
            yield _vector_lists(model.encode(tokens))

    def encoder(text: Column) -> Column:
        return encode(tx.tokenize(text))

    return encoder
