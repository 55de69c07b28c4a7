"""The test tables in the roles the operators expect.

documents = corpus, benchmark = questions (each whole passage), relevance =
documents that contain the passage, embeddings = ready vectors.  Chunks and indexes are
built once per session and folder, as they would be in a deployment.
"""

from __future__ import annotations

from functools import cached_property

import numpy as np
import pyarrow as pa
from pandas.util import hash_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rankloom.functions import text as tx
from rankloom.operators.bm25 import BM25Retriever
from rankloom.operators.chunking import FixedSizeChunker, SentenceWindowChunker
from rankloom.operators.dense import DenseRetriever
from rankloom.operators.retriever import Retriever
from rankloom.plans.setups import SharedIndexes
from rankloom.runtime import broadcast_if_small, materialize, spread_small_input

KEY_WORDS = 8  # a power of two
# Odd numbers that mix the hashes of two halves.
MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], dtype=np.uint64)

FIXED = FixedSizeChunker(200, 40)
SENTENCES = SentenceWindowChunker(3, 2)


def _window_keys(words: pa.Array) -> pa.Array:
    flat = words.flatten().dictionary_encode()
    hashed = hash_array(np.array(flat.dictionary.to_pylist(), dtype=object), categorize=False)
    keys, apart = hashed[flat.indices.to_numpy(zero_copy_only=False)], 1
    while apart < KEY_WORDS:
        ahead = np.roll(keys, -apart)
        keys, apart = (keys ^ keys >> np.uint64(29)) * MIX[0] + (ahead ^ ahead >> np.uint64(32)) * MIX[1] + MIX[2], 2 * apart
    size = words.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    place = np.arange(len(keys)) - np.repeat(np.cumsum(size) - size, size)
    whole = place + KEY_WORDS <= np.repeat(size, size)  # a window ends in the row it begins in
    ends = np.concatenate([[0], np.cumsum(np.maximum(size - KEY_WORDS + 1, 0))])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(keys[whole].view(np.int64)), mask=words.is_null())


def window_keys(words: Column) -> Column:
    """A hash of every ``KEY_WORDS`` consecutive words, made of the hashes of its halves; none for fewer words."""
    return F.arrow_udf(_window_keys, "array<long>")(words)  # made per call: it belongs to one session


class Fixtures:
    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark = spark
        self.folder = folder

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    @property
    def documents(self) -> DataFrame:
        rows = self.table("documents").select(
            F.col("doc_id").cast("string").alias("doc_id"), F.lit("").alias("title"), "text", "source")
        return spread_small_input(rows)

    @cached_property
    def questions(self) -> DataFrame:
        """qid, question, passage."""
        return materialize(self.table("benchmark").select(
            F.col("item_id").cast("string").alias("qid"),
            F.col("text").alias("question"),
            F.col("text").alias("passage")), "questions")

    @property
    def queries(self) -> DataFrame:
        return self.questions.select("qid", "question")

    @cached_property
    def qrels(self) -> DataFrame:
        """qid, doc_id where the document contains the whole passage.

        Both sides meet on a hash of eight consecutive words from inside the passage, whose first and last word
        may be parts of longer ones in a document.  A passage too short for that meets the documents by its one longest
        inner word, or all documents if it has none.  Only those candidates are compared as text.
        """
        asked = self.questions.select("qid", "passage", F.slice(
            tx.split_whitespace(F.col("passage")), 2, F.greatest(F.size(tx.split_whitespace(F.col("passage"))) - 2, F.lit(0))).alias("inner"))
        long_ = asked.where(F.size("inner") >= KEY_WORDS).select(
            "qid", F.get(window_keys(F.slice("inner", 1, KEY_WORDS)), F.lit(0)).alias("key"))
        longest = F.array_max(F.transform("inner", lambda w: F.struct(F.length(w), w.alias("word"))))["word"]
        short = asked.where(F.size("inner") < KEY_WORDS).select("qid", F.xxhash64(longest).alias("key"), F.size("inner").alias("n"))

        words = tx.split_whitespace(F.col("text"))
        # Catalyst broadcasts the questions while their table is small, and shuffles them if not.
        found = self.documents.select("doc_id", F.explode(window_keys(words)).alias("key")).join(long_, "key").select("qid", "doc_id")
        if not short.isEmpty():
            by_word = self.documents.select("doc_id", F.explode(F.transform(F.array_distinct(words), lambda word: F.xxhash64(word))).alias("key"))
            found = found.unionByName(by_word.join(short.where("n > 0").drop("n"), "key").select("qid", "doc_id"))
            # Passages without an inner word are a stated set, compared with every document.
            bare = broadcast_if_small(short.where("n = 0").join(asked.select("qid", "passage"), "qid"), 10_000)
            found = found.unionByName(self.documents.join(bare, F.contains("text", "passage")).select("qid", "doc_id"))
        candidates = materialize(found.distinct(), "pairs")
        return materialize(
            self.documents.select("doc_id", "text")
            .join(candidates, "doc_id").join(self.questions.select("qid", "passage"), "qid")
            .filter(F.contains("text", "passage"))
            .select("qid", "doc_id"), "qrels")

    @cached_property
    def shared(self) -> SharedIndexes:
        return SharedIndexes(self.documents)

    def chunks(self, chunker=FIXED) -> DataFrame:
        return self.shared.chunks(chunker)

    def bm25(self, chunker=FIXED, **params) -> BM25Retriever:
        return self.shared.index(BM25Retriever(**params), chunker)

    def dense(self, chunker=FIXED) -> DenseRetriever:
        return self.shared.index(DenseRetriever(), chunker)

    def search(self, retriever: Retriever, k: int = 10) -> DataFrame:
        return retriever.search(self.queries, k)


_open: dict[tuple[str, str], Fixtures] = {}


def fixtures(spark: SparkSession, folder: str) -> Fixtures:
    key = (spark.sparkContext.applicationId, folder)
    if key not in _open:
        _open[key] = Fixtures(spark, folder)
    return _open[key]
