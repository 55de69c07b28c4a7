"""The retriever contract and the ranking steps all retrievers share."""

from __future__ import annotations

from abc import ABC, abstractmethod

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rankloom.functions.scores import ranking_score
from rankloom.runtime import (
    LISTED_KEYS,
    broadcast_if_small,
    estimated_bytes,
    materialize,
    new_table_path,
    rows_with,
    same_rows,
    write_bucketed,
)
from rankloom.schemas import CHUNK_COLUMNS, RUN_COLUMNS, require_columns

QUERY_COLUMNS = ("qid", "question")
BUCKET_BYTES = 12 << 20  # a task sorts a bucket's texts in memory, and indexes them where they lie
MAX_BUCKETS = 100_000
TRUSTED_BYTES = 1 << 50


class DeepRun:
    """A retriever's run over one set of questions, searched and written once at a depth; of a run, which is in order, a search that
    is not as deep has the first ranks."""

    def __init__(self, queries: DataFrame, depth: int) -> None:
        self.queries, self.depth = queries.select(*QUERY_COLUMNS), depth
        self._run: DataFrame | None = None

    def best(self, retriever: "Retriever", queries: DataFrame, k: int) -> DataFrame | None:
        """The best *k*, None when that is too deep or *queries* are not the run's."""
        if k > self.depth or not same_rows(queries, self.queries):
            return None
        if self._run is None:
            self._run = materialize(retriever._search(self.queries, self.depth), "deep-run")
        return self._run.where(F.col("rank") <= k)


class Retriever(ABC):
    """Build once with :meth:`index`, then search whole batches of questions."""

    name: str = ""
    deep: DeepRun | None = None  # the run that searches of its questions share

    def __init__(self) -> None:
        self._ready = False

    @abstractmethod
    def _build(self, chunks: DataFrame) -> None: ...

    @abstractmethod
    def _search(self, queries: DataFrame, k: int) -> DataFrame: ...

    def index(self, chunks: DataFrame) -> "Retriever":
        """Index (chunk_id, doc_id, text, index) rows; building again replaces the old index."""
        require_columns(chunks, CHUNK_COLUMNS, "The chunk table")
        self._build(chunks)
        self._ready = True
        return self

    def search(self, queries: DataFrame, k: int = 10) -> DataFrame:
        """Top *k* chunks for each (qid, question) row, as a run table."""
        if not self._ready:
            raise RuntimeError(f"{type(self).__name__}.search() needs index() first.")
        require_columns(queries, QUERY_COLUMNS, "The query table")
        asked = queries.select(*QUERY_COLUMNS)
        found = self.deep.best(self, asked, k) if self.deep else None
        return self._search(asked, k) if found is None else found

    def search_one(self, question: str, k: int = 10, spark=None) -> DataFrame:
        """Search a single question string."""
        from pyspark.sql import SparkSession

        session = spark or SparkSession.active()
        one = session.createDataFrame([("q0", question)], "qid string, question string")
        return self.search(one, k)


def top_k(scored: DataFrame, k: int, retriever: str) -> DataFrame:
    """Rank (qid, chunk_id, doc_id, score) by score desc, chunk_id asc and keep *k* per qid.

    Spark plans this shape with a group limit below the shuffle, so a question that
    matches everything still sends at most k rows per partition.
    """
    order = Window.partitionBy("qid").orderBy(F.desc("score"), F.asc("chunk_id"))
    return (
        scored.withColumn("score", ranking_score(F.col("score")))
        .withColumn("rank", F.row_number().over(order))
        .filter(F.col("rank") <= k)
        .withColumn("retriever", F.lit(retriever))
        .select(*RUN_COLUMNS)
    )


def fetch(table: DataFrame, run: DataFrame, columns: list[str]) -> DataFrame:
    """The rows of *run* with *columns* of a chunk table.

    The chunk ids of a short run are a list in the scan's filter: on a table bucketed and sorted by chunk id
    (:func:`write_chunks`) only their buckets are opened, and of these the row groups that may hold them.  A longer run is joined,
    without a shuffle of a bucketed table.  Pass a materialised run, so that it is not ranked again.
    """
    listed = rows_with(table, "chunk_id", run.select("chunk_id"), LISTED_KEYS)
    side = broadcast_if_small(run)
    return (table if listed is None else listed).select("chunk_id", *columns).join(side, "chunk_id").select(*run.columns, *columns)


def attach_text(run: DataFrame, chunks: DataFrame) -> DataFrame:
    """Add the chunk text to a run."""
    return fetch(chunks, run, ["text"])


def write_chunks(chunks: DataFrame, n_buckets: int | None = None) -> DataFrame:
    """*chunks* written as a table bucketed and sorted by chunk id, in buckets of about ``BUCKET_BYTES``."""
    spark = chunks.sparkSession
    size = 0 if n_buckets else estimated_bytes(chunks)
    if size > TRUSTED_BYTES:  # rows that come from no file, or a join, have no size worth the name before they are written
        chunks = materialize(chunks, "chunks")
        size = estimated_bytes(chunks)
    n = n_buckets or max(spark.sparkContext.defaultParallelism, min(MAX_BUCKETS, size // BUCKET_BYTES))
    return write_bucketed(chunks.repartition(n, "chunk_id"), new_table_path(spark, "chunks"), "chunk_id", n, ["chunk_id"])
