"""Chunkers: one document row in, many overlapping chunk rows out.

A chunker is any object with a ``name`` and a ``chunk(docs) -> chunks``; the
result has the columns of ``schemas.CHUNK_COLUMNS`` plus typed positions.  Both
chunkers are map-only: windows are cut inside the row and exploded once, so the
word or sentence array is never copied per window and nothing is shuffled.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankloom.functions import text as tx
from rankloom.runtime import has_rows


class Chunker(Protocol):
    name: str

    def chunk(self, docs: DataFrame) -> DataFrame: ...


def _windows(items: Column, size: int, step: int) -> Column:
    """Array of (start, length, joined text) for windows starting every *step* items."""
    def cut(bound: Column) -> Column:
        n = F.size(bound)
        windows = F.transform(
            F.sequence(F.lit(0), n - 1, F.lit(step)),
            lambda start: F.struct(
                start.alias("start"),
                F.least(F.lit(size), n - start).alias("length"),
                F.array_join(F.slice(bound, start + 1, size), " ").alias("text"),
            ),
        )
        return F.when(n > 0, windows)

    return tx.bind(items, cut)  # splitting is the expensive part, so it happens once per row


def _cut(docs: DataFrame, items: Column, size: int, step: int, label: str) -> DataFrame:
    """chunk_id, doc_id, text, index, start, length for every window of every document."""
    exploded = docs.filter(~tx.is_blank(F.col("text"))).select(
        F.col("doc_id").cast("string").alias("doc_id"), F.inline(_windows(items, size, step)))
    index = F.expr(f"start div {step}").cast("int")
    return exploded.select(
        F.concat_ws("::", "doc_id", F.lit(label), index.cast("string")).alias("chunk_id"),
        "doc_id",
        "text",
        index.alias("index"),
        "start",
        "length",
    )


class FixedSizeChunker:
    """Windows of *chunk_size* words, each repeating the last *overlap* words of the one before."""

    name = "fixed"

    def __init__(self, chunk_size: int = 200, overlap: int = 40) -> None:
        if chunk_size < 1 or overlap < 0:
            raise ValueError("chunk_size must be positive and overlap not negative")
        if overlap >= chunk_size:
            raise ValueError(f"overlap ({overlap}) must be smaller than chunk_size ({chunk_size})")
        self.chunk_size = chunk_size
        self.overlap = overlap

    def chunk(self, docs: DataFrame) -> DataFrame:
        words = tx.split_whitespace(F.col("text"))
        cut = _cut(docs, words, self.chunk_size, self.chunk_size - self.overlap, self.name)
        return cut.select(
            "chunk_id", "doc_id", "text", "index",
            F.col("start").alias("word_start"),
            (F.col("start") + F.col("length") - 1).alias("word_end"),
            F.lit(self.name).alias("chunker"),
        )


class SentenceWindowChunker:
    """Windows of *window_size* sentences, advancing by *stride* sentences."""

    name = "sentence_window"

    def __init__(self, window_size: int = 3, stride: int = 2) -> None:
        if not 1 <= stride <= window_size:
            raise ValueError(f"stride ({stride}) must lie in 1..window_size ({window_size})")
        self.window_size = window_size
        self.stride = stride

    def chunk(self, docs: DataFrame) -> DataFrame:
        sentences = tx.chunk_sentences(F.col("text"))
        cut = _cut(docs, sentences, self.window_size, self.stride, self.name)
        return cut.select(
            "chunk_id", "doc_id", "text", "index",
            F.col("start").alias("sent_start"),
            (F.col("start") + F.col("length") - 1).alias("sent_end"),
            F.col("length").alias("num_sentences"),
            F.lit(self.name).alias("chunker"),
        )


class FunctionChunker:
    """A chunker from a Python function ``split(text) -> list of texts``, Arrow-batched."""

    def __init__(self, name: str, split: Callable[[str], list[str]]) -> None:
        self.name = name
        self.split = split

    def chunk(self, docs: DataFrame) -> DataFrame:
        split = self.split

        def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                rows = [(doc_id, text, i) for doc_id, whole in zip(batch["doc_id"], batch["text"])
                        if whole.strip() for i, text in enumerate(split(whole))]
                yield pd.DataFrame(rows, columns=["doc_id", "text", "index"])

        parts = docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text").mapInPandas(
            cut, "doc_id string, text string, index int")
        chunk_id = F.concat_ws("::", "doc_id", F.lit(self.name), F.col("index").cast("string"))
        return parts.select(chunk_id.alias("chunk_id"), "doc_id", "text", "index",
                            F.lit(self.name).alias("chunker"))


def chunk_corpus(docs: DataFrame, chunker: Chunker) -> DataFrame:
    """Chunk a whole corpus; an empty corpus is an error."""
    if not has_rows(docs):
        raise ValueError("The corpus has no documents to chunk.")
    return chunker.chunk(docs)
