"""SimHash near-duplicates by covering locality-sensitive hashing.

Fingerprints have 64 bits.  For radius r every bit position gets a vector of r + 1 bits, not
zero, and every non-zero vector v makes a table whose mask keeps the positions with an odd
inner product with v.  The vectors of up to r differing positions span at most r
dimensions, so some v is orthogonal to them all: in that table the two masked fingerprints
are equal.  With r = 3 there are 15 tables keeping about 34 bits each, and *every* pair
within the radius meets in one of them.

Only distinct fingerprints enter the tables, so copies cost nothing.  Buckets stream
through tasks in sorted order and leave a spanning forest of links, never all pairs.  A
bucket of more than ``BUCKET_ROWS`` fingerprints is not held in memory: its rows go on to
15 finer tables over the bits that its mask left out, under the same guarantee, so
nothing is lost.  The third level leaves seven bits open, so a bucket there holds at most 128
fingerprints and no level follows.

Null and empty texts have the fingerprint zero, which links like any other.  Null ids are
never the smallest; a component of null ids only has a null id.  Repeated rows each get a
row; an empty table gives none; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import islice

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from llm.common import small_batches
from llm.components import components
from rankloom.runtime import materialize

BITS = 64
RADIUS = 3
SEED = 42
WORDS = 3
BLOCK = 65_536
#: Fingerprints of one bucket that a task compares at once.
BUCKET_ROWS = 4_096


def shingles(data: bytes, size: int) -> Iterator[bytes]:
    """Word runs of UTF-8 *data*, A-Z lower-cased; bytes split and lower by ASCII rules only."""
    words = data.lower().split()
    if len(words) < size:
        return iter([b" ".join(words)] if words else [])
    return map(b" ".join, zip(*(words[k:] for k in range(size)), strict=False))


def simhash(data: bytes, size: int = WORDS, seed: int = SEED) -> int:
    """Majority bit by bit over the shingles' XXH64; zero without words."""
    pieces, total, ones = shingles(data, size), 0, np.zeros(BITS, dtype=np.int64)
    while block := [xxhash.xxh64_intdigest(x, seed) for x in islice(pieces, BLOCK)]:
        hashes = np.array(block, dtype=">u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(hashes, axis=1).sum(axis=0, dtype=np.int64)
        total += len(block)
    return int.from_bytes(np.packbits(2 * ones > total).tobytes(), "big", signed=True) if total else 0


def fingerprints(docs: DataFrame, size: int = WORDS, seed: int = SEED) -> DataFrame:
    """doc_id and fingerprint (long, its bits read as signed) of every row."""
    small_batches(docs.sparkSession)

    def mark(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).cast(pa.binary())
            found = [simhash(x.as_py() or b"", size, seed) for x in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.int64())], ["doc_id", "fingerprint"])

    kind = docs.select("doc_id").schema[0].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(mark, f"doc_id {kind}, fingerprint long")


def masks(positions: list[int], radius: int) -> list[int]:
    """Bit masks over *positions* such that any *radius* of them are all left out by one mask."""
    vectors = 2 ** (radius + 1) - 1
    return [sum(1 << p for k, p in enumerate(positions) if ((k % vectors + 1) & v).bit_count() % 2)
            for v in range(1, vectors + 1)]


def finer(mask: int, radius: int) -> list[int]:
    """Masks that keep what *mask* keeps and cover the rest."""
    return [mask | m for m in masks([p for p in range(BITS) if not mask >> p & 1], radius)]


def _signed(mask: int) -> int:
    return mask - (1 << BITS) if mask >> (BITS - 1) else mask


def forest(points: np.ndarray, radius: int) -> Iterator[tuple[int, int]]:
    """(point, first point of its group) for groups linked within *radius*."""
    left = points
    while len(left) > 1:
        root, queue, left = left[0], [left[0]], left[1:]
        while queue and len(left):
            near = np.bitwise_count(left ^ queue.pop()) <= radius
            queue.extend(left[near])
            for x in left[near]:
                yield int(x), int(root)
            left = left[~near]


def bucket_links(rows: DataFrame, radius: int, bucket_rows: int) -> DataFrame:
    """From (table, key, point): links (a, b, table null), and the points (a) of buckets too large, with their table."""
    def link(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept, spilling = None, None

        def out(a, b, table) -> pd.DataFrame:
            return pd.DataFrame({"a": pd.array(a, "Int64"), "b": pd.array(b, "Int64"), "table": pd.array(table, "Int64")})

        def close(run: pd.DataFrame) -> list[tuple[int, int]]:
            return list(forest(run["point"].to_numpy().view(np.uint64), radius)) if len(run) > 1 else []

        for batch in batches:
            rows = batch if kept is None else pd.concat([kept, batch], ignore_index=True)
            table, key = rows["table"].to_numpy(), rows["key"].to_numpy()
            starts = np.r_[0, np.flatnonzero((table[1:] != table[:-1]) | (key[1:] != key[:-1])) + 1, len(rows)]
            links, over_points, over_tables = [], [], []
            points = rows["point"].to_numpy().view(np.uint64)
            for s, e in zip(starts[:-1], starts[1:], strict=True):
                last, bucket = e == len(rows), (table[s], key[s])
                if bucket == spilling or e - s > bucket_rows:
                    spilling = bucket
                    over_points.append(points[s:e])
                    over_tables.append(table[s:e])
                elif last:
                    continue
                elif e - s > 1:
                    links.extend(forest(points[s:e], radius))
            s = starts[-2]
            kept = None if (table[s], key[s]) == spilling else rows.iloc[s:].reset_index(drop=True)
            if links:
                pair = np.array(links, dtype=np.uint64).view(np.int64).reshape(-1, 2)
                yield out(pair[:, 0], pair[:, 1], [None] * len(pair))
            if over_points:
                a = np.concatenate(over_points).view(np.int64)
                yield out(a, [None] * len(a), np.concatenate(over_tables))
        if kept is not None and (links := close(kept)):
            pair = np.array(links, dtype=np.uint64).view(np.int64).reshape(-1, 2)
            yield out(pair[:, 0], pair[:, 1], [None] * len(pair))

    return rows.repartition("table", "key").sortWithinPartitions("table", "key").mapInPandas(
        link, "a long, b long, table long")


def links_within(points: DataFrame, radius: int = RADIUS, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Links (a, b) whose components are those of all pairs of distinct *points* within *radius*."""
    tables = masks(list(range(BITS)), radius)
    rows = points.select(F.explode(F.array(*(F.struct(
        F.lit(t).cast("long").alias("table"), F.col("point").bitwiseAND(F.lit(_signed(m))).alias("key"))
        for t, m in enumerate(tables)))).alias("x"), "point").select("x.table", "x.key", "point")
    found = None
    while True:
        level = materialize(bucket_links(rows, radius, bucket_rows), "bucket-links")
        links = level.where("table IS NULL").select("a", "b")
        found = links if found is None else found.unionAll(links)
        over = level.where("table IS NOT NULL").select(F.col("a").alias("point"), "table")
        used = sorted(r[0] for r in over.select("table").distinct().collect())  # at most as many as tables
        if not used:
            return found
        # Finer tables only for the tables with an overfull bucket; a mask without free bits holds one point.
        next_tables = [(t, m) for t in used for m in finer(tables[t], radius)]
        names = points.sparkSession.createDataFrame(
            [(t, n, _signed(m)) for n, (t, m) in enumerate(next_tables)], "table long, next long, mask long")
        rows = over.distinct().join(F.broadcast(names), "table").select(
            F.col("next").alias("table"), F.col("point").bitwiseAND(F.col("mask")).alias("key"), "point").distinct()
        tables = [m for _, m in next_tables]


def simhash_components(docs: DataFrame, size: int = WORDS, radius: int = RADIUS,
                       bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Per row of *docs*: doc_id, fingerprint (16 hexadecimal digits), component_id."""
    marked = materialize(fingerprints(docs, size), "fingerprints")
    points = materialize(marked.groupBy(F.col("fingerprint").alias("point")).agg(F.min("doc_id").alias("first")), "points")
    roots = components(links_within(points.select("point"), radius, bucket_rows))
    rooted = points.join(roots.withColumnRenamed("node", "point"), "point", "left").select(
        "point", "first", F.coalesce("root", "point").alias("root"))
    smallest = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    labels = materialize(rooted.join(smallest, "root").select(F.col("point").alias("fingerprint"), "component_id"), "labels")
    return marked.join(labels, "fingerprint").select(
        "doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")
