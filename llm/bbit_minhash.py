"""Near-duplicates by b-bit MinHash, links confirmed on whole shingle sets.

Texts with equal shingle sets are one node; everything below works on distinct sets.

1. *Signature.*  ``HASHES`` minima of a set under different hash functions.  Whole minima, ``ROWS`` at a time,
   make the band keys; of each minimum only the low ``BITS`` bits are retained, packed into longs.
2. *Candidates.*  Sets with an equal band key share a bucket.  A pair at the bound of 0.85 shares none of the 24
   buckets less than once in a million.  Members of a bucket are paired with its first and last member, never all with all.
3. *Estimate.*  Equal low bits of two signatures are counted by bit operations.  Different minima agree by
   chance in C = 2^-b of the places, so similarity is estimated as (share - C) / (1 - C).  Pairs ``SURE`` standard
   errors or more below the bound are dropped (a true pair is, once in 10^9), as are pairs whose sizes rule it out.
4. *Confirmation.*  The whole sets of all other pairs are intersected; only these links count.
5. *Open buckets.*  Linked sets are joined to groups.  Where a bucket of four or more sets still holds several groups,
   pairs of different groups meet in cells of bounded size, pass the same estimate and are confirmed by
   matrix products over the hashes that they share.  So whatever shares a bucket is either linked or compared.

Whole sets are those of 64-bit hashes, nodes are 128-bit hashes of sets.

Texts without words and null texts have no shingle and no link.  The smallest id of a component skips null ids; a component
of null ids only has a null id.  Repeated rows each get a row; a null id equals a null
component, so such rows are kept.  An empty table gives none; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from llm.cells import CELL_ROWS, open_cells
from llm.common import small_batches
from llm.components import components
from llm.covering_simhash import shingles
from rankloom.runtime import materialize

WORDS = 3
#: Sets are linked when 100 times their intersection is at least so many times their union.
PERCENT = 85
HASHES = 128
BANDS = 24
ROWS = 5
BITS = 4
SURE = 6
#: Up to so many text digests are sent to the texts, beyond that the texts move to the digests.
SENT_DIGESTS = 200_000
#: A cell's row counts once more for every so many shingles, as it brings all of them.
ROW_SHINGLES = 4_096
BLOCK = 8_192
_draw = np.random.default_rng(11)
FACTORS = _draw.integers(0, 2 ** 63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
LONGS = HASHES * BITS // 64
CHANCE = 2.0 ** -BITS
#: The lowest bit of every retained minimum.
LOWEST = sum(1 << k for k in range(0, 64, BITS))


def shingle_set(data: bytes, words: int) -> np.ndarray:
    """Hashes of a text's distinct shingles, ascending."""
    return np.unique(np.fromiter((xxhash.xxh64_intdigest(x, 7) for x in shingles(data, words)), dtype=np.uint64))


def minima(hashes: np.ndarray) -> np.ndarray:
    least = np.full(HASHES, np.iinfo(np.uint64).max, dtype=np.uint64)
    for s in range(0, len(hashes), BLOCK):
        mixed = hashes[s:s + BLOCK, None] * FACTORS[None, :]
        mixed ^= mixed >> np.uint64(32)
        np.minimum(least, mixed.min(axis=0), out=least)
    return least


def pack(least: np.ndarray) -> np.ndarray:
    """The low bits of the minima as longs."""
    places = np.arange(HASHES, dtype=np.uint64).reshape(LONGS, -1) % np.uint64(64 // BITS) * np.uint64(BITS)
    low = (least & np.uint64(2 ** BITS - 1)).reshape(LONGS, -1)
    return np.bitwise_or.reduce(low << places, axis=1)


def signature(data: bytes, words: int) -> tuple[bytes | None, int, list[int], list[int]]:
    """Node, size, band keys and packed bits of a text; no node without words."""
    hashes = shingle_set(data, words)
    if not len(hashes):
        return None, 0, [], []
    least = minima(hashes)
    rows = least[:BANDS * ROWS].reshape(BANDS, ROWS)
    keys = np.array([xxhash.xxh64_intdigest(row.tobytes(), k) for k, row in enumerate(rows)], dtype=np.uint64)
    return xxhash.xxh3_128_digest(hashes.tobytes()), len(hashes), keys.view(np.int64).tolist(), pack(least).view(np.int64).tolist()


def floor_matches(percent: int) -> int:
    """The least number of equal places that a pair at the bound shows, but for ``SURE`` standard errors."""
    share = CHANCE + (1 - CHANCE) * percent / 100
    return int(np.ceil(HASHES * share - SURE * (HASHES * share * (1 - share)) ** 0.5))


def estimate(matches: Column) -> Column:
    """Similarity from the number of equal places, corrected for agreement by chance."""
    return (matches / HASHES - CHANCE) / (1 - CHANCE)


def equal_places(a: Column, b: Column) -> Column:
    """How many retained minima of two packed signatures agree."""
    differing = F.lit(0)
    for k in range(LONGS):
        x = folded = a[k].bitwiseXOR(b[k])
        for s in range(1, BITS):
            folded = folded.bitwiseOR(F.shiftrightunsigned(x, s))
        differing = differing + F.bit_count(folded.bitwiseAND(F.lit(LOWEST)))
    return F.lit(HASHES) - differing


def signatures(docs: DataFrame, words: int) -> DataFrame:
    """Per row: doc_id, digest (of the text), node, size, keys (of its bands), bits."""
    small_batches(docs.sparkSession)
    kind = docs.select("doc_id").schema[0].dataType.simpleString()

    def mark(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            digests, seen, found = batch.column(1).to_pylist(), {}, []
            for digest, text in zip(digests, batch.column(2).cast(pa.binary()), strict=True):
                if digest not in seen:
                    seen[digest] = signature(text.as_py() or b"", words)
                found.append(seen[digest])
            node, size, keys, bits = zip(*found, strict=True) if found else [()] * 4
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(node, pa.binary()), pa.array(size, pa.int64()),
                 pa.array(keys, pa.list_(pa.int64())), pa.array(bits, pa.list_(pa.int64()))],
                ["doc_id", "digest", "node", "size", "keys", "bits"])

    return docs.select("doc_id", F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("digest"), "text").mapInArrow(
        mark, f"doc_id {kind}, digest string, node binary, size long, keys array<long>, bits array<long>")


def whole_sets(docs: DataFrame, wanted: DataFrame, words: int) -> DataFrame:
    """(node, all): the whole shingle sets of the *wanted* (node, digest)."""
    wanted = materialize(wanted.distinct(), "wanted-sets")
    few = wanted.limit(SENT_DIGESTS + 1).count() <= SENT_DIGESTS
    digest = F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("digest")
    texts = docs.select(digest, "text").join(F.broadcast(wanted) if few else wanted, "digest").groupBy("node").agg(
        F.first("text").alias("text"))

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_set(x.as_py() or b"", words).view(np.int64) for x in batch.column(1).cast(pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.list_(pa.int64()))], ["node", "all"])

    return materialize(texts.mapInArrow(cut, "node binary, all array<long>"), "whole-sets")


def shared_buckets(nodes: DataFrame) -> DataFrame:
    """(bucket, node, first, last, n, mixed) of the buckets with several nodes; *mixed* tells apart who is in a bucket."""
    members = nodes.select(F.explode("keys").alias("bucket"), "node")
    ends = members.groupBy("bucket").agg(
        F.min("node").alias("first"), F.max("node").alias("last"), F.count("*").alias("n"),
        F.bit_xor(F.xxhash64("node")).alias("mixed")).where("first < last")
    return members.join(ends, "bucket")


def star_pairs(shared: DataFrame) -> DataFrame:
    """(a, b): every member with the first and last of its bucket, each pair once."""
    return shared.select(F.col("node").alias("a"), F.explode(F.array("first", "last")).alias("b")).where("a <> b").select(
        F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def likely_pairs(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """The *pairs* whose sizes and estimated similarity allow a link: a, b, similarity."""
    def side(name: str) -> DataFrame:
        return nodes.select(F.col("node").alias(name), F.col("bits").alias(f"bits_{name}"), F.col("size").alias(f"size_{name}"))

    sized = 100 * F.least("size_a", "size_b") >= percent * F.greatest("size_a", "size_b")
    return pairs.join(side("a"), "a").join(side("b"), "b").where(sized).select(
        "a", "b", equal_places(F.col("bits_a"), F.col("bits_b")).alias("matches")).where(
        F.col("matches") >= floor_matches(percent)).select("a", "b", estimate(F.col("matches")).alias("similarity"))


def confirmed(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, percent: int, words: int) -> DataFrame:
    """The *pairs* (a, b) whose whole sets are similar enough."""
    pairs = materialize(pairs, "likely-pairs")
    ends = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    sets = whole_sets(docs, ends.join(nodes.select("node", "digest"), "node"), words)
    shared = F.size(F.array_intersect("all_a", "all_b"))
    return pairs.join(sets.select(F.col("node").alias("a"), F.col("all").alias("all_a")), "a").join(
        sets.select(F.col("node").alias("b"), F.col("all").alias("all_b")), "b").select(
        "a", "b", shared.alias("shared"), (F.size("all_a") + F.size("all_b")).alias("sum")).where(
        F.lit(100) * F.col("shared") >= percent * (F.col("sum") - F.col("shared"))).select("a", "b")


def intersections(sets: list[np.ndarray], columns: int = 4_096) -> np.ndarray:
    """Sizes of the intersections of all *sets* with each other, by matrix products over hashes of several sets."""
    sizes = [len(s) for s in sets]
    rows = np.repeat(np.arange(len(sets)), sizes)
    _, column, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    number = np.cumsum(times > 1) - 1  # hashes of a single set have no column
    rows, column = rows[times[column] > 1], number[column[times[column] > 1]]
    order = np.argsort(column, kind="stable")
    rows, column = rows[order], column[order]
    found = np.zeros((len(sets), len(sets)), dtype=np.int64)
    for start in range(0, int((times > 1).sum()), columns):
        low, high = np.searchsorted(column, [start, start + columns])
        held = np.zeros((len(sets), columns), dtype=np.float32)
        held[rows[low:high], column[low:high] - start] = 1
        found += (held @ held.T).astype(np.int64)
    return found


def cell_links(cell: pd.DataFrame, percent: int) -> list[tuple[bytes, bytes]]:
    """Links between the groups of a cell (node, group, bits, all): a forest over what is similar enough."""
    nodes, group = cell["node"].to_numpy(), pd.factorize(cell["group"])[0]
    bits = np.stack(cell["bits"].to_list()).view(np.uint64)
    sizes = cell["all"].map(len).to_numpy()
    floor, n = floor_matches(percent), len(cell)
    near = np.zeros((n, n), dtype=bool)
    for s in range(0, n, 128):
        x = bits[s:s + 128, None, :] ^ bits[None, :, :]
        folded = x.copy()
        for k in range(1, BITS):
            folded |= x >> np.uint64(k)
        matches = HASHES - np.bitwise_count(folded & np.uint64(LOWEST)).sum(axis=2, dtype=np.int64)
        mine = sizes[s:s + 128, None]
        near[s:s + 128] = (matches >= floor) & (group[s:s + 128, None] != group[None, :]) & (
            100 * np.minimum(mine, sizes) >= percent * np.maximum(mine, sizes))
    open_ = np.flatnonzero(near.any(axis=1))
    if not len(open_):
        return []
    shared = intersections([cell["all"].iloc[i] for i in open_])
    union = sizes[open_][:, None] + sizes[open_][None, :] - shared
    near = near[np.ix_(open_, open_)] & (100 * shared >= percent * union)
    links, left = [], np.ones(len(open_), dtype=bool)
    for root in range(len(open_)):
        queue = [root] if left[root] else []
        left[root] = False
        while queue:
            x = queue.pop()
            fresh = np.flatnonzero(near[x] & left)
            left[fresh] = False
            queue += fresh.tolist()
            links += [(nodes[open_[x]], nodes[open_[y]]) for y in fresh]
    return links


def crowd_links(shared: DataFrame, groups: DataFrame, nodes: DataFrame, docs: DataFrame, percent: int, words: int,
                cell_rows: int = CELL_ROWS) -> DataFrame | None:
    """Links (a, b) between *groups* (node, root) within the buckets that stars leave open; None if there are none."""
    crowds = shared.where("n > 3")
    # Of buckets with the same members one is enough.
    once = crowds.groupBy("n", "mixed", "first", "last").agg(F.min("bucket").alias("bucket")).select("bucket")
    weight = (1 + F.floor(F.col("size") / ROW_SHINGLES)).cast("int").alias("weight")
    members = materialize(crowds.select("bucket", "node").join(once, "bucket", "left_semi").join(groups, "node", "left").join(
        nodes.select("node", weight), "node").select("bucket", "node", F.coalesce("root", "node").alias("group"), "weight"), "crowds")
    cells = materialize(open_cells(members, cell_rows), "cells")
    if cells.isEmpty():
        return None
    wanted = cells.select("node").distinct().join(nodes.select("node", "digest", "bits"), "node")
    rows = whole_sets(docs, wanted.select("node", "digest"), words).join(nodes.select("node", "bits"), "node")

    def link(cell: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame(cell_links(cell, percent), columns=["a", "b"], dtype=object)

    return cells.join(rows, "node").groupBy("bucket", "i", "j").applyInPandas(link, "a binary, b binary")


def minhash_components(docs: DataFrame, percent: int = PERCENT, words: int = WORDS, cell_rows: int = CELL_ROWS) -> DataFrame:
    """Per row of *docs* (doc_id, text): doc_id, n_shingles, component_id, kept."""
    marked = materialize(signatures(docs, words), "signatures")
    nodes = materialize(marked.where("node IS NOT NULL").groupBy("node").agg(
        F.min("doc_id").alias("id"), F.first("digest").alias("digest"), F.first("size").alias("size"),
        F.first("keys").alias("keys"), F.first("bits").alias("bits")), "nodes")
    shared = materialize(shared_buckets(nodes), "shared-buckets")
    likely = likely_pairs(star_pairs(shared), nodes, percent).select("a", "b")
    groups = components(confirmed(likely, nodes, docs, percent, words))
    more = crowd_links(shared, groups, nodes, docs, percent, words, cell_rows)
    if more is not None:
        groups = components(groups.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(more))
    rooted = nodes.select("node", "id").join(groups, "node", "left").select("node", "id", F.coalesce("root", "node").alias("root"))
    smallest = rooted.groupBy("root").agg(F.min("id").alias("component_id"))
    labels = materialize(rooted.join(smallest, "root").select("node", "component_id"), "labels")
    found = marked.select("doc_id", F.col("size").alias("n_shingles"), "node").join(labels, "node", "left")
    component = F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return found.select("doc_id", "n_shingles", component.alias("component_id")).withColumn(
        "kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
