"""Sharding along a Hilbert curve over several metadata dimensions.

Each dimension is quantised to ``bits`` bits; the curve index of the cell orders the rows,
so that rows near each other on the curve are alike in all dimensions and a file of
consecutive rows covers a small box of the metadata space.  The order is cut into equal
runs: row counts of two shards differ by at most one (the ``rows`` law).

Ranks come from one range shuffle of narrow rows: partitions are sorted and written with
each row's place in its partition, and the places are offset by the partitions' counts
(one number per partition).  Ties on the curve are ordered by text checksum, id and size; for
equal rows the input place spreads them, so copies do not pile up in one partition.

A null dimension falls into cell 0; null ids come first; a null text has no bytes and
checksum 0.  Repeated rows each get a slot; an empty table gives an empty result; with fewer
rows than shards some shards stay empty.  Clashing column names are avoided.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from llm.common import free_names
from rankloom.runtime import materialize

SHARDS = 24
BITS = 5
ROW_BYTES = 8


def text_bytes(text: Column) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + ROW_BYTES


def text_crc32(text: Column) -> Column:
    return F.crc32(F.coalesce(text, F.lit("")).cast("binary"))


def label_cell(value: Column, bits: int = BITS) -> Column:
    """A cell for a label without order: its checksum's low bits."""
    return F.coalesce(F.crc32(value.cast("string").cast("binary")) % (1 << bits), F.lit(0)).cast("int")


def size_cell(value: Column, bits: int = BITS) -> Column:
    """A cell on a logarithmic scale: twice the binary logarithm."""
    return F.least(F.floor(2 * F.log2(F.greatest(value, F.lit(1)))), F.lit((1 << bits) - 1)).cast("int")


def hilbert_index(cells: list[np.ndarray], bits: int) -> np.ndarray:
    """Index along the Hilbert curve of points with *bits* bits a dimension (transpose form, then interleaved)."""
    x = [c.astype(np.int64) for c in cells]
    for level in range(bits - 1, 0, -1):
        bit, low = 1 << level, (1 << level) - 1
        for i in range(len(x)):
            flip = (x[i] & bit) != 0
            swap = np.where(flip, 0, (x[0] ^ x[i]) & low)
            x[0] = x[0] ^ np.where(flip, low, swap)
            if i:
                x[i] = x[i] ^ swap
    for i in range(1, len(x)):
        x[i] = x[i] ^ x[i - 1]
    carry = np.zeros_like(x[0])
    for level in range(bits - 1, 0, -1):
        carry = np.where((x[-1] & (1 << level)) != 0, carry ^ ((1 << level) - 1), carry)
    index = np.zeros_like(x[0])
    for level in range(bits - 1, -1, -1):
        for axis in x:
            index = index << 1 | ((axis ^ carry) >> level & 1)
    return index


def curve_index(dimensions: list[Column], bits: int = BITS) -> Column:
    """The curve index of integer cells as a column; at most 62 bits in all."""
    if bits * len(dimensions) > 62:
        raise ValueError("dimensions times bits must not exceed 62")

    @F.pandas_udf("long")
    def index(*cells: pd.Series) -> pd.Series:
        return pd.Series(hilbert_index([c.to_numpy() for c in cells], bits))

    return index(*(F.coalesce(d.cast("int"), F.lit(0)) for d in dimensions))


def ranked(rows: DataFrame, order: list[str], name: str, total: str) -> DataFrame:
    """*rows*, written once, with their rank from 0 in *order* and the number of rows."""
    part, place, entry = free_names(rows, ["part", "place", "entry"])
    spread = rows.withColumn(entry, F.monotonically_increasing_id()).repartitionByRange(*order, entry)
    placed = materialize(spread.sortWithinPartitions(*order, entry).drop(entry)
                         .withColumn(part, F.spark_partition_id())
                         .withColumn(place, F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))), "placed")
    counts = sorted(placed.groupBy(part).count().collect())  # one number per partition
    starts, seen = [], 0
    for number, count in counts:
        starts.append((number, seen))
        seen += count
    offsets = rows.sparkSession.createDataFrame(starts, f"{part} int, {name} long")
    return placed.join(F.broadcast(offsets), part).withColumn(name, F.col(name) + F.col(place)).withColumn(
        total, F.lit(seen).cast("long")).drop(part, place)


def cut(rank: Column, total: Column, shards: int) -> tuple[Column, Column]:
    """Shard of a rank when *total* rows are cut into equal runs, and the slot in it."""
    shard = F.call_function("div", rank * shards, total)
    first = F.call_function("div", shard * total + (shards - 1), F.lit(shards).cast("long"))
    return shard.cast("int"), rank - first


def shard_documents(docs: DataFrame, dimensions: list[Column] | None = None, shards: int = SHARDS,
                    bits: int = BITS) -> DataFrame:
    """All columns of *docs* with shard, slot, curve and row size under free names ending the row.

    The added columns are named shard, slot, curve, size and text_crc32, with underscores appended on a clash.
    """
    shard, slot, curve, size, crc = free_names(docs, ["shard", "slot", "curve", "size", "text_crc32"])
    dims = dimensions or [label_cell(F.col("lang"), bits), label_cell(F.col("source"), bits),
                          size_cell(text_bytes(F.col("text")), bits)]
    sized = docs.withColumns({size: text_bytes(F.col("text")), crc: text_crc32(F.col("text")),
                              curve: curve_index(dims, bits)})
    rank, total = free_names(sized, ["rank", "total"])
    out = ranked(sized, [curve, crc, "doc_id", size], rank, total)
    where, at = cut(F.col(rank), F.col(total), shards)
    return out.withColumns({shard: where, slot: at}).drop(rank, total)


def shard_digest(docs: DataFrame, shards: int = SHARDS, bits: int = BITS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard, curve; texts themselves are not shuffled."""
    narrow = docs.select(
        "doc_id", text_bytes(F.col("text")).alias("size"), text_crc32(F.col("text")).alias("text_crc32"),
        curve_index([label_cell(F.col("lang"), bits), label_cell(F.col("source"), bits),
                     size_cell(text_bytes(F.col("text")), bits)], bits).alias("curve"))
    out = ranked(narrow, ["curve", "text_crc32", "doc_id", "size"], "rank", "total")
    where, at = cut(F.col("rank"), F.col("total"), shards)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), where.alias("shard"),
                      at.alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "curve")


def shard_ranges(sharded: DataFrame, columns: list[str], shard: str = "shard") -> DataFrame:
    """Least and greatest value of *columns* per shard: what a reader prunes files by."""
    return sharded.groupBy(shard).agg(F.count("*").alias("rows"), *(
        f(c).alias(f"{n}_{c}") for c in columns for n, f in (("min", F.min), ("max", F.max))))


def write_shards(sharded: DataFrame, path: str, shard: str = "shard", slot: str = "slot") -> None:
    """One folder per shard, rows in slot order."""
    sharded.repartition(shard).sortWithinPartitions(shard, slot).write.partitionBy(shard).parquet(path)
