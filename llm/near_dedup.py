"""Near-duplicate removal for the pipeline: covering SimHash, completed to a similarity of 0.8.

Texts count as near copies when the Jaccard similarity of their five-word shingles is 0.8 or
more.  Candidates come from two sides:

* SimHash fingerprints of the shingles within 3 bits, by the covering tables of
  :mod:`llm.covering_simhash`.  That finds the closest copies only: at a similarity of 0.8 two
  64-bit fingerprints differ in ten bits on average, and covering ten bits would take 2,047 tables.
* Twenty bands of five minima over the same shingles, which miss a pair at 0.8 about three times in ten thousand.

Buckets of either kind first link their members to their first and last member only, never
to each other.  Every candidate is verified: bottom-k sketches decide texts of up to ``SKETCH`` distinct
shingles together, and beyond that the pairs whose estimate lies ``SURE`` standard errors (0.15 at 0.8)
or more from the bound.  All others are decided by their whole shingle sets, which are
made for the texts of such pairs only.  Verified links are joined to groups.  Buckets of four or more members that still hold
several groups are then compared across these groups, so that no pair that shares a bucket stays
unseen: a bucket is cut into cells of at most about ``CELL_ROWS`` rows a side, the rows of its
largest group meeting only those of the others, and every cell leaves a forest of links.
The row with the smallest id of each final group stays.

Exact copies share one node by their digest, texts without words included; null counts as
the empty text.  Null ids are kept only where a group has no other.  Repeated rows are copies.
An empty table gives an empty result; all columns are kept, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from llm.common import free_names, small_batches
from llm.components import components
from llm.covering_simhash import RADIUS, links_within, shingles, simhash
from rankloom.runtime import materialize

WORDS = 5
SIMILARITY = 0.8
BANDS = 20
ROWS = 5
SKETCH = 256
#: Standard errors by which a sketch must clear the bound; an estimate is off by more once in 10^9.
SURE = 6
#: A cell's row counts once more for every so many shingles, as it brings all of them.
ROW_SHINGLES = 4_096
#: Up to so many digests are sent to the texts, beyond that the texts move to the digests.
SENT_DIGESTS = 200_000
BLOCK = 8_192
#: Rows of a bucket on either side of a comparison in one task.
CELL_ROWS = 2_048
#: Fills short sketches; no 32-bit value equals it.
PAD = 1 << 40
_draw = np.random.default_rng(20)
FACTORS = _draw.integers(0, 2 ** 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_hashes(data: bytes, words: int = WORDS) -> np.ndarray:
    """The hashes of a text's distinct shingles, ascending."""
    return np.unique(np.fromiter((xxhash.xxh64_intdigest(x, 1) for x in shingles(data, words)), dtype=np.uint64))


def sketch(data: bytes, words: int = WORDS) -> tuple[list[int], list[int], int]:
    """Bottom-k sketch (high 32 bits as signed numbers, ascending), band hashes and size of a text's shingle set."""
    distinct = shingle_hashes(data, words)
    if not len(distinct):
        return [], [], 0
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, dtype=np.uint64)
    for s in range(0, len(distinct), BLOCK):
        mixed = distinct[s:s + BLOCK, None] * FACTORS[None, :]
        least = np.minimum(least, (mixed ^ (mixed >> np.uint64(32))).min(axis=0))
    bands = [xxhash.xxh64_intdigest(row.tobytes()) for row in least.reshape(BANDS, ROWS)]
    low = np.unique((distinct >> np.uint64(32)).astype(np.uint32).view(np.int32))[:SKETCH]
    return low.tolist(), np.array(bands, dtype=np.uint64).view(np.int64).tolist(), len(distinct)


def sketches(texts: DataFrame) -> DataFrame:
    """digest, id, point (SimHash), low (sketch), bands, size (distinct shingles) of (digest, id, text)."""
    small_batches(texts.sparkSession)

    def mark(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data = [x.as_py() or b"" for x in batch.column(2).cast(pa.binary())]
            found = [sketch(x) for x in data]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([simhash(x, WORDS) for x in data], pa.int64()),
                 pa.array([f[0] for f in found], pa.list_(pa.int32())), pa.array([f[1] for f in found], pa.list_(pa.int64())),
                 pa.array([f[2] for f in found], pa.int32())],
                ["digest", "id", "point", "low", "bands", "size"])

    kind = texts.schema["id"].dataType.simpleString()
    return texts.select("digest", "id", "text").mapInArrow(
        mark, f"digest string, id {kind}, point long, low array<int>, bands array<long>, size int")


def shingle_sets(texts: DataFrame, digests: DataFrame) -> DataFrame:
    """(digest, all): the whole shingle sets, hashes ascending as unsigned numbers, of the *texts* whose digest is among *digests*."""
    wanted = materialize(digests.distinct(), "wanted")
    few = wanted.limit(SENT_DIGESTS + 1).count() <= SENT_DIGESTS
    once = texts.select("digest", "text").join(F.broadcast(wanted) if few else wanted, "digest", "left_semi").groupBy(
        "digest").agg(F.first("text").alias("text"))

    def mark(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_hashes(x.as_py() or b"").view(np.int64) for x in batch.column(1).cast(pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.list_(pa.int64()))], ["digest", "all"])

    return materialize(once.mapInArrow(mark, "digest string, all array<long>"), "shingle-sets")


def shared_buckets(members: DataFrame) -> DataFrame:
    """(band, hash, digest, first, last, n) of the buckets with more than one member, from (band, hash, digest)."""
    ends = members.groupBy("band", "hash").agg(
        F.min("digest").alias("first"), F.max("digest").alias("last"), F.count("*").alias("n")).where("first < last")
    return members.join(ends, ["band", "hash"])


def star_candidates(shared: DataFrame) -> DataFrame:
    """(a, b): every member with the first and last of its bucket."""
    return shared.select(F.col("digest").alias("a"), F.explode(F.array("first", "last")).alias("b")).where(
        "a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def margin(similarity: float) -> float:
    """How far from *similarity* an estimate on ``SKETCH`` shingles must lie to decide."""
    return SURE * (similarity * (1 - similarity) / SKETCH) ** 0.5


def verified(pairs: DataFrame, nodes: DataFrame, similarity: float, texts: DataFrame | None = None) -> DataFrame:
    """The *pairs* that are similar enough; without *texts* (digest, text) those whose sketches say so."""
    left = nodes.select(F.col("digest").alias("a"), F.col("low").alias("low_a"))
    right = nodes.select(F.col("digest").alias("b"), F.col("low").alias("low_b"))
    both = pairs.join(left, "a").join(right, "b")
    least = F.slice(F.array_sort(F.array_union("low_a", "low_b")), 1, SKETCH)
    shared = F.size(F.array_intersect(F.array_intersect("low_a", "low_b"), least))
    if texts is None:
        return both.where(shared >= F.lit(similarity) * F.size(least)).select("a", "b")
    counted = both.select("a", "b", shared.alias("shared"), F.size(least).alias("least"))
    partial, off = F.col("least") == SKETCH, F.when(F.col("least") == SKETCH, margin(similarity)).otherwise(0.0)
    # 0.8 - 0.0 is 0.8: complete sketches meet the bound itself.
    likely = materialize(counted.where(F.col("shared") >= (similarity - off) * F.col("least")).select(
        "a", "b", (~partial | (F.col("shared") >= (similarity + off) * F.col("least"))).alias("sure")), "likely")
    sure, unsure = likely.where("sure").select("a", "b"), likely.where("NOT sure").select("a", "b")
    if unsure.isEmpty():
        return sure
    sets = shingle_sets(texts, unsure.select(F.explode(F.array("a", "b")).alias("digest")))
    whole = unsure.join(sets.select(F.col("digest").alias("a"), F.col("all").alias("all_a")), "a").join(
        sets.select(F.col("digest").alias("b"), F.col("all").alias("all_b")), "b").select(
        "a", "b", F.size(F.array_intersect("all_a", "all_b")).alias("shared"),
        (F.size("all_a") + F.size("all_b")).alias("sum"))
    return sure.unionAll(whole.where(F.col("shared") >= F.lit(similarity) * (F.col("sum") - F.col("shared"))).select("a", "b"))


def overlap(one: np.ndarray, others: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of *one* with each row of *others* (sketches filled up with PAD): shared hashes, and all, among the smallest of both."""
    at = np.searchsorted(one, others)
    hit = one[np.minimum(at, len(one) - 1)] == others
    rank = np.arange(others.shape[1]) + at - (np.cumsum(hit, axis=1) - hit)  # in the union of both
    least = np.minimum(SKETCH, len(one) + (others < PAD).sum(axis=1) - hit.sum(axis=1))
    return (hit & (rank < SKETCH)).sum(axis=1), least


def sets_alike(a: np.ndarray, b: np.ndarray, similarity: float) -> bool:
    """Whether two whole shingle sets, ascending as unsigned numbers, are similar enough."""
    a, b = a.view(np.uint64), b.view(np.uint64)
    if len(a) > len(b):
        a, b = b, a
    if len(a) < similarity * len(b):
        return False
    shared = int((b[np.minimum(np.searchsorted(b, a), len(b) - 1)] == a).sum())
    return shared >= similarity * (len(a) + len(b) - shared)


def alike(one: np.ndarray, others: np.ndarray, similarity: float,
          sets: tuple[np.ndarray, np.ndarray] | None = None) -> np.ndarray:
    """Which rows of *others* are similar enough to *one*; the rule of :func:`verified`, with whole *sets* of one and others."""
    shared, least = overlap(one, others)
    near = shared >= similarity * least
    if sets is not None:
        off = margin(similarity)
        unsure = (least == SKETCH) & (shared >= (similarity - off) * least) & (shared < (similarity + off) * least)
        for k in np.flatnonzero(unsure):
            near[k] = sets_alike(sets[0], sets[1][k], similarity)
    return near


def cell_links(cell: pd.DataFrame, similarity: float) -> list[tuple[str, str]]:
    """Links between the groups of a cell (digest, group, low), each group searched from all of its members.

    By the rule of :func:`verified`: with a column *all* the whole sets decide what the sketches leave open.
    """
    digests, sizes = cell["digest"].to_numpy(), cell["low"].map(len).to_numpy()
    group = pd.factorize(cell["group"])[0]
    rows = np.full((len(cell), sizes.max()), PAD, dtype=np.int64)
    for i, low in enumerate(cell["low"]):
        rows[i, :sizes[i]] = low
    left = np.argsort(-np.bincount(group)[group], kind="stable")  # large groups first leave little to compare with
    sets = cell["all"].to_numpy() if "all" in cell else None
    links = []
    while len(left):
        mine = group[left] == group[left[0]]
        queue, left = left[mine].tolist(), left[~mine]
        while queue and len(left):
            x = queue.pop()
            whole = None if sets is None else (sets[x], sets[left])
            near = left[alike(rows[x, :sizes[x]], rows[left], similarity, whole)]
            if len(near):
                links += [(digests[x], digests[y]) for y in near]
                joined = np.isin(group[left], group[near])
                queue += left[joined].tolist()
                left = left[~joined]
    return links


def crowd_links(shared: DataFrame, groups: DataFrame, nodes: DataFrame, similarity: float,
                cell_rows: int = CELL_ROWS, texts: DataFrame | None = None) -> DataFrame | None:
    """Links (a, b) between *groups* (node, root) inside the buckets that stars leave open; None if there are none.

    Buckets of two or three members are left out: their stars hold all pairs.  With *texts* (digest, text) and
    the *size* of the nodes, whole shingle sets decide what sketches leave open.
    """
    weight = F.lit(1) if texts is None else (1 + F.floor(F.col("size") / ROW_SHINGLES)).cast("int")
    crowds = materialize(shared.where("n > 3").select("band", "hash", "digest").join(
        groups.withColumnRenamed("node", "digest"), "digest", "left").select(
        "band", "hash", "digest", F.coalesce("root", "digest").alias("group")).join(
        nodes.select("digest", weight.alias("weight")), "digest"), "crowds")
    sizes = crowds.groupBy("band", "hash", "group").agg(F.sum("weight").alias("rows"))
    top = F.max(F.struct("rows", "group"))
    split = sizes.groupBy("band", "hash").agg(
        F.sum("rows").alias("rows"), F.count("*").alias("groups"), top.alias("top")).where("groups > 1")
    whole = F.col("rows") <= cell_rows
    minor = F.when(whole, 1).otherwise(F.ceil((F.col("rows") - F.col("top.rows")) / cell_rows)).cast("int")
    major = F.when(whole, 0).otherwise(F.ceil(F.col("top.rows") / cell_rows)).cast("int")
    split = materialize(split.select("band", "hash", minor.alias("minor"), major.alias("major"),
                                     F.col("top.group").alias("top")), "open-buckets")
    if split.isEmpty():
        return None
    # Blocks of smaller groups come before those of the largest; a cell (i, j) has i <= j and i among the former.
    dealt = crowds.join(split, ["band", "hash"])
    of_top = (F.col("major") > 0) & (F.col("group") == F.col("top"))
    drawn = F.xxhash64("digest")
    block = F.when(of_top, F.col("minor") + F.pmod(drawn, "major")).otherwise(F.pmod(drawn, "minor")).cast("int")
    met = F.sequence(F.lit(0), F.when(of_top, F.col("minor")).otherwise(F.col("minor") + F.col("major")) - 1)
    placed = dealt.withColumn("block", block).withColumn("other", F.explode(met)).select(
        "band", "hash", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "digest", "group")

    def link(cell: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame(cell_links(cell, similarity), columns=["a", "b"], dtype=object)

    rows = nodes.select("digest", "low")
    if texts is not None:
        rows = rows.join(shingle_sets(texts, dealt.select("digest")), "digest")
    return placed.join(rows, "digest").groupBy("band", "hash", "i", "j").applyInPandas(
        link, "a string, b string")


def near_groups(texts: DataFrame, similarity: float = SIMILARITY, radius: int = RADIUS) -> tuple[DataFrame, DataFrame]:
    """(digest, id) of every distinct text and (node, root) of the texts with near copies, from (digest, id, text)."""
    marked = materialize(sketches(texts), "sketches")
    nodes = materialize(marked.groupBy("digest").agg(
        F.min("id").alias("id"), F.first("point").alias("point"), F.first("low").alias("low"),
        F.first("bands").alias("bands"), F.first("size").alias("size")), "texts")
    worded = nodes.where(F.size("low") > 0)
    banded = worded.select(F.posexplode("bands").alias("band", "hash"), "digest")
    links = links_within(worded.select("point").distinct(), radius)
    rooted = components(links).withColumnRenamed("node", "point")
    ball = worded.select("digest", "point").join(rooted, "point", "left").select(
        F.lit(-1).alias("band"), F.coalesce("root", "point").alias("hash"), "digest")
    shared = materialize(shared_buckets(banded.unionAll(ball)), "shared-buckets")
    groups = components(verified(star_candidates(shared), worded, similarity, texts))
    more = crowd_links(shared, groups, worded, similarity, texts=texts)
    if more is not None:
        groups = components(groups.select(F.col("node").alias("a"), F.col("root").alias("b")).unionAll(more))
    return nodes.select("digest", "id"), groups


def drop_near_duplicates(docs: DataFrame, similarity: float = SIMILARITY, radius: int = RADIUS) -> DataFrame:
    """One row of every group of near copies, with all columns of *docs*."""
    digest, key = free_names(docs, ["digest", "key"])
    # Identical rows collapse before any shuffle of texts.
    rows = docs.withColumn(digest, F.md5(F.coalesce("text", F.lit("")).cast("binary")))
    nodes, groups = near_groups(rows.select(
        F.col(digest).alias("digest"), F.col("doc_id").alias("id"), F.col("text").alias("text")), similarity, radius)
    order = F.struct(F.col("id").isNull().alias("no_id"), "id", "digest")
    stay = nodes.join(groups.withColumnRenamed("node", "digest"), "digest", "left").groupBy(
        F.coalesce("root", "digest").alias("root")).agg(F.min(order).alias("best")).select("best.id", "best.digest")

    def row_key(doc_id, text_digest):
        return F.concat_ws("|", F.coalesce(doc_id.cast("string"), F.lit("")), text_digest)

    kept = materialize(stay.select(row_key(F.col("id"), F.col("digest")).alias(key)), "kept")
    keyed = rows.withColumn(key, row_key(F.col("doc_id"), F.col(digest)))
    return keyed.dropDuplicates([key]).join(kept, key, "left_semi").select(*docs.columns)
