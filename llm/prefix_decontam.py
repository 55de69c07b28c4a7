"""Benchmark decontamination by a prefix-filtered set join over item-sized windows.

A window is ``window`` consecutive words of an item; a shorter item is one window.  Each
window is seen as the sequence of its shingles of ``shingle`` words (a window with fewer
words is one shingle).

1. Every shingle of the benchmark is looked up in every document.  The matches
   (text, place, shingle) are written once: they give the shingles' counts over all
   documents and serve all later steps.  Nothing else of the documents is shuffled.
2. *Prefix.*  Only whole windows count, so the necessary prefix of a window is one
   shingle: its rarest.  Only matches of prefix shingles yield candidates.
3. *Length and position bounds.*  The place of the match and the shingle's offset give the
   window's only possible start, which must leave the whole window inside the document.
4. *Exact check.*  The shingles that cover the window must all be matched at their places.
   Shingles are compared as text, so the check is exact.

Documents are handled by the digest of their text: copies share one set of matches.

Null and empty texts have no words.  An item without words has no window.  Items with a
null id count under the empty id; repeated items count once.  Repeated documents each get
a row.  Empty tables: no rows, or no hits.  Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from llm.common import ascii_lower, free_names
from rankloom.runtime import broadcast_if_small, materialize

BREAKS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
WINDOW = 10
SHINGLE = 5
#: Benchmark shingles, windows or items that may be sent to every executor: under 100 MB.
BROADCAST_ROWS = 500_000


def words_of(text: Column) -> Column:
    """Runs of 0-9, a-z and anything beyond ASCII, after lower-casing A-Z."""
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), BREAKS), "")


def _grams(words: Column, size: int) -> Column:
    """All runs of *size* words as structs."""
    n = F.greatest(F.size(words) - size + 1, F.lit(0))
    return F.arrays_zip(*(F.slice(words, k + 1, n).alias(f"w{k}") for k in range(size)))


def _joined(size: int, of: str = "gram") -> Column:
    return F.concat_ws(" ", *(F.col(f"{of}.w{k}") for k in range(size)))


def item_windows(benchmark: DataFrame, window: int, shingle: int) -> DataFrame:
    """item, window (text), length, size (words of its shingles), words."""
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"),
                             words_of(F.col("text")).alias("words")).where(F.size("words") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("words") - window + 1, F.lit(1)))
    cut = items.select("item", F.explode(F.transform(starts, lambda s: F.slice("words", s, window))).alias("words"))
    return cut.select("item", F.array_join("words", " ").alias("window"), F.size("words").alias("length"),
                      F.least(F.size("words"), F.lit(shingle)).alias("size"), "words").distinct()


def window_grams(windows: DataFrame) -> DataFrame:
    """Per distinct window and offset: window, length, size, offset, gram (text)."""
    distinct = windows.select("window", "length", "size", "words").distinct()
    places = F.sequence(F.lit(0), F.col("length") - F.col("size"))
    return distinct.select("window", "length", "size", F.explode(F.transform(places, lambda o: F.struct(
        o.alias("offset"), F.array_join(F.slice("words", o + 1, F.col("size")), " ").alias("gram")))).alias("x")
    ).select("window", "length", "size", "x.*")


def gram_matches(docs: DataFrame, grams: DataFrame, sizes: list[int]) -> DataFrame:
    """Where the benchmark's shingles occur: text digest, place, gram, n (words of the text)."""
    asked = broadcast_if_small(grams.select("size", "gram").distinct(), BROADCAST_ROWS)
    texts = docs.where(F.col("text").isNotNull()).select(
        F.md5(F.col("text").cast("binary")).alias("digest"), words_of(F.col("text")).alias("words"))
    found = None
    for size in sizes:
        each = texts.select("digest", F.size("words").alias("n"), F.posexplode(_grams(F.col("words"), size)).alias(
            "place", "gram")).select("digest", "n", "place", _joined(size).alias("gram"))
        hit = each.join(asked.where(F.col("size") == size).select("gram"), "gram")
        found = hit if found is None else found.unionByName(hit)
    return found.select("digest", "n", "place", "gram").distinct()


def found_windows(docs: DataFrame, windows: DataFrame) -> DataFrame:
    """Every occurrence of a window in a distinct text: digest, start, length, window."""
    grams = materialize(window_grams(windows), "benchmark-grams")
    sizes = sorted(r[0] for r in grams.select("size").distinct().collect())  # at most as many as words in a shingle
    if not sizes:
        return docs.sparkSession.createDataFrame([], "digest string, start int, length int, window string")
    matches = materialize(gram_matches(docs, grams, sizes), "gram-matches")
    counts = matches.groupBy("gram").agg(F.count("*").alias("count"))
    # A window with a shingle that no document has cannot occur.
    counted = grams.join(counts, "gram", "left")
    rarest = counted.groupBy("window", "length", "size").agg(
        F.min(F.struct(F.coalesce("count", F.lit(0)).alias("count"), "gram", "offset")).alias("rarest")).where(
        "rarest.count > 0").select("window", "length", "size", "rarest.gram", "rarest.offset")
    prefix = broadcast_if_small(rarest, BROADCAST_ROWS)
    candidates = matches.join(prefix, "gram").select(
        "digest", "n", (F.col("place") - F.col("offset")).alias("start"), "length", "size", "window").where(
        (F.col("start") >= 0) & (F.col("start") + F.col("length") <= F.col("n")))
    # Offsets 0, size, 2 size, ... and the last one cover the window.
    steps = F.array_distinct(F.concat(
        F.expr("sequence(0, length - size, size)"), F.array(F.col("length") - F.col("size"))))
    cover = grams.select("window", "offset", "gram")
    needed = candidates.select("digest", "start", "length", "window", F.size(steps).alias("needed"),
                               F.explode(steps).alias("offset"))
    checked = needed.join(broadcast_if_small(cover, BROADCAST_ROWS), ["window", "offset"]).withColumn(
        "place", F.col("start") + F.col("offset")).join(
        matches.select("digest", "place", "gram"), ["digest", "place", "gram"], "left_semi")
    return checked.groupBy("digest", "start", "length", "window", "needed").agg(F.count("*").alias("got")).where(
        "got = needed").select("digest", "start", "length", "window")


def covered_words(spans: Column) -> Column:
    """Words inside any of the (start, length) *spans*."""
    return F.aggregate(F.array_sort(spans), F.struct(F.lit(0).alias("sum"), F.lit(0).alias("end")), lambda acc, s: F.struct(
        (acc["sum"] + F.greatest(s["start"] + s["length"] - F.greatest(s["start"], acc["end"]), F.lit(0))).alias("sum"),
        F.greatest(acc["end"], s["start"] + s["length"]).alias("end")), lambda acc: acc["sum"])


def text_hits(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, shingle: int = SHINGLE) -> DataFrame:
    """Per distinct text with hits: digest, n_hit, items (sorted item ids)."""
    windows = materialize(item_windows(benchmark, window, shingle), "benchmark-windows")
    found = materialize(found_windows(docs, windows), "found-windows")
    spans = found.groupBy("digest").agg(F.collect_set(F.struct("start", "length")).alias("spans")).select(
        "digest", covered_words(F.col("spans")).cast("long").alias("n_hit"))
    owners = broadcast_if_small(windows.select("window", "item"), BROADCAST_ROWS)
    items = found.select("digest", "window").distinct().join(owners, "window").groupBy("digest").agg(
        F.array_sort(F.collect_set("item")).alias("items"))
    return spans.join(items, "digest")


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, shingle: int = SHINGLE) -> DataFrame:
    """Per row of *docs*: doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    hits = materialize(text_hits(docs, benchmark, window, shingle), "text-hits")
    rows = docs.select("doc_id", F.md5(F.col("text").cast("binary")).alias("digest"),
                       F.regexp_count(F.coalesce("text", F.lit("")), F.lit(WORD)).cast("long").alias("n_words"))
    items = F.coalesce("items", F.array().cast("array<string>"))
    return rows.join(hits, "digest", "left").select(
        "doc_id", "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"),
        F.size(items).cast("long").alias("n_items"),
        F.sha2(F.array_join(items, ",").cast("binary"), 256).alias("items_sha256"),
        (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, shingle: int = SHINGLE) -> DataFrame:
    """The rows of *docs* without any word of a benchmark window; all columns stay."""
    (digest,) = free_names(docs, ["digest"])
    hits = materialize(text_hits(docs, benchmark, window, shingle).select(F.col("digest").alias(digest)), "hit-texts")
    return docs.withColumn(digest, F.md5(F.coalesce("text", F.lit("")).cast("binary"))).join(
        broadcast_if_small(hits, BROADCAST_ROWS), digest, "left_anti").select(*docs.columns)
