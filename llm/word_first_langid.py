"""Language identification, word first with backoff to character n-grams.

A known word scores by its log frequency per language.  An unknown word falls back to its
character n-grams (with word ends marked), longest first: the first length of which any
n-gram is known decides, by the mean log frequency of the known ones.  Word scores are
normalised over the languages and added up; the score is the share of the best language
after a softmax, tempered by ``TEMPERATURE`` words.

The model is fitted on a bounded sample: per language the ``SAMPLE_TEXTS`` distinct
training texts with the smallest hash, and of their counts the ``MODEL_WORDS`` most
frequent words and ``MODEL_GRAMS`` most frequent n-grams over all languages.  Everything
that grows with the input (sampling, prediction) runs in Spark; counts are taken in Spark
and only the bounded model reaches the driver.

A null text, or one without a letter, is ``und`` with score 0, as is every text when
nothing could be learned.  Letters of no known n-gram leave all languages alike: the first
by name, with an even score.  Rows with a null lang teach nothing.  Repeated rows are each
predicted; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from llm.common import held_out, small_batches
from rankloom.runtime import broadcast_if_small, materialize

SAMPLE_TEXTS = 500
MODEL_WORDS = 60_000
MODEL_GRAMS = 60_000
LONGEST = 5
SMOOTHING = 0.5
TEMPERATURE = 4.0
#: A text's language counts as known when its share is so many times that of the next language; without evidence all are alike.
MIN_RATIO = 1.1
MEMO = 100_000
LETTERS = r"\p{L}+"
WORD = re.compile(r"[^\W\d_]+")
UNDECIDED = "und"


def sample_texts(training: DataFrame, per_language: int = SAMPLE_TEXTS) -> DataFrame:
    """lang, text: of each language the distinct texts with the smallest hashes."""
    hashed = training.where("lang IS NOT NULL AND text IS NOT NULL").select(
        "lang", "text", F.xxhash64("text").alias("h"))
    order = Window.partitionBy("lang").orderBy("h")
    # One row per distinct text before ranking; the ranking keeps only that many a task.
    bound = hashed.groupBy("lang", "h").agg(F.count("*").alias("n")).withColumn("r", F.row_number().over(order)).where(
        F.col("r") <= per_language).groupBy("lang").agg(F.max("h").alias("bound"))
    chosen = hashed.join(broadcast_if_small(bound, 100_000), "lang").where("h <= bound")
    return chosen.groupBy("lang", "h").agg(F.first("text").alias("text")).select("lang", "text")


def fit(sample: DataFrame, n_words: int = MODEL_WORDS, n_grams: int = MODEL_GRAMS) -> dict:
    """The model: languages, and per word and n-gram a row of centred log frequencies."""
    words = sample.select("lang", F.explode(F.regexp_extract_all(F.lower("text"), F.lit(f"({LETTERS})"), 1)).alias("item"))
    slots = 2 * sample.sparkSession.sparkContext.defaultParallelism
    counts = materialize(words.groupBy("lang", "item").agg(F.count("*").alias("n")).repartition(slots), "word-counts")
    marked = F.concat(F.lit("<"), F.col("item"), F.lit(">"))
    starts = F.sequence(F.lit(1), F.char_length(marked))
    pieces = F.flatten(F.transform(F.sequence(F.lit(1), F.lit(LONGEST)), lambda k: F.transform(
        F.filter(starts, lambda s: s + k - 1 <= F.char_length(marked)), lambda s: F.substring(marked, s, k))))
    grams = materialize(counts.select("lang", "n", F.explode(pieces).alias("item")).groupBy("lang", "item").agg(
        F.sum("n").alias("n")), "gram-counts")

    def top(rows: DataFrame, limit: int) -> tuple[list, dict]:
        best = rows.groupBy("item").agg(F.sum("n").alias("all")).where("all > 1").orderBy(F.desc("all"), "item").limit(limit)
        return rows.join(broadcast_if_small(best.select("item"), limit), "item").collect()

    languages = sorted(r[0] for r in counts.select("lang").distinct().collect())
    place = {lang: i for i, lang in enumerate(languages)}

    def table(rows: list) -> tuple[dict[str, int], np.ndarray]:
        index: dict[str, int] = {}
        for r in rows:
            index.setdefault(r["item"], len(index))
        found = np.zeros((len(index), len(languages)))
        for r in rows:
            found[index[r["item"]], place[r["lang"]]] = r["n"]
        return index, found

    def centred(found: np.ndarray) -> np.ndarray:
        share = (found + SMOOTHING) / (found.sum(axis=0) + SMOOTHING * max(1, len(found)))
        return np.log(share / share.sum(axis=1, keepdims=True)).astype(np.float32)

    word_index, word_found = table(top(counts, n_words))
    gram_index, gram_found = table(top(grams, n_grams))
    gram_scores = np.zeros(gram_found.shape, dtype=np.float32)
    lengths = np.array([len(g) for g in gram_index], dtype=int)
    for k in range(1, LONGEST + 1):
        gram_scores[lengths == k] = centred(gram_found[lengths == k])
    return {"languages": languages, "words": word_index, "word_scores": centred(word_found),
            "grams": gram_index, "gram_scores": gram_scores}


def known_grams(word: str, grams: dict[str, int]) -> list[int]:
    """The known n-grams of a word, of the greatest length that has any."""
    marked = f"<{word}>"
    for k in range(min(LONGEST, len(marked)), 0, -1):
        known = [i for s in range(len(marked) - k + 1) if (i := grams.get(marked[s:s + k])) is not None]
        if known:
            return known
    return []


class Backoff:
    """Scores of unknown words, remembered up to ``MEMO`` words; a batch's new words are scored together."""

    def __init__(self, model: dict) -> None:
        self.model = model
        self.clear()

    def clear(self) -> None:
        self.rows: dict[str, int] = {}
        self.scores = np.zeros((0, len(self.model["languages"])))

    def learn(self, counts: list[Counter[str]]) -> None:
        """Score all unknown words of *counts*."""
        known = self.model["words"].keys()
        unknown = set().union(*counts) - known
        if len(self.rows) + len(unknown) > MEMO:
            self.clear()
        fresh = [word for word in unknown if word not in self.rows]
        grams = [known_grams(word, self.model["grams"]) for word in fresh]
        sizes = np.array([len(g) for g in grams], dtype=np.int64)
        found = np.zeros((len(fresh), self.scores.shape[1]))
        at = np.flatnonzero(sizes)  # words of no known n-gram score nothing
        if len(at):
            flat = self.model["gram_scores"][np.fromiter((i for g in grams for i in g), dtype=np.int64)].astype(np.float64)
            found[at] = np.add.reduceat(flat, (np.cumsum(sizes) - sizes)[at]) / sizes[at, None]
        self.rows.update(zip(fresh, range(len(self.rows), len(self.rows) + len(fresh)), strict=True))
        self.scores = np.concatenate([self.scores, found])


def word_counts(text: str | None) -> Counter[str]:
    """Runs of letters, lower-cased.  Number signs such as a half or a circled one are no letters."""
    counts = Counter(WORD.findall((text or "").lower()))
    if not all(map(str.isalpha, counts)):
        for word in [w for w in counts if not w.isalpha()]:
            n = counts.pop(word)
            for part in "".join(c if c.isalpha() else " " for c in word).split():
                counts[part] += n
    return counts


def batch_shares(texts: list[str | None], model: dict, backoff: Backoff) -> list[np.ndarray | None]:
    """The languages' shares of each text; None without a letter or a language."""
    counts = [word_counts(text) for text in texts]
    if not model["languages"]:
        return [None] * len(texts)
    backoff.learn(counts)
    place, rows, out = model["words"].get, backoff.rows, []
    for count in counts:
        if not count:
            out.append(None)
            continue
        at = [place(word, -1) for word in count]
        n = np.fromiter(count.values(), dtype=np.float64, count=len(at))
        known = np.array(at)
        unknown = known < 0
        total = n[~unknown] @ model["word_scores"][known[~unknown]]
        if unknown.any():
            total = total + n[unknown] @ backoff.scores[[rows[word] for word, i in zip(count, at, strict=True) if i < 0]]
        share = np.exp((total - total.max()) / TEMPERATURE)
        out.append(share / share.sum())
    return out


def named(share: np.ndarray | None, model: dict) -> tuple[str, float]:
    """The best language and its share."""
    if share is None:
        return UNDECIDED, 0.0
    best = int(share.argmax())
    return model["languages"][best], float(share[best])


def is_identified(share: np.ndarray | None, min_ratio: float = MIN_RATIO) -> bool:
    """Whether one language stands out against the next; of a single language, whether there is any letter."""
    if share is None:
        return False
    return len(share) < 2 or bool(np.max(share) >= min_ratio * np.partition(share, -2)[-2])


def identify(docs: DataFrame, model: dict) -> DataFrame:
    """doc_id, lang_pred and score of every row of *docs* (doc_id, text)."""
    spark = docs.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(model)

    def mark(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        backoff = Backoff(shared.value)
        for batch in batches:
            found = [named(share, shared.value) for share in batch_shares(batch.column(1).to_pylist(), shared.value, backoff)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())],
                ["doc_id", "lang_pred", "score"])

    kind = docs.select("doc_id").schema[0].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(mark, f"doc_id {kind}, lang_pred string, score double")


def keep_identified(docs: DataFrame, model: dict, min_ratio: float = MIN_RATIO) -> DataFrame:
    """The rows of *docs* with a language that stands out against the next; all columns stay."""
    spark = docs.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def keep(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        backoff = Backoff(shared.value)
        for batch in batches:
            found = batch_shares(batch.column(at).to_pylist(), shared.value, backoff)
            yield batch.filter(pa.array([is_identified(share, min_ratio) for share in found], pa.bool_()))

    return docs.mapInArrow(keep, docs.schema)


def train(docs: DataFrame) -> dict:
    """A model from the documents outside the held-out fold."""
    rows = docs.where(~held_out(F.col("doc_id"))).select("lang", "text")
    spread = 2 * docs.sparkSession.sparkContext.defaultParallelism
    return fit(materialize(sample_texts(rows).repartition(spread), "language-sample"))


def identify_languages(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score: learned from one part of *docs*, predicted for all."""
    return identify(docs, train(docs)).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
