"""Toxic spans by a linear-chain conditional random field, and document scores from its marginals.

Documents are labelled, tokens are not, so token labels come first.  A feature of a token
is its word or a prefix of 4 to 6 letters.  In a bounded sample of training documents its different
contexts (word before, word after) are counted in toxic and in clean texts; contexts rather than
occurrences, so that copies of one text mark nothing.  A feature is *marked* when its smoothed log-odds, relative to all
contexts of either kind, lie above ``MIN_ODDS`` by ``ERRORS`` standard errors: no absolute bar, so a word is
judged alike in samples of every size.  A token with a marked feature is labelled toxic if its document is.

The chain has two states and is trained by gradient ascent on sentences of that sample.
Sequences are sentences, or runs of ``LONGEST`` words of longer ones.  Forward-backward gives every token's marginal;
a document's features are the expected number of toxic tokens and the highest
marginal, and a logistic curve fitted on the sampled documents turns them into a score.
Runs of tokens with a marginal above one half are the offending spans, as code point
offsets into the text.

Sample, features and sentences are bounded by the constants below; prediction covers whole
texts.  Null and empty texts score what a text without toxic tokens scores.  Labels that are
null are ignored, a document labelled twice is toxic if one label says so; without both
kinds of labels every score is 0.  Repeated rows are each scored; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from llm.common import held_out, small_batches
from rankloom.runtime import materialize

SAMPLE_TOXIC = 1_500
SAMPLE_CLEAN = 3_000
MIN_ODDS = 1.0
ERRORS = 2
MODEL_FEATURES = 20_000
SENTENCES = 12_000
PREFIXES = (4, 5, 6)
LONGEST = 64
STEPS = 60
RATE = 0.3
L2 = 1e-4
MEMO = 200_000
WORD = re.compile(r"[^\W\d_]+")
SENTENCE = re.compile(r"[.!?\n]+")


def token_features(word: Column) -> Column:
    return F.concat(F.array(F.concat(F.lit("w:"), word)), *(
        F.when(F.char_length(word) > k, F.array(F.concat(F.lit("p:"), F.left(word, F.lit(k))))).otherwise(
            F.array().cast("array<string>")) for k in PREFIXES))


def features_of(word: str) -> list[str]:
    return ["w:" + word, *("p:" + word[:k] for k in PREFIXES if len(word) > k)]


def labelled_sample(docs: DataFrame, labels: DataFrame, n_toxic: int, n_clean: int) -> DataFrame:
    """doc_id, text, toxic of a bounded number of labelled training documents, by smallest hash of the id."""
    known = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    ids = known.where(~held_out(F.col("doc_id"))).withColumn("toxic", (F.col("toxic") > 0).cast("int"))
    order = Window.partitionBy("toxic").orderBy(F.xxhash64("doc_id"), "doc_id")
    chosen = ids.withColumn("r", F.row_number().over(order)).where(
        F.col("r") <= F.when(F.col("toxic") == 1, n_toxic).otherwise(n_clean)).select(
        F.col("doc_id").alias("id"), "toxic")
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), F.col("doc_id") == F.col("id"))  # bounded by the sample
    return rows.groupBy("doc_id", "text").agg(F.max("toxic").alias("toxic"))


def feature_counts(sample: DataFrame, limit: int) -> list:
    """feature and marked of the marked features and those that toxic texts use in most contexts."""
    words = F.transform(F.regexp_extract_all(F.col("text"), F.lit(r"(\p{L}+)"), 1), F.lower)
    tokens = sample.select("toxic", words.alias("w")).select("toxic", "w", F.posexplode("w").alias("i", "word"))
    context = F.xxhash64(F.get("w", F.col("i") - 1), F.get("w", F.col("i") + 1))
    each = tokens.select("toxic", context.alias("c"), F.explode(token_features(F.col("word"))).alias("feature")).distinct()
    counts = materialize(each.groupBy("feature").agg(
        F.sum("toxic").alias("toxic"), F.sum(1 - F.col("toxic")).alias("clean")), "feature-contexts")
    all_toxic, all_clean = counts.where(F.col("feature").startswith("w:")).agg(
        F.coalesce(F.sum("toxic"), F.lit(0)), F.coalesce(F.sum("clean"), F.lit(0))).first()
    t, c = F.col("toxic") + 0.5, F.col("clean") + 0.5
    bound = F.log(t / c) + float(np.log((all_clean + 0.5) / (all_toxic + 0.5))) - ERRORS * F.sqrt(1 / t + 1 / c)
    return counts.where("toxic > 0").select("feature", "toxic", (bound >= MIN_ODDS).alias("marked")).orderBy(
        F.desc("marked"), F.desc("toxic"), "feature").limit(limit).collect()


def sentences_of(text: str) -> list[list[str]]:
    out = []
    for part in SENTENCE.split(text):
        words = [word.lower() for word in WORD.findall(part)]
        out.extend(words[s:s + LONGEST] for s in range(0, len(words), LONGEST))
    return out


def forward_backward(scores: np.ndarray, lengths: np.ndarray, chain: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Marginals of state 1 and of both states in a row, and log-odds forward.

    *scores* (sequences, time) are emission log-odds; sequences are sorted by falling length.
    *chain* holds the start log-odds and the four transition weights 00, 01, 10, 11.
    """
    start, w00, w01, w10, w11 = chain
    n, width = scores.shape
    active = [int(np.searchsorted(-lengths, -t, side="left")) for t in range(width)]  # sequences longer than t
    ahead, back = np.zeros_like(scores), np.zeros_like(scores)
    ahead[:, 0] = start + scores[:, 0]
    for t in range(1, width):
        k = active[t]
        a = ahead[:k, t - 1]
        ahead[:k, t] = scores[:k, t] + np.logaddexp(a + w11, w01) - np.logaddexp(a + w10, w00)
    for t in range(width - 2, -1, -1):
        k = active[t + 1]
        x = scores[:k, t + 1] + back[:k, t + 1]
        back[:k, t] = np.logaddexp(w11 + x, w10) - np.logaddexp(w01 + x, w00)
    marginal = 1 / (1 + np.exp(-np.clip(ahead + back, -60, 60)))
    return marginal, ahead, back


def pad(sequences: list, fill: float = 0.0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sequences as rows sorted by falling length, their lengths, and their order."""
    lengths = np.array([len(s) for s in sequences])
    order = np.argsort(-lengths, kind="stable")
    out = np.full((len(sequences), max(1, lengths.max(initial=1))), fill)
    for row, i in enumerate(order):
        out[row, :lengths[i]] = sequences[i]
    return out, lengths[order], order


def train_chain(sentences: list[tuple[list[list[int]], list[int]]], n_features: int) -> tuple[np.ndarray, np.ndarray]:
    """Feature weights (log-odds of toxic) and chain weights by gradient ascent (Adam)."""
    lengths = np.array([len(y) for _, y in sentences])
    order = np.argsort(-lengths, kind="stable")
    sentences, lengths = [sentences[i] for i in order], lengths[order]
    width = int(lengths.max())
    rows, columns, features, truth = [], [], [], np.zeros((len(sentences), width))
    for r, (xs, ys) in enumerate(sentences):
        truth[r, :len(ys)] = ys
        for t, fs in enumerate(xs):
            rows += [r] * len(fs)
            columns += [t] * len(fs)
            features += fs
    rows, columns, features = np.array(rows, dtype=int), np.array(columns, dtype=int), np.array(features, dtype=int)
    cells = rows * width + columns
    real = np.arange(width)[None, :] < lengths[:, None]
    both = real[:, 1:]
    weights, chain = np.zeros(n_features + 1), np.zeros(5)  # the last feature is the bias
    moments = [np.zeros(n_features + 6), np.zeros(n_features + 6)]
    pairs = {(a, b): ((truth[:, :-1] == a) & (truth[:, 1:] == b) & both).sum() for a in (0, 1) for b in (0, 1)}
    for step in range(1, STEPS + 1):
        scores = np.bincount(cells, weights[features], truth.size).reshape(truth.shape)
        scores = (scores + weights[-1]) * real
        marginal, ahead, back = forward_backward(scores, lengths, chain)
        # Pair marginals from forward odds at t, the transition, and emission and backward odds at t + 1.
        x = scores[:, 1:] + back[:, 1:]
        logs = [chain[1] + 0 * x, chain[2] + x, chain[3] + ahead[:, :-1], chain[4] + ahead[:, :-1] + x]
        top = np.maximum.reduce(logs)
        mass = [np.exp(v - top) * both for v in logs]
        total = np.where(both, sum(mass), 1)
        error = (truth - marginal) * real
        gradient = np.bincount(features, error.ravel()[cells], n_features + 6)
        gradient[n_features] = error.sum()
        gradient[n_features + 1] = error[:, 0].sum()
        for k, (a, b) in enumerate(((0, 0), (0, 1), (1, 0), (1, 1))):
            gradient[n_features + 2 + k] = pairs[a, b] - (mass[k] / total).sum()
        gradient = gradient / len(sentences) - L2 * np.r_[weights, chain]
        moments[0] = 0.9 * moments[0] + 0.1 * gradient
        moments[1] = 0.99 * moments[1] + 0.01 * gradient ** 2
        move = RATE * (moments[0] / (1 - 0.9 ** step)) / (np.sqrt(moments[1] / (1 - 0.99 ** step)) + 1e-8)
        weights, chain = weights + move[:n_features + 1], chain + move[n_features + 1:]
    return weights, chain


def fit_curve(features: np.ndarray, truth: np.ndarray) -> np.ndarray:
    """Ridge logistic regression by Newton's method."""
    x = np.c_[features, np.ones(len(features))]
    w = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        hessian = (x * (p * (1 - p))[:, None]).T @ x + 0.05 * np.eye(len(w))
        w += np.linalg.solve(hessian, x.T @ (truth - p) - 0.05 * w)
    return w


def word_score(word: str, model: dict) -> float:
    index, weights = model["index"], model["weights"]
    return float(weights[-1] + sum(weights[i] for f in features_of(word) if (i := index.get(f)) is not None))


def document_marginals(texts: list[str | None], model: dict, memo: dict[str, float]) -> list[np.ndarray]:
    """Per text the marginal of each of its words, in order."""
    owner, sequences = [], []
    for d, text in enumerate(texts):
        for words in sentences_of(text or ""):
            found = list(map(memo.get, words))
            if None in found:
                if len(memo) > MEMO:
                    memo.clear()
                for i, word in enumerate(words):
                    if found[i] is None:
                        found[i] = memo[word] = word_score(word, model)
            owner.append(d)
            sequences.append(found)
    per_text: list[list[np.ndarray]] = [[] for _ in texts]
    if sequences:
        scores, lengths, order = pad(sequences)
        marginal, _, _ = forward_backward(scores, lengths, model["chain"])
        rows: list = [None] * len(sequences)
        for row, i in enumerate(order):
            rows[i] = marginal[row, :lengths[row]]
        for d, row in zip(owner, rows, strict=True):
            per_text[d].append(row)
    return [np.concatenate(p) if p else np.zeros(0) for p in per_text]


def summary(marginals: np.ndarray) -> tuple[float, float]:
    return (float(np.log1p(marginals.sum())), float(marginals.max())) if len(marginals) else (0.0, 0.0)


def spans_of(text: str, marginals: np.ndarray) -> list[tuple[int, int]]:
    """Code point offsets of runs of neighbouring toxic words."""
    spans: list[tuple[int, int]] = []
    last = -2
    for i, m in enumerate(WORD.finditer(text)):
        if i < len(marginals) and marginals[i] > 0.5:
            if i == last + 1:
                spans[-1] = (spans[-1][0], m.end())
            else:
                spans.append((m.start(), m.end()))
            last = i
    return spans


def train(docs: DataFrame, labels: DataFrame) -> dict | None:
    """The model, or None without both kinds of labels."""
    sample = materialize(labelled_sample(docs, labels, SAMPLE_TOXIC, SAMPLE_CLEAN), "toxic-sample")
    sizes = dict(sample.groupBy("toxic").count().collect())
    if len(sizes) < 2:
        return None
    counts = feature_counts(sample, MODEL_FEATURES)
    marked = {r["feature"] for r in counts if r["marked"]}
    index = {r["feature"]: i for i, r in enumerate(counts)}
    small_batches(docs.sparkSession)

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """All sentences with their labels."""
        for batch in batches:
            words, ys = [], []
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for sentence in sentences_of(text or ""):
                    words.append(sentence)
                    ys.append([int(toxic and any(f in marked for f in features_of(w))) for w in sentence])
            yield pa.RecordBatch.from_arrays([pa.array(words, pa.list_(pa.string())), pa.array(ys, pa.list_(pa.int32()))],
                                             ["words", "y"])

    cuts = materialize(sample.select("text", "toxic").mapInArrow(cut, "words array<string>, y array<int>"), "sentences")
    hashed = F.xxhash64("words")
    hot = F.array_contains("y", 1)
    rows = [r for part in (cuts.where(hot), cuts.where(~hot))
            for r in part.distinct().orderBy(hashed, "words").limit(SENTENCES // 2).collect()]
    sentences = [([[index[f] for f in features_of(w) if f in index] for w in r["words"]], r["y"]) for r in rows if r["y"]]
    if not sentences:
        return None
    weights, chain = train_chain(sentences, len(index))
    model = {"index": index, "weights": weights, "chain": chain, "curve": np.zeros(3)}
    found = scored(sample, model, extra=["toxic"]).select("a", "b", "toxic").toPandas()  # bounded by the sample
    model["curve"] = fit_curve(found[["a", "b"]].to_numpy(), found["toxic"].to_numpy(dtype=float))
    return model


def scored(docs: DataFrame, model: dict, extra: list[str] = ()) -> DataFrame:
    """doc_id, *extra*, a and b (document features), spans of every row."""
    spark = docs.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(model)
    names = ["doc_id", *extra]

    def mark(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo: dict[str, float] = {}
        for batch in batches:
            texts = batch.column(len(names)).to_pylist()
            marginals = document_marginals(texts, shared.value, memo)
            features = [summary(m) for m in marginals]
            spans = [[{"start": s, "end": e} for s, e in spans_of(t, m)] if len(m) and m.max() > 0.5 else []
                     for t, m in zip(texts, marginals, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:len(names)], pa.array([f[0] for f in features], pa.float64()),
                 pa.array([f[1] for f in features], pa.float64()),
                 pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))],
                [*names, "a", "b", "spans"])

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in docs.select(*names).schema)
    return docs.select(*names, "text").mapInArrow(
        mark, f"{kinds}, a double, b double, spans array<struct<start:int,end:int>>")


def score_toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per row of *docs*: doc_id, held_out, score, predicted, spans (start, end)."""
    model = train(docs, labels)
    out = held_out(F.col("doc_id")).alias("held_out")
    if model is None:
        return docs.select("doc_id", out, F.lit(0.0).alias("score"), F.lit(0).alias("predicted"),
                           F.array().cast("array<struct<start:int,end:int>>").alias("spans"))
    wa, wb, w0 = (float(w) for w in model["curve"])
    score = 1 / (1 + F.exp(-(F.col("a") * wa + F.col("b") * wb + w0)))
    return scored(docs, model).select("doc_id", out, score.alias("score"), "spans").select(
        "doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "spans")
