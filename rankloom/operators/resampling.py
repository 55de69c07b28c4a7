"""Bootstrap confidence intervals and paired permutation tests.

Every draw comes from a counter hash: the md5 of the seed, a draw block and the value's key
gives four 32-bit words.  So a value's part in a draw depends on nothing else, sums add up
map-side, and one rule holds for groups of any size and any partitioning.

* Bootstrap: each word gives a value its weight in one resample, by inverting the Poisson
  distribution with mean 1; a resample's mean is the weighted mean.  A resample in which all
  weights are zero (one in e^n of n values) counts as the plain mean.
* Permutation test: each bit gives a difference its sign in one permutation.

A task digests each key once, whatever number of groups has a value of it, and adds up all draws of a group as one
array; only these arrays, at most one per task and group, are shuffled.  Missing values are left out; a null group is a group.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from hashlib import md5

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankloom.runtime import materialize

# --- fixed values ---------------------------------------------------------
BOOTSTRAP_RESAMPLES = 2000
CONFIDENCE = 0.95
PERMUTATIONS = 10_000
SEED = 42
# --- end of fixed values --------------------------------------------------

WORDS = 4  # in a digest
WORD_BITS = 32
#: A word has weight k or more from the k-th of these on.
POISSON_STEPS = [
    math.floor(2 ** WORD_BITS * math.exp(-1) * sum(1 / math.factorial(j) for j in range(k + 1))) for k in range(12)]
_ALL = "_all"
#: Keys whose draws a task remembers, and groups whose sums it holds before handing them on.
MEMO_KEYS = 1_024
HELD_GROUPS = 256


def _digests(label: str, key: str, blocks: int, seed: int) -> bytes:
    return b"".join(md5(f"{seed}|{label}|{block}|{key}".encode()).digest() for block in range(blocks))


def poisson_weights(key: str, draws: int, seed: int) -> np.ndarray:
    """Weights of a value in each resample."""
    words = np.frombuffer(_digests("bootstrap", key, -(-draws // WORDS), seed), dtype=">u4")[:draws]
    return np.searchsorted(np.array(POISSON_STEPS), words.astype(np.int64), side="right").astype(np.int8)


def sign_bits(key: str, draws: int, seed: int) -> np.ndarray:
    """Signs of a difference in each permutation; of a word the lowest bit comes first."""
    words = np.frombuffer(_digests("permutation", key, -(-draws // (WORDS * WORD_BITS)), seed), dtype=">u4").astype("<u4")
    return (2 * np.unpackbits(words.view(np.uint8), bitorder="little")[:draws].astype(np.int8) - 1)


def _values(df: DataFrame, by: Sequence[str], order: str, value: Column) -> tuple[DataFrame, list[str]]:
    """(by, key, value) rows without missing values.  Without groups everything belongs to one constant group."""
    keys = [F.col(c) for c in by] or [F.lit(0).alias(_ALL)]
    data = df.select(*keys, F.col(order).cast("string").alias("key"), value.cast("double").alias("value"))
    return data.where("value IS NOT NULL"), list(by) or [_ALL]


def _draw_sums(data: DataFrame, groups: list[str], parts, draws: int, seed: int) -> DataFrame:
    """groups, n, total, sums and weights: per group the number and sum of its values, and arrays over the draws.

    *parts* maps (key, draws, seed) to what a value counts in each draw.
    """
    kinds = ", ".join(f"`{g}` {data.schema[g].dataType.simpleString()}" for g in groups)
    width = len(groups)

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, list] = {}
        memo: dict[str, np.ndarray] = {}
        schema = None

        def out() -> pa.RecordBatch:
            columns = [pa.array([k[i] for k in held], schema.field(i).type) for i in range(width)]
            rows = list(held.values())
            columns += [pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.float64())]
            columns += [pa.array([r[i] for r in rows], pa.list_(pa.float64())) for i in (2, 3)]
            held.clear()
            return pa.RecordBatch.from_arrays(columns, [*groups, "n", "total", "sums", "weights"])

        for batch in batches:
            schema = batch.schema
            for *group, key, value in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                part = memo.get(key)
                if part is None:
                    if len(memo) >= MEMO_KEYS:
                        memo.clear()
                    part = memo[key] = parts(key or "", draws, seed)
                row = held.get(tuple(group))
                if row is None:
                    if len(held) >= HELD_GROUPS:
                        yield out()
                    row = held[tuple(group)] = [0, 0.0, np.zeros(draws), np.zeros(draws)]
                row[0] += 1
                row[1] += value
                row[2] += part * value
                row[3] += part
        if held:
            yield out()

    return data.mapInArrow(add_up, f"{kinds}, n long, total double, sums array<double>, weights array<double>")


def _drawn(found: DataFrame, groups: list[str]) -> DataFrame:
    """groups, n, mean, draws: an array of (sum, weight) over the draws, tasks added up."""
    placed = found.select(*groups, F.posexplode(F.arrays_zip("sums", "weights")).alias("draw", "x"))
    draws = placed.groupBy(*groups, "draw").agg(F.sum("x.sums").alias("sum"), F.sum("x.weights").alias("weight"))
    plain = found.groupBy(*groups).agg(F.sum("n").alias("n"), (F.sum("total") / F.sum("n")).alias("mean"))
    same = [F.col(f"a.`{g}`").eqNullSafe(F.col(f"b.`{g}`")) for g in groups]
    return draws.alias("a").join(plain.alias("b"), same).select(*(f"a.`{g}`" for g in groups), "sum", "weight", "n", "mean")


def bootstrap_ci(values: DataFrame, by: Sequence[str] = (), value: str = "value", order: str = "qid",
                 n_resamples: int = BOOTSTRAP_RESAMPLES, confidence: float = CONFIDENCE,
                 seed: int = SEED) -> DataFrame:
    """by, mean, ci_lo, ci_hi: percentile bootstrap of the mean in each group.

    *order* is a column that tells the values of a group apart.
    """
    data, groups = _values(values, by, order, F.col(value))
    drawn = _drawn(materialize(_draw_sums(data, groups, poisson_weights, n_resamples, seed), "resamples"), groups)
    sampled = F.coalesce(F.try_divide(F.col("sum"), F.col("weight")), "mean")
    tail = (1.0 - confidence) / 2.0
    joined = drawn.groupBy(*groups).agg(
        F.max("mean").alias("mean"), F.percentile(sampled, F.lit(tail)).alias("ci_lo"),
        F.percentile(sampled, F.lit(1.0 - tail)).alias("ci_hi")).select(*by, "mean", "ci_lo", "ci_hi")
    if by:
        return joined
    zero = F.lit(0.0)  # no values at all: one row of zeros
    return joined.agg(*[F.coalesce(F.max(c), zero).alias(c) for c in ("mean", "ci_lo", "ci_hi")])


def paired_permutation(pairs: DataFrame, by: Sequence[str] = (), a: str = "a", b: str = "b",
                       order: str = "qid", n_permutations: int = PERMUTATIONS, seed: int = SEED) -> DataFrame:
    """by, n, delta, p_value: two-sided sign-flip test of mean(a - b) per group.

    The p-value is never below 1 / n_permutations.  *order* tells the pairs of a group apart.
    """
    data, groups = _values(pairs, by, order, F.col(a).cast("double") - F.col(b).cast("double"))
    drawn = _drawn(materialize(_draw_sums(data, groups, sign_bits, n_permutations, seed), "permutations"), groups)
    # sums in another order differ in the last bits, which must not undo a tie
    slack = 1e-12
    extreme = (F.abs(F.col("sum") / F.col("n")) >= F.abs("mean") - slack).cast("double")
    return drawn.groupBy(*groups).agg(
        F.max("n").alias("n"), F.max("mean").alias("delta"),
        F.greatest(F.avg(extreme), F.lit(1.0 / n_permutations)).alias("p_value")).select(*by, "n", "delta", "p_value")


def require_pairs(a: DataFrame, b: DataFrame) -> None:
    """Both samples must be non-empty and of the same length."""
    n_a, n_b = a.count(), b.count()
    if n_a == 0 or n_b == 0:
        raise ValueError("A paired test needs non-empty samples.")
    if n_a != n_b:
        raise ValueError(f"A paired test needs samples of one length, got {n_a} and {n_b}.")
