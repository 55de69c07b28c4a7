"""Mixing sources to target weights by Poisson replication.

A source's mean repetition rate is its target share of the output divided by its share of
the input (shares of text bytes plus a fixed cost per row, so no source is empty).  Every
document draws its number of copies from a Poisson distribution with that mean, by
inverting the distribution at a uniform number hashed from the seed, the id and the text:
the same document gets the same copies in any run, order or partitioning.  Documents are
exploded by their count and shuffled globally by a hash of document and copy.

Means over ``BLOCK`` are drawn as a sum of equal smaller draws, so that no power underflows.
Only the sources' sizes are aggregated (before the shuffle); they meet the documents by a
broadcast when they are few, else by a join that adaptive execution splits on hot sources.

A null source is a source of its own.  Null ids and texts hash as empty.  Repeated rows draw alike.
Sources without a given weight get none; an empty table gives an empty result.
Clashing column names are avoided.  Leaving documents out is the feature here: a source
above its target share is thinned.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from llm.common import bind, free_names
from rankloom.runtime import broadcast_if_small, materialize

TEMPERATURE = 0.5
SEED = 7
BLOCK = 16.0
ROW_BYTES = 8
BROADCAST_SOURCES = 100_000


def source_rates(docs: DataFrame, weights: DataFrame | None = None, temperature: float = TEMPERATURE) -> DataFrame:
    """source, rate: mean copies of a document.

    *weights* (source, weight) are relative target shares; by default a source weighs its
    size to the power *temperature*, which lifts small sources.  Rates are rounded at nine
    digits so that the order of summation cannot matter.
    """
    sizes = docs.groupBy("source").agg(
        F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + ROW_BYTES).cast("double").alias("size"))
    sizes = materialize(sizes, "source-sizes")
    if weights is None:
        weighed = sizes.withColumn("weight", F.pow("size", F.lit(temperature)))
    else:
        given = weights.select(F.col("source").alias("given"), F.col("weight").cast("double"))
        weighed = sizes.join(given, F.col("source").eqNullSafe(F.col("given")), "left").select(
            "source", "size", F.coalesce("weight", F.lit(0.0)).alias("weight"))
    totals = weighed.agg(F.sum("size").alias("all_size"), F.sum("weight").alias("all_weight")).first()
    share = F.col("weight") / F.lit(totals["all_weight"] or 1.0)
    return weighed.select("source", F.round(share * F.lit(totals["all_size"] or 0.0) / F.col("size"), 9).alias("rate"))


def uniform(*parts: Column) -> Column:
    """A number in [0, 1) from 52 bits of the parts' digest."""
    digest = F.md5(F.concat_ws("|", *parts).cast("binary"))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("long") / F.lit(float(16 ** 13))


def poisson_steps(mean: Column) -> Column:
    """P(X <= k) for k = 0, 1, ... up to where the rest is below double precision."""
    last = F.ceil(mean + 12 * F.sqrt(mean) + 24).cast("int")

    def step(acc: Column, k: Column) -> Column:
        p = acc["p"] * mean / k
        return F.struct(p.alias("p"), (acc["sum"] + p).alias("sum"),
                        F.concat(acc["steps"], F.array(acc["sum"] + p)).alias("steps"))

    first = F.exp(-mean)
    start = F.struct(first.alias("p"), first.alias("sum"), F.array(first).alias("steps"))
    return F.aggregate(F.sequence(F.lit(1), last), start, step, lambda acc: acc["steps"])


def document_key(doc_id: Column, text: Column) -> Column:
    return F.concat_ws("|", F.coalesce(doc_id.cast("string"), F.lit("")),
                       F.md5(F.coalesce(text, F.lit("")).cast("binary")))


def replicate(docs: DataFrame, weights: DataFrame | None = None, temperature: float = TEMPERATURE,
              seed: int = SEED, keep: list[str] | None = None, shuffle: bool = True) -> DataFrame:
    """*docs* with every document as often as drawn, in a global random order.

    Adds copy (from 0), rate and order_key under free names; *keep* lists the columns of
    *docs* to return (all by default).
    """
    copy, rate, order, key, given, steps, blocks = free_names(
        docs, ["copy", "rate", "order_key", "key", "given", "steps", "blocks"])
    n_blocks = F.greatest(F.ceil(F.col(rate) / BLOCK), F.lit(1)).cast("int")
    rates = source_rates(docs, weights, temperature).select(F.col("source").alias(given), F.col("rate").alias(rate))
    rates = rates.withColumn(blocks, n_blocks).withColumn(steps, poisson_steps(F.col(rate) / F.col(blocks)))
    keyed = docs.withColumn(key, document_key(F.col("doc_id"), F.col("text")))
    if keep is not None:
        keyed = keyed.select(*dict.fromkeys([*keep, "source"]), key)
    joined = keyed.join(broadcast_if_small(rates, BROADCAST_SOURCES), F.col("source").eqNullSafe(F.col(given)))

    def draw(block: Column) -> Column:
        u = uniform(F.lit(str(seed)), F.col(key), block.cast("string"))
        return bind(u, lambda v: F.size(F.filter(F.col(steps), lambda s: s <= v)))

    count = F.aggregate(F.sequence(F.lit(0), F.col(blocks) - 1), F.lit(0), lambda total, b: total + draw(b))
    many = joined.withColumn(copy, F.explode(F.when(count > 0, F.sequence(F.lit(0), count - 1))))
    out = many.withColumn(order, F.md5(F.concat_ws("|", F.lit(f"{seed}-order"), key, copy).cast("binary")))
    out = out.select(*(docs.columns if keep is None else keep), copy, rate, order)
    return out.repartitionByRange(order).sortWithinPartitions(order) if shuffle else out
