"""Ranking metrics per question, at document level with binary relevance.

A run is reduced to documents first (a document counts at its best chunk).  Every
evaluated question gets a row: no results or no relevant documents score 0.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankloom.functions.scores import dcg_discount
from rankloom.runtime import materialize

DEFAULT_KS = (1, 3, 5, 10)
CUT_METRICS = ("hit_rate", "recall", "precision", "ndcg")


def metric_names(ks: Sequence[int] = DEFAULT_KS) -> list[str]:
    return [f"{metric}@{k}" for k in ks for metric in CUT_METRICS] + ["mrr", "map"]


def doc_ranking(run: DataFrame) -> DataFrame:
    """qid, doc_id, doc_rank: documents by first appearance."""
    order = Window.partitionBy("qid").orderBy("first_rank")
    return (
        run.groupBy("qid", "doc_id").agg(F.min("rank").alias("first_rank"))
        .select("qid", "doc_id", F.row_number().over(order).alias("doc_rank"))
    )


def relevant_counts(qrels: DataFrame) -> DataFrame:
    """qid, n_rel: distinct relevant documents."""
    return qrels.groupBy("qid").agg(F.countDistinct("doc_id").alias("n_rel"))


def judged_ranking(run: DataFrame, qrels: DataFrame) -> DataFrame:
    """Document ranking with a relevance flag and the hits seen so far."""
    relevant = qrels.select("qid", "doc_id").distinct().withColumn("rel", F.lit(True))
    so_far = (Window.partitionBy("qid").orderBy("doc_rank")
              .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return (
        doc_ranking(run).join(relevant, ["qid", "doc_id"], "left")
        .withColumn("rel", F.coalesce("rel", F.lit(False)))
        .withColumn("hits", F.sum(F.col("rel").cast("int")).over(so_far))
    )


def _ideal_dcg(n_rel: Column, k: int) -> Column:
    """DCG of min(k, n_rel) relevant documents at the top; k terms, known when planning."""
    terms = [F.when(n_rel >= i, dcg_discount(F.lit(i))).otherwise(F.lit(0.0)) for i in range(1, k + 1)]
    return sum(terms[1:], terms[0])


def _at_k(k: int) -> dict[str, Column]:
    """Aggregates over a judged ranking joined with n_rel, for one cut-off."""
    if k <= 0:
        return {f"{metric}@{k}": F.lit(0.0) for metric in CUT_METRICS}
    hit = F.col("rel") & (F.col("doc_rank") <= k)
    n_hits = F.sum(F.when(hit, 1).otherwise(0))
    n_rel = F.max("n_rel")
    dcg = F.sum(F.when(hit, dcg_discount(F.col("doc_rank"))).otherwise(F.lit(0.0)))
    return {
        f"hit_rate@{k}": F.when(n_hits > 0, F.lit(1.0)).otherwise(F.lit(0.0)),
        f"recall@{k}": F.try_divide(n_hits.cast("double"), n_rel),
        f"precision@{k}": n_hits / F.lit(float(k)),
        f"ndcg@{k}": F.try_divide(dcg, _ideal_dcg(n_rel, k)),
    }


def per_query_metrics(run: DataFrame, queries: DataFrame, qrels: DataFrame,
                      ks: Sequence[int] = DEFAULT_KS) -> DataFrame:
    """qid and one column per metric, for every row of *queries*."""
    judged = judged_ranking(run, qrels).join(relevant_counts(qrels), "qid", "inner")
    aggregates: dict[str, Column] = {}
    for k in ks:
        aggregates |= _at_k(k)
    first_hit = F.min(F.when(F.col("rel"), F.col("doc_rank")))
    aggregates["mrr"] = F.lit(1.0) / first_hit
    precision_at_hits = F.sum(F.when(F.col("rel"), F.col("hits") / F.col("doc_rank")))
    aggregates["map"] = F.try_divide(precision_at_hits, F.max("n_rel"))
    scored = judged.groupBy("qid").agg(*[column.alias(name) for name, column in aggregates.items()])
    return (
        queries.select("qid").distinct().join(scored, "qid", "left")
        .select("qid", *[F.coalesce(F.col(f"`{name}`"), F.lit(0.0)).alias(name) for name in aggregates])
    )


def long_metrics(per_query: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """qid, columns to *keep*, metric, value: the wide per-question table unpivoted."""
    names = [c for c in per_query.columns if c != "qid" and c not in keep]
    return per_query.unpivot(["qid", *keep], [f"`{n}`" for n in names], "metric", "value")


def exact_percentiles(values: DataFrame, column: str, probs: Sequence[float], by: Sequence[str]) -> DataFrame:
    """by, n and percentiles p0, p1, … with linear interpolation, for groups of any size.

    Distinct values are counted, range-partitioned and numbered by running counts, so no
    task holds a group: only the rows that carry a wanted position leave their partition.
    """
    counts = (values.select(*by, F.col(column).cast("double").alias("value")).filter("value IS NOT NULL")
              .groupBy(*by, "value").agg(F.count("*").alias("c")))
    spread = materialize(
        counts.repartitionByRange(*by, "value").withColumn("part", F.spark_partition_id()), "histogram")
    group = Window.partitionBy(*by)
    before = group.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (  # at most one row per group and range partition
        spread.groupBy(*by, "part").agg(F.sum("c").alias("rows"))
        .select(*by, "part", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("offset"),
                F.sum("rows").over(group).alias("n")))
    running = Window.partitionBy(*by, "part").orderBy("value")
    place = [F.col(f"o_{c}").eqNullSafe(F.col(c)) for c in (*by, "part")]  # a null group is a group
    placed = (
        spread.join(offsets.select(*[F.col(c).alias(f"o_{c}") for c in (*by, "part")], "offset", "n"),
                    reduce(and_, place))
        .withColumn("after", F.col("offset") + F.sum("c").over(running))
        .withColumn("first", F.col("after") - F.col("c")))

    def at(position: Column) -> Column:
        return (F.col("first") <= position) & (position < F.col("after"))

    positions = [(F.col("n") - 1) * F.lit(p) for p in probs]
    ends = [end(position) for position in positions for end in (F.floor, F.ceil)]
    wanted = placed.filter(reduce(or_, [at(end) for end in ends]))
    picked = wanted.groupBy(*by).agg(
        F.max("n").alias("n"), *[F.max(F.when(at(end), F.col("value"))).alias(f"e{i}") for i, end in enumerate(ends)])
    return picked.select(*by, "n", *[
        (F.col(f"e{2 * i}") + (F.col(f"e{2 * i + 1}") - F.col(f"e{2 * i}"))
         * (position - F.floor(position))).alias(f"p{i}")
        for i, position in enumerate(positions)])


def summarize(values: DataFrame, column: str, by: Sequence[str] = ()) -> DataFrame:
    """mean, std (population), p50 and p95 with linear interpolation; zeros for groups without a value.

    One way for every size: percentiles come from range-partitioned counts, never from a group in one buffer.
    """
    value = F.col(column).cast("double")
    keyed = values if by else values.withColumn("_all", F.lit(0))
    keys = list(by) or ["_all"]
    moments = keyed.groupBy(*keys).agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"))
    if not by:  # a table without rows still has a summary
        one = values.sparkSession.range(1).select(F.lit(0).alias("_all"))
        moments = one.join(moments, "_all", "left")
    percentiles = exact_percentiles(keyed, column, (0.5, 0.95), keys).select(
        *[F.col(k).alias(f"_{k}") for k in keys], F.col("p0").alias("p50"), F.col("p1").alias("p95"))
    same = reduce(and_, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys])
    rows = moments.join(percentiles, same, "left")
    # Only a group without any value has no percentiles, and its mean is null as well.
    return rows.select(*by, *[F.when(F.col("mean").isNull(), F.lit(0.0)).otherwise(F.col(name)).alias(name)
                              for name in ("mean", "std", "p50", "p95")])
