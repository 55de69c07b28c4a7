"""Connected components of an edge table, by alternating large and small stars.

Every round rewrites the edges so that nodes hang from ever smaller neighbours; at the end
each node hangs from the smallest node of its component.  Rounds grow with the logarithm of
the component's size.  Each round is a written table, so lost executors cost no more than
the round.  A hub's edges meet its one label in a join that adaptive execution can split;
minima are aggregated before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankloom.runtime import materialize


def _signature(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("high", "low"))).first())


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of *edges* (a, b) but the roots; both columns of one sortable type.

    Self-links and repeated links change nothing; no edges give no rows; links with a null end are ignored.
    """
    current = materialize(edges.where("a <> b").select(
        F.greatest("a", "b").alias("high"), F.least("a", "b").alias("low")).distinct(), "edges")
    before = _signature(current)
    while before[0]:
        both = current.select(F.col("high").alias("u"), F.col("low").alias("v")).unionAll(
            current.select(F.col("low").alias("u"), F.col("high").alias("v")))
        smallest = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(smallest, "u").select(F.col("v").alias("high"), F.col("m").alias("low"))
        large = materialize(large.distinct(), "large-star")
        root = large.groupBy("high").agg(F.min("low").alias("m"))
        small = large.join(root, "high").where("low <> m").select(F.col("low").alias("high"), F.col("m").alias("low"))
        current = materialize(small.unionAll(root.select("high", F.col("m").alias("low"))).distinct(), "small-star")
        after = _signature(current)
        if after == before:
            break
        before = after
    return current.select(F.col("high").alias("node"), F.col("low").alias("root"))
