"""Crowded buckets cut into cells of bounded size, so that members of different groups meet without one task holding a bucket."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankloom.runtime import materialize

#: Weight of the rows of one block; a cell holds two blocks at most.
CELL_ROWS = 2_048


def open_cells(members: DataFrame, cell_rows: int = CELL_ROWS) -> DataFrame:
    """(bucket, i, j, node, group): every two members of different groups of a bucket share a cell (bucket, i, j).

    From (bucket, node, group, weight).  A bucket of one group has no cell.  The rows of a bucket's largest
    group are dealt to blocks of their own, which meet the blocks of all others but not each other.
    """
    sizes = members.groupBy("bucket", "group").agg(F.sum("weight").alias("rows"))
    open_ = sizes.groupBy("bucket").agg(
        F.sum("rows").alias("rows"), F.count("*").alias("groups"), F.max(F.struct("rows", "group")).alias("top")).where(
        "groups > 1")
    one = F.col("rows") <= cell_rows
    plan = materialize(open_.select(
        "bucket", F.when(~one, F.col("top.group")).alias("top"),
        F.when(one, 1).otherwise(F.ceil((F.col("rows") - F.col("top.rows")) / cell_rows)).cast("int").alias("others"),
        F.when(one, 0).otherwise(F.ceil(F.col("top.rows") / cell_rows)).cast("int").alias("tops")), "open-buckets")
    drawn, of_top = F.xxhash64("node", "bucket"), F.coalesce(F.col("group") == F.col("top"), F.lit(False))
    dealt = members.join(plan, "bucket").withColumn(
        "block", F.when(of_top, F.col("others") + F.pmod(drawn, "tops")).otherwise(F.pmod(drawn, "others")).cast("int"))
    last = F.when(of_top, F.col("others")).otherwise(F.col("others") + F.col("tops")) - 1
    return dealt.withColumn("met", F.explode(F.sequence(F.lit(0), last))).select(
        "bucket", F.least("block", "met").alias("i"), F.greatest("block", "met").alias("j"), "node", "group")
