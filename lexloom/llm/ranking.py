"""Ranks within groups of which one may hold most rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BLOCKS = 64


def ranked(df: DataFrame, group: list[str], order: str) -> DataFrame:
    """`df` with a column `rank`, 0, 1, ... within each group, without a group meeting in one task.

    Rows are ranked within blocks of their group; the blocks' sizes (BLOCKS rows a group) give
    each block its first rank. Ranks follow `order` within a block.
    """
    blocked = df.withColumn("__block", F.pmod(F.xxhash64(order), F.lit(BLOCKS)).cast("int"))
    sizes = blocked.groupBy(*group, "__block").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy(*group).orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    first = sizes.select(*group, "__block", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__first"))
    inner = F.row_number().over(Window.partitionBy(*group, "__block").orderBy(order)) - 1
    out = blocked.withColumn("__inner", inner).join(first, [*group, "__block"])
    return out.withColumn("rank", F.col("__first") + F.col("__inner")).drop("__block", "__inner", "__first")
