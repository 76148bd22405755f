"""Exact ranks inside groups of any size.

A window partitioned by the group alone puts a whole group into one task.  Here
rows are range-partitioned by (group, order), so a large group spans many
partitions; each partition ranks its own part, and the counts of the earlier
parts of the group (one row per group and partition) are added.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.session import cut_lineage


def ranked(df: DataFrame, groups: list[str], order: list, rank: str = "_rank", size: str = "_size") -> DataFrame:
    """``df`` plus each row's number (from 1) in its group by ``order`` and the group's size.

    The dealt rows are checkpointed once, so that counts and ranks see the same
    partitions even if a task is run again."""
    keys = [F.col(g) for g in groups]
    dealt = cut_lineage(df.repartitionByRange(*keys, *order).withColumn("_part", F.spark_partition_id()))
    counts = dealt.groupBy(*groups, "_part").agg(F.count(F.lit(1)).alias("_n"))
    parts = Window.partitionBy(*groups).orderBy("_part")          # one row per partition of a group
    starts = counts.select(
        *[F.col(g).alias(f"_g{i}") for i, g in enumerate(groups)], F.col("_part").alias("_p"),
        (F.sum("_n").over(parts) - F.col("_n")).alias("_before"), F.sum("_n").over(Window.partitionBy(*groups)).alias(size))
    same = F.col("_part") == F.col("_p")
    for i, g in enumerate(groups):
        same = same & F.col(g).eqNullSafe(F.col(f"_g{i}"))
    own = Window.partitionBy(*groups, "_part").orderBy(*order)    # one partition's part of a group
    return (dealt.withColumn("_own", F.row_number().over(own)).join(starts, same)
            .withColumn(rank, F.col("_before") + F.col("_own"))
            .select(*df.columns, rank, size))


def ntile(rank, size, buckets: int):
    """SQL ``ntile``: the first size mod buckets tiles hold one row more."""
    each, more = F.floor(size / buckets), F.pmod(size, F.lit(buckets))
    wide = more * (each + 1)
    return F.when(rank <= wide, F.ceil(F.try_divide(rank, each + 1))).otherwise(
        more + F.ceil(F.try_divide(rank - wide, each))).cast("int")
