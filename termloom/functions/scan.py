"""Ordered scans that never need one whole group in one task.

A group is cut into blocks of consecutive positions. Per block a small summary is computed, the summaries (one
row per block) are scanned, and every block then starts from its own carried value. The result equals the plain
window over the whole group, for any block size.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from termloom.session import stage

BLOCK = 1 << 16
# a numbered row is (partition << LOCAL) + its position there
LOCAL = 33


def block_of(pos: str, size: int = BLOCK) -> Column:
    return F.floor(F.col(pos) / size).cast("long")


def _joined(df: DataFrame, carried: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.join(carried, [*keys, "_block"], "left")


def sum_before(
    df: DataFrame, keys: Sequence[str], pos: str, value: Column, out: str, size: int = BLOCK
) -> DataFrame:
    """Sum of `value` over all earlier rows of the group (0 for the first row)."""
    blocks = df.withColumn("_block", block_of(pos, size)).withColumn("_value", value)
    totals = blocks.groupBy(*keys, "_block").agg(F.sum("_value").alias("_total"))
    earlier = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.select(*keys, "_block", F.coalesce(F.sum("_total").over(earlier), F.lit(0)).alias("_base"))
    inside = Window.partitionBy(*keys, "_block").orderBy(pos).rowsBetween(Window.unboundedPreceding, -1)
    return (
        _joined(blocks, carried, keys)
        .withColumn(out, F.col("_base") + F.coalesce(F.sum("_value").over(inside), F.lit(0)))
        .drop("_block", "_value", "_base")
    )


def carry_forward(
    df: DataFrame, keys: Sequence[str], pos: str, value: Column, out: str, size: int = BLOCK
) -> DataFrame:
    """Last non-null `value` at or before each row of the group."""
    blocks = df.withColumn("_block", block_of(pos, size)).withColumn("_value", value)
    lasts = blocks.where(F.col("_value").isNotNull()).groupBy(*keys, "_block").agg(
        F.max_by("_value", pos).alias("_last")
    )
    # every block needs a row, also one without any value of its own
    every = blocks.select(*keys, "_block").distinct().join(lasts, [*keys, "_block"], "left")
    earlier = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    carried = every.select(*keys, "_block", F.last("_last", ignorenulls=True).over(earlier).alias("_base"))
    inside = Window.partitionBy(*keys, "_block").orderBy(pos).rowsBetween(Window.unboundedPreceding, 0)
    return (
        _joined(blocks, carried, keys)
        .withColumn(out, F.coalesce(F.last("_value", ignorenulls=True).over(inside), F.col("_base")))
        .drop("_block", "_value", "_base")
    )


def dealt_by_range(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """`df` sorted by (keys, order) over range partitions of about equal size, with `_at`, which grows in that order.

    A group is split wherever its range is, so its size does not matter. The result is written once: the numbers are those of the written rows.
    """
    placed = df.repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order)
    return stage(placed.withColumn("_at", F.monotonically_increasing_id()))


def ranked(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], out: str) -> DataFrame:
    """`df` with `out`, the number (from 1) of each row within its group in `order`; rows that tie come in any order.

    Rows are numbered within range partitions. Of each group and partition one row (first number, count) is summed up over the
    partitions before, so what a window gathers per group is at most one row per partition. Null keys are a group.
    """
    here = dealt_by_range(df, keys, order).withColumn("_part", F.shiftright("_at", LOCAL))
    pieces = here.groupBy(*keys, "_part").agg(F.min("_at").alias("_from"), F.count(F.lit(1)).alias("_size"))
    earlier = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = pieces.select(
        *[F.col(k).alias(f"_of_{k}") for k in keys], F.col("_part").alias("_of_part"), "_from",
        F.coalesce(F.sum("_size").over(earlier), F.lit(0)).alias("_before"),
    )
    same = F.col("_part") == F.col("_of_part")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_of_{k}"))
    return here.join(offsets, same).withColumn(out, F.col("_before") + F.col("_at") - F.col("_from") + 1).select(*df.columns, out)
