"""A bounded lookup that sorts out rows before a join."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# a lookup that says "surely not in the set" has 64 bits for each slot: a fixed 2^22 bits, so broadcasting it is bounded
SLOTS = 1 << 16


def maybe_in(df: DataFrame, column: str, ids: DataFrame) -> DataFrame:
    """`df` with `maybe`: false only if `column` is surely not among `ids` (id)."""
    slot = F.pmod(F.col("id"), F.lit(SLOTS))
    masks = ids.groupBy(slot.alias("slot")).agg(F.bit_or(F.expr("shiftleft(1L, cast(shiftrightunsigned(id, 16) & 63 as int))")).alias("mask"))
    known = f"coalesce(mask & shiftleft(1L, cast(shiftrightunsigned({column}, 16) & 63 as int)), 0L) <> 0L"
    return df.join(F.broadcast(masks), F.pmod(F.col(column), F.lit(SLOTS)) == F.col("slot"), "left").withColumn("maybe", F.expr(known)).drop("slot", "mask")
