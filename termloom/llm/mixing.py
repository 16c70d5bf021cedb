"""Mixing sources to target weights: water-filled targets, whole copies, and a subset-sum fit of what is left of each budget.

Documents are counted by (source, size). A source takes every document `copies` = floor(target / size of source) times. The rest
of its budget is fitted from the counts: an equal share of each size first, then a bounded knapsack (subset-sum bits, counts
split into powers of two) over one spare document or more of each size, so the words taken meet the target as nearly as sizes
allow. Where single documents leave a gap, the knapsack is solved again with repeats up to CAP. Which documents of a size are taken is decided by seeded hash order: hash buckets are taken whole, and only the
bucket at the border is ranked, so no group of equal sizes meets in one task.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from termloom.llm.common import stage

CAP = 3
WEIGHTS = 3
SEED = 17
# hash buckets of a (source, size) group
SLICES = 4096
# budget, in words, that the knapsack covers bit by bit; a wider rest first goes to the sizes whose equal share was cut the most
KNAPSACK = 1 << 18
SIZE = r"[^\x20\x09-\x0D]+"


def sizes(docs: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, source, size) of each row, with the columns `keep`; a null text has size 0."""
    return docs.select(*keep, "doc_id", F.col("source").cast("string").alias("source"), F.coalesce(F.regexp_count("text", F.lit(SIZE)), F.lit(0)).cast("long").alias("size"))


def targets(sized: DataFrame) -> DataFrame:
    """(source, source_size, target): weights 1, 2, 3, 1, ... by code point order, null last, targets at most CAP times the size.

    Sharing the excess again by weight until no target is above its cap ends at target = min(cap, level * weight). The level
    follows from the sources in order of cap / weight. One row per source takes part, never documents.
    """
    known = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").isNull(), "source")
    weighed = known.withColumn("weight", (F.row_number().over(order) - 1) % WEIGHTS + 1).withColumn("cap", CAP * F.col("source_size"))
    filling = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").isNull(), "source")
    every = Window.partitionBy()
    before = filling.rowsBetween(Window.unboundedPreceding, -1)
    filled = weighed.withColumns(
        {
            "all": F.sum("source_size").over(every),
            "capped": F.coalesce(F.sum("cap").over(before), F.lit(0)),
            "weights": F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0)),
        }
    ).withColumn("level", (F.col("all") - F.col("capped")) / F.col("weights"))
    # sources before the first whose cap reaches the level are capped; from there on the level holds
    first = F.min(F.when(F.col("cap") >= F.col("level") * F.col("weight"), F.struct(F.col("cap") / F.col("weight"), "level"))).over(every)
    target = F.least(F.col("cap").cast("double"), F.coalesce(first["level"], F.lit(0.0)) * F.col("weight"))
    return filled.select("source", "source_size", target.alias("target"))


def fit(size: np.ndarray, count: np.ndarray, budget: int, most: int = 1, knapsack: int = KNAPSACK) -> np.ndarray:
    """How many documents of each size to take so that the words come nearest below or at `budget`. Sizes are distinct and positive.

    A document is taken once; up to `most` times where that comes nearer.
    """
    order = np.argsort(-size, kind="stable")
    size, count = size[order].astype(np.int64), count[order].astype(np.int64)
    total = int((size * count).sum())
    if budget >= total:
        take = count.copy()
    else:
        take = np.array([int(c) * budget // total for c in count], dtype=np.int64)
        left = budget - int((take * size).sum())
        # a wide rest: one more of each size, the largest remainder of its share first, until a few documents' words are left
        short = np.array([int(c) * budget % total / total for c in count])
        few = knapsack if left <= knapsack else min(knapsack, 8 * int(size[0]))
        for i in np.argsort(-short, kind="stable").tolist():
            if left <= few:
                break
            if take[i] < count[i] and size[i] <= left:
                take[i] += 1
                left -= int(size[i])
        more = _knapsack(size, count - take, left)
        if most > 1 and int((more * size).sum()) < left:
            more = _knapsack(size, most * count - take, left)
        take += more
    back = np.empty_like(take)
    back[order] = take
    return back


def _knapsack(size: np.ndarray, spare: np.ndarray, budget: int) -> np.ndarray:
    """Bounded subset sum: the fullest sum up to `budget`; reachable sums are the bits of one integer per piece."""
    pieces = []
    for i, (s, n) in enumerate(zip(size.tolist(), spare.tolist())):
        n, k = min(n, budget // s), 1
        while n > 0:
            part = min(k, n)
            pieces.append((i, part, part * s))
            n -= part
            k *= 2
    mask = (1 << (budget + 1)) - 1
    reach, steps = 1, []
    for piece in pieces:
        new = (reach | reach << piece[2]) & mask
        if new != reach:
            steps.append((piece, new & ~reach))
            reach = new
        if reach >> budget & 1:
            break
    at, take = reach.bit_length() - 1, np.zeros(len(size), dtype=np.int64)
    for (i, part, width), fresh in reversed(steps):  # the step that first reached a sum used its piece
        if fresh >> at & 1:
            take[i] += part
            at -= width
    return take


def mix(docs: DataFrame, seed: int = SEED, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, copies (how often the mix takes it), with the columns `keep`.

    Null texts have size 0 and are never taken; null sources are a source of their own, the last; repeated rows are
    documents of their own. Without words all targets are 0. An empty table gives no rows.
    """
    sized = stage(sizes(docs, keep).withColumn("at", F.xxhash64(F.lit(seed), "doc_id", "size")))
    aims = targets(sized)
    counts = sized.where("size > 0").groupBy("source", "size").agg(F.count("*").alias("n"))
    same = F.expr("source <=> aim_source")
    aims = stage(aims)
    aim = aims.withColumnRenamed("source", "aim_source")
    budgets = counts.join(aim, same).select("source", "size", "n", "source_size", "target")

    def plan(pdf: pd.DataFrame) -> pd.DataFrame:
        whole, target = int(pdf["source_size"].iloc[0]), float(pdf["target"].iloc[0])
        copies = min(CAP, int(target // whole))
        left = 0 if copies == CAP else int(target - copies * whole)
        n = pdf["n"].to_numpy()
        take = fit(pdf["size"].to_numpy(), n, left, CAP - copies)
        # `every`: extra copies of all documents of a size; `take`: how many of them are taken once more
        return pd.DataFrame({"source": pdf["source"], "size": pdf["size"], "copies": copies, "every": take // n, "take": take % n})

    chosen = stage(budgets.groupBy("source").applyInPandas(plan, "source string, size long, copies long, every long, take long"))
    sliced = sized.withColumn("slice", F.pmod("at", F.lit(SLICES)))
    per_slice = sliced.where("size > 0").groupBy("source", "size", "slice").agg(F.count("*").alias("n"))
    some = chosen.where("every > 0 or take > 0").withColumnRenamed("source", "aim_source").withColumnRenamed("size", "aim_size").select("aim_source", "aim_size", "every", "take")
    running = Window.partitionBy("source", "size").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    slices = per_slice.withColumn("before", F.coalesce(F.sum("n").over(running), F.lit(0)))
    border = slices.join(some, F.expr("source <=> aim_source and size = aim_size")).where("every > 0 or before < take").select(
        F.col("source").alias("s_source"), F.col("size").alias("s_size"), F.col("slice").alias("s_slice"), "every",
        F.greatest(F.lit(0), F.least("n", F.col("take") - F.col("before"))).alias("room"), "n",
    )
    joined = sliced.join(border, F.expr("source <=> s_source and size = s_size and slice = s_slice"), "left")
    whole = joined.where("room is null or room = n or room = 0").withColumn("extra", F.expr("coalesce(every + if(room = n, 1, 0), 0)"))
    rank = F.row_number().over(Window.partitionBy("source", "size", "slice").orderBy("at", "doc_id"))
    part = joined.where("room > 0 and room < n").withColumn("extra", F.col("every") + (rank <= F.col("room")).cast("int"))
    taken = whole.unionByName(part).select(*keep, "doc_id", "source", "size", "extra")
    base = chosen.groupBy("source").agg(F.max("copies").alias("copies")).withColumnRenamed("source", "base_source")
    facts = aim.join(base, F.expr("aim_source <=> base_source"), "left").select("aim_source", "source_size", "target", F.coalesce("copies", F.lit(0)).alias("whole_copies"))
    out = taken.join(facts, same)
    return out.select(*keep, "doc_id", "source", "size", "source_size", "target", F.when(F.col("size") > 0, F.col("whole_copies") + F.col("extra")).otherwise(0).cast("long").alias("copies"))


def op5(docs: DataFrame) -> DataFrame:
    """`mix` as one row per document with the words taken; odd rows as stated there."""
    return mix(docs).select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def mixed(docs: DataFrame) -> DataFrame:
    """The documents that the mix takes, one row each: the columns of `docs` and `copies`, how often it is taken.

    A column `copies` of `docs` gives way to the new one; other names may be any. Rows are told apart by a number of their own, so repeated ones stay apart.
    """
    held = stage(docs.select(F.struct("*").alias("doc"), F.monotonically_increasing_id().alias("row")))
    planned = mix(held.select("row", "doc.doc_id", "doc.source", "doc.text"), keep=("row",)).where("copies > 0").select(F.col("row").alias("taken_row"), F.col("copies").alias("n"))
    columns = [F.col("doc").getField(c).alias(c) for c in docs.columns if c != "copies"]
    return held.join(planned, F.expr("row = taken_row")).select(*columns, F.col("n").alias("copies"))
