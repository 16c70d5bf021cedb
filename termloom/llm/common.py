"""Helpers the operators of this subpackage share: session, tables, Arrow passes, connected components."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from termloom.functions.lookup import maybe_in  # noqa: F401
from termloom.session import configure, stage

# rows of one Arrow batch: bounds what a Python worker holds even if each text is very long
BATCH_ROWS = 500
ARROW_TYPES = {
    "long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string(), "boolean": pa.bool_(), "binary": pa.binary(),
    "tinyint": pa.int8(), "array<long>": pa.list_(pa.int64()), "array<int>": pa.list_(pa.int32()), "array<string>": pa.list_(pa.string()),
    "array<float>": pa.list_(pa.float32()), "array<double>": pa.list_(pa.float64()),
}


def ready(spark: SparkSession) -> SparkSession:
    configure(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return spark


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ready(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def arrow_map(df: DataFrame, out: dict[str, str], work: Callable[[pa.RecordBatch], dict[str, list]]) -> DataFrame:
    """`work` turns each Arrow batch of `df` into lists of the columns `out` (name -> Spark type)."""
    types = [(name, ARROW_TYPES[kind]) for name, kind in out.items()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema(types)
        for batch in batches:
            got = work(batch)
            yield pa.RecordBatch.from_arrays([pa.array(got[name], type=kind) for name, kind in types], schema=schema)

    return df.mapInArrow(run, ", ".join(f"{name} {kind}" for name, kind in out.items()))


def sample_texts(df: DataFrame, column: str, size: int) -> DataFrame:
    """The `size` distinct texts of smallest hash. Only hashes are ranked, so no task gathers texts from all over the table."""
    hashed = df.select(F.col(column), F.xxhash64(column).alias("h"))
    least = hashed.select("h").distinct().orderBy("h").limit(size).agg(F.max("h").alias("h")).first()["h"]
    return hashed.where(F.lit(False) if least is None else F.col("h") <= least).dropDuplicates(["h"]).select(column)


def utf8(column: pa.Array) -> list:
    """The UTF-8 bytes of each string; None for null."""
    return column.cast(pa.binary()).to_pylist()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for each node of the undirected `edges` (a, b); root is one node of the connected component.

    Rounds of contraction: each node is merged into its smallest neighbour, edges are renamed and made distinct. Node ids
    must be hash-like (fingerprints, hashes), so each round merges a constant share of the nodes whatever the shape of the
    graph. Neighbours are only ever reduced by min, so a hub needs no task of its own. Each round is written to the
    shared folder, which cuts the lineage. Empty edges give an empty result.
    """
    edges = stage(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    labels = None
    while not edges.isEmpty():
        ends = edges.selectExpr("a as node", "b as other").unionByName(edges.selectExpr("b as node", "a as other"))
        up = stage(ends.groupBy("node").agg(F.min("other").alias("other")).select("node", F.least("node", "other").alias("up")))
        hop = up.select(F.col("node").alias("up"), F.col("up").alias("top"))
        up = stage(up.join(hop, "up", "left").select("node", F.coalesce("top", "up").alias("up")))
        of = lambda name: up.select(F.col("node").alias(name), F.col("up").alias(f"{name}_up"))  # noqa: B023, E731
        moved = edges.join(of("a"), "a").join(of("b"), "b").where("a_up <> b_up")
        edges = stage(moved.select(F.least("a_up", "b_up").alias("a"), F.greatest("a_up", "b_up").alias("b")).distinct())
        if labels is None:
            labels = up.select("node", F.col("up").alias("root"))
        else:
            labels = labels.join(of("root"), "root", "left").select("node", F.coalesce("root_up", "root").alias("root"))
    if labels is None:
        return edges.selectExpr("a as node", "b as root")
    return stage(labels)
