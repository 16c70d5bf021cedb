"""A ledger of answers: what a callable said to a prompt is kept on shared storage and never asked for again.

The ledger lies in partitions <path>/batch=<n>. A run asks only prompts without a complete answer, each text once however many chunks
share it, and writes what it got as its own batch before anyone uses it. A run that is repeated with the same number replaces its batch.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from termloom.functions.lookup import maybe_in
from termloom.operators import extraction as E
from termloom.session import discard, stage, stage_at
from termloom.sources.tables import write_partitions

COURSE = ["student_id", "course_id"]
LEDGER = "prompt_key string, part string, artifact_ids array<string>, response string, error string, batch bigint"


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not there.getFileSystem(spark._jsc.hadoopConfiguration()).exists(there):
        return spark.createDataFrame([], LEDGER)
    return spark.read.schema(LEDGER).parquet(path)


def complete(ledger: DataFrame) -> DataFrame:
    """(prompt_key, batch): the first batch that answered every part of a prompt."""
    each = ledger.groupBy("prompt_key", "batch").agg(F.count("error").alias("failed")).where("failed = 0")
    return each.groupBy("prompt_key").agg(F.min("batch").alias("batch"))


def _chosen(keyed: DataFrame, rows: DataFrame, fresh: DataFrame) -> DataFrame:
    """The rows of `keyed` whose number (_row) is in `fresh`, a part of `rows`.

    Texts are shuffled only where the lookups cannot tell a row that is asked from one that is not: none at all if all are asked.
    """
    hashed = lambda df: df.select(F.xxhash64("_row").alias("id"))
    others = rows.select("_row").join(fresh.select("_row"), "_row", "left_anti")
    asked = maybe_in(keyed.withColumn("_id", F.xxhash64("_row")), "_id", hashed(fresh)).where("maybe").drop("maybe")
    marked = maybe_in(asked, "_id", hashed(others)).drop("_id")
    sure = marked.where("not maybe").drop("maybe")
    return sure.unionByName(marked.where("maybe").drop("maybe").join(fresh.select("_row"), "_row", "left_semi").select(*sure.columns))


def ask(
    prompts: DataFrame, answer: Callable[[str], str], template: str, path: str, *, batch: int, retry: Callable[[Exception], bool] = E.retryable
) -> DataFrame:
    """One row per answered part of each prompt: course keys, chunk, part, artifact_ids, response, error.

    prompts: the result of build_prompts. Prompts with a failed part keep their rows of this batch, with the error; the next run asks them again.
    """
    spark = prompts.sparkSession
    # the texts are written once, with a number for each chunk, and removed when all are answered
    keyed, folder = stage_at(prompts.withColumns({"prompt_key": F.sha2("prompt", 256), "_row": F.monotonically_increasing_id()}).drop("prompt"))
    rows = stage(keyed.select(*COURSE, "chunk", "prompt_key", "_row"))
    ledger = read_ledger(spark, path).where(F.col("batch") != batch)
    # one chunk stands for all that share its text
    first = rows.groupBy("prompt_key").agg(F.min("_row").alias("_row"))
    fresh = stage(first.join(complete(ledger).select("prompt_key"), "prompt_key", "left_anti").select("_row"))
    said = E.batch_extract(_chosen(keyed, rows, fresh), answer, template, retry=retry)
    asked = said.join(rows.join(fresh, "_row", "left_semi").select(*COURSE, "chunk", "prompt_key"), [*COURSE, "chunk"])
    write_partitions(asked.select("prompt_key", "part", "artifact_ids", "response", "error", F.lit(batch).cast("long").alias("batch")), path, "batch")
    discard(spark, folder)
    ledger = read_ledger(spark, path)
    done = complete(ledger)
    current = ledger.join(done, ["prompt_key", "batch"], "left_semi").unionByName(
        ledger.where(F.col("batch") == batch).join(done.select("prompt_key"), "prompt_key", "left_anti")
    )
    return rows.drop("_row").join(current.drop("batch"), "prompt_key").drop("prompt_key")
