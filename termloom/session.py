"""Session settings, and stages on shared storage that survive the loss of executors."""

from __future__ import annotations

import uuid

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession

import termloom

CHECKPOINT_DIR = "spark.checkpoint.dir"
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def configure(spark: SparkSession) -> SparkSession:
    """Settings the operators rely on: UTC clock, adaptive plans, skewed joins split at run time."""
    # functions for Python workers travel by value, so executors need no copy of the package
    cloudpickle.register_pickle_by_value(termloom)
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    spark.conf.set("spark.sql.adaptive.skewJoin.enabled", "true")
    # wide expression stages: generated methods beyond the JIT's size limit run slower than split ones
    spark.conf.set("spark.sql.codegen.hugeMethodLimit", "8000")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder the cluster names in spark.checkpoint.dir; where none is set, a folder in the warehouse, which is shared too."""
    named = spark.sparkContext.getConf().get(CHECKPOINT_DIR) or spark.conf.get(CHECKPOINT_DIR, None)
    return named or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_stages"


def stage(df: DataFrame) -> DataFrame:
    """Write a result that several later steps read, once, to the shared checkpoint folder, and read it back.

    Later steps start from the files, so a lost executor repeats a read and not the work before it, and one side of a
    self-join is not computed twice.
    """
    return stage_at(df)[0]


def stage_at(df: DataFrame) -> tuple[DataFrame, str]:
    """A staged result and the folder it lies in, for those who remove it when nothing reads it any more."""
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark)}/stage-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")  # what was shuffled for the files is of no use once they are written; else it stays until the driver collects its garbage
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path), path


def discard(spark: SparkSession, path: str) -> None:
    """Removes a folder of `stage_at`."""
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    there.getFileSystem(spark._jsc.hadoopConfiguration()).delete(there, True)
