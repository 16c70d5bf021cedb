"""Tables on shared storage: current state in buckets of students, an append-only log, numbered results of steps."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from termloom import schemas
from termloom.session import stage

# tables that hold the current state, by buckets of their students
STATE = {
    "courses": schemas.COURSES, "assignments": schemas.ASSIGNMENTS, "agenda_entries": schemas.AGENDA, "fact_evidence": schemas.FACT_EVIDENCE,
    "fact_notes": schemas.FACT_NOTES, "fact_artifacts": schemas.FACT_ARTIFACTS,
}
TABLES = {**STATE, "log": schemas.LOG}
BUCKETS = 64


def schema_of(name: str) -> str:
    return TABLES[name].replace("\n", " ")


def empty_table(spark: SparkSession, name: str) -> DataFrame:
    return spark.createDataFrame([], schema_of(name))


def read_table(spark: SparkSession, name: str, path: str) -> DataFrame:
    """A table in its declared schema; Parquet prunes columns and skips row groups by itself."""
    return spark.read.schema(schema_of(name)).parquet(path)


def bucket_of(student: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(student), F.lit(buckets)).cast("int")


def write_partitions(df: DataFrame, path: str, by: str) -> None:
    """Replace the partitions that `df` has rows of, and no other; large ones come in several files."""
    writer = df.hint("rebalance", by).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    writer.partitionBy(by).parquet(path)


class TableStore:
    """Tables below one folder.

    * State (STATE) lies in partitions root/<table>/bucket=<k> by a hash of student_id. A merge reads the buckets its students fall into and replaces
      these by dynamic partition overwrite; the files of all others stay. The merged rows are staged first, and a merge that is repeated after a
      failure gives the same rows.
    * The log lies in partitions root/log/batch=<n>; a batch is appended, or replaces itself when it is repeated.
    * Results of steps are numbered generations root/<table>/v=<n>, read only once their marker file exists.
    """

    def __init__(self, spark: SparkSession, root: str, buckets: int = BUCKETS) -> None:
        self.spark, self.root, self.buckets = spark, root.rstrip("/"), buckets

    def _path(self, text: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(text)
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def exists(self, name: str) -> bool:
        path, fs = self._path(f"{self.root}/{name}")
        return bool(fs.exists(path))

    # state

    def touched(self, *batches: DataFrame) -> list[int]:
        """Buckets of the students of the batches: at most as many as there are buckets."""
        found: set[int] = set()
        for batch in batches:
            found |= {r[0] for r in batch.select(bucket_of(F.col("student_id"), self.buckets)).distinct().collect()}
        return sorted(found)

    def state(self, name: str, buckets: Iterable[int] | None = None) -> DataFrame:
        """A state table, or the part of it in `buckets`, which reads no other partition."""
        if not self.exists(name):
            return empty_table(self.spark, name)
        table = self.spark.read.schema(schema_of(name) + ", bucket int").parquet(f"{self.root}/{name}")
        return (table if buckets is None else table.where(F.col("bucket").isin(list(buckets)))).drop("bucket")

    def replace(self, name: str, rows: DataFrame, buckets: list[int]) -> None:
        """`rows` become the whole of `buckets`."""
        staged = stage(rows.select(*empty_table(self.spark, name).columns).withColumn("bucket", bucket_of(F.col("student_id"), self.buckets)))
        filled = {r[0] for r in staged.select("bucket").distinct().collect()}  # at most as many as there are buckets
        assert filled <= set(buckets)
        write_partitions(staged, f"{self.root}/{name}", "bucket")
        for k in set(buckets) - filled:  # an overwrite leaves partitions it has no rows of
            path, fs = self._path(f"{self.root}/{name}/bucket={k}")
            fs.delete(path, True)

    # log

    def append_log(self, events: DataFrame, batch: int) -> None:
        """The events of a batch behind the log, without reading it; a repeated batch replaces its own partition."""
        known = [c for c in empty_table(self.spark, "log").columns if c in events.columns]
        write_partitions(events.select(*known, F.lit(batch).cast("long").alias("batch")), f"{self.root}/log", "batch")

    def log(self) -> DataFrame:
        """All events with their batch, the partition column."""
        if not self.exists("log"):
            return empty_table(self.spark, "log").withColumn("batch", F.lit(0).cast("long"))
        return self.spark.read.schema(schema_of("log") + ", batch bigint").parquet(f"{self.root}/log")

    # any table

    def version(self, name: str) -> int | None:
        """Greatest complete generation of a step's result."""
        path, fs = self._path(f"{self.root}/{name}")
        if not fs.exists(path):
            return None
        done = [
            int(s.getPath().getName()[2:])
            for s in fs.listStatus(path)
            if s.getPath().getName().startswith("v=") and fs.exists(self._path(f"{s.getPath()}/_SUCCESS")[0])
        ]
        return max(done, default=None)

    def read(self, name: str, version: int | None = None) -> DataFrame:
        if name in STATE:
            return self.state(name)
        if name == "log":
            return self.log().drop("batch")
        found = self.version(name) if version is None else version
        if found is None:
            raise FileNotFoundError(f"{self.root}/{name} has no complete generation")
        return self.spark.read.parquet(f"{self.root}/{name}/v={found}")

    def write(self, name: str, df: DataFrame, version: int | None = None) -> int:
        """A step's result as generation `version`, else the next one."""
        number = (self.version(name) or 0) + 1 if version is None else version
        df.write.mode("overwrite").parquet(f"{self.root}/{name}/v={number}")
        return number
