"""Snapshots and audit events as they arrive."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from datetime import UTC, datetime

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from termloom import schemas
from termloom.functions import text as X
from termloom.plans.refresh import sync_lms_frames
from termloom.session import configure, stage
from termloom.sources.snapshots import explode_lms_snapshot
from termloom.sources.tables import TableStore

ARRIVED = "student_id bigint, course_id string, fetched_at timestamp, body string"
# groups that share the courses of a stream; checkpoints depend on it
SLOTS = 1 << 12


def _newest(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Rows of the courses of a slot that are as new as anything seen of their course; the state holds the newest instant of each, in microseconds."""
    newest = dict(zip(*state.get)) if state.exists else {}
    held: dict[str, list] = {}
    for batch in batches:
        for course, at, body in zip(batch["course"].tolist(), batch["at"].tolist(), batch["body"].tolist()):
            seen = newest.get(course)
            if seen is None or at > seen:
                newest[course], held[course] = at, [body]
            elif at == seen:
                held.setdefault(course, []).append(body)
    if held:
        state.update((list(newest), list(newest.values())))
    out = [(course, newest[course], body) for course, bodies in held.items() for body in bodies]
    yield pd.DataFrame(out, columns=["course", "at", "body"]).astype({"at": "int64", "course": object, "body": object})


def newest_only(arriving: DataFrame) -> DataFrame:
    """Of a stream of captured courses (student_id, course_id, fetched_at, body) those that no newer one preceded.

    The state holds one instant per course, so documents that arrive late are dropped before anything is merged; of a batch only the newest
    of a course comes through, and one that is delivered again comes through again. Rows without an instant are dropped.

    Courses share SLOTS groups by hash, as each group costs a call of Python; a batch rewrites the instants of the slots it has rows of. Keys
    travel as JSON and instants as numbers, so neither nulls nor large ids change on the way.
    """
    known = arriving.where("fetched_at is not null").select(
        F.pmod(F.xxhash64("student_id", "course_id"), F.lit(SLOTS)).alias("slot"), F.to_json(F.struct("student_id", "course_id")).alias("course"),
        F.unix_micros("fetched_at").alias("at"), "body",
    )
    got = known.groupBy("slot").applyInPandasWithState(
        _newest, "course string, at bigint, body string", "courses array<string>, newest array<bigint>", "append", GroupStateTimeout.NoTimeout
    )
    key = F.from_json("course", "student_id bigint, course_id string")
    return got.select(key["student_id"].alias("student_id"), key["course_id"].alias("course_id"), F.timestamp_micros("at").alias("fetched_at"), "body")


def captured_courses(snapshots: DataFrame) -> DataFrame:
    """Documents as one row per course, the course itself as JSON."""
    each = snapshots.select("student_id", "fetched_at", F.explode("courses").alias("c"))
    return each.select("student_id", X.course_key(F.col("c.code"), F.col("c.semester")).alias("course_id"), "fetched_at", F.to_json("c").alias("body"))


def snapshots_of(courses: DataFrame) -> DataFrame:
    """Documents of one course each, from the rows of `captured_courses`."""
    spec = schemas.LMS_COURSE.replace("\n", " ")
    return courses.select("student_id", "fetched_at", F.lit(None).cast("string").alias("source_url"), F.array(F.from_json("body", spec)).alias("courses"))


def sync_arriving(
    arriving: DataFrame, root: str, checkpoint: str, *, tz: str, clock: Callable[[], datetime] = lambda: datetime.now(UTC)
) -> StreamingQuery:
    """Synchronise a stream of LMS documents into the tables below `root`; a micro-batch rewrites the buckets of its students only."""
    store = TableStore(configure(arriving.sparkSession), root)

    def one_batch(batch: DataFrame, _: int) -> None:
        # written once: every step that reads a batch would compute it anew, with its state
        held = stage(batch)
        if not held.isEmpty():
            sync_lms_frames(store, explode_lms_snapshot(snapshots_of(held)), tz=tz, now=clock())

    return (
        newest_only(captured_courses(arriving))
        .writeStream.foreachBatch(one_batch)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def stream_sync(
    spark: SparkSession, snapshot_dir: str, root: str, checkpoint: str, *, tz: str,
    clock: Callable[[], datetime] = lambda: datetime.now(UTC), files_per_batch: int = 1000,
) -> StreamingQuery:
    """Synchronise every arriving LMS snapshot once; an older snapshot never replaces a newer one.

    A batch that is repeated after a failure merges the same rows again, which changes nothing.
    """
    arriving = (
        configure(spark).readStream.schema(schemas.LMS_SNAPSHOT.replace("\n", " "))
        .option("multiLine", True)
        .option("maxFilesPerTrigger", files_per_batch)
        .json(snapshot_dir)
    )
    return sync_arriving(arriving, root, checkpoint, tz=tz, clock=clock)


def distinct_events(events: DataFrame, *, key: str = "event_id", time: str = "ts", delay: str = "1 hour") -> DataFrame:
    """Events without repeats of an id inside the watermark."""
    return events.withWatermark(time, delay).dropDuplicatesWithinWatermark([key])


def stream_log(
    events: DataFrame, path: str, checkpoint: str, *, key: str = "event_id", time: str = "ts", delay: str = "1 hour"
) -> StreamingQuery:
    """Append audit events to Parquet, repeats dropped."""
    return (
        distinct_events(events, key=key, time=time, delay=delay)
        .writeStream.format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )
