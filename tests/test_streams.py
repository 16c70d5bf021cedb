"""Late snapshots of streamed courses are dropped, whatever shares a slot with them."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from termloom.streaming import jobs

BIG = (1 << 53) + 1
DAY = "2026-03-%02d 12:00:00.000001"
BATCHES = [
    [(1, "a", 5, "x"), (1, "a", 4, "old"), (1, "a", 5, "y"), (BIG, "a", 5, "big"), (None, "a", 5, "no student"), (1, None, 5, None), (2, 'q"', 5, "q"), (3, "a", None, "no instant")],
    [(1, "a", 4, "late"), (BIG, "a", 5, "again"), (BIG + 1, "a", 1, "other"), (None, "a", 6, "newer"), (1, None, 4, "late"), (2, 'q"', 7, "q")],
]
WANT = [
    [(1, "a", 5, "x"), (1, "a", 5, "y"), (BIG, "a", 5, "big"), (None, "a", 5, "no student"), (1, None, 5, None), (2, 'q"', 5, "q")],
    [(BIG, "a", 5, "again"), (BIG + 1, "a", 1, "other"), (None, "a", 6, "newer"), (2, 'q"', 7, "q")],
]


@pytest.mark.parametrize("slots", [1, jobs.SLOTS])
def test_newest_of_courses_that_share_slots(spark, tmp_path, monkeypatch, slots):
    monkeypatch.setattr(jobs, "SLOTS", slots)
    got = []
    for k, rows in enumerate(BATCHES):
        made = spark.createDataFrame([(s, c, d and DAY % d, b) for s, c, d, b in rows], "student_id bigint, course_id string, at string, body string")
        made.select("student_id", "course_id", F.col("at").cast("timestamp").alias("fetched_at"), "body").write.parquet(str(tmp_path / "in" / str(k)))
        arriving = spark.readStream.schema(jobs.ARRIVED).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
        kept = []
        query = jobs.newest_only(arriving).writeStream.foreachBatch(lambda df, _: kept.extend(df.withColumn("fetched_at", F.col("fetched_at").cast("string")).collect()))
        query.option("checkpointLocation", str(tmp_path / "mark")).trigger(availableNow=True).start().awaitTermination()
        got.append(sorted(map(repr, map(tuple, kept))))
    assert got == [sorted(repr((s, c, DAY % d, b)) for s, c, d, b in rows) for rows in WANT]


def test_a_slot_is_one_call(spark):
    plan = jobs.newest_only(spark.readStream.format("rate").load().selectExpr("value as student_id", "'c' as course_id", "timestamp as fetched_at", "'b' as body"))
    assert "slot" in plan._jdf.queryExecution().analyzed().toString()
