"""Steps that many queries share: what they write, read and compute once."""

from __future__ import annotations

import random
import time
from datetime import date
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from queries import chain, planning, readers
from termloom import schemas, session
from termloom.operators import reconcile
from tests.conftest import at


def test_documents_are_written_in_files_of_bounded_size(spark):
    docs = spark.range(1, 1001).selectExpr("named_struct('student_id', if(id % 50 = 0, null, id), 'courses', array()) as doc").coalesce(1)
    folder = readers._write(docs)
    files = [p for p in Path(folder.removeprefix("file:")).rglob("*.txt")]
    assert len(files) == 1000 // readers.PER_FILE
    got = spark.read.schema("student_id bigint").option("multiLine", True).json(folder).collect()
    assert sorted(r[0] or 0 for r in got) == sorted(0 if i % 50 == 0 else i for i in range(1, 1001))


def test_large_groups_merge_as_small_ones(spark, assignments):
    rng = random.Random(2)
    rows = [
        {"student_id": rng.choice([1, 2, None]), "title": rng.choice(["Lab 1", "Lab 1 - Due", "lab 1", "Quiz 2", "Course total"]), "id": f"i{n}",
         "source_platform": rng.choice(["d2l", "pearson_mylab", None]), "grade_pct": rng.choice([None, 0.0, 80.0]), "points_possible": rng.choice([None, 10.0]),
         "description": rng.choice([None, "", "d"]), "status": rng.choice(["graded", "upcoming", "available"]), "estimated_minutes": rng.choice([None, 0, 30])}
        for n in range(200)
    ]
    df = assignments(*rows)
    for name, type_ in (("raw", "map<string,string>"), ("late_policy", schemas.LATE_POLICY)):
        if name not in df.columns:
            df = df.withColumn(name, F.lit(None).cast(type_))
    read = lambda most: sorted(map(repr, reconcile.canonical_assignments(df, now=at("2026-03-24T12:00:00"), most=most).collect()))
    small = read(1 << 20)
    assert small == read(0) == read(20)


@pytest.mark.parametrize("name", ["agenda_full", "agenda_items", "agenda_days", "agenda_report", "today_focus"])
def test_the_scored_rows_of_a_plan_are_computed_once(spark, monkeypatch, name):
    rows = spark.createDataFrame(
        [(1, "c", f"k{n}", f"i{n}", f"T{n}", "homework", "upcoming", date(1998, 6, 10 + n % 9), 20 * n, float(n)) for n in range(1, 12)],
        "student_id bigint, course_id string, match_key string, id string, title string, type string, status string, due_day date, estimated_minutes int, priority_score double",
    ).withColumns({
        "due_at": F.col("due_day").cast("timestamp"), "due_date": F.col("due_day").cast("timestamp"), "external_url": F.lit("u"), "raw_due_at": F.lit(None).cast("string"),
        "course": F.struct(F.lit("C").alias("code"), F.lit(70.0).alias("current_grade_pct")), "priority_reasons": F.array(F.lit("r")),
    })
    calls = []
    monkeypatch.setattr(chain, "relevant_scored", lambda *_: calls.append(1) or rows)
    monkeypatch.setattr(planning.P, "priority_reasons", lambda df: df)
    assert getattr(planning, name)(spark, "").count() > 0
    assert len(calls) == 1


def test_documents_are_one_file_each_in_few_folders(spark):
    long = "line\n" * 5000
    docs = spark.createDataFrame([("7", "a ü"), ("8", None), ("9", ""), ("-3", long), ("7", "b"), (None, "no name")], "name string, text string")
    folder = f"{readers.checkpoint_dir(spark)}/few-{random.random()}"
    paths = {r["path"] for r in readers._one_file_each(docs, folder).collect()}
    files = {p for p in Path(folder.removeprefix("file:")).rglob("*") if p.is_file() and not p.name.startswith((".", "_"))}
    assert paths == set(map(str, files)) and len(files) == 5
    assert len({p.parent for p in files}) <= 8 and not any(p.parent.name.startswith("name=") for p in files)
    got = {p.name: p.read_text() for p in files}
    assert sorted(got.pop("name=7").splitlines()) == ["a ü", "b"]
    assert got == {"name=8": "\n", "name=9": "\n", "name=-3": long + "\n", "name=__HIVE_DEFAULT_PARTITION__": "no name\n"}
    assert readers._one_file_each(docs.limit(0), folder + "-none").count() == 0 and Path(folder.removeprefix("file:") + "-none").is_dir()


def shuffled(spark):
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {name for k in range(files.size()) if (name := files.apply(k).getName()).startswith("shuffle_")}


def test_a_stage_leaves_no_shuffle_files(spark):
    before = shuffled(spark)
    set_before = spark.conf.get(session.CLEANUP, None)
    held = session.stage(spark.range(1000).selectExpr("id % 7 as k", "id").groupBy("k").agg(F.sum("id").alias("s")))
    end = time.time() + 20
    while shuffled(spark) - before and time.time() < end:
        time.sleep(0.1)
    assert not shuffled(spark) - before and spark.conf.get(session.CLEANUP, None) == set_before
    assert held.agg(F.sum("s")).first()[0] == 499500


def test_today_focus_writes_what_it_counts(spark, monkeypatch):
    asked, written = [], []
    rows = spark.createDataFrame(
        [(1, "c", f"k{n}", f"i{n}", f"T{n}", "homework", "upcoming", date(1998, 6, 10 + n), 20 * n, float(n)) for n in range(1, 12)],
        "student_id bigint, course_id string, match_key string, id string, title string, type string, status string, due_day date, estimated_minutes int, priority_score double",
    ).withColumns({"course": F.struct(F.lit("C").alias("code"), F.lit(70.0).alias("current_grade_pct")), "description": F.lit("d"), "external_url": F.lit("u")})
    monkeypatch.setattr(chain, "relevant_scored", lambda *args: asked.append(args[2:]) or rows)
    monkeypatch.setattr(planning, "stage", lambda df: written.append(df.columns) or session.stage(df))
    got = planning.today_focus(spark, "").collect()
    # five are due by the 15th, of which none needs more than an hour; the others come on their own days
    assert [(r["student_id"], r["today_minutes"], r["today_items"]) for r in got] == [(1, 20 + 40 + 60 + 60 + 60 + 20 + 40, 5)]
    assert asked == [(("estimated_minutes",),)] and not {"description", "external_url", "match_key", "course_id"} & set(written[0])
