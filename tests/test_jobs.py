"""Documents on disk, whole refresh, streaming, model batches, and the registered queries against SQL."""

from __future__ import annotations

import json

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import compare
from conftest import at
from termloom.operators import extraction as E
from termloom.operators import normalize as N
from termloom.plans import refresh
from termloom.sources import snapshots
from termloom.sources.tables import TableStore
from termloom.streaming import jobs

TZ = "America/Chicago"
NOW = at("2026-03-24 12:00:00")
SF = "/root/testdata/sf0.001"


def topic(title, url, text=None, module=None, launch=None):
    return {"title": title, "url": url, "module_title": module, "extracted_text": text, "launch_url": launch}


def lms_document(fetched="2026-03-20T12:00:00Z", points="95 / 100", student=1, extra_rows=()):
    grade_rows = [
        {"title": "Homework", "is_category": True, "grade_text": "90 %"},
        {"title": "Programming Exercise 6.7: Unit 6 Code: more", "is_category": False, "category_title": "Homework", "points_text": points, "weight_achieved_text": "9 / 10", "grade_text": "95 %"},
        *extra_rows,
    ]
    return {
        "student_id": student, "fetched_at": fetched, "source_url": "https://l",
        "courses": [{
            "course_id": "42", "code": "CS 101", "name": "Intro", "semester": "Spring 2026", "home_url": "https://l/d2l/home/42",
            "final_calculated_grade": {"grade_text": "91.5 %"},
            "tool_links": [{"name": "Quizzes / Exams", "url": "https://l/q"}],
            "upcoming_events": [{"title": "Programming Exercise 6.7 - Due", "due_text": "MAR 22 11:59 PM", "details_url": "https://l/d2l/le/event/7590085"}],
            "announcements": [{"title": "News", "url": "https://l/n", "posted_at_text": "x", "items": [{"title": "Quiz 9", "url": None}]}],
            "grade_rows": grade_rows,
            "syllabus_topics": [topic("Syllabus", "s1", " Policy text "), topic("Copy", "s2", "Policy text")],
            "external_tools": [topic("MindTap Assignments", "t1", launch="https://www.cengage.com/x", module="MindTap")],
            "content_outline_topics": [topic("Week 1", "o1", "Quiz 9 due APR 2 11:59 PM\nObjectives\nnothing here", module="Week 1"), topic("Grading", "o2", "Weights", module=None)],
        }],
    }


def write(folder, name, document):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text(json.dumps(document))
    return str(folder)


def test_snapshot_becomes_merged_assignments(spark, tmp_path):
    frames = snapshots.explode_lms_snapshot(snapshots.read_lms_snapshot(spark, write(tmp_path / "in", "a.json", lms_document())))
    rows = {r["key"]: r for r in N.normalize_assignments(frames, tz=TZ).collect()}
    assert set(rows) == {"programming-exercise-6-7", "quiz-9"}
    pe, quiz = rows["programming-exercise-6-7"], rows["quiz-9"]
    assert pe["id"] == "cs-101-spring-2026-7590085" and pe["status"] == "upcoming" and pe["points_possible"] == 100.0 and pe["weight_possible"] == 10.0
    assert str(pe["due_at"]) == "2026-03-23 04:59:00" and pe["raw_source"]["event_due_text"] == "MAR 22 11:59 PM"
    assert quiz["status"] == "upcoming" and str(quiz["due_at"]) == "2026-04-03 04:59:00" and quiz["raw_source"]["announcement_title"] == "News"
    course = N.normalize_courses(frames).first()
    assert course["syllabus_raw_text"] == "[Syllabus]\nPolicy text\n\n---\n\n[Content: Grading]\nWeights"
    assert (course["external_platform"], course["current_grade_pct"]) == ("cengage_mindtap", 91.5)
    assert course["external_platform_urls"] == {"quizzes_exams": "https://l/q", "mindtap-assignments": "https://www.cengage.com/x"}
    work = snapshots.publisher_worklist(frames["courses"], frames["topics"]).first()
    assert (work["source_platform"], work["launch_url"]) == ("cengage_mindtap", "https://www.cengage.com/x")


def test_outline_text(spark):
    text = "Week 5\nProgramming Exercise 5.2 due Mar 1, 2026 11:59 PM\nQuiz 4 - MAR 8 11:59 PM\nReading MAR 9 11:59 PM\nshort"
    df = spark.createDataFrame([(1, text)], "id int, extracted_text string")
    got = [(r["title"], r["due_text"]) for r in N.outline_assignments(df, keys=["id"]).orderBy("line").collect()]
    assert got == [("Programming Exercise 5.2", "Mar 1, 2026 11:59 PM"), ("Quiz 4", "MAR 8 11:59 PM")]


def test_refresh_job_and_second_generation(spark, tmp_path):
    root = str(tmp_path / "tables")
    first = write(tmp_path / "one", "a.json", lms_document(extra_rows=[{"title": "Essay", "is_category": False, "points_text": "8 / 10"}]))
    out = refresh.refresh(spark, root, lms_path=first, tz=TZ, now=NOW)
    assert out["summary"].first()["course_count"] == 1 and out["canonical"].count() == 3
    assert out["agenda_entries"].count() == out["agenda_days"].agg(F.sum("entry_count")).first()[0]
    second = write(tmp_path / "two", "b.json", lms_document(fetched="2026-03-21T12:00:00Z"))
    refresh.refresh(spark, root, lms_path=second, tz=TZ, now=NOW)
    store = TableStore(spark, root)
    assert store.read("sync_summary").first().asDict() == {"courses_upserted": 1, "assignments_upserted": 2, "assignments_deleted": 1}
    assert store.read("assignments").count() == 2


def test_extraction_documents_refresh(spark, tmp_path):
    extraction = {
        "student_id": 1, "extracted_at": "2026-03-20T00:00:00Z",
        "courses": [{
            "course_id": "c1", "course_code": "C1", "course_name": "Course", "grading_scale": None, "grade_categories": [{"name": "HW", "weight": 0.5}],
            "assignments": [{"title": "Essay", "source_platforms": ["d2l"], "due_on": "2026-03-26", "evidence_artifact_ids": ["a1"], "evidence_spans": []}],
            "provenance_events": [{"stage": "extract", "detail": "{}"}, {"stage": "", "detail": "{}"}],
        }],
    }
    manifest = {"student_id": 1, "courses": [{"course_id": "c1", "code": "C1", "name": "Course"}],
                "artifacts": [{"id": "a1", "course_id": "c1", "source_platform": "d2l", "page_kind": "course_home", "url": "https://l/d2l/home/5"}]}
    root = str(tmp_path / "tables")
    out = refresh.refresh(spark, root, extraction_path=write(tmp_path / "x", "e.json", extraction), manifest_path=write(tmp_path / "m", "m.json", manifest), tz=TZ, now=NOW)
    row = out["upcoming"].first()
    assert (row["title"], row["external_url"], row["urgency_label"]) == ("Essay", "https://l/d2l/home/5", "Due in 2 days")
    assert TableStore(spark, root).read("log").count() == 1


def test_log_ids_never_repeat(spark, tmp_path):
    event = {"stage": "extract", "detail": "{}"}
    course = lambda c: {"course_id": c, "course_code": c, "course_name": c, "assignments": [{"title": "Essay", "evidence_artifact_ids": ["a1"], "evidence_spans": []}], "provenance_events": [event, event]}
    document = {"student_id": 1, "extracted_at": "2026-03-20T00:00:00Z", "courses": [course("c1"), course("c2"), course("c3")]}
    manifest = {"student_id": 1, "courses": [{"course_id": "c1", "code": "C1", "name": "Course"}], "artifacts": []}
    x, m, store = write(tmp_path / "x", "e.json", document), write(tmp_path / "m", "m.json", manifest), TableStore(spark, str(tmp_path / "tables"))
    for _ in range(2):
        refresh.sync_extraction_frames(store, snapshots.read_extraction(spark, x), snapshots.read_crawl_manifest(spark, m)[1], now=NOW)
    log = store.read("log")
    assert log.count() == 12 and log.select("log_id").distinct().count() == 12
    again = snapshots.read_extraction(spark, x)["provenance"].withColumn("created_at", F.col("extracted_at"))
    refresh.write_log(store, again, store.version("sync_summary"))
    assert store.read("log").count() == 12
    with pytest.raises(ValueError):
        refresh.refresh(spark, str(tmp_path / "tables"), extraction_path=x, tz=TZ, now=NOW)


def test_numbers_grow_with_the_position(spark):
    from termloom.operators import sync

    events = spark.range(5000).selectExpr("1L as student_id", "if(id % 3 = 0, 'a', 'b') as course_id", "id as position").unionByName(
        spark.sql("select cast(null as bigint) as student_id, cast(null as string) as course_id, cast(null as bigint) as position from range(3)"))
    rows = sync.numbered(events).collect()
    assert sorted(r["sequence"] for r in rows) == list(range(5003))
    for name in ("a", "b"):
        mine = sorted((r["position"], r["sequence"]) for r in rows if r["course_id"] == name)
        assert [n for _, n in mine] == sorted(n for _, n in mine)
    assert sync.numbered(events.limit(0)).count() == 0


def test_publisher_step_keeps_the_newest_and_reports_the_unknown(spark, tmp_path):
    root, store = str(tmp_path / "tables"), TableStore(spark, str(tmp_path / "tables"))
    refresh.refresh(spark, root, lms_path=write(tmp_path / "in", "a.json", lms_document()), tz=TZ, now=NOW)
    known = store.read("courses").first()["course_id"]
    row = lambda c, i, pct: {"id": i, "course_id": c, "source_platform": "cengage_mindtap", "title": f"Lab {i}", "type": "lab", "status": "upcoming", "grade_pct": pct}
    seen = lambda c: {"course_id": c, "source_platform": "cengage_mindtap", "launch_url": "u"}
    folder = tmp_path / "pub"
    write(folder, "old.json", {"student_id": 1, "fetched_at": "2026-03-19T00:00:00Z", "courses": [seen(known)], "assignments": [row(known, "l1", 10.0), row(known, "gone", 50.0)]})
    new = {"student_id": 1, "fetched_at": "2026-03-20T00:00:00Z", "courses": [seen(known), seen("other")], "assignments": [row(known, "l1", 80.0), row("other", "l9", 70.0)]}
    write(folder, "new.json", new)
    path = write(folder, "copy.json", new)
    for _ in range(2):
        refresh.sync_publisher_frames(store, *snapshots.read_publisher_snapshot(spark, path), now=NOW)
        got = store.read("assignments").where("source_platform = 'cengage_mindtap'").collect()
        assert [(r["id"], r["title"]) for r in got] == [("l1", "Lab l1")]
        assert [(r["course_id"], r["reason"]) for r in store.read("skipped_input").collect()] == [("other", "course is not known")]
    assert str(store.read("courses").first()["last_scraped_external"]) == "2026-03-20 00:00:00"


def test_older_snapshot_is_reported(spark, tmp_path):
    store = TableStore(spark, str(tmp_path / "tables"))
    for name, fetched in (("new", "2026-03-21T12:00:00Z"), ("old", "2026-03-19T12:00:00Z")):
        frames = snapshots.explode_lms_snapshot(snapshots.read_lms_snapshot(spark, write(tmp_path / name, "a.json", lms_document(fetched=fetched))))
        refresh.sync_lms_frames(store, frames, tz=TZ, now=NOW)
    assert [r["reason"] for r in store.read("skipped_input").collect()] == ["older than the stored course"]


def test_syllabus_step_applies_answers_and_keeps_failures_pending(spark, tmp_path):
    store = TableStore(spark, str(tmp_path / "tables"))
    for student in (1, 2):
        frames = snapshots.explode_lms_snapshot(snapshots.read_lms_snapshot(spark, write(tmp_path / f"in{student}", "a.json", lms_document(student=student))))
        refresh.sync_lms_frames(store, frames, tz=TZ, now=NOW)
    attempts = refresh.parse_syllabi(store, lambda prompt: 'Here: {"instructor": "Dr. A", "grade_categories": [{"name": "HW", "weight": 1.0}]}' if "Policy text" in prompt else "", "Read", now=NOW)
    assert [(r["student_id"], r["error"]) for r in attempts.orderBy("student_id").collect()] == [(1, None), (2, None)]
    assert [(r["instructor"], str(r["last_syllabus_parse"])) for r in store.read("courses").collect()] == [("Dr. A", "2026-03-24 12:00:00")] * 2
    assert refresh.parse_syllabi(store, lambda _: "{}", "Read", now=NOW).count() == 0

    def broken(_: str) -> str:
        raise ValueError("no model")

    failed = refresh.parse_syllabi(store, broken, "Read", now=NOW, force=True)
    assert {r["error"] for r in failed.collect()} == {"ValueError: no model"}
    assert {r["instructor"] for r in store.read("courses").collect()} == {"Dr. A"}
    assert store.read("log").where("stage = 'syllabus_parse'").count() == 4


def test_artifact_bodies_and_publisher_documents(spark, tmp_path):
    (tmp_path / "b").mkdir()
    (tmp_path / "b" / "t.txt").write_text("plain")
    (tmp_path / "b" / "p.html").write_text("<p>page</p>")
    art = [(1, "c", "a", "course_home", str(tmp_path / "b" / "t.txt"), str(tmp_path / "b" / "p.html")), (1, "c", "b", "other", str(tmp_path / "b" / "none.txt"), None)]
    df = spark.createDataFrame(art, "student_id bigint, course_id string, id string, page_kind string, text_path string, html_path string")
    from termloom.operators.pages import artifact_text

    got = {r["id"]: r["text"] for r in artifact_text(snapshots.read_artifact_bodies(spark, df, str(tmp_path / "b"))).collect()}
    assert got == {"a": "plain\n\npage", "b": ""}
    doc = {"student_id": 1, "fetched_at": "2026-03-20T00:00:00Z", "courses": [{"course_id": "c", "source_platform": "pearson_mylab", "launch_url": "u"}],
           "assignments": [{"id": "i", "course_id": "c", "source_platform": "pearson_mylab", "title": "T", "type": "homework", "status": "upcoming", "due_at": "2026-03-25T00:00:00Z"}]}
    cs, rows = snapshots.read_publisher_snapshot(spark, write(tmp_path / "pub", "p.json", doc))
    assert cs.first()["launch_url"] == "u" and str(rows.first()["due_at"]) == "2026-03-25 00:00:00"


def test_stream_sync_keeps_the_newest_snapshot(spark, tmp_path):
    folder, root, mark = tmp_path / "in", str(tmp_path / "t"), str(tmp_path / "cp")
    write(folder, "a.json", lms_document(fetched="2026-03-21T12:00:00Z", points="80 / 100"))
    jobs.stream_sync(spark, str(folder), root, mark, tz=TZ, clock=lambda: NOW).awaitTermination()
    write(folder, "b.json", lms_document(fetched="2026-03-19T12:00:00Z", points="10 / 100"))
    jobs.stream_sync(spark, str(folder), root, mark, tz=TZ, clock=lambda: NOW).awaitTermination()
    store = TableStore(spark, root)
    assert [r["points_earned"] for r in store.read("assignments").where("points_possible = 100").collect()] == [80.0]
    assert store.version("sync_summary") == 1  # the late document is dropped before anything is merged


def test_stream_log_drops_repeats(spark, tmp_path):
    source = str(tmp_path / "src")
    one = spark.read.parquet(f"{SF}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp")).where("event_id < 50")
    one.unionByName(one).write.parquet(source)
    events = spark.readStream.schema(one.schema).parquet(source)
    jobs.stream_log(events, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 50


def test_batch_extract_splits_and_keeps_failures(spark):
    rows = [(1, "c", i, f"a{i}", "d2l", "course_home", "t", "u", None, f"text {i}", None, "C", "N", 1) for i in range(4)] + [(1, "bad", 0, "z", "d2l", "k", "t", "u", None, "fail", None, "C", "N", 1)]
    chunks = spark.createDataFrame(rows, "student_id bigint, course_id string, position bigint, id string, source_platform string, page_kind string, title string, url string, parent_url string, text string, score_text string, course_code string, course_name string, chunk bigint")

    def answer(prompt: str) -> str:
        if "fail" in prompt:
            raise ValueError("broken")
        if prompt.count("artifact_id:") > 2:
            raise TimeoutError("slow")
        return json.dumps({"n": prompt.count("artifact_id:")})

    got = E.batch_extract(E.build_prompts(chunks, "Go"), answer, "Go").collect()
    assert sorted((r["course_id"], r["part"], r["response"], r["error"]) for r in got if r["course_id"] == "c") == [("c", "1", '{"n": 2}', None), ("c", "2", '{"n": 2}', None)]
    assert [(r["response"], r["error"]) for r in got if r["course_id"] == "bad"] == [(None, "ValueError: broken")]




@pytest.mark.parametrize("name", ["canonical_assignments", "course_grades", "priority_scores", "summary", "upsert", "consolidate_facts", "compose_syllabus", "page_links", "pack_chunks"])
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in compare.TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    df = entry.queries()[name](spark, SF)
    got = compare.table_of(df.columns, df.collect())
    result = con.execute(entry.oracle_sql()[name])
    assert got == compare.table_of([d[0] for d in result.description], result.fetchall())


def test_every_query_has_a_stable_name_and_entry_runs(spark):
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0
