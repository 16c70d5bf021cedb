"""Golden cases of reconcile, grades, priority, agenda, overview and sync."""

from __future__ import annotations

from datetime import date

import pytest
from pyspark.sql import functions as F

from conftest import at
from termloom import schemas
from termloom.operators import agenda, grades, overview, priority, reconcile, sync
from termloom.sources.tables import empty_table

TZ = "America/Chicago"
NOW = at("2026-03-24 12:00:00")
TODAY = date(2026, 3, 24)
COURSE = ["student_id", "course_id"]


def canonical(df, now=NOW):
    return reconcile.canonical_assignments(df, now=now)


def rows_of(df, courses_df, now=NOW):
    return reconcile.attach_courses(reconcile.with_deadline(canonical(df, now), tz=TZ), courses_df)


def final(df, courses_df, now=NOW):
    return {r["course_id"]: r["final_grade_pct"] for r in grades.course_grades(rows_of(df, courses_df, now), now=now).collect()}


def test_lms_row_is_canonical_and_publisher_fills_the_grade(assignments, courses):
    df = assignments(
        {"id": "lms", "title": "Homework 1 - Due", "points_earned": 50.0, "points_possible": 100.0, "grade_weight_pct": 20.0, "due_date": at("2026-03-20 10:00:00")},
        {"id": "pub", "title": "Homework 1Not started", "source_platform": "pearson_mylab", "status": "completed", "points_earned": 100.0, "points_possible": 100.0, "due_date": at("2026-03-25 10:00:00")},
        {"id": "other", "title": "Essay"},
    )
    got = {r["id"]: r for r in canonical(df).collect()}
    assert set(got) == {"lms", "other"}
    r = got["lms"]
    assert (r["grade_pct"], r["grade_weight_pct"], r["status"], r["due_date"].day, r["title"], r["due_source"]) == (100.0, 20.0, "completed", 20, "Homework 1", "d2l")
    assert final(df, courses({})) == {"c": 100.0}


def test_best_of_repeated_attempts_and_order_independence(assignments):
    attempts = [{"id": f"a{i}", "title": "Test 1", "source_platform": "pearson_mylab", "points_earned": p, "points_possible": 100.0} for i, p in enumerate((40.0, 82.0, 70.0))]
    for shuffled in (attempts, attempts[::-1]):
        r = canonical(assignments(*shuffled).repartition(3)).collect()
        assert len(r) == 1 and r[0]["grade_pct"] == 82.0 and r[0]["id"] == "a0"


def test_rollups_are_dropped_but_participation_stays(assignments):
    df = assignments(*[{"title": t} for t in ("Final Calculated Grade", "Course Total", "Participation current grade", "weighted total")])
    assert [r["title"] for r in canonical(df).collect()] == ["Participation current grade"]


def test_raw_fields_last_one_wins_and_true_zero_ranks_low(assignments):
    df = assignments(
        {"id": "a", "title": "X", "raw": {"due_at": "2026-03-29T23:59:00-05:00", "due_on": "2026-03-29"}, "grade_pct": 0.0, "source_platform": "pearson_mylab"},
        {"id": "b", "title": "X", "raw": {"due_at": None, "extra": "1"}, "grade_pct": None, "points_earned": 3.0},
    )
    r = canonical(df).first()
    assert r["raw_due_at"] is None and r["raw_due_on"] == "2026-03-29" and r["points_earned"] == 3.0
    assert reconcile.merged_raw(df).first()["raw"] == {"due_at": None, "due_on": "2026-03-29", "extra": "1"}


def test_deadline_prefers_captured_text(assignments):
    df = assignments({"id": "a", "title": "X", "due_date": at("2026-04-02 03:00:00"), "raw": {"due_at": "2026-04-01T22:30:00-05:00"}}, {"id": "b", "title": "Y", "due_date": at("2026-04-02 03:00:00")})
    got = {r["id"]: r for r in reconcile.with_deadline(canonical(df), tz=TZ).collect()}
    assert str(got["a"]["due_at"]) == "2026-04-02 03:30:00" and got["a"]["due_day"] == date(2026, 4, 1) and got["b"]["due_day"] == date(2026, 4, 1)


HW_EXAMS = [("Homework", 0.2, None), ("Exams", 0.8, None)]


def scored(i, title, earned, possible=10.0, **more):
    return {"id": i, "title": title, "points_earned": earned, "points_possible": possible, "status": "graded", **more}


def test_category_blend(assignments, courses):
    df = assignments(scored("h1", "Homework 1", 10.0), scored("h2", "Homework 2", 8.0), scored("e", "Exam 1", 70.0, 100.0, type="exam"))
    assert final(df, courses({"grade_categories": HW_EXAMS})) == {"c": 74.0}


def test_past_due_missing_work_counts_as_zero(assignments, courses):
    df = assignments(
        scored("h", "Homework 1", 10.0, grade_weight_pct=50.0), {"id": "e", "title": "Exam 1", "type": "exam", "due_date": at("2026-03-01 00:00:00"), "grade_weight_pct": 50.0},
    )
    table = courses({"grade_categories": HW_EXAMS})
    assert final(df, table) == {"c": 20.0}
    member = {r["id"]: r["note"] for r in grades.grade_members(rows_of(df, table), now=NOW).collect()}
    assert member == {"h": None, "e": grades.ZERO_NOTE}


def test_zero_scores_wait_for_the_due_date(assignments, courses):
    df = assignments(scored("a", "Homework 1", 0.0, due_date=at("2026-04-01 00:00:00")), scored("b", "Homework 2", 9.0), scored("c", "Homework 3", 0.0), scored("p", "Practice Test 1", 1.0))
    rows = rows_of(df, courses({"grade_categories": HW_EXAMS}))
    assert final(df, courses({"grade_categories": HW_EXAMS})) == {"c": 90.0}
    reasons = {r["title"]: r["reason"] for r in grades.grade_exclusions(rows, now=NOW).collect()}
    assert reasons == {"Homework 1": grades.ZERO_EARLY, "Homework 3": grades.ZERO_NO_DUE, "Practice Test 1": grades.PRACTICE}


def test_late_penalty(assignments, courses):
    policy = (None, True, 0.1, 5, None)
    df = assignments(scored("a", "Homework 1", 9.0, grade_weight_pct=10.0, late_policy=policy, raw={"days_late": "2"}))
    assert final(df, courses({})) == {"c": 70.0}
    late = assignments(scored("a", "Homework 1", 9.0, grade_weight_pct=10.0, late_policy=policy, raw={"days_late": "6"}))
    assert final(late, courses({})) == {"c": 0.0}


def planned(assignments, courses, *rows, daily=60, horizon=3, now=NOW):
    table = rows_of(assignments(*rows), courses({}), now)
    scored_rows = priority.priority_scores(table, today=agenda.local_today(now, TZ))
    plan = agenda.plan_agenda(scored_rows, today=agenda.local_today(now, TZ), horizon_days=horizon, daily_minutes=daily)
    return sorted((r["agenda_date"].isoformat(), r["planned_minutes"]) for r in plan.collect())


def test_plan_spreads_work(assignments, courses):
    hw = {"title": "HW", "status": "upcoming", "estimated_minutes": 90, "due_date": at("2026-03-26 04:59:00")}
    assert planned(assignments, courses, hw) == [("2026-03-24", 45), ("2026-03-25", 45)]
    overdue = {**hw, "estimated_minutes": 45, "due_date": at("2026-03-20 00:00:00"), "status": "overdue"}
    assert planned(assignments, courses, overdue) == [("2026-03-24", 45)]
    exam = {**hw, "type": "exam", "due_date": at("2026-03-29 20:00:00")}
    assert planned(assignments, courses, exam, horizon=7, daily=120) == [("2026-03-29", 90)]
    assert planned(assignments, courses, hw, horizon=0) == []


def test_overflow_adds_half_a_point(assignments, courses):
    rows = [{"title": f"HW {i}", "status": "upcoming", "estimated_minutes": 60, "due_date": at("2026-03-24 20:00:00")} for i in range(3)]
    table = priority.priority_scores(rows_of(assignments(*rows), courses({})), today=TODAY)
    plan = agenda.plan_agenda(table, today=TODAY, daily_minutes=60).collect()
    over = [r for r in plan if r["overflow"]]
    assert len(plan) == 3 and len(over) == 2 and all("overflow on due date" in r["notes"] for r in over)
    assert {r["priority_score"] for r in over} == {r["priority_score"] + 0.5 for r in plan if not r["overflow"]}


def score_of(assignments, courses, row, course):
    table = rows_of(assignments({"title": "X", "status": "upcoming", "due_date": at("2026-03-27 12:00:00"), **row}), courses(course))
    return priority.priority_scores(table, today=TODAY).first()["priority_score"]


@pytest.mark.parametrize(
    ("first", "second"),
    [
        (({"grade_category": "HW", "grade_weight_pct": 40.0}, {}), ({"type": "reading"}, {})),
        (({"late_policy": (None, False, None, None, None)}, {}), ({"late_policy": (None, True, 0.01, 7, None)}, {})),
        (({}, {"current_grade_pct": 89.0, "grading_scale": {"A": [90.0, 100.0]}}), ({}, {"current_grade_pct": 81.0, "grading_scale": {"A": [90.0, 100.0]}})),
        (({"status": "in_progress"}, {}), ({}, {})),
    ],
)
def test_priority_orderings(assignments, courses, first, second):
    assert score_of(assignments, courses, *first) > score_of(assignments, courses, *second)


def test_priority_reasons(assignments, courses):
    course = {"current_grade_pct": 88.5, "grading_scale": {"A": [0.9, 1.0]}, "grade_categories": [("Homework", 0.3, None)]}
    table = rows_of(assignments({"title": "Homework 1", "status": "in_progress", "due_date": at("2026-03-26 12:00:00")}), courses(course))
    r = priority.priority_reasons(priority.priority_scores(table, today=TODAY), limit=5).first()
    assert r["priority_reasons"] == ["Due within 2 days", "Homework worth about 30% of course grade", "1.5 points from the next grade cutoff", "Already in progress"]
    shown = overview.urgency_labels(priority.priority_reasons(priority.priority_scores(table, today=TODAY)), now=NOW, today=TODAY).first()
    assert shown["priority_reasons"][0] == "Due in 2 days" and shown["urgency_tone"] == "warning"


def test_summary_and_due_soon(assignments, courses):
    due = [{"title": f"HW {i:02d}", "status": "upcoming", "due_date": at("2026-03-24 20:00:00")} for i in range(14)]
    rows = rows_of(assignments(*due, {"title": "Practice Test", "due_date": at("2026-03-25 00:00:00"), "status": "upcoming"}), courses({}))
    s = overview.summary(courses({}), rows, now=NOW, today=TODAY).first()
    assert (s["course_count"], s["assignment_count"], s["upcoming_count"], s["urgent_count"]) == (1, 14, 14, 14)
    assert overview.due_soon(overview.relevant(rows)).count() == 12
    label = overview.due_labels(rows, tz=TZ).where("title = 'HW 00'").first()
    assert (label["due_label"], label["due_iso"]) == ("03/24/26 3:00 PM", "2026-03-24T20:00:00Z")
    health = overview.course_health(courses({"current_grade_pct": 85.0}), rows, now=NOW).first()
    assert (health["band"], health["assignment_count"], health["syllabus_url"]) == ("Needs attention", 14, "https://lms/d2l/le/content/9/Home")


def test_relevance(assignments, courses):
    df = assignments(
        {"title": "inventory", "source_platform": "pearson_mylab", "points_possible": 10.0}, {"title": "announced", "source_platform": "pearson_mylab", "points_possible": 10.0, "raw": {"announcement_title": "N"}},
        {"title": "lms", "points_possible": 10.0}, {"title": "only news", "raw": {"announcement_title": "N"}}, {"title": "graded", "source_platform": "pearson_mylab", "grade_pct": 0.0},
    )
    assert {r["title"] for r in overview.relevant(rows_of(df, courses({}))).collect()} == {"announced", "lms", "graded"}


def test_upsert_keeps_preserved_columns(spark):
    old = spark.createDataFrame([(1, "a", "x", "keep"), (1, "b", "y", "z")], "student_id bigint, id string, v string, p string")
    new = spark.createDataFrame([(1, "a", "1", None, 0), (1, "a", "2", None, 1), (1, "c", "3", "n", 0)], "student_id bigint, id string, v string, p string, seq int")
    got = {r["id"]: (r["v"], r["p"]) for r in sync.upsert(old, new, sync.KEY, sequence=["seq"], preserve=["p"]).collect()}
    assert got == {"a": ("2", "keep"), "b": ("y", "z"), "c": ("3", "n")}


def test_publisher_sync_prunes_its_scope(spark, assignments, courses):
    table = assignments({"id": "old", "title": "Old", "source_platform": "pearson_mylab"}, {"id": "lms", "title": "L"}, {"id": "new", "title": "N", "source_platform": "pearson_mylab"})
    seen = spark.createDataFrame([(1, "c", "pearson_mylab", "https://l", "T", 0, NOW), (1, "unknown", "pearson_mylab", "u", "T", 1, NOW)],
                                 "student_id bigint, course_id string, source_platform string, launch_url string, title string, position int, fetched_at timestamp")
    spec = schemas.PUBLISHER_SNAPSHOT.split("assignments array<struct<")[1].rsplit(">>", 1)[0].replace("raw_source:map<string,string>", "raw_source:map<string,string>")
    row = ("new", "c", "pearson_mylab", "N", "homework", "completed", None, None, at("2026-03-20 00:00:00"), None, 0.0, 10.0, None, 30, None)
    batch = spark.createDataFrame([row], f"struct<{spec}>".replace("\n", " ")).withColumns({"student_id": F.lit(1).cast("bigint"), "fetched_at": F.lit("2026-03-24 12:00:00").cast("timestamp")})
    new_courses, new_rows, summary = sync.sync_publisher(courses({}), table, seen, batch, now=NOW)
    assert summary.first().asDict() == {"courses_upserted": 1, "assignments_upserted": 1, "assignments_deleted": 1}
    got = {r["id"]: r for r in new_rows.collect()}
    assert set(got) == {"lms", "new"} and got["new"]["status"] == "overdue" and got["new"]["is_submitted"] is False and got["new"]["grade_pct"] is None
    c = new_courses.collect()
    assert len(c) == 1 and c[0]["external_platform"] == "pearson_mylab" and c[0]["last_scraped_external"] is not None


def test_extraction_sync_and_modes(spark, assignments, courses):
    from termloom.operators import extraction as E

    facts_schema = f"struct<student_id:bigint,course_id:string,position:int,{schemas.FACT_FIELDS}>".replace("\n", " ")
    base = {"student_id": 1, "course_id": "c", "position": 0, "title": "Essay 1", "source_platform": "d2l", "due_on": "2026-03-29", "points_possible": 10.0, "points_earned": 9.0,
            "graded": True, "evidence_artifact_ids": ["a1"], "evidence_spans": [("a1", " quote ")], "notes": [" n ", "n"]}
    names = spark.createDataFrame([], facts_schema).columns
    facts = spark.createDataFrame([tuple(base.get(n) for n in names), tuple({**base, "position": 1, "source_platform": "pearson_mylab", "optional": None}.get(n) for n in names)], facts_schema)
    merged = E.consolidate_facts(facts)
    full = merged.withColumns({"evidence_artifact_ids": F.array(F.lit("a1")), "evidence_spans": F.array(F.struct(F.lit("a1").alias("artifact_id"), F.lit("q").alias("quote")))})
    new_courses = spark.createDataFrame(
        [(1, "c", "C1", "Course", NOW, [("HW", 0.4, "n")], {"A": [0.9, 1.0]}, ("No late", False, 10.0, 0))],
        "student_id bigint, course_id string, course_code string, course_name string, extracted_at timestamp, grade_categories array<struct<name:string,weight:double,notes:string>>, grading_scale map<string,array<double>>, late_policy struct<raw_text:string,accepts_late:boolean,default_penalty_per_day:double,max_late_days:int>",
    )
    artifacts = spark.createDataFrame(
        [(1, "c", 0, "a0", "course_home", "https://l/d2l/home/77", None, "d2l"), (1, "c", 1, "a1", "d2l_nav_page", " ", "https://l/parent", "d2l")],
        "student_id bigint, course_id string, position int, id string, page_kind string, url string, parent_url string, source_platform string",
    )
    stale = assignments({"id": "stale", "title": "Stale", "source_platform": "pearson_mylab"})
    entries = spark.createDataFrame([(1, "stale", TODAY, 30, 1.0, None), (1, "kept", TODAY, 30, 1.0, None)], schemas.AGENDA.replace("\n", " "))
    for mode, deleted in (("full", 1), ("additive", 0)):
        cs, rows, agenda_rows, summary = sync.sync_extraction(courses({}), stale, entries, new_courses, full, artifacts, now=NOW, mode=mode)
        assert summary.first().asDict() == {"courses_upserted": 1, "assignments_upserted": 1, "assignments_deleted": deleted}
        assert agenda_rows.count() == 2 - deleted and rows.count() == 2 - deleted
    got = rows.where("id <> 'stale'").first()
    assert (got["id"], got["external_url"], got["status"], str(got["due_date"])) == ("c-essay-1", "https://l/parent", "graded", "2026-03-29 23:59:00")
    c = cs.first()
    assert (c["d2l_course_id"], c["external_platform"]) == ("77", "pearson_mylab")
    assert c["late_policy_global"] == "No late\nAccepts late submissions: False\nDefault penalty per day: 10.0%\nMax late days: 0"
    assert [r["note"] for r in E.fact_notes(facts).collect()] == ["n"] and [r["quote"] for r in E.fact_evidence(facts).collect()] == ["quote"]


def test_log_wraps_details_and_lists_newest_first(spark):
    events = spark.createDataFrame(
        [(0, 1, "c", "stage", "x" * 9000, '{"a": 1}'), (1, 1, "c", " ", "p", "{}"), (2, 1, "c", "stage", None, "plain")],
        "position long, student_id bigint, course_id string, stage string, text_preview string, detail string",
    )
    log = sync.append_log(events, batch=2)
    rows = sync.query_log(log, course_id="c", limit=1).collect()
    assert [r["detail"] for r in rows] == ['{"payload":{"d":"plain"}}']
    assert sorted(len(r["text_preview"] or "") for r in log.collect()) == [0, 9000]
    assert sorted(len(r["text_preview"] or "") for r in sync.append_log(events, batch=2, preview=8000).collect()) == [0, 8000]


def test_a_batch_is_reduced_to_one_row_per_key(spark):
    target = spark.createDataFrame([(1, "x", 1.0)], "student_id bigint, id string, points double")
    batch = spark.createDataFrame([(1, "x", 2.0), (1, "x", 3.0), (2, "y", 1.0)], "student_id bigint, id string, points double")
    once = sync.upsert(target, sync.one_per_key(batch, ["student_id", "id"]), ["student_id", "id"])
    twice = sync.upsert(once, sync.one_per_key(batch, ["student_id", "id"]), ["student_id", "id"])
    assert sorted(map(tuple, once.collect())) == sorted(map(tuple, twice.collect())) == [(1, "x", 3.0), (2, "y", 1.0)]


def test_outline_lines_may_hold_no_break_spaces(spark):
    from termloom.operators.normalize import outline_assignments

    df = spark.createDataFrame([(1, "Homework 3 due Mar 29, 2026 11:59\u00a0PM")], "k int, extracted_text string")
    assert outline_assignments(df, keys=["k"]).count() == 1


def test_external_tools_are_no_syllabus(spark):
    from termloom.operators.normalize import compose_syllabus

    rows = [(1, "c", "syllabus", 1, "Late work", "m", "a" * 100_000), (1, "c", "external", 2, "Tool", "m", "tool text")]
    df = spark.createDataFrame(rows, "student_id bigint, course_id string, kind string, position int, title string, module_title string, extracted_text string")
    text = compose_syllabus(df).first()["syllabus_raw_text"]
    assert "tool text" not in text and len(text) > 100_000


def test_syllabus_parts_are_rows_and_digest_as_one_text(spark):
    import hashlib

    from termloom.operators import normalize as N

    rows = [(s, c, "syllabus", p, f"T{p}", "m", f"text ü {p % 9} of {c}\n" * (p % 5 + 1)) for s in (1, 2) for c in ("c", "d", None) for p in range(40)]
    df = spark.createDataFrame(rows, "student_id bigint, course_id string, kind string, position int, title string, module_title string, extracted_text string").repartition(5)
    want = {(r["student_id"], r["course_id"]): r["syllabus_raw_text"] for r in N.compose_syllabus(df).collect()}
    parts = N.syllabus_parts(df)
    assert parts.count() > 3 * len(want) and all(r["n_chars"] == len(r["part"]) and r["part_md5"] == hashlib.md5(r["part"].encode()).hexdigest() for r in parts.collect())
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    got = {(r["student_id"], r["course_id"]): (r["n_chars"], r["text_md5"]) for r in N.syllabus_digests(parts).collect()}
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == {k: (len(t), hashlib.md5(t.encode()).hexdigest()) for k, t in want.items()}
    assert "collect_list" not in N.syllabus_digests(parts)._jdf.queryExecution().toString()


def test_empty_tables_have_their_schema(spark):
    assert empty_table(spark, "courses").columns[:3] == ["student_id", "course_id", "code"]
