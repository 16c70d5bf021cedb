"""Steps whose rows are dealt into tasks of bounded size, and what they no longer write or shuffle."""

from __future__ import annotations

import random
import re
from datetime import date

from pyspark.sql import functions as F

from queries import chain
from termloom import schemas
from termloom.operators import grades, links, priority, reconcile
from tests.conftest import at


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def dealt(df) -> list[int]:
    """Numbers of tasks into which rows are dealt by request."""
    return [int(n) for n in re.findall(r"hashpartitioning\([^)]*, (\d+)\), REPARTITION_BY_NUM", plan(df))]


def test_seeds_are_made_in_tasks_of_bounded_size(spark, monkeypatch):
    # every third course comes twice, with another name; some have no key
    courses = spark.createDataFrame(
        [(None if n == 5 else 1, f"c{n}", str(n), f"https://l/d2l/home/{n}", f"Course {n}{'b' * again}") for n in range(100) for again in range(1 + (n % 3 == 0))],
        "student_id bigint, course_id string, d2l_course_id string, home_url string, name string",
    ).coalesce(1)
    tools = spark.createDataFrame(
        [(None if n == 5 else 1, f"c{n}", p, name, None if n == 4 else f"https://t/{word}/{n}") for n in range(0, 100, 2)
         for p, (name, word) in enumerate([("Quiz test", "q"), ("Quizzes / Exams", "quizzing"), ("Grades", "g"), ("Grades", "h")])],
        "student_id bigint, course_id string, position int, name string, url string",
    ).coalesce(1)
    # the first announcement stands where the course does
    news = spark.createDataFrame(
        [(1, f"c{n}", p, f"https://l/d2l/home/{n}" if p == 0 else f"https://l/news/{n}", f"News {p}") for n in range(0, 100, 5) for p in range(3)],
        "student_id bigint, course_id string, position int, url string, title string",
    ).coalesce(1)
    monkeypatch.setattr(links, "PER_TASK", 4)
    out = links.seed_targets(courses, tools, news)
    assert dealt(out) == [-(-(134 + 200 + 60) // 4)] * 3

    wanted = {}
    for r in courses.collect():
        n, mine = int(r.course_id[1:]), (r.student_id, r.course_id)
        swapped = n % 2 == 0 and n != 5
        lms = "https://l/d2l"
        entries = [
            ("course_home", r.home_url, r.name), ("tool_content", f"{lms}/le/content/{n}/Home", "Content"),
            ("tool_assignments", f"{lms}/lms/dropbox/dropbox.d2l?ou={n}", "Assignments"),
            ("tool_quizzes-exams", f"https://t/quizzing/{n}", "Quizzes / Exams") if swapped else ("tool_quizzes-exams", f"{lms}/lms/quizzing/user/quizzes_list.d2l?ou={n}", "Quizzes / Exams"),
            ("tool_grades", f"https://t/g/{n}", "Grades") if swapped else ("tool_grades", f"{lms}/lms/grades/my_grades/main.d2l?ou={n}", "Grades"),
            ("tool_calendar", f"{lms}/le/calendar/{n}", "Calendar"), ("announcements_index", f"{lms}/lms/news/main.d2l?ou={n}", "Announcements"),
        ]
        if n == 4:  # tools without an address keep the default one and lend their name
            entries[3] = ("tool_quizzes-exams", f"{lms}/lms/quizzing/user/quizzes_list.d2l?ou={n}", "Quizzes / Exams")
            entries[4] = ("tool_grades", f"{lms}/lms/grades/my_grades/main.d2l?ou={n}", "Grades")
        for at, (kind, url, title) in enumerate(entries):
            wanted[(*mine, url)] = min(wanted.get((*mine, url), ((9, 0), "", "")), ((0, at), kind, title))
    for r in news.collect():
        mine = (r.student_id, r.course_id, r.url)
        wanted[mine] = min(wanted.get(mine, ((9, 0), "", "")), ((1, r.position), "announcement_detail", r.title))
    got = {(r.student_id, r.course_id, r.url): (tuple(r["at"]), r.page_kind, r.title) for r in out.collect()}
    assert len(got) == out.count() and got == wanted


def many(spark, assignments):
    rows = assignments(*[{"student_id": n % 7, "course_id": f"c{n % 3}", "title": f"Lab {n % 5}", "id": f"i{n}", "status": "graded", "grade_pct": 50.0 + n % 40} for n in range(300)])
    wanted = {"raw": "map<string,string>", "late_policy": schemas.LATE_POLICY}
    return rows.withColumns({n: F.lit(None).cast(t) for n, t in wanted.items() if n not in rows.columns})


def test_source_rows_are_dealt_by_course_into_tasks_of_bounded_size(spark, assignments, monkeypatch):
    monkeypatch.setattr(reconcile, "PER_TASK", 20)
    written = []
    monkeypatch.setattr(reconcile, "stage", lambda df: written.append(df) or df, raising=False)
    out = reconcile.canonical_assignments(many(spark, assignments), now=at("2026-03-24T12:00:00"))
    assert not written
    assert dealt(out) == [300 // 20]
    # the rows lie by course: one exchange serves the merge and what is grouped by course after it
    per_course = out.groupBy(*reconcile.COURSE).count()
    assert plan(per_course).count("Exchange ") == 1
    assert sum(r["count"] for r in per_course.collect()) == 105 == out.count()


def test_source_rows_cross_the_network_without_what_is_not_asked_for(spark, assignments):
    out = reconcile.canonical_assignments(many(spark, assignments), now=at("2026-03-24T12:00:00")).select("id", "grade_pct")
    below = plan(out).split("Exchange ")[1].split("\n")[1]  # the columns that are dealt
    assert "Project" in below and "title#" in below
    for name in ("external_url", "raw_due_at", "shown#", "match_key#"):
        assert name not in below


def test_rows_are_written_with_their_keys_and_what_is_asked_for(spark, assignments, courses, monkeypatch):
    rows = reconcile.canonical_assignments(many(spark, assignments), now=at("2026-03-24T12:00:00"))
    # every course comes twice, and so does each of its rows
    held = courses(*[{"student_id": n, "course_id": f"c{m}", "name": name} for n in range(7) for m in range(3) for name in "ab"])
    written = []
    monkeypatch.setattr(chain, "canonical", lambda *_: rows)
    monkeypatch.setattr(chain.V, "courses", lambda *_: held)
    monkeypatch.setattr(chain, "stage", lambda df: written.append(df.columns) or df)
    every, few = chain.graded_rows(spark, ""), chain.graded_rows(spark, "", ())
    assert set(every.columns) == {*rows.columns, "due_at", "due_day", "course"}
    assert few.columns == [*reconcile.COURSE, "match_key", "id", "course"]
    assert set(written[1]) == {*reconcile.KEYS, "id", *chain.FOR_GRADES}
    key = ["student_id", "id", "course.name", "course.current_grade_pct"]
    assert few.count() == 2 * rows.count()
    assert sorted(map(repr, every.select(*key).collect())) == sorted(map(repr, few.select(*key).collect()))


def test_texts_are_brought_into_normal_form_once(spark):
    # row: category, type, title
    for made in (priority.assignment_weight(), priority.category_label()):
        assert made._jc.toString().count("regexp_replace") <= 4


def test_source_rows_are_counted_by_their_course_alone(spark, assignments, monkeypatch):
    # totals of the grade book are no rows to be merged; they need not be told apart to be counted
    counted, real = [], reconcile._dealt
    monkeypatch.setattr(reconcile, "_dealt", lambda rows, of, most: counted.append(of) or real(rows, of, most))
    rows = many(spark, assignments).unionByName(many(spark, assignments).limit(40).withColumn("title", F.lit("Course total")))
    out = reconcile.canonical_assignments(rows, now=at("2026-03-24T12:00:00"))
    assert [c.columns for c in counted] == [list(reconcile.COURSE)] and out.count() == 105


def test_categories_are_read_once_per_course(spark, assignments, courses):
    # the row has one pattern of its own, for the key of its own category
    assert grades.assigned_category()._jc.toString().count("regexp_replace") == 1
    rows = reconcile.canonical_assignments(many(spark, assignments), now=at("2026-03-24T12:00:00"))
    held = courses(*[{"student_id": n, "course_id": f"c{m}", "grade_categories": [("Labs", 0.5, None)]} for n in range(7) for m in range(3)]).coalesce(1)
    tree = plan(reconcile.attach_courses(rows, held))
    # courses are dealt as they are, and their texts read after that, in the tasks of the join
    assert "REPARTITION_BY_COL" in tree and "regexp_replace" not in tree.split("REPARTITION_BY_COL")[1]


def _squashed(text):
    return " ".join((text or "").lower().split())


def _key(text):
    return re.sub(r"[^a-z0-9]+", "-", (text or "").lower()).strip("-") or None


def test_rows_find_the_categories_of_their_course(spark):
    rng = random.Random(7)
    names = ["Homework", "HW sets", "Programming  Exercises", "Exams", "Quizzes", "Lab Work", "Final Project", "Es", "", " ", "--", None, "Essay", "Reading", "Other"]
    pick = lambda some: rng.choice(some)
    lists = [None, [], *[[(pick(names), pick([None, 0.0, 0.2, 40.0, 150.0, 1e-9]), None) for _ in range(rng.randint(1, 4))] for _ in range(60)]]
    rows = [
        (i, f"c{i}", pick(["Essay 1", "hw 3", "HW  4", "Exams week", "x", None, "Lab Work 2"]), pick(["homework", "exam", "lab", "project", "reading", "discussion", "essay", "Exam", "", None]),
         pick([None, "", "Lab", "es", "Other things"]), pick([None, 0.1, 5.0, 0.0]), cats)
        for i, cats in enumerate(lists * 6)
    ]
    df = spark.createDataFrame(rows, f"student_id bigint, course_id string, title string, type string, grade_category string, grade_weight_pct double, cats {schemas.CATEGORIES}")
    table = df.select("student_id", "course_id", F.col("cats").alias("grade_categories"))
    out = reconcile.attach_courses(df.drop("cats"), table).select(
        "student_id", grades.assigned_category().alias("key"), priority.assignment_weight().alias("weight"), priority.category_label().alias("label"), grades.by_categories().alias("blended"),
    )
    got = {r.student_id: r for r in out.collect()}
    aliases, hints = grades.TYPE_ALIASES, priority.TYPE_HINTS
    for i, _, title, kind, own, direct, cats in rows:
        cats = cats or []
        words = [] if kind is None else [kind.lower(), *aliases.get(kind, ())]
        words += aliases["homework"] if (title or "").lower().startswith("hw ") else ()
        key = next((_key(n) for n, *_ in cats if _key(n) and any(w in n.lower() or n.lower() in w for w in words)), None)
        assert got[i].key == (_key(own) if own else key)
        mine, shown = _squashed(own), _squashed(title)
        stands = [h for h in (*hints.get(kind, ()), _squashed(kind)) if h]
        fit = [
            (n, w) for n, w, _ in cats
            if (c := _squashed(n)) and ((mine and (mine in c or c in mine)) or any(h in c for h in stands) or (len(c) >= 4 and c in shown))
        ]
        share = lambda w: None if w is None or not 0 <= w <= 100 else w if w <= 1 else w / 100
        top = max((share(w) for _, w in fit if share(w) is not None), default=None)
        wanted = share(direct) if own and share(direct) is not None else top if top is not None else share(direct)
        assert got[i].weight == wanted
        named = next((n.strip(" ") for n, _ in fit), None)
        assert got[i].label == (own or named or (kind if kind is None else kind.replace("_", " ").title()))
        assert got[i].blended == any((w or 0) > 0 for _, w, _ in cats)


def test_the_first_reason_is_the_one_that_leads_all(spark, assignments, courses):
    made = assignments(*[{"title": f"Lab {n}", "id": f"i{n}", "grade_weight_pct": float(n), "due_date": at("2026-03-25T12:00:00") if n % 4 else None, "status": "in_progress" if n % 3 else "overdue"} for n in range(40)])
    wanted = {"raw": "map<string,string>", "late_policy": schemas.LATE_POLICY}
    made = made.withColumns({n: F.lit(None).cast(t) for n, t in wanted.items() if n not in made.columns})
    dated = reconcile.with_deadline(reconcile.canonical_assignments(made, now=at("2026-03-24T12:00:00")), tz="UTC")
    rows = priority.priority_scores(reconcile.attach_courses(dated, courses({"grade_categories": [("Labs", 0.4, None)]})), today=date(2026, 3, 24))
    read = lambda limit: {r.id: r.priority_reasons for r in priority.priority_reasons(rows, limit=limit).collect()}
    every, first = read(9), read(1)
    assert {i: v[:1] for i, v in every.items()} == first and max(map(len, every.values())) > 1 and min(map(len, every.values())) == 0
