from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from conftest import at
from termloom.functions import text as X
from termloom.functions import urls as U
from termloom.operators import links as L
from termloom.operators import pages as P

TZ = "America/Chicago"


def one(spark, expression, text):
    return spark.createDataFrame([(text,)], "t string").select(expression(F.col("t")).alias("v")).first()["v"]


def test_same_exercise_meets_under_one_key(spark):
    a = "Programming Exercise 6.7: Unit 6 Code: Unit 6: Inheritance and..."
    b = "Programming Exercise 6.7Not startedCOUNTS TOWARDS GRADE"
    assert one(spark, X.canonical_key, a) == one(spark, X.canonical_key, b) == "programming-exercise-6-7"
    assert one(spark, X.display_title, a) == one(spark, X.display_title, b) == "Programming Exercise 6.7"


@pytest.mark.parametrize(
    ("title", "shown", "key"),
    [
        ("Quiz 3 - Due", "Quiz 3", "quiz-3"),
        ("Lab 2 in class", "Lab 2", "lab-2"),
        ("Pre-requisite: Intro: More: Even more", "Pre-requisite: Intro", "pre-requisite-intro"),
        ("Unit due : Unit 4 Apply it", "Unit", "unit"),
        ("!!!", "!!!", "item"),
        ("Homework  1\tIn progress", "Homework 1", "homework-1"),
    ],
)
def test_display_title_and_key(spark, title, shown, key):
    assert one(spark, X.display_title, title) == shown
    assert one(spark, X.canonical_key, title) == key


@pytest.mark.parametrize(
    ("text", "expected"),
    [
        ("MAR 22 11:59 PM", "2026-03-23 04:59"), ("Mar 1, 2026 11:59 PM", "2026-03-02 05:59"), ("MAR 5", "2026-03-06 05:59"),
        ("FEB 30 1:00 PM", None), ("soon", None),
    ],
)
def test_due_texts(spark, text, expected):
    ref = F.lit("2026-03-20 12:00:00").cast("timestamp")
    got = one(spark, lambda c: F.date_format(X.due_flexible(c, ref, TZ), "yyyy-MM-dd HH:mm"), text)
    assert got == expected


@pytest.mark.parametrize(("text", "expected"), [("03/25/2026 10:59 PM", "2026-03-26 03:59"), ("01/26/26 6:00pm", "2026-01-27 00:00"), ("x", None)])
def test_due_slashed(spark, text, expected):
    assert one(spark, lambda c: F.date_format(X.due_slashed(c, TZ), "yyyy-MM-dd HH:mm"), text) == expected


def test_numbers(spark):
    assert one(spark, lambda c: F.struct(*[v.alias(n) for n, v in zip("ab", X.fraction(c), strict=True)]), "38.75 / 60").asDict() == {"a": 38.75, "b": 60.0}
    assert one(spark, X.percent, "46.92 %") == 46.92
    assert one(spark, lambda c: X.points(c)[0], "--/10 points") is None
    assert one(spark, lambda c: X.points(c)[1], "--/10 points") == 10.0
    assert one(spark, X.minutes, "about 25-30 minutes") == 28
    assert one(spark, X.fraction_of_text, "20%") == 0.2
    assert one(spark, X.fraction_of_text, "250") is None


def test_platform_and_types(spark):
    assert one(spark, X.platform_of, "MindTap via Pearson") == "cengage_mindtap"
    assert one(spark, X.platform_of, "Mastering") == "pearson_mylab"
    assert one(spark, X.infer_fact_type, "Programming Exercise 2") == "lab"
    assert one(spark, X.infer_type, "Programming Exercise 2") == "homework"


@pytest.mark.parametrize(
    ("base", "href", "expected"),
    [
        ("https://a.b/x/y?q=1", "/z", "https://a.b/z"), ("https://a.b/x/y?q=1", "z", "https://a.b/x/z"), ("https://a.b/x/y", "../z", "https://a.b/z"),
        ("https://a.b/x/y", "?k=2", "https://a.b/x/y?k=2"), ("https://a.b/x", "//c.d/e", "https://c.d/e"), ("https://a.b", "z", "https://a.b/z"),
        ("https://a.b/x/y", "http://c/d#f", "http://c/d#f"), ("https://a.b/x/y", "./", "https://a.b/x/"),
    ],
)
def test_resolved_links_equal_the_standard(spark, base, href, expected):
    from urllib.parse import urljoin

    got = spark.createDataFrame([(base, href)], "b string, h string").select(U.resolved(F.col("b"), F.col("h")).alias("v")).first()["v"]
    assert got == expected == urljoin(base, href)


def test_link_relevance(spark):
    rows = spark.createDataFrame(
        [("Grades", "https://l/d2l/lms/grades"), ("eText", "https://l/d2l/le/content/1"), ("Network", "https://l/x"), ("Course work", "https://l/x")], "text string, url string"
    )
    got = {r["text"] for r in L.relevant_links(rows).collect()}
    assert got == {"Grades", "Course work"}
    assert {r["text"] for r in L.relevant_links(rows, platform="pearson_mylab").collect()} == {"Grades", "Course work"}


def test_html_to_text(spark):
    html = (
        '<script>x</script><p>Due <abbr class="d2l-fuzzydate" title="Mar 3, 2026">soon</abbr> &amp;amp; more</p>'
        '<d2l-html-block html="&lt;p&gt;Inner&lt;/p&gt;"></d2l-html-block>'
    )
    got = P.html_to_text(spark.createDataFrame([(html,)], "html string")).first()["text"]
    assert got.startswith("Inner\n\nDue soon (Mar 3, 2026) & more")


def test_html_due_facts(spark):
    html = '<h3 class="x">Unit 5 Quiz - Due</h3><div><abbr class="a d2l-fuzzydate" id="i" title="Mar 29, 2026 11:59 PM">3 days</abbr></div>'
    pages = spark.createDataFrame([(1, "c", "a1", "tool_content", html), (1, "c", "a2", "course_home", html)], "student_id bigint, course_id string, id string, page_kind string, html string")
    rows = P.html_due_facts(pages, tz=TZ, now=at("2026-03-20 00:00:00")).collect()
    assert [(r["title"], r["due_at"], r["status"], r["assignment_type"]) for r in rows] == [("Unit 5 Quiz", "2026-03-29T23:59:00-05:00", "upcoming", "exam")]


def test_announcement_items_are_distinct_by_url_and_title(spark):
    links = spark.createDataFrame([(1, "c", 0, "u1", " News "), (1, "c", 1, "u1", "Again"), (1, "c", 2, "u2", "")], "student_id bigint, course_id string, position int, url string, text string")
    items = [("A", "x"), ("a", "y"), ("B", "x"), ("C", None), ("c", "z")]
    pages = spark.createDataFrame([(1, "c", "u1", "Posted on Mar 3, 2026 9:05 AM by me", items)], "student_id bigint, course_id string, url string, text string, items array<struct<title:string,url:string>>")
    row = P.announcements(links, pages).collect()
    assert len(row) == 1 and row[0]["title"] == "News" and row[0]["posted_at_text"] == "Mar 3, 2026 9:05 AM"
    assert [i["title"] for i in row[0]["items"]] == ["A", "C"]


def test_publisher_rows(spark):
    schema = "student_id bigint, course_id string, position int, title string, row_text string, points_text string, activity_class string, external_url string, description string"
    rows = [
        (1, "c", 0, "Ch 6.7In progress", "Ch 6.7 In progress about 25-30 minutes 03/25/2026 10:59 PM", "--/10 points", "", "https://x/1", None),
        (1, "c", 1, "dup", "dup", None, "", "https://x/1", None),
        (1, "c", 2, "Ch 7", "Ch 7 not started", "0/10 points", "", None, None),
    ]
    got = {r["title"]: r for r in P.mindtap_rows(spark.createDataFrame(rows, schema), tz=TZ).collect()}
    assert set(got) == {"Ch 6.7", "Ch 7"}
    assert got["Ch 6.7"]["status"] == "in_progress" and got["Ch 6.7"]["estimated_minutes"] == 28 and got["Ch 6.7"]["points_possible"] == 10.0
    assert got["Ch 7"]["status"] == "upcoming" and got["Ch 7"]["grade_pct"] == 0.0
    assert got["Ch 7"]["id"].startswith("cengage-c-ch-7-")


def test_mylab_table_rows(spark):
    schema = "student_id bigint, course_id string, position int, title string, assignment_kind string, row_text string, due_text string, due_class string, score_text string, href string"
    rows = [
        (1, "c", 0, "HW 1", "Quiz", "HW 1 03/25/2026 10:59 PM done", "03/25/2026 10:59 PM", "", "0%", "javascript:open(77,1)"),
        (1, "c", 1, "HW 2", "", "HW 2 something", "", "past due late", None, None),
        (1, "c", 2, "HW 3", "", "HW 3 8/10 points", None, None, None, None),
    ]
    got = {r["title"]: r for r in P.mylab_table_rows(spark.createDataFrame(rows, schema), tz=TZ, now=at("2026-03-20 00:00:00")).collect()}
    assert (got["HW 1"]["status"], got["HW 1"]["type"], got["HW 1"]["grade_pct"]) == ("upcoming", "exam", 0.0)
    assert got["HW 1"]["id"].startswith("pearson-c-77-")
    assert got["HW 2"]["status"] == "overdue"
    assert (got["HW 3"]["status"], got["HW 3"]["grade_pct"]) == ("completed", 80.0)


def test_course_links_and_events(spark):
    links = spark.createDataFrame(
        [(1, 0, "/d2l/home/42", "CS 101 -  Intro to X, 101-2, Spring 2026, Ends May 1, 2026", "https://l/d2l/home/42"), (1, 1, "/d2l/home/42", "Other - Y", "u"), (1, 2, "/d2l/home/7", "no separator", "u")],
        "student_id bigint, position int, href string, text string, home_url string",
    )
    r = P.course_links(links).collect()
    assert [(x["lms_course_id"], x["code"], x["name"], x["semester"], x["end_date_text"]) for x in r] == [("42", "CS 101", "Intro to X", "Spring 2026", "Ends May 1, 2026")]
    blocks = spark.createDataFrame([(1, "c", 0, "View Event - Quiz", "/e/1", ["MAR", "22", "11:59 PM", "Quiz 3 - Due", ""])], "student_id bigint, course_id string, position int, title string, href string, texts array<string>")
    e = P.upcoming_events(blocks).first()
    assert (e["title"], e["due_text"]) == ("Quiz 3 - Due", "MAR 22 11:59 PM")


def test_best_document_text(spark):
    body = "junk " * 20 + "Course Syllabus " + "word " * 100
    frames = [(1, "c", "t", 0, "https://s.brightspace.com/x", "z" * 900), (1, "c", "t", 1, "https://ok/x", body), (1, "c", "t", 2, "https://ok/y", "y" * 210), (1, "c", "t", 3, "about:blank", "q" * 999)]
    got = P.best_document_text(spark.createDataFrame(frames, "student_id bigint, course_id string, topic_url string, position int, frame_url string, text string")).first()
    assert got["extracted_text"].startswith("Course Syllabus word")


def test_classify_content_limits_and_kinds(spark):
    topics = [(1, "c", "Course Syllabus", 0, 0, "Syllabus", "u0", None, None, "text"), (1, "c", "MindTap", 1, 0, "Launch", "u1", "External Learning Tool", "L", None)]
    topics += [(1, "c", "Week 1", 2, i, f"Quiz {i}", f"w{i}", "HTML", None, "body" if i % 2 else None) for i in range(60)]
    topics += [(1, "c", "Week 1", 2, 90, "Quiz again", "u0", "HTML", None, "body")]
    t = spark.createDataFrame(topics, "student_id bigint, course_id string, module_title string, module_position int, position int, title string, url string, content_type string, launch_url string, extracted_text string")
    m = spark.createDataFrame([(1, "c", "Week 1", 2, "https://l/content", "m" * 130)], "student_id bigint, course_id string, module_title string, module_position int, content_url string, main_text string")
    assert P.classify_content(t, m).where("kind = 'outline'").count() == 1 + 30  # the module view, and every topic with text
    rows = P.classify_content(t, m, max_extracts=40).collect()
    kinds = [r["kind"] for r in rows]
    assert kinds.count("syllabus") == 1 and kinds.count("external") == 1
    assert kinds.count("outline") == 1 + 20  # the module view, and the ones with text among the first 40 tries
    assert any(r["url"] == "https://l/content#outline-module=Week%201" for r in rows)


def test_parse_model_json_keeps_bad_rows(spark):
    from termloom import schemas

    rows = spark.createDataFrame([("```json\n{\"assignments\": null}\n```",), ("no json",), ("{broken",), ("{\"assignments\": [}",)], "response string")
    got = P.parse_model_json(rows, schemas.FACTS_RESPONSE).collect()
    assert [r["error"] for r in got] == [None, "response holds no JSON object", "response holds no JSON object", "response is not valid JSON"]


def test_apply_syllabus_parse(spark, courses):
    from termloom import schemas

    parsed = spark.createDataFrame([(1, "c", '{"instructor":"Dr. X","grade_categories":[{"name":"HW","weight":0.4}],"grading_scale":{"A":[0.9,1.0]},"late_policy":{"raw_text":"none","accepts_late":false},"external_tools":[{"name":"t","textbook":"Book"}]}')], "student_id bigint, course_id string, j string")
    parsed = parsed.select("student_id", "course_id", F.from_json("j", schemas.PARSED_SYLLABUS.replace("\n", " ")).alias("parsed"), F.lit("2026-01-01").cast("timestamp").alias("parsed_at"))
    r = P.apply_syllabus_parse(courses({"textbook": "", "instructor": "old"}, {"course_id": "d", "instructor": "kept"}), parsed).orderBy("course_id").collect()
    assert (r[0]["instructor"], r[0]["textbook"], r[0]["late_policy_global"]) == ("Dr. X", "Book", "none")
    assert r[0]["syllabus_parsed"]["review_flags"] == ["grade category weights sum to 0.40"]
    assert r[1]["instructor"] == "kept" and r[1]["grading_scale"] is None
