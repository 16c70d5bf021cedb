"""Captured fragments, scopes and table projections, shaped from the given tables."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import functions as F

from queries import chain as C
from queries import planning, texts, web
from queries import views as V
from queries.canonical import stamp
from termloom import schemas
from termloom.functions import text as X
from termloom.operators import extraction as E
from termloom.operators import links as L
from termloom.operators import pages as P
from termloom.operators import sync as S
from termloom.plans import refresh
from termloom.session import checkpoint_dir
from termloom.sources.snapshots import publisher_worklist as worklist
from termloom.sources.tables import TableStore, empty_table
from termloom.streaming import jobs

BASE = {"student_id": "cast(1 as bigint)", "course_id": "'c' || cast(user_id % 20 as {s})", "position": "event_id"}
CHAPTER = "'Chapter ' || cast(event_id % 40 as {s}) || '.' || cast(event_id % 7 as {s})"
MINDTAP = {
    **BASE,
    "title": CHAPTER + " || case event_id % 4 when 0 then 'In progress' when 1 then 'Not started' when 2 then ' Submitted x' else '' end",
    "row_text": CHAPTER + " || case event_id % 4 when 0 then ' In progress' when 1 then ' Not started' when 2 then ' Submitted x' else '' end || ' about ' || cast(10 + event_id % 20 as {s}) || ' minutes'"
    " || case when event_id % 3 = 0 then ' 03/' || cast(10 + event_id % 18 as {s}) || '/2026 10:59 PM' else '' end || case when event_id % 5 = 0 then ' done ' else '' end",
    "points_text": "case event_id % 6 when 0 then '--/10 points' when 1 then cast(event_id % 10 as {s}) || '/10 points' end",
    "activity_class": "''", "external_url": "case when event_id % 8 = 0 then 'https://x.example.com/' || cast(event_id % 100 as {s}) end",
    "description": "cast(null as {s})",
}
MYLAB = {
    **BASE,
    "title": CHAPTER, "assignment_kind": "case when event_id % 3 = 0 then 'Quiz' else '' end",
    "row_text": CHAPTER + " || case event_id % 5 when 0 then ' incomplete' when 1 then ' completed' when 2 then ' past due' when 3 then ' 8/10 points' else '' end",
    "due_text": "case when event_id % 2 = 0 then '03/' || cast(10 + event_id % 18 as {s}) || '/2026 10:59 PM' end",
    "due_class": "case when event_id % 11 = 0 then 'Past Due' end", "score_text": "case event_id % 7 when 0 then '0%' when 1 then '95.5%' end",
    "href": "case when event_id % 9 = 0 then 'javascript:go(' || cast(event_id % 50 as {s}) || ',1)' end",
}


def _events(spark, sf, columns):
    return V.table(spark, sf, "events").selectExpr(*[f"{e.format(s='string')} as {n}" for n, e in columns.items()])


def _sql(columns):
    return "select " + ", ".join(f"{e.format(s='varchar')} as {n}" for n, e in columns.items()) + " from events"


ROW = ("course_id", "id", "position", "title", "type", "status", "points_earned", "points_possible", "grade_pct", "estimated_minutes")


def mindtap_rows(spark, sf):
    return P.mindtap_rows(_events(spark, sf, MINDTAP), tz=V.TZ).select(*ROW, stamp("due_at").alias("due_at"))


def mylab_list_rows(spark, sf):
    rows = _events(spark, sf, MYLAB).withColumns({"row_text": F.concat_ws(" ", "row_text", "due_text"), "external_url": F.lit(None).cast("string")})
    return P.mylab_list_rows(rows, tz=V.TZ).select(*ROW, stamp("due_at").alias("due_at"), "description")


def mylab_table_rows(spark, sf):
    from datetime import UTC, datetime

    return P.mylab_table_rows(_events(spark, sf, MYLAB), tz=V.TZ, now=datetime(2026, 3, 20, tzinfo=UTC)).select(*ROW, stamp("due_at").alias("due_at"))


def html_due_facts(spark, sf):
    from datetime import UTC, datetime

    n = F.col("page_id").cast("string")
    day = (F.col("page_id") % 28 + 1).cast("string")
    head = F.concat(F.lit("<h3 class='t'>Quiz "), n, F.lit(' &amp; more - Due</h3><p>x</p><abbr class="vui d2l-fuzzydate" title="Mar '), day, F.lit(', 2026 11:59 PM">soon</abbr>'))
    pages = V.table(spark, sf, "pages").select(
        F.lit(1).cast("bigint").alias("student_id"), F.lit("c").alias("course_id"), n.alias("id"),
        F.when(F.col("page_id") % 5 == 0, "course_home").otherwise("tool_content").alias("page_kind"), F.concat("html", head).alias("html"),
    )
    out = P.html_due_facts(pages, tz=V.TZ, now=datetime(2026, 3, 15, tzinfo=UTC))
    return out.select("id", "title", "due_at", "due_text", "status", "assignment_type")


def artifact_text(spark, sf):
    docs = V.table(spark, sf, "documents")
    art = docs.select(
        "doc_id", F.when(F.col("doc_id") % 4 == 0, "course_home").otherwise("other").alias("page_kind"), F.col("text").alias("body"),
        F.concat(F.lit("<p>Page "), F.col("doc_id").cast("string"), F.lit(" <b>bold</b></p>")).alias("html"),
    )
    return P.artifact_text(art).select("doc_id", F.md5(F.encode("text", "UTF-8")).alias("text_md5"), F.length("text").alias("n_chars"))


def best_document_text(spark, sf):
    d = V.table(spark, sf, "documents")
    frames = d.select(
        F.lit(1).cast("bigint").alias("student_id"), F.lit("c").alias("course_id"), F.col("source").alias("topic_url"), F.col("doc_id").alias("position"),
        F.when(F.col("doc_id") % 6 == 0, "https://s.brightspace.com/a").when(F.col("doc_id") % 7 == 0, "about:blank").otherwise("https://files.example.com/a").alias("frame_url"),
        F.concat(F.when(F.col("doc_id") % 3 == 0, "intro Course Syllabus ").otherwise("intro "), "text").alias("text"),
    )
    return P.best_document_text(frames).select("topic_url", F.length("extracted_text").alias("n_chars"), F.substring("extracted_text", 1, 6).alias("start"))


def upcoming_events(spark, sf):
    e = V.table(spark, sf, "events")
    n = F.col("event_id")
    blocks = e.select(
        F.lit(1).cast("bigint").alias("student_id"), F.col("user_id").cast("string").alias("course_id"), n.alias("position"),
        F.when(n % 5 == 0, F.lit("Other")).otherwise(F.concat(F.lit("View Event - "), "event_type")).alias("title"), F.concat(F.lit("/e/"), n.cast("string")).alias("href"),
        F.array(F.lit("MAR"), (n % 28 + 1).cast("string"), F.when(n % 2 == 0, "11:59 PM").otherwise(""), F.when(n % 3 == 0, F.concat(F.lit("Quiz  "), n.cast("string"))).otherwise("")).alias("texts"),
    )
    return P.upcoming_events(blocks).select("position", "title", "due_text", "details_url")


def announcements(spark, sf):
    e = V.table(spark, sf, "events")
    n = F.col("event_id")
    key = [F.lit(1).cast("bigint").alias("student_id"), F.concat(F.lit("c"), (F.col("user_id") % 20).cast("string")).alias("course_id")]
    url = F.concat(F.lit("https://l.example.edu/news/"), (n % 300).cast("string"))
    links = e.select(*key, n.alias("position"), url.alias("url"), F.when(n % 9 == 0, " ").otherwise(F.concat(F.lit(" News  "), n.cast("string"))).alias("text"))
    item = lambda t, u: F.struct(F.lit(t).alias("title"), F.lit(u).alias("url"))
    pages = e.select(*key, url.alias("url"), (n % 300).alias("m")).distinct().select(
        "student_id", "course_id", "url", F.concat(F.lit("Posted on Mar "), (F.col("m") % 28 + 1).cast("string"), F.lit(", 2026 9:05 AM by staff")).alias("text"),
        F.array(item("Quiz", "q1"), item("QUIZ", "q2"), item("Lab", "q1"), item(" ", "q3"), item("Essay", None)).alias("items"),
    )
    out = P.announcements(links, pages)
    return out.select("course_id", "position", "title", "url", "posted_at_text", F.array_join(F.transform("items", lambda i: i["title"]), ",").alias("items"))


def stream_log(spark, sf):
    """Events arriving twice, appended once: the streaming job run to the end of its input."""
    base = f"{checkpoint_dir(spark)}/log-{uuid.uuid4().hex}"
    schema = spark.read.parquet(f"{sf}/events.parquet").schema
    arriving = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf).withColumn("ts", F.col("ts").cast("timestamp"))
    twice = arriving.withColumn("copy", F.explode(F.array(F.lit(1), F.lit(2)))).drop("copy")
    jobs.stream_log(twice, f"{base}/out", f"{base}/state").awaitTermination()
    return spark.read.parquet(f"{base}/out").select("event_id", stamp("ts").alias("ts"), "user_id", "event_type", "value", "props")


def course_links(spark, sf):
    c = V.table(spark, sf, "customer")
    links = c.select(
        F.lit(1).cast("bigint").alias("student_id"), F.col("c_custkey").alias("position"), F.concat(F.lit("/d2l/home/"), (F.col("c_custkey") % 400).cast("string")).alias("href"),
        F.concat(F.col("c_mktsegment"), F.lit(" - "), "c_name", F.lit(", off, Spring, Ends May 1, 2026")).alias("text"), F.lit("u").alias("home_url"),
    )
    return P.course_links(links).select("lms_course_id", "code", "name", "offering_code", "semester", "end_date_text")


def seed_targets(spark, sf):
    c = V.table(spark, sf, "customer")
    n = F.col("c_custkey").cast("string")
    key = [F.lit(1).cast("bigint").alias("student_id"), F.concat(F.lit("c"), n).alias("course_id")]
    courses = c.select(*key, n.alias("d2l_course_id"), F.concat(F.lit("https://l.example.edu/d2l/home/"), n).alias("home_url"), F.col("c_name").alias("name"))
    tools = c.where("c_custkey % 2 = 0").select(
        *key, F.explode(F.array(
            F.struct(F.lit(0).alias("position"), F.lit("Quizzes / Exams").alias("name"), F.concat(F.lit("https://l.example.edu/quizzing/"), n).alias("url")),
            F.struct(F.lit(1).alias("position"), F.lit("Quiz test").alias("name"), F.concat(F.lit("https://l.example.edu/q2/"), n).alias("url")))).alias("t"),
    ).select("student_id", "course_id", "t.*")
    news = c.where("c_custkey % 3 = 0").select(*key, F.lit(0).alias("position"), F.concat(F.lit("https://l.example.edu/news/"), n).alias("url"), F.lit("News").alias("title"))
    return L.seed_targets(courses, tools, news).select("course_id", "page_kind", "url", "title")


def valid_picks(spark, sf):
    """The links that stand on each page, with picks for two pages in three."""
    p = V.table(spark, sf, "pages")
    n = F.col("page_id")
    listed = web._named(spark, sf).groupBy("page_id", "page_url").agg(F.array_sort(F.collect_list(F.struct("position", "url", "text"))).alias("l"))
    pages = listed.select("page_id", "page_url", F.transform("l", lambda x: F.struct(x["url"].alias("url"), x["text"].alias("text"))).alias("links"))
    picks = p.where("page_id % 3 <> 0").select(
        "page_id", F.array((n % 5).cast("int"), F.lit(1), F.lit(-1), F.lit(1)).alias("follow"), F.lit("why").alias("notes"), F.when(n % 7 == 0, "failed").alias("error")
    )
    return L.valid_picks(pages, picks).select("page_id", F.array_join("follow_indices", ",").alias("follow"), "notes", "fallback", "error")


def detail_urls(spark, sf):
    p = V.table(spark, sf, "part")
    n = F.col("p_partkey")
    rows = p.select(
        F.lit(1).cast("bigint").alias("student_id"), F.col("p_brand").alias("course_id"), n.alias("position"),
        F.when(n % 3 == 0, F.concat(n.cast("string"), F.lit("-focus"))).alias("focus_tag"), F.when(n % 3 == 1, F.concat(F.lit("activity-heading-h"), n.cast("string"))).alias("heading_id"),
        F.concat(F.lit("https://m.example.com/app?snapshotId="), (n % 9).cast("string"), F.lit("&deploymentId=d1"), F.when(n % 5 != 0, "&eISBN=978").otherwise("")).alias("course_url"),
    )
    return L.detail_urls(rows).select("course_id", "position", "activity_id", "detail_url")


def distinct_surfaces(spark, sf):
    p = V.table(spark, sf, "part")
    n = F.col("p_partkey")
    frames = p.select(
        F.lit(1).cast("bigint").alias("student_id"), F.col("p_brand").alias("course_id"), n.alias("position"), F.when(n % 2 == 0, F.lit(" Home ")).when(n % 2 == 1, F.lit("HOME")).alias("nav_label"),
        F.concat(F.when(n % 7 == 0, "https://other.example.com/courses/").otherwise("https://MyLab.Pearson.com/courses/"), (n % 4).cast("string"),
                 F.when(n % 3 == 0, "/assignments#f").when(n % 3 == 1, "/app.js").otherwise("/home")).alias("url"),
    ).withColumn("url", F.when(F.col("position") % 5 == 0, F.lower("url")).otherwise(F.col("url")))
    return L.distinct_surfaces(frames).select("course_id", "position", "page_kind")


def resolve_urls(spark, sf):
    facts = _facts_with_lists(spark, sf)
    artifacts = V.table(spark, sf, "events").selectExpr("user_id % 20 as u", "event_id % 7 as a", "event_id").groupBy("u", "a").agg(F.min("event_id").alias("e"))
    known = artifacts.where("a <> 0").select(
        F.lit(1).cast("bigint").alias("student_id"), F.concat(F.lit("c"), F.col("u").cast("string")).alias("course_id"), F.concat(F.lit("a"), F.col("a").cast("string")).alias("id"),
        F.col("e").alias("position"), F.when(F.col("a") % 2 == 0, "d2l").otherwise("pearson_mylab").alias("source_platform"),
        F.when(F.col("a") == 3, F.lit(" ")).otherwise(F.concat(F.lit("u"), F.col("a").cast("string"))).alias("url"), F.concat(F.lit("p"), F.col("a").cast("string")).alias("parent_url"),
    )
    return S.resolve_urls(facts, known).select("course_id", "fact_key", "url")


def _facts_with_lists(spark, sf):
    """Consolidated facts that cite one artifact, or none at all."""
    facts = E.consolidate_facts(texts._facts(spark, sf))
    cited = F.when(F.length("fact_key") % 2 == 0, F.array("first_artifact_id")).otherwise(F.array(F.lit("gone")))
    return facts.withColumns({"evidence_artifact_ids": cited, "evidence_spans": F.array().cast("array<struct<artifact_id:string,quote:string>>")})


def extraction_to_tables(spark, sf):
    facts = _facts_with_lists(spark, sf).withColumn("extracted_at", F.lit("2024-01-20 00:00:00").cast("timestamp"))
    urls = facts.select("student_id", "course_id", "fact_key", F.lit("u").alias("url"))
    from datetime import UTC, datetime

    out = S.extraction_to_assignments(facts, urls, now=datetime(2024, 1, 20, tzinfo=UTC))
    return out.select("course_id", "id", "type", "source_platform", "status", "is_submitted", stamp("due_date").alias("due_date"), "points_earned", "points_possible", "grade_pct")


def normalized_to_tables(spark, sf):
    rows = V.assignments(spark, sf).select(
        "student_id", "course_id", "id", "title", "type", "status", "source_platform", "external_url", F.col("due_date").alias("due_at"), "grade_category", "points_earned",
        "points_possible", F.col("grade_weight_pct").alias("weight_possible"), "grade_pct", F.col("raw").alias("raw_source"), F.col("last_scraped").alias("fetched_at"),
    )
    return S.normalized_to_assignments(rows, now=V.NOW).select("student_id", "id", "status", "grade_pct", "grade_weight_pct", "is_submitted", stamp("due_date").alias("due_date"))


def publisher_to_tables(spark, sf):
    rows = V.assignments(spark, sf).where("source_platform <> 'd2l'").withColumns({"due_at": F.col("due_date"), "raw_source": F.col("raw"), "fetched_at": F.col("last_scraped"),
                                                                              "status": F.when(F.col("status") == "graded", "completed").otherwise(F.col("status"))})
    return S.publisher_to_assignments(rows.drop("due_date", "raw"), now=V.NOW).select("student_id", "id", "status", "is_submitted", "is_late", stamp("submitted_at").alias("submitted_at"), "grade_pct")


def batch_extract(spark, sf):
    docs, numbers = texts._chunks(spark, sf)
    chunks = docs.join(numbers, ["student_id", "course_id", "position"]).withColumns(
        {"source_platform": F.lit("d2l"), "page_kind": F.col("lang"), "url": F.lit("u"), "parent_url": F.lit(None).cast("string"), "score_text": F.lit(None).cast("string"),
         "course_code": F.col("course_id"), "course_name": F.lit("Course")}
    )

    def answer(prompt: str) -> str:
        """Stands in for a model: refuses more than four artifacts, else counts them."""
        n = prompt.count("artifact_id: ")
        if n > 4:
            raise TimeoutError("too many")
        return str(n)

    got = E.batch_extract(E.build_prompts(chunks, "Count."), answer, "Count.")
    return got.groupBy("course_id", "chunk").agg(F.sum(F.col("response").cast("int")).alias("n"), F.count_if(F.col("error").isNotNull()).alias("errors"))


def apply_syllabus_parse(spark, sf):
    courses = V.courses(spark, sf).withColumns({"instructor": F.lit("old"), "textbook": F.when(F.col("student_id") % 2 == 0, "own"), "late_policy_global": F.lit(None).cast("string"),
                                              "last_syllabus_parse": F.lit(None).cast("timestamp")}).withColumn(
        "syllabus_parsed", F.when(F.lit(False), F.struct(F.lit(None).cast(schemas.LATE_POLICY).alias("late_policy"), F.array().cast("array<string>").alias("review_flags"))))
    text = F.concat(F.lit('{"instructor":"Dr. '), F.col("student_id").cast("string"), F.lit('","grade_categories":[{"name":"HW","weight":0.4}],"grading_scale":{"A":[0.9]},"external_tools":[{"name":"t","textbook":"Book"}]}'))
    parsed = courses.where("student_id % 3 = 0").select("student_id", "course_id", F.from_json(text, schemas.PARSED_SYLLABUS.replace("\n", " ")).alias("parsed"), F.lit("1998-06-15 00:00:00").cast("timestamp").alias("parsed_at"))
    out = P.apply_syllabus_parse(courses, parsed)
    return out.select("student_id", "course_id", "instructor", "textbook", F.array_join("syllabus_parsed.review_flags", "; ").alias("flags"), F.get("grade_categories", F.lit(0))["name"].alias("first_category"))


def publisher_worklist(spark, sf):
    part = V.table(spark, sf, "part")
    topics = part.select(
        F.lit(1).cast("bigint").alias("student_id"), F.col("p_brand").alias("course_id"), F.col("p_partkey").alias("position"), F.lit("external").alias("kind"),
        F.when(F.col("p_partkey") % 2 == 0, "MindTap Assignments").otherwise("eText").alias("title"), F.lit(None).cast("string").alias("module_title"),
        F.concat(F.lit("https://t/"), F.col("p_partkey").cast("string")).alias("url"), F.lit(None).cast("string").alias("launch_url"),
    )
    courses = part.groupBy(F.col("p_brand").alias("course_id")).agg(F.min("p_partkey").alias("course_position")).withColumns({"student_id": F.lit(1).cast("bigint"), "name": F.col("course_id")})
    return worklist(courses, topics).select("course_id", "course_position", "source_platform", "launch_url")


def refresh_overview(spark, sf):
    """Tables written once, then the whole overview job over them."""
    store = TableStore(spark, f"{checkpoint_dir(spark)}/overview-{spark.sparkContext.applicationId}-{sf.strip('/').replace('/', '-')}")
    every = list(range(store.buckets))
    store.replace("assignments", S._fitted(V.assignments(spark, sf), empty_table(spark, "assignments")), every)
    known = empty_table(spark, "courses")
    table = V.courses(spark, sf).withColumn("syllabus_parsed", F.when(F.col("syllabus_parsed").isNotNull(), F.struct(F.col("syllabus_parsed.late_policy").alias("late_policy"), F.array().cast("array<string>").alias("review_flags"))))
    store.replace("courses", S._fitted(table, known), every)
    return refresh.build_overview(store, tz=V.TZ, now=V.NOW)["summary"]


CLEAN = r"trim(regexp_replace(regexp_replace(title, '([\d.])(In progress\b|Not started\b|Submitted\b)', '\1 \2'), ' (?:Submitted|Not started|In progress).*$', ''))"
PTS = r"'(--|\d+(?:\.\d+)?)\s*/\s*(\d+(?:\.\d+)?)\s*points?'"
TYPE = "case when regexp_matches(lower({0}), 'quiz|exam|test') then 'exam' else 'homework' end"
SLASH = "strftime(timezone('UTC', timezone('America/Chicago', try_strptime(due_text, '%m/%d/%Y %I:%M %p'))), '%Y-%m-%d %H:%M:%S')"
PUB_ID = "'{0}-' || course_id || '-' || substr(" + texts.SLUG("k") + ", 1, 20) || '-' || substr(sha1(k), 1, 8)"
FIRST = "select * exclude (n) from (select *, row_number() over (partition by course_id, id order by position) as n from ({0})) where n = 1"
LIST_STATUS = "case when score is not null then 'completed' when contains(low, 'incomplete') then 'in_progress' when contains(low, 'complete') then 'completed' when contains(low, 'past due') then 'overdue' else 'upcoming' end"


def _renamed(suffix):
    """The grade CTEs once more, over the relevant rows."""
    names = [n for n, _ in C.EFFECTIVE]
    swap = lambda q: re.sub(r"\b(" + "|".join(names) + r")\b(?=[\s.,)]|$)", rf"\1{suffix}", re.sub(r"\bfrom j\b", "from jr", q))
    return [("jr", f"select * from j where {planning.RELEVANT}"), *[(n + suffix, swap(q)) for n, q in C.EFFECTIVE]]


QUERIES = {
    "mindtap_rows": (
        mindtap_rows,
        FIRST.format(f"""select course_id, {PUB_ID.format('cengage')} as id, position, t as title, {TYPE.format('t')} as type, case when e > 0 then 'completed'
          when contains(low, 'submitted') or contains(' ' || low || ' ', ' done ') then 'completed' when contains(low, 'in progress') then 'in_progress'
          when e is not null and not contains(low, 'not started') then 'completed' when contains(low, 'not started') then 'upcoming' else 'available' end as status,
          e as points_earned, p as points_possible, round(e / p * 100, 2) as grade_pct, m as estimated_minutes, {SLASH} as due_at from (select *, coalesce(external_url, t) as k, lower(row_text || ' ') as low from (select *,
          {CLEAN} as t, try_cast(regexp_extract(points_text, {PTS}, 1) as double) as e, try_cast(regexp_extract(points_text, {PTS}, 2) as double) as p,
          try_cast(regexp_extract(row_text, 'about (\\d+) minutes', 1) as int) as m, nullif(regexp_extract(row_text, '(\\d+/\\d+/\\d+ \\d+:\\d+ PM)', 1), '') as due_text from ({_sql(MINDTAP)})))"""),
    ),
    "mylab_list_rows": (
        mylab_list_rows,
        FIRST.format(f"""select course_id, {PUB_ID.format('pearson')} as id, position, title, 'homework' as type, {LIST_STATUS} as status, e as points_earned, p as points_possible, round(e / p * 100, 2) as grade_pct,
          cast(null as int) as estimated_minutes, {SLASH} as due_at, nullif(trim(substr(rt, length(title) + 1)), '') as d0, nullif(trim(case when starts_with(trim(substr(rt, length(title) + 1)), due_text)
            then substr(trim(substr(rt, length(title) + 1)), length(due_text) + 1) else trim(substr(rt, length(title) + 1)) end), '') as description from (select *, concat_ws('-', title, due_text) as k,
          concat_ws(' ', row_text, due_text) as rt, lower(concat_ws(' ', row_text, due_text)) as low, try_cast(regexp_extract(row_text, {PTS}, 1) as double) as e, try_cast(regexp_extract(row_text, {PTS}, 2) as double) as p,
          try_cast(regexp_extract(row_text, {PTS}, 2) as double) as score from ({_sql(MYLAB)}))""").replace("select * exclude (n)", "select * exclude (n, d0)"),
    ),
    "mylab_table_rows": (
        mylab_table_rows,
        FIRST.format(f"""select course_id, {PUB_ID.format('pearson')} as id, position, title, case when assignment_kind = 'Quiz' then 'exam' else 'homework' end as type,
          case when score = 0 and due >= timestamp '2026-03-20 00:00:00' then 'upcoming' when score is not null then 'completed' when lower(due_class) like '%past due%' then 'overdue'
          when plain <> 'upcoming' then plain when due < timestamp '2026-03-20 00:00:00' then 'overdue' else plain end as status, e as points_earned, p as points_possible, score as grade_pct,
          cast(null as int) as estimated_minutes, strftime(due, '%Y-%m-%d %H:%M:%S') as due_at from (select *, case when p is not null then round(e / p * 100, 2) else try_cast(regexp_extract(st, '([\\d.]+)%', 1) as double) end as score,
            case when try_cast(regexp_extract(row_text, {PTS}, 2) as double) is not null then 'completed' when contains(row_text, 'incomplete') then 'in_progress' when contains(row_text, 'complete') then 'completed'
            when contains(row_text, 'past due') then 'overdue' else 'upcoming' end as plain from (select *, coalesce(nullif(regexp_extract(href, '\\((\\d+),', 1), ''), concat_ws('-', title, due_text)) as k,
            timezone('UTC', timezone('America/Chicago', try_strptime(due_text, '%m/%d/%Y %I:%M %p'))) as due, st, try_cast(regexp_extract(st, {PTS}, 1) as double) as e, try_cast(regexp_extract(st, {PTS}, 2) as double) as p
            from (select *, coalesce(score_text, row_text) as st from ({_sql(MYLAB)}))))"""),
    ),
    "html_due_facts": (
        html_due_facts,
        """select cast(page_id as varchar) as id, 'Quiz ' || page_id || ' & more' as title, '2026-03-' || lpad(cast(page_id % 28 + 1 as varchar), 2, '0') || 'T23:59:00' || case when page_id % 28 + 1 < 8 then '-06:00' else '-05:00' end as due_at,
          'Mar ' || (page_id % 28 + 1) || ', 2026 11:59 PM' as due_text, case when timezone('UTC', timezone('America/Chicago', timestamp '2026-03-01 23:59:00' + to_days(cast(page_id % 28 as int)))) >= timestamp '2026-03-15 00:00:00' then 'upcoming' else 'overdue' end as status, 'exam' as assignment_type from pages where page_id % 5 <> 0""",
    ),
    "artifact_text": (
        artifact_text,
        r"""select doc_id, md5(t) as text_md5, length(t) as n_chars from (select doc_id, concat_ws(chr(10) || chr(10), nullif(regexp_replace(text, '^\s+|\s+$', '', 'g'), ''),
          case when doc_id % 4 = 0 then 'Page ' || doc_id || ' bold' end) as t from documents)""",
    ),
    "best_document_text": (
        best_document_text,
        r"""select topic_url, length(t) as n_chars, substr(t, 1, 6) as start from (select source as topic_url, arg_min(t, (-length(t), doc_id)) as t from (select source, doc_id,
          case when doc_id % 3 = 0 then substr(t, 7) else t end as t from (select *, trim(regexp_replace(case when doc_id % 3 = 0 then 'intro Course Syllabus ' else 'intro ' end || text, '\s+', ' ', 'g')) as t from documents
          where doc_id % 6 <> 0 and doc_id % 7 <> 0) where length(t) >= 200) group by source)""",
    ),
    "upcoming_events": (
        upcoming_events,
        """select event_id as position, case when event_id % 3 = 0 then 'Quiz ' || event_id when event_id % 2 = 0 then '11:59 PM' else cast(event_id % 28 + 1 as varchar) end as title,
          'MAR ' || (event_id % 28 + 1) || case when event_id % 2 = 0 then ' 11:59 PM' else '' end as due_text, '/e/' || event_id as details_url from events where event_id % 5 <> 0""",
    ),
    "announcements": (
        announcements,
        """select course_id, position, 'News ' || position as title, 'https://l.example.edu/news/' || m as url, 'Mar ' || (m % 28 + 1) || ', 2026 9:05 AM' as posted_at_text, 'Quiz,Essay' as items from (
          select 'c' || user_id % 20 as course_id, event_id % 300 as m, min(event_id) as position from events where event_id % 9 <> 0 group by all)""",
    ),
    "stream_log": (stream_log, "select event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') as ts, user_id, event_type, value, props from events"),
    "course_links": (
        course_links,
        """select cast(k as varchar) as lms_course_id, arg_min(c_mktsegment, c_custkey) as code, arg_min(c_name, c_custkey) as name, 'off' as offering_code, 'Spring' as semester, 'Ends May 1, 2026' as end_date_text
          from (select *, c_custkey % 400 as k from customer) group by k""",
    ),
    "seed_targets": (
        seed_targets,
        """with c as (select c_custkey as n, c_name, 'c' || c_custkey as course_id, 'https://l.example.edu' as l from customer)
          select course_id, 'course_home' as page_kind, l || '/d2l/home/' || n as url, c_name as title from c union all
          select course_id, 'tool_content', l || '/d2l/le/content/' || n || '/Home', 'Content' from c union all
          select course_id, 'tool_assignments', l || '/d2l/lms/dropbox/dropbox.d2l?ou=' || n, 'Assignments' from c union all
          select course_id, 'tool_quizzes-exams', case when n % 2 = 0 then l || '/quizzing/' || n else l || '/d2l/lms/quizzing/user/quizzes_list.d2l?ou=' || n end, 'Quizzes / Exams' from c union all
          select course_id, 'tool_grades', l || '/d2l/lms/grades/my_grades/main.d2l?ou=' || n, 'Grades' from c union all
          select course_id, 'tool_calendar', l || '/d2l/le/calendar/' || n, 'Calendar' from c union all
          select course_id, 'announcements_index', l || '/d2l/lms/news/main.d2l?ou=' || n, 'Announcements' from c union all
          select course_id, 'announcement_detail', l || '/news/' || n, 'News' from c where n % 3 = 0""",
    ),
    "valid_picks": (
        valid_picks,
        f"""with l as ({web.NAMED_SQL}), p as (select page_id, count(*) as n, coalesce(string_agg(cast(position - 1 as varchar), ',' order by position) filter ({web.LMS_SQL}), '') as words from l group by page_id),
          u as (select *, page_id % 3 <> 0 and page_id % 7 <> 0 as used, list_filter([page_id % 5, 1], lambda x: x < n) as f from p)
          select page_id, case when used then array_to_string(list_transform(list_filter(range(len(f)), lambda i: not list_contains(f[1:i], f[i + 1])), lambda i: f[i + 1]), ',') else words end as follow,
          case when used then 'why' end as notes, case when not used then 'heuristic_d2l' end as fallback, case when page_id % 3 <> 0 and page_id % 7 = 0 then 'failed' end as error from u""",
    ),
    "detail_urls": (
        detail_urls,
        """select course_id, position, activity_id, 'https://m.example.com/app?deploymentId=d1&eISBN=978&id=' || activity_id || '&snapshotId=' || position % 9 || '&' as detail_url from (select p_brand as course_id, p_partkey as position, case p_partkey % 3 when 0 then cast(p_partkey as varchar) when 1 then 'h' || p_partkey end as activity_id
          from part where p_partkey % 5 <> 0 and p_partkey % 3 <> 2)""",
    ),
    "distinct_surfaces": (
        distinct_surfaces,
        """select course_id, min(position) as position, case when arg_min(assign, position) then 'external_assignments_frame' else 'external_course_frame' end as page_kind from (select p_brand as course_id, p_partkey as position, p_partkey % 4 as c,
          p_partkey % 3 as tail, p_partkey % 5 = 0 and p_partkey % 3 = 0 as assign from part where p_partkey % 7 <> 0 and p_partkey % 3 <> 1) group by course_id, c, tail""",
    ),
    "resolve_urls": (
        resolve_urls,
        f"""{texts.FACTS_CTE}, k as ({texts.CONSOLIDATED}), a as (select 'c' || u as course_id, 'a' || a as id, e, case when a % 2 = 0 then 'd2l' else 'pearson_mylab' end as sp, case when a <> 3 then 'u' || a end as own,
          case when a <> 3 then 'u' || a else 'p3' end as any_url from (select user_id % 20 as u, event_id % 7 as a, min(event_id) as e from events group by all) where a <> 0)
          select k.course_id, fact_key, coalesce(case when length(fact_key) % 2 = 0 then c.any_url end, (select arg_min(own, e) from a where a.course_id = k.course_id and own is not null
            and a.sp = coalesce(case when contains(source_platforms, 'cengage_mindtap') then 'cengage_mindtap' when contains(source_platforms, 'd2l') then 'd2l' when source_platforms <> '' then source_platforms end, 'd2l'))) as url
          from k left join a c on c.course_id = k.course_id and c.id = k.first_artifact_id""",
    ),
    "extraction_to_tables": (
        extraction_to_tables,
        rf"""{texts.FACTS_CTE}, k as ({texts.CONSOLIDATED}), s as (select *, coalesce(try_cast(replace(replace(due_at, 'T', ' '), 'Z', '') as timestamp), try_cast(due_on || ' 23:59:00' as timestamp)) as due, case when points_earned is not null
          and points_possible > 0 then round(points_earned / points_possible * 100, 2) else grade_pct end as g, case when status in ('overdue', 'available') then status when graded then 'graded' when submitted then 'submitted' else 'upcoming' end as st from k),
          z as (select *, coalesce(g <= 0, false) or coalesce(points_earned <= 0 and points_possible > 0, false) as zero from s)
          select course_id, course_id || '-' || {texts.SLUG("title")} as id, case when assignment_type = 'exam' then 'exam' when regexp_matches(lower(title), 'quiz') then 'exam' when contains(lower(title), 'lab') then 'lab'
            when contains(lower(title), 'project') then 'project' else 'homework' end as type, coalesce(nullif(split_part(source_platforms, ',', 1), ''), 'd2l') as source_platform,
          case when zero and st in ('graded', 'submitted') then case when coalesce(due < timestamp '2024-01-20 00:00:00', false) then 'overdue' else 'upcoming' end else st end as status,
          (coalesce(submitted, false) or st in ('submitted', 'graded')) and not zero as is_submitted, strftime(due, '%Y-%m-%d %H:%M:%S') as due_date, points_earned, points_possible, cast(null as double) as grade_pct from z""",
    ),
    "normalized_to_tables": (
        normalized_to_tables,
        V.with_views() + f"""select student_id, id, case when z and status in ('graded', 'in_progress') then case when coalesce(due_date < {V.NOW_SQL}, false) then 'overdue' else 'upcoming' end else status end as status,
          g as grade_pct, grade_weight_pct, false as is_submitted, strftime(due_date, '%Y-%m-%d %H:%M:%S') as due_date from (select *, coalesce(g <= 0, false) or coalesce(points_earned <= 0 and points_possible > 0, false) as z
          from (select *, coalesce(round(points_earned / nullif(points_possible, 0) * 100, 2), grade_pct) as g from asg))""",
    ),
    "publisher_to_tables": (
        publisher_to_tables,
        V.with_views() + f"""select student_id, id, case when z and status in ('graded', 'in_progress') then case when coalesce(due_date < {V.NOW_SQL}, false) then 'overdue' else 'upcoming' end
          when status = 'graded' then 'completed' else status end as status, status = 'graded' and not z as is_submitted, status = 'overdue' as is_late,
          case when status = 'graded' and not z then strftime(last_scraped, '%Y-%m-%d %H:%M:%S') end as submitted_at, cast(null as double) as grade_pct
          from (select *, coalesce(g <= 0, false) or coalesce(points_earned <= 0 and points_possible > 0, false) as z from (select *, coalesce(round(points_earned / nullif(points_possible, 0) * 100, 2), grade_pct) as g from asg
          where source_platform <> 'd2l'))""",
    ),
    "batch_extract": (batch_extract, f"with {texts.PACKED} select course_id, chunk, count(*) as n, 0 as errors from w group by all"),
    "apply_syllabus_parse": (
        apply_syllabus_parse,
        V.with_views() + """select student_id, course_id, case when p then 'Dr. ' || student_id else 'old' end as instructor, case when student_id % 2 = 0 then 'own' when p then 'Book' end as textbook,
          case when p then 'grade category weights sum to 0.40; late policy needs review' end as flags, case when p then 'HW' when course_no = 0 then 'Homework' when course_no = 1 then 'Programming Exercises' end as first_category
          from (select *, student_id % 3 = 0 as p from crs)""",
    ),
    "publisher_worklist": (
        publisher_worklist,
        """select p_brand as course_id, min(p_partkey) as course_position, 'cengage_mindtap' as source_platform, 'https://t/' || min(case when p_partkey % 2 = 0 then p_partkey end) as launch_url
          from part group by p_brand having min(case when p_partkey % 2 = 0 then p_partkey end) is not null""",
    ),
    "refresh_overview": (refresh_overview, planning.QUERIES["summary"][1]),
    "course_health": (
        planning.course_health,
        C.sql(C.CANONICAL, C.DUE, C.EFFECTIVE, _renamed("_r"), body=f"""select c.student_id, c.course_id, c.code, c.name, c.semester, c.external_platform, c.d2l_url, g as current_grade_pct,
          case when g >= 90 then 'On track' when g >= 80 then 'Needs attention' else 'At risk' end as band, case when g >= 90 then 'safe' when g >= 80 then 'warning' else 'critical' end as tone,
          coalesce(n, 0) as assignment_count, coalesce(o, 0) as upcoming_count, case when c.course_no < 2 then 'https://lms.example.edu/d2l/le/content/' || c.d2l_course_id || '/Home' end as syllabus_url,
          r.final_grade_pct as detail_grade_pct, r.numerator_weighted_points, r.total_weight_pct from (select crs.*, coalesce(f.final_grade_pct, crs.current_grade_pct) as g from crs left join finals f using (student_id, course_id)) c
          left join finals_r r using (student_id, course_id) left join (select student_id, course_id, count(*) as n, count(*) filter (where {planning.OPEN}) as o from jr group by all) k using (student_id, course_id)"""),
    ),
}
