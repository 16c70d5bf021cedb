"""Titles, keys, due texts, snapshots, chunks and extracted facts over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from queries import views as V
from queries.canonical import stamp
from queries.chain import display_ctes
from termloom import schemas
from termloom.functions import text as X
from termloom.operators import extraction as E
from termloom.operators import normalize as N
from termloom.operators import pages as P

TITLES = (
    "Programming Exercise 6.7: Unit 6 Code: Unit 6: Inheritance and more", "Programming Exercise 6.7Not startedCOUNTS TOWARDS GRADE",
    "Quiz 3 - Due", "HW 4 in class", "Pre-requisite: Intro: A: B", "Discussion 2 : Unit 4 Apply task", "Reading in progress", "Lab: Cells Due",
    "Final Exam", "Project Test plan", "!!!", "MindTap Pearson mix", "Mastering Biology lab",
)
TITLES_SQL = "[" + ", ".join(f"'{t}'" for t in TITLES) + "]"
DUES = ("MAR 22 11:59 PM", "apr 5", "Mar 1, 2026 11:59 PM", "January 5, 2025 8:05 AM", "FEB 30 1:00 PM", "soon", "Dec 9 2025 7:00 PM")
DUES_SQL = "[" + ", ".join(f"'{d}'" for d in DUES) + "]"
SLASHED = ("03/25/2026 10:59 PM", "01/26/26 6:00pm", "7/4/2025 9:05 am", "13/40/2025 1:00 PM", "later")
SLASHED_SQL = "[" + ", ".join(f"'{d}'" for d in SLASHED) + "]"
NUMBERS = ("38.75 / 60", "46.92 %", "--/10 points", "8.5/10 Points", "about 25-30 minutes", "about 40 minutes", "95% done", "a / b", "none")
NUMBERS_SQL = "[" + ", ".join(f"'{n}'" for n in NUMBERS) + "]"


def _pick(spark, sf, values):
    """One of the values per part, followed by the part key where that keeps it parseable."""
    part = V.table(spark, sf, "part")
    return part.select("p_partkey", "p_name", F.element_at(F.array(*[F.lit(v) for v in values]), (F.col("p_partkey") % len(values) + 1).cast("int")).alias("t"))


def match_keys(spark, sf):
    t = F.col("title")
    rows = _pick(spark, sf, TITLES).select("p_partkey", F.concat_ws(" ", "p_name", "t").alias("title"))
    return rows.select(
        "p_partkey", X.display_title(t).alias("shown"), X.canonical_key(t).alias("canonical_key"), X.snapshot_key(t).alias("snapshot_key"),
        X.fact_key(t).alias("fact_key"), X.name_key(t).alias("name_key"),
    )


def inference(spark, sf):
    t = F.col("title")
    rows = _pick(spark, sf, TITLES).select("p_partkey", F.concat_ws(" ", "t", "p_name").alias("title"))
    return rows.select(
        "p_partkey", X.infer_type(t).alias("type"), X.infer_fact_type(t).alias("fact_type"), X.infer_status(t).alias("status"), X.platform_of(t).alias("platform"),
    )


def stable_ids(spark, sf):
    rows = _pick(spark, sf, TITLES)
    n = F.col("p_partkey").cast("string")
    url = (
        F.when(F.col("p_partkey") % 4 == 0, F.concat(F.lit("https://x/event/"), n))
        .when(F.col("p_partkey") % 4 == 1, F.concat(F.lit("https://x/q?a=1&rcode=R"), n, F.lit("&b=2")))
        .when(F.col("p_partkey") % 4 == 2, F.concat(F.lit("https://x/news/5/"), n, F.lit("/view")))
    )
    course = X.course_key(F.col("p_name"), F.when(F.col("p_partkey") % 3 != 0, F.lit("Spring 2026")))
    return rows.select(
        "p_partkey", course.alias("course_id"), X.assignment_key(course, F.col("t"), url).alias("assignment_id"),
        X.publisher_key("cengage", course, F.concat_ws("-", "t", "p_name")).alias("publisher_id"),
    )


def due_texts(spark, sf):
    ref = F.lit("2026-03-20 12:00:00").cast("timestamp")
    return _pick(spark, sf, DUES).select("p_partkey", stamp(X.due_flexible(F.col("t"), ref, V.TZ)).alias("due_at"))


def due_slashed(spark, sf):
    return _pick(spark, sf, SLASHED).select("p_partkey", stamp(X.due_slashed(F.col("t"), V.TZ)).alias("due_at"))


def numbers(spark, sf):
    t = F.col("t")
    a, b = X.fraction(t)
    e, p, pct = X.score(t)
    return _pick(spark, sf, NUMBERS).select(
        "p_partkey", a.alias("left_side"), b.alias("right_side"), X.percent(t).alias("pct"), e.alias("earned"), p.alias("possible"), pct.alias("score_pct"),
        X.minutes(t).alias("minutes"),
    )


def order_dates(spark, sf):
    """The dates of all orders, written in each of the forms that due texts come in, parsed back."""
    at = F.expr("cast(o_orderdate as timestamp) + make_interval(0, 0, 0, 0, 0, 360 + o_orderkey % 1000, 0)")
    forms = ("MMM d, yyyy h:mm a", "MMMM d, yyyy h:mm a", "MMM d yyyy h:mm a", "M/d/yyyy h:mma", "MM/dd/yy hh:mm a", "MMM d h:mm a", "MMM d")
    text = F.coalesce(*[F.when(F.col("o_orderkey") % len(forms) == k, F.date_format(at, f)) for k, f in enumerate(forms)])
    orders = V.table(spark, sf, "orders").select("o_orderkey", at.alias("at"), text.alias("t"))
    # the year of a text without one is that of its reference
    reference = F.to_utc_timestamp("at", V.TZ)
    return orders.select("o_orderkey", stamp(F.coalesce(X.due_flexible(F.col("t"), reference, V.TZ), X.due_slashed(F.col("t"), V.TZ))).alias("due_at"))


def line_numbers(spark, sf):
    """Numbers of all order lines written as fraction, percentage, score and minutes, parsed back."""
    n, d = F.col("l_linenumber").cast("string"), F.col("l_partkey").cast("string")
    q = F.col("l_quantity").cast("string")
    forms = (F.concat(q, F.lit(" / "), d), F.concat(q, F.lit(" %")), F.concat(q, F.lit("/"), d, F.lit(" points")), F.concat(F.lit("About "), n, F.lit("-"), d, F.lit(" minutes left")), F.concat(F.lit("--/"), d, F.lit(" Points")), F.concat(d, F.lit("% done")))
    text = F.coalesce(*[F.when((F.col("l_orderkey") + F.col("l_suppkey")) % len(forms) == k, f) for k, f in enumerate(forms)])
    t = F.col("t")
    a, b = X.fraction(t)
    e, p, pct = X.score(t)
    lines = V.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", text.alias("t"))
    return lines.select("l_orderkey", "l_linenumber", "l_suppkey", a.alias("left_side"), b.alias("right_side"), X.percent(t).alias("pct"), e.alias("earned"), p.alias("possible"), pct.alias("score_pct"), X.minutes(t).alias("minutes"))


def primary_tool(spark, sf):
    words = ("Assignments", "MindTap", "Pearson Dashboard", "eText", "Support")
    part = V.table(spark, sf, "part")
    tools = part.select(
        F.lit(1).cast("bigint").alias("student_id"), F.col("p_brand").alias("course_id"), F.col("p_partkey").alias("position"),
        F.concat_ws(" ", F.element_at(F.array(*[F.lit(w) for w in words]), (F.col("p_partkey") % 5 + 1).cast("int")), "p_name").alias("title"),
        F.col("p_type").alias("module_title"), F.concat(F.lit("https://x/"), F.col("p_size").cast("string")).alias("url"),
        F.when(F.col("p_partkey") % 7 == 0, F.lit("https://cengage.example.com/launch")).alias("launch_url"),
    )
    return N.primary_tool(tools).select("course_id", "title", "external_platform", "external_platform_url")


def _grade_rows(spark, sf):
    part = V.table(spark, sf, "part")
    return part.select(
        F.lit(1).cast("bigint").alias("student_id"), F.col("p_brand").alias("course_id"), F.col("p_partkey").alias("position"), F.col("p_name").alias("title"),
        (F.col("p_partkey") % 3 == 0).alias("is_category"), F.when(F.col("p_partkey") % 3 == 1, F.concat_ws(" ", "p_name", F.lit("x"))).when(F.col("p_partkey") % 3 == 2, F.col("p_name")).alias("category_title"),
        F.when(F.col("p_partkey") % 4 == 0, "5 / 10").alias("points_text"), F.lit(None).cast("string").alias("weight_achieved_text"),
        F.when(F.col("p_partkey") % 5 == 0, "50 %").alias("grade_text"),
    )


def usable_grade_rows(spark, sf):
    return N.usable_grade_rows(_grade_rows(spark, sf)).select("position", "course_id", "title", "is_category")


def merge_sources(spark, sf):
    events = V.table(spark, sf, "events")
    source = F.when(F.col("event_type") == "view", 0).when(F.col("event_type") == "click", 1).when(F.col("event_type") == "signup", 2).otherwise(3)
    e = F.col("event_id")
    zero = F.lit(0).cast("long")
    rows = events.select(
        F.lit(1).cast("bigint").alias("student_id"), F.concat(F.lit("c"), (F.col("user_id") % 40).cast("string")).alias("course_id"), source.alias("source"),
        F.struct(e.alias("p0"), zero.alias("p1"), zero.alias("p2")).alias("position"), F.concat(F.lit("Task "), (e % 23).cast("string")).alias("title"),
        F.concat(F.lit("id-"), e.cast("string")).alias("id"), F.when((source != 2) & (e % 3 == 0), "upcoming").otherwise("available").alias("status"),
        F.when(source.isin(1, 2) & (e % 4 != 0), F.concat(F.lit("u"), e.cast("string"))).alias("external_url"),
        F.when(source == 0, "Cat").alias("grade_category"), F.when(source == 0, F.col("value")).alias("points_earned"),
        *[F.lit(None).cast("double").alias(n) for n in ("points_possible", "weight_achieved", "weight_possible", "grade_pct")],
        F.when(source.isin(1, 3) & (e % 5 != 0), F.col("ts")).alias("due_at"), F.when(source.isin(1, 3) & (e % 6 != 0), F.concat(F.lit("d"), e.cast("string"))).alias("due_text"),
        F.create_map(F.concat(F.lit("k"), source.cast("string")), e.cast("string")).alias("raw"),
        F.concat(F.lit("task-"), (e % 23).cast("string")).alias("key"),
    )
    out = N.merge_sources(rows)
    return out.select("course_id", "key", "id", "title", "status", "external_url", "grade_category", "points_earned", stamp("due_at").alias("due_at"), "due_text",
                      F.col("raw_source.k0").alias("k0"), F.col("raw_source.k2").alias("k2"), F.col("raw_source.k3").alias("k3"), F.col("raw_source.event_due_text").alias("event_due_text"))


def carry_forward(spark, sf):
    """Events as grade-table rows: an error is a header."""
    e = V.table(spark, sf, "events")
    rows = e.select(
        F.lit(1).cast("bigint").alias("student_id"), F.col("user_id").cast("string").alias("course_id"), F.col("event_id").alias("position"),
        F.concat_ws(" ", "event_type", F.col("event_id").cast("string")).alias("title"),
        F.when(F.col("event_type") == "error", F.array(F.lit(""), F.lit("5 / 5"), F.lit("90 %"), F.lit(""))).otherwise(
            F.array(F.lit(""), F.col("value").cast("int").cast("string"), F.lit(""), F.lit("80 %"), F.lit(""))).alias("cells"),
    )
    return P.grade_table_rows(rows, block=1000).select("course_id", "position", "is_category", "category_title", "points_text", "weight_achieved_text", "grade_text")


def _documents(spark, sf):
    d = V.table(spark, sf, "documents")
    n = F.col("doc_id")
    head = F.when(n % 3 == 0, F.concat(F.lit("Quiz "), n.cast("string"), F.lit(" due MAR "), (n % 28 + 1).cast("string"), F.lit(" 11:59 PM\n"))).otherwise(F.lit(""))
    tail = F.when(n % 4 == 0, F.concat(F.lit("\nSection 3."), (n % 7).cast("string"), F.lit(" notes: - Mar 3, 2026 10:00 AM"))).when(
        n % 4 == 1, F.lit("\nNothing here Apr 4, 2026 9:00 AM")).otherwise(F.lit(""))
    return d.select(
        F.lit(1).cast("bigint").alias("student_id"), F.col("source").alias("course_id"), n.alias("position"), n.cast("string").alias("id"),
        F.concat(head, "text", tail).alias("extracted_text"), "text", "lang",
        F.when(n % 3 == 0, "outline").otherwise("syllabus").alias("kind"), F.concat(F.lit("Topic "), (n % 4).cast("string")).alias("title"),
        F.when(n % 2 == 0, "Late work").otherwise("Other").alias("module_title"),
    )


def outline_assignments(spark, sf):
    rows = N.outline_assignments(_documents(spark, sf), keys=["course_id", "position"])
    return rows.select("position", "title", "due_text")


def compose_syllabus(spark, sf):
    topics = _documents(spark, sf).withColumn("extracted_text", F.col("text"))
    return N.syllabus_digests(N.syllabus_parts(topics)).select("course_id", "n_chars", "text_md5")


def syllabus_parts(spark, sf):
    topics = _documents(spark, sf).withColumn("extracted_text", F.col("text"))
    return N.syllabus_parts(topics).select("course_id", "position", "n_chars", "part_md5")


def _chunks(spark, sf):
    docs = _documents(spark, sf).withColumn("size", E.artifact_size(F.col("text")))
    return docs, E.pack_chunks(docs, max_chars=E.ASSIGNMENT_CHUNK, block=200)


def pack_chunks(spark, sf):
    return _chunks(spark, sf)[1].select("course_id", "position", "chunk")


def build_prompts(spark, sf):
    docs, numbers = _chunks(spark, sf)
    chunks = docs.join(numbers, ["student_id", "course_id", "position"]).withColumns(
        {
            "source_platform": F.lit("d2l"), "page_kind": F.col("lang"), "url": F.lit("u"), "parent_url": F.lit(None).cast("string"), "score_text": F.lit(None).cast("string"),
            "course_code": F.col("course_id"), "course_name": F.lit("Course"),
        }
    )
    prompts = E.build_prompts(chunks, "Find the assignments.")
    return prompts.select("course_id", "chunk", F.size("artifact_ids").alias("n"), F.length("prompt").alias("n_chars"), F.md5(F.encode("prompt", "UTF-8")).alias("prompt_md5"))


def select_artifacts(spark, sf):
    kinds = ("tool_grades", "course_home", "syllabus_topic", "external_course_page", "other")
    docs = _documents(spark, sf).withColumn("page_kind", F.element_at(F.array(*[F.lit(k) for k in kinds]), (F.col("position") % 5 + 1).cast("int")))
    a = E.select_artifacts(docs, E.ASSIGNMENT_KINDS).select("position", F.lit("assignments").alias("purpose"))
    return a.unionByName(E.select_artifacts(docs, E.RULE_KINDS).select("position", F.lit("rules").alias("purpose")))


def course_manifest(spark, sf):
    from termloom.sources.snapshots import course_manifest as manifest

    docs = _documents(spark, sf)
    courses = docs.groupBy("student_id", "course_id").agg(F.min("position").alias("position"))
    return manifest(courses, docs.select("student_id", "course_id", "id"), limit=7).select("course_id", "artifact_count")


FACT_COLUMNS = {
    "student_id": "cast(1 as bigint)", "course_id": "'c' || cast(user_id % 20 as {s})", "position": "event_id",
    "title": "case event_id % 4 when 0 then 'Quiz ' when 1 then 'Homework ' when 2 then 'lab ' else 'Project  ' end || cast(user_id % 5 as {s}) || case when event_id % 3 = 0 then ' : Unit 2' else '' end",
    "assignment_type": "case when event_id % 5 = 0 then 'exam' end",
    "source_platform": "case event_type when 'view' then 'd2l' when 'click' then 'pearson_mylab' when 'signup' then 'cengage_mindtap' end",
    "grade_category": "case when event_id % 60 = 0 then 'Homework' end",
    "due_at": "case when event_id % 37 = 0 then '2024-01-0' || cast(event_id % 9 + 1 as {s}) || 'T10:00:00Z' end",
    "due_on": "case when event_id % 41 = 1 then '2024-02-0' || cast(event_id % 9 + 1 as {s}) end",
    "due_text": "case when event_id % 11 = 1 then 'text ' || cast(event_id % 3 as {s}) end",
    "weight_pct": "case when event_id % 50 = 0 then cast(10.0 as double) end",
    "points_possible": "case when event_id % 13 = 1 then cast(100.0 as double) end",
    "points_earned": "case when event_id % 19 = 2 then cast(50.0 as double) end",
    "grade_pct": "case when event_id % 17 = 2 then cast(event_id % 90 + 5 as double) end",
    "submitted": "case when event_id % 15 = 1 then true when event_id % 15 = 2 then false end",
    "graded": "case when event_id % 6 = 1 then true when event_id % 6 = 2 then false end",
    "optional": "case when event_id % 997 = 0 then true end", "extra_credit": "case when event_id % 701 = 0 then true end",
    "counts_toward_grade": "case when event_id % 503 = 0 then false when event_id % 2 = 0 then true end",
    "status": "case event_type when 'purchase' then 'overdue' when 'view' then 'custom' when 'click' then 'available' end",
    "rationale": "case when event_id % 7 = 3 then 'because ' || cast(event_id as {s}) end",
}


def _facts(spark, sf):
    e = V.table(spark, sf, "events")
    n = lambda m: (F.col("event_id") % m).cast("string")
    a = lambda m: F.concat(F.lit("a"), n(m))
    return e.selectExpr(*[f"{x.format(s='string')} as {c}" for c, x in FACT_COLUMNS.items()], "event_id").withColumns(
        {
            "evidence_artifact_ids": F.array(a(7), a(5)), "notes": F.array(F.concat(F.lit(" n"), n(3), F.lit(" ")), F.lit("")),
            "evidence_spans": F.array(F.struct(a(4).alias("artifact_id"), F.concat(F.lit(" q"), n(6)).alias("quote")), F.struct(F.lit(" ").alias("artifact_id"), F.lit("x").alias("quote"))),
        }
    ).drop("event_id")


def consolidate_facts(spark, sf):
    out = E.consolidate_facts(_facts(spark, sf)).withColumn("source_platforms", F.array_join("source_platforms", ","))
    return out.drop("student_id")


def fact_notes(spark, sf):
    return E.fact_notes(_facts(spark, sf)).select("course_id", "fact_key", "note", F.col("first_at.position").alias("position"))


def fact_evidence(spark, sf):
    return E.fact_evidence(_facts(spark, sf)).select("course_id", "fact_key", "artifact_id", "quote", F.col("first_at.position").alias("position"))


def fact_artifacts(spark, sf):
    return E.fact_artifacts(_facts(spark, sf)).drop("student_id")


def dedupe(spark, sf):
    words = F.split("text", "[\n.]")
    return V.table(spark, sf, "documents").select("doc_id", F.size(E.dedupe_strings(words)).alias("n"), F.md5(F.encode(F.array_join(E.dedupe_strings(words), "|"), "UTF-8")).alias("joined_md5"))


def _rules(spark, sf):
    e = V.table(spark, sf, "events")
    n = F.col("event_id")
    name = F.element_at(F.array(F.lit("Homework"), F.lit("HOMEWORK !"), F.lit("Exams"), F.lit("Lab Work"), F.lit("--")), (n % 5 + 1).cast("int"))
    cat = F.struct(name.alias("name"), F.when(n % 3 == 0, (n % 10).cast("double") / 10).alias("weight"), F.when(n % 4 == 0, F.concat(F.lit("note "), n.cast("string"))).otherwise("").alias("notes"))
    policy = F.when(n % 13 == 0, F.struct(F.concat(F.lit("late "), n.cast("string")).alias("raw_text"), F.lit(True).alias("accepts_late"), F.lit(0.1).alias("default_penalty_per_day"), F.lit(2).alias("max_late_days")))
    return e.select(
        F.lit(1).cast("bigint").alias("student_id"), F.concat(F.lit("c"), (F.col("user_id") % 30).cast("string")).alias("course_id"), n.alias("position"),
        F.when(n % 9 == 0, F.concat(F.lit("C"), n.cast("string"))).otherwise("").alias("course_code"), F.lit(None).cast("string").alias("course_name"),
        F.array(cat).alias("grade_categories"), F.when(n % 11 == 0, F.create_map(F.lit("A"), F.array((n % 7).cast("double")))).alias("grading_scale"),
        policy.alias("late_policy"), F.array(F.concat(F.lit("note "), (n % 3).cast("string"))).alias("notes"),
    )


def merge_rules(spark, sf):
    out = E.merge_rules(_rules(spark, sf))
    each = F.transform("grade_categories", lambda c: F.concat_ws(":", c["name"], c["weight"].cast("string"), c["notes"]))
    return out.select("course_id", "course_code", F.array_join(each, "; ").alias("categories"), F.element_at("grading_scale", "A")[0].alias("scale_a"), F.col("late_policy.raw_text").alias("late"))


def rule_notes(spark, sf):
    return E.rule_notes(_rules(spark, sf)).select("course_id", "note", F.col("first_at.position").alias("position"))


CATEGORIES = (("Homework", 0.3), ("Exams", 0.4), ("Labs", 0.2), ("Other", 0.1))


def extracted_grade(spark, sf):
    from datetime import UTC, datetime

    facts = E.consolidate_facts(_facts(spark, sf))
    cats = facts.select("student_id", "course_id").distinct().where("course_id <> 'c3'").select(
        "student_id", "course_id", F.posexplode(F.array(*[F.struct(F.lit(n).alias("name"), F.lit(w).alias("weight")) for n, w in CATEGORIES])).alias("position", "c")
    ).select("student_id", "course_id", "position", "c.name", "c.weight")
    return E.extracted_grade(facts, cats, tz=V.TZ, now=datetime(2024, 1, 20, tzinfo=UTC)).drop("student_id")


def _merged_runs(spark, sf):
    """Two runs: courses and their audit events, one event per row of `events`."""
    e = V.table(spark, sf, "events").withColumns({"student_id": F.lit(1).cast("bigint"), "course_id": F.col("user_id").cast("string")})

    def run(rows, number, mark):
        rows = rows.withColumn("run", F.lit(number))
        courses = rows.groupBy("student_id", "course_id", "run").agg(F.count(F.lit(1)).alias("artifact_count")).withColumn("course_code", F.lit(mark))
        return {"courses": courses, "events": rows.select("student_id", "course_id", "run", F.col("event_id").alias("position"), "event_type")}

    return E.merge_extractions(run(e.where("user_id % 3 <> 0"), 1, "old"), run(e.where("user_id % 2 = 0"), 2, "new"))


def merge_extractions(spark, sf):
    merged = _merged_runs(spark, sf)
    counts = merged["events"].groupBy("student_id", "course_id").agg(F.count(F.lit(1)).alias("events"))
    return merged["courses"].join(counts, ["student_id", "course_id"]).select("course_id", "course_code", "artifact_count", "events")


def extraction_events(spark, sf):
    return E.course_events(_merged_runs(spark, sf)["events"]).select("course_id", "run", "position", "event_type", "at")


def _responses(spark, sf):
    n = F.col("event_id")
    item = F.concat(F.lit('{"title": "T'), n.cast("string"), F.lit('", "points_possible": 5, "evidence_spans": [{"artifact_id": "a", "quote": "q"}]}'))
    body = F.when(n % 5 == 0, '{"assignments": null}').otherwise(F.concat(F.lit('{"assignments": ['), item, F.when(n % 3 == 0, F.concat(F.lit(", "), item)).otherwise(""), F.lit("]}")))
    text = F.when(n % 7 == 0, "sorry").when(n % 2 == 0, F.concat(F.lit("```json\n"), body, F.lit("\n```"))).otherwise(F.concat(F.lit("Here: "), body))
    return V.table(spark, sf, "events").select(
        F.lit(1).cast("bigint").alias("student_id"), F.col("user_id").cast("string").alias("course_id"), n.alias("chunk"), F.lit("").alias("part"),
        F.array(n.cast("string")).alias("artifact_ids"), text.alias("response"),
    )


def parse_model_json(spark, sf):
    out = P.parse_model_json(_responses(spark, sf), schemas.FACTS_RESPONSE)
    facts = F.col("parsed.assignments")
    return out.select("chunk", "error", F.coalesce(F.size(facts), F.lit(0)).alias("n"), F.get(facts, F.lit(0))["title"].alias("title")).withColumn("n", F.greatest("n", F.lit(0)))


def extraction_log(spark, sf):
    parsed = P.parse_model_json(_responses(spark, sf), schemas.FACTS_RESPONSE)
    log = E.extraction_log(parsed, stage="extract_assignments")
    return log.select("chunk", "stage", F.get_json_object("detail", "$.assignment_count").cast("int").alias("n"), F.get_json_object("detail", "$.sample_titles[0]").alias("title"),
                      F.get_json_object("detail", "$.assignment_evidence[0].evidence_spans[0].quote").alias("quote"))


def review_flags(spark, sf):
    courses = V.courses(spark, sf)
    flags = P.review_flags(F.coalesce("grade_categories", F.array().cast(schemas.CATEGORIES)), F.col("name"), F.col("grading_scale"))
    return courses.select("student_id", "course_id", F.array_join(flags, "; ").alias("flags"))


def pending_syllabi(spark, sf):
    courses = V.courses(spark, sf).withColumn("last_syllabus_parse", F.when(F.col("parsed"), F.lit("1998-01-01").cast("timestamp")))
    return P.pending_syllabi(courses).select("student_id", "course_id")


DOC_SQL = r"""select source as course_id, doc_id as position, text, doc_id % 3 = 0 as outline, 'Topic ' || doc_id % 4 as title,
  case when doc_id % 2 = 0 then 'Late work' else 'Other' end as module_title, case when doc_id % 3 = 0 then 'Quiz ' || doc_id || ' due MAR ' || (doc_id % 28 + 1) || ' 11:59 PM' || chr(10) else '' end
  || text || case doc_id % 4 when 0 then chr(10) || 'Section 3.' || doc_id % 7 || ' notes: - Mar 3, 2026 10:00 AM' when 1 then chr(10) || 'Nothing here Apr 4, 2026 9:00 AM' else '' end as long_text, lang from documents"""
PACKED = r"""recursive d as (select source as course_id, doc_id as position, text, lang, coalesce(length(text), 0) + 400 as size,
  row_number() over (partition by source order by doc_id) as n from documents),
  w as (select course_id, n, position, size as filled, cast(1 as bigint) as chunk from d where n = 1 union all
    select d.course_id, d.n, d.position, case when w.filled + d.size > 12000 then d.size else w.filled + d.size end,
      case when w.filled + d.size > 12000 then w.chunk + 1 else w.chunk end from w join d on d.course_id = w.course_id and d.n = w.n + 1)"""
FACTS_SQL = "select " + ", ".join(f"{x.format(s='varchar')} as {c}" for c, x in FACT_COLUMNS.items()) + ", event_id from events"
FACT_KEY = r"""coalesce(nullif(trim(regexp_replace(regexp_replace(trim(regexp_replace(lower(title), '\s+', ' ', 'g')), '\s*:\s*unit.*$', ''), '[^a-z0-9]+', '-', 'g'), '-'), ''), 'item')"""
FACTS_CTE = f"with f as (select *, {FACT_KEY} as fact_key from ({FACTS_SQL}))"
CONSOLIDATED = """select course_id, fact_key, arg_min(title, (length(title), lower(title), position)) as title,
  arg_min(assignment_type, position) filter (where assignment_type is not null) as assignment_type,
  coalesce(string_agg(distinct source_platform, ',' order by source_platform), '') as source_platforms,
  arg_min(grade_category, position) filter (where grade_category is not null) as grade_category,
  arg_min({'v': due_at}, (case when source_platform = 'd2l' then 0 else 1 end, position)) filter (where due_at is not null or due_on is not null)['v'] as due_at,
  arg_min({'v': due_on}, (case when source_platform = 'd2l' then 0 else 1 end, position)) filter (where due_at is not null or due_on is not null)['v'] as due_on,
  case when bool_or(due_at is not null or due_on is not null)
    then arg_min({'v': due_text}, (case when source_platform = 'd2l' then 0 else 1 end, position)) filter (where due_at is not null or due_on is not null)['v']
    else arg_min(due_text, position) filter (where due_text is not null) end as due_text,
  arg_min(weight_pct, position) filter (where weight_pct is not null) as weight_pct,
  coalesce(arg_min({'v': points_possible}, (case when grade_pct is not null or points_earned is not null then 0 else 1 end, -coalesce(grade_pct, -1), position))['v'],
    arg_min(points_possible, position) filter (where points_possible is not null)) as points_possible,
  coalesce(arg_min({'v': points_earned}, (case when grade_pct is not null or points_earned is not null then 0 else 1 end, -coalesce(grade_pct, -1), position))['v'],
    arg_min(points_earned, position) filter (where points_earned is not null)) as points_earned, max(grade_pct) as grade_pct,
  bool_or(submitted) as submitted, bool_or(graded) as graded, bool_or(coalesce(optional, false)) as optional, bool_or(coalesce(extra_credit, false)) as extra_credit,
  not bool_or(coalesce(not counts_toward_grade, false) or coalesce(extra_credit, false) or coalesce(optional, false)) as counts_toward_grade,
  case when bool_or(status = 'overdue') then 'overdue' when bool_or(status = 'available') then 'available' else arg_min(status, position) filter (where status is not null) end as status,
  arg_min(rationale, position) filter (where rationale is not null) as rationale, 'a' || min(least(event_id % 7, event_id % 5)) as first_artifact_id, count(*) as fact_count
  from f where fact_key <> 'item' group by course_id, fact_key"""
RULES_SQL = """select 'c' || user_id % 30 as course_id, event_id as position, (['Homework', 'HOMEWORK !', 'Exams', 'Lab Work', '--'])[event_id % 5 + 1] as name,
  case when event_id % 3 = 0 then (event_id % 10)::double / 10 end as weight, case when event_id % 4 = 0 then 'note ' || event_id end as notes,
  case when event_id % 9 = 0 then 'C' || event_id end as code, case when event_id % 11 = 0 then (event_id % 7)::double end as a,
  case when event_id % 13 = 0 then 'late ' || event_id end as late from events"""
GRADE_SQL = f"""{FACTS_CTE}, k as ({CONSOLIDATED}),
  g as (select *, lower(coalesce(assignment_type, '') || ' ' || title) as hay, nullif(trim(regexp_replace(lower(grade_category), '[^a-z0-9]+', '-', 'g'), '-'), '') as own,
    case when grade_pct is not null then coalesce(nullif(points_possible, 0), 1.0) end as u, case when grade_pct is not null then nullif(weight_pct, 0) end as w,
    coalesce(try_cast(replace(replace(due_at, 'T', ' '), 'Z', '') as timestamp), timezone('UTC', timezone('America/Chicago', try_cast(due_on || ' 23:59:00' as timestamp)))) as due from k
    where not optional and not extra_credit and counts_toward_grade and not (coalesce(submitted, false) and not coalesce(graded, false))
      and not (coalesce(grade_pct <= 0, false) or coalesce(points_earned <= 0 and points_possible > 0, false)) and (grade_pct is not null or points_earned is not null)),
  n as (select * from g where not coalesce(due > timestamp '2024-01-20 00:00:00', false)),
  c as (select kk.course_id, key, weight from (select distinct course_id from k) kk cross join (values ('homework', 0.3::double), ('exams', 0.4::double), ('labs', 0.2::double), ('other', 0.1::double)) v(key, weight)
    where kk.course_id <> 'c3' and not exists (select 1 from n where n.course_id = kk.course_id and n.w is not null and n.own = v.key)),
  m as (select c.course_id, key, weight, cast(sum(cast(grade_pct * u as decimal(28, 8))) as double) / cast(sum(cast(u as decimal(28, 8))) as double) as mean from c join n on n.course_id = c.course_id
    and n.u is not null and case when coalesce(n.grade_category, '') <> '' then n.own = c.key when c.key = 'homework' then regexp_matches(hay, 'homework|exercise|assignment')
    when c.key = 'exams' then regexp_matches(hay, 'quiz|test|exam') when c.key = 'labs' then contains(hay, 'lab') else false end group by all),
  t as (select x.course_id, coalesce(ip, 0) + coalesce(cp, 0) as num, coalesce(iw, 0) + coalesce(cw, 0) as den, pp / pu as plain, nn from (select distinct course_id from k) x
    left join (select course_id, cast(sum(cast(w * (grade_pct / 100) as decimal(28, 8))) as double) as ip, cast(sum(cast(w as decimal(28, 8))) as double) as iw,
      cast(sum(cast(grade_pct * u as decimal(28, 8))) as double) as pp, cast(sum(cast(u as decimal(28, 8))) as double) as pu, count(*) as nn from n group by all) i using (course_id)
    left join (select course_id, cast(sum(cast(weight * (mean / 100) as decimal(28, 8))) as double) as cp, cast(sum(cast(weight as decimal(28, 8))) as double) as cw from m group by all) b using (course_id))
  select course_id, cast(round(cast(case when den > 0 then num / den * 100 else plain end as decimal(28, 8)), 2) as double) as current_grade_pct,
    case when den > 0 then 'Calculated from graded assignments that are already due.' when plain is not null
      then 'Used straight average because no usable category or item weights were found.' when nn > 0 then 'No graded coursework available for calculation.'
      else 'No due and graded coursework available for calculation.' end as note from t"""
SLUG = lambda x: f"coalesce(nullif(trim(regexp_replace(lower({x}), '[^a-z0-9]+', '-', 'g'), '-'), ''), 'item')"
PE = r"'programming-exercise-' || replace(nullif(regexp_extract(title, 'programming\s+exercise\s+(\d+(?:\.\d+)?)', 1, 'i'), ''), '.', '-')"

QUERIES = {
    "order_dates": (
        order_dates,
        """select o_orderkey, strftime(timezone('UTC', timezone('America/Chicago', case o_orderkey % 7 when 6 then cast(cast(o_orderdate as date) as timestamp) + interval 1439 minute
          else cast(o_orderdate as timestamp) + to_minutes(360 + o_orderkey % 1000) end)), '%Y-%m-%d %H:%M:%S') as due_at from orders""",
    ),
    "line_numbers": (
        line_numbers,
        """with l as (select *, (l_orderkey + l_suppkey) % 6 as f, l_partkey::double as d, l_quantity::double as q from lineitem)
          select l_orderkey, l_linenumber, l_suppkey, case f when 0 then q end as left_side, case f when 0 then d end as right_side, case f when 1 then q end as pct, case f when 2 then q end as earned,
          case when f in (2, 4) then d end as possible, case f when 2 then round(q / nullif(d, 0) * 100, 2) when 5 then d end as score_pct, case f when 3 then cast(round_even((l_linenumber + l_partkey) / 2, 0) as int) end as minutes from l""",
    ),
    "match_keys": (
        match_keys,
        "with src as (select p_partkey, p_name || ' ' || (" + TITLES_SQL + f")[p_partkey % {len(TITLES)} + 1] as title from part), "
        + ", ".join(f"{n} as ({q})" for n, q in display_ctes("src"))
        + rf"""select p_partkey, shown, match_key as canonical_key, coalesce({PE}, {SLUG("regexp_replace(trim(lower(title)), '(?: - due| due| in class)$', '')")}) as snapshot_key,
          {FACT_KEY} as fact_key, nullif(trim(regexp_replace(lower(title), '[^a-z0-9]+', '-', 'g'), '-'), '') as name_key from k5""",
    ),
    "infer_type_status": (
        inference,
        f"""select p_partkey, case when regexp_matches(t, 'quiz|exam|test') then 'exam' when contains(t, 'lab') then 'lab' when contains(t, 'discussion') then 'discussion'
          when contains(t, 'project') then 'project' when contains(t, 'reading') then 'reading' else 'homework' end as type,
          case when contains(t, 'quiz') then 'exam' when regexp_matches(t, 'lab|programming exercise') then 'lab' when contains(t, 'discussion') then 'discussion'
          when contains(t, 'project') then 'project' when contains(t, 'reading') then 'reading' when regexp_matches(t, 'exam|test') then 'exam' else 'homework' end as fact_type,
          case when contains(t, 'in class') then 'available' when contains(t, 'due') then 'upcoming' else 'available' end as status,
          case when regexp_matches(t, 'cengage|mindtap') then 'cengage_mindtap' when regexp_matches(t, 'pearson|mastering|mylab') then 'pearson_mylab' end as platform
          from (select p_partkey, lower(({TITLES_SQL})[p_partkey % {len(TITLES)} + 1] || ' ' || p_name) as t from part)""",
    ),
    "stable_ids": (
        stable_ids,
        rf"""select p_partkey, c as course_id, c || '-' || case p_partkey % 4 when 0 then cast(p_partkey as varchar) when 1 then 'R' || p_partkey when 2 then cast(p_partkey as varchar)
          else coalesce({PE}, {SLUG("regexp_replace(trim(lower(title)), '(?: - due| due| in class)$', '')")}) end as assignment_id,
          'cengage-' || c || '-' || substr({SLUG("title || '-' || p_name")}, 1, 20) || '-' || substr(sha1(title || '-' || p_name), 1, 8) as publisher_id from (select p_partkey, p_name,
          ({TITLES_SQL})[p_partkey % {len(TITLES)} + 1] as title, {SLUG('p_name')} || '-' || case when p_partkey % 3 <> 0 then 'spring-2026' else 'unknown-term' end as c from part)""",
    ),
    "parse_due": (
        due_texts,
        f"""select p_partkey, strftime(timezone('UTC', timezone('America/Chicago', coalesce(try_strptime('2026 ' || case when len(string_split(t, ' ')) = 2 then t || ' 11:59 PM' else t end, '%Y %b %d %I:%M %p'),
          try_strptime(t, '%b %d, %Y %I:%M %p'), try_strptime(t, '%B %d, %Y %I:%M %p'), try_strptime(t, '%b %d %Y %I:%M %p')))), '%Y-%m-%d %H:%M:%S') as due_at
          from (select p_partkey, ({DUES_SQL})[p_partkey % {len(DUES)} + 1] as t from part)""",
    ),
    "parse_due_slashed": (
        due_slashed,
        f"""select p_partkey, strftime(timezone('UTC', timezone('America/Chicago', coalesce(try_strptime(t, '%m/%d/%Y %I:%M %p'), try_strptime(t, '%m/%d/%y %I:%M%p')))), '%Y-%m-%d %H:%M:%S') as due_at
          from (select p_partkey, upper(({SLASHED_SQL})[p_partkey % {len(SLASHED)} + 1]) as t from part)""",
    ),
    "parse_numbers": (
        numbers,
        rf"""select p_partkey, case when r is not null then l end as left_side, case when l is not null then r end as right_side, try_cast(trim(replace(t, '%', '')) as double) as pct,
          try_cast(regexp_extract(t, '(--|\d+(?:\.\d+)?)\s*/\s*(\d+(?:\.\d+)?)\s*points?', 1, 'i') as double) as earned, p as possible,
          case when p is not null then round(try_cast(regexp_extract(t, '(--|\d+(?:\.\d+)?)\s*/\s*(\d+(?:\.\d+)?)\s*points?', 1, 'i') as double) / p * 100, 2)
            else try_cast(regexp_extract(t, '(\d+(?:\.\d+)?)%', 1) as double) end as score_pct,
          case when lo is not null then cast(round_even((lo + coalesce(hi, lo)) / 2.0, 0) as int) end as minutes
          from (select *, try_cast(trim(split_part(t, '/', 1)) as double) as l, case when contains(t, '/') then try_cast(trim(split_part(t, '/', 2)) as double) end as r,
            try_cast(regexp_extract(t, '(--|\d+(?:\.\d+)?)\s*/\s*(\d+(?:\.\d+)?)\s*points?', 2, 'i') as double) as p,
            try_cast(regexp_extract(t, 'about\s+(\d+)(?:-(\d+))?\s+minutes', 1) as int) as lo, try_cast(regexp_extract(t, 'about\s+(\d+)(?:-(\d+))?\s+minutes', 2) as int) as hi
          from (select p_partkey, ({NUMBERS_SQL})[p_partkey % {len(NUMBERS)} + 1] as t from part))""",
    ),
    "primary_tool": (
        primary_tool,
        """select course_id, title, case when regexp_matches(hay, 'cengage|mindtap') then 'cengage_mindtap' when regexp_matches(hay, 'pearson|mastering|mylab') then 'pearson_mylab' end as external_platform,
          coalesce(launch_url, url) as external_platform_url from (select *, row_number() over (partition by course_id order by case when contains(hay, 'assignment') then 4 else 0 end
          + case when regexp_matches(hay, 'mindtap|mastering') then 3 else 0 end + case when regexp_matches(hay, 'pearson|cengage') then 2 else 0 end
          - case when regexp_matches(hay, 'dashboard|support') then 2 else 0 end - case when contains(hay, 'etext') then 1 else 0 end desc, length(title), p_partkey) as n
          from (select *, lower(p_type || ' ' || title || ' ' || coalesce(launch_url, '') || ' ' || url) as hay from (select p_partkey, p_brand as course_id, p_type,
            (['Assignments', 'MindTap', 'Pearson Dashboard', 'eText', 'Support'])[p_partkey % 5 + 1] || ' ' || p_name as title, 'https://x/' || p_size as url,
            case when p_partkey % 7 = 0 then 'https://cengage.example.com/launch' end as launch_url from part))) where n = 1""",
    ),
    "usable_grade_rows": (
        usable_grade_rows,
        """with g as (select p_partkey as position, p_brand as course_id, p_name as title, p_partkey % 3 = 0 as is_category,
          case p_partkey % 3 when 1 then p_name || ' x' when 2 then p_name end as category_title, p_partkey % 4 = 0 or p_partkey % 5 = 0 as valued from part)
          select position, course_id, title, is_category from g where not is_category or (valued and not exists (select 1 from g c where c.course_id = g.course_id
            and not c.is_category and c.category_title = g.title))""",
    ),
    "merge_sources": (
        merge_sources,
        """with s as (select 'c' || user_id % 40 as course_id, 'task-' || event_id % 23 as key, 'Task ' || event_id % 23 as title, event_id as e, value, ts,
            case event_type when 'view' then 0 when 'click' then 1 when 'signup' then 2 else 3 end as src from events),
          t as (select *, 'id-' || e as id, case when src <> 2 and e % 3 = 0 then 'upcoming' else 'available' end as st, case when src in (1, 2) and e % 4 <> 0 then 'u' || e end as url,
            case when src in (1, 3) and e % 5 <> 0 then ts end as due, case when src in (1, 3) and e % 6 <> 0 then 'd' || e end as dt from s),
          b as (select course_id, key, arg_max(e, e) filter (where src = 0) as g, arg_min(e, (src, e)) filter (where src > 0) as o, max(e) filter (where src = 1) as le, count(*) filter (where src = 1) as ne,
            arg_min(url, e) filter (where src = 1 and url is not null) as eu, arg_min(due, (src, e)) filter (where due is not null) as due_at, arg_min(dt, (src, e)) filter (where dt is not null) as due_text,
            bool_or(src in (1, 3) and st = 'upcoming') as up, max(e) filter (where src = 2) as k2, max(e) filter (where src = 3) as k3, any_value(title) as title from t group by all)
          select b.course_id, b.key, 'id-' || coalesce(le, coalesce(g, o)) as id, b.title, case when coalesce(up, false) then 'upcoming' else x.st end as status,
            coalesce(eu, case when g is null and ne = 0 and x.src = 2 then x.url end) as external_url, case when g is not null then 'Cat' end as grade_category, case when g is not null then x.value end as points_earned,
            strftime(due_at, '%Y-%m-%d %H:%M:%S') as due_at, due_text, cast(g as varchar) as k0, cast(k2 as varchar) as k2, cast(k3 as varchar) as k3,
            case when ne > 1 or (ne > 0 and g is not null) then case when le % 6 <> 0 then 'd' || le end end as event_due_text from b join t x on x.e = coalesce(g, o)""",
    ),
    "grade_table_rows": (
        carry_forward,
        """select cast(user_id as varchar) as course_id, event_id as position, event_type = 'error' as is_category, case when event_type <> 'error' then
          last_value(case when event_type = 'error' then 'error ' || event_id end ignore nulls) over (partition by user_id order by event_id) end as category_title,
          case when event_type <> 'error' then cast(cast(trunc(value) as int) as varchar) end as points_text, case when event_type = 'error' then '5 / 5' end as weight_achieved_text,
          case when event_type = 'error' then '90 %' else '80 %' end as grade_text from events""",
    ),
    "outline_assignments": (
        outline_assignments,
        rf"""select position, title, due_text from (select position, trim(regexp_replace(trim(left(line, strpos(line, due_text) - 1)), '\s+[Dd]ue\s*$', ''), ' :-|') as title, due_text from (select position, line,
          coalesce(nullif(regexp_extract(line, '((?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)[a-z]*\s+\d{{1,2}},?\s+\d{{4}}\s+\d{{1,2}}:\d{{2}}\s*(?:AM|PM))', 1, 'i'), ''),
            nullif(regexp_extract(line, '\b((?:JAN|FEB|MAR|APR|MAY|JUN|JUL|AUG|SEP|OCT|NOV|DEC)\s+\d{{1,2}}\s+\d{{1,2}}:\d{{2}}\s*(?:AM|PM))\b', 1), '')) as due_text
          from (select position, trim(regexp_replace(unnest(string_split(long_text, chr(10))), '\s+', ' ', 'g')) as line from ({DOC_SQL})) where length(line) >= 8) where due_text is not null)
          where length(title) >= 4 and (regexp_matches(lower(title), '{N.OUTLINE_WORDS}') or regexp_matches(title, '\d+\.\d+'))""",
    ),
    "compose_syllabus": (
        compose_syllabus,
        rf"""with t as (select course_id, position, regexp_replace(text, '^\s+|\s+$', '', 'g') as body, case when outline then '[' || module_title || ': ' || title || ']' else '[' || title || ']' end || chr(10) as heading
            from ({DOC_SQL}) where not outline or regexp_matches(title || ' ' || module_title, 'late\s*work|syllabus|grading|attendance', 'i')),
          u as (select course_id, min(position) as position, arg_min(heading || body, position) as part from t where body <> '' group by course_id, sha256(body)),
          j as (select course_id, string_agg(part, chr(10) || chr(10) || '---' || chr(10) || chr(10) order by position) as txt from u group by all)
          select course_id, length(txt) as n_chars, md5(txt) as text_md5 from j""",
    ),
    "syllabus_parts": (
        syllabus_parts,
        rf"""with t as (select course_id, position, regexp_replace(text, '^\s+|\s+$', '', 'g') as body, case when outline then '[' || module_title || ': ' || title || ']' else '[' || title || ']' end || chr(10) as heading
            from ({DOC_SQL}) where not outline or regexp_matches(title || ' ' || module_title, 'late\s*work|syllabus|grading|attendance', 'i')),
          u as (select course_id, min(position) as position, arg_min(heading || body, position) as part from t where body <> '' group by course_id, sha256(body))
          select course_id, position, length(part) as n_chars, md5(part) as part_md5 from u""",
    ),
    "pack_chunks": (pack_chunks, f"with {PACKED} select course_id, position, chunk from w"),
    "build_prompts": (
        build_prompts,
        rf"""with {PACKED} select course_id, chunk, cast(n as int) as n, length(prompt) as n_chars, md5(prompt) as prompt_md5 from (select course_id, chunk, count(*) as n,
          'Find the assignments.' || chr(10) || chr(10) || 'COURSE: ' || course_id || ' - Course' || chr(10) || chr(10) || 'ARTIFACTS:' || chr(10)
          || string_agg(body, chr(10) || chr(10) order by position) as prompt from (select w.course_id, w.chunk, w.position, regexp_replace('artifact_id: ' || w.position || chr(10)
          || 'source_platform: d2l' || chr(10) || 'page_kind: ' || lang || chr(10) || 'title: Topic ' || w.position % 4 || chr(10) || 'url: u' || chr(10) || 'parent_url: ' || chr(10)
          || 'text:' || chr(10) || text, '\s+$', '') as body from w join d using (course_id, position)) group by course_id, chunk)""",
    ),
    "select_artifacts": (
        select_artifacts,
        """select doc_id as position, p as purpose from (select doc_id, unnest(case doc_id % 5 when 0 then ['assignments', 'rules'] when 1 then ['assignments', 'rules']
          when 2 then ['rules'] when 3 then ['assignments'] else [] end) as p from documents)""",
    ),
    "course_manifest": (
        course_manifest,
        "select course_id, artifact_count from (select source as course_id, count(*) as artifact_count, row_number() over (order by min(doc_id)) as n from documents group by 1) where n <= 7",
    ),
    "consolidate_facts": (consolidate_facts, f"{FACTS_CTE} {CONSOLIDATED}"),
    "fact_notes": (fact_notes, f"{FACTS_CTE} select course_id, fact_key, 'n' || event_id % 3 as note, min(position) as position from f group by all"),
    "fact_evidence": (
        fact_evidence, f"{FACTS_CTE} select course_id, fact_key, 'a' || event_id % 4 as artifact_id, 'q' || event_id % 6 as quote, min(position) as position from f group by all",
    ),
    "fact_artifacts": (fact_artifacts, f"{FACTS_CTE} select distinct course_id, fact_key, 'a' || unnest([event_id % 7, event_id % 5]) as artifact_id from f"),
    "dedupe_strings": (
        dedupe,
        r"""select doc_id, coalesce(n, 0) as n, md5(coalesce(j, '')) as joined_md5 from documents left join (select doc_id, cast(count(*) as int) as n, string_agg(v, '|' order by i) as j from (select doc_id, v, min(i) as i
          from (select doc_id, unnest(range(1, len(vs) + 1)) as i, trim(unnest(vs)) as v from (select doc_id, regexp_split_to_array(text, '[\n.]') as vs from documents)) where v <> '' group by all) group by all) using (doc_id)""",
    ),
    "merge_rules": (
        merge_rules,
        f"""with r as ({RULES_SQL}), c as (select course_id, arg_min(name, (length(name), position)) as name, arg_min(weight, position) filter (where weight is not null) as weight,
            arg_min(notes, position) filter (where notes is not null) as notes from (select *, trim(regexp_replace(lower(name), '[^a-z0-9]+', '-', 'g'), '-') as key from r) where key <> '' group by course_id, key)
          select course_id, code as course_code, coalesce(cats, '') as categories, a as scale_a, late from (select course_id, arg_min(code, position) filter (where code is not null) as code,
            arg_min(a, position) filter (where a is not null) as a, arg_min(late, position) filter (where late is not null) as late from r group by all)
          left join (select course_id, string_agg(concat_ws(':', name, weight, notes), '; ' order by lower(name)) as cats from c group by all) using (course_id)""",
    ),
    "rule_notes": (rule_notes, "select 'c' || user_id % 30 as course_id, 'note ' || event_id % 3 as note, min(event_id) as position from events group by all"),
    "extracted_grade": (extracted_grade, GRADE_SQL),
    "merge_extractions": (
        merge_extractions,
        """select cast(user_id as varchar) as course_id, case when user_id % 2 = 0 then 'new' else 'old' end as course_code, count(*) as artifact_count,
          count(*) * (case when user_id % 2 = 0 and user_id % 3 <> 0 then 2 else 1 end) as events
          from events where user_id % 3 <> 0 or user_id % 2 = 0 group by user_id""",
    ),
    "extraction_events": (
        extraction_events,
        """select *, row_number() over (partition by course_id order by run, position) as at from (
          select cast(user_id as varchar) as course_id, 1 as run, event_id as position, event_type from events where user_id % 3 <> 0 union all
          select cast(user_id as varchar), 2, event_id, event_type from events where user_id % 2 = 0)""",
    ),
    "parse_model_json": (
        parse_model_json,
        """select event_id as chunk, case when event_id % 7 = 0 then 'response holds no JSON object' end as error, case when event_id % 7 = 0 or event_id % 5 = 0 then 0 when event_id % 3 = 0 then 2 else 1 end as n,
          case when event_id % 7 <> 0 and event_id % 5 <> 0 then 'T' || event_id end as title from events""",
    ),
    "extraction_log": (
        extraction_log,
        """select event_id as chunk, 'extract_assignments' as stage, case when event_id % 5 = 0 then 0 when event_id % 3 = 0 then 2 else 1 end as n,
          case when event_id % 5 <> 0 then 'T' || event_id end as title, case when event_id % 5 <> 0 then 'q' end as quote from events where event_id % 7 <> 0""",
    ),
    "syllabus_review_flags": (
        review_flags,
        V.with_views() + """select student_id, course_id, case course_no when 0 then '' when 1 then 'grade category weights sum to 100.00' else 'grading scale missing' end as flags from crs""",
    ),
    "pending_syllabi": (pending_syllabi, V.with_views() + "select student_id, course_id from crs where syllabus_raw_text is not null and not parsed"),
}
