"""Captured pages, fragments and model responses -> facts. Parsers are column expressions over one row each."""

from __future__ import annotations

import html
from datetime import datetime
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from termloom import schemas
from termloom.functions import scan
from termloom.functions import text as X
from termloom.functions import urls as U
from termloom.operators.reconcile import instant

COURSE = ["student_id", "course_id"]

# Page kinds whose HTML adds to the text, words that classify content modules and topics.
HTML_KINDS = (
    "announcement_detail", "announcements_index", "content_outline_topic", "d2l_nav_page", "course_home", "tool_assignments",
    "tool_content", "tool_grades", "tool_calendar", "tool_calendar_full_schedule", "tool_quizzes-exams",
    "external_course_nav_page", "external_course_frame",
)
SYLLABUS_WORDS = (
    "syll|course outline|course information|course info|getting started|start here|welcome|orientation|general information|"
    "instructor information|about this course|course summary|grading policy|grade policy|grade breakdown|grade components|"
    "assessment plan|course expectations|class expectations|important information"
)
EXTERNAL_WORDS = "cengage|mindtap|mastering|pearson|mylab"
WEEK_MODULE = r"(?i)^week\s+\d+\b"
SCHEDULE_MODULE = (
    r"(?i)graded?\s*tasks?|grades?\s*tasks?|grade\s+tasks?|extra\s+credit|programming\s+exercise|lab\s+assignment|"
    r"weekly\s+tasks?|reading\s+tasks?"
)
LISTING_TOPIC = (
    r"(?i)graded?\s*tasks?|grades?\s*tasks?|extra\s+credit|programming\s+exercise|\bquiz\b|\bexam\b|lab\s+\d|assignment|"
    r"\bhw\b|\bhomework\b|due\s+(?:jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)"
)
IGNORED_HOSTS = ("s.brightspace.com", "service.force.com", "solve-widget.forethought.ai", "d2l.my.site.com")
FRAME_PREFIXES = r"^(?:Toggle Sidebar Find Previous Next of|Thumbnails Document Outline Attachments)"
DOCUMENT_MARKERS = ("OAKTON", "Oakton", "COURSE SYLLABUS", "Course Syllabus", "SYLLABUS", "Syllabus")
MONTH_TOKEN, DAY_TOKEN, TIME_TOKEN = r"^\p{L}{1,4}$", r"^\d{1,2}$", r"(?i)\b\d{1,2}:\d{2}\s?(?:AM|PM)\b"
MIN_OUTLINE, MIN_FRAME = 120, 200

FUZZY_DATE = r'<abbr\b[^>]*class="[^"]*d2l-fuzzydate[^"]*"[^>]*title="([^"]+)"[^>]*>\s*(.*?)\s*</abbr>'


@F.pandas_udf(T.StringType())
def decode_entities(texts: pd.Series) -> pd.Series:
    """HTML entities decoded up to three times; only texts with an ampersand are touched."""

    def once(s: pd.Series) -> pd.Series:
        hit = s.str.contains("&", regex=False, na=False)
        return s.where(~hit, s[hit].map(html.unescape)) if hit.any() else s

    return once(once(once(texts)))


# ---------------------------------------------------------------- pages


def strip_tags(c: Column) -> Column:
    return X.squash(F.regexp_replace(c, r"<[^>]+>", " "))


def html_to_text(pages: DataFrame, *, decode: bool = True, column: str = "html", out: str = "text") -> DataFrame:
    """Readable text of a page: embedded HTML blocks first, then the page, repeated parts once."""
    opened = decode_entities if decode else (lambda c: c)
    bare = F.regexp_replace(column, r"(?is)<script\b[^>]*>.*?</script>", " ")
    bare = F.regexp_replace(bare, r"(?is)<style\b[^>]*>.*?</style>", " ")
    dated = F.regexp_replace(bare, "(?is)" + FUZZY_DATE, "$2 ($1)")
    cleaned = pages.withColumn("_clean", dated)
    # the blocks of one page travel in one string, so that one vectorised call decodes page and blocks
    blocks = F.array_join(F.regexp_extract_all("_clean", F.lit(r'<d2l-html-block[^>]*\shtml="([^"]*)"'), F.lit(1)), "\u0001")
    ready = cleaned.withColumns({"_page": opened(F.col("_clean")), "_blocks": opened(blocks)})
    parts = F.concat(F.transform(F.split("_blocks", "\u0001"), strip_tags), F.array(strip_tags(F.col("_page"))))
    kept = F.array_distinct(F.filter(parts, lambda p: p != ""))
    return ready.withColumn(out, F.array_join(kept, "\n\n")).drop("_clean", "_page", "_blocks")


def artifact_text(artifacts: DataFrame) -> DataFrame:
    """Text of each artifact: its text body, then the text of its HTML for page kinds that need it."""
    augment = F.col("page_kind").isin(*HTML_KINDS) & F.col("html").isNotNull()
    with_html = html_to_text(artifacts.withColumn("_html", F.when(augment, F.col("html"))), column="_html", out="_html_text")
    own = F.regexp_replace("body", f"^{X.SPACE}+|{X.SPACE}+$", "")
    parts = F.array_distinct(F.filter(F.array(own, F.col("_html_text")), lambda p: F.coalesce(p != "", F.lit(False))))
    return with_html.withColumn("text", F.array_join(parts, "\n\n")).drop("_html", "_html_text")


def iso_with_offset(at: Column, tz: str) -> Column:
    """Instant as ISO text on the clock of a time zone, with its offset."""
    local = F.from_utc_timestamp(at, tz)
    minutes = F.floor((F.unix_timestamp(local) - F.unix_timestamp(at)) / 60).cast("int")
    sign = F.when(minutes < 0, "-").otherwise("+")
    hh, mm = F.lpad((F.floor(F.abs(minutes) / 60)).cast("string"), 2, "0"), F.lpad((F.abs(minutes) % 60).cast("string"), 2, "0")
    return F.concat(F.date_format(local, "yyyy-MM-dd'T'HH:mm:ss"), sign, hh, F.lit(":"), mm)


def html_due_facts(pages: DataFrame, *, tz: str, now: datetime) -> DataFrame:
    """'<title> - Due' headings with the fuzzy date that follows, as fact rows."""
    pattern = r"(?is)<h3[^>]*>([^<]+?)\s*-\s*Due</h3>.*?" + FUZZY_DATE
    grab = lambda g: F.regexp_extract_all("html", F.lit(pattern), F.lit(g))
    hits = pages.where("page_kind = 'tool_content'").select(
        *COURSE, "id", F.posexplode(F.arrays_zip(grab(1).alias("t"), grab(2).alias("d"))).alias("pos", "h")
    )
    read = hits.withColumns({"title": decode_entities(F.col("h.t")), "due_text": decode_entities(F.col("h.d"))})
    shown = read.withColumns({"title": strip_tags(F.col("title")), "due_text": X.squash(F.col("due_text"))})
    due = shown.withColumn("_due", X.due_long(F.col("due_text"), tz, comma_only=True))
    return due.where("title <> '' and _due is not null").select(
        *COURSE, "id", "pos", "title", X.infer_fact_type(F.col("title")).alias("assignment_type"), F.lit("d2l").alias("source_platform"),
        iso_with_offset(F.col("_due"), tz).alias("due_at"), "due_text",
        F.when(F.col("_due") >= instant(now), "upcoming").otherwise("overdue").alias("status"),
        F.array("id").alias("evidence_artifact_ids"), F.array(F.lit("Parsed due date from D2L content.")).alias("notes"),
    )


# ---------------------------------------------------------------- LMS fragments


def course_links(links: DataFrame) -> DataFrame:
    """Course cards: 'CODE - NAME, offering, term, end' with the id of their link; first link per id."""
    text = X.squash(F.col("text"))
    cards = links.where(text.contains(" - ")).withColumns(
        {"lms_course_id": F.regexp_extract("href", r"/d2l/home/(\d+)", 1), "_p": F.transform(F.split(text, ","), lambda p: F.trim(p))}
    ).where("lms_course_id <> ''")
    first = cards.groupBy("student_id", "lms_course_id").agg(F.min(F.struct("position", "_p", "home_url")).alias("f"))
    p = lambda i: F.get("f._p", F.lit(i))
    name = F.trim(F.regexp_extract(p(0), r"^.*? - (.*)$", 1))
    return first.select(
        "student_id", "lms_course_id", F.trim(F.substring_index(p(0), " - ", 1)).alias("code"),
        F.coalesce(X.blank_to_null(name), p(0)).alias("name"), p(1).alias("offering_code"), p(2).alias("semester"),
        F.when(F.size("f._p") > 3, F.array_join(F.slice("f._p", F.lit(4), F.size("f._p")), ", ")).alias("end_date_text"), "f.home_url",
    )


def upcoming_events(blocks: DataFrame) -> DataFrame:
    """Calendar entries: title and due text from the text blocks of one list item."""
    texts = F.transform("texts", lambda t: X.squash(t))
    pick = lambda rx: F.get(F.filter("_t", lambda v: v.rlike(rx)), F.lit(0))
    clean = lambda c: X.squash(F.replace(c, F.lit("View Event - "), F.lit("")))
    seen = F.get(F.reverse(F.filter("_t", lambda v: v != "")), F.lit(0))
    rows = blocks.where(F.col("title").startswith("View Event - ") & X.truthy(F.col("href"))).withColumn("_t", texts)
    due = F.concat_ws(" ", pick(MONTH_TOKEN), pick(DAY_TOKEN), pick(TIME_TOKEN))
    return rows.select(
        *COURSE, "position", clean(F.coalesce(seen, F.col("title"))).alias("title"), X.blank_to_null(due).alias("due_text"),
        F.col("href").alias("details_url"),
    )


def announcements(links: DataFrame, pages: DataFrame) -> DataFrame:
    """Announcements, first per URL, with the time they were posted and their distinct item links.

    pages: url, text, items array<struct<title,url>> in document order.
    """
    titled = links.withColumn("title", X.squash(F.col("text"))).where("title <> '' and url <> ''")
    first = titled.groupBy(*COURSE, "url").agg(F.min(F.struct("position", "title")).alias("f"))
    posted = F.regexp_extract("text", r"(?i)posted on ([A-Z][a-z]{2} \d{1,2}, \d{4} \d{1,2}:\d{2} [AP]M)", 1)
    item = F.transform(
        F.filter(F.transform("items", lambda i: F.struct(X.squash(i["title"]).alias("title"), i["url"].alias("url"))), lambda i: i["title"] != ""),
        lambda i: F.struct(i["title"].alias("title"), i["url"].alias("url"), F.lower(i["title"]).alias("low"), F.coalesce(i["url"], F.lower(i["title"])).alias("key")),
    )
    none = F.array().cast("array<struct<title:string,url:string,low:string,key:string>>")
    # an item counts as seen by its URL and by its title, and only items that were kept are seen
    distinct = F.aggregate(
        item, none,
        lambda kept, i: F.when(F.exists(kept, lambda k: (k["key"] == i["key"]) | (k["low"] == i["low"])), kept).otherwise(F.concat(kept, F.array(i))),
    )
    detail = pages.select(
        *COURSE, "url", X.blank_to_null(posted).alias("posted_at_text"),
        F.transform(distinct, lambda i: F.struct(i["title"].alias("title"), i["url"].alias("url"))).alias("items"),
    )
    return first.join(detail, [*COURSE, "url"], "left").select(
        *COURSE, "f.position", "f.title", "url", "posted_at_text",
        F.coalesce("items", F.array().cast("array<struct<title:string,url:string>>")).alias("items"),
    )


def grade_table_rows(rows: DataFrame, *, block: int = scan.BLOCK) -> DataFrame:
    """Grade table: a row of four cells is a category header, one of five an item below the last header.

    rows: course keys, position, title, cells array<string>.
    """
    shaped = rows.where((X.squash(F.col("title")) != "") & F.size("cells").isin(4, 5)).withColumns(
        {"title": X.squash(F.col("title")), "cells": F.transform("cells", lambda c: X.squash(c)), "is_category": F.size("cells") == 4}
    )
    carried = scan.carry_forward(shaped, COURSE, "position", F.when(F.col("is_category"), F.col("title")), "_header", block)
    cell = lambda i: X.blank_to_null(F.get("cells", F.lit(i)))
    header = F.col("is_category")
    return carried.select(
        *COURSE, "position", "title", "is_category", F.when(~header, F.col("_header")).alias("category_title"),
        F.when(~header, cell(1)).alias("points_text"), F.when(header, cell(1)).otherwise(cell(2)).alias("weight_achieved_text"),
        F.when(header, cell(2)).otherwise(cell(3)).alias("grade_text"),
    )


def module_kind(title: Column) -> Column:
    t = F.lower(title)
    return F.when(t.rlike(SYLLABUS_WORDS), "syllabus").when(t.rlike(EXTERNAL_WORDS), "external")


def is_schedule_module(title: Column) -> Column:
    t = F.trim(title)
    return t.rlike(WEEK_MODULE) | t.rlike(SCHEDULE_MODULE)


def lists_assignments(title: Column, content_type: Column) -> Column:
    by_type = F.lower(F.coalesce(content_type, F.lit(""))).isin("html document", "html")
    return by_type | F.coalesce(title.rlike(LISTING_TOPIC), F.lit(False))


def classify_content(topics: DataFrame, modules: DataFrame, *, max_extracts: int | None = None, max_chars: int | None = None) -> DataFrame:
    """Content topics as syllabus, external tool or outline; outline also has one view per schedule module.

    Outline texts come whole and from all topics, unless `max_chars` or `max_extracts` (topics tried per course) is given.

    topics: course keys, module_title, module_position, position, title, url, content_type, launch_url, extracted_text;
    modules: course keys, module_title, module_position, content_url, main_text.
    """
    at = F.struct(F.col("module_position").cast("long").alias("m"), F.col("position").cast("long").alias("p"))
    shaped = topics.withColumns({"kind": module_kind(F.col("module_title")), "at": at})
    fields = ("title", "module_title", "content_type", "launch_url", "extracted_text")
    tool = (F.col("content_type") == "External Learning Tool") | X.platform_of(F.col("title"), F.col("url")).isNotNull()
    named = shaped.where((F.col("kind") == "syllabus") | ((F.col("kind") == "external") & F.coalesce(tool, F.lit(False))))
    listed = named.groupBy(*COURSE, "kind", "url").agg(F.min(F.struct("at", *fields)).alias("f")).select(*COURSE, "kind", "url", "f.*")

    taken = listed.select(*COURSE, "url").distinct()
    wanted = shaped.where(is_schedule_module(F.col("module_title")) & lists_assignments(F.col("title"), F.col("content_type"))).join(
        taken, [*COURSE, "url"], "left_anti"
    )
    # a topic that yields text is read once; one without text is tried again wherever it appears
    try_key = F.when(X.truthy(F.col("extracted_text")), F.lit("")).otherwise(F.to_json("at"))
    tries = wanted.groupBy(*COURSE, "url", try_key.alias("_try")).agg(F.min(F.struct("at", *fields)).alias("f")).select(*COURSE, "url", "f.*")
    if max_extracts is not None:
        order = Window.partitionBy(*COURSE).orderBy("at")
        tries = tries.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= max_extracts).drop("_n")
    shown = lambda name: F.col(name) if max_chars is None else F.substring(name, 1, max_chars)
    read = tries.where(X.truthy(F.col("extracted_text")))
    outline = read.withColumns({"kind": F.lit("outline"), "extracted_text": shown("extracted_text")})

    quoted = F.replace(F.replace(F.replace(F.url_encode("module_title"), F.lit("+"), F.lit("%20")), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))
    main = X.squash(F.col("main_text"))
    views = modules.where(is_schedule_module(F.col("module_title"))).withColumn("_main", main).where(F.length("_main") >= MIN_OUTLINE).select(
        *COURSE, F.lit("outline").alias("kind"), F.concat("content_url", F.lit("#outline-module="), quoted).alias("url"),
        F.struct(F.col("module_position").cast("long").alias("m"), F.lit(-1).cast("long").alias("p")).alias("at"),
        F.concat("module_title", F.lit(" (module view)")).alias("title"), "module_title", F.lit("ModuleOverview").alias("content_type"),
        F.lit(None).cast("string").alias("launch_url"), shown("_main").alias("extracted_text"),
    )
    return listed.unionByName(outline).unionByName(views)


def best_document_text(frames: DataFrame, *, max_chars: int | None = None) -> DataFrame:
    """Longest text of the frames of one topic, without generic prefix and preamble; its first `max_chars` if that is given.

    frames: course keys, topic_url, position, frame_url, text.
    """
    host = F.regexp_extract(U.host(F.col("frame_url")), r"^(?:.*@)?([^:]*)", 1)
    usable = X.truthy(F.col("frame_url")) & (F.col("frame_url") != "about:blank") & ~host.isin(*IGNORED_HOSTS)
    long = frames.where(usable).withColumn("_t", X.squash(F.col("text"))).where(F.length("_t") >= MIN_FRAME)
    bare = long.withColumn("_t", F.trim(F.regexp_replace("_t", FRAME_PREFIXES, "")))
    starts = F.array_min(F.filter(F.array(*[F.locate(m, "_t") for m in DOCUMENT_MARKERS]), lambda i: i > 0))
    cut = bare.withColumn("_from", starts).withColumn(
        "_t", F.when(F.col("_from") <= 501, F.trim(F.expr("substring(_t, _from)"))).otherwise(F.col("_t"))
    )
    best = cut.groupBy(*COURSE, "topic_url").agg(F.min(F.struct((-F.length("_t")).alias("n"), "position", (F.col("_t") if max_chars is None else F.substring("_t", 1, max_chars)).alias("t")))["t"].alias("extracted_text"))
    return best


# ---------------------------------------------------------------- publisher rows


def _first_per_id(rows: DataFrame) -> DataFrame:
    """First row per id in document order."""
    rest = [c for c in rows.columns if c not in ("student_id", "course_id", "id", "position")]
    first = rows.groupBy(*COURSE, "id").agg(F.min_by(F.struct("position", *rest), F.col("position")).alias("r"))
    return first.select(*COURSE, "id", "r.*")


def mindtap_title(c: Column) -> Column:
    spaced = F.regexp_replace(
        X.squash(c), r"(?i)([\d.])(In progress\b|Not started\b|Submitted\b|COUNTS TOWARDS GRADE\b)", "$1 $2"
    )
    return F.trim(F.regexp_replace(spaced, r" (?:Submitted|Not started|In progress|COUNTS TOWARDS GRADE).*$", ""))


def mindtap_status(row_text: Column, activity_class: Column, earned: Column) -> Column:
    low = F.lower(F.concat_ws(" ", row_text, F.coalesce(activity_class, F.lit(""))))
    padded = F.concat(F.lit(" "), low, F.lit(" "))
    return (
        F.when(earned > 0, "completed")
        .when(low.contains("submitted") | padded.contains(" done "), "completed")
        .when(low.contains("in progress") | low.contains("inprogress"), "in_progress")
        .when(earned.isNotNull() & ~low.contains("not started"), "completed")
        .when(low.contains("not started"), "upcoming")
        .otherwise("available")
    )


def _row_id(prefix: str, identity: Column) -> Column:
    return X.publisher_key(prefix, F.col("course_id"), identity)


def mindtap_rows(rows: DataFrame, *, tz: str) -> DataFrame:
    """Activity rows: course keys, position, title, row_text, points_text, activity_class, external_url, description."""
    c = F.col
    earned, possible = X.points(c("points_text"))
    shown = rows.withColumns(
        {
            "title": mindtap_title(F.coalesce(X.blank_to_null(c("title")), c("row_text"))),
            "points_earned": earned, "points_possible": possible,
            "due_text": X.blank_to_null(F.regexp_extract("row_text", r"(?i)\b(\d{1,2}/\d{1,2}/(?:\d{4}|\d{2})\s+\d{1,2}:\d{2}\s*[AP]M)\b", 1)),
        }
    ).where("title <> ''")
    return _first_per_id(shown.select(
        *COURSE, "position", _row_id("cengage", F.coalesce(X.blank_to_null(c("external_url")), c("title"))).alias("id"),
        F.lit("cengage_mindtap").alias("source_platform"), "title", X.infer_type(c("title")).alias("type"),
        mindtap_status(c("row_text"), c("activity_class"), c("points_earned")).alias("status"), "external_url", "description",
        X.due_slashed(c("due_text"), tz).alias("due_at"), "due_text", "points_earned", "points_possible",
        X.ratio_pct(c("points_earned"), c("points_possible")).alias("grade_pct"), X.minutes(c("row_text")).alias("estimated_minutes"),
        F.create_map(*[x for k in ("row_text", "points_text", "activity_class", "due_text") for x in (F.lit(k), c(k))]).alias("raw_source"),
    ))


def mylab_status(row_text: Column) -> Column:
    low = F.lower(row_text)
    _, _, pct = X.score(row_text)
    return (
        F.when(pct.isNotNull(), "completed").when(low.contains("incomplete"), "in_progress").when(low.contains("complete"), "completed")
        .when(low.contains("past due"), "overdue").otherwise("upcoming")
    )


def mylab_description(row_text: Column, title: Column, due_text: Column) -> Column:
    """Row text without the title and the due text it starts with."""
    rest = lambda whole, head: F.when(
        F.coalesce(whole.startswith(head), F.lit(False)), F.trim(F.substr(whole, F.length(head) + 1))
    ).otherwise(whole)
    return X.blank_to_null(rest(rest(X.squash(row_text), title), due_text))


def mylab_list_rows(rows: DataFrame, *, tz: str) -> DataFrame:
    """List rows: course keys, position, title, row_text, external_url."""
    c = F.col
    due = r"\b\d{2}/\d{2}/(?:\d{2}|\d{4})\s+\d{1,2}:\d{2}\s*[APap][Mm]\b"
    earned, possible = X.points(c("row_text"))
    shown = rows.withColumns(
        {
            "title": X.squash(F.coalesce(X.blank_to_null(c("title")), c("row_text"))),
            "due_text": X.blank_to_null(F.regexp_extract("row_text", due, 0)), "points_earned": earned, "points_possible": possible,
        }
    ).where("title <> ''")
    return _first_per_id(shown.select(
        *COURSE, "position", _row_id("pearson", F.concat_ws("-", "title", "due_text")).alias("id"),
        F.lit("pearson_mylab").alias("source_platform"), "title", X.infer_type(c("title")).alias("type"),
        mylab_status(c("row_text")).alias("status"), "external_url", mylab_description(c("row_text"), c("title"), c("due_text")).alias("description"),
        X.due_slashed(c("due_text"), tz).alias("due_at"), "due_text", "points_earned", "points_possible",
        X.ratio_pct(c("points_earned"), c("points_possible")).alias("grade_pct"), X.minutes(c("row_text")).alias("estimated_minutes"),
        F.create_map(*[x for k in ("row_text", "due_text") for x in (F.lit(k), c(k))]).alias("raw_source"),
    ))


def mylab_table_rows(rows: DataFrame, *, tz: str, now: datetime) -> DataFrame:
    """Table rows: course keys, position, title, assignment_kind, row_text, due_text, due_class, score_text, href."""
    c = F.col
    shown = rows.withColumns(
        {
            "title": X.squash(F.coalesce(X.blank_to_null(c("title")), c("row_text"))),
            "_due": X.blank_to_null(X.squash(c("due_text"))),
            "_score": F.coalesce(X.blank_to_null(c("score_text")), c("row_text")),
            "_link_id": X.blank_to_null(F.regexp_extract("href", r"\((\d+)[,)]", 1)),
        }
    ).where("title <> ''")
    earned, possible, pct = X.score(c("_score"))
    scored = shown.withColumns(
        {"due_at": X.due_slashed(c("_due"), tz), "points_earned": F.when(possible.isNotNull(), earned), "points_possible": possible, "grade_pct": pct, "_plain": mylab_status(c("row_text"))}
    )
    past = F.coalesce(c("due_at") < instant(now), F.lit(False))
    status = (
        F.when((c("grade_pct") == 0) & (c("due_at") >= instant(now)), "upcoming").when(c("grade_pct").isNotNull(), "completed")
        .when(F.lower("due_class").contains("past due"), "overdue").when(c("_plain") != "upcoming", c("_plain"))
        .when(past, "overdue").otherwise(c("_plain"))
    )
    kind = F.trim(F.concat_ws(" ", F.coalesce(c("assignment_kind"), F.lit("")), c("title")))
    identity = F.coalesce(c("_link_id"), F.concat_ws("-", "title", "_due"))
    raw = {"row_text": c("row_text"), "due_text": c("_due"), "due_class": c("due_class"), "score_text": c("score_text"), "href": c("href"), "assignment_kind": X.blank_to_null(c("assignment_kind"))}
    return _first_per_id(scored.select(
        *COURSE, "position", _row_id("pearson", identity).alias("id"), F.lit("pearson_mylab").alias("source_platform"), "title",
        X.infer_type(kind).alias("type"), status.alias("status"), F.lit(None).cast("string").alias("external_url"),
        mylab_description(c("row_text"), c("title"), c("_due")).alias("description"), "due_at", c("_due").alias("due_text"), "points_earned",
        "points_possible", "grade_pct", X.minutes(c("row_text")).alias("estimated_minutes"),
        F.create_map(*[x for k, v in raw.items() for x in (F.lit(k), v)]).alias("raw_source"),
    ))


# ---------------------------------------------------------------- model responses and syllabi


def parse_model_json(responses: DataFrame, schema: str, *, column: str = "response", out: str = "parsed") -> DataFrame:
    """First '{' to last '}' of a response as a struct; `error` says why there is none."""
    body = F.regexp_extract(column, r"(?s)\{.*\}", 0)
    valid = F.try_parse_json(F.col("_json")).isNotNull()
    error = F.when(F.col("_json") == "", "response holds no JSON object").when(~valid, "response is not valid JSON")
    return (
        responses.withColumn("_json", F.coalesce(body, F.lit("")))
        .withColumn("error", error)
        .withColumn(out, F.when(F.col("error").isNull(), F.from_json("_json", schema.replace("\n", " "), {"mode": "PERMISSIVE"})))
        .drop("_json")
    )


def review_flags(categories: Column, late_text: Column, scale: Column) -> Column:
    """What a person should look at in a parsed syllabus."""
    total = F.aggregate(categories, F.lit(0.0), lambda a, c: a + F.coalesce(c["weight"], F.lit(0.0)))
    summed = F.concat(F.lit("grade category weights sum to "), F.replace(F.format_number(total, 2), F.lit(","), F.lit("")))
    flags = F.array(
        F.when((F.size(categories) > 0) & ~total.between(0.95, 1.05), summed),
        F.when(late_text.isNull(), "late policy needs review"),
        F.when(scale.isNull() | (F.size(scale) == 0), "grading scale missing"),
    )
    return F.filter(flags, lambda f: f.isNotNull())


def syllabus_review_flags(parsed: DataFrame) -> DataFrame:
    p = lambda n: F.col("parsed." + n)
    cats = F.coalesce(p("grade_categories"), F.array().cast(schemas.PARSED_SYLLABUS.split("grade_categories:")[1].split(">>")[0] + ">>"))
    return parsed.withColumn("review_flags", review_flags(cats, p("late_policy.raw_text"), p("grading_scale")))


def apply_syllabus_parse(courses: DataFrame, parsed: DataFrame) -> DataFrame:
    """Courses with the facts of their parsed syllabus. parsed: course keys, parsed struct, parsed_at."""
    flagged = syllabus_review_flags(parsed).select(*COURSE, F.struct("parsed", "review_flags", "parsed_at").alias("_p"))
    joined = courses.join(flagged, COURSE, "left")
    hit, p = F.col("_p").isNotNull(), lambda n: F.col("_p.parsed." + n)
    book = F.get(F.filter(p("external_tools"), lambda t: X.truthy(t["textbook"])), F.lit(0))["textbook"]
    policy = F.struct(*[p("late_policy." + n).alias(n) for n in ("raw_text", "accepts_late", "default_penalty_per_day", "max_late_days", "exceptions")])
    late = F.when(p("late_policy").isNotNull(), policy)
    cats = F.transform(p("grade_categories"), lambda c: F.struct(c["name"].alias("name"), c["weight"].alias("weight"), c["description"].alias("description")))
    new = {
        "syllabus_parsed": F.struct(late.alias("late_policy"), F.col("_p.review_flags").alias("review_flags")),
        "grading_scale": F.when(F.size(p("grading_scale")) > 0, p("grading_scale")),
        "grade_categories": F.when(F.size(p("grade_categories")) > 0, cats),
        "late_policy_global": X.blank_to_null(p("late_policy.raw_text")),
        "instructor": F.coalesce(X.blank_to_null(p("instructor")), F.col("instructor")),
        "textbook": F.coalesce(X.blank_to_null(F.col("textbook")), book),
        "last_syllabus_parse": F.col("_p.parsed_at"),
    }
    return joined.withColumns({k: F.when(hit, v).otherwise(F.col(k)) for k, v in new.items()}).drop("_p")


def pending_syllabi(courses: DataFrame, *, force: bool = False, course_id: str | None = None) -> DataFrame:
    """Courses with syllabus text that was not parsed yet."""
    wanted = [F.col("syllabus_raw_text").isNotNull()]
    if not force:
        wanted.append(F.col("last_syllabus_parse").isNull())
    if course_id is not None:
        wanted.append(F.col("course_id") == course_id)
    return courses.where(reduce(lambda a, b: a & b, wanted))
