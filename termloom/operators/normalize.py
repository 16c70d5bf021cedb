"""Captured LMS snapshot -> courses and assignments.

Inputs are the exploded frames of sources.snapshots.explode_lms_snapshot. All frames carry student_id, course_id (the
normalised key) and positions that keep the order of the document.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from termloom.functions import scan
from termloom.functions import text as X

COURSE = ["student_id", "course_id"]
SYLLABUS_GAP = "\n\n---\n\n"
SYLLABUS_CUT = "\n\n[... syllabus text truncated for parsing ...]"
# Outline titles that belong to the syllabus, keywords and noise of outline lines.
POLICY_TITLE = (
    r"(?i)syllabus|grading|grade\s*(?:breakdown|distribution|components|scheme|weights?)|"
    r"course\s*(?:policy|policies|expectations)|assessment|evaluation|late\s*work|"
    r"attendance|accommodat|weights?\s*(?:and|&|\+)\s*grades?"
)
LONG_DUE = (
    r"(?i)((?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)[a-z]*\s+\d{1,2},?\s+\d{4}\s+\d{1,2}:\d{2}\s*(?:AM|PM))"
)
SHORT_DUE = r"\b((?:JAN|FEB|MAR|APR|MAY|JUN|JUL|AUG|SEP|OCT|NOV|DEC)\s+\d{1,2}\s+\d{1,2}:\d{2}\s*(?:AM|PM))\b"
OUTLINE_WORDS = (
    "programming|exercise|quiz|exam|lab|homework|assignment|extra credit|project|chapter|discussion|activity|"
    "mindtap|pearson|dropbox"
)
OUTLINE_NOISE = ("objectives", "reading", "graded tasks", "grades tasks", "grade tasks", "extra credit", "table of contents")


def outline_assignments(topics: DataFrame, *, keys: list[str], text: str = "extracted_text") -> DataFrame:
    """Lines of a text that name an assignment and its due date: title, due_text, line position."""
    breaks = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"
    lines = F.split(F.replace(F.col(text), F.lit("\t"), F.lit(" ")), breaks)
    dated = lambda raw: F.upper(raw).rlike(r"\d{1,2}:\d{2}" + X.SPACE + "*(?:AM|PM)")
    # most lines carry no clock time: drop them before the line is unnested
    kept = F.filter(F.transform(lines, lambda raw, i: F.struct(i.alias("line"), raw.alias("raw"))), lambda s: dated(s["raw"]))
    each = topics.select(*keys, F.explode(kept).alias("s")).select(*keys, "s.line", X.squash(F.col("s.raw")).alias("one"))
    found = each.where(F.length("one") >= 8).withColumns(
        {"_long": F.regexp_extract("one", LONG_DUE, 1), "_short": F.regexp_extract("one", SHORT_DUE, 1)}
    ).withColumn("_hit", F.coalesce(X.blank_to_null(F.col("_long")), X.blank_to_null(F.col("_short"))))
    before = F.trim(F.expr("left(one, locate(_hit, one) - 1)"))
    title = F.btrim(F.regexp_replace(before, r"\s+[Dd]ue\s*$", ""), F.lit(" :-|"))
    titled = found.where("_hit is not null").withColumn("title", title)
    low = F.btrim(F.lower("title"), F.lit(" :-|"))
    keep = (
        (F.length(low) >= 4)
        & ~low.isin(*OUTLINE_NOISE)
        & ~low.rlike("^(graded tasks|grades tasks)")
        & (low.rlike(OUTLINE_WORDS) | F.col("title").rlike(r"\d+\.\d+"))
    )
    return titled.where(keep).select(*keys, "line", "title", F.col("_hit").alias("due_text"))


def syllabus_parts(topics: DataFrame) -> DataFrame:
    """Parts of each course's syllabus as rows (`position`, `part`, `n_chars`, `part_md5`): syllabus and policy-like outline topics, repeats dropped.

    The text of a course is its parts in order of position with SYLLABUS_GAP between them. `topics` has kind ('syllabus' | 'outline'; others are no syllabus) and an integer `position` in report order.
    """
    body = F.trim(F.regexp_replace("extracted_text", f"^{X.SPACE}+|{X.SPACE}+$", ""))
    outline = F.col("kind") == "outline"
    hay = F.concat_ws(" ", F.coalesce("title", F.lit("")), F.coalesce("module_title", F.lit("")))
    heading = F.when(
        outline, F.concat(F.lit("["), F.coalesce(X.blank_to_null(F.col("module_title")), F.lit("Content")), F.lit(": "), F.col("title"), F.lit("]\n"))
    ).when(X.truthy(F.col("title")), F.concat(F.lit("["), F.col("title"), F.lit("]\n")))
    texts = (
        topics.where((F.col("kind") == "syllabus") | (outline & hay.rlike(POLICY_TITLE)))
        .withColumns({"body": body, "heading": F.coalesce(heading, F.lit(""))})
        .where("body <> ''")
    )
    first = texts.groupBy(*COURSE, F.sha2("body", 256).alias("digest")).agg(
        F.min(F.struct("position", "heading", "body")).alias("s")
    )
    parts = first.select(*COURSE, F.col("s.position").alias("position"), F.concat("s.heading", "s.body").alias("part"))
    return parts.withColumns({"n_chars": F.length("part").cast("long"), "part_md5": F.md5(F.encode("part", "UTF-8"))})


def syllabus_digests(parts: DataFrame) -> DataFrame:
    """Length and MD5 of each course's syllabus text, from its parts as rows; the text itself is never built.

    An MD5 takes its bytes in order, so one task reads the sorted parts of a course, a batch at a time.
    """
    gap = SYLLABUS_GAP.encode()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, size, digest = None, 0, None

        def done():
            return pa.RecordBatch.from_arrays([pa.array([at[0]], pa.int64()), pa.array([at[1]], pa.string()), pa.array([size], pa.int64()), pa.array([digest.hexdigest()])], names=[*COURSE, "n_chars", "text_md5"])

        for batch in batches:
            for student, course, n, part in zip(*(batch.column(i) for i in range(4))):
                if digest is None or (student.as_py(), course.as_py()) != at:
                    if digest is not None:
                        yield done()
                    at, size, digest = (student.as_py(), course.as_py()), -len(SYLLABUS_GAP), hashlib.md5(usedforsecurity=False)
                else:
                    digest.update(gap)
                size += n.as_py() + len(SYLLABUS_GAP)
                digest.update(part.as_buffer())
        if digest is not None:
            yield done()

    ordered = parts.where("part is not null").repartition(*COURSE).sortWithinPartitions(*COURSE, "position", "part")
    return ordered.select(F.col("student_id").cast("long"), F.col("course_id").cast("string"), "n_chars", F.encode("part", "UTF-8").alias("part")).mapInArrow(run, "student_id long, course_id string, n_chars long, text_md5 string")


def compose_syllabus(topics: DataFrame, *, cap: int | None = None) -> DataFrame:
    """Syllabus text per course, joined from its parts; cut only if `cap` is given. For courses whose text fits in a row: else see `syllabus_parts`."""
    parts = syllabus_parts(topics).select(*COURSE, "position", "part")
    if cap is None:
        every = parts.groupBy(*COURSE).agg(F.array_sort(F.collect_list(F.struct("position", "part"))).alias("ps"))
        return every.select(*COURSE, F.array_join(F.transform("ps", lambda p: p["part"]), SYLLABUS_GAP).alias("syllabus_raw_text"))
    gap = len(SYLLABUS_GAP)
    placed = scan.sum_before(parts, COURSE, "position", (F.length("part") + gap).cast("long"), "start")
    size = placed.groupBy(*COURSE).agg((F.sum(F.length("part") + gap) - gap).alias("size"))
    # parts that start beyond the cap cannot be seen; what is left has a bounded total length
    visible = placed.where(F.col("start") <= cap).groupBy(*COURSE).agg(
        F.array_sort(F.collect_list(F.struct("position", "part"))).alias("ps")
    )
    text = F.array_join(F.transform("ps", lambda p: p["part"]), SYLLABUS_GAP)
    cut = F.concat(F.regexp_replace(F.substring(text, 1, cap), f"{X.SPACE}+$", ""), F.lit(SYLLABUS_CUT))
    return visible.join(size, COURSE).select(
        *COURSE, F.when(F.col("size") > cap, cut).otherwise(text).alias("syllabus_raw_text")
    )


def tool_score(module_title: Column, title: Column, launch_url: Column, url: Column) -> Column:
    blank = lambda c: F.coalesce(c, F.lit(""))
    hay = F.lower(F.concat_ws(" ", blank(module_title), title, blank(launch_url), url))
    points = (("assignment", 4), ("mindtap|mastering", 3), ("pearson|cengage", 2), ("dashboard|support", -2), ("etext", -1))
    total = F.lit(0)
    for words, n in points:
        total = total + F.when(hay.rlike(words), n).otherwise(0)
    return total


def primary_tool(topics: DataFrame) -> DataFrame:
    """The external tool of each course: best words, then shorter title, then first."""
    score = tool_score(F.col("module_title"), F.col("title"), F.col("launch_url"), F.col("url"))
    rank = F.struct((-score).alias("score"), F.length("title").alias("n"), "position")
    best = topics.groupBy(*COURSE).agg(
        F.min(F.struct(rank.alias("rank"), "title", "module_title", "url", "launch_url"))["title"].alias("title"),
        F.min(F.struct(rank.alias("rank"), "title", "module_title", "url", "launch_url")).alias("t"),
    )
    t = lambda n: F.col("t")[n]
    return best.select(
        *COURSE, "title", t("module_title").alias("module_title"), t("url").alias("url"), t("launch_url").alias("launch_url"),
        X.platform_of(t("module_title"), t("title"), t("launch_url"), t("url")).alias("external_platform"),
        F.coalesce(X.blank_to_null(t("launch_url")), t("url")).alias("external_platform_url"),
    )


def normalize_courses(frames: dict[str, DataFrame]) -> DataFrame:
    """Normalised courses with final grade, tool URLs, syllabus text and platform."""
    tools = frames["tool_links"].select(
        *COURSE, F.lit(0).alias("r"), "position",
        F.replace(F.replace(F.lower("name"), F.lit(" / "), F.lit("_")), F.lit(" "), F.lit("_")).alias("k"), F.col("url").alias("v"),
    )
    external = frames["topics"].where("kind = 'external'")
    launched = external.select(
        *COURSE, F.lit(1).alias("r"), "position", X.slug(F.col("title")).alias("k"),
        F.coalesce(X.blank_to_null(F.col("launch_url")), F.col("url")).alias("v"),
    )
    urls = (
        tools.unionByName(launched)
        .groupBy(*COURSE, "k").agg(F.max(F.struct("r", "position", "v"))["v"].alias("v"))
        # the tools of one course, a navigation bar
        .groupBy(*COURSE).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("k", "v")))).alias("external_platform_urls"))
    )
    tool = primary_tool(external).select(*COURSE, "external_platform", "external_platform_url")
    out = frames["courses"].join(compose_syllabus(frames["topics"]), COURSE, "left").join(tool, COURSE, "left").join(urls, COURSE, "left")
    grade = F.col("final_calculated_grade.grade_text")
    return out.select(
        *COURSE, "d2l_course_id", "code", "name", "semester", F.col("home_url").alias("d2l_url"), F.lit("d2l").alias("source_platform"),
        X.percent(grade).alias("current_grade_pct"), grade.alias("current_grade_text"), "syllabus_raw_text", "external_platform",
        "external_platform_url", "external_platform_urls", "fetched_at",
    )


def usable_grade_rows(rows: DataFrame) -> DataFrame:
    """Category rows count only when they have no child rows and carry a value."""
    children = rows.where(~F.col("is_category") & X.truthy(F.col("category_title"))).select(
        *COURSE, F.col("category_title").alias("title")
    ).distinct()
    values = X.truthy(F.col("grade_text")) | X.truthy(F.col("weight_achieved_text")) | X.truthy(F.col("points_text"))
    items = rows.where(~F.col("is_category"))
    alone = rows.where(F.col("is_category") & values).join(children, [*COURSE, "title"], "left_anti")
    return items.unionByName(alone.select(*items.columns))


SOURCE_FIELDS = (
    "position", "title", "id", "status", "external_url", "grade_category", "points_earned", "points_possible",
    "weight_achieved", "weight_possible", "grade_pct", "due_at", "due_text", "raw",
)


def _source(df: DataFrame, source: int, **given: Column) -> DataFrame:
    """Rows of one source in the common shape."""
    null = {
        **{n: F.lit(None).cast("double") for n in ("points_earned", "points_possible", "weight_achieved", "weight_possible", "grade_pct")},
        "external_url": F.lit(None).cast("string"), "grade_category": F.lit(None).cast("string"),
        "due_at": F.lit(None).cast("timestamp"), "due_text": F.lit(None).cast("string"),
    }
    columns = {**null, **given}
    return df.select(
        *COURSE, F.lit(source).alias("source"), *[columns[n].alias(n) for n in SOURCE_FIELDS],
    ).withColumn("key", X.snapshot_key(F.col("title")))


def _map(**fields: Column) -> Column:
    return F.create_map(*[x for k, v in fields.items() for x in (F.lit(k), v.cast("string"))])


def snapshot_sources(frames: dict[str, DataFrame], *, tz: str) -> DataFrame:
    """Grade rows (0), events (1), announcement items (2) and outline lines (3) in one shape."""
    c = F.col
    p = lambda *cols: F.struct(*[c(x).cast("long").alias(f"p{i}") for i, x in enumerate(cols)] + [F.lit(0).cast("long").alias(f"p{i}") for i in range(len(cols), 3)])  # noqa: E731,E501
    earned, possible = X.fraction(c("points_text"))
    w_earned, w_possible = X.fraction(c("weight_achieved_text"))
    graded = _source(
        usable_grade_rows(frames["grade_rows"]), 0, position=p("position"), title=c("title"),
        id=X.assignment_key(c("course_id"), c("title")), status=X.infer_status(c("title")), grade_category=c("category_title"),
        points_earned=earned, points_possible=possible, weight_achieved=w_earned, weight_possible=w_possible, grade_pct=X.percent(c("grade_text")),
        raw=_map(grade_category=c("category_title"), points_text=c("points_text"), weight_achieved_text=c("weight_achieved_text"), grade_text=c("grade_text")),
    )
    events = _source(
        frames["events"], 1, position=p("position"), title=c("title"), id=X.assignment_key(c("course_id"), c("title"), c("details_url")),
        status=X.infer_status(c("title")), external_url=c("details_url"), due_at=X.due_month_day(c("due_text"), c("fetched_at"), tz),
        due_text=c("due_text"), raw=_map(details_url=c("details_url"), due_text=c("due_text")),
    )
    link = F.coalesce(X.blank_to_null(c("url")), F.concat("announcement_url", F.lit("#"), "title"))
    items = _source(
        frames["announcement_items"], 2, position=p("announcement", "position"), title=c("title"),
        id=X.assignment_key(c("course_id"), c("title"), link), status=F.lit("available"), external_url=c("url"),
        raw=_map(announcement_title=c("announcement_title"), announcement_url=c("announcement_url"),
                 announcement_posted_at_text=c("posted_at_text"), announcement_item_url=c("url")),
    )
    topics = frames["topics"].where("kind = 'outline'").withColumnRenamed("title", "topic")
    keep = [*COURSE, "position", "topic", "module_title", "url", "fetched_at"]
    lines = outline_assignments(topics, keys=keep).withColumn("_due", X.due_flexible(c("due_text"), c("fetched_at"), tz))
    outline = _source(
        lines, 3, position=p("position", "line"), title=c("title"), id=X.assignment_key(c("course_id"), c("title"), c("url")),
        status=F.when(c("_due").isNotNull(), "upcoming").otherwise(X.infer_status(c("title"))), due_at=c("_due"), due_text=c("due_text"),
        raw=_map(content_outline_topic=c("topic"), content_outline_module=c("module_title"), content_outline_url=c("url")),
    )
    return graded.unionByName(events).unionByName(items).unionByName(outline)


def merge_sources(sources: DataFrame) -> DataFrame:
    """One assignment per (student, course, key).

    The base row is the last grade row, else the first event, announcement item or outline line. Events name the id,
    events and outline lines fill a missing deadline and lift the status, every later source adds its raw fields.
    """
    c = F.col
    body = F.struct(*[n for n in SOURCE_FIELDS if n not in ("position", "raw", "due_at")])
    at = F.struct("source", "position")
    of = lambda n: c("source") == n
    dated = of(1) | of(3)
    merged = sources.groupBy(*COURSE, "key").agg(
        F.min(at).alias("first_seen"),
        F.max(F.when(of(0), F.struct("position", body.alias("b"))))["b"].alias("_grade"),
        F.min(F.when(~of(0), F.struct(at.alias("at"), body.alias("b")))).alias("_other"),
        F.max(F.when(of(1), F.struct("position", "id", "external_url", "due_text"))).alias("_event"),
        F.count_if(of(1)).alias("_events"),
        F.min(F.when(of(1) & X.truthy(c("external_url")), F.struct("position", "external_url")))["external_url"].alias("_event_url"),
        F.min(F.when(dated & c("due_at").isNotNull(), F.struct(at.alias("at"), "due_at")))["due_at"].alias("due_at"),
        F.min(F.when(dated & X.truthy(c("due_text")), F.struct(at.alias("at"), "due_text")))["due_text"].alias("due_text"),
        F.bool_or(dated & (c("status") == "upcoming")).alias("_lifted"),
        F.max_by("raw", F.when(of(0), c("position"))).alias("_raw0"),
        F.min_by("raw", F.when(of(1), c("position"))).alias("_raw1"),
        F.max_by("raw", F.when(of(2), c("position"))).alias("_raw2"),
        F.max_by("raw", F.when(of(3), c("position"))).alias("_raw3"),
    )
    base = F.coalesce("_grade", "_other.b")
    empty = F.create_map().cast("map<string,string>")
    created_by_event = c("_grade").isNull() & (c("_events") > 0)
    updates = F.when(
        (c("_events") > 1) | ((c("_events") > 0) & ~created_by_event),
        _map(event_details_url=c("_event.external_url"), event_due_text=c("_event.due_text")),
    )
    item_url = F.when(c("_grade").isNull() & (c("_events") == 0) & (c("_other.at.source") == 2), c("_other.b.external_url"))
    raw = F.map_concat(
        F.coalesce("_raw0", empty), F.coalesce(F.when(created_by_event, c("_raw1")), empty), F.coalesce(updates, empty),
        F.coalesce("_raw2", empty), F.coalesce("_raw3", empty),
    )
    b = lambda n: base[n].alias(n)
    return merged.select(
        *COURSE, "key", F.coalesce(c("_event.id"), base["id"]).alias("id"), b("title"), X.infer_type(base["title"]).alias("type"),
        F.when(c("_lifted"), "upcoming").otherwise(base["status"]).alias("status"), F.lit("d2l").alias("source_platform"),
        F.coalesce("_event_url", item_url).alias("external_url"), b("grade_category"), b("points_earned"), b("points_possible"),
        b("weight_achieved"), b("weight_possible"), b("grade_pct"), "due_at", "due_text", raw.alias("raw_source"), "first_seen",
    )


def normalize_assignments(frames: dict[str, DataFrame], *, tz: str) -> DataFrame:
    fetched = frames["courses"].select(*COURSE, "fetched_at")
    return merge_sources(snapshot_sources(frames, tz=tz)).join(fetched, COURSE, "left")
