"""Keeping the tables current: keyed upsert, scoped prune, audit log.

Tables and batches meet by hash joins on their keys; scopes are semi and anti joins. Nothing is looked up row by row.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from termloom.functions import text as X
from termloom.operators.reconcile import LMS, instant, status_after_zero
from termloom.schemas import ASSIGNMENTS, LATE_POLICY

KEY = ["student_id", "id"]
COURSE = ["student_id", "course_id"]
PUBLISHERS = ("pearson_mylab", "cengage_mindtap")
STATUSES = ("graded", "completed", "submitted", "in_progress", "overdue", "upcoming", "available")
TYPES = ("homework", "exam", "lab", "discussion", "project", "reading")
LOG_BITS = 40
LOG_SHIFT = 1 << LOG_BITS
# groups that number the events of a batch: so many positions, so many slots of courses
LOG_BLOCK = 1024
LOG_SLOTS = 4096


def last_write(batch: DataFrame, keys: Sequence[str], sequence: Sequence[str]) -> DataFrame:
    """One row per key: the one written last."""
    rest = [c for c in batch.columns if c not in keys]
    latest = batch.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*sequence)).alias("_row"))
    return latest.select(*keys, "_row.*").select(*batch.columns)


def one_per_key(batch: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row per key of a batch without an order of its own: the greatest as text, so a repeat gives the same row."""
    return last_write(batch.withColumn("_text", F.to_json(F.struct(*batch.columns))), keys, ["_text"]).drop("_text")


def upsert(
    target: DataFrame, source: DataFrame, keys: Sequence[str], *, sequence: Sequence[str] = (), preserve: Sequence[str] = ()
) -> DataFrame:
    """Target with the source rows replacing rows of the same key; `preserve` columns survive a null."""
    batch = last_write(source, keys, sequence) if sequence else source
    new = batch.select(*keys, F.struct(*[c for c in target.columns if c not in keys]).alias("_new"))
    old = target.select(*keys, F.struct(*[c for c in target.columns if c not in keys]).alias("_old"))

    def merged(c: str) -> Column:
        if c in keys:
            return F.col(c)
        fresh = F.coalesce(F.col("_new")[c], F.col("_old")[c]) if c in preserve else F.col("_new")[c]
        return F.when(F.col("_new").isNotNull(), fresh).otherwise(F.col("_old")[c]).alias(c)

    return old.join(new, list(keys), "full").select(*[merged(c) for c in target.columns])


def _missing(target: DataFrame, scope: DataFrame, kept: DataFrame, scope_keys: Sequence[str], where: Column | None) -> DataFrame:
    """Rows of the scope that the snapshot no longer has."""
    inside = target if where is None else target.where(where)
    stale = inside.join(scope.select(*scope_keys).distinct(), list(scope_keys), "left_semi")
    return stale.join(kept.select(*KEY).distinct(), KEY, "left_anti")


def missing_lms(target: DataFrame, courses: DataFrame, snapshot: DataFrame) -> DataFrame:
    return _missing(target, courses, snapshot, COURSE, F.col("source_platform") == LMS)


def missing_publisher(target: DataFrame, courses: DataFrame, snapshot: DataFrame) -> DataFrame:
    """Scoped per course and platform; a row kept under another scope does not protect this one."""
    scope = [*COURSE, "source_platform"]
    stale = target.join(courses.select(*scope).distinct(), scope, "left_semi")
    return stale.join(snapshot.select(*scope, "id").distinct(), [*scope, "id"], "left_anti")


def missing_extraction(target: DataFrame, courses: DataFrame, snapshot: DataFrame) -> DataFrame:
    return _missing(target, courses, snapshot, COURSE, None)


def without(target: DataFrame, doomed: DataFrame) -> DataFrame:
    return target.join(doomed.select(*KEY), KEY, "left_anti")


def prune_lms(target: DataFrame, courses: DataFrame, snapshot: DataFrame) -> DataFrame:
    return without(target, missing_lms(target, courses, snapshot))


def prune_publisher(target: DataFrame, courses: DataFrame, snapshot: DataFrame) -> DataFrame:
    return without(target, missing_publisher(target, courses, snapshot))


def prune_extraction(
    target: DataFrame, agenda: DataFrame, courses: DataFrame, snapshot: DataFrame
) -> tuple[DataFrame, DataFrame]:
    """Assignments and agenda entries without the orphans of the snapshot's courses."""
    doomed = missing_extraction(target, courses, snapshot)
    orphans = doomed.select("student_id", F.col("id").alias("assignment_id"))
    return without(target, doomed), agenda.join(orphans, ["student_id", "assignment_id"], "left_anti")


# ---------------------------------------------------------------- snapshots -> table rows


def _typed(columns: dict[str, Column]) -> list[Column]:
    """Columns of the assignments table; what a snapshot does not know is null."""
    spec = [x.strip() for x in ASSIGNMENTS.replace(LATE_POLICY, "LATE_POLICY").replace("map<string,string>", "RAW").split(",")]
    types = {n: t.replace("LATE_POLICY", LATE_POLICY).replace("RAW", "map<string,string>") for n, t in (x.split() for x in spec)}
    return [columns.get(n, F.lit(None)).cast(t).alias(n) for n, t in types.items()]


def _settled(df: DataFrame, *, grade: Column, submitted: Column, now: datetime) -> DataFrame:
    """Status and submission once explicit zeros are read as missing work."""
    g, e, p = F.col("_grade"), F.col("points_earned"), F.col("points_possible")
    with_grade = df.withColumns({"_grade": grade, "_submitted": submitted})
    return with_grade.withColumns(
        {
            "_status": status_after_zero(F.col("status"), g, e, p, F.col("due_date"), instant(now)),
            "_submitted": F.col("_submitted") & ~X.meaning_zero(g, e, p),
        }
    )


def _signal_grade() -> Column:
    return F.coalesce(X.ratio_pct(F.col("points_earned"), F.col("points_possible")), F.col("grade_pct"))


def normalized_to_assignments(assignments: DataFrame, *, now: datetime) -> DataFrame:
    rows = _settled(
        assignments.withColumn("due_date", F.col("due_at")), grade=_signal_grade(), submitted=F.lit(False), now=now
    )
    c = F.col
    return rows.select(*_typed({
        "student_id": c("student_id"), "course_id": c("course_id"), "id": c("id"), "title": c("title"), "type": c("type"),
        "source_platform": c("source_platform"), "external_url": c("external_url"), "due_date": c("due_date"),
        "grade_category": c("grade_category"), "grade_weight_pct": c("weight_possible"), "points_possible": c("points_possible"),
        "points_earned": c("points_earned"), "grade_pct": c("_grade"), "status": c("_status"), "is_submitted": F.lit(False),
        "is_late": F.lit(False), "days_late": F.lit(0), "is_multi_day": F.lit(False), "raw": c("raw_source"), "last_scraped": c("fetched_at"),
    }))


def normalized_to_courses(courses: DataFrame) -> DataFrame:
    """Course rows of a normalised snapshot; parsed syllabus facts start empty."""
    return courses.select(
        "student_id", "course_id", "code", "name", "d2l_course_id", "d2l_url",
        F.coalesce(X.blank_to_null(F.col("semester")), F.lit("Unknown term")).alias("semester"),
        "external_platform", "external_platform_url", "syllabus_raw_text", "current_grade_pct",
        F.col("fetched_at").alias("last_scraped_d2l"),
    )


def publisher_to_assignments(assignments: DataFrame, *, now: datetime) -> DataFrame:
    rows = _settled(
        assignments.withColumn("due_date", F.col("due_at")), grade=_signal_grade(),
        submitted=F.col("status").isin("completed", "submitted"), now=now,
    )
    c = F.col
    return rows.select(*_typed({
        "student_id": c("student_id"), "course_id": c("course_id"), "id": c("id"), "title": c("title"), "description": c("description"),
        "type": c("type"), "source_platform": c("source_platform"), "external_url": c("external_url"), "due_date": c("due_date"),
        "points_possible": c("points_possible"), "points_earned": c("points_earned"), "status": c("_status"),
        "is_submitted": c("_submitted"), "submitted_at": F.when(c("_submitted"), c("fetched_at")), "is_late": c("status") == "overdue",
        "days_late": F.lit(0), "estimated_minutes": c("estimated_minutes"), "is_multi_day": F.lit(False), "raw": c("raw_source"),
        "last_scraped": c("fetched_at"),
    }))


def extracted_due() -> Column:
    """Captured instant, else 23:59 UTC of the captured day."""
    on = F.trim("due_on")
    day = F.when(on.rlike(r"^\d{4}-\d{2}-\d{2}"), F.substring(on, 1, 10).try_cast("date"))
    at = X.iso_instant(X.blank_to_null(F.col("due_at")))
    return F.coalesce(at, F.try_to_timestamp(F.concat(day.cast("string"), F.lit(" 23:59:00"))))


def extracted_status() -> Column:
    raw = F.trim(F.lower(F.coalesce("status", F.lit(""))))
    return F.when(raw.isin(*STATUSES), raw).when(F.col("graded"), "graded").when(F.col("submitted"), "submitted").otherwise("upcoming")


def extracted_type() -> Column:
    hint = F.trim(F.lower(F.coalesce("assignment_type", F.lit(""))))
    return F.when(hint.isin(*TYPES), hint).otherwise(X.infer_type(F.col("title")))


def extracted_platform() -> Column:
    """First known platform of the fact, else its first one, else the LMS."""
    known = F.filter("source_platforms", lambda p: p.isin(LMS, *PUBLISHERS))
    return F.coalesce(F.get(known, F.lit(0)), F.get("source_platforms", F.lit(0)), F.lit(LMS))


def extraction_to_assignments(facts: DataFrame, urls: DataFrame, *, now: datetime) -> DataFrame:
    """Consolidated facts as table rows. `urls` is the result of resolve_urls (student, course, fact_key, url)."""
    c = F.col
    shaped = (
        facts.join(urls, [*COURSE, "fact_key"], "left")
        .withColumns({"due_date": extracted_due(), "status": extracted_status(), "type": extracted_type(), "platform": extracted_platform()})
    )
    submitted = F.coalesce(c("submitted"), F.lit(False)) | c("status").isin("submitted", "graded", "completed")
    rows = _settled(shaped, grade=_signal_grade(), submitted=submitted, now=now)
    raw = F.create_map(
        *[x for k, v in {
            "source": F.lit("crawl_extract"), "due_text": c("due_text"), "due_on": c("due_on"), "due_at": c("due_at"),
            "rationale": c("rationale"), "optional": c("optional"), "extra_credit": c("extra_credit"),
            "counts_toward_grade": c("counts_toward_grade"), "inferred_external_url": c("url"),
        }.items() for x in (F.lit(k), v.cast("string"))]
    )
    return rows.select(*_typed({
        "student_id": c("student_id"), "course_id": c("course_id"), "id": X.assignment_key(c("course_id"), c("title"), c("first_artifact_id")),
        "title": c("title"), "type": c("type"), "source_platform": c("platform"), "external_url": c("url"), "due_date": c("due_date"),
        "grade_category": c("grade_category"), "grade_weight_pct": c("weight_pct"), "points_possible": c("points_possible"),
        "points_earned": c("points_earned"), "status": c("_status"), "is_submitted": c("_submitted"),
        "submitted_at": F.when(c("_submitted"), c("extracted_at")), "is_late": c("_status") == "overdue", "days_late": F.lit(0),
        "is_multi_day": F.lit(False), "raw": raw, "last_scraped": c("extracted_at"),
    }))


def late_policy_text(policy: Column) -> Column:
    """Readable lines of an extracted late policy; null when it says nothing."""
    lines = F.concat_ws(
        "\n",
        F.when(X.truthy(policy["raw_text"]), F.trim(policy["raw_text"])),
        F.concat(F.lit("Accepts late submissions: "), F.initcap(policy["accepts_late"].cast("string"))),
        F.concat(F.lit("Default penalty per day: "), policy["default_penalty_per_day"].cast("string"), F.lit("%")),
        F.concat(F.lit("Max late days: "), policy["max_late_days"].cast("string")),
    )
    return X.blank_to_null(lines)


def lms_home(courses: DataFrame, artifacts: DataFrame) -> DataFrame:
    """LMS id and home URL of each course from its first captured home page."""
    homes = artifacts.where("page_kind = 'course_home'").withColumn("_lms_id", F.regexp_extract("url", r"/d2l/home/(\d+)", 1)).where("_lms_id <> ''")
    first = homes.groupBy(*COURSE).agg(F.min(F.struct("position", "_lms_id", "url")).alias("h"))
    return courses.select(*COURSE).distinct().join(first, COURSE, "left").select(
        *COURSE,
        F.coalesce("h._lms_id", "course_id").alias("d2l_course_id"),
        F.coalesce("h.url", F.concat(F.lit("https://d2l.invalid/d2l/home/"), "course_id")).alias("d2l_url"),
    )


def extraction_to_courses(courses: DataFrame, facts: DataFrame, homes: DataFrame, existing: DataFrame) -> DataFrame:
    """Course rows of an extraction. What it does not know is taken over from the existing row."""
    seen = facts.select(*COURSE, F.explode("source_platforms").alias("p")).where(F.col("p").isin(*PUBLISHERS))
    platform = seen.groupBy(*COURSE).agg(F.max("p").alias("_platform"))  # 'pearson_mylab' sorts last and goes first
    kept = ("instructor", "semester", "external_platform", "external_platform_url", "textbook", "syllabus_raw_text",
            "syllabus_parsed", "current_letter_grade", "last_syllabus_parse")
    old = existing.select(*COURSE, F.struct(*kept).alias("_old"))
    joined = courses.join(homes, COURSE, "left").join(platform, COURSE, "left").join(old, COURSE, "left")
    o = lambda n: F.col("_old")[n].alias(n)
    cats = F.transform("grade_categories", lambda c: F.struct(c["name"].alias("name"), c["weight"].alias("weight"), c["notes"].alias("description")))
    return joined.select(
        *COURSE, F.col("course_code").alias("code"), F.col("course_name").alias("name"), "d2l_course_id", "d2l_url",
        F.coalesce(F.col("_old")["semester"], F.lit("Unknown term")).alias("semester"),
        F.coalesce("_platform", F.col("_old")["external_platform"]).alias("external_platform"),
        *[o(n) for n in kept if n not in ("semester", "external_platform")],
        F.when(F.size("grading_scale") > 0, F.col("grading_scale")).alias("grading_scale"),
        F.when(F.size("grade_categories") > 0, cats).alias("grade_categories"),
        late_policy_text(F.col("late_policy")).alias("late_policy_global"),
        F.lit(None).cast("double").alias("current_grade_pct"),
        F.col("extracted_at").alias("last_scraped_d2l"), F.col("extracted_at").alias("last_scraped_external"),
    )


def cited_by_children(cited: DataFrame, evidence: DataFrame) -> DataFrame:
    """Artifacts a fact names, from its child rows: cited ids in their order, then those of its evidence."""
    keys = [*COURSE, "fact_key"]
    last = evidence.groupBy(*keys, "artifact_id").agg(F.min("first_at").alias("first_at"))
    return cited.select(*keys, F.struct(F.lit(0).alias("kind"), F.lit(None).cast(last.schema["first_at"].dataType).alias("at"), F.col("artifact_id").alias("name")).alias("pos"), "artifact_id").unionByName(
        last.select(*keys, F.struct(F.lit(1).alias("kind"), F.col("first_at").alias("at"), F.col("artifact_id").alias("name")).alias("pos"), "artifact_id")
    )


def resolve_urls(facts: DataFrame, artifacts: DataFrame, cited: DataFrame | None = None) -> DataFrame:
    """URL of each fact: first cited artifact with one (its own, else its parent's), else first artifact of the platform.

    `cited` (fact keys, pos, artifact_id) stands for the lists of the facts where these are rows of their own.
    """
    keys = [*COURSE, "fact_key"]
    cited = cited if cited is not None else facts.select(
        *keys,
        F.posexplode(F.array_distinct(F.concat(
            F.coalesce(F.array_sort("evidence_artifact_ids"), F.array().cast("array<string>")),
            F.coalesce(F.transform("evidence_spans", lambda s: s["artifact_id"]), F.array().cast("array<string>")),
        ))).alias("pos", "artifact_id"),
    )
    clean = lambda n: X.blank_to_null(F.trim(n))
    known = artifacts.select(
        *COURSE, F.col("id").alias("artifact_id"), "position", "source_platform", clean("url").alias("own"), F.coalesce(clean("url"), clean("parent_url")).alias("any")
    )
    by_citation = cited.join(known.where("any is not null"), [*COURSE, "artifact_id"]).groupBy(*keys).agg(F.min(F.struct("pos", "any"))["any"].alias("_cited"))
    first = known.where("own is not null").groupBy(*COURSE, F.col("source_platform").alias("platform")).agg(F.min(F.struct("position", "own"))["own"].alias("_first"))
    platform = facts.select(*keys, extracted_platform().alias("platform"))
    return platform.join(by_citation, keys, "left").join(first, [*COURSE, "platform"], "left").select(
        *keys, F.coalesce("_cited", "_first").alias("url")
    )


def touch_courses(courses: DataFrame, publisher_courses: DataFrame, *, sequence: str = "position") -> DataFrame:
    """Known courses of a publisher snapshot get its scrape time; platform and URL only where they are unset."""
    s = publisher_courses.groupBy(*COURSE).agg(
        F.max("fetched_at").alias("_at"),
        F.min(F.when(F.col("source_platform").isNotNull(), F.struct(sequence, "source_platform")))["source_platform"].alias("_platform"),
        F.min(F.when(F.col("launch_url").isNotNull(), F.struct(sequence, "launch_url")))["launch_url"].alias("_url"),
    )
    return courses.join(s, COURSE, "left").withColumns(
        {
            "last_scraped_external": F.coalesce("_at", "last_scraped_external"),
            "external_platform": F.coalesce("external_platform", "_platform"),
            "external_platform_url": F.coalesce("external_platform_url", "_url"),
        }
    ).drop("_at", "_platform", "_url")


# ---------------------------------------------------------------- whole synchronisations


def sync_summary(courses: DataFrame, assignments: DataFrame, deleted: DataFrame) -> DataFrame:
    """One row: courses and assignments upserted, assignments deleted."""
    parts = {"courses_upserted": courses, "assignments_upserted": assignments, "assignments_deleted": deleted}
    tagged = reduce(DataFrame.unionByName, [df.select(F.lit(name).alias("part")) for name, df in parts.items()])
    return tagged.agg(*[F.count_if(F.col("part") == name).alias(name) for name in parts])


def _fitted(batch: DataFrame, table: DataFrame) -> DataFrame:
    """Batch in the shape of the table; columns it does not know are null."""
    missing = {f.name: F.lit(None).cast(f.dataType) for f in table.schema if f.name not in batch.columns}
    return batch.withColumns(missing).select(*table.columns) if missing else batch.select(*table.columns)


def sync_lms(courses: DataFrame, assignments: DataFrame, new_courses: DataFrame, new_assignments: DataFrame, *, now: datetime):
    """Tables after a normalised snapshot, and the summary."""
    batch_c, batch_a = one_per_key(_fitted(normalized_to_courses(new_courses), courses), COURSE), one_per_key(normalized_to_assignments(new_assignments, now=now), KEY)
    kept = ("last_scraped_external", "last_syllabus_parse")
    merged = upsert(assignments, batch_a, KEY)
    doomed = missing_lms(merged, batch_c, batch_a)
    return upsert(courses, batch_c, COURSE, preserve=kept), without(merged, doomed), sync_summary(batch_c, batch_a, doomed)


def sync_publisher(courses: DataFrame, assignments: DataFrame, seen: DataFrame, rows: DataFrame, *, now: datetime):
    """Tables after a publisher snapshot, and the summary; courses that are not known are ignored."""
    batch = one_per_key(publisher_to_assignments(rows, now=now), KEY)
    known = seen.join(courses.select(*COURSE), COURSE, "left_semi")
    merged = upsert(assignments, batch, KEY)
    doomed = missing_publisher(merged, seen, batch)
    return touch_courses(courses, seen), without(merged, doomed), sync_summary(known, batch, doomed)


CHILD = ["student_id", "assignment_id"]


def orphans_of(doomed: DataFrame) -> DataFrame:
    return doomed.select("student_id", F.col("id").alias("assignment_id"))


def cascade(orphans: DataFrame, children: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Child tables (student_id, assignment_id, ...) without the rows of the orphans; one orphan set serves all of them."""
    return {name: rows.join(orphans, CHILD, "left_anti") for name, rows in children.items()}


def fact_children(facts: DataFrame, ids: DataFrame, tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Child rows of facts (fact keys, ...) under the ids of their assignments; `ids`: fact keys, assignment_id."""
    return {
        name: rows.join(ids, [*COURSE, "fact_key"]).select(*[c for c in ("student_id", "course_id", "assignment_id", "artifact_id", "quote", "note") if c == "assignment_id" or c in rows.columns]).distinct()
        for name, rows in tables.items()
    }


def extraction_batch(
    courses: DataFrame, assignments: DataFrame, new_courses: DataFrame, facts: DataFrame, artifacts: DataFrame,
    *, now: datetime, mode: str = "full", cited: DataFrame | None = None,
) -> dict[str, DataFrame]:
    """What an extraction changes: rows of `courses` and `assignments`, the assignments `merged` with the table, `doomed` ones, and `ids` of its facts."""
    homes = lms_home(new_courses, artifacts)
    batch_c = one_per_key(_fitted(extraction_to_courses(new_courses, facts, homes, courses), courses), COURSE)
    stamped = facts if "extracted_at" in facts.columns else facts.join(new_courses.select(*COURSE, "extracted_at"), COURSE)
    # two facts may name one assignment
    batch_a = one_per_key(extraction_to_assignments(stamped, resolve_urls(facts, artifacts, cited), now=now), KEY)
    merged = upsert(assignments, batch_a, KEY)
    doomed = missing_extraction(merged, batch_c, batch_a)
    ids = facts.select(*COURSE, "fact_key", X.assignment_key(F.col("course_id"), F.col("title"), F.col("first_artifact_id")).alias("assignment_id"))
    return {"courses": batch_c, "assignments": batch_a, "merged": merged, "doomed": doomed.limit(0) if mode == "additive" else doomed, "ids": ids}


def sync_extraction(
    courses: DataFrame, assignments: DataFrame, agenda: DataFrame, new_courses: DataFrame, facts: DataFrame, artifacts: DataFrame,
    *, now: datetime, mode: str = "full",
):
    """Tables after an extraction, and the summary. `mode='additive'` keeps rows the extraction does not have."""
    batch = extraction_batch(courses, assignments, new_courses, facts, artifacts, now=now, mode=mode)
    doomed = batch["doomed"]
    return (
        upsert(courses, batch["courses"], COURSE), without(batch["merged"], doomed),
        cascade(orphans_of(doomed), {"agenda": agenda})["agenda"], sync_summary(batch["courses"], batch["assignments"], doomed),
    )


# ---------------------------------------------------------------- audit log


def numbered(events: DataFrame, *, sequence: str = "position", out: str = "sequence") -> DataFrame:
    """Events with a number that no other event of the batch has; within a course it grows with `sequence`.

    Events are counted per block of positions and slot of courses, the counts are chained, and each group numbers its own rows. The
    chain has one row per group: at most LOG_SLOTS for each LOG_BLOCK positions of the longest course.
    """
    at = F.coalesce(F.col(sequence), F.lit(0))
    marked = events.withColumns({"_block": F.floor(at / LOG_BLOCK), "_slot": F.pmod(F.xxhash64(*COURSE), F.lit(LOG_SLOTS)), "_text": F.to_json(F.struct(*events.columns))})
    before = Window.orderBy("_block", "_slot").rowsBetween(Window.unboundedPreceding, -1)
    bases = marked.groupBy("_block", "_slot").agg(F.count(F.lit(1)).alias("_n")).select("_block", "_slot", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    inside = Window.partitionBy("_block", "_slot").orderBy(at, *COURSE, "_text")
    return marked.join(bases, ["_block", "_slot"]).withColumn(out, F.col("_base") + F.row_number().over(inside) - 1).drop("_block", "_slot", "_text", "_base")


def append_log(events: DataFrame, *, batch: int, sequence: str = "position", preview: int | None = None) -> DataFrame:
    """Events as log rows: known stage, detail an object, preview cut if asked for. Ids grow with the batch and the sequence."""
    detail = F.trim("detail")
    is_object = detail.startswith("{") & F.try_parse_json(detail).isNotNull()
    payload = F.concat(F.lit('{"payload":'), F.coalesce(F.to_json(F.struct(F.col("detail").alias("d"))), F.lit("null")), F.lit("}"))
    return events.where(F.trim(F.coalesce("stage", F.lit(""))) != "").select(
        (F.lit(batch * LOG_SHIFT) + F.col(sequence)).cast("long").alias("log_id"),
        *[c for c in ("created_at", "student_id", "course_id", "assignment_id", "stage", "source_url", "artifact_ref") if c in events.columns],
        (F.col("text_preview") if preview is None else F.substring("text_preview", 1, preview)).alias("text_preview"),
        F.when(is_object, F.col("detail")).otherwise(payload).alias("detail"),
    )


def query_log(
    log: DataFrame, *, course_id: str | None = None, assignment_id: str | None = None, limit: int = 200
) -> DataFrame:
    """The newest `limit` entries, newest first. A limit below 1 is refused.

    Of a log with the partition column `batch` only the newest batches that hold enough entries are read: ids grow with the batch.
    """
    if limit < 1:
        raise ValueError("limit must be 1 or more")
    if course_id is not None:
        log = log.where(F.col("course_id") == course_id)
    if assignment_id is not None:
        log = log.where(F.col("assignment_id") == assignment_id)
    if "batch" in log.columns:
        newest = log.groupBy("batch").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("batch")).limit(limit).collect()
        held, oldest = 0, None
        for r in newest:
            held, oldest = held + r["n"], r["batch"]
            if held >= limit:
                break
        log = log.where(F.lit(False) if oldest is None else F.col("batch") >= oldest).drop("batch")
    return log.orderBy(F.desc("log_id")).limit(limit)
