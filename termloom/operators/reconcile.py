"""Entity resolution: the source rows of one real assignment become one canonical row.

All survivorship rules are ordered minima over structs whose first fields are the (negated) scores and whose last
fields before the payload are (title, id), so "the first row wins a tie" holds whatever the input order. Minima are
combined on the map side in very large courses, hence a group that holds a large share of all rows shuffles one row
per map task there.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from termloom.functions import text as X
from termloom.operators import categories

COURSE = ("student_id", "course_id")
KEYS = (*COURSE, "match_key")
DONE = ("completed", "graded", "submitted")
LMS = "d2l"
# raw fields that drive later rules; they become columns of the canonical row
RAW_FIELDS = ("due_at", "due_on", "days_late", "announcement_title")
# fields of the preferred row
KEPT = ("due_date", "type", "source_platform", "description", "grade_category", "grade_weight_pct", "late_policy", "estimated_minutes")
# source fields of a merged row, besides those of the preferred row
USED = ("id", "title", "grade_pct", "points_possible", "points_earned", "last_scraped", "external_url", "status")
# what rows may ask of the categories of their course
FACTS = (categories.for_grades, categories.for_weights)
# hash slots whose rows are counted, and the rows of a slot from which its courses count as very large
SLOTS, MOST = 1 << 16, 1 << 21
# source rows of one task of the merge, on average
PER_TASK = 1 << 18


def instant(now: datetime | Column) -> Column:
    return now if isinstance(now, Column) else F.lit(now.isoformat(sep=" ")).cast("timestamp")


def grade_pct(points_earned: Column, points_possible: Column, reported: Column) -> Column:
    """Points ratio rounded to two places, else the reported percentage."""
    return F.coalesce(X.ratio_pct(points_earned, points_possible), reported)


def grade_of() -> Column:
    return grade_pct(F.col("points_earned"), F.col("points_possible"), F.col("grade_pct"))


def drop_rollups(rows: DataFrame) -> DataFrame:
    return rows.where(~X.is_rollup(F.col("title")))


def status_after_zero(status: Column, grade: Column, earned: Column, possible: Column, due: Column, now: Column):
    """Status of a row once an explicit zero is read as missing work."""
    reopened = F.when(F.coalesce(due < now, F.lit(False)), "overdue").otherwise("upcoming")
    zero = X.meaning_zero(grade, earned, possible)
    return F.when(zero & status.isin(*DONE, "in_progress"), reopened).otherwise(status)


def zero_means_missing(rows: DataFrame, *, now: datetime) -> DataFrame:
    """Rows with an explicit zero are not submitted; done or started ones reopen."""
    g, e, p = F.col("grade_pct"), F.col("points_earned"), F.col("points_possible")
    return rows.withColumns(
        {
            "status": status_after_zero(F.col("status"), g, e, p, F.col("due_date"), instant(now)),
            "is_submitted": F.col("is_submitted") & ~X.meaning_zero(g, e, p),
        }
    )


def _flag(c: Column) -> Column:
    """0 for true, 1 for false or null: true sorts first."""
    return F.when(c, 0).otherwise(1)


def _scores() -> dict[str, Column]:
    """The scores that decide survivorship, and the place of a row among equals."""
    return {
        "_lms": F.col("source_platform") == LMS,
        "_signals": F.struct(
            _flag(F.col("grade").isNotNull() | F.col("points_earned").isNotNull()).alias("g"),
            _flag(F.col("estimated_minutes").isNotNull()).alias("m"),
            _flag(F.col("due_date").isNotNull()).alias("d"),
        ),
        "_at": F.struct("title", "id"),
    }


def _titled(rows: DataFrame) -> DataFrame:
    """Rows with their group key, display title and grade."""
    shown = rows.withColumns({"shown": X.display_title(F.col("title")), "grade": grade_of()})
    return shown.withColumn("match_key", X.canonical_key(F.col("title"), F.col("shown")))


def scored(rows: DataFrame) -> DataFrame:
    """Source rows with their group key and the scores that decide survivorship."""
    return _titled(drop_rollups(rows)).withColumns(_scores())


def _first(value: Column, wanted: Column, field: str) -> Column:
    """Value of the first row in (title, id) order that satisfies `wanted`."""
    return F.min(F.when(wanted, F.struct("_at", value.alias(field))))[field]


def _grade_order() -> Column:
    pct = F.coalesce(X.positive_or_missing(F.col("grade")), F.lit(-1.0))
    return F.struct(
        _flag(F.col("grade").isNotNull()).alias("has"),
        (-F.round(pct * 100)).cast("long").alias("pct"),
        _flag(~F.col("_lms")).alias("pub"),
        _flag(F.col("points_earned").isNotNull() | F.col("points_possible").isNotNull()).alias("pts"),
        F.coalesce(-F.unix_micros("last_scraped"), F.lit(2**63 - 1)).alias("age"),
        "_at",
    )


STATUS_RANK = {"completed": 2, "graded": 2, "submitted": 2, "available": 1}
LADDER = ("in_progress", "overdue", "upcoming")


def _status() -> Column:
    has = lambda c: F.bool_or(F.coalesce(c, F.lit(False)))
    published = F.col("status").isin(*DONE) & ~F.col("_lms")
    # the best-ranked status decides only in groups without any status of the ladder
    rank = F.coalesce(*[F.when(F.col("status") == s, r) for s, r in STATUS_RANK.items()], F.lit(0))
    other = ~published & ~F.col("status").isin(*LADDER)
    best = F.min(F.when(other, F.struct((-rank).alias("rank"), "_at", F.col("status").alias("status"))))["status"]
    ladder = F.when(has(published), "completed")
    for s in LADDER:
        ladder = ladder.when(has(F.col("status") == s), s)
    return ladder.otherwise(best)


def _carried(name: str) -> Column:
    """The raw field of a row, null where the row does not carry it."""
    return F.when(F.map_contains_key("raw", name), F.struct(F.element_at("raw", name).alias("v")))


def _raw_field(name: str) -> Column:
    """Later rows win, also with a null, as long as they carry the field at all."""
    carried = F.col("_raw_" + name)
    return F.max(F.when(carried.isNotNull(), F.struct("_at", carried["v"].alias("v"))))["v"]


def _dealt(rows: DataFrame, counted: DataFrame, most: int) -> list[DataFrame]:
    """`rows` in parts whose courses do not meet: one dealt by course, and one, if need be, of the courses of slots with more than `most` rows.

    Dealt by course, a row crosses the network once, as its source has it, into tasks of about PER_TASK rows whatever the number of rows; all that
    is keyed by course stays there. The rows of a very large course stay where they are and are combined there. `counted` has the courses of at least
    all `rows`; of theirs nothing else is read to count them.
    """
    slot = F.pmod(F.xxhash64(*COURSE), F.lit(SLOTS))
    large = F.collect_list(F.when(F.col("count") > most, F.col("slot")))  # at most one number per `most` rows
    total, large = counted.groupBy(slot.alias("slot")).count().agg(F.coalesce(F.sum("count"), F.lit(0)), large).first()
    tasks = max(rows.sparkSession.sparkContext.defaultParallelism, -(-total // PER_TASK))
    if not large:
        return [rows.repartition(tasks, *COURSE)]
    return [rows.where(~slot.isin(large)).repartition(tasks, *COURSE), rows.where(slot.isin(large))]


def canonical_assignments(rows: DataFrame, *, now: datetime, most: int = MOST) -> DataFrame:
    """One row per (student, course, key). Groups of courses in hash slots of more than `most` rows are combined before they are dealt."""
    raw = [_carried(f).alias("_raw_" + f) for f in RAW_FIELDS]
    narrow = drop_rollups(rows).select(*COURSE, *USED, *KEPT, *raw)
    # titles are read where the rows are merged, so what is derived from them is not shuffled
    first, *rest = [_merged(_titled(part).withColumns(_scores()), now=now) for part in _dealt(narrow, rows.select(*COURSE), most)]
    return reduce(DataFrame.unionByName, rest, first)


def _merged(rows: DataFrame, *, now: datetime) -> DataFrame:
    """Scored rows merged, one row per group."""
    c = F.col
    present = lambda n: c(n).isNotNull()
    nonzero = lambda n: F.coalesce(c(n) != 0, F.lit(False))
    some_policy = c("late_policy").isNotNull()
    usable_url = X.truthy(c("external_url")) & (c("external_url") != "#/#")

    # a row feeds either the LMS or the publisher candidates, which keeps the partial rows of the shuffle narrow
    best = lambda rows: F.min(F.when(rows, F.struct("_signals", "_at", *KEPT)))
    merged = rows.groupBy(*KEYS).agg(
        best(c("_lms")).alias("_lms_best"),
        best(~c("_lms")).alias("_pub_best"),
        F.min(F.struct(_grade_order().alias("o"), "grade", "points_possible", "points_earned")).alias("_gsrc"),
        _first(c("due_date"), c("_lms") & present("due_date"), "d").alias("_lms_due"),
        _first(c("due_date"), ~c("_lms") & present("due_date"), "d").alias("_pub_due"),
        _first(c("points_possible"), present("points_possible"), "p").alias("_pp"),
        _first(c("points_earned"), present("points_earned"), "p").alias("_pe"),
        _first(c("description"), X.truthy(c("description")), "v").alias("_desc"),
        _first(c("grade_category"), X.truthy(c("grade_category")), "v").alias("_cat"),
        _first(c("grade_weight_pct"), nonzero("grade_weight_pct"), "v").alias("_weight"),
        _first(c("estimated_minutes"), nonzero("estimated_minutes"), "v").alias("_minutes"),
        _first(c("late_policy"), some_policy, "v").alias("_policy"),
        _first(c("external_url"), usable_url, "v").alias("external_url"),
        F.min(F.struct(F.length("shown").alias("n"), F.lower("shown").alias("l"), "title", "shown"))["shown"].alias("title"),
        _status().alias("_status"),
        F.bool_or(c("_lms") & c("due_date").isNull()).alias("_lms_undated"),
        F.bool_or(c("_lms") & present("due_date")).alias("_lms_dated"),
        F.count(F.lit(1)).alias("source_count"),
        *[_raw_field(f).alias("raw_" + f) for f in RAW_FIELDS],
    ).withColumn("_pref", F.coalesce("_lms_best", "_pub_best"))

    pref, src = (lambda n: c("_pref")[n]), (lambda n: c("_gsrc")[n])
    or_first = lambda n, other: F.coalesce(X.blank_to_null(pref(n)), c(other))
    out = merged.select(
        "student_id",
        "course_id",
        "match_key",
        c("_pref._at.id").alias("id"),
        "title",
        or_first("description", "_desc").alias("description"),
        pref("type").alias("type"),
        pref("source_platform").alias("source_platform"),
        "external_url",
        F.coalesce("_lms_due", "_pub_best.due_date", "_pub_due").alias("due_date"),
        or_first("grade_category", "_cat").alias("grade_category"),
        F.coalesce(X.positive_or_missing(pref("grade_weight_pct")), c("_weight")).alias("grade_weight_pct"),
        src("grade").alias("grade_pct"),
        F.coalesce(src("points_possible"), c("_pp")).alias("points_possible"),
        F.coalesce(src("points_earned"), c("_pe")).alias("points_earned"),
        "_status",
        F.coalesce(pref("late_policy"), c("_policy")).alias("late_policy"),
        F.coalesce(F.nullif(pref("estimated_minutes"), F.lit(0)), c("_minutes")).alias("estimated_minutes"),
        *["raw_" + f for f in RAW_FIELDS],
        "source_count",
        c("_gsrc.o._at.id").alias("grade_source_id"),
        # an undated LMS row explains a missing due date as well as a dated one explains a given date
        F.when(c("_lms_dated") | (c("_lms_undated") & c("_pub_due").isNull()), LMS)
        .otherwise("best_available")
        .alias("due_source"),
    )
    status = status_after_zero(
        c("_status"), c("grade_pct"), c("points_earned"), c("points_possible"), c("due_date"), instant(now)
    )
    return out.withColumn("status", status).drop("_status")


def lineage(rows: DataFrame) -> DataFrame:
    """One row per merged source row: the inputs of each canonical row, in their order."""
    return scored(rows).select(
        *KEYS,
        "title",
        "id",
        "source_platform",
        "status",
        F.col("due_date").isNotNull().alias("has_due_date"),
        F.col("grade").isNotNull().alias("has_grade"),
        F.lit("d2l_canonical_external_fill").alias("strategy"),
    )


def merged_raw(rows: DataFrame) -> DataFrame:
    """Raw payload of each canonical row; of one field, the value of the last row in (title, id) order."""
    fields = scored(rows).where(F.size("raw") > 0).select(*KEYS, "_at", F.explode("raw").alias("field", "value"))
    latest = fields.groupBy(*KEYS, "field").agg(F.max(F.struct("_at", "value"))["value"].alias("value"))
    # the fields of a payload are the few names its source writes
    return latest.groupBy(*KEYS).agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("field", "value")))).alias("raw")
    )


def due_instant() -> Column:
    """Deadline of a canonical row: the captured ISO text when it parses, else the merged due date."""
    return F.coalesce(X.iso_instant(X.blank_to_null(F.trim("raw_due_at"))), F.col("due_date"))


def due_day(tz: str) -> Column:
    """Calendar day of the deadline: captured date, date written in the captured offset, date in the time zone."""
    captured = F.trim("raw_due_on")
    on = F.when(captured.rlike(r"^\d{4}-\d{2}-\d{2}$"), captured.try_cast("date"))
    return F.coalesce(on, X.iso_local_date(F.col("raw_due_at")), X.local_date(F.col("due_date"), tz))


def with_deadline(rows: DataFrame, *, tz: str) -> DataFrame:
    return rows.withColumns({"due_at": due_instant(), "due_day": due_day(tz)})


def attach_courses(canonical: DataFrame, courses: DataFrame, grades: DataFrame | None = None, *, facts_for: Sequence = FACTS) -> DataFrame:
    """Canonical rows with their course as a struct; a computed grade replaces the stored one.

    What rows ask of the categories of their course (`facts_for`) is worked out once per course, in as many tasks as the join has.
    """
    keys = ["student_id", "course_id"]
    facts = courses
    if grades is not None:
        computed = grades.select(*keys, F.col("final_grade_pct").alias("_computed"))
        facts = courses.join(computed, keys, "left").withColumn(
            "current_grade_pct", F.coalesce("_computed", "current_grade_pct")
        )
    wanted = [w for w in ("code", "name", "current_grade_pct", "grade_categories", "grading_scale", "syllabus_parsed") if w in facts.columns]
    facts = facts.select(*keys, *wanted)
    if grades is None:
        facts = facts.repartition(*keys)
    known = {n: f for made in facts_for if "grade_categories" in wanted for n, f in made(F.col("grade_categories")).items()}
    packed = facts.select(*keys, F.struct(*wanted, *[f.alias(n) for n, f in known.items()]).alias("course"))
    return canonical.join(packed, keys, "left")
