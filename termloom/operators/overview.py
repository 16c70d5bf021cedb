"""Overview tables from canonical rows with course struct and deadline columns (due_at, due_day)."""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from termloom.functions import text as X
from termloom.operators import grades as G
from termloom.operators.reconcile import DONE, LMS, instant

COURSE = ["student_id", "course_id"]
DUE_SOON = 12
UPCOMING = 25


def is_relevant() -> Column:
    """Practice tests and publisher inventory nobody assigned stay out of the overview."""
    announced = X.truthy(F.col("raw_announcement_title"))
    lms = F.col("source_platform") == LMS
    return (
        F.when(G.is_practice(), False)
        .when(F.col("due_date").isNotNull() | X.truthy(F.col("grade_category")), True)
        .when(F.col("grade_pct").isNotNull() | F.col("points_earned").isNotNull(), True)
        .when(F.coalesce(F.col("points_possible") != 0, F.lit(False)), lms | announced)
        .when(announced, False)
        .otherwise(lms)
    )


def relevant(rows: DataFrame) -> DataFrame:
    return rows.where(is_relevant())


def is_open_due() -> Column:
    return F.col("due_date").isNotNull() & ~F.col("status").isin(*DONE)


def course_code() -> Column:
    return F.coalesce(F.col("course.code"), F.col("course_id"))


def due_soon(rows: DataFrame, *, n: int = DUE_SOON) -> DataFrame:
    """The next n open rows of each student."""
    order = Window.partitionBy("student_id").orderBy(
        F.asc_nulls_last("due_at"), F.lower(course_code()), F.lower("title"), "course_id", "match_key"
    )
    ranked = rows.where(is_open_due()).withColumn("position", F.row_number().over(order))
    return ranked.where(F.col("position") <= n)


def upcoming(rows: DataFrame, *, now: datetime | None = None, limit: int = UPCOMING) -> DataFrame:
    """The first dated rows of each student, from `now` on when it is given."""
    dated = rows.where("due_date is not null")
    if now is not None:
        dated = dated.where(F.col("due_date") >= instant(now))
    order = Window.partitionBy("student_id").orderBy("due_date", "title", "course_id", "match_key")
    return dated.withColumn("position", F.row_number().over(order)).where(F.col("position") <= limit)


def is_urgent(*, now: datetime, today: date) -> Column:
    """Past its deadline, or due by tomorrow's calendar day."""
    past = F.col("due_at") <= instant(now)
    near = F.date_diff(F.col("due_day"), F.lit(today)) <= 1
    return F.coalesce(past | near, F.lit(False))


def urgent_counts(rows: DataFrame, *, now: datetime, today: date) -> DataFrame:
    urgent = is_open_due() & ~G.is_practice() & is_urgent(now=now, today=today)
    return rows.groupBy("student_id").agg(F.count_if(urgent).alias("urgent_count"))


def due_iso() -> Column:
    """Deadline as text: the captured one as it stands, else the instant in UTC."""
    shown = F.date_format("due_at", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    return F.coalesce(X.blank_to_null(F.trim("raw_due_at")), shown)


def due_label(*, tz: str) -> Column:
    """'MM/dd/yy h:mm AM' on the clock of the captured offset, else of the time zone."""
    captured = F.trim("raw_due_at")
    on_its_clock = F.when(
        captured.rlike(r"T.*" + X.HAS_OFFSET) & X.iso_instant(captured).isNotNull(),
        F.regexp_replace(captured, X.HAS_OFFSET, "").try_cast("timestamp"),
    )
    return F.date_format(F.coalesce(on_its_clock, F.from_utc_timestamp("due_date", tz)), "MM/dd/yy h:mm a")


def due_labels(rows: DataFrame, *, tz: str) -> DataFrame:
    return rows.withColumns({"due_label": due_label(tz=tz), "due_iso": due_iso()})


def urgency_label(*, now: datetime, today: date) -> tuple[Column, Column]:
    """How soon a row is due, and the tone it is shown in."""
    at = X.iso_instant(due_iso())
    days = F.date_diff(F.col("due_day"), F.lit(today))
    n = days.cast("string")
    label = (
        F.when(at.isNull(), "No due date")
        .when(at <= instant(now), "Overdue")
        .when(days == 0, "Due today")
        .when(days == 1, "Due tomorrow")
        .when(days <= 3, F.concat(F.lit("Due in "), n, F.lit(" days")))
        .otherwise(F.concat(F.lit("In "), n, F.lit(" days")))
    )
    tone = (
        F.when(at.isNull(), "neutral").when(at <= instant(now), "critical").when(days <= 3, "warning").otherwise("safe")
    )
    return label, tone


def urgency_labels(rows: DataFrame, *, now: datetime, today: date) -> DataFrame:
    """Adds label and tone; the first 'Due …' reason gives way to the label."""
    label, tone = urgency_label(now=now, today=today)
    out = rows.withColumns({"urgency_label": label, "urgency_tone": tone})
    if "priority_reasons" not in rows.columns:
        return out
    hit = F.array_position(F.transform("priority_reasons", lambda r: r.startswith("Due ")), True)
    return out.withColumn(
        "priority_reasons",
        F.transform("priority_reasons", lambda r, i: F.when(i + 1 == hit, F.col("urgency_label")).otherwise(r)),
    )


def syllabus_url(d2l_url: Column, d2l_course_id: Column) -> Column:
    known = d2l_url.contains("/d2l/home/") & X.truthy(F.trim(d2l_course_id))
    site = F.regexp_extract(d2l_url, r"^(.*)/d2l/home/", 1)
    return F.when(known, F.concat(site, F.lit("/d2l/le/content/"), d2l_course_id, F.lit("/Home")))


def course_health(courses: DataFrame, rows: DataFrame, *, now: datetime) -> DataFrame:
    """Each course with its grade, band and counts. The grade uses all rows, the detail only relevant ones."""
    marked = rows.withColumn("_relevant", F.coalesce(is_relevant(), F.lit(False)))
    # both populations and the counts from one aggregate
    sums = G.course_grades(
        marked, now=now, populations={"_all": None, "_shown": F.col("_relevant")},
        counted={"_n": F.col("_relevant"), "_open": F.col("_relevant") & is_open_due()},
    )
    detail = lambda n: F.when(F.col("_n") > 0, F.col(n + "_shown"))
    joined = courses.join(sums, COURSE, "left")
    grade = F.coalesce("final_grade_pct_all", "current_grade_pct")
    return joined.select(
        *COURSE,
        "code",
        "name",
        "semester",
        "external_platform",
        "d2l_url",
        grade.alias("current_grade_pct"),
        G.grade_band(grade).alias("band"),
        G.band_tone(grade).alias("tone"),
        F.coalesce("_n", F.lit(0)).alias("assignment_count"),
        F.coalesce("_open", F.lit(0)).alias("upcoming_count"),
        syllabus_url(F.col("d2l_url"), F.col("d2l_course_id")).alias("syllabus_url"),
        detail("final_grade_pct").alias("detail_grade_pct"),
        detail("numerator_weighted_points").alias("numerator_weighted_points"),
        detail("total_weight_pct").alias("total_weight_pct"),
    )


def course_order() -> list[Column]:
    """Report order of courses."""
    return [F.col("code"), F.col("name")]


def summary(courses: DataFrame, rows: DataFrame, *, now: datetime, today: date) -> DataFrame:
    """Counts per student over the relevant rows."""
    urgent = is_open_due() & is_urgent(now=now, today=today)
    per_student = relevant(rows).groupBy("student_id").agg(
        F.count(F.lit(1)).alias("assignment_count"),
        F.count_if(is_open_due()).alias("upcoming_count"),
        F.count_if(urgent).alias("urgent_count"),
    )
    taken = courses.groupBy("student_id").agg(F.count(F.lit(1)).alias("course_count"))
    zero = lambda n: F.coalesce(n, F.lit(0)).alias(n)
    names = ("course_count", "assignment_count", "upcoming_count", "urgent_count")
    return taken.join(per_student, "student_id", "full").select("student_id", *[zero(n) for n in names])


def today_focus(items: DataFrame, *, today: date) -> DataFrame:
    """Minutes and items planned for today."""
    return items.where(F.col("agenda_date") == F.lit(today)).groupBy("student_id").agg(
        F.sum("planned_minutes").alias("today_minutes"), F.count(F.lit(1)).alias("today_items")
    )
