"""Course grades from canonical rows that carry their `course` struct.

Sums run over DECIMAL values, so the result does not depend on how rows are spread over partitions. Grouping is
always (student, course, category) first and (student, course) second; both levels pre-aggregate on the map side.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from termloom.functions import text as X
from termloom.functions.scan import ranked
from termloom.operators.categories import TYPE_ALIASES, category_weight, named_by, place
from termloom.operators.reconcile import grade_of, instant
from termloom.session import stage

EXACT = "decimal(28,8)"
COURSE = ("student_id", "course_id")

PRACTICE = "Practice tests are excluded from this course grade estimate."
ZERO_NO_DUE = "Zero score with no due date is excluded until a due time is known."
ZERO_EARLY = "Zero or missing work is excluded until the due date passes."
NO_CATEGORY = "Graded item does not match any syllabus category name for this course."
NO_SCORE = "No scored grade yet (points or percentage missing)."
NO_WEIGHT = "Has a grade but no weight in the course breakdown."
NO_SCORE_NO_WEIGHT = "No scored grade and no course weight on this row."
ZERO_NOTE = "Counted as 0% (due date passed, no score recorded)."


def exact(c: Column) -> Column:
    return c.cast(EXACT)


def categories(courses: DataFrame) -> DataFrame:
    """One row per category of a course, in list order."""
    exploded = courses.select(*COURSE, F.posexplode("grade_categories").alias("pos", "cat"))
    return exploded.select(
        *COURSE,
        "pos",
        F.col("cat.name").alias("name"),
        X.name_key(F.col("cat.name")).alias("category_key"),
        category_weight(F.col("cat.weight")).alias("weight_pct"),
    )


def past_due(now: datetime) -> Column:
    return F.coalesce(F.col("due_date") < instant(now), F.lit(False))


def is_practice() -> Column:
    return F.lower("title").contains("practice test")


def is_zero() -> Column:
    return X.meaning_zero(F.col("grade_pct"), F.col("points_earned"), F.col("points_possible"))


def counts(now: datetime) -> Column:
    """Does the row enter the course grade: no practice tests, zeros only once they are due."""
    return ~is_practice() & (~is_zero() | past_due(now))


def late_penalty(base: Column) -> Column:
    """Grade after the late policy of the row, else of the course."""
    p = lambda n: F.when(
        F.col("late_policy").isNotNull(), F.col("late_policy")[n]
    ).otherwise(F.col("course.syllabus_parsed.late_policy")[n])
    grade = F.when(base.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(100.0), base)))
    days = F.coalesce(F.col("raw_days_late").try_cast("int"), F.lit(0))
    rate = p("default_penalty_per_day")
    per_day = F.when(rate <= 1, rate * 100).otherwise(rate)
    late = F.greatest(F.lit(0.0), F.least(F.lit(100.0), F.round(grade - days * per_day, 2)))
    too_late = (p("max_late_days") >= 0) & (days > p("max_late_days"))
    return F.when(grade.isNull() | (days <= 0), grade).when(too_late, 0.0).when(rate > 0, late).otherwise(grade)


def effective_pct(now: datetime) -> Column:
    """Percentage that counts: the grade, or zero for missing work once due; null when nothing counts yet."""
    base = F.coalesce(grade_of(), F.when(past_due(now), 0.0))
    return F.when(counts(now), late_penalty(base))


def assigned_category() -> Column:
    """Key of the row's own category, else of the first course category that names its type."""
    own, hw = F.col("grade_category"), F.lower("title").startswith("hw ")
    at = place(F.col("type"), TYPE_ALIASES)
    aliases = F.array(F.lower("type"), *[F.when(F.col("type") == t, a) for t, al in TYPE_ALIASES.items() for a in al], *[F.when(hw, a) for a in TYPE_ALIASES["homework"]])
    fits = lambda c: F.exists(aliases, lambda a: named_by(c, a)) & c["key"].isNotNull()
    first = F.get(F.filter("course.graded", fits), F.lit(0))["key"]
    # a course knows its category of each type; other types and titles of other homework are compared with the names
    inferred = F.when(at.isNotNull() & ~F.coalesce(hw, F.lit(False)), F.get("course.category_of", at)).otherwise(first)
    return F.when(X.truthy(own), X.name_key(own)).otherwise(inferred)


def by_categories() -> Column:
    """Does any category of the course carry a weight."""
    return F.coalesce(F.col("course.blended"), F.lit(False))


def graded(rows: DataFrame, *, now: datetime) -> DataFrame:
    """Rows with everything the blends need."""
    return rows.withColumns(
        {
            "counted": counts(now),
            "effective_pct": effective_pct(now),
            "units": F.coalesce(X.positive_or_missing(F.col("points_possible")), F.lit(1.0)),
            "blended": by_categories(),
            "category_key": assigned_category(),
        }
    )


def _listed_weight() -> Column:
    """Weight of the row's category in the course list; null when it has none. A key listed twice counts twice."""
    fitting = F.filter("course.graded", lambda c: (c["weight_pct"] > 0) & (c["key"] == F.col("category_key")))
    return F.aggregate(fitting, F.lit(None).cast("double"), lambda a, c: F.coalesce(a, F.lit(0.0)) + c["weight_pct"])


def _category_sums(g: DataFrame, *more: Column, populations: dict[str, Column | None] | None = None) -> DataFrame:
    """Per (student, course, category): points-weighted mean and the list weight of the category.

    With `populations` (suffix -> which rows) the sums and means of each come side by side, from one pass over the rows.

    Rows of courses without category weights meet under a null category and carry row-weight sums instead. All
    buffers are numbers, so both sides of the shuffle aggregate in hash tables.
    """
    key = F.when(F.col("blended"), F.col("category_key"))
    has = F.col("effective_pct").isNotNull()
    row_weight = F.when(has & ~F.col("blended"), X.positive_or_missing(F.col("grade_weight_pct")))
    weighted = g.withColumns({"_key": key, "_listed": F.when(F.col("blended"), _listed_weight()), "_row_weight": row_weight})
    populations = populations or {"": None}
    parts = []
    for suffix, rows in populations.items():
        only = lambda c: c if rows is None else F.when(rows, c)  # noqa: B023, E731
        parts += [
            F.sum(only(exact(F.col("effective_pct") * F.col("units")))).alias("num" + suffix),
            F.sum(only(F.when(has, exact(F.col("units"))))).alias("den" + suffix),
            F.sum(only(exact(F.col("_row_weight") * (F.col("effective_pct") / 100)))).alias("row_num" + suffix),
            F.sum(only(exact(F.col("_row_weight")))).alias("row_den" + suffix),
        ]
    sums = weighted.groupBy(*COURSE, "blended", F.col("_key").alias("category_key")).agg(
        *parts,
        F.max("_listed").alias("weight_pct"),  # the same value on every row of the category
        *more,
    )
    mean = lambda s: X.rounded(F.col("num" + s).cast("double") / X.positive_or_missing(F.col("den" + s).cast("double")), 2)
    return sums.withColumns({"category_grade_pct" + s: mean(s) for s in populations})


def category_grades(rows: DataFrame, *, now: datetime) -> DataFrame:
    """Points-weighted mean per category key."""
    g = graded(rows, now=now).where("effective_pct is not null and category_key is not null")
    sums = g.groupBy(*COURSE, "category_key").agg(
        F.sum(exact(F.col("effective_pct") * F.col("units"))).alias("num"), F.sum(exact(F.col("units"))).alias("den")
    )
    mean = X.rounded(F.col("num").cast("double") / X.positive_or_missing(F.col("den").cast("double")), 2)
    return sums.select(*COURSE, "category_key", mean.alias("grade_pct"))


def course_grades(
    rows: DataFrame, *, now: datetime, populations: dict[str, Column | None] | None = None, counted: dict[str, Column] | None = None
) -> DataFrame:
    """Final grade per course: category blend where categories carry weights, else row-weight blend.

    With `populations` (suffix -> which rows) each has its grade beside the others, and `counted` (name -> which rows) adds counts of rows.
    """
    counted = counted or {}
    sums = _category_sums(graded(rows, now=now), *[F.count_if(c).alias(n) for n, c in counted.items()], populations=populations)
    totals, shown = [], []
    for s in populations or {"": None}:
        used = F.col("blended") & F.col("category_grade_pct" + s).isNotNull() & F.col("weight_pct").isNotNull()
        part = F.when(used, exact(F.col("weight_pct") * (F.col("category_grade_pct" + s) / 100)))
        weight = F.when(used, exact(F.col("weight_pct")))
        totals += [
            F.coalesce(F.sum(part), F.sum("row_num" + s), F.lit(0)).cast("double").alias("numerator" + s),
            F.coalesce(F.sum(weight), F.sum("row_den" + s), F.lit(0)).cast("double").alias("total" + s),
        ]
        final = X.rounded(F.col("numerator" + s) / X.positive_or_missing(F.col("total" + s)) * 100, 2)
        shown += [
            final.alias("final_grade_pct" + s), X.rounded(F.col("total" + s), 4).alias("total_weight_pct" + s),
            X.rounded(F.col("numerator" + s), 6).alias("numerator_weighted_points" + s),
        ]
    joined = sums.groupBy(*COURSE, "blended").agg(*totals, *[F.sum(n).alias(n) for n in counted])
    return joined.select(*COURSE, F.when(F.col("blended"), "categories").otherwise("rows").alias("basis"), *shown, *counted)


def missing_as_zero() -> Column:
    """Whether a row counts as zero for want of a score."""
    return F.col("effective_pct").isNotNull() & grade_of().isNull() & (F.col("effective_pct") == 0)


def grade_components(rows: DataFrame, *, now: datetime) -> DataFrame:
    """What the final grade is made of: one row per weighted category, or per weighted row."""
    # both kinds of components start from the same rows
    kept = ("title", "blended", "category_key", "effective_pct", "units", "grade_weight_pct", "grade_pct", "points_earned", "points_possible")
    lists = F.struct(F.col("course.graded").alias("graded")).alias("course")
    g = stage(graded(rows, now=now).select(*COURSE, *kept, lists))
    weighted = g.where("blended and category_key is not null")
    sums = _category_sums(weighted, F.any_value("course.graded").alias("cats")).where("category_grade_pct is not null")
    per_category = sums.select(
        *COURSE,
        "category_grade_pct",
        F.explode(F.filter("cats", lambda c: (c["key"] == F.col("category_key")) & (c["weight"] > 0))).alias("c"),
    ).select(
        *COURSE,
        F.lit("category").alias("component"),
        F.coalesce("c.name", F.lit("Category")).alias("name"),
        F.col("c.weight_pct").alias("weight_pct"),
        F.col("category_grade_pct").alias("grade_pct"), F.lit(None).cast("string").alias("note"),
    )
    per_row = g.where("not blended and effective_pct is not null and coalesce(grade_weight_pct, 0) <> 0").select(
        *COURSE, F.lit("assignment").alias("component"), F.col("title").alias("name"),
        F.col("grade_weight_pct").alias("weight_pct"), F.col("effective_pct").alias("grade_pct"), F.when(missing_as_zero(), ZERO_NOTE).alias("note"),
    )
    both = per_category.unionByName(per_row)
    return both.withColumn("weighted_points", X.rounded(F.col("weight_pct") * (F.col("grade_pct") / 100), 6))


def grade_members(rows: DataFrame, *, now: datetime) -> DataFrame:
    """Counted rows of each weighted category with their share of the category mean."""
    g = graded(rows, now=now)
    listed = F.exists("course.graded", lambda c: (c["key"] == F.col("category_key")) & F.coalesce(c["weight"] > 0, F.lit(False)))
    keys = [*COURSE, "category_key"]
    kept = ("id", "title", "effective_pct", "units", "grade_pct", "points_earned", "points_possible")
    # read twice: for the totals and for the shares
    members = stage(g.where(F.col("blended") & F.col("counted") & listed).select(*keys, *kept))
    # the category total is pre-aggregated and joined back: no task has to hold one whole category
    totals = members.groupBy(*keys).agg(F.sum(F.when(F.col("effective_pct").isNotNull(), exact(F.col("units")))).alias("total"))
    share = X.rounded(F.col("units") / F.col("total").cast("double") * 100, 2)
    return (
        members.join(totals.where("total > 0"), keys, "inner")
        .select(
            *keys,
            "id",
            "title",
            F.col("effective_pct").alias("grade_pct"),
            F.when(F.col("effective_pct").isNotNull(), share).alias("share_of_category_avg_pct"),
            F.col("units").alias("category_weight_units"),
            X.positive_or_missing(F.col("points_possible")).alias("points_possible"),
            "points_earned",
            F.when(missing_as_zero(), ZERO_NOTE).alias("note"),
        )
    )


def all_exclusions(rows: DataFrame, *, now: datetime) -> DataFrame:
    """Every row left out of the course grade, with the reason."""
    g = graded(rows, now=now)
    general = F.when(is_practice(), PRACTICE).when(F.col("due_date").isNull(), ZERO_NO_DUE).otherwise(ZERO_EARLY)
    listed = F.exists("course.graded", lambda c: (c["key"] == F.col("category_key")) & F.coalesce(c["weight"] > 0, F.lit(False)))
    unmatched = F.when(F.col("effective_pct").isNotNull() & ~F.coalesce(listed, F.lit(False)), NO_CATEGORY)
    weighted = X.positive_or_missing(F.col("grade_weight_pct")).isNotNull()
    scored = F.col("effective_pct").isNotNull()
    unweighted = (
        F.when(~scored & weighted, NO_SCORE).when(scored & ~weighted, NO_WEIGHT).when(~scored, NO_SCORE_NO_WEIGHT)
    )
    reason = F.when(~F.col("counted"), general).when(F.col("blended"), unmatched).otherwise(unweighted)
    # rows that do not count are listed first
    return g.select(
        *COURSE, "match_key", "id", "title", F.when(F.col("counted"), 1).otherwise(0).alias("stage"), reason.alias("reason")
    ).where("reason is not null")


def grade_exclusions(rows: DataFrame, *, now: datetime, shown: int | None = None) -> DataFrame:
    """Exclusions of each course in report order; the first `shown` if that is given."""
    numbered = ranked(all_exclusions(rows, now=now), COURSE, ["stage", "match_key"], "position")
    return (numbered if shown is None else numbered.where(F.col("position") <= shown)).select(*COURSE, "position", "title", "reason")


def exclusion_counts(rows: DataFrame, *, now: datetime, shown: int | None = None) -> DataFrame:
    """Exclusions per course, and how many of them a report of `shown` rows leaves out."""
    counted = all_exclusions(rows, now=now).groupBy(*COURSE).agg(F.count(F.lit(1)).alias("excluded_count"))
    return counted.withColumn("excluded_truncated", F.lit(0).cast("bigint") if shown is None else F.greatest(F.lit(0), F.col("excluded_count") - shown))


def grade_band(pct: Column) -> Column:
    return (
        F.when(pct.isNull(), "No grade yet").when(pct >= 90, "On track").when(pct >= 80, "Needs attention").otherwise("At risk")
    )


def band_tone(pct: Column) -> Column:
    return F.when(pct.isNull(), "neutral").when(pct >= 90, "safe").when(pct >= 80, "warning").otherwise("critical")
