"""Canonical rows, deadlines and course grades."""

from __future__ import annotations

from pyspark.sql import functions as F

from queries import chain as C
from queries import views as V
from termloom.operators import grades as G
from termloom.operators import reconcile as R

stamp = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss")
STAMP = "strftime({0}, '%Y-%m-%d %H:%M:%S')"
CANON_OUT = (
    "student_id, course_id, match_key, id, title, description, type, source_platform, external_url,"
    " strftime(due_date, '%Y-%m-%d %H:%M:%S') as due_date, grade_category, grade_weight_pct, grade_pct, points_possible,"
    " points_earned, status, estimated_minutes, raw_due_at, raw_due_on, raw_days_late, raw_announcement_title,"
    " source_count, grade_source_id, due_source, pol_accepts, pol_penalty, pol_max"
)


def canonical_assignments(spark, sf):
    out = C.canonical(spark, sf)
    p = lambda n: F.col("late_policy")[n]
    return out.withColumns(
        {
            "due_date": stamp("due_date"), "pol_accepts": p("accepts_late"),
            "pol_penalty": p("default_penalty_per_day"), "pol_max": p("max_late_days"),
        }
    ).drop("late_policy")


def lineage(spark, sf):
    return R.lineage(V.assignments(spark, sf))


def merged_raw(spark, sf):
    raw = R.merged_raw(V.assignments(spark, sf))
    return raw.select(*R.KEYS, F.explode("raw").alias("field", "value"))


def zero_means_missing(spark, sf):
    rows = V.assignments(spark, sf).withColumn("is_submitted", F.col("status") == "graded")
    out = R.zero_means_missing(rows.withColumn("grade_pct", R.grade_of()), now=V.NOW)
    return out.select("student_id", "id", "status", "is_submitted", "grade_pct")


def deadlines(spark, sf):
    dated = R.with_deadline(C.canonical(spark, sf), tz=V.TZ)
    return dated.select("student_id", "id", stamp("due_at").alias("due_at"), F.col("due_day").cast("string").alias("due_day"))


def row_grades(spark, sf):
    return V.assignments(spark, sf).select("student_id", "id", R.grade_of().alias("grade"))


def rollups(spark, sf):
    docs = V.table(spark, sf, "lineitem").select(
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("id"),
        F.concat(
            F.element_at(F.array(*[F.lit(t) for t in ROLLUP_TITLES]), (F.col("l_partkey") % 6 + 1).cast("int")),
            F.lit(" "), F.col("l_linenumber").cast("string"),
        ).alias("title"),
    )
    return R.drop_rollups(docs).distinct()


ROLLUP_TITLES = ("Final Calculated Grade", "Course total", "Participation current grade", "Upgrade total", "Lab", "WEIGHTED TOTAL:")
TITLES_SQL = "[" + ", ".join(f"'{t}'" for t in ROLLUP_TITLES) + "]"


def course_grades(spark, sf):
    return G.course_grades(C.rows(spark, sf), now=V.NOW)


def course_grades_rows(spark, sf):
    return course_grades(spark, sf).where("basis = 'rows'")


def category_grades(spark, sf):
    return G.category_grades(C.rows(spark, sf), now=V.NOW)


def effective(spark, sf):
    g = G.graded(C.rows(spark, sf), now=V.NOW)
    return g.select("student_id", "id", "counted", "effective_pct", "units", "blended", "category_key")


def categories(spark, sf):
    return G.categories(V.courses(spark, sf))


def grade_components(spark, sf):
    return G.grade_components(C.rows(spark, sf), now=V.NOW)


def grade_members(spark, sf):
    return G.grade_members(C.rows(spark, sf), now=V.NOW).select(
        "student_id", "course_id", "category_key", "id", "grade_pct", "share_of_category_avg_pct", "category_weight_units", "note"
    )


def grade_exclusions(spark, sf):
    return G.grade_exclusions(C.rows(spark, sf), now=V.NOW)


def exclusion_counts(spark, sf):
    return G.exclusion_counts(C.rows(spark, sf), now=V.NOW, shown=40)


EXCLUDED = """select student_id, course_id, match_key, title, case when counted then 1 else 0 end as stage, case
    when not counted then case when practice then 'Practice tests are excluded from this course grade estimate.'
      when due_date is null then 'Zero score with no due date is excluded until a due time is known.'
      else 'Zero or missing work is excluded until the due date passes.' end
    when blended then case when eff is not null and not exists (select 1 from catk k where k.course_no = e2.course_no
        and k.category_key = e2.category_key and k.weight_pct is not null)
      then 'Graded item does not match any syllabus category name for this course.' end
    when eff is null and grade_weight_pct <> 0 then 'No scored grade yet (points or percentage missing).'
    when eff is not null and coalesce(grade_weight_pct, 0) = 0 then 'Has a grade but no weight in the course breakdown.'
    when eff is null then 'No scored grade and no course weight on this row.' end as reason from e2"""

GRADED = (C.CANONICAL, C.DUE, C.EFFECTIVE)

QUERIES = {
    "canonical_assignments": (canonical_assignments, C.sql(C.CANONICAL, body=f"select {CANON_OUT} from canon")),
    "canonical_lineage": (
        lineage,
        C.sql(C.CANONICAL, body="""select student_id, course_id, match_key, title, id, source_platform, status, due_date is not null as has_due_date,
          grade is not null as has_grade, 'd2l_canonical_external_fill' as strategy from r"""),
    ),
    "canonical_raw": (
        merged_raw,
        C.sql(C.CANONICAL, body="""select student_id, course_id, match_key, field, value from (
          select student_id, course_id, match_key, 'due_at' as field, raw_due_at as value from m union all
          select student_id, course_id, match_key, 'due_on', raw_due_on from m union all
          select student_id, course_id, match_key, 'days_late', raw_days_late from m union all
          select student_id, course_id, match_key, 'announcement_title', raw_announcement_title from m) where value is not null"""),
    ),
    "zero_means_missing": (
        zero_means_missing,
        C.sql(C.CANONICAL, body=f"""select student_id, id, case when z and status in ('graded', 'in_progress') then
          case when coalesce(due_date < {V.NOW_SQL}, false) then 'overdue' else 'upcoming' end else status end as status,
          status = 'graded' and not z as is_submitted, grade as grade_pct
          from (select *, coalesce(grade <= 0, false) or coalesce(points_earned <= 0 and points_possible > 0, false) as z from r)"""),
    ),
    "drop_rollups": (
        rollups,
        rf"""select distinct id, title from (select concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) as id,
          ({TITLES_SQL})[l_partkey % 6 + 1] || ' ' || l_linenumber as title from lineitem)
          where not (regexp_matches(title, '\b(final calculated grade|current grade|course total|total grade|weighted total|final grade)\b', 'i')
          and not regexp_matches(lower(title), 'attendance|participation|discussion'))""",
    ),
    "grade_pct": (
        row_grades,
        V.with_views() + "select student_id, id, coalesce(round(points_earned / nullif(points_possible, 0) * 100, 2), grade_pct) as grade from asg",
    ),
    "deadlines": (
        deadlines,
        C.sql(C.CANONICAL, C.DUE, body="select student_id, id, strftime(due_at, '%Y-%m-%d %H:%M:%S') as due_at, cast(due_day as varchar) as due_day from dl"),
    ),
    "effective_pct": (
        effective,
        C.sql(*GRADED, body="select student_id, id, counted, eff as effective_pct, units, blended, category_key from e2"),
    ),
    "course_categories": (
        categories,
        C.sql(*GRADED, body="select student_id, course_id, pos, catk.name, category_key, weight_pct from catk join crs using (course_no)"),
    ),
    "category_grades": (
        category_grades,
        C.sql(*GRADED, body=f"""select student_id, course_id, category_key, {C.MEAN} as grade_pct
          from e2 where eff is not null and category_key is not null group by all"""),
    ),
    "course_grades": (course_grades, C.sql(*GRADED, body="select * from finals")),
    "course_grades_rows": (course_grades_rows, C.sql(*GRADED, body="select * from finals where basis = 'rows'")),
    "grade_components": (
        grade_components,
        C.sql(*GRADED, body="""select *, cast(round(cast(weight_pct * (grade_pct / 100) as decimal(28, 8)), 6) as double) as weighted_points from (
          select student_id, course_id, 'category' as component, name, weight_pct, cgrade as grade_pct, cast(null as varchar) as note from comp union all
          select student_id, course_id, 'assignment', title, grade_weight_pct, eff,
            case when eff = 0 and shown_grade is null then 'Counted as 0% (due date passed, no score recorded).' end from e2
          where not blended and eff is not null and grade_weight_pct <> 0)"""),
    ),
    "grade_members": (
        grade_members,
        C.sql(*GRADED, body="""select student_id, course_id, category_key, id, eff as grade_pct,
          case when eff is not null then cast(round(cast(units / total * 100 as decimal(28, 8)), 2) as double) end as share_of_category_avg_pct, units as category_weight_units,
          case when eff = 0 and shown_grade is null then 'Counted as 0% (due date passed, no score recorded).' end as note
          from (select *, cast(sum(case when eff is not null then cast(units as decimal(28, 8)) end) over (partition by student_id, course_id, category_key) as double) as total
            from e2 where blended and counted and exists (select 1 from catk k where k.course_no = e2.course_no and k.category_key = e2.category_key and k.weight_pct is not null))
          where total > 0"""),
    ),
    "grade_exclusions": (
        grade_exclusions,
        C.sql(*GRADED, body=f"""select student_id, course_id, position, title, reason from (select *, cast(row_number() over (
          partition by student_id, course_id order by stage, match_key) as int) as position from ({EXCLUDED}) where reason is not null)"""),
    ),
    "exclusion_counts": (
        exclusion_counts,
        C.sql(*GRADED, body=f"""select student_id, course_id, count(*) as excluded_count, greatest(0, count(*) - 40) as excluded_truncated
          from ({EXCLUDED}) where reason is not null group by all"""),
    ),
}
