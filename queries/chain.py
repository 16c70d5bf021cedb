"""SQL side of the chain canonical rows -> grades -> priority -> plan, as CTEs shared by many queries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

from queries import views as V
from termloom.operators import categories, grades, overview, priority, reconcile
from termloom.session import stage

# half-up rounding of the decimal value
MEAN = """cast(round(cast(cast(sum(cast(eff * units as decimal(28, 8))) as double)
  / nullif(cast(sum(cast(units as decimal(28, 8))) as double), 0) as decimal(28, 8)), 2) as double)"""
NOW, TODAY = V.NOW_SQL, V.TODAY_SQL
G = "student_id, course_id, match_key"

DISPLAY = [
    ("k1", r"""select *, trim(regexp_replace(regexp_replace(title, '([a-z0-9])([A-Z])', '\1 \2', 'g'), '\s+', ' ', 'g')) as t1
      from {source}"""),
    ("k2", r"""select *, list_transform(string_split(bare, ':'), lambda x: trim(x)) as parts from (select *,
      trim(regexp_replace(t1, '(submitted|not started|in progress|grading in progress|counts towards grade).*$', '', 'i'), ' :-|') as bare from k1)"""),
    ("k3", r"""select *, case when len(parts) >= 2 and regexp_matches(parts[2], '^unit\b.*\b(?:code|apply)\b', 'i') then parts[1]
      when len(parts) >= 4 and lower(parts[1]) = 'pre-requisite' then parts[1] || ': ' || parts[2] else bare end as cut from k2"""),
    ("k4", r"""select *, coalesce(nullif(trim(regexp_replace(cut, '\b(?:due|in class)\b$', '', 'i'), ' :-'), ''), title) as shown from k3"""),
    ("k5", r"""select * exclude (t1, bare, parts, cut), coalesce(
      'programming-exercise-' || replace(nullif(regexp_extract(title, 'programming\s+exercise\s+(\d+(?:\.\d+)?)', 1, 'i'), ''), '.', '-'),
      nullif(trim(regexp_replace(trim(regexp_replace(lower(shown), '\b(?:due|in class)\b$', '', 'i'), ' :-'), '[^a-z0-9]+', '-', 'g'), '-'), ''),
      'item') as match_key from k4"""),
]


def display_ctes(source: str) -> list[tuple[str, str]]:
    return [(n, q.replace("{source}", source)) for n, q in DISPLAY]


KEPT = r"""(select * from asg where not (regexp_matches(title,
  '\b(final calculated grade|current grade|course total|total grade|weighted total|final grade)\b', 'i')
  and not regexp_matches(lower(title), 'attendance|participation|discussion')))"""

CANONICAL = [
    *display_ctes(KEPT),
    ("r", f"""select *, row_number() over (partition by {G} order by title, id) as rn, source_platform = 'd2l' as lms,
      coalesce(round(points_earned / nullif(points_possible, 0) * 100, 2), grade_pct) as grade from k5"""),
    ("p", f"""select *,
      row_number() over (partition by {G} order by case when lms then 0 else 1 end,
        case when grade is not null or points_earned is not null then 0 else 1 end,
        case when estimated_minutes is not null then 0 else 1 end, case when due_date is not null then 0 else 1 end, rn) as pr,
      row_number() over (partition by {G} order by case when lms then 1 else 0 end,
        case when grade is not null or points_earned is not null then 0 else 1 end,
        case when estimated_minutes is not null then 0 else 1 end, case when due_date is not null then 0 else 1 end, rn) as ar,
      row_number() over (partition by {G} order by case when grade is not null then 0 else 1 end,
        cast(round(coalesce(nullif(grade, 0), -1) * 100) as bigint) desc, case when lms then 1 else 0 end,
        case when points_earned is not null or points_possible is not null then 0 else 1 end, last_scraped desc nulls last, rn) as gr,
      case status when 'overdue' then 5 when 'in_progress' then 4 when 'upcoming' then 3 when 'completed' then 2
        when 'graded' then 2 when 'submitted' then 2 when 'available' then 1 else 0 end as sr from r"""),
    ("m", f"""select {G}, max(case when pr = 1 then id end) as id, arg_min(shown, (length(shown), lower(shown), rn)) as title,
      coalesce(nullif(max(case when pr = 1 then description end), ''), arg_min(description, rn) filter (where description <> '')) as description,
      max(case when pr = 1 then type end) as type, max(case when pr = 1 then source_platform end) as source_platform,
      arg_min(external_url, rn) filter (where external_url <> '' and external_url <> '#/#') as external_url,
      coalesce(arg_min(due_date, rn) filter (where lms and due_date is not null), max(case when ar = 1 then due_date end),
        arg_min(due_date, rn) filter (where due_date is not null)) as due_date,
      coalesce(nullif(max(case when pr = 1 then grade_category end), ''), arg_min(grade_category, rn) filter (where grade_category <> '')) as grade_category,
      coalesce(nullif(max(case when pr = 1 then grade_weight_pct end), 0), arg_min(grade_weight_pct, rn) filter (where grade_weight_pct <> 0)) as grade_weight_pct,
      max(case when gr = 1 then grade end) as grade_pct,
      coalesce(max(case when gr = 1 then points_possible end), arg_min(points_possible, rn) filter (where points_possible is not null)) as points_possible,
      coalesce(max(case when gr = 1 then points_earned end), arg_min(points_earned, rn) filter (where points_earned is not null)) as points_earned,
      case when bool_or(status in ('completed', 'graded', 'submitted') and not lms) then 'completed'
        when bool_or(status = 'in_progress') then 'in_progress' when bool_or(status = 'overdue') then 'overdue'
        when bool_or(status = 'upcoming') then 'upcoming' else arg_min(status, (-sr, rn)) end as st,
      coalesce(max(case when pr = 1 and lp_accepts is not null then pr end), 0) = 1 as own_policy,
      max(case when pr = 1 then lp_accepts end) as pa, max(case when pr = 1 then lp_penalty end) as pp, max(case when pr = 1 then lp_max_days end) as pm,
      arg_min(lp_accepts, rn) filter (where lp_accepts is not null) as fa, arg_min(lp_penalty, rn) filter (where lp_accepts is not null) as fp,
      arg_min(lp_max_days, rn) filter (where lp_accepts is not null) as fm,
      coalesce(nullif(max(case when pr = 1 then estimated_minutes end), 0), arg_min(estimated_minutes, rn) filter (where estimated_minutes <> 0)) as estimated_minutes,
      arg_max(raw_due_at, rn) filter (where raw_due_at is not null) as raw_due_at,
      arg_max(raw_due_on, rn) filter (where raw_due_on is not null) as raw_due_on,
      arg_max(raw_days_late, rn) filter (where raw_days_late is not null) as raw_days_late,
      arg_max(raw_announcement_title, rn) filter (where raw_announcement_title is not null) as raw_announcement_title,
      count(*) as source_count, max(case when gr = 1 then id end) as grade_source_id, bool_or(lms and due_date is not null) as ld,
      bool_or(lms) as has_lms from p group by {G}"""),
    ("canon", f"""select {G}, id, title, description, type, source_platform, external_url, due_date, grade_category, grade_weight_pct,
      grade_pct, points_possible, points_earned,
      case when (coalesce(grade_pct <= 0, false) or coalesce(points_earned <= 0 and points_possible > 0, false))
        and st in ('graded', 'completed', 'submitted', 'in_progress')
        then case when coalesce(due_date < {NOW}, false) then 'overdue' else 'upcoming' end else st end as status,
      case when own_policy then pa else fa end as pol_accepts, case when own_policy then pp else fp end as pol_penalty,
      case when own_policy then pm else fm end as pol_max, estimated_minutes, raw_due_at, raw_due_on, raw_days_late,
      raw_announcement_title, source_count, grade_source_id,
      case when ld or (has_lms and due_date is null) then 'd2l' else 'best_available' end as due_source from m"""),
]

# rows with their course, deadline and grade-relevant facts; current grade is the stored one
DUE = [
    ("dl", """select c.*, coalesce(timezone('UTC', cast(raw_due_at as timestamptz)), due_date) as due_at,
      coalesce(cast(raw_due_on as date), cast(substr(raw_due_at, 1, 10) as date),
        cast(timezone('America/Chicago', timezone('UTC', due_date)) as date)) as due_day from canon c"""),
    ("j", f"""select dl.*, k.course_no, k.code, k.current_grade_pct as stored_grade, k.cp_accepts, k.cp_penalty, k.cp_max_days, k.cp_exceptions, k.cp_known,
      coalesce(due_date < {NOW}, false) as past, lower(title) like '%practice test%' as practice,
      (coalesce(grade_pct <= 0, false) or coalesce(points_earned <= 0 and points_possible > 0, false)) as zero,
      coalesce(round(points_earned / nullif(points_possible, 0) * 100, 2), grade_pct) as shown_grade,
      case when pol_accepts is not null then pol_penalty else cp_penalty end as penalty,
      case when pol_accepts is not null then pol_max else cp_max_days end as max_late,
      coalesce(try_cast(raw_days_late as int), 0) as days_late
      from dl left join course k using (student_id, course_id)"""),
]

EFFECTIVE = [
    ("e0", """select *, not practice and (not zero or past) as counted, coalesce(shown_grade, case when past then 0.0 end) as base,
      coalesce(nullif(points_possible, 0), 1.0) as units from j"""),
    ("e1", """select *, case when counted and base is not null then
        case when days_late <= 0 then greatest(0.0, least(100.0, base))
          when max_late >= 0 and days_late > max_late then 0.0
          when penalty > 0 then greatest(0.0, least(100.0, round(greatest(0.0, least(100.0, base))
            - days_late * case when penalty <= 1 then penalty * 100 else penalty end, 2)))
          else greatest(0.0, least(100.0, base)) end end as eff,
      case type when 'homework' then ['homework', 'hw', 'exercise', 'assignment', 'problem'] when 'exam' then ['exam', 'quiz', 'test']
        else [type] end as aliases from e0"""),
    ("fits", """select student_id, course_id, match_key, arg_min(name, pos) as cname from e1 join cat using (course_no)
      where len(list_filter(aliases, lambda a: contains(lower(name), a) or contains(a, lower(name)))) > 0 group by all"""),
    ("e2", r"""select e1.*, exists (select 1 from cat where cat.course_no = e1.course_no and weight > 0) as blended,
      nullif(trim(regexp_replace(lower(case when grade_category <> '' then grade_category else cname end), '[^a-z0-9]+', '-', 'g'), '-'), '') as category_key
      from e1 left join fits using (student_id, course_id, match_key)"""),
    ("catk", r"""select *, nullif(trim(regexp_replace(lower(name), '[^a-z0-9]+', '-', 'g'), '-'), '') as category_key,
      case when weight > 0 then case when weight <= 1.5 then round(weight * 100, 4) else weight end end as weight_pct from cat"""),
    ("cg", f"""select student_id, course_id, course_no, category_key, {MEAN} as cgrade
      from e2 where blended and eff is not null and category_key is not null group by all"""),
    ("comp", """select student_id, course_id, name, weight_pct, cgrade from cg join catk using (course_no, category_key) where weight_pct is not null"""),
    ("fin", """select student_id, course_id, blended, coalesce(cast(case when blended then
        (select sum(cast(weight_pct * (cgrade / 100) as decimal(28, 8))) from comp where comp.student_id = x.student_id and comp.course_id = x.course_id)
        else rn end as double), 0) as num, coalesce(cast(case when blended then
        (select sum(cast(weight_pct as decimal(28, 8))) from comp where comp.student_id = x.student_id and comp.course_id = x.course_id)
        else rd end as double), 0) as den from (select student_id, course_id, blended,
          sum(cast(grade_weight_pct * (eff / 100) as decimal(28, 8))) filter (where grade_weight_pct <> 0 and eff is not null) as rn,
          sum(cast(grade_weight_pct as decimal(28, 8))) filter (where grade_weight_pct <> 0 and eff is not null) as rd
        from e2 group by all) x"""),
    ("finals", """select student_id, course_id, case when blended then 'categories' else 'rows' end as basis,
      cast(round(cast(num / nullif(den, 0) * 100 as decimal(28, 8)), 2) as double) as final_grade_pct,
      cast(round(cast(den as decimal(28, 8)), 4) as double) as total_weight_pct, cast(round(cast(num as decimal(28, 8)), 6) as double) as numerator_weighted_points from fin"""),
]

PRIORITY = [
    ("q0", f"""select j.*, coalesce(f.final_grade_pct, stored_grade) as cur, date_diff('day', {TODAY}, due_day) as days,
      case when grade_weight_pct between 0 and 1 then grade_weight_pct when grade_weight_pct <= 100 then grade_weight_pct / 100.0 end as direct
      from j left join finals f using (student_id, course_id)"""),
    ("hits", """select q0.student_id, q0.course_id, q0.match_key,
        max(case when weight between 0 and 1 then weight when weight <= 100 then weight / 100.0 end) as w,
        arg_min(name, pos) as cname from q0 join cat using (course_no) where
        (coalesce(grade_category, '') <> '' and (contains(lower(name), lower(grade_category)) or contains(lower(grade_category), lower(name))))
        or len(list_filter(case type when 'homework' then ['homework', 'programming exercise', 'mindtap', 'mylab', 'assignment', 'problem']
          when 'lab' then ['lab', 'laboratory'] when 'exam' then ['exam', 'quiz', 'test'] when 'project' then ['project', 'paper']
          when 'discussion' then ['discussion'] when 'reading' then ['reading', 'chapter'] else [type] end, lambda h: contains(lower(name), h))) > 0
        or (contains(lower(title), lower(name)) and length(name) >= 4) group by all"""),
    ("gaps", """select student_id, course_id, match_key, min(lo - cur) as gap from q0 join (select * from (values
        (0, 90.0), (0, 80.0), (0, 70.0), (1, 90.0), (1, 80.0)) as s(course_no, lo)) using (course_no) where lo > cur group by all"""),
    ("q1", """select q0.*, cname, case when direct is not null and coalesce(grade_category, '') <> '' then direct else coalesce(w, direct) end as weight,
      case when gap > 0 and gap <= 5 then cast(gap as double) end as gap from q0 left join hits using (student_id, course_id, match_key)
      left join gaps using (student_id, course_id, match_key)"""),
    ("q2", """select *, case when days <= 0 then 100.0 when days = 1 then 92.0 when days = 2 then 82.0 else greatest(24.0, 72.0 - (days - 3) * 10.0) end::double as urgency,
      case type when 'exam' then 80.0 when 'project' then 68.0 when 'lab' then 52.0 when 'homework' then 45.0 when 'discussion' then 30.0
        when 'reading' then 24.0 else 40.0 end::double as ib,
      case when gap is null then 0.0 else greatest(2.0::double, 12.0 - gap * 2.0) * case when weight is null then 1.0::double
        else least(1.5::double, greatest(0.75::double, 1.0 + weight)) end end as pressure,
      pol_accepts is not null or coalesce(cp_known, false) as has_pol,
      case when pol_accepts is not null then pol_accepts else cp_accepts end as acc,
      case when pol_accepts is not null then '' else coalesce(cp_exceptions, '') end as exc from q1"""),
    ("q3", """select *, least(100.0::double, case when weight is null then ib else greatest(ib, least(100.0::double, 24.0 + weight * 220.0)) end
        + case when cur < 80 and type in ('exam', 'project') then 8.0 when cur < 80 and weight >= 0.15 then 6.0 else 0.0 end
        + case when points_possible >= 100 then 3.0 else 0.0 end + pressure) as impact,
      least(100.0::double, greatest(0.0::double, case when not has_pol then 55.0
          when type in ('exam', 'discussion', 'quiz') and contains(exc, type) then 96.0
          when acc = false or max_late = 0 then 92.0
          else case when acc then 30.0 else 55.0 end
            + case when penalty is not null then least(35.0::double, penalty * 1000.0) when acc then 0.0 else 8.0 end
            + case when max_late <= 1 then 25.0 when max_late <= 3 then 15.0 when max_late <= 5 then 8.0 else 0.0 end
            - case when acc and coalesce(penalty, 0) <= 0.01 and coalesce(nullif(max_late, 0), 999) >= 5 then 10.0 else 0.0 end end
        + case when days <= 0 then 10.0 when days <= 1 then 8.0 when days <= 3 then 4.0 else 0.0 end
        + case when status = 'overdue' then 10.0 else 0.0 end)) as late_risk from q2"""),
    ("prio", """select *, case when due_day is null then 0.0 else cast(round(cast(least(100.0::double, urgency * 0.45 + impact * 0.30 + late_risk * 0.15
        + case when status = 'in_progress' then 100.0 else 0.0 end * 0.10 + case when type = 'exam' then 5.0 else 0.0 end) as decimal(28, 8)), 2) as double) end as priority_score from q3"""),
]


def canonical(spark: SparkSession, sf: str) -> DataFrame:
    return reconcile.canonical_assignments(V.assignments(spark, sf), now=V.NOW)


def rows(spark: SparkSession, sf: str) -> DataFrame:
    """Canonical rows with deadline and course as stored."""
    dated = reconcile.with_deadline(canonical(spark, sf), tz=V.TZ)
    return reconcile.attach_courses(dated, V.courses(spark, sf))


# what course grades, the weight and the priority of a row are made of
FOR_GRADES = (
    "title", "type", "due_date", "grade_category", "grade_weight_pct", "grade_pct", "points_earned", "points_possible", "late_policy", "raw_days_late",
)
FOR_WEIGHT = ("title", "type", "grade_category", "grade_weight_pct")
FOR_PRIORITY = (*FOR_WEIGHT, "points_possible", "late_policy", "status", "due_day")


def graded_rows(spark: SparkSession, sf: str, only: Sequence[str] | None = None) -> DataFrame:
    """The same rows with the computed course grade in place of the stored one; with `only`, their keys, ids and these columns."""
    dated = reconcile.with_deadline(canonical(spark, sf), tz=V.TZ)
    kept = [c for c in dated.columns if only is None or c in (*reconcile.KEYS, "id", *only)]
    # grades and rows both start from the canonical rows
    dated = stage(dated.select(*[c for c in dated.columns if c in (*kept, *FOR_GRADES)]))
    courses = V.courses(spark, sf)
    final = grades.course_grades(reconcile.attach_courses(dated, courses, facts_for=[categories.for_grades]), now=V.NOW)
    return reconcile.attach_courses(dated.select(*kept), courses, final, facts_for=[categories.for_weights])


def scored_rows(spark: SparkSession, sf: str, only: Sequence[str] | None = None) -> DataFrame:
    """Rows with their priority; with `only`, of the columns that it is not made of these alone."""
    wanted = None if only is None else (*FOR_PRIORITY, *only)
    return priority.priority_scores(graded_rows(spark, sf, wanted), today=V.TODAY)


# what tells a relevant row from others, besides the columns a priority is made of
FOR_RELEVANT = ("due_date", "grade_pct", "points_earned", "raw_announcement_title", "source_platform")


def relevant_scored(spark: SparkSession, sf: str, only: Sequence[str] | None = None) -> DataFrame:
    """Relevant rows with their priority; with `only`, of the columns that neither is made of these alone."""
    return overview.relevant(scored_rows(spark, sf, only and (*FOR_RELEVANT, *only)))


def sql(*parts: list[tuple[str, str]], body: str) -> str:
    return V.with_views(*[cte for part in parts for cte in part]) + body
