"""Priority, agenda and overview tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from queries import chain as C
from queries import views as V
from queries.canonical import stamp
from termloom.functions import text as X
from termloom.operators import agenda as A
from termloom.operators import grades as G
from termloom.operators import overview as O
from termloom.operators import priority as P
from termloom.session import stage

FULL = (C.CANONICAL, C.DUE, C.EFFECTIVE, C.PRIORITY)
RELEVANT = """not practice and case when due_date is not null or coalesce(grade_category, '') <> '' then true
  when grade_pct is not null or points_earned is not null then true
  when coalesce(points_possible <> 0, false) then source_platform = 'd2l' or coalesce(raw_announcement_title, '') <> ''
  when coalesce(raw_announcement_title, '') <> '' then false else source_platform = 'd2l' end"""
OPEN = "due_date is not null and status not in ('completed', 'graded', 'submitted')"
URGENT = f"coalesce(due_at <= {V.NOW_SQL} or date_diff('day', {V.TODAY_SQL}, due_day) <= 1, false)"
HORIZON, DAILY = 7, 120


def priority_scores(spark, sf):
    return C.scored_rows(spark, sf, ()).select(
        "student_id", "id", "urgency", "weight", "cutoff_gap", "impact", "late_risk", "priority_score"
    ).withColumns({c: X.rounded(F.col(c), 6) for c in ("weight", "cutoff_gap", "impact", "late_risk")})


def assignment_weight(spark, sf):
    rows = C.graded_rows(spark, sf, C.FOR_WEIGHT)
    return rows.select("student_id", "id", X.rounded(P.assignment_weight(), 6).alias("weight"), P.category_label().alias("label"))


def cutoff_gap(spark, sf):
    return C.graded_rows(spark, sf, ()).select("student_id", "id", X.rounded(P.cutoff_gap(), 6).alias("gap"))


def late_risk(spark, sf):
    return C.rows(spark, sf).select("student_id", "id", P.late_risk(P.days_left(V.TODAY)).alias("late_risk"))


def urgency(spark, sf):
    days = P.days_left(V.TODAY)
    rows = C.rows(spark, sf).where("due_day is not null")
    return rows.select("student_id", "id", P.urgency(days).alias("urgency"), P.urgency_reason(days).alias("label"))


def impact(spark, sf):
    return priority_scores(spark, sf).select("student_id", "id", "impact")


def top_reason(spark, sf):
    rows = P.priority_reasons(C.scored_rows(spark, sf, ()), limit=1)
    return rows.select("student_id", "id", F.get("priority_reasons", F.lit(0)).alias("reason"))


def reasons(spark, sf):
    rows = P.priority_reasons(C.scored_rows(spark, sf, ()))
    return rows.select("student_id", "id", F.array_join("priority_reasons", " | ").alias("reasons"))


def plan_candidates(spark, sf):
    return A.plan_candidates(C.scored_rows(spark, sf, ()), today=V.TODAY, horizon_days=HORIZON).select("student_id", "id")


def candidate_rank(spark, sf):
    ranked = A.ranked_candidates(C.scored_rows(spark, sf, ("due_at",)), today=V.TODAY, horizon_days=HORIZON)
    return ranked.select("student_id", "id", "plan_rank")


def effort(spark, sf):
    return C.graded_rows(spark, sf, ("type", "status", "estimated_minutes")).select("student_id", "id", A.effort_minutes().alias("minutes"))


def work_window(spark, sf):
    picked = A.plan_candidates(C.scored_rows(spark, sf, ("estimated_minutes",)), today=V.TODAY, horizon_days=HORIZON)
    out = A.work_window(picked, today=V.TODAY)
    return out.select(
        "student_id", "id", "minutes", F.col("window_start").cast("string").alias("window_start"),
        F.col("window_end").cast("string").alias("window_end"),
    )


def _plan(rows):
    return A.plan_agenda(rows, today=V.TODAY, horizon_days=HORIZON, daily_minutes=DAILY)


def plan_agenda(spark, sf):
    return _plan(C.relevant_scored(spark, sf)).withColumn("agenda_date", F.col("agenda_date").cast("string"))


def _shared(rows):
    """What a plan and the items it names read of the scored rows, written once for both."""
    course = F.struct(F.col("course.code").alias("code"), F.col("course.current_grade_pct").alias("current_grade_pct"))
    named = ("student_id", "course_id", "match_key", "id", "title", "type", "status", "due_at", "due_day", "estimated_minutes", "priority_score", "external_url")
    return stage(rows.select(*named, course.alias("course"), *[c for c in ("priority_reasons", "due_label") if c in rows.columns]))


def agenda_full(spark, sf):
    rows = _shared(O.due_labels(P.priority_reasons(C.relevant_scored(spark, sf)), tz=V.TZ))
    items = A.agenda_items(_plan(rows), rows)
    return items.withColumns(
        {
            "priority_reasons": F.array_join("priority_reasons", " | "), "due_at": stamp("due_at"),
            "agenda_date": F.col("agenda_date").cast("string"), "due_day": F.col("due_day").cast("string"),
        }
    )


def _fixed_plan(rows):
    """A plan that SQL can state: every candidate on its due day or today, plus a second entry for long work."""
    w = A.work_window(A.plan_candidates(rows, today=V.TODAY, horizon_days=HORIZON), today=V.TODAY)
    day = F.greatest("due_day", F.lit(V.TODAY))
    main = w.select(
        "student_id", F.col("id").alias("assignment_id"), day.alias("agenda_date"), F.least("minutes", F.lit(60)).alias("planned_minutes"),
        "priority_score", F.lit("planned").alias("notes"), F.lit(False).alias("overflow"),
    )
    rest = w.where("minutes > 60").select(
        "student_id", F.col("id").alias("assignment_id"), day.alias("agenda_date"), (F.col("minutes") - 60).alias("planned_minutes"),
        (F.col("priority_score") + 0.5).alias("priority_score"), F.lit("planned; overflow").alias("notes"), F.lit(True).alias("overflow"),
    )
    return main.unionByName(rest)


def _fixed_items(spark, sf):
    rows = _shared(C.relevant_scored(spark, sf))
    return A.agenda_items(_fixed_plan(rows), rows)


def agenda_items(spark, sf):
    items = _fixed_items(spark, sf)
    return items.select(
        "student_id", "assignment_id", F.col("agenda_date").cast("string").alias("agenda_date"), "planned_minutes",
        "priority_score", "notes", "assignment_title", "course_code", "external_url", "status", stamp("due_at").alias("due_at"),
    )


def agenda_days(spark, sf):
    days = A.agenda_days(_fixed_items(spark, sf))
    return days.withColumn("agenda_date", F.col("agenda_date").cast("string"))


def agenda_report(spark, sf):
    rows = _shared(C.relevant_scored(spark, sf))
    report = A.agenda_report(_fixed_plan(rows), rows)
    return report.withColumn("agenda_date", F.col("agenda_date").cast("string"))


def plan_counts(spark, sf):
    return A.plan_counts(_fixed_plan(_shared(C.relevant_scored(spark, sf))))


def today_focus(spark, sf):
    # items are counted and their minutes summed: of what a plan and its items are made of, only this is carried and written
    grade = F.struct(F.col("course.current_grade_pct").alias("current_grade_pct")).alias("course")
    scored = C.relevant_scored(spark, sf, ("estimated_minutes",))
    rows = stage(scored.select("student_id", "id", "title", "type", "status", "due_day", "estimated_minutes", "priority_score", grade))
    return O.today_focus(A.agenda_items(_fixed_plan(rows), rows), today=V.TODAY)


def relevant(spark, sf):
    return O.relevant(C.rows(spark, sf)).select("student_id", "id")


def due_soon(spark, sf):
    return O.due_soon(O.relevant(C.rows(spark, sf))).select("student_id", "position", "id", "title")


def upcoming(spark, sf):
    return O.upcoming(C.rows(spark, sf), now=V.NOW).select("student_id", "position", "id", stamp("due_date").alias("due_date"))


def urgent_counts(spark, sf):
    return O.urgent_counts(O.relevant(C.rows(spark, sf)), now=V.NOW, today=V.TODAY)


def urgency_labels(spark, sf):
    rows = O.urgency_labels(C.rows(spark, sf), now=V.NOW, today=V.TODAY)
    return rows.select("student_id", "id", "urgency_label", "urgency_tone")


def due_labels(spark, sf):
    return O.due_labels(C.rows(spark, sf), tz=V.TZ).select("student_id", "id", "due_label", "due_iso")


def course_health(spark, sf):
    return O.course_health(V.courses(spark, sf), C.rows(spark, sf), now=V.NOW)


def summary(spark, sf):
    return O.summary(V.courses(spark, sf), C.rows(spark, sf), now=V.NOW, today=V.TODAY)


def grade_bands(spark, sf):
    pct = F.col("current_grade_pct")
    return V.courses(spark, sf).select("student_id", "course_id", G.grade_band(pct).alias("band"), G.band_tone(pct).alias("tone"))


MINUTES = """case when estimated_minutes is not null then greatest(15, estimated_minutes) else
  case type when 'exam' then 90 when 'project' then 90 when 'lab' then 60 when 'discussion' then 30 when 'reading' then 30 else 45 end
  + case when status = 'in_progress' then 15 else 0 end + case when type = 'exam' and cur < 80 then 30 else 0 end end"""
CAND = [
    ("cand", f"""select *, {MINUTES} as minutes, date_diff('day', {V.TODAY_SQL}, due_day) as off from prio
      where status not in ('completed', 'graded', 'submitted') and due_day <= {V.TODAY_SQL} + 6"""),
    ("wcand", f"""select *, greatest(0, off - (case when type in ('exam', 'quiz') then 1 else greatest(1, least(off + 1, cast(ceil(minutes / 45.0) as int))) end - 1)) as first_day from cand"""),
    ("fixed", f"""select student_id, id as assignment_id, greatest(due_day, {V.TODAY_SQL}) as agenda_date, least(minutes, 60) as planned_minutes,
      priority_score, 'planned' as notes from cand where {RELEVANT}
      union all select student_id, id, greatest(due_day, {V.TODAY_SQL}), minutes - 60, priority_score + 0.5, 'planned; overflow' from cand where {RELEVANT} and minutes > 60"""),
    ("items", """select f.student_id, f.assignment_id, cast(agenda_date as varchar) as agenda_date, cast(sum(planned_minutes) as bigint) as planned_minutes,
      max(f.priority_score) as priority_score, min(notes) as notes, any_value(p.title) as assignment_title, any_value(p.code) as course_code,
      any_value(external_url) as external_url, any_value(status) as status, strftime(any_value(due_at), '%Y-%m-%d %H:%M:%S') as due_at
      from fixed f left join prio p on p.student_id = f.student_id and p.id = f.assignment_id group by f.student_id, f.assignment_id, agenda_date"""),
]
POL_REASON = """case when not has_pol then case when status = 'overdue' then {'l': 'Already overdue', 'c': 20.0::double} end
  when type in ('exam', 'discussion', 'quiz') and contains(exc, type) then {'l': 'No late submissions for this item type', 'c': 18.0::double}
  when acc = false or max_late = 0 then {'l': 'No late work accepted', 'c': 17.0::double}
  when penalty > 0 then {'l': cast(round(penalty * 100) as int) || '% penalty per late day', 'c': least(16.0::double, 5.0 + penalty * 100.0)}
  when days <= 1 and acc and max_late is not null then {'l': 'Only ' || max_late || ' late day' || case when max_late <> 1 then 's' else '' end || ' allowed', 'c': 10.0::double} end"""
REASONS = [
    ("reas", f"""select student_id, id, due_day, list_filter([
      {{'l': case when days <= 0 then 'Overdue' when days = 1 then 'Due within 1 day' else 'Due within ' || days || ' days' end, 'c': urgency * 0.45}},
      case when weight is not null then {{'l': coalesce(nullif(grade_category, ''), cname, upper(type[1]) || type[2:]) || ' worth about '
        || cast(round(weight * 100) as int) || '% of course grade', 'c': least(32.0::double, 8.0 + weight * 80.0)}} end,
      case when gap is not null then {{'l': printf('%.1f', gap) || ' points from the next grade cutoff', 'c': pressure}} end,
      {POL_REASON},
      case when status = 'in_progress' then {{'l': 'Already in progress', 'c': 10.0::double}} end], lambda x: x is not null) as rs from prio"""),
    ("ordered", """select student_id, id, case when due_day is not null then list_transform(list_sort(list_transform(rs, lambda x: {'c': -x.c, 'l': x.l})),
      lambda x: x.l) else [] end as labels from reas"""),
]

# the greedy pass, one (candidate, day) pair per step, all students side by side
PLANNED_ROWS = f"""(with recursive picked as (select student_id, course_id, match_key, id, title, due_at, due_day, priority_score, minutes, cast(first_day as int) as first_day,
      cast(greatest(off, first_day) as int) as last_day from wcand where {RELEVANT}),
    steps as (select *, row_number() over (partition by student_id order by priority_score desc, due_at nulls last, lower(title), course_id, match_key, day) as n
      from (select *, unnest(range(first_day, last_day + 1)) as day from picked)),
    walk as (select student_id, cast(0 as bigint) as n, [{", ".join([str(DAILY)] * HORIZON)}] as free, 0 as rest, 0 as share, cast(null as varchar) as id, cast(null as bigint) as day, false as done from (select distinct student_id from steps)
      union all select student_id, n, free[:day] || [free[day + 1] - share] || free[day + 2:], rest - share, share, id, day, day = last_day from (select w.student_id, s.n, w.free, s.id, s.day, s.last_day,
        case when s.day = s.first_day then s.minutes else w.rest end as rest, cast(case when (case when s.day = s.first_day then s.minutes else w.rest end) <= 0 or w.free[s.day + 1] <= 0 then 0 else least(
          greatest(15, ceil(ceil((case when s.day = s.first_day then s.minutes else w.rest end) / (s.last_day - s.day + 1)::double) / 15.0) * 15), w.free[s.day + 1], case when s.day = s.first_day then s.minutes else w.rest end) end as int) as share
        from walk w join steps s on s.student_id = w.student_id and s.n = w.n + 1))
    select p.student_id, p.id as assignment_id, cast(case when e.overflow then greatest(due_day, {V.TODAY_SQL}) else {V.TODAY_SQL} + cast(e.day as int) end as varchar) as agenda_date, e.minutes as planned_minutes,
      priority_score + case when e.overflow then 0.5 else 0.0 end as priority_score, 'Auto-planned for due ' || cast(due_day as varchar) || case when not e.overflow then ''
        when due_day < {V.TODAY_SQL} then '; overflow scheduled today (overdue)' else '; overflow on due date' end as notes, e.overflow
    from picked p join (select student_id, id, day, share as minutes, false as overflow from walk where share > 0 union all select student_id, id, day, rest, true from walk where done and rest > 0) e
      on e.student_id = p.student_id and e.id = p.id)"""
PLANNED = C.sql(*FULL, CAND, body="select * from " + PLANNED_ROWS)

QUERIES = {
    "priority_scores": (
        priority_scores,
        C.sql(*FULL, body="""select student_id, id, urgency, cast(round(cast(weight as decimal(28, 8)), 6) as double) as weight,
          cast(round(cast(gap as decimal(28, 8)), 6) as double) as cutoff_gap, cast(round(cast(impact as decimal(28, 8)), 6) as double) as impact,
          cast(round(cast(late_risk as decimal(28, 8)), 6) as double) as late_risk, priority_score from
          (select * replace (case when days is null then 24.0 else urgency end as urgency, case when due_day is null then 0.0 else priority_score end as priority_score) from prio)"""),
    ),
    "assignment_weight": (
        assignment_weight,
        C.sql(*FULL, body="""select student_id, id, cast(round(cast(weight as decimal(28, 8)), 6) as double) as weight,
          coalesce(nullif(grade_category, ''), cname, upper(type[1]) || type[2:]) as label from prio"""),
    ),
    "cutoff_gap": (cutoff_gap, C.sql(*FULL, body="select student_id, id, cast(round(cast(gap as decimal(28, 8)), 6) as double) as gap from prio")),
    "late_risk": (late_risk, C.sql(*FULL, body="select student_id, id, late_risk from prio")),
    "urgency": (
        urgency,
        C.sql(*FULL, body="""select student_id, id, urgency, case when days <= 0 then 'Overdue' when days = 1 then 'Due within 1 day'
          else 'Due within ' || days || ' days' end as label from prio where due_day is not null"""),
    ),
    "impact": (impact, C.sql(*FULL, body="select student_id, id, cast(round(cast(impact as decimal(28, 8)), 6) as double) as impact from prio")),
    "top_reason": (top_reason, C.sql(*FULL, REASONS, body="select student_id, id, labels[1] as reason from ordered")),
    "priority_reasons": (
        reasons, C.sql(*FULL, REASONS, body="select student_id, id, array_to_string(labels[1:3], ' | ') as reasons from ordered"),
    ),
    "plan_candidates": (plan_candidates, C.sql(*FULL, CAND, body="select student_id, id from cand")),
    "candidate_rank": (
        candidate_rank,
        C.sql(*FULL, CAND, body="""select student_id, id, row_number() over (partition by student_id order by priority_score desc, due_at nulls last,
          lower(title), course_id, match_key) as plan_rank from cand"""),
    ),
    "effort_minutes": (effort, C.sql(*FULL, body=f"select student_id, id, {MINUTES} as minutes from prio")),
    "work_window": (
        work_window,
        C.sql(*FULL, CAND, body=f"""select student_id, id, minutes, cast({V.TODAY_SQL} + cast(first_day as int) as varchar) as window_start,
          cast(greatest(due_day, {V.TODAY_SQL} + cast(first_day as int)) as varchar) as window_end from wcand"""),
    ),
    "plan_agenda": (plan_agenda, PLANNED),
    "agenda_with_reasons": (
        agenda_full,
        C.sql(*FULL, CAND, REASONS, body=f"""select e.student_id, e.agenda_date, e.assignment_id, e.planned_minutes, e.priority_score, e.notes, p.title as assignment_title,
          p.code as course_code, p.external_url, p.status, strftime(p.due_at, '%Y-%m-%d %H:%M:%S') as due_at, cast(p.due_day as varchar) as due_day,
          coalesce(array_to_string(o.labels[1:3], ' | '), '') as priority_reasons, strftime(coalesce(try_cast(substr(p.raw_due_at, 1, 19) as timestamp),
          timezone('America/Chicago', timezone('UTC', p.due_date))), '%m/%d/%y %-I:%M %p') as due_label
          from (select student_id, agenda_date, assignment_id, cast(sum(planned_minutes) as bigint) as planned_minutes, max(priority_score) as priority_score,
            arg_min(notes, overflow) as notes from {PLANNED_ROWS} group by all) e
          join prio p on p.student_id = e.student_id and p.id = e.assignment_id join ordered o on o.student_id = e.student_id and o.id = e.assignment_id
          where not contains(lower(p.title), 'practice test')"""),
    ),
    "agenda_items": (agenda_items, C.sql(*FULL, CAND, body="select * from items")),
    "agenda_days": (
        agenda_days,
        C.sql(*FULL, CAND, body="select student_id, agenda_date, cast(sum(planned_minutes) as bigint) as total_minutes, count(*) as entry_count from items group by all"),
    ),
    "agenda_report": (
        agenda_report,
        C.sql(*FULL, CAND, body="""select f.student_id, cast(agenda_date as varchar) as agenda_date, p.code as course_code, p.title, planned_minutes,
          f.priority_score, notes from fixed f left join prio p on p.student_id = f.student_id and p.id = f.assignment_id"""),
    ),
    "plan_counts": (
        plan_counts,
        C.sql(*FULL, CAND, body="""select student_id, count(*) as entries, count(distinct agenda_date) as days, count(distinct assignment_id) as assignments,
          cast(sum(planned_minutes) as bigint) as minutes from fixed group by all"""),
    ),
    "today_focus": (
        today_focus,
        C.sql(*FULL, CAND, body=f"""select student_id, cast(sum(planned_minutes) as bigint) as today_minutes, count(*) as today_items from items
          where agenda_date = cast({V.TODAY_SQL} as varchar) group by all"""),
    ),
    "relevant": (relevant, C.sql(*FULL, body=f"select student_id, id from j where {RELEVANT}")),
    "due_soon": (
        due_soon,
        C.sql(*FULL, body=f"""select student_id, position, id, title from (select *, row_number() over (partition by student_id order by due_at nulls last,
          lower(coalesce(code, course_id)), lower(title), course_id, match_key) as position from j where {RELEVANT} and {OPEN}) where position <= 12"""),
    ),
    "upcoming": (
        upcoming,
        C.sql(*FULL, body=f"""select student_id, position, id, strftime(due_date, '%Y-%m-%d %H:%M:%S') as due_date from (select *, row_number() over (
          partition by student_id order by due_date, title, course_id, match_key) as position from j where due_date >= {V.NOW_SQL}) where position <= 25"""),
    ),
    "urgent_counts": (
        urgent_counts,
        C.sql(*FULL, body=f"select student_id, count(*) filter (where {OPEN} and {URGENT}) as urgent_count from j where {RELEVANT} group by all"),
    ),
    "urgency_labels": (
        urgency_labels,
        C.sql(*FULL, body=f"""select student_id, id, case when due_at is null then 'No due date' when due_at <= {V.NOW_SQL} then 'Overdue' when d = 0 then 'Due today'
          when d = 1 then 'Due tomorrow' when d <= 3 then 'Due in ' || d || ' days' else 'In ' || d || ' days' end as urgency_label,
          case when due_at is null then 'neutral' when due_at <= {V.NOW_SQL} then 'critical' when d <= 3 then 'warning' else 'safe' end as urgency_tone
          from (select *, date_diff('day', {V.TODAY_SQL}, due_day) as d from j)"""),
    ),
    "due_labels": (
        due_labels,
        C.sql(*FULL, body="""select student_id, id, strftime(coalesce(try_cast(substr(raw_due_at, 1, 19) as timestamp),
          timezone('America/Chicago', timezone('UTC', due_date))), '%m/%d/%y %-I:%M %p') as due_label,
          coalesce(raw_due_at, strftime(due_at, '%Y-%m-%dT%H:%M:%SZ')) as due_iso from j"""),
    ),
    "summary": (
        summary,
        C.sql(*FULL, body=f"""select student_id, course_count, coalesce(assignment_count, 0) as assignment_count, coalesce(upcoming_count, 0) as upcoming_count,
          coalesce(urgent_count, 0) as urgent_count from (select student_id, count(*) as course_count from crs group by all) c
          full join (select student_id, count(*) as assignment_count, count(*) filter (where {OPEN}) as upcoming_count,
            count(*) filter (where {OPEN} and {URGENT}) as urgent_count from j where {RELEVANT} group by all) a using (student_id)"""),
    ),
    "grade_band": (
        grade_bands,
        V.with_views() + """select student_id, course_id, case when current_grade_pct >= 90 then 'On track' when current_grade_pct >= 80 then 'Needs attention'
          else 'At risk' end as band, case when current_grade_pct >= 90 then 'safe' when current_grade_pct >= 80 then 'warning' else 'critical' end as tone from crs""",
    ),
}
