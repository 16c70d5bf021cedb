"""Work plan: open canonical rows spread greedily over the coming days of each student.

The greedy pass is sequential, but only a bounded head of each student's candidates can take capacity. Within the
candidates that share one window of days, those that receive minutes are a prefix of the priority order, because a
candidate comes away empty only when every day of its window is full, and full days stay full. The first allocation
of a candidate takes at least MIN_MINUTES or fills its day, so the prefix has at most
days x (daily_minutes / MIN_MINUTES + 1) members. Only that head runs through the sequential pass; all other candidates
are overflow and never meet in one task.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import date, datetime, timedelta
from zoneinfo import ZoneInfo

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from termloom.functions import text as X
from termloom.functions.scan import ranked
from termloom.operators.priority import lookup
from termloom.operators.reconcile import DONE
from termloom.session import stage

MIN_MINUTES = 15
# Minutes planned per assignment type when nothing better is known.
TYPE_MINUTES = {"exam": 90, "project": 90, "lab": 60, "discussion": 30, "reading": 30, "homework": 45}


def local_today(now: datetime, tz: str) -> date:
    return now.astimezone(ZoneInfo(tz)).date()


def effort_minutes() -> Column:
    own = F.greatest(F.lit(MIN_MINUTES), F.col("estimated_minutes"))
    base = lookup(F.col("type"), TYPE_MINUTES, F.lit(45))
    started = F.when(F.col("status") == "in_progress", 15).otherwise(0)
    weak = F.when((F.col("type") == "exam") & (F.col("course.current_grade_pct") < 80), 30).otherwise(0)
    return F.when(F.col("estimated_minutes").isNotNull(), own).otherwise(base + started + weak).cast("int")


def plan_candidates(rows: DataFrame, *, today: date, horizon_days: int) -> DataFrame:
    """Open rows due inside the horizon or already past due."""
    last = today + timedelta(days=horizon_days - 1)
    return rows.where(~F.col("status").isin(*DONE) & (F.col("due_day") <= F.lit(last)))


def candidate_order() -> list[Column]:
    return [F.desc("priority_score"), F.asc_nulls_last("due_at"), F.lower("title"), F.col("course_id"), F.col("match_key")]


def work_window(candidates: DataFrame, *, today: date) -> DataFrame:
    """Minutes and the days they may be spread over, as offsets from today and as dates."""
    due = F.date_diff(F.col("due_day"), F.lit(today))
    minutes = effort_minutes()
    days = F.when(F.col("type").isin("exam", "quiz"), 1).otherwise(
        F.greatest(F.lit(1), F.least(due + 1, F.ceil(minutes / 45)))
    )
    first = F.greatest(F.lit(0), due - (days - 1)).cast("int")
    return (
        candidates.withColumns({"minutes": minutes, "first_day": first})
        .withColumn("last_day", F.greatest(due, F.col("first_day")).cast("int"))
        .withColumns(
            {
                "window_start": F.date_add(F.lit(today), F.col("first_day")),
                "window_end": F.date_add(F.lit(today), F.col("last_day")),
            }
        )
    )


def ranked_candidates(rows: DataFrame, *, today: date, horizon_days: int) -> DataFrame:
    """Candidates numbered in planning order per student."""
    picked = plan_candidates(rows, today=today, horizon_days=horizon_days)
    return ranked(picked, ["student_id"], candidate_order(), "plan_rank")


def _daily_share(remaining: int, days_left: int, free: int) -> int:
    """Minutes to take from one day: an even share in steps of MIN_MINUTES, within what the day still has."""
    if free <= 0:
        return 0
    even = -(-remaining // days_left)
    step = max(MIN_MINUTES, -(-even // MIN_MINUTES) * MIN_MINUTES)
    return min(step, free, remaining)


def _spread(horizon_days: int, daily_minutes: int):
    """Sequential pass over partitions sorted by student and planning order; state lives across batches."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        student, free = None, []
        for batch in batches:
            taken: list[tuple[int, str, int, int]] = []
            for row in batch.itertuples(index=False):
                if row.student_id != student:
                    student, free = row.student_id, [daily_minutes] * horizon_days
                remaining = row.minutes
                for day in range(row.first_day, row.last_day + 1):
                    share = _daily_share(remaining, row.last_day + 1 - day, free[day]) if remaining > 0 else 0
                    if share > 0:
                        free[day] -= share
                        remaining -= share
                        taken.append((student, row.id, day, share))
            yield pd.DataFrame(taken, columns=["student_id", "id", "day", "planned"])

    return run


def plan_agenda(
    rows: DataFrame, *, today: date, horizon_days: int = 7, daily_minutes: int = 120
) -> DataFrame:
    """Planned entries: (student, assignment, day, minutes, priority, notes, overflow)."""
    spec = "student_id bigint, assignment_id string, agenda_date date, planned_minutes int, priority_score double, notes string, overflow boolean"
    if horizon_days <= 0:
        return rows.sparkSession.createDataFrame([], spec)
    picked = work_window(plan_candidates(rows, today=today, horizon_days=horizon_days), today=today)
    # read twice below: for the sequential pass over the head, and for the entries of every candidate
    needed = ("student_id", "course_id", "match_key", "id", "title", "due_at", "due_day", "priority_score", "minutes", "first_day", "last_day")
    candidates = stage(picked.select(*needed))
    head_size = horizon_days * (max(daily_minutes, 0) // MIN_MINUTES + 1)
    same_window = Window.partitionBy("student_id", "first_day", "last_day").orderBy(*candidate_order())
    head = candidates.withColumn("_n", F.row_number().over(same_window)).where(F.col("_n") <= head_size)
    taken = (
        head.repartition("student_id")
        .sortWithinPartitions("student_id", *candidate_order())
        .select("student_id", "id", "minutes", "first_day", "last_day")
        .mapInPandas(_spread(horizon_days, daily_minutes), "student_id bigint, id string, day int, planned int")
    )
    # at most one entry per day of the horizon
    per_row = taken.groupBy("student_id", "id").agg(
        F.collect_list(F.struct("day", "planned")).alias("_entries"), F.sum("planned").alias("_planned")
    )
    rest = F.col("minutes") - F.coalesce("_planned", F.lit(0))
    overdue = F.col("due_day") < F.lit(today)
    note = F.concat(F.lit("Auto-planned for due "), F.col("due_day").cast("string"))
    late_note = F.when(overdue, "; overflow scheduled today (overdue)").otherwise("; overflow on due date")
    entry = lambda day, planned, over: F.struct(
        day.cast("int").alias("day"), planned.cast("int").alias("planned"), F.lit(over).alias("overflow")
    )
    entries = F.concat(
        F.coalesce(
            F.transform("_entries", lambda e: entry(e["day"], e["planned"], False)),
            F.array().cast("array<struct<day:int,planned:int,overflow:boolean>>"),
        ),
        F.when(rest > 0, F.array(entry(F.greatest(F.lit(0), F.date_diff("due_day", F.lit(today))), rest, True))).otherwise(
            F.array().cast("array<struct<day:int,planned:int,overflow:boolean>>")
        ),
    )
    return (
        candidates.join(per_row, ["student_id", "id"], "left")
        .select("student_id", "id", "priority_score", "due_day", F.explode(entries).alias("e"))
        .select(
            "student_id",
            F.col("id").alias("assignment_id"),
            F.date_add(F.lit(today), F.col("e.day")).alias("agenda_date"),
            F.col("e.planned").alias("planned_minutes"),
            (F.col("priority_score") + F.when(F.col("e.overflow"), 0.5).otherwise(0.0)).alias("priority_score"),
            F.when(F.col("e.overflow"), F.concat(note, late_note)).otherwise(note).alias("notes"),
            F.col("e.overflow").alias("overflow"),
        )
    )


def agenda_items(plan: DataFrame, canonical: DataFrame) -> DataFrame:
    """One row per (day, assignment), with the course code, URL, deadline, reasons and label of `canonical` where it carries them."""
    merged = plan.groupBy("student_id", "agenda_date", "assignment_id").agg(
        F.sum("planned_minutes").alias("planned_minutes"),
        F.max("priority_score").alias("priority_score"),
        F.min(F.when(X.truthy(F.col("notes")), F.struct("overflow", "notes")))["notes"].alias("notes"),
    )
    info = canonical.select(
        "student_id",
        F.col("id").alias("assignment_id"),
        F.col("title").alias("_title"),
        *[F.col("course.code").alias("course_code")] * ("code" in canonical.schema["course"].dataType.names),
        *[c for c in ("external_url", "due_at", "due_day") if c in canonical.columns],
        F.col("status").alias("_status"),
        *[c for c in ("priority_reasons", "due_label") if c in canonical.columns],
    )
    return (
        merged.join(info, ["student_id", "assignment_id"], "left")
        .withColumn("assignment_title", F.coalesce("_title", "assignment_id"))
        .withColumn("status", F.coalesce("_status", F.lit("upcoming")))
        .where(~F.coalesce(F.lower("_title").contains("practice test"), F.lit(False)))
        .drop("_title", "_status")
    )


def agenda_order() -> list[Column]:
    """Report order of agenda items."""
    return [
        F.col("agenda_date"),
        F.asc_nulls_last("due_at"),
        F.lower(F.coalesce("course_code", F.lit(""))),
        F.lower("assignment_title"),
    ]


def agenda_days(items: DataFrame) -> DataFrame:
    return items.groupBy("student_id", "agenda_date").agg(
        F.sum("planned_minutes").alias("total_minutes"), F.count(F.lit(1)).alias("entry_count")
    )


def agenda_report(plan: DataFrame, canonical: DataFrame) -> DataFrame:
    """Plan entries with the title and course they belong to."""
    info = canonical.select(
        "student_id", F.col("id").alias("assignment_id"), "title", F.col("course.code").alias("course_code"), "course_id"
    )
    joined = plan.join(info, ["student_id", "assignment_id"], "left")
    return joined.select(
        "student_id",
        "agenda_date",
        F.coalesce("course_code", "course_id").alias("course_code"),
        F.coalesce("title", "assignment_id").alias("title"),
        "planned_minutes",
        "priority_score",
        "notes",
    )


def plan_counts(plan: DataFrame) -> DataFrame:
    """Entries, planned days and planned assignments per student."""
    return plan.groupBy("student_id").agg(
        F.count(F.lit(1)).alias("entries"),
        F.count_distinct("agenda_date").alias("days"),
        F.count_distinct("assignment_id").alias("assignments"),
        F.sum("planned_minutes").alias("minutes"),
    )
