"""Priority of canonical rows: one pass of expressions, no shuffle.

Input rows carry `due_day` (see reconcile.with_deadline) and the `course` struct.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from termloom.functions import text as X
from termloom.operators.categories import TYPE_HINTS, normal_text, place

# Weights of the score and scores per assignment type.
URGENCY_SHARE, IMPACT_SHARE, RISK_SHARE, MOMENTUM_SHARE = 0.45, 0.30, 0.15, 0.10
FITTING = "fitting"
TYPE_IMPACT = {"exam": 80.0, "project": 68.0, "lab": 52.0, "homework": 45.0, "discussion": 30.0, "reading": 24.0}


def lookup(key: Column, table: dict[str, object], default: Column) -> Column:
    picked = default
    for k, v in reversed(table.items()):
        picked = F.when(key == k, v if isinstance(v, Column) else F.lit(v)).otherwise(picked)
    return picked


def days_left(today: date) -> Column:
    return F.date_diff(F.col("due_day"), F.lit(today))


def urgency(days: Column) -> Column:
    return (
        F.when(days <= 0, 100.0)
        .when(days == 1, 92.0)
        .when(days == 2, 82.0)
        .otherwise(F.greatest(F.lit(24.0), F.lit(72.0) - (days - 3) * 10.0))
    )


def urgency_reason(days: Column) -> Column:
    return (
        F.when(days <= 0, "Overdue")
        .when(days == 1, "Due within 1 day")
        .otherwise(F.concat(F.lit("Due within "), days.cast("string"), F.lit(" days")))
    )


def fitting() -> Column:
    """Course categories that stand for this row: by its category, its type's words or its title."""
    at = place(F.col("type"), TYPE_HINTS)
    row = F.struct(
        normal_text(F.col("grade_category")).alias("own"), normal_text(F.col("title")).alias("title"),
        F.coalesce(*[F.when(at == i, 1 << i) for i in range(len(TYPE_HINTS))], F.lit(0)).alias("bit"),
        # other types stand for themselves
        F.when(at.isNull(), X.blank_to_null(normal_text(F.col("type")))).alias("type"),
    )

    def fits(c: Column, r: Column) -> Column:
        by_own = (r["own"] != "") & (c["normal"].contains(r["own"]) | r["own"].contains(c["normal"]))
        by_type = (c["stands_for"].bitwiseAND(r["bit"]) != 0) | (r["type"].isNotNull() & c["normal"].contains(r["type"]))
        by_title = r["title"].contains(c["normal"]) & (F.length(c["normal"]) >= 4)
        return (c["normal"] != "") & (by_type | by_title | by_own)

    # an array of one row gives its texts a name
    return F.get(F.transform(F.array(row), lambda r: F.filter("course.weighing", lambda c: fits(c, r))), F.lit(0))


def assignment_weight(fitting_: Column | None = None) -> Column:
    """Share of the course grade, as a fraction; `fitting_` are the fitting categories if already known."""
    direct = X.as_fraction(F.col("grade_weight_pct"))
    # array_max leaves missing weights out
    from_course = F.array_max((fitting() if fitting_ is None else fitting_)["share"])
    own = direct.isNotNull() & X.truthy(F.col("grade_category"))
    return F.when(own, direct).otherwise(F.coalesce(from_course, direct))


def category_label(fitting_: Column | None = None) -> Column:
    """Name shown for the weight: own category, first fitting course category, else the type."""
    named = F.filter((fitting() if fitting_ is None else fitting_)["name"], lambda n: F.trim(n) != "")
    own = X.blank_to_null(F.col("grade_category"))
    return F.coalesce(own, F.trim(F.get(named, F.lit(0))), F.initcap(F.replace("type", F.lit("_"), F.lit(" "))))


def cutoff_gap() -> Column:
    """Points to the next letter grade, when at most five are missing."""
    current = F.col("course.current_grade_pct")
    lower = F.transform(F.map_values("course.grading_scale"), lambda b: X.as_fraction(F.get(b, F.lit(0))) * 100.0)
    gap = F.array_min(F.filter(lower, lambda v: v > current)) - current
    return F.when((gap > 0) & (gap <= 5), gap)


def cutoff_pressure(gap: Column, weight: Column) -> Column:
    base = F.greatest(F.lit(2.0), F.lit(12.0) - gap * 2.0)
    factor = F.when(weight.isNull(), 1.0).otherwise(F.least(F.lit(1.5), F.greatest(F.lit(0.75), weight + 1.0)))
    return F.when(gap.isNull(), 0.0).otherwise(base * factor)


def impact(weight: Column, gap: Column) -> Column:
    base = lookup(F.col("type"), TYPE_IMPACT, F.lit(40.0))
    weighted = F.when(weight.isNull(), base).otherwise(
        F.greatest(base, F.least(F.lit(100.0), weight * 220.0 + 24.0))
    )
    low = F.coalesce(F.col("course.current_grade_pct") < 80, F.lit(False))
    boost = F.when(low & F.col("type").isin("exam", "project"), 8.0).when(low & (weight >= 0.15), 6.0).otherwise(0.0)
    big = F.when(F.col("points_possible") >= 100, 3.0).otherwise(0.0)
    return F.least(F.lit(100.0), weighted + boost + big + cutoff_pressure(gap, weight))


def policy(field: str) -> Column:
    """Field of the row's late policy, else of the course's."""
    return F.when(F.col("late_policy").isNotNull(), F.col("late_policy")[field]).otherwise(
        F.col("course.syllabus_parsed.late_policy")[field]
    )


def has_policy() -> Column:
    return F.col("late_policy").isNotNull() | F.col("course.syllabus_parsed.late_policy").isNotNull()


def blocked_type() -> Column:
    """The policy's exceptions name the type of this row."""
    exceptions = normal_text(policy("exceptions"))
    return F.col("type").isin("exam", "discussion", "quiz") & exceptions.contains(F.col("type"))


def late_risk(days: Column) -> Column:
    accepts, max_days = policy("accepts_late"), policy("max_late_days")
    penalty = X.as_fraction(policy("default_penalty_per_day"))
    yes = F.coalesce(accepts, F.lit(False))
    no = F.coalesce(~accepts, F.lit(False)) | F.coalesce(max_days == 0, F.lit(False))
    lenient = yes & (F.coalesce(penalty, F.lit(0.0)) <= 0.01) & (F.coalesce(F.nullif(max_days, F.lit(0)), F.lit(999)) >= 5)
    # least() skips nulls, so a missing penalty must stay outside of it
    penalised = F.when(penalty.isNull(), F.when(yes, 0.0).otherwise(8.0)).otherwise(F.least(F.lit(35.0), penalty * 1000.0))
    graded_risk = (
        F.when(yes, 30.0).otherwise(55.0)
        + penalised
        + F.when(max_days <= 1, 25.0).when(max_days <= 3, 15.0).when(max_days <= 5, 8.0).otherwise(0.0)
        - F.when(lenient, 10.0).otherwise(0.0)
    )
    base = F.when(~has_policy(), 55.0).when(blocked_type(), 96.0).when(no, 92.0).otherwise(graded_risk)
    near = F.when(days <= 0, 10.0).when(days <= 1, 8.0).when(days <= 3, 4.0).otherwise(0.0)
    overdue = F.when(F.col("status") == "overdue", 10.0).otherwise(0.0)
    return F.least(F.lit(100.0), F.greatest(F.lit(0.0), base + near + overdue))


def priority_scores(rows: DataFrame, *, today: date) -> DataFrame:
    """Rows with the categories that fit, days_left, weight, cutoff_gap, urgency, impact, late_risk and priority_score."""
    # the fitting categories are read for the weight and for its label
    base = rows.withColumn(FITTING, fitting()).withColumns(
        {"days_left": days_left(today), "weight": assignment_weight(F.col(FITTING)), "cutoff_gap": cutoff_gap()}
    )
    parts = base.withColumns(
        {
            "urgency": urgency(F.col("days_left")),
            "impact": impact(F.col("weight"), F.col("cutoff_gap")),
            "late_risk": late_risk(F.col("days_left")),
        }
    )
    total = (
        F.col("urgency") * URGENCY_SHARE
        + F.col("impact") * IMPACT_SHARE
        + F.col("late_risk") * RISK_SHARE
        + F.when(F.col("status") == "in_progress", 100.0).otherwise(0.0) * MOMENTUM_SHARE
        + F.when(F.col("type") == "exam", 5.0).otherwise(0.0)
    )
    capped = X.rounded(F.least(F.lit(100.0), total), 2)
    return parts.withColumn("priority_score", F.when(F.col("due_day").isNull(), 0.0).otherwise(capped))


def _reason(when: Column, label: Column, contribution: Column) -> Column:
    body = F.struct((-contribution.cast("double")).alias("rank"), label.alias("label"))
    return F.when(when & label.isNotNull(), body)


def _policy_reason(days: Column) -> Column:
    accepts, max_days = policy("accepts_late"), policy("max_late_days")
    penalty = X.as_fraction(policy("default_penalty_per_day"))
    body = lambda label, contribution: F.struct(
        (-(contribution if isinstance(contribution, Column) else F.lit(contribution)).cast("double")).alias("rank"),
        (label if isinstance(label, Column) else F.lit(label)).alias("label"),
    )
    no = F.coalesce(~accepts, F.lit(False)) | F.coalesce(max_days == 0, F.lit(False))
    only = F.concat(
        F.lit("Only "), max_days.cast("string"), F.lit(" late day"), F.when(max_days != 1, "s").otherwise(""), F.lit(" allowed")
    )
    per_day = F.concat(F.round(penalty * 100).cast("int").cast("string"), F.lit("% penalty per late day"))
    return (
        F.when(~has_policy() & (F.col("status") == "overdue"), body("Already overdue", 20.0))
        .when(~has_policy(), F.lit(None))
        .when(blocked_type(), body("No late submissions for this item type", 18.0))
        .when(no, body("No late work accepted", 17.0))
        .when(penalty > 0, body(per_day, F.least(F.lit(16.0), penalty * 100.0 + 5.0)))
        .when((days <= 1) & accepts & max_days.isNotNull(), body(only, 10.0))
    )


def priority_reasons(scored: DataFrame, *, limit: int = 3) -> DataFrame:
    """Rows of priority_scores with `priority_reasons`: the labels that contribute most."""
    days, weight, gap = F.col("days_left"), F.col("weight"), F.col("cutoff_gap")
    always = F.lit(True)
    worth = F.concat(
        category_label(F.col(FITTING) if FITTING in scored.columns else None), F.lit(" worth about "), F.round(weight * 100).cast("int").cast("string"), F.lit("% of course grade")
    )
    missing = F.concat(F.format_number(gap, 1), F.lit(" points from the next grade cutoff"))
    reasons = F.array(
        _reason(always, urgency_reason(days), F.col("urgency") * URGENCY_SHARE),
        _reason(weight.isNotNull(), worth, F.least(F.lit(32.0), weight * 80.0 + 8.0)),
        _reason(gap.isNotNull(), missing, cutoff_pressure(gap, weight)),
        _policy_reason(days),
        _reason(F.col("status") == "in_progress", F.lit("Already in progress"), F.lit(10.0)),
    )
    # the urgency of a row with a deadline is always among them
    if limit == 1:
        labels = F.array(F.array_min(reasons)["label"])
    else:
        labels = F.transform(F.slice(F.sort_array(F.filter(reasons, lambda r: r.isNotNull())), 1, limit), lambda r: r["label"])
    empty = F.array().cast("array<string>")
    return scored.withColumn("priority_reasons", F.when(F.col("due_day").isNull(), empty).otherwise(labels))
