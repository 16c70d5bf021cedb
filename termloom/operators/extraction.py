"""Captured artifacts -> prompt chunks -> extracted facts -> consolidated facts, rules and grade."""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Callable, Iterator
from datetime import datetime

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from termloom.functions import scan
from termloom.functions import text as X
from termloom.operators.grades import exact
from termloom.operators.reconcile import LMS, instant

COURSE = ["student_id", "course_id"]
FACT = [*COURSE, "fact_key"]

# Page kinds that feed the two extractions, sizes in characters.
ASSIGNMENT_KINDS = (
    "announcement_detail", "content_outline_topic", "d2l_nav_page", "tool_assignments", "tool_quizzes-exams", "tool_grades",
    "tool_calendar", "tool_calendar_full_schedule", "course_home", "external_assignment_row", "external_assignment_page",
    "external_assignments_frame", "external_assignments_page", "external_course_page", "external_course_nav_page",
    "external_course_frame",
)
RULE_KINDS = (
    "tool_grades", "tool_calendar", "tool_calendar_full_schedule", "syllabus_topic", "content_outline_topic", "d2l_nav_page",
    "tool_content", "course_home", "announcement_detail",
)
ASSIGNMENT_CHUNK, RULE_CHUNK, OVERHEAD = 12_000, 20_000, 400
# errors that a smaller prompt may avoid, with the words (fixed values) their text must hold
RETRY = {TimeoutError: "", RuntimeError: "timed out|timeout|context length|maximum context|too large"}
STATUS_ORDER = ("graded", "completed", "submitted", "in_progress", "overdue", "upcoming", "available")


def select_artifacts(artifacts: DataFrame, kinds: tuple[str, ...]) -> DataFrame:
    return artifacts.where(F.col("page_kind").isin(*kinds))


def artifact_size(text: Column, shown: int | None = None) -> Column:
    """Size an artifact counts with: its whole text, or the first `shown` characters, and a fixed overhead."""
    size = F.coalesce(F.length(text), F.lit(0))
    return (size if shown is None else F.least(size, F.lit(shown))) + OVERHEAD


# ---------------------------------------------------------------- chunk packing


def _summarise(limit: int, reach: int):
    """Per block: sums of its first rows, and per possible first chunk start the chunks opened and the size left open."""

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        sizes = rows.sort_values("position")["size"].tolist()
        sums = [0]
        for s in sizes:
            sums.append(sums[-1] + s)
        starts = min(reach, len(sizes))
        opened, tail = [], []
        for first in range(starts):
            n, begin = 1, first
            # the first row that no longer fits opens the next chunk; a row beyond the limit is a chunk of its own
            while (nxt := max(begin + 1, bisect_right(sums, sums[begin] + limit) - 1)) < len(sizes):
                n, begin = n + 1, nxt
            opened.append(n)
            tail.append(sums[-1] - sums[begin])
        return pd.DataFrame([[*key, sums[: reach + 1], sums[-1], len(sizes), opened, tail]])

    return run


def _carry(limit: int):
    """Chunks opened before each block and the size left open where it begins, block after block."""

    def run(key: tuple, blocks: pd.DataFrame) -> pd.DataFrame:
        open_size, chunks, out = None, 0, []
        for b in blocks.sort_values("block").itertuples(index=False):
            out.append((*key, b.block, -1 if open_size is None else open_size, chunks))
            if open_size is None:
                first = 0
            else:
                first = next((i for i in range(1, len(b.sums)) if open_size + b.sums[i] > limit), len(b.sums)) - 1
            if first >= b.n:
                open_size += b.total
            else:
                chunks += b.opened[first]
                open_size = b.tail[first]
        return pd.DataFrame(out)

    return run


def _assign(limit: int):
    """Chunk number of every row of a block, from the state carried into it."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        ordered = rows.sort_values("position")
        open_size, chunk = int(ordered["_open"].iloc[0]), int(ordered["_chunks"].iloc[0])
        numbers = []
        for size in ordered["size"].tolist():
            if open_size < 0 or open_size + size > limit:
                chunk, open_size = chunk + 1, 0
            open_size += size
            numbers.append(chunk)
        return ordered.drop(columns=["_open", "_chunks", "size"]).assign(chunk=numbers)

    return run


def pack_chunks(artifacts: DataFrame, *, max_chars: int, block: int = 1 << 14) -> DataFrame:
    """Chunk number (from 1) of every artifact, as rows (course keys, position, chunk): in order, a new chunk where the sum would exceed `max_chars`.
    An artifact of more than `max_chars` is a chunk of its own. Whoever needs the artifacts' other columns joins these narrow rows.

    artifacts: course keys, position (unique integer per course), size. The greedy scan is cut into blocks of positions: each
    block is summarised for every place its first chunk can start, the summaries are chained per course, and each block is
    numbered from its carried state. No task sees more than one block of rows or one row per block.
    """
    reach = max_chars // OVERHEAD + 1  # rows before a new chunk must have started: every row has at least OVERHEAD
    keyed = artifacts.select(*COURSE, "position", F.col("size").cast("long").alias("size"), scan.block_of("position", block).alias("block"))
    keys = "student_id bigint, course_id string"
    summaries = keyed.groupBy(*COURSE, "block").applyInPandas(
        _summarise(max_chars, reach), f"{keys}, block bigint, sums array<bigint>, total bigint, n bigint, opened array<bigint>, tail array<bigint>"
    )
    carried = summaries.groupBy(*COURSE).applyInPandas(_carry(max_chars), f"{keys}, block bigint, _open bigint, _chunks bigint")
    numbered = keyed.join(carried, [*COURSE, "block"]).groupBy(*COURSE, "block").applyInPandas(
        _assign(max_chars), f"{keys}, position bigint, block bigint, chunk bigint"
    )
    return numbered.select(*COURSE, "position", "chunk")


def artifact_block(shown: int | None = None) -> Column:
    """How one artifact appears in a prompt; its text whole, or the first `shown` characters."""
    text = F.coalesce(F.col("text"), F.lit(""))
    blank = lambda n: F.coalesce(F.col(n), F.lit(""))
    score = F.when(X.truthy(F.col("score_text")), F.concat(F.lit("pearson_score_text: "), "score_text", F.lit("\n"))).otherwise("")
    return F.trim(F.concat(
        F.lit("artifact_id: "), "id", F.lit("\nsource_platform: "), blank("source_platform"), F.lit("\npage_kind: "), blank("page_kind"),
        F.lit("\ntitle: "), blank("title"), F.lit("\nurl: "), blank("url"), F.lit("\nparent_url: "), blank("parent_url"), F.lit("\n"), score,
        F.lit("text:\n"), F.regexp_replace(text if shown is None else F.substring(text, 1, shown), f"{X.SPACE}+$", ""),
    ))


def build_prompts(chunks: DataFrame, template: str, *, shown: int | None = None) -> DataFrame:
    """One prompt per chunk: template, course line, formatted artifacts in order. A chunk is bounded by its size limit or is one artifact."""
    listed = chunks.groupBy(*COURSE, "chunk").agg(
        F.array_sort(F.collect_list(F.struct("position", "id", artifact_block(shown).alias("body")))).alias("a"),
        F.any_value("course_code").alias("course_code"), F.any_value("course_name").alias("course_name"),
    )
    bodies = F.array_join(F.transform("a", lambda a: a["body"]), "\n\n")
    prompt = F.concat(F.lit(template + "\n\nCOURSE: "), "course_code", F.lit(" - "), "course_name", F.lit("\n\nARTIFACTS:\n"), bodies)
    return listed.select(
        *COURSE, "chunk", "course_code", "course_name", F.transform("a", lambda a: a["id"]).alias("artifact_ids"),
        F.transform("a", lambda a: a["body"]).alias("bodies"), prompt.alias("prompt"),
    )


def retryable(error: Exception) -> bool:
    """Whether half of the artifacts may fare better: the error is one of RETRY and its text fits."""
    return any(isinstance(error, kind) and re.search(words, str(error), re.IGNORECASE) for kind, words in RETRY.items())


def batch_extract(
    prompts: DataFrame, answer: Callable[[str], str], template: str, *, retry: Callable[[Exception], bool] = retryable
) -> DataFrame:
    """Apply `answer` to every prompt. On an error that `retry` accepts the chunk is halved and both halves are tried.

    One row per answered part of a chunk; failures keep their row with the error.
    """

    def prompt_of(row, bodies: list[str]) -> str:
        return f"{template}\n\nCOURSE: {row.course_code} - {row.course_name}\n\nARTIFACTS:\n" + "\n\n".join(bodies)

    def tries(row, ids: list[str], bodies: list[str], part: str) -> Iterator[tuple]:
        try:
            yield (row.student_id, row.course_id, row.chunk, part, ids, answer(prompt_of(row, bodies)), None)
        except Exception as error:  # noqa: BLE001
            if len(ids) > 1 and retry(error):
                half = len(ids) // 2
                yield from tries(row, ids[:half], bodies[:half], part + "1")
                yield from tries(row, ids[half:], bodies[half:], part + "2")
            else:
                yield (row.student_id, row.course_id, row.chunk, part, ids, None, f"{type(error).__name__}: {error}")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["student_id", "course_id", "chunk", "part", "artifact_ids", "response", "error"]
        for batch in batches:
            out = [t for row in batch.itertuples(index=False) for t in tries(row, list(row.artifact_ids), list(row.bodies), "")]
            yield pd.DataFrame(out, columns=names)

    return prompts.drop("prompt").mapInPandas(
        run, "student_id bigint, course_id string, chunk bigint, part string, artifact_ids array<string>, response string, error string"
    )


# ---------------------------------------------------------------- consolidation


def keyed_facts(facts: DataFrame) -> DataFrame:
    return facts.withColumn("fact_key", X.fact_key(F.col("title"))).where("fact_key <> 'item'")


def _first(name: str, wanted: Column | None = None) -> Column:
    """Value of the first fact, in order, that has one."""
    has = F.col(name).isNotNull() if wanted is None else wanted
    return F.min(F.when(has, F.struct("position", name)))[name]


def fact_status() -> Column:
    seen = lambda s: F.bool_or(F.coalesce(F.col("status") == s, F.lit(False)))
    ladder = F.when(seen(STATUS_ORDER[0]), STATUS_ORDER[0])
    for s in STATUS_ORDER[1:]:
        ladder = ladder.when(seen(s), s)
    return ladder.otherwise(_first("status", X.truthy(F.col("status"))))


def consolidate_facts(facts: DataFrame) -> DataFrame:
    """One row per (student, course, fact key). facts: course keys, position and the fields of a fact.

    Evidence, notes and artifact ids are lists without a bound: see fact_evidence, fact_notes and fact_artifacts.
    """
    c = F.col
    yes = lambda n: F.coalesce(c(n), F.lit(False))
    has_due = X.truthy(c("due_at")) | X.truthy(c("due_on"))
    cited = F.coalesce(F.size("evidence_artifact_ids"), F.lit(0))
    grade_rank = F.struct(
        F.when(c("grade_pct").isNotNull() | c("points_earned").isNotNull(), 0).otherwise(1).alias("has"),
        (-F.coalesce("grade_pct", F.lit(-1.0))).alias("pct"), (-F.greatest(cited, F.lit(0))).alias("cited"), "position",
    )
    due = F.struct(F.when(c("source_platform") == LMS, 0).otherwise(1).alias("lms"), "position", "due_at", "due_on", "due_text")
    merged = keyed_facts(facts).groupBy(*FACT).agg(
        F.min(F.struct(F.length("title").alias("n"), F.lower("title").alias("l"), "position", "title"))["title"].alias("title"),
        _first("assignment_type").alias("assignment_type"),
        # the platforms are a handful of names
        F.array_sort(F.collect_set(X.blank_to_null(c("source_platform")))).alias("source_platforms"),
        _first("grade_category").alias("grade_category"),
        F.min(F.when(has_due, due)).alias("_due"),
        _first("due_text").alias("_due_text"),
        _first("weight_pct").alias("weight_pct"),
        F.min(F.struct(grade_rank.alias("rank"), "points_possible", "points_earned", "grade_pct")).alias("_grade"),
        *[_first(n).alias("_" + n) for n in ("points_possible", "points_earned", "grade_pct")],
        F.bool_or("submitted").alias("submitted"), F.bool_or("graded").alias("graded"),
        F.bool_or(yes("optional")).alias("optional"), F.bool_or(yes("extra_credit")).alias("extra_credit"),
        (~F.bool_or(F.coalesce(~c("counts_toward_grade"), F.lit(False)) | yes("extra_credit") | yes("optional"))).alias("counts_toward_grade"),
        fact_status().alias("status"), _first("rationale").alias("rationale"),
        F.min(F.array_min("evidence_artifact_ids")).alias("first_artifact_id"), F.count(F.lit(1)).alias("fact_count"),
    )
    due_of = lambda n: c("_due")[n].alias(n)
    graded = lambda n: F.coalesce(c("_grade")[n], c("_" + n)).alias(n)
    return merged.select(
        *FACT, "title", "assignment_type", "source_platforms", "grade_category", due_of("due_at"), due_of("due_on"),
        F.when(c("_due").isNotNull(), c("_due.due_text")).otherwise(c("_due_text")).alias("due_text"), "weight_pct",
        graded("points_possible"), graded("points_earned"), graded("grade_pct"), "submitted", "graded", "optional", "extra_credit",
        "counts_toward_grade", "status", "rationale", "first_artifact_id", "fact_count",
    )


def _distinct_values(each: DataFrame, keys: list[str], values: list[str], at: list[str]) -> DataFrame:
    """Distinct values in the order of their first occurrence (`first_at`), all of them."""
    return each.groupBy(*keys, *values).agg(F.min(F.struct(*at)).alias("first_at"))


def fact_notes(facts: DataFrame) -> DataFrame:
    """Distinct trimmed notes of each consolidated fact."""
    each = keyed_facts(facts).select(*FACT, "position", F.posexplode("notes").alias("i", "n")).withColumn("note", F.trim("n")).where("note <> ''")
    return _distinct_values(each, FACT, ["note"], ["position", "i"])


def fact_evidence(facts: DataFrame) -> DataFrame:
    """Distinct evidence spans of each consolidated fact."""
    each = keyed_facts(facts).select(*FACT, "position", F.posexplode("evidence_spans").alias("i", "s")).select(
        *FACT, "position", "i", F.trim("s.artifact_id").alias("artifact_id"), F.trim("s.quote").alias("quote")
    ).where("artifact_id <> '' and quote <> ''")
    return _distinct_values(each, FACT, ["artifact_id", "quote"], ["position", "i"])


def fact_artifacts(facts: DataFrame) -> DataFrame:
    """Distinct artifact ids cited by each consolidated fact."""
    return keyed_facts(facts).select(*FACT, F.explode("evidence_artifact_ids").alias("artifact_id")).distinct()


def dedupe_strings(values: Column) -> Column:
    """Trimmed, non-empty, first occurrence order."""
    return F.array_distinct(F.filter(F.transform(values, lambda v: F.trim(v)), lambda v: v != ""))


# ---------------------------------------------------------------- rules


def merged_categories(rules: DataFrame) -> DataFrame:
    """Grade categories of all rule results of a course: shorter name, first weight, first note per key."""
    each = rules.select(*COURSE, "position", F.posexplode("grade_categories").alias("i", "c")).select(
        *COURSE, F.struct("position", "i").alias("at"), "c.name", "c.weight", "c.notes", F.coalesce(X.dashed(F.col("c.name")), F.lit("")).alias("category_key")
    ).where("category_key <> ''")
    first = lambda n, ok: F.min(F.when(ok, F.struct("at", n)))[n].alias(n)
    return each.groupBy(*COURSE, "category_key").agg(
        F.min(F.struct(F.length("name").alias("n"), "at", "name"))["name"].alias("name"),
        first("weight", F.col("weight").isNotNull()), first("notes", X.truthy(F.col("notes"))),
    )


def merge_rules(rules: DataFrame) -> DataFrame:
    """One rule result per course. rules: course keys, position and the fields of a rule result."""
    has_scale = F.coalesce(F.size("grading_scale") > 0, F.lit(False))
    facts = rules.groupBy(*COURSE).agg(
        _first("course_code", X.truthy(F.col("course_code"))).alias("course_code"),
        _first("course_name", X.truthy(F.col("course_name"))).alias("course_name"),
        F.min_by("grading_scale", F.when(has_scale, F.col("position"))).alias("grading_scale"),
        _first("late_policy").alias("late_policy"),
    )
    # the categories of one course's grading scheme, one per distinct key
    listed = merged_categories(rules).groupBy(*COURSE).agg(
        F.array_sort(F.collect_list(F.struct(F.lower("name").alias("order"), "name", "weight", "notes"))).alias("cs")
    )
    cats = F.transform("cs", lambda c: F.struct(c["name"].alias("name"), c["weight"].alias("weight"), c["notes"].alias("notes")))
    none = F.array().cast("array<struct<name:string,weight:double,notes:string>>")
    return facts.join(listed, COURSE, "left").select(
        *COURSE, "course_code", "course_name", F.coalesce(cats, none).alias("grade_categories"), "grading_scale", "late_policy"
    )


def rule_notes(rules: DataFrame) -> DataFrame:
    """Distinct trimmed notes of the rule results of each course."""
    each = rules.select(*COURSE, "position", F.posexplode("notes").alias("i", "n")).withColumn("note", F.trim("n")).where("note <> ''")
    return _distinct_values(each, COURSE, ["note"], ["position", "i"])


# ---------------------------------------------------------------- grade from extracted facts


def counts_now(*, tz: str, now: datetime) -> Column:
    """Due and graded coursework only."""
    c = F.col
    yes = lambda n: F.coalesce(c(n), F.lit(False))
    on = F.trim("due_on")
    day_end = X.in_zone(F.try_to_timestamp(F.concat(F.when(on.rlike(r"^\d{4}-\d{2}-\d{2}$"), on), F.lit(" 23:59:00"))), tz)
    due = F.coalesce(X.iso_instant(X.blank_to_null(c("due_at"))), day_end)
    return (
        ~yes("optional") & ~yes("extra_credit") & F.coalesce(c("counts_toward_grade"), F.lit(True)) & ~(yes("submitted") & ~yes("graded"))
        & ~X.meaning_zero(c("grade_pct"), c("points_earned"), c("points_possible"))
        & (c("grade_pct").isNotNull() | c("points_earned").isNotNull()) & ~F.coalesce(due > instant(now), F.lit(False))
    )


def category_takes(key: Column, own: Column, hay: Column) -> Column:
    """Does a category take a fact: by the fact's own category, else by words of its type and title."""
    by_words = (
        F.when(key.isin("homework", "programming-exercises"), hay.rlike("homework|exercise|assignment"))
        .when(key.isin("quizzes", "quiz", "tests", "test", "exams", "exam"), hay.rlike("quiz|test|exam"))
        .when(key == "labs", hay.contains("lab")).otherwise(False)
    )
    return F.when(X.truthy(own), X.dashed(own) == key).otherwise(by_words)


def extracted_grade(facts: DataFrame, categories: DataFrame, *, tz: str, now: datetime) -> DataFrame:
    """Grade per course: item weights, then categories without weighted items, else the plain mean.

    categories: course keys, position, name, weight.
    """
    c = F.col
    counted = facts.where(counts_now(tz=tz, now=now))
    own_key = F.when(X.truthy(c("grade_category")), X.dashed(c("grade_category")))
    shaped = counted.withColumns(
        {
            "_hay": F.lower(F.concat_ws(" ", F.coalesce("assignment_type", F.lit("")), "title")), "_own": own_key,
            "_w": F.when(c("grade_pct").isNotNull(), X.positive_or_missing(c("weight_pct"))),
            "_u": F.when(c("grade_pct").isNotNull(), F.coalesce(X.positive_or_missing(c("points_possible")), F.lit(1.0))),
        }
    )
    items = shaped.groupBy(*COURSE).agg(
        F.sum(exact(c("_w") * (c("grade_pct") / 100))).cast("double").alias("item_points"), F.sum(exact(c("_w"))).cast("double").alias("item_weight"),
        F.sum(exact(c("grade_pct") * c("_u"))).cast("double").alias("plain_points"), F.sum(exact(c("_u"))).cast("double").alias("plain_units"),
        F.count(F.lit(1)).alias("n"),
    )
    listed = categories.withColumn("_key", X.dashed(c("name"))).where("_key <> '' and coalesce(weight, 0) <> 0")
    weighted = shaped.where("_w is not null and _own is not null").select(*COURSE, c("_own").alias("_key")).distinct()
    open_categories = listed.join(weighted, [*COURSE, "_key"], "left_anti").select(*COURSE, c("position").alias("_pos"), "_key", "weight")
    # equality on the course makes this a hash join; the word test is its residual
    taken = shaped.where("_u is not null").join(open_categories, COURSE).where(category_takes(c("_key"), c("grade_category"), c("_hay")))
    means = taken.groupBy(*COURSE, "_pos", "weight").agg(
        (F.sum(exact(c("grade_pct") * c("_u"))).cast("double") / F.sum(exact(c("_u"))).cast("double")).alias("mean")
    )
    blended = means.groupBy(*COURSE).agg(
        F.sum(exact(c("weight") * (c("mean") / 100))).cast("double").alias("cat_points"), F.sum(exact(c("weight"))).cast("double").alias("cat_weight")
    )
    zero = lambda n: F.coalesce(n, F.lit(0.0))
    total = zero("item_weight") + zero("cat_weight")
    weighted_grade = F.when(total > 0, X.rounded((zero("item_points") + zero("cat_points")) / total * 100, 2))
    plain = X.rounded(c("plain_points") / c("plain_units"), 2)
    note = (
        F.when(weighted_grade.isNotNull(), "Calculated from graded assignments that are already due.")
        .when(plain.isNotNull(), "Used straight average because no usable category or item weights were found.")
        .when(c("n") > 0, "No graded coursework available for calculation.")
        .otherwise("No due and graded coursework available for calculation.")
    )
    courses = facts.select(*COURSE).distinct()
    return courses.join(items, COURSE, "left").join(blended, COURSE, "left").select(
        *COURSE, F.coalesce(weighted_grade, plain).alias("current_grade_pct"), note.alias("note")
    )


# ---------------------------------------------------------------- merging and log


def newest_runs(courses: DataFrame) -> DataFrame:
    """Extracted courses (course keys, run, ...) of the newest run of each course."""
    newest = courses.groupBy(*COURSE).agg(F.max("run").alias("run"))
    older = courses.select(*COURSE, "run").distinct().join(newest, [*COURSE, "run"], "left_anti")
    return courses.join(older, [*COURSE, "run"], "left_anti")


def merge_extractions(saved: dict[str, DataFrame], updated: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Updated courses replace saved ones; the audit events of all runs stay, as rows (course keys, run, position, ...).

    Each side has `courses` (course keys, run, ...) and `events`; a run is numbered, and a course is that of its newest run.
    """
    return {"courses": newest_runs(saved["courses"].unionByName(updated["courses"])), "events": saved["events"].unionByName(updated["events"])}


def course_events(events: DataFrame) -> DataFrame:
    """Events of all runs numbered (`at`) per course: earlier runs first, in a run by position."""
    return scan.ranked(events, COURSE, ["run", "position"], "at")


def extraction_log(results: DataFrame, *, stage: str, samples: int | None = None, spans: int | None = None, quote: int | None = None) -> DataFrame:
    """One audit row per answered part of a chunk, with all facts, evidence and quotes unless fewer are asked for. results: course keys, chunk, part, artifact_ids, parsed struct of facts."""
    facts = F.coalesce("parsed.assignments", F.array().cast(results.schema["parsed"].dataType["assignments"].dataType))
    first = lambda c, n: c if n is None else F.slice(c, 1, n)
    shown = first(facts, samples)
    evidence = F.transform(shown, lambda a: F.struct(
        a["title"].alias("title"), a["rationale"].alias("rationale"),
        F.transform(first(F.coalesce(a["evidence_spans"], F.array().cast("array<struct<artifact_id:string,quote:string>>")), spans), lambda s: F.struct(
            s["artifact_id"].alias("artifact_id"), (s["quote"] if quote is None else F.substring(s["quote"], 1, quote)).alias("quote"))).alias("evidence_spans"),
    ))
    detail = F.struct(
        F.concat_ws("", F.lit("chunk "), F.col("chunk").cast("string"), F.when(F.col("part") != "", F.concat(F.lit(" part "), "part"))).alias("chunk"),
        "artifact_ids", F.size(facts).alias("assignment_count"), F.transform(shown, lambda a: a["title"]).alias("sample_titles"),
        evidence.alias("assignment_evidence"),
    )
    return results.where("error is null").select(*COURSE, "chunk", "part", F.lit(stage).alias("stage"), F.to_json(detail).alias("detail"))


def rules_log(results: DataFrame, *, stage: str, notes: int | None = None) -> DataFrame:
    """One audit row per answered rule chunk, with all notes or the first `notes`."""
    none = F.array().cast("array<string>")
    detail = F.struct(
        F.concat_ws("", F.lit("chunk "), F.col("chunk").cast("string"), F.when(F.col("part") != "", F.concat(F.lit(" part "), "part"))).alias("chunk"),
        "artifact_ids", F.coalesce(F.transform("parsed.grade_categories", lambda c: c["name"]), none).alias("grade_category_names"),
        F.col("parsed.late_policy").isNotNull().alias("has_late_policy"), (F.coalesce("parsed.notes", none) if notes is None else F.slice(F.coalesce("parsed.notes", none), 1, notes)).alias("rule_notes"),
    )
    return results.where("error is null").select(*COURSE, "chunk", "part", F.lit(stage).alias("stage"), F.to_json(detail).alias("detail"))
