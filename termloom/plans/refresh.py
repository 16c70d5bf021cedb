"""The whole refresh as one batch job: captured documents -> tables -> canonical rows -> overview tables.

Each stage that several later stages read is written as a table and read back. That cuts the lineage on shared storage,
keeps plans small, and means a lost executor repeats one stage instead of the job.

A synchronisation reads and rewrites only the buckets of students it has rows of. Its summary is written last, as the generation that numbers
the run: a run that failed before is repeated under the same number and merges the same rows again.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from termloom import schemas
from termloom.operators import agenda, grades, overview, priority, reconcile, sync
from termloom.operators import answers
from termloom.operators import extraction as E
from termloom.operators import normalize as N
from termloom.operators import pages as P
from termloom.session import configure, stage
from termloom.sources import snapshots
from termloom.sources.tables import TableStore

COURSE = ["student_id", "course_id"]
SCOPE = [*COURSE, "source_platform"]
SYLLABUS_STAGE = "syllabus_parse"
FACT_TABLES = ("fact_evidence", "fact_notes", "fact_artifacts")


def next_run(store: TableStore) -> int:
    return (store.version("sync_summary") or 0) + 1


def finish(store: TableStore, summary: DataFrame, number: int) -> DataFrame:
    """The summary (staged before the tables changed) as the mark of a complete run."""
    store.write("sync_summary", summary, number)
    return store.read("sync_summary", number)


def skipped(courses: DataFrame, reason: str) -> DataFrame:
    """Courses of the input that a synchronisation leaves out, with the reason."""
    return courses.select(*COURSE, "fetched_at", F.lit(reason).alias("reason")).distinct()


def older_courses(courses: DataFrame, known: DataFrame) -> DataFrame:
    """Captured courses of which the tables hold a newer state."""
    seen = known.select(*COURSE, F.col("last_scraped_d2l").alias("_seen"))
    return skipped(courses.join(seen, COURSE).where("fetched_at < _seen"), "older than the stored course")


def write_log(store: TableStore, events: DataFrame, number: int) -> None:
    """The events of run `number` behind the log, as a batch of their own; a repeat after a failure replaces the batch."""
    store.append_log(sync.append_log(sync.numbered(events), batch=number, sequence="sequence"), number)


def newest_courses(frames: dict[str, DataFrame], known: DataFrame | None = None) -> dict[str, DataFrame]:
    """Frames of the newest snapshot of each course, without courses the tables already know in a newer state."""
    newest = frames["courses"].groupBy(*COURSE).agg(F.max("fetched_at").alias("fetched_at"))
    if known is not None:
        seen = known.select(*COURSE, F.col("last_scraped_d2l").alias("_seen"))
        newest = newest.join(seen, COURSE, "left").where("_seen is null or fetched_at >= _seen").drop("_seen")
    picked = {name: df.join(newest, [*COURSE, "fetched_at"], "left_semi") for name, df in frames.items()}
    # a document that was delivered twice counts once
    return {name: df if any(t.startswith("map") or "map<" in t for _, t in df.dtypes) else df.distinct() for name, df in picked.items()}


def sync_lms_frames(store: TableStore, frames: dict[str, DataFrame], *, tz: str, now: datetime) -> DataFrame:
    """One LMS synchronisation of the buckets its students fall into, and the summary.

    The assignments are written first: a repeat that finds the courses complete has nothing left to do.
    """
    touched = store.touched(frames["courses"])
    courses, assignments = store.state("courses", touched), store.state("assignments", touched)
    fresh = newest_courses(frames, courses)
    number = next_run(store)
    store.write("skipped_input", older_courses(frames["courses"], courses), number)
    store.write("normalized_courses", N.normalize_courses(fresh), number)
    store.write("normalized_assignments", N.normalize_assignments(fresh, tz=tz).drop("first_seen"), number)
    new_courses, new_assignments = store.read("normalized_courses", number), store.read("normalized_assignments", number)
    merged_courses, merged_assignments, summary = sync.sync_lms(courses, assignments, new_courses, new_assignments, now=now)
    summary, merged_courses = stage(summary), stage(merged_courses)
    store.replace("assignments", merged_assignments, touched)
    store.replace("courses", merged_courses, touched)
    return finish(store, summary, number)


def sync_extraction_frames(
    store: TableStore, extraction: dict[str, DataFrame], artifacts: DataFrame, *, now: datetime, mode: str = "full"
) -> DataFrame:
    """One synchronisation of extracted courses (mode 'full' prunes, 'additive' keeps), with its log events.

    One set of orphans removes assignments, their agenda entries, evidence, notes and cited artifacts. `extraction` has `courses`, `facts` (one per
    fact key), `provenance`, and the child rows of the facts where these are not lists inside them.
    """
    touched = store.touched(extraction["courses"])
    facts = extraction["facts"]
    fresh = {name: extraction[name] if name in extraction else getattr(E, name)(facts) for name in FACT_TABLES}
    cited = sync.cited_by_children(fresh["fact_artifacts"], fresh["fact_evidence"])
    courses = store.state("courses", touched)
    batch = sync.extraction_batch(courses, store.state("assignments", touched), extraction["courses"], facts, artifacts, now=now, mode=mode, cited=cited)
    orphans = stage(sync.orphans_of(batch["doomed"]))
    ids = stage(batch["ids"])
    summary = stage(sync.sync_summary(batch["courses"], batch["assignments"], batch["doomed"]))
    new_courses = stage(sync.upsert(courses, batch["courses"], COURSE))
    number = next_run(store)
    # rows of facts that came again are replaced, those of orphans go
    gone = orphans.unionByName(ids.select(*sync.CHILD)).distinct()
    kept = sync.cascade(gone, {name: store.state(name, touched) for name in FACT_TABLES})
    kept["agenda_entries"] = sync.cascade(orphans, {"agenda_entries": store.state("agenda_entries", touched)})["agenda_entries"]
    for name, rows in sync.fact_children(facts, ids, fresh).items():
        kept[name] = kept[name].unionByName(rows.select(*kept[name].columns))
    for name, rows in kept.items():
        store.replace(name, rows, touched)
    store.replace("assignments", batch["merged"].join(orphans.withColumnRenamed("assignment_id", "id"), sync.KEY, "left_anti"), touched)
    store.replace("courses", new_courses, touched)
    # last: a run that failed before is repeated as a whole, and logs once
    write_log(store, extraction["provenance"].withColumn("created_at", F.col("extracted_at")), number)
    return finish(store, summary, number)


def answered(
    store: TableStore, artifacts: DataFrame, kinds: tuple[str, ...], limit: int, template: str, schema: str, answer: Callable[[str], str], name: str, number: int
) -> DataFrame:
    """Artifacts of some kinds packed, asked about and parsed: course keys, chunk, part, artifact_ids, response, parsed, error."""
    picked = E.select_artifacts(artifacts, kinds).withColumn("size", E.artifact_size(F.col("text")))
    chunks = picked.join(E.pack_chunks(picked, max_chars=limit), [*COURSE, "position"])
    got = answers.ask(E.build_prompts(chunks, template), answer, template, f"{store.root}/answers/{name}", batch=number)
    parsed = P.parse_model_json(got.withColumnRenamed("error", "call_error"), schema)
    store.write(f"{name}_responses", parsed.withColumn("error", F.coalesce("call_error", "error")).drop("call_error"), number)
    return store.read(f"{name}_responses", number)


def extract_facts(
    store: TableStore, artifacts: DataFrame, answer: Callable[[str], str], *, fact_template: str = "", rule_template: str = "", tz: str, now: datetime
) -> dict[str, DataFrame]:
    """Captured artifacts as an extraction: what `sync_extraction_frames` takes.

    artifacts: course keys, course_code, course_name, position (unique in a course), id, page_kind, source_platform, title, url, parent_url, score_text,
    text and, for due dates in the markup, html. Prompts that were answered in an earlier run are not asked again; failed ones leave their error in the responses.
    """
    number = next_run(store)
    told = answered(store, artifacts, E.ASSIGNMENT_KINDS, E.ASSIGNMENT_CHUNK, fact_template, schemas.FACTS_RESPONSE, answer, "facts", number)
    ruled = answered(store, artifacts, E.RULE_KINDS, E.RULE_CHUNK, rule_template, schemas.RULES_RESPONSE, answer, "rules", number)
    at = lambda chunk, part, i: F.struct(chunk.cast("long").alias("chunk"), part.alias("part"), i.cast("int").alias("i")).alias("position")
    raw = told.where("error is null").select(*COURSE, "chunk", "part", F.posexplode("parsed.assignments").alias("i", "f")).select(
        *COURSE, at(F.col("chunk"), F.col("part"), F.col("i")), "f.*"
    )
    if "html" in artifacts.columns:
        # dates in the markup come before everything a prompt found
        marked = P.html_due_facts(artifacts, tz=tz, now=now).join(artifacts.select(*COURSE, "id", F.col("position").alias("_at")), [*COURSE, "id"])
        marked = marked.withColumn("position", at(F.lit(0), F.format_string("%019d", "_at"), F.col("pos"))).drop("id", "pos", "_at")
        raw = raw.unionByName(marked, allowMissingColumns=True)
    store.write("extracted_facts", raw, number)
    raw = store.read("extracted_facts", number)
    rules = ruled.where("error is null").select(*COURSE, at(F.col("chunk"), F.col("part"), F.lit(0)), "parsed.*")
    facts, merged = E.consolidate_facts(raw), E.merge_rules(rules)
    categories = merged.select(*COURSE, F.posexplode("grade_categories").alias("position", "c")).select(*COURSE, "position", "c.*")
    seen = artifacts.groupBy(*COURSE).agg(F.min("course_code").alias("_code"), F.min("course_name").alias("_name"), F.count(F.lit(1)).alias("artifact_count"))
    grade = E.extracted_grade(facts, categories, tz=tz, now=now).select(*COURSE, "current_grade_pct")
    stamp = reconcile.instant(now).alias("extracted_at")
    courses = seen.join(merged.drop("course_code", "course_name"), COURSE, "left").join(grade, COURSE, "left").select(
        *COURSE, stamp, F.col("_code").alias("course_code"), F.col("_name").alias("course_name"),
        F.coalesce("grade_categories", F.array().cast(merged.schema["grade_categories"].dataType)).alias("grade_categories"),
        F.coalesce("grading_scale", F.create_map().cast(merged.schema["grading_scale"].dataType)).alias("grading_scale"), "late_policy", "current_grade_pct", "artifact_count",
    )
    logged = E.extraction_log(told, stage="extract_assignments").unionByName(E.rules_log(ruled, stage="extract_rules"))
    events = logged.select(*COURSE, stamp, F.col("chunk").alias("position"), "stage", F.lit(None).cast("string").alias("text_preview"), "detail")
    children = {name: getattr(E, name)(raw) for name in FACT_TABLES}
    return {"courses": courses, "facts": facts.withColumn("extracted_at", stamp), "categories": categories, "provenance": events, **children}


def newest_scopes(seen: DataFrame, rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Courses and assignments of the newest document of each course and platform."""
    captured = seen.select(*SCOPE, "fetched_at").unionByName(rows.select(*SCOPE, "fetched_at"))
    newest = captured.groupBy(*SCOPE).agg(F.max("fetched_at").alias("fetched_at"))
    pick = lambda df: df.join(newest, [*SCOPE, "fetched_at"], "left_semi")
    return pick(seen), pick(rows)


def sync_publisher_frames(store: TableStore, seen: DataFrame, rows: DataFrame, *, now: datetime) -> DataFrame:
    """One synchronisation of publisher snapshots; courses the tables do not know are reported, their rows left out."""
    touched = store.touched(seen, rows)
    courses, assignments = store.state("courses", touched), store.state("assignments", touched)
    number = next_run(store)
    store.write("skipped_input", skipped(seen.join(courses.select(*COURSE), COURSE, "left_anti"), "course is not known"), number)
    known = lambda df: df.join(courses.select(*COURSE), COURSE, "left_semi")
    seen, rows = newest_scopes(known(seen), known(rows))
    scraped, merged, summary = sync.sync_publisher(courses, assignments, seen, rows, now=now)
    summary, scraped = stage(summary), stage(scraped)
    store.replace("assignments", merged, touched)
    store.replace("courses", scraped, touched)
    return finish(store, summary, number)


def parse_syllabi(store: TableStore, answer: Callable[[str], str], template: str, *, now: datetime, force: bool = False) -> DataFrame:
    """Ask `answer` about each syllabus that waits, apply what parses, and log every attempt; failures stay pending.

    Returns one row per attempt: course keys, response, error. Responses are written before they are used, so none is asked for twice.
    """
    pending = stage(P.pending_syllabi(store.state("courses"), force=force))
    number = next_run(store)
    touched = store.touched(pending)
    courses = store.state("courses", touched)
    prompts = pending.select(
        *COURSE, F.lit(0).cast("long").alias("chunk"), F.col("code").alias("course_code"), F.col("name").alias("course_name"),
        F.array(F.lit("syllabus")).alias("artifact_ids"), F.array("syllabus_raw_text").alias("bodies"), F.lit(None).cast("string").alias("prompt"),
    )
    store.write("syllabus_responses", E.batch_extract(prompts, answer, template).withColumnRenamed("error", "call_error"), number)
    parsed = P.parse_model_json(store.read("syllabus_responses", number), schemas.PARSED_SYLLABUS).withColumns(
        {"error": F.coalesce("call_error", "error"), "parsed_at": reconcile.instant(now)}
    )
    events = parsed.select(
        *COURSE, F.col("parsed_at").alias("created_at"), F.lit(SYLLABUS_STAGE).alias("stage"), F.lit(0).cast("long").alias("position"),
        F.col("response").alias("text_preview"), F.to_json(F.struct(F.when(F.col("error").isNull(), "parsed").otherwise("failed").alias("result"), "error")).alias("detail"),
    )
    write_log(store, events, number)
    applied = P.apply_syllabus_parse(courses, parsed.where("error is null").select(*COURSE, "parsed", "parsed_at"))
    store.replace("courses", applied.select(*courses.columns), touched)
    finish(store, sync.sync_summary(parsed.where("error is null"), courses.limit(0), courses.limit(0)), number)
    return parsed.select(*COURSE, "response", "error")


def build_overview(
    store: TableStore, *, tz: str, now: datetime, horizon_days: int = 7, daily_minutes: int = 120
) -> dict[str, DataFrame]:
    """Canonical rows, grades, plan and overview tables from the current tables."""
    today = agenda.local_today(now, tz)
    courses = store.read("courses")
    canonical = reconcile.canonical_assignments(store.read("assignments"), now=now)
    number = store.write("canonical", reconcile.with_deadline(canonical, tz=tz))
    dated = store.read("canonical", number)
    stored = reconcile.attach_courses(dated, courses)
    final = store.read("course_grades", store.write("course_grades", grades.course_grades(stored, now=now)))
    rows = priority.priority_scores(reconcile.attach_courses(dated, courses, final), today=today)
    scored = store.read("scored", store.write("scored", rows))
    shown = overview.relevant(scored)
    labelled = overview.urgency_labels(
        overview.due_labels(priority.priority_reasons(shown), tz=tz), now=now, today=today
    )
    plan = agenda.plan_agenda(shown, today=today, horizon_days=horizon_days, daily_minutes=daily_minutes)
    plan = store.read("plan", store.write("plan", plan))
    items = agenda.agenda_items(plan, labelled)
    return {
        "canonical": dated,
        "course_grades": final,
        "courses": overview.course_health(courses, stored, now=now),
        "upcoming": overview.due_soon(labelled),
        "agenda_entries": items,
        "agenda_days": agenda.agenda_days(items),
        "today": overview.today_focus(items, today=today),
        "summary": overview.summary(courses, scored, now=now, today=today),
    }


def captured_artifacts(spark: SparkSession, manifest_path: str, bodies_path: str) -> DataFrame:
    """Artifacts of crawl manifests with their texts, as `extract_facts` takes them."""
    courses, listed = snapshots.read_crawl_manifest(spark, manifest_path)
    names = courses.groupBy(*COURSE).agg(F.min("code").alias("_code"), F.min("name").alias("course_name"))
    texts = P.artifact_text(snapshots.read_artifact_bodies(spark, listed, bodies_path)).withColumn("score_text", F.col("metadata")["pearson_score_text"])
    return texts.join(names, COURSE, "left").withColumn("course_code", F.coalesce("course_code", "_code", F.lit(""))).withColumn("course_name", F.coalesce("course_name", F.lit(""))).drop("_code")


def refresh(
    spark: SparkSession, root: str, *, lms_path: str | None = None, publisher_path: str | None = None, extraction_path: str | None = None,
    manifest_path: str | None = None, bodies_path: str | None = None, artifacts: DataFrame | None = None, answer: Callable[[str], str] | None = None,
    fact_template: str = "", rule_template: str = "", syllabus_template: str = "", tz: str, now: datetime, mode: str = "full", horizon_days: int = 7, daily_minutes: int = 120,
) -> dict[str, DataFrame]:
    """Synchronise whatever was captured, let `answer` (if given) read artifacts and the syllabi that wait, then rebuild the overview.

    Artifacts come as a frame (see `extract_facts`), or from a manifest with the folder of their bodies.
    """
    if extraction_path is not None and manifest_path is None:
        raise ValueError("an extraction needs the manifest of its artifacts: manifest_path")
    configure(spark)
    store = TableStore(spark, root)
    if lms_path is not None:
        frames = snapshots.explode_lms_snapshot(snapshots.read_lms_snapshot(spark, lms_path))
        sync_lms_frames(store, frames, tz=tz, now=now)
    if publisher_path is not None:
        sync_publisher_frames(store, *snapshots.read_publisher_snapshot(spark, publisher_path), now=now)
    if extraction_path is not None:
        extraction = snapshots.read_extraction(spark, extraction_path)
        sync_extraction_frames(store, extraction, snapshots.read_crawl_manifest(spark, manifest_path)[1], now=now, mode=mode)
    if artifacts is None and bodies_path is not None and manifest_path is not None:
        artifacts = captured_artifacts(spark, manifest_path, bodies_path)
    if artifacts is not None and answer is not None:
        extraction = extract_facts(store, artifacts, answer, fact_template=fact_template, rule_template=rule_template, tz=tz, now=now)
        sync_extraction_frames(store, extraction, artifacts, now=now, mode=mode)
    if answer is not None:
        parse_syllabi(store, answer, syllabus_template, now=now)
    return build_overview(store, tz=tz, now=now, horizon_days=horizon_days, daily_minutes=daily_minutes)
