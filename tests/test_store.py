"""State in buckets, the log by batch, the ledger of answers, the job from artifacts to facts, arriving snapshots."""

from __future__ import annotations

import glob
import json
import os
from datetime import UTC, datetime

import pytest
from pyspark.sql import functions as F

from termloom.functions import lookup
from termloom.operators import answers, sync
from termloom.operators import extraction as E
from termloom.plans import refresh
from termloom.session import checkpoint_dir
from termloom.sources.tables import TableStore, bucket_of
from termloom.streaming import jobs

NOW = datetime(2026, 3, 24, 12, tzinfo=UTC)
TZ = "America/Chicago"
ARTIFACTS = """student_id bigint, course_id string, course_code string, course_name string, position bigint, id string, page_kind string, source_platform string,
  title string, url string, parent_url string, score_text string, text string, html string"""


def files(root, name):
    return {os.path.relpath(p, root) for p in glob.glob(f"{root}/{name}/*/part-*.parquet")}


def entries(spark, rows):
    return spark.createDataFrame([(s, a, None, m, 0.0, n) for s, a, m, n in rows], "student_id bigint, assignment_id string, agenda_date date, planned_minutes int, priority_score double, notes string")


def test_an_upsert_leaves_other_buckets_as_they_were(spark, tmp_path):
    root = str(tmp_path / "t")
    store = TableStore(spark, root, buckets=8)
    rows = [(s, f"a{k}", k, "old") for s in range(40) for k in range(3)]
    store.replace("agenda_entries", entries(spark, rows), list(range(8)))
    before = files(root, "agenda_entries")
    batch = entries(spark, [(7, "a1", 99, "new"), (7, "a9", 1, "new")])
    touched = store.touched(batch)
    mine = spark.range(1).select(bucket_of(F.lit(7).cast("bigint"), 8)).first()[0]
    assert touched == [mine] and len(before) >= 8
    part = store.state("agenda_entries", touched)
    assert "PartitionFilters: [isnotnull(bucket" in part._jdf.queryExecution().executedPlan().toString()
    for _ in range(2):  # a repeat changes nothing
        store.replace("agenda_entries", sync.upsert(store.state("agenda_entries", touched), batch, sync.CHILD), touched)
        got = {(r["student_id"], r["assignment_id"]): (r["planned_minutes"], r["notes"]) for r in store.state("agenda_entries").collect()}
        assert len(got) == 121 and got[7, "a1"] == (99, "new") and got[7, "a0"] == (0, "old") and got[8, "a1"] == (1, "old")
    after = files(root, "agenda_entries")
    moved = {p for p in before ^ after}
    assert moved and all(f"bucket={mine}/" in p for p in moved)
    # a bucket that loses all rows is empty afterwards
    store.replace("agenda_entries", store.state("agenda_entries", touched).limit(0), touched)
    assert store.state("agenda_entries", touched).count() == 0 and store.state("agenda_entries").count() < 121


def test_the_log_grows_by_partitions(spark, tmp_path):
    root = str(tmp_path / "t")
    store = TableStore(spark, root)
    event = lambda batch, n: spark.range(n).selectExpr("1L as student_id", "'c' as course_id", "'s' as stage", "'p' as text_preview", "'{}' as detail", "id as sequence", f"{batch} as b")
    for batch, n in ((1, 5), (2, 4)):
        store.append_log(sync.append_log(event(batch, n), batch=batch, sequence="sequence"), batch)
    before = files(root, "log")
    store.append_log(sync.append_log(event(3, 3), batch=3, sequence="sequence"), 3)
    assert before < files(root, "log")
    store.append_log(sync.append_log(event(3, 2), batch=3, sequence="sequence"), 3)  # a repeat replaces its own
    assert before < files(root, "log") and store.read("log").count() == 11
    newest = sync.query_log(store.log(), limit=4)
    assert [r["log_id"] >> sync.LOG_BITS for r in newest.collect()] == [3, 3, 2, 2]
    assert "batch#" in newest._jdf.queryExecution().executedPlan().toString() and ">= 2" in newest._jdf.queryExecution().executedPlan().toString()
    assert sync.query_log(store.log(), course_id="none", limit=4).count() == 0


def artifact_rows(spark, ids, course="c"):
    rows = [(1, course, "C1", "Course", i, f"a{i}", "tool_content" if i == 0 else "content_outline_topic", "d2l", f"T{i}", f"https://l/d2l/home/{i}", None, None, f"text {i} " + "x" * 3000,
             '<h3>Essay - Due</h3> <abbr class="d2l-fuzzydate" title="Mar 29, 2026 11:59 PM">soon</abbr>' if i == 0 else None) for i in ids]
    return spark.createDataFrame(rows, ARTIFACTS.replace("\n", " "))


def teller(path, *, slow=False, broken=""):
    """A callable that notes each call in a file and tells one fact per artifact."""

    def answer(prompt: str) -> str:
        with open(path, "a") as f:
            f.write("call\n")
        if broken and broken in prompt:
            raise ValueError("broken")
        found = [w.split("\n")[0] for w in prompt.split("artifact_id: ")[1:]]
        if slow and len(found) > 2:
            raise TimeoutError("slow")
        facts = [{"title": f"Task {a}", "points_possible": 10, "evidence_artifact_ids": [a], "evidence_spans": [{"artifact_id": a, "quote": f"q {a}"}], "notes": [f"n {a}"]} for a in found]
        return json.dumps({"assignments": facts, "grade_categories": [{"name": "Labs", "weight": 0.4}], "grading_scale": {"A": [90]}, "notes": ["x"]})

    return answer


def calls(path):
    return len(open(path).readlines()) if os.path.exists(path) else 0


def test_a_prompt_is_asked_once(spark, tmp_path):
    log, ledger = str(tmp_path / "calls"), str(tmp_path / "ledger")
    artifacts = artifact_rows(spark, range(1, 9)).withColumn("size", E.artifact_size(F.col("text")))
    chunks = artifacts.join(E.pack_chunks(artifacts, max_chars=12_000), ["student_id", "course_id", "position"])
    prompts = E.build_prompts(chunks, "Go")
    both = prompts.unionByName(prompts.withColumn("course_id", F.lit("d")))  # another course with the same texts
    got = answers.ask(both, teller(log, slow=True), "Go", ledger, batch=1).collect()
    n, asked = prompts.count(), calls(log)
    assert n > 1 and {r["course_id"] for r in got} == {"c", "d"} and all(r["error"] is None for r in got)
    assert sorted(a for r in got if r["course_id"] == "d" for a in r["artifact_ids"]) == [f"a{i}" for i in range(1, 9)]
    again = answers.ask(both, teller(log), "Go", ledger, batch=2).collect()
    assert calls(log) == asked and sorted(map(str, again)) == sorted(map(str, got))
    more = E.build_prompts(chunks.withColumn("title", F.lit("other")), "Go")
    failed = answers.ask(more, teller(log, broken="text 1 "), "Go", ledger, batch=3).collect()
    assert [r["error"] for r in failed if r["error"]] == ["ValueError: broken"]
    before = calls(log)
    mended = answers.ask(more, teller(log), "Go", ledger, batch=4).collect()
    assert calls(log) == before + 1 and all(r["error"] is None for r in mended) and len(mended) == n


def test_artifacts_become_facts_and_go_with_their_children(spark, tmp_path):
    log, root = str(tmp_path / "calls"), str(tmp_path / "tables")
    out = refresh.refresh(spark, root, artifacts=artifact_rows(spark, range(6)), answer=teller(log), tz=TZ, now=NOW)
    store = TableStore(spark, root)
    rows = {r["title"]: r for r in store.read("assignments").collect()}
    assert set(rows) == {"Essay", *(f"Task a{i}" for i in range(1, 6))} and rows["Task a3"]["external_url"] == "https://l/d2l/home/3"
    assert str(rows["Essay"]["due_date"]) == "2026-03-30 04:59:00" and out["summary"].first()["course_count"] == 1
    course = store.read("courses").first()
    assert [c["name"] for c in course["grade_categories"]] == ["Labs"] and course["grading_scale"] == {"A": [90.0]}
    assert {r["quote"] for r in store.read("fact_evidence").collect()} == {f"q a{i}" for i in range(1, 6)}
    assert store.read("fact_artifacts").count() == 6 and store.read("fact_notes").count() == 6
    logged = {r["stage"] for r in store.read("log").collect()}
    assert {"extract_assignments", "extract_rules"} <= logged
    asked = calls(log)
    refresh.refresh(spark, root, artifacts=artifact_rows(spark, range(6)), answer=teller(log), tz=TZ, now=NOW)
    assert calls(log) == asked and store.read("assignments").count() == 6 and store.read("fact_evidence").count() == 5
    # artifacts that are gone take their assignments along, with evidence, notes and cited ids
    refresh.refresh(spark, root, artifacts=artifact_rows(spark, range(3)), answer=teller(log), tz=TZ, now=NOW)
    assert {r["title"] for r in store.read("assignments").collect()} == {"Essay", "Task a1", "Task a2"}
    assert {r["quote"] for r in store.read("fact_evidence").collect()} == {"q a1", "q a2"} and store.read("fact_notes").count() == 3 and store.read("fact_artifacts").count() == 3


def test_only_the_newest_of_a_course_comes_through(spark, tmp_path):
    rows = lambda *r: spark.createDataFrame([(s, c, datetime(2026, 1, d, tzinfo=UTC), b) for s, c, d, b in r], jobs.ARRIVED)
    seen: list[set] = []
    batches = [rows((1, "c", 3, "x"), (1, "c", 2, "old"), (2, "c", 1, "y")), rows((1, "c", 2, "late"), (2, "c", 4, "z")), rows((1, "c", 3, "x"), (2, "c", 3, "late"))]
    for k, batch in enumerate(batches):
        batch.coalesce(1).write.parquet(str(tmp_path / "in" / str(k)))
        arriving = spark.readStream.schema(jobs.ARRIVED).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
        got: set = set()
        query = jobs.newest_only(arriving).writeStream.foreachBatch(lambda df, _, got=got: got.update((r["student_id"], r["body"]) for r in df.collect()))
        query.option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start().awaitTermination()
        seen.append(got)
    assert seen == [{(1, "x"), (2, "y")}, {(2, "z")}, {(1, "x")}]


@pytest.mark.parametrize("name", ["body", "html"])
def test_bodies_come_from_one_scan(spark, tmp_path, name):
    from termloom.sources import snapshots

    (tmp_path / "b").mkdir()
    for k in range(3):
        (tmp_path / "b" / f"{k}.txt").write_text(f"t{k}")
    path = lambda k: None if k is None else str(tmp_path / "b" / f"{k}.txt")
    rows = [(1, "c", "a", path(0), path(1)), (1, "c", "b", path(0), None), (1, "c", "d", path(9), path(2)), (1, "c", "e", None, None), (1, "c", "b", path(0), None)]
    df = spark.createDataFrame(rows, "student_id bigint, course_id string, id string, text_path string, html_path string")
    got = snapshots.read_artifact_bodies(spark, df, str(tmp_path / "b"))
    want = {"body": ["t0", "t0", "t0", None, None], "html": ["t1", None, None, "t2", None]}[name]
    assert [r[name] for r in got.orderBy("id").collect()] == want
    assert got._jdf.queryExecution().executedPlan().toString().count("FileScan text") == 1


def test_texts_of_prompts_do_not_stay(spark, tmp_path):
    """The texts are written once, without the prompt beside its parts, and removed when they are answered."""
    artifacts = artifact_rows(spark, range(4)).withColumn("size", E.artifact_size(F.col("text")))
    chunks = artifacts.join(E.pack_chunks(artifacts, max_chars=2_000), ["student_id", "course_id", "position"])
    root = checkpoint_dir(spark).removeprefix("file:")
    before = set(os.listdir(root)) if os.path.isdir(root) else set()
    assert answers.ask(E.build_prompts(chunks, "Go"), teller(str(tmp_path / "calls")), "Go", str(tmp_path / "ledger"), batch=1).count() > 0
    made = [spark.read.parquet(f"{root}/{name}").columns for name in set(os.listdir(root)) - before if name.startswith("stage-")]
    assert made and not any({"bodies", "prompt"} & set(columns) for columns in made)


@pytest.mark.parametrize("slots", [1, 1 << 16])
def test_chosen_chunks(spark, monkeypatch, slots):
    monkeypatch.setattr(lookup, "SLOTS", slots)
    keyed = spark.range(200).selectExpr("id as _row", "concat('text ', id) as bodies")
    for some in ("_row < 0", "_row % 3 = 0", "_row >= 0"):
        got = answers._chosen(keyed, keyed, keyed.where(some).select("_row")).collect()
        assert sorted(tuple(r) for r in got) == sorted(tuple(r) for r in keyed.where(some).collect())
