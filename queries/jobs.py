"""Jobs that keep state on shared storage: artifacts to facts, partitioned tables, the log, arriving snapshots."""

from __future__ import annotations

import json
import re
import uuid

from pyspark.sql import functions as F

from queries import views as V
from queries.canonical import stamp
from termloom.operators import sync as S
from termloom.plans import refresh
from termloom.session import checkpoint_dir, stage
from termloom.sources.tables import TableStore
from termloom.streaming import jobs as J


def _folder(spark, name):
    """A folder of its own for each call."""
    return f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


def say(prompt: str) -> str:
    """A deterministic stand-in for a model: one fact per artifact of the prompt, numbered by the artifact's id."""
    facts = []
    for n in map(int, re.findall(r"(?m)^artifact_id: a(\d+)$", prompt)):
        facts.append({
            "title": f"Task {n % 50}", "assignment_type": "lab" if n % 3 else "homework", "source_platform": "d2l", "points_possible": 1 + n % 7,
            "weight_pct": 5.0 if n % 4 == 0 else None, "due_on": f"1998-06-{1 + n % 28:02d}", "evidence_artifact_ids": [f"a{n}"],
            "evidence_spans": [{"artifact_id": f"a{n}", "quote": f"quote {n % 5}"}], "notes": [f"note {n % 3}"],
        })
    return "```json\n" + json.dumps({"assignments": facts, "grade_categories": [{"name": "Labs", "weight": 0.4}], "notes": []}) + "\n```"


def _artifacts(spark, sf):
    return V.table(spark, sf, "documents").select(
        F.lit(1).cast("bigint").alias("student_id"), F.col("source").alias("course_id"), F.col("source").alias("course_code"), F.col("source").alias("course_name"),
        F.col("doc_id").alias("position"), F.concat(F.lit("a"), F.col("doc_id").cast("string")).alias("id"), F.lit("content_outline_topic").alias("page_kind"),
        F.lit("d2l").alias("source_platform"), F.col("lang").alias("title"), F.concat(F.lit("https://l/"), F.col("doc_id").cast("string")).alias("url"),
        F.lit(None).cast("string").alias("parent_url"), F.lit(None).cast("string").alias("score_text"), "text",
    )


def _extracted(spark, sf):
    store = TableStore(spark, _folder(spark, "extract"), buckets=4)
    artifacts = _artifacts(spark, sf)
    refresh.sync_extraction_frames(store, refresh.extract_facts(store, artifacts, say, tz=V.TZ, now=V.NOW), artifacts, now=V.NOW)
    return store


def extract_artifacts(spark, sf):
    """Documents as artifacts: packed, asked about, parsed, consolidated and synchronised."""
    rows = _extracted(spark, sf).state("assignments")
    return rows.select("course_id", "id", "title", "type", "points_possible", "grade_weight_pct", stamp("due_date").alias("due_date"), "external_url", "status")


def extracted_children(spark, sf):
    """Child rows of the facts, as the job stores them."""
    store = _extracted(spark, sf)
    one = lambda name, value: store.state(name).select(F.lit(name).alias("part"), "course_id", "assignment_id", F.col(value).alias("value"))
    return one("fact_evidence", "quote").unionByName(one("fact_notes", "note")).unionByName(one("fact_artifacts", "artifact_id"))


def partitioned_upsert(spark, sf):
    """A table of all orders in buckets, then an upsert of every seventh student that touches only these students' buckets."""
    store = TableStore(spark, _folder(spark, "upsert"), buckets=16)
    orders = V.table(spark, sf, "orders")
    shape = lambda df, note: df.selectExpr(
        "o_custkey as student_id", "cast(o_orderkey as string) as assignment_id", "cast(o_orderdate as date) as agenda_date", "int(o_orderkey % 90) as planned_minutes",
        "o_totalprice as priority_score", f"'{note}' as notes",
    )
    first, second = shape(orders.where("o_orderkey % 10 <> 0"), "old"), shape(orders.where("o_orderkey % 3 <> 0 and o_custkey % 7 = 0"), "new")
    store.replace("agenda_entries", first, list(range(store.buckets)))
    touched = store.touched(second)
    store.replace("agenda_entries", S.upsert(store.state("agenda_entries", touched), second, S.CHILD), touched)
    return store.state("agenda_entries").withColumn("agenda_date", F.col("agenda_date").cast("string"))


def newest_log(spark, sf):
    """Events appended in three batches, the last of them twice; the newest 500 of one kind."""
    store = TableStore(spark, _folder(spark, "log"))
    events = V.table(spark, sf, "events").select(
        "event_id", F.lit(1).cast("bigint").alias("student_id"), F.concat(F.lit("c"), (F.col("user_id") % 5).cast("string")).alias("course_id"), F.col("event_type").alias("stage"),
        F.lit(None).cast("string").alias("text_preview"), F.concat(F.lit('{"value":'), F.col("event_id").cast("string"), F.lit("}")).alias("detail"),
    )
    for batch in (1, 2, 3, 3):
        store.append_log(S.append_log(events.where(f"event_id % 3 = {batch - 1}"), batch=batch, sequence="event_id"), batch)
    return S.query_log(store.log(), course_id="c1", limit=500).select("log_id", "course_id", "stage", "detail")


def cascade_prune(spark, sf):
    """One orphan set takes agenda entries, evidence and notes along."""
    orders = V.table(spark, sf, "orders")
    keyed = orders.selectExpr("o_custkey as student_id", "cast(o_orderkey as string) as assignment_id", "o_orderkey")
    orphans = keyed.where("student_id % 4 = 1 and o_orderkey % 3 = 0").select(*S.CHILD)
    lines = V.table(spark, sf, "lineitem").selectExpr("l_orderkey", "l_linenumber").join(keyed, F.expr("l_orderkey = o_orderkey"))
    tables = {
        "agenda": keyed.selectExpr(*S.CHILD, "0 as n"), "evidence": lines.selectExpr(*S.CHILD, "l_linenumber as n"),
        "notes": lines.where("l_linenumber = 1").selectExpr(*S.CHILD, "l_linenumber as n"),
    }
    kept = S.cascade(orphans, tables)
    first, *rest = [rows.select(F.lit(name).alias("part"), *S.CHILD, F.col("n").cast("int").alias("n")) for name, rows in kept.items()]
    for rows in rest:
        first = first.unionByName(rows)
    return first


def stream_newest(spark, sf):
    """Snapshots built from orders, streamed to the end in two orders, one batch twice: the tables end up the same."""
    orders = V.table(spark, sf, "orders").selectExpr(
        "o_custkey as student_id", "concat('c', o_custkey % 3) as course_id", "cast(o_orderdate as timestamp) + make_interval(0, 0, 0, 0, 0, 0, o_orderkey % 86400) as fetched_at",
        "to_json(named_struct('order', o_orderkey, 'price', o_totalprice)) as body", "int(o_orderkey div 4 % 4) as part",
    )
    out = None
    for name, order in (("up", (0, 1, 2, 2, 3)), ("down", (3, 2, 1, 1, 0))):
        folder = _folder(spark, f"arriving-{name}")
        store = TableStore(spark, f"{folder}/tables", buckets=8)

        def one_batch(batch, _, store=store):
            # a batch is computed anew by every step that reads it
            rows = stage(batch.selectExpr("student_id", "course_id as assignment_id", "cast(fetched_at as date) as agenda_date", "int(0) as planned_minutes", "0D as priority_score",
                                    "concat(date_format(fetched_at, 'yyyy-MM-dd HH:mm:ss'), ' ', body) as notes").distinct())
            touched = store.touched(rows)
            store.replace("agenda_entries", S.upsert(store.state("agenda_entries", touched), rows, S.CHILD), touched)

        for k, part in enumerate(order):
            orders.where(f"part = {part}").drop("part").write.parquet(f"{folder}/in/{k}")
            arriving = spark.readStream.schema(J.ARRIVED).option("recursiveFileLookup", True).parquet(f"{folder}/in")
            J.newest_only(arriving).writeStream.foreachBatch(one_batch).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()
        rows = store.state("agenda_entries").select(F.lit(name).alias("arrival"), "student_id", F.col("assignment_id").alias("course_id"), "notes")
        out = rows if out is None else out.unionByName(rows)
    return out


FACTS = """with f as (select source as course_id, doc_id as n, 'Task ' || doc_id % 50 as title, 'task-' || doc_id % 50 as key from documents)"""
QUERIES = {
    "extract_artifacts": (
        extract_artifacts,
        FACTS + """, m as (select course_id, key, any_value(title) as title, arg_min(case when n % 3 <> 0 then 'lab' else 'homework' end, n) as type, arg_min(1 + n % 7, n)::double as points_possible,
          case when count(*) filter (n % 4 = 0) > 0 then 5.0::double end as grade_weight_pct, arg_min(n % 28 + 1, n) as day, min('a' || n) as first_artifact from f group by course_id, key)
          select course_id, course_id || '-' || key as id, title, type, points_possible, grade_weight_pct, '1998-06-' || printf('%02d', cast(day as integer)) || ' 23:59:00' as due_date,
          'https://l/' || substr(first_artifact, 2) as external_url, 'upcoming' as status from m""",
    ),
    "extracted_children": (
        extracted_children,
        FACTS + """ select 'fact_evidence' as part, course_id, course_id || '-' || key as assignment_id, 'quote ' || n % 5 as value from (select distinct course_id, key, n from f)
          union all select distinct 'fact_notes', course_id, course_id || '-' || key, 'note ' || n % 3 from f
          union all select distinct 'fact_artifacts', course_id, course_id || '-' || key, 'a' || n from f""",
    ),
    "partitioned_upsert": (
        partitioned_upsert,
        """with o as (select o_custkey as student_id, cast(o_orderkey as varchar) as assignment_id, cast(cast(o_orderdate as date) as varchar) as agenda_date, cast(o_orderkey % 90 as int) as planned_minutes,
          o_totalprice as priority_score, o_orderkey as k from orders)
          select student_id, assignment_id, agenda_date, planned_minutes, priority_score, case when k % 3 <> 0 and student_id % 7 = 0 then 'new' else 'old' end as notes
          from o where k % 10 <> 0 or (k % 3 <> 0 and student_id % 7 = 0)""",
    ),
    "newest_log": (
        newest_log,
        """select (event_id % 3 + 1) * 1099511627776 + event_id as log_id, 'c1' as course_id, event_type as stage, '{"value":' || event_id || '}' as detail
          from events where user_id % 5 = 1 order by 1 desc limit 500""",
    ),
    "cascade_prune": (
        cascade_prune,
        """with o as (select o_custkey as student_id, cast(o_orderkey as varchar) as assignment_id, o_orderkey as k from orders where not (o_custkey % 4 = 1 and o_orderkey % 3 = 0))
          select 'agenda' as part, student_id, assignment_id, 0::int as n from o union all select 'evidence', student_id, assignment_id, l_linenumber::int from o join lineitem on l_orderkey = k
          union all select 'notes', student_id, assignment_id, 1::int from o join lineitem on l_orderkey = k and l_linenumber = 1""",
    ),
    "stream_newest": (
        stream_newest,
        """with o as (select o_custkey as student_id, 'c' || o_custkey % 3 as course_id, cast(o_orderdate as timestamp) + to_seconds(o_orderkey % 86400) as fetched_at, o_orderkey, o_totalprice from orders),
          n as (select student_id, course_id, strftime(max(fetched_at), '%Y-%m-%d %H:%M:%S') as seen, arg_max(o_orderkey, fetched_at) as k from o group by all)
          select arrival, student_id, course_id, seen || ' {"order":' || k || ',"price":' || (select any_value(o_totalprice) from orders where o_orderkey = k) || '}' as notes
          from n, (values ('up'), ('down')) v(arrival)""",
    ),
}
