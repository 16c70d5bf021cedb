"""Captured documents written from the given tables and read back: snapshots, manifests, extractions, bodies."""

from __future__ import annotations

import os
import uuid

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import functions as F

from queries import views as V
from queries.canonical import stamp
from termloom.operators import normalize as N
from termloom.operators import pages as P
from termloom.session import checkpoint_dir, stage
from termloom.sources import snapshots as R

PER_FILE = 200


def _packed(batches):
    """JSON texts as arrays of at most PER_FILE of them."""
    for batch in batches:
        docs = batch["doc"].tolist()
        lists = [docs[at : at + PER_FILE] for at in range(0, len(docs), PER_FILE)]
        yield pd.DataFrame({"value": ["[" + ",".join(some) + "]" for some in lists]}, dtype=object)


def _write(documents):
    """Documents (doc) as JSON files of at most PER_FILE documents each, however many there are; the folder they are in."""
    folder = f"{checkpoint_dir(documents.sparkSession)}/documents-{uuid.uuid4().hex}"
    files = documents.select(F.to_json("doc").alias("doc")).mapInPandas(_packed, "value string")
    files.write.option("maxRecordsPerFile", 1).text(folder)
    return folder


def _filed(folder):
    """Writes the texts of each name to one file and gives the files; rows come sorted by name."""

    def run(batches):
        place, held = f"{folder}/part-{TaskContext.get().partitionId():05d}", None
        os.makedirs(place, exist_ok=True)

        def close():
            name, lines = held
            path = f"{place}/name={name}"
            # a task that is repeated replaces its files; unfinished ones are hidden from readers
            unfinished = f"{place}/.{uuid.uuid4().hex}"
            with open(unfinished, "wb") as file:
                file.writelines(lines)
            os.replace(unfinished, path)
            return path

        for batch in batches:
            made = []
            for name, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist()):
                if held is None or held[0] != name:
                    if held is not None:
                        made.append(close())
                    held = (name, [])
                held[1].append((text or b"") + b"\n")
            yield pa.RecordBatch.from_arrays([pa.array(made, pa.string())], names=["path"])
        if held is not None:
            yield pa.RecordBatch.from_arrays([pa.array([close()], pa.string())], names=["path"])

    return run


def _one_file_each(documents, folder):
    """Documents (name, text) as one file for each name, all texts of the name as lines of it; the paths of the files.

    On a folder that tasks see as files they write them directly: Spark's writer starts processes for the permissions of each, and a folder of its own
    for each name must be listed by itself.
    """
    spark = documents.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    where = fs.makeQualified(path).toUri()
    if where.getScheme() != "file":
        documents.repartition("name").write.partitionBy("name").text(folder)
        return stage(spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select("path"))
    fs.mkdirs(path)
    named = documents.select(F.coalesce("name", F.lit("__HIVE_DEFAULT_PARTITION__")).alias("name"), "text")
    return stage(named.repartition("name").sortWithinPartitions("name").mapInArrow(_filed(where.getPath()), "path string"))


def _orders(spark, sf):
    """Per customer the orders, in order of their keys."""
    return V.table(spark, sf, "orders").selectExpr("o_custkey as c", "o_orderkey as k", "o_totalprice as price").groupBy("c").agg(F.array_sort(F.collect_list(F.struct("k", "price"))).alias("o"))


def _lms(spark, sf):
    customers = V.table(spark, sf, "customer").selectExpr("c_custkey as c", "c_name", "c_mktsegment").join(_orders(spark, sf), "c", "left").withColumn("o", F.expr("coalesce(o, array())"))
    topic = "named_struct('title', {t}, 'url', concat('https://t/', c, '/', {n}), 'module_title', {m}, 'content_type', 'Link', 'launch_url', {l}, 'extracted_text', {x})"
    course = """named_struct('course_id', cast(c * 10 + {k} as string), 'code', 'C{k}', 'name', c_name, 'offering_code', 'off', 'semester', 'Spring 2026', 'end_date_text', 'end',
      'home_url', concat('https://l/d2l/home/', c * 10 + {k}), 'final_calculated_grade', named_struct('weight_achieved_text', cast(null as string), 'grade_text', concat(c % 100, '.5 %')),
      'tool_links', array(named_struct('name', 'Grades', 'url', concat('https://l/g/', c))),
      'upcoming_events', transform(filter(o, x -> x.k % 5 = {k}), x -> named_struct('title', concat('Event ', x.k), 'due_text', 'MAR 22 11:59 PM', 'details_url', concat('https://l/event/', x.k))),
      'announcements', transform(filter(o, x -> x.k % 7 = {k}), x -> named_struct('title', concat('News ', x.k), 'url', concat('https://l/n/', x.k), 'posted_at_text', 'Mar 1', 'items',
        array(named_struct('title', concat('Item ', x.k), 'url', 'u')))),
      'grade_rows', transform(filter(o, x -> x.k % 2 = {k}), x -> named_struct('title', concat('Order ', x.k), 'is_category', false, 'category_title', cast(null as string),
        'points_text', concat(x.k % 10, ' / 10'), 'weight_achieved_text', cast(null as string), 'grade_text', cast(null as string))),
      'syllabus_topics', array({s}), 'external_tools', array({e}), 'content_outline_topics', array({u}))"""
    parts = {
        "s": topic.format(t="'Syllabus'", n="'s'", m="'Start'", l="cast(null as string)", x="concat('text ', c)"),
        "e": topic.format(t="'MindTap'", n="'e'", m="'Tools'", l="concat('https://cengage/', c)", x="cast(null as string)"),
        "u": topic.format(t="'Week 1'", n="'u'", m="'Week 1'", l="cast(null as string)", x="c_mktsegment"),
    }
    courses = ", ".join(course.format(k=k, **parts) for k in (0, 1))
    doc = f"named_struct('student_id', c, 'fetched_at', '2026-03-20T12:00:00Z', 'source_url', 'https://l', 'courses', array({courses}))"
    return R.explode_lms_snapshot(R.read_lms_snapshot(spark, _write(customers.selectExpr("c", f"{doc} as doc"))))


def snapshot_rows(spark, sf):
    """Grade rows, events and announcement items of LMS snapshots with their positions."""
    frames = _lms(spark, sf)
    pick = lambda name: frames[name].select(F.lit(name).alias("part"), "student_id", "course_id", F.col("position").cast("int").alias("position"), "title")
    return pick("grade_rows").unionByName(pick("events")).unionByName(pick("announcements"))


def snapshot_topics(spark, sf):
    """Topics of all three lists in their order."""
    topics = _lms(spark, sf)["topics"]
    at = F.when(F.col("position") >= R.OUTLINE_OFFSET, F.col("position") - R.OUTLINE_OFFSET).otherwise(F.col("position"))
    return topics.select("student_id", "course_id", "kind", at.cast("int").alias("position"), "title", "url", "launch_url", "extracted_text")


def normalized_courses(spark, sf):
    out = N.normalize_courses(_lms(spark, sf))
    return out.select("student_id", "course_id", "d2l_course_id", "code", "name", "semester", "d2l_url", "current_grade_pct", "external_platform", "external_platform_url",
                      F.array_join(F.array_sort(F.map_keys("external_platform_urls")), ",").alias("tools"), F.md5("syllabus_raw_text").alias("syllabus_md5"))


def publisher_rows(spark, sf):
    """Assignments of publisher snapshots with the launch URL of their course."""
    doc = """named_struct('student_id', c, 'fetched_at', '2026-03-20T12:00:00Z', 'courses', array(named_struct('course_id', 'c', 'source_platform', 'pearson_mylab', 'launch_url', concat('https://p/', c), 'title', 'T')),
      'assignments', transform(o, x -> named_struct('id', concat('p-', x.k), 'course_id', 'c', 'source_platform', 'pearson_mylab', 'title', concat('Order ', x.k), 'type', 'homework', 'status', 'upcoming',
        'due_at', '2026-03-25T01:02:03Z', 'points_possible', x.price, 'estimated_minutes', int(x.k % 60))))"""
    courses, rows = R.read_publisher_snapshot(spark, _write(_orders(spark, sf).selectExpr("c", f"{doc} as doc")))
    launch = courses.select("student_id", "course_id", "source_platform", "launch_url")
    return rows.join(launch, ["student_id", "course_id", "source_platform"]).select("student_id", "position", "id", "title", "points_possible", "estimated_minutes", stamp("due_at").alias("due_at"), "launch_url")


def manifest_artifacts(spark, sf):
    """Artifacts of crawl manifests with the course they belong to."""
    doc = """named_struct('student_id', c, 'fetched_at', '2026-03-20T12:00:00Z', 'artifacts_dir', '/a', 'courses', array(named_struct('course_id', 'c', 'code', concat('C', c), 'name', 'N', 'artifact_count', size(o))),
      'artifacts', transform(o, x -> named_struct('id', concat('a', x.k), 'course_id', 'c', 'source_platform', 'd2l', 'page_kind', if(x.k % 2 = 0, 'tool_grades', 'course_home'), 'title', concat('Order ', x.k),
        'url', concat('https://l/', x.k), 'text_path', concat('/a/', x.k, '.txt'), 'metadata', map('price', cast(x.price as string)))))"""
    courses, artifacts = R.read_crawl_manifest(spark, _write(_orders(spark, sf).selectExpr("c", f"{doc} as doc")))
    codes = courses.select("student_id", "course_id", F.col("code").alias("course"), F.col("artifact_count").alias("n"))
    return artifacts.join(codes, ["student_id", "course_id"]).select("student_id", "position", "id", "page_kind", "text_path", "course", "n")


def extraction_rows(spark, sf):
    """Facts of extraction documents, with the key and first cited artifact the reader adds."""
    doc = """named_struct('student_id', c, 'extracted_at', '2026-03-20T12:00:00Z', 'courses', array(named_struct('course_id', 'c', 'course_code', 'C', 'course_name', 'N', 'assignments',
      transform(o, x -> named_struct('title', concat('Order ', x.k % 100, ' : Unit ', x.k % 3), 'source_platforms', if(x.k % 3 = 0, cast(null as array<string>), array('d2l')), 'points_possible', x.price,
        'evidence_artifact_ids', if(x.k % 2 = 0, array(concat('a', x.k), 'b'), array()))),
      'grade_categories', array(named_struct('name', 'HW', 'weight', 0.5D)), 'provenance_events', array(named_struct('stage', 'extract', 'detail', '{}')))))"""
    facts = R.read_extraction(spark, _write(_orders(spark, sf).selectExpr("c", f"{doc} as doc")))["facts"]
    return facts.select("student_id", "course_id", "position", "title", "fact_key", F.array_join("source_platforms", ",").alias("platforms"), "points_possible", "first_artifact_id")


def artifact_bodies(spark, sf):
    """Documents written as one file each; artifacts name one of them as their text, every third another as their HTML, some a missing file."""
    folder = f"{checkpoint_dir(spark)}/bodies-{uuid.uuid4().hex}"
    documents = V.table(spark, sf, "documents").select("doc_id", "text")
    listed = _one_file_each(documents.select(F.col("doc_id").cast("string").alias("name"), "text"), folder)
    listed = listed.select("path", F.regexp_extract("path", r"name=(-?\d+)", 1).try_cast("long").alias("n"))
    at = lambda name, of: listed.select(F.col("path").alias(name), F.col("n").alias(of))
    artifacts = documents.select("doc_id", (F.col("doc_id") - F.col("doc_id") % 10).alias("other")).join(at("text_path", "t"), F.expr("doc_id = t")).join(at("html_path", "h"), F.expr("other = h and doc_id % 3 = 0"), "left")
    artifacts = artifacts.select(
        F.lit(1).cast("bigint").alias("student_id"), F.lit("c").alias("course_id"), F.col("doc_id").alias("id"), F.when(F.col("doc_id") % 7 == 0, "/none/x.txt").otherwise(F.col("text_path")).alias("text_path"), "html_path",
    )
    got = R.read_artifact_bodies(spark, artifacts, folder)
    return got.select("id", F.sha2(F.col("body"), 256).alias("body_sha256"), F.sha2(F.col("html"), 256).alias("html_sha256"))


def content_topics(spark, sf):
    """Documents as topics of modules: syllabus, external tools, assignment lists of schedule modules, and one view per schedule module."""
    titles = ("Syllabus and policies", "MindTap tools", "Week 3", "Misc", "Weekly tasks")
    d = V.table(spark, sf, "documents").withColumns({"student_id": F.lit(1).cast("bigint"), "course_id": F.col("source"), "module_position": F.col("doc_id") % len(titles)})
    named = d.withColumn("module_title", F.element_at(F.array(*[F.lit(t) for t in titles]), (F.col("module_position") + 1).cast("int")))
    topics = named.select(
        "student_id", "course_id", "module_title", "module_position", F.col("doc_id").alias("position"), F.when(F.col("doc_id") % 4 == 0, "Assignment list").otherwise(F.concat(F.lit("Reading "), "lang")).alias("title"),
        F.concat(F.lit("https://t/"), (F.col("doc_id") % 300).cast("string")).alias("url"), F.when(F.col("doc_id") % 6 == 1, "External Learning Tool").otherwise("Link").alias("content_type"),
        F.lit(None).cast("string").alias("launch_url"), F.when(F.col("doc_id") % 9 != 0, F.col("text")).alias("extracted_text"),
    )
    modules = named.groupBy("student_id", "course_id", "module_title", "module_position").agg(F.lit("https://m").alias("content_url"), F.repeat(F.lit("word "), F.count(F.lit(1)).cast("int")).alias("main_text"))
    got = P.classify_content(topics, modules)
    return got.select("course_id", "kind", "url", F.col("at.p").alias("position"), "title", "content_type", F.md5("extracted_text").alias("text_md5"))


O = "o as (select o_custkey as c, o_orderkey as k, o_totalprice as price from orders)"  # noqa: E741
COURSE = "'c' || j || '-spring-2026'"
QUERIES = {
    "snapshot_rows": (
        snapshot_rows,
        f"""with {O}, j as (select unnest([0, 1]) as j) select 'grade_rows' as part, c as student_id, {COURSE} as course_id, cast(row_number() over (partition by c, j order by k) - 1 as int) as position, 'Order ' || k as title
          from o, j where k % 2 = j union all select 'events', c, {COURSE}, row_number() over (partition by c, j order by k) - 1, 'Event ' || k from o, j where k % 5 = j
          union all select 'announcements', c, {COURSE}, row_number() over (partition by c, j order by k) - 1, 'News ' || k from o, j where k % 7 = j""",
    ),
    "snapshot_topics": (
        snapshot_topics,
        f"""select c_custkey as student_id, {COURSE} as course_id, kind, 0::int as position, title, 'https://t/' || c_custkey || '/' || u as url, case kind when 'external' then 'https://cengage/' || c_custkey end as launch_url,
          case kind when 'syllabus' then 'text ' || c_custkey when 'outline' then c_mktsegment end as extracted_text from customer, (select unnest([0, 1]) as j),
          (values ('syllabus', 'Syllabus', 's'), ('external', 'MindTap', 'e'), ('outline', 'Week 1', 'u')) v(kind, title, u)""",
    ),
    "normalized_courses": (
        normalized_courses,
        f"""select c_custkey as student_id, {COURSE} as course_id, cast(c_custkey * 10 + j as varchar) as d2l_course_id, 'C' || j as code, c_name as name, 'Spring 2026' as semester,
          'https://l/d2l/home/' || c_custkey * 10 + j as d2l_url, c_custkey % 100 + 0.5::double as current_grade_pct, 'cengage_mindtap' as external_platform,
          'https://cengage/' || c_custkey as external_platform_url, 'grades,mindtap' as tools, md5('[Syllabus]' || chr(10) || 'text ' || c_custkey) as syllabus_md5 from customer, (select unnest([0, 1]) as j)""",
    ),
    "publisher_rows": (
        publisher_rows,
        f"""with {O} select c as student_id, cast(row_number() over (partition by c order by k) - 1 as int) as position, 'p-' || k as id, 'Order ' || k as title, price as points_possible,
          cast(k % 60 as int) as estimated_minutes, '2026-03-25 01:02:03' as due_at, 'https://p/' || c as launch_url from o""",
    ),
    "manifest_artifacts": (
        manifest_artifacts,
        f"""with {O} select c as student_id, cast(row_number() over (partition by c order by k) - 1 as int) as position, 'a' || k as id, case when k % 2 = 0 then 'tool_grades' else 'course_home' end as page_kind,
          '/a/' || k || '.txt' as text_path, 'C' || c as course, cast(count(*) over (partition by c) as int) as n from o""",
    ),
    "extraction_rows": (
        extraction_rows,
        f"""with {O} select c as student_id, 'c' as course_id, cast(row_number() over (partition by c order by k) - 1 as int) as position, 'Order ' || k % 100 || ' : Unit ' || k % 3 as title, 'order-' || k % 100 as fact_key,
          case when k % 3 = 0 then '' else 'd2l' end as platforms, price as points_possible, case when k % 2 = 0 then 'a' || k end as first_artifact_id from o""",
    ),
    "artifact_bodies": (
        artifact_bodies,
        """select d.doc_id as id, case when d.doc_id % 7 <> 0 then sha256(d.text || chr(10)) end as body_sha256, case when d.doc_id % 3 = 0 then sha256(o.text || chr(10)) end as html_sha256
          from documents d join documents o on o.doc_id = d.doc_id - d.doc_id % 10""",
    ),
    "content_topics": (
        content_topics,
        """with t as (select source as course_id, doc_id as p, doc_id % 5 as m, 'https://t/' || doc_id % 300 as url, case when doc_id % 4 = 0 then 'Assignment list' else 'Reading ' || lang end as title,
            case when doc_id % 6 = 1 then 'External Learning Tool' else 'Link' end as content_type, case when doc_id % 9 <> 0 then text end as x from documents),
          named as (select *, case m when 0 then 'syllabus' else 'external' end as kind from t where m = 0 or (m = 1 and content_type = 'External Learning Tool')),
          listed as (select course_id, kind, url, arg_min({'p': p, 'title': title, 'c': content_type, 'x': x}, (m, p)) as f from named group by all),
          tries as (select * from t where m in (2, 4) and title = 'Assignment list' and coalesce(x, '') <> '' and not exists (select 1 from listed l where l.course_id = t.course_id and l.url = t.url)),
          outline as (select course_id, url, arg_min({'p': p, 'title': title, 'c': content_type, 'x': x}, (m, p)) as f from tries group by all),
          views as (select course_id, m, count(*) as n from t where m in (2, 4) group by all)
          select course_id, kind, url, f.p as position, f.title as title, f.c as content_type, md5(f.x) as text_md5 from listed
          union all select course_id, 'outline', url, f.p, f.title, f.c, md5(f.x) from outline
          union all select course_id, 'outline', 'https://m#outline-module=' || case m when 2 then 'Week%203' else 'Weekly%20tasks' end, -1, case m when 2 then 'Week 3' else 'Weekly tasks' end || ' (module view)',
            'ModuleOverview', md5(trim(repeat('word ', cast(n as int)))) from views where length(trim(repeat('word ', cast(n as int)))) >= 120""",
    ),
}
