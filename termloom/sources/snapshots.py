"""Readers for captured documents and the frames they explode into."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from termloom import schemas
from termloom.functions import text as X
from termloom.operators.normalize import primary_tool
from termloom.session import stage

COURSE = ["student_id", "course_id"]
# positions of outline topics start behind those of any other list: an array holds fewer elements than this
OUTLINE_OFFSET = 1 << 32
SUPPORTED = ("cengage_mindtap", "pearson_mylab")


def _documents(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One row per JSON document; a document is one student's snapshot."""
    return spark.read.schema(schema.replace("\n", " ")).option("multiLine", True).json(path)


def read_lms_snapshot(spark: SparkSession, path: str) -> DataFrame:
    return _documents(spark, path, schemas.LMS_SNAPSHOT)


def explode_lms_snapshot(snapshots: DataFrame) -> dict[str, DataFrame]:
    """Courses, tool links, events, announcements, announcement items, grade rows and topics, with their positions."""
    each = snapshots.select("student_id", "fetched_at", F.posexplode("courses").alias("course_position", "c")).select(
        "student_id", X.course_key(F.col("c.code"), F.col("c.semester")).alias("course_id"), "fetched_at", "course_position", "c"
    )
    base = [*COURSE, "fetched_at"]
    listed = lambda field: each.select(*base, F.posexplode("c." + field).alias("position", "x"))
    flat = lambda field: listed(field).select(*base, "position", "x.*")
    announcements = listed("announcements").select(*base, "position", "x.title", "x.url", "x.posted_at_text", "x.items")
    items = announcements.select(
        *base, F.col("position").alias("announcement"), F.col("title").alias("announcement_title"), F.col("url").alias("announcement_url"),
        "posted_at_text", F.posexplode("items").alias("position", "i"),
    )
    kinds = (("syllabus_topics", "syllabus", 0), ("external_tools", "external", 0), ("content_outline_topics", "outline", OUTLINE_OFFSET))
    topics = None
    for field, kind, offset in kinds:
        one = flat(field).withColumns({"kind": F.lit(kind), "position": F.col("position").cast("long") + offset})
        topics = one if topics is None else topics.unionByName(one)
    courses = each.select(
        *base, "course_position", F.col("c.course_id").alias("d2l_course_id"), "c.code", "c.name", "c.offering_code", "c.semester",
        "c.end_date_text", "c.home_url", "c.final_calculated_grade",
    )
    return {
        "courses": courses, "tool_links": flat("tool_links"), "events": flat("upcoming_events"), "announcements": announcements.drop("items"),
        "announcement_items": items.select(*items.columns[:-1], "i.*"), "grade_rows": flat("grade_rows"), "topics": topics,
    }


def read_publisher_snapshot(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Courses and assignments of publisher snapshots."""
    docs = _documents(spark, path, schemas.PUBLISHER_SNAPSHOT)
    one = lambda field: docs.select("student_id", "fetched_at", F.posexplode(field).alias("position", "x")).select("student_id", "fetched_at", "position", "x.*")
    return one("courses"), one("assignments")


def read_crawl_manifest(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Courses and artifacts of crawl manifests."""
    docs = _documents(spark, path, schemas.CRAWL_MANIFEST)
    courses = docs.select("student_id", F.posexplode("courses").alias("position", "x")).select("student_id", "position", "x.*")
    artifacts = docs.select("student_id", F.posexplode("artifacts").alias("position", "x")).select("student_id", "position", "x.*")
    return courses, artifacts


def read_artifact_bodies(spark: SparkSession, artifacts: DataFrame, bodies_path: str) -> DataFrame:
    """Artifacts with the text (`body`) and HTML (`html`) stored below `bodies_path`; a missing file gives null.

    Each artifact names up to two paths; these are rows with their role, joined with one scan of the folder and pivoted back, so no file is
    opened from the driver and the texts are shuffled once by path and once by artifact.
    """
    files = spark.read.option("recursiveFileLookup", True).text(bodies_path, wholetext=True).select(
        F.url_decode(F.replace(F.regexp_replace("_metadata.file_path", r"^file:/+", "/"), F.lit("+"), F.lit("%2B"))).alias("path"), F.col("value")
    )
    local = lambda c: F.regexp_replace(c, r"^file:/+", "/")
    numbered = stage(artifacts.withColumn("_row", F.monotonically_increasing_id()))
    role = lambda name, path: F.struct(F.lit(name).alias("role"), local(path).alias("path"))
    named = numbered.select("_row", F.explode(F.array(role("body", "text_path"), role("html", "html_path"))).alias("r")).select("_row", "r.*")
    found = named.where("path is not null").join(files, "path")
    held = found.groupBy("_row").agg(*[F.max(F.when(F.col("role") == name, F.col("value"))).alias(name) for name in ("body", "html")])
    return numbered.join(held, "_row", "left").drop("_row")


def read_extraction(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """Courses, facts, categories and provenance events of extraction documents."""
    docs = _documents(spark, path, schemas.EXTRACTION)
    each = docs.select("student_id", "extracted_at", F.posexplode("courses").alias("course_position", "c")).select(
        "student_id", F.col("c.course_id").alias("course_id"), "extracted_at", "c"
    )
    base = [*COURSE, "extracted_at"]
    flat = lambda field: each.select(*base, F.posexplode("c." + field).alias("position", "x")).select(*base, "position", "x.*")
    facts = flat("assignments").withColumns(
        {
            "source_platforms": F.coalesce("source_platforms", F.array().cast("array<string>")), "fact_key": X.fact_key(F.col("title")),
            "first_artifact_id": F.get("evidence_artifact_ids", F.lit(0)),
        }
    )
    courses = each.select(
        *base, "c.course_code", "c.course_name", F.coalesce("c.grade_categories", F.array().cast("array<struct<name:string,weight:double,notes:string>>")).alias("grade_categories"),
        F.coalesce("c.grading_scale", F.create_map().cast("map<string,array<double>>")).alias("grading_scale"), "c.late_policy", "c.current_grade_pct", "c.artifact_count",
    )
    return {"courses": courses, "facts": facts, "categories": flat("grade_categories"), "provenance": flat("provenance_events")}


def publisher_worklist(courses: DataFrame, topics: DataFrame) -> DataFrame:
    """Courses whose primary tool runs on a supported platform, with launch URL, in snapshot order."""
    tool = primary_tool(topics.where("kind = 'external'")).where(F.col("external_platform").isin(*SUPPORTED))
    named = courses.select(*COURSE, "course_position", F.col("name").alias("course_title"))
    return named.join(tool, COURSE).select(
        *COURSE, "course_position", F.col("external_platform").alias("source_platform"), F.col("external_platform_url").alias("launch_url"),
        F.col("url").alias("wrapper_url"), "course_title",
    )


def course_manifest(courses: DataFrame, artifacts: DataFrame, *, course_id: str | None = None, limit: int | None = None) -> DataFrame:
    """Courses of a crawl with their artifact counts: optionally one course, or each student's first `limit`."""
    picked = courses if course_id is None else courses.where(F.col("course_id") == course_id)
    if limit is not None:
        order = Window.partitionBy("student_id").orderBy("position")
        picked = picked.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= limit).drop("_n")
    counts = artifacts.groupBy(*COURSE).agg(F.count(F.lit(1)).alias("artifact_count"))
    return picked.drop("artifact_count").join(counts, COURSE, "left").withColumn("artifact_count", F.coalesce("artifact_count", F.lit(0)))
