"""Coursework-shaped views over the given tables: the same expressions for Spark and for the SQL side."""

from __future__ import annotations

from datetime import UTC, date, datetime
from functools import cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from termloom.schemas import CATEGORIES, LATE_POLICY, SCALE

NOW = datetime(1998, 6, 15, 12, 0, tzinfo=UTC)
TODAY = date(1998, 6, 15)
TZ = "America/Chicago"
NOW_SQL = "timestamp '1998-06-15 12:00:00'"
TODAY_SQL = "date '1998-06-15'"

# expressions valid in both engines
ASG_COLUMNS = {
    "student_id": "o.o_custkey",
    "course_id": "'crs-' || cast(l.l_suppkey % 3 as varchar(3))",
    "id": "cast(l.l_orderkey as varchar(20)) || '-' || cast(l.l_linenumber as varchar(3)) || '-' || cast(l.l_partkey as varchar(20))"
    " || '-' || cast(l.l_suppkey as varchar(20)) || '-' || cast(cast(l.l_quantity as int) as varchar(5))",
    "title": "case l.l_linenumber % 6 when 0 then 'Homework' when 1 then 'Quiz' when 2 then 'Lab' when 3 then 'Project'"
    " when 4 then 'Reading' else 'Discussion' end || ' ' || cast(l.l_partkey % 2 + 1 as varchar(3))"
    " || case l.l_returnflag when 'N' then ' - Due' when 'A' then 'Not startedCOUNTS TOWARDS GRADE' else '' end",
    "type": "case l.l_linenumber % 6 when 0 then 'homework' when 1 then 'exam' when 2 then 'lab' when 3 then 'project'"
    " when 4 then 'reading' else 'discussion' end",
    "source_platform": "case l.l_returnflag when 'N' then 'd2l' when 'A' then 'cengage_mindtap' else 'pearson_mylab' end",
    "description": "case when l.l_partkey % 11 = 0 then 'Part ' || cast(l.l_partkey as varchar(20)) end",
    "external_url": "case l.l_partkey % 7 when 0 then '#/#' when 1 then 'https://tool.example.com/' || cast(l.l_partkey as varchar(20)) end",
    "due_date": "case when l.l_partkey % 5 = 0 then null else l.l_shipdate end",
    "grade_category": "case when l.l_returnflag = 'N' then case l.l_partkey % 8 when 0 then 'Homework' when 1 then 'Tests' when 2 then '' end end",
    "grade_weight_pct": "case when l.l_returnflag = 'N' and l.l_partkey % 3 = 0 then cast(5 as double) end",
    "points_possible": "l.l_quantity",
    "points_earned": "case when l.l_linestatus = 'O' then null when l.l_orderkey % 17 = 0 then cast(0 as double)"
    " else round(l.l_quantity * (1 - l.l_discount), 2) end",
    "grade_pct": "case when l.l_linestatus = 'O' and l.l_orderkey % 13 = 0 then cast(75.5 as double) end",
    "status": "case when l.l_linestatus = 'F' then 'graded' when l.l_orderkey % 4 = 0 then 'in_progress'"
    " when l.l_orderkey % 4 = 1 then 'overdue' else 'upcoming' end",
    "estimated_minutes": "case when l.l_returnflag = 'N' then null else cast(15 + (l.l_partkey % 6) * 15 as int) end",
    "last_scraped": "o.o_orderdate",
    "raw_due_at": "case when l.l_partkey % 5 <> 0 and l.l_suppkey % 4 = 0 then cast(cast(l.l_shipdate as date) as varchar(10)) || 'T23:30:00-05:00' end",
    "raw_due_on": "case when l.l_partkey % 9 = 1 then cast(cast(l.l_shipdate as date) as varchar(10)) end",
    "raw_days_late": "case when l.l_suppkey % 6 = 0 then cast(l.l_linenumber % 4 as varchar(3)) end",
    "raw_announcement_title": "case when l.l_partkey % 10 = 3 then 'News ' || cast(l.l_linenumber as varchar(3)) end",
    "lp_accepts": "case when l.l_partkey % 23 = 0 then l.l_suppkey % 2 = 0 end",
    "lp_max_days": "case when l.l_partkey % 23 = 0 then cast(l.l_suppkey % 7 as int) end",
    "lp_penalty": "case when l.l_partkey % 23 = 0 then cast(0.05 as double) end",
}
ASG_SQL = (
    "select " + ", ".join(f"{e} as {n}" for n, e in ASG_COLUMNS.items())
    + " from lineitem l join orders o on l.l_orderkey = o.o_orderkey"
)
CRS_COLUMNS = {
    "student_id": "c.c_custkey",
    "course_id": "'crs-' || cast(k.n as varchar(3))",
    "course_no": "k.n",
    "code": "'C' || cast(k.n as varchar(3))",
    "name": "'Course ' || cast(k.n as varchar(3))",
    "semester": "case when c.c_nationkey % 2 = 0 then 'Spring 1998' else 'Fall 1997' end",
    "d2l_course_id": "cast(c.c_custkey * 3 + k.n as varchar(20))",
    "d2l_url": "case when k.n < 2 then 'https://lms.example.edu/d2l/home/' || cast(c.c_custkey * 3 + k.n as varchar(20)) else 'https://lms.example.edu/x' end",
    "external_platform": "case when c.c_nationkey % 3 = 0 then 'cengage_mindtap' when c.c_nationkey % 3 = 1 then 'pearson_mylab' end",
    "external_platform_url": "case when c.c_nationkey % 4 = 0 then 'https://tool.example.com/launch' end",
    "current_grade_pct": "cast(60 + (c.c_custkey * 7 + k.n * 11) % 40 as double)",
    "syllabus_raw_text": "case when c.c_custkey % 3 = 0 then 'Syllabus ' || c.c_name end",
    "parsed": "c.c_custkey % 5 = 0",
}
CRS_SQL = (
    "select " + ", ".join(f"{e} as {n}" for n, e in CRS_COLUMNS.items())
    + " from customer c cross join (select 0 as n union all select 1 union all select 2) k"
)
CAT_SQL = (
    "select cast(v.course_no as int) as course_no, cast(v.pos as int) as pos, v.name, cast(v.weight as double) as weight"
    " from (values (0,0,'Homework',0.2),(0,1,'Exams',0.5),(0,2,'Labs',0.3),"
    "(1,0,'Programming Exercises',40.0),(1,1,'Tests',60.0),(1,2,'Reading',0.0)) as v(course_no,pos,name,weight)"
)
CATEGORY_LISTS = {
    0: (("Homework", 0.2), ("Exams", 0.5), ("Labs", 0.3)),
    1: (("Programming Exercises", 40.0), ("Tests", 60.0), ("Reading", 0.0)),
}
SCALES = {0: {"A": (0.9, 1.0), "B": (0.8, 0.899), "C": (0.7, 0.799)}, 1: {"A": (90.0, 100.0), "B": (80.0, 89.9)}}
POLICIES = {0: (True, 0.1, 3, None), 1: (False, None, None, "No late exams")}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    stamps = {f.name: F.col(f.name).cast("timestamp") for f in df.schema if f.dataType.typeName() == "timestamp_ntz"}
    return df.withColumns(stamps) if stamps else df


def _spark_sql(expression: str) -> str:
    return expression.replace("varchar(20)", "string").replace("varchar(10)", "string").replace(
        "varchar(3)", "string"
    ).replace("varchar(5)", "string")


def _raw_map():
    names = ("due_at", "due_on", "days_late", "announcement_title")
    pairs = [x for n in names for x in (F.lit(n), F.col("raw_" + n))]
    return F.map_filter(F.create_map(*pairs), lambda _, v: v.isNotNull())


def assignments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Source rows: student = customer, platform = return flag."""
    lines, orders = table(spark, sf_dir, "lineitem").alias("l"), table(spark, sf_dir, "orders").alias("o")
    picked = lines.join(orders, F.expr("l.l_orderkey = o.o_orderkey")).selectExpr(
        *[f"{_spark_sql(e)} as {n}" for n, e in ASG_COLUMNS.items()]
    )
    policy = F.when(
        F.col("lp_accepts").isNotNull(),
        F.struct(
            F.lit(None).cast("string").alias("raw_text"), F.col("lp_accepts").alias("accepts_late"),
            F.col("lp_penalty").alias("default_penalty_per_day"), F.col("lp_max_days").alias("max_late_days"),
            F.lit(None).cast("string").alias("exceptions"),
        ),
    ).cast(LATE_POLICY)
    return picked.withColumns({"late_policy": policy, "raw": _raw_map()}).drop(
        "lp_accepts", "lp_max_days", "lp_penalty", "raw_due_at", "raw_due_on", "raw_days_late", "raw_announcement_title"
    )


def _per_course(values: dict, build, type_: str):
    out = F.lit(None).cast(type_)
    for n, v in values.items():
        out = F.when(F.col("course_no") == n, build(v).cast(type_)).otherwise(out)
    return out


def courses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three courses per student with categories, grading scale and late policy."""
    base = (
        table(spark, sf_dir, "customer").alias("c")
        .withColumn("n", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))))
        .selectExpr(*[f"{_spark_sql(e).replace('k.n', 'n')} as {n}" for n, e in CRS_COLUMNS.items()])
    )
    cats = lambda v: F.array(*[F.struct(F.lit(a).alias("name"), F.lit(w).alias("weight"), F.lit(None).cast("string").alias("description")) for a, w in v])  # noqa: E731,E501
    scale = lambda v: F.create_map(*[x for k, b in v.items() for x in (F.lit(k), F.array(*[F.lit(y) for y in b]))])
    policy = lambda v: F.struct(
        F.lit(None).cast("string").alias("raw_text"), F.lit(v[0]).alias("accepts_late"),
        F.lit(v[1]).cast("double").alias("default_penalty_per_day"), F.lit(v[2]).cast("int").alias("max_late_days"),
        F.lit(v[3]).cast("string").alias("exceptions"),
    )
    late = _per_course(POLICIES, policy, LATE_POLICY)
    return base.withColumns(
        {
            "grade_categories": _per_course(CATEGORY_LISTS, cats, CATEGORIES),
            "grading_scale": _per_course(SCALES, scale, SCALE),
            "syllabus_parsed": F.when(late.isNotNull(), F.struct(late.alias("late_policy"))),
        }
    )


# the course attributes above, for the SQL side
COURSE_FACTS = (
    "select *, case course_no when 0 then true when 1 then false end as cp_accepts,"
    " case course_no when 0 then 0.1::double end as cp_penalty, case course_no when 0 then 3 end as cp_max_days,"
    " case course_no when 1 then 'no late exams' else '' end as cp_exceptions, course_no < 2 as cp_known from crs"
)


@cache
def with_views(*ctes: tuple[str, str]) -> str:
    """'with asg as (...), ...' prefix; later CTEs may use the earlier ones."""
    every = (("asg", ASG_SQL), ("crs", CRS_SQL), ("cat", CAT_SQL), ("course", COURSE_FACTS), *ctes)
    return "with " + ",\n".join(f"{n} as ({q})" for n, q in every) + "\n"
