"""Table synchronisation: two generations of a table, scopes, audit log."""

from __future__ import annotations

from pyspark.sql import functions as F

from queries import views as V
from queries.canonical import stamp
from termloom.operators import sync as S

OLD_SQL = """select o_custkey as student_id, 'c' || o_custkey % 4 as course_id, cast(o_orderkey as varchar) as id,
  case o_orderstatus when 'O' then 'd2l' when 'F' then 'cengage_mindtap' else 'pearson_mylab' end as source_platform, o_totalprice as price,
  case when o_orderkey % 3 = 0 then o_orderpriority end as note from orders where o_orderkey % 10 <> 0"""
NEW_SQL = """select o_custkey as student_id, 'c' || o_custkey % 4 as course_id, cast(o_orderkey as varchar) as id,
  case o_orderstatus when 'O' then 'd2l' when 'F' then 'cengage_mindtap' else 'pearson_mylab' end as source_platform, o_totalprice + 1 as price,
  case when o_orderkey % 5 = 0 then 'new' end as note from orders where o_orderkey % 7 <> 0 and o_custkey % 3 = 0"""
SCOPE_SQL = "select distinct student_id, course_id, source_platform from fresh where cast(id as bigint) % 11 <> 1"


def _generations(spark, sf):
    orders = V.table(spark, sf, "orders")
    platform = "case o_orderstatus when 'O' then 'd2l' when 'F' then 'cengage_mindtap' else 'pearson_mylab' end as source_platform"
    shared = ("o_custkey as student_id", "concat('c', o_custkey % 4) as course_id", "cast(o_orderkey as string) as id", platform)
    old = orders.where("o_orderkey % 10 <> 0").selectExpr(*shared, "o_totalprice as price", "case when o_orderkey % 3 = 0 then o_orderpriority end as note")
    new = orders.where("o_orderkey % 7 <> 0 and o_custkey % 3 = 0").selectExpr(
        *shared, "o_totalprice + 1 as price", "case when o_orderkey % 5 = 0 then 'new' end as note"
    )
    return old, new


def _scope(new):
    return new.where("cast(id as bigint) % 11 <> 1").select("student_id", "course_id", "source_platform").distinct()


def upsert(spark, sf):
    old, new = _generations(spark, sf)
    return S.upsert(old, new, S.KEY, preserve=("note",))


def last_write(spark, sf):
    lines = V.table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount"
    )
    return S.last_write(lines, ["l_orderkey", "l_linenumber"], ["l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"])


def prune_lms(spark, sf):
    old, new = _generations(spark, sf)
    return S.prune_lms(old, _scope(new), new)


def prune_publisher(spark, sf):
    old, new = _generations(spark, sf)
    return S.prune_publisher(old, _scope(new), new)


def prune_extraction(spark, sf):
    old, new = _generations(spark, sf)
    agenda = old.select("student_id", F.col("id").alias("assignment_id"), F.col("price").alias("minutes"))
    return S.prune_extraction(old, agenda, _scope(new), new)[1]


def sync_counts(spark, sf):
    old, new = _generations(spark, sf)
    merged = S.upsert(old, new, S.KEY)
    scope = _scope(new)
    return S.sync_summary(scope.select("student_id", "course_id").distinct(), new, S.missing_extraction(merged, scope, new))


def touch_courses(spark, sf):
    _, new = _generations(spark, sf)
    seen = new.select(
        "student_id", F.concat(F.lit("crs-"), (F.col("student_id") % 4).cast("string")).alias("course_id"), "source_platform",
        F.concat(F.lit("https://launch.example.com/"), "id").alias("launch_url"), F.col("id").cast("long").alias("position"),
        F.lit("1998-06-15 12:00:00").cast("timestamp").alias("fetched_at"),
    )
    courses = V.courses(spark, sf).withColumn("last_scraped_external", F.lit(None).cast("timestamp"))
    out = S.touch_courses(courses, seen)
    return out.select("student_id", "course_id", "external_platform", "external_platform_url", stamp("last_scraped_external").alias("last_scraped_external"))


def _log(spark, sf):
    events = V.table(spark, sf, "events")
    return events.select(
        F.col("event_id").alias("position"), F.col("ts").alias("created_at"), F.col("user_id").alias("student_id"),
        F.concat(F.lit("c"), F.col("user_id").cast("string")).alias("course_id"), F.lit(None).cast("string").alias("assignment_id"),
        F.when(F.col("event_id") % 9 == 0, F.lit(" ")).otherwise(F.col("event_type")).alias("stage"),
        F.lit(None).cast("string").alias("source_url"), F.lit(None).cast("string").alias("artifact_ref"),
        F.when(F.col("event_id") % 50 == 1, F.repeat("event_type", F.lit(2000))).otherwise(F.col("event_type")).alias("text_preview"),
        F.when(F.col("event_id") % 4 == 0, F.col("event_type")).otherwise(F.col("props")).alias("detail"),
    )


def append_log(spark, sf):
    return S.append_log(_log(spark, sf), batch=1).select("log_id", "course_id", "stage", "text_preview", "detail")


def query_log(spark, sf):
    log = S.append_log(_log(spark, sf), batch=1)
    return S.query_log(log, course_id="c7", limit=100).select("log_id", "stage")


GEN = f"with prior as ({OLD_SQL}), fresh as ({NEW_SQL}), scope as ({SCOPE_SQL})\n"
LOG_SQL = """select 1099511627776 + event_id as log_id, 'c' || user_id as course_id, event_type as stage,
  case when event_id % 50 = 1 then repeat(event_type, 2000) else event_type end as text_preview,
  case when event_id % 4 = 0 then '{"payload":{"d":"' || event_type || '"}}' else props end as detail from events where event_id % 9 <> 0"""

QUERIES = {
    "upsert": (
        upsert,
        GEN + """select student_id, id, coalesce(f.course_id, p.course_id) as course_id, coalesce(f.source_platform, p.source_platform) as source_platform,
          coalesce(f.price, p.price) as price, coalesce(f.note, p.note) as note from prior p full join fresh f using (student_id, id)""",
    ),
    "last_write": (
        last_write,
        """select l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount from (select *, row_number() over (
          partition by l_orderkey, l_linenumber order by l_partkey desc, l_suppkey desc, l_quantity desc, l_extendedprice desc) as n from lineitem) where n = 1""",
    ),
    "prune_lms": (
        prune_lms,
        GEN + """select * from prior p where not (source_platform = 'd2l' and exists (select 1 from scope s where s.student_id = p.student_id and s.course_id = p.course_id)
          and not exists (select 1 from fresh f where f.student_id = p.student_id and f.id = p.id))""",
    ),
    "prune_publisher": (
        prune_publisher,
        GEN + """select * from prior p where not (exists (select 1 from scope s where s.student_id = p.student_id and s.course_id = p.course_id
          and s.source_platform = p.source_platform) and not exists (select 1 from fresh f where f.student_id = p.student_id and f.id = p.id
          and f.course_id = p.course_id and f.source_platform = p.source_platform))""",
    ),
    "prune_extraction": (
        prune_extraction,
        GEN + """select student_id, id as assignment_id, price as minutes from prior p where not (exists (select 1 from scope s where s.student_id = p.student_id
          and s.course_id = p.course_id) and not exists (select 1 from fresh f where f.student_id = p.student_id and f.id = p.id))""",
    ),
    "sync_summary": (
        sync_counts,
        GEN + """select (select count(*) from (select distinct student_id, course_id from scope)) as courses_upserted, (select count(*) from fresh) as assignments_upserted,
          (select count(*) from prior p where exists (select 1 from scope s where s.student_id = p.student_id and s.course_id = p.course_id)
            and not exists (select 1 from fresh f where f.student_id = p.student_id and f.id = p.id)) as assignments_deleted""",
    ),
    "touch_courses": (
        touch_courses,
        V.with_views(("fresh", NEW_SQL), ("seen", """select student_id, 'crs-' || student_id % 4 as course_id, arg_min(source_platform, cast(id as bigint)) as sp,
          'https://launch.example.com/' || min(cast(id as bigint)) as url from fresh group by all"""))
        + """select student_id, course_id, coalesce(external_platform, sp) as external_platform, coalesce(external_platform_url, url) as external_platform_url,
          case when sp is not null then '1998-06-15 12:00:00' end as last_scraped_external from crs left join seen using (student_id, course_id)""",
    ),
    "append_log": (append_log, LOG_SQL),
    "query_log": (query_log, f"select log_id, stage from ({LOG_SQL}) where course_id = 'c7' order by log_id desc limit 100"),
}
