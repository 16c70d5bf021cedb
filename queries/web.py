"""Links, URLs and page text over the given pages and documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from queries import views as V
from termloom.functions import text as X
from termloom.functions import urls as U
from termloom.operators import links as L
from termloom.operators import normalize as N
from termloom.operators import pages as P


def _pages(spark, sf):
    """Pages as course pages: the course is the host."""
    return V.table(spark, sf, "pages").select(
        F.lit(1).cast("bigint").alias("student_id"), U.host(F.col("url")).alias("course_id"), "page_id", "url", "html"
    )


def normalize_urls(spark, sf):
    return L.normalize_urls(V.table(spark, sf, "pages").select("page_id", F.concat(F.upper("url"), F.lit("#Top")).alias("url"))).select("page_id", "normalized_url")


def html_text(spark, sf):
    return P.html_to_text(V.table(spark, sf, "pages"), decode=False).select("page_id", F.md5(F.encode("text", "UTF-8")).alias("text_md5"), F.length("text").alias("n_chars"))


def html_text_decoded(spark, sf):
    return P.html_to_text(V.table(spark, sf, "pages")).select("page_id", F.md5(F.encode("text", "UTF-8")).alias("text_md5"), F.length("text").alias("n_chars"))


def page_links(spark, sf):
    return L.page_links(_pages(spark, sf)).select("page_id", "position", "url", "text")


def links_in_scope(spark, sf):
    links = L.page_links(_pages(spark, sf))
    return links.where(L.in_course_scope(F.col("url"), F.col("page_url"))).select("page_id", "position", "url")


def _lms_links(spark, sf):
    """Every page as an LMS link of one of three courses."""
    pages = V.table(spark, sf, "pages")
    unit = (F.col("page_id") % 3).cast("string")
    lms = F.concat(
        F.when(F.col("page_id") % 5 == 0, "http://other.example.edu").otherwise("https://LMS.example.edu"),
        F.when(F.col("page_id") % 7 == 0, "/d2l/logout/").when(F.col("page_id") % 7 == 1, "/x/").otherwise("/d2l/le/"),
        F.when(F.col("page_id") % 2 == 0, F.concat(unit, F.lit("/Home"))).otherwise(F.concat(F.lit("list?a=1&ou="), unit)),
    )
    return pages.select(
        F.lit(1).cast("bigint").alias("student_id"), F.concat(F.lit("c"), (F.col("page_id") % 4).cast("string")).alias("course_id"), "page_id", lms.alias("url")
    )


def lms_scope(spark, sf):
    links = _lms_links(spark, sf)
    scope = links.select("student_id", "course_id").distinct().withColumns(
        {"lms_course_id": F.substring("course_id", 2, 1), "lms_host": F.lit("lms.example.edu")}
    )
    return L.links_in_scope(links, scope).select("page_id", "url")


WORDS = ("Grades", "Network news", "eText chapter", "Course work", "Chat", "Quiz list", "Content", "Hello", "Late policy", "Library exam")


def _named(spark, sf):
    links = L.page_links(_pages(spark, sf))
    n = (F.length("url") + F.col("page_id")) % len(WORDS)
    return links.withColumn("text", F.element_at(F.array(*[F.lit(w) for w in WORDS]), (n + 1).cast("int")))


def relevant_links(spark, sf):
    return L.relevant_links(_named(spark, sf)).select("page_id", "position", "text")


def relevant_publisher_links(spark, sf):
    return L.relevant_links(_named(spark, sf), platform="pearson_mylab").select("page_id", "position", "text")


TOPIC_MODULES = ("Week 1", "Panopto recordings", "Grades and policies", "Chat room", "Echo360", "Start")


def _topics(spark, sf):
    module = F.element_at(F.array(*[F.lit(m) for m in TOPIC_MODULES]), (F.col("position") % len(TOPIC_MODULES) + 1).cast("int"))
    return _named(spark, sf).select("page_id", "position", F.col("text").alias("title"), "url", module.alias("module_title"))


def relevant_topics(spark, sf):
    return L.relevant_topics(_topics(spark, sf)).select("page_id", "position", "title", "module_title")


def relevant_wrappers(spark, sf):
    return L.relevant_topics(_topics(spark, sf), wrappers=True).select("page_id", "position", "title", "module_title")


def _nav_links(spark, sf):
    return _named(spark, sf).select(
        "student_id", F.col("page_id").cast("string").alias("course_id"), "page_id", "position", "page_url", "url", "text", (F.col("position") % 2 == 0).alias("has_href"),
    )


def nav_plan_picked(spark, sf):
    """Every third page has picks (every second link, last first); the others go by words."""
    links = _nav_links(spark, sf).where(F.col("url").rlike("^https?:"))
    inside = links.where("lower(regexp_extract(url, '://([^/?#]*)', 1)) = lower(regexp_extract(page_url, '://([^/?#]*)', 1))")
    counts = inside.where("page_id % 3 = 0").groupBy("student_id", "course_id").agg(F.count(F.lit(1)).cast("int").alias("n"))
    picks = counts.where("n > 0").select("student_id", "course_id", F.explode(F.expr("filter(sequence(0, n - 1), i -> i % 2 = 0)")).alias("index"), "n")
    picks = picks.select("student_id", "course_id", "index", (F.col("n") - F.col("index")).alias("rank"))
    return L.publisher_nav_plan(links, picks, platform="cengage_mindtap").select("course_id", "step", "position", "text")


def nav_plan_labels(spark, sf):
    """The other platform: links without a target count, first of each label, the first five pages."""
    return L.publisher_nav_plan(_nav_links(spark, sf), platform="pearson_mylab", budget=5).select("course_id", "step", "position", "text")


def tool_scores(spark, sf):
    named = _named(spark, sf).select("page_id", "position", F.col("text").alias("name"), "url")
    return L.tool_scores(named).select("page_id", "position", "slot", "score")


def artifact_ids(spark, sf):
    pages = _pages(spark, sf).select("course_id", F.lit("D2L Nav page").alias("page_kind"), "page_id", "url")
    return L.artifact_ids(pages).select("page_id", "id")


def nav_plan(spark, sf):
    links = _named(spark, sf).select("student_id", F.col("page_id").cast("string").alias("course_id"), "position", "page_url", "url", "text", F.lit(True).alias("has_href"))
    return L.publisher_nav_plan(links, platform="cengage_mindtap").select("course_id", "step", "position", "text")


def frontier(spark, sf):
    """Pages of one site linked by site name: breadth-first from the first page of each site."""
    pages = V.table(spark, sf, "pages").select("page_id", (F.col("page_id") % 10).alias("site"))
    key = ("student_id", "course_id")
    base = pages.select(F.lit(1).cast("bigint").alias(key[0]), F.concat(F.lit("s"), F.col("site").cast("string")).alias(key[1]), "page_id")
    url = lambda c: F.concat(F.lit("http://x.example.com/"), c.cast("string"))
    seeds = base.groupBy(*key).agg(F.min("page_id").alias("p")).select(*key, url(F.col("p")).alias("url"), F.lit(0).alias("position"))
    steps = F.array(F.lit(20), F.lit(10), F.lit(50))
    links = base.select(*key, "page_id", F.posexplode(steps).alias("position", "step")).join(
        base.select(*key, F.col("page_id").alias("to")), list(key)
    ).where("`to` = page_id + step").select(*key, url(F.col("page_id")).alias("from_url"), url(F.col("to")).alias("url"), "position")
    return L.expand_frontier(seeds, links).select("course_id", "url", "visit", "level")


def modules(spark, sf):
    titles = V.table(spark, sf, "pages").select("page_id", F.element_at(F.array(*[F.lit(t) for t in MODULES]), (F.col("page_id") % len(MODULES) + 1).cast("int")).alias("t"))
    return titles.select(
        "page_id", P.module_kind(F.col("t")).alias("kind"), P.is_schedule_module(F.col("t")).alias("schedule"), P.lists_assignments(F.col("t"), F.lit("PDF")).alias("listing"),
    )


MODULES = ("Course Syllabus", "Week 3 reading", "MindTap tools", "Graded Tasks", "Extra  credit", "Lab 4", "Notes", "Getting Started", "HW due Mar", "Weekly task")
MODULES_SQL = "[" + ", ".join(f"'{m}'" for m in MODULES) + "]"
WORDS_SQL = "[" + ", ".join(f"'{w}'" for w in WORDS) + "]"

ANCHOR = r"(?is)<a\b[^>]*?\bhref\s*=\s*[\"'']([^\"'']*)[\"''][^>]*>(.*?)</a>"
LINKS_SQL = rf"""select page_id, page_url, row_number() over (partition by page_id order by i) as position, url, text from (
  select page_id, page_url, url, min(i) as i, arg_min(inn, i) as text from (select page_id, page_url, i,
    case when regexp_matches(h, '^[A-Za-z][A-Za-z0-9+.-]*:') then h when starts_with(h, '/') then regexp_extract(page_url, '^([^:]*://[^/?#]*)', 1) || h
      else page_url || h end as url, trim(regexp_replace(regexp_replace(inn, '<[^>]+>', ' ', 'g'), '\s+', ' ', 'g')) as inn
    from (select page_id, url as page_url, unnest(range(1, len(hs) + 1)) as i, trim(unnest(hs)) as h, unnest(ts) as inn from (select page_id, url,
      regexp_extract_all(html, '{ANCHOR}', 1) as hs, regexp_extract_all(html, '{ANCHOR}', 2) as ts from pages))
    where h <> '' and not regexp_matches(lower(h), '^(#|javascript:|mailto:)'))
  group by page_id, page_url, url)"""


def _alternation(words):
    return L.any_of(words).replace("'", "''").replace("\\ ", " ").replace("\\-", "-").replace("\\/", "/")


NAMED_SQL = f"select page_id, page_url, position, url, ({WORDS_SQL})[(length(url) + page_id) % {len(WORDS)} + 1] as text from ({LINKS_SQL})"
PATH_SQL = "regexp_extract(url, '^[^:]*://[^/?#]*([^?#]*)', 1) || '?' || regexp_extract(url, '[?]([^#]*)', 1)"
LMS_SQL = f"""not regexp_matches(lower(text || ' ' || url), '{_alternation(L.SKIP + L.LMS_SKIP)}') and (regexp_matches(lower(text), '{_alternation(L.LMS_FORCED)}')
  or regexp_matches(lower(url), '{_alternation(L.TOOL_FRAGMENTS)}') or regexp_matches(lower(text || '  ' || {PATH_SQL}), '{_alternation(L.INCLUDE + L.LMS_INCLUDE)}')
  or regexp_matches(lower(text || '  ' || {PATH_SQL}), '\\b(course\\s*work|classwork|schoolwork)\\b'))"""
PUBLISHER_SQL = f"""not regexp_matches(lower(text || ' ' || url), '{_alternation(L.SKIP)}') and (regexp_matches(lower(text || ' ' || url), '{_alternation(L.INCLUDE)}')
  or regexp_matches(lower(text || ' ' || url), '\\b(course\\s*work|classwork|schoolwork)\\b'))"""
TOPICS_SQL = f"select page_id, position, text as title, url, ([{', '.join(repr(m) for m in TOPIC_MODULES)}])[position % {len(TOPIC_MODULES)} + 1] as module_title from ({NAMED_SQL})"
TOPIC_HAY = "lower(title || ' ' || url || ' ' || module_title)"
TOPIC_SIGNAL = f"lower(title || ' ' || module_title || ' ' || {PATH_SQL})"
WRAPPER_SQL = f"""not regexp_matches({TOPIC_HAY}, '{_alternation(L.SKIP + L.LMS_SKIP)}') and (regexp_matches(lower(title), '{_alternation(L.LMS_FORCED)}') or regexp_matches(lower(module_title), '{_alternation(L.LMS_FORCED)}')
  or regexp_matches(lower(url), '{_alternation(L.WRAPPER_FRAGMENTS)}') or regexp_matches({TOPIC_SIGNAL}, '{_alternation(L.INCLUDE + L.LMS_INCLUDE)}')
  or regexp_matches({TOPIC_SIGNAL}, '\\b(course\\s*work|classwork|schoolwork)\\b'))"""
INSIDE_SQL = """regexp_matches(url, '^https?:') and lower(regexp_extract(url, '://([^/?#]*)', 1)) = lower(regexp_extract(page_url, '://([^/?#]*)', 1))"""
SLOTS_SQL = " union all ".join(
    f"select page_id, position, '{slot}' as slot, cast(" + " + ".join(f"case when contains(hay, '{w}') then 1 else 0 end" for w in words) + " as int) as score from h"
    for slot, _, words in L.SURFACES
)

QUERIES = {
    "normalize_urls": (
        normalize_urls,
        """select page_id, lower(regexp_extract(u, '^([^:]*)', 1)) || '://' || lower(regexp_extract(u, '://([^/?#]*)', 1)) || regexp_extract(u, '://[^/?#]*([^#]*)', 1)
          as normalized_url from (select page_id, upper(url) as u from pages)""",
    ),
    "html_to_text": (
        html_text,
        r"""select page_id, md5(text) as text_md5, length(text) as n_chars from (select page_id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html,
          '(?is)<script\b[^>]*>.*?</script>', ' ', 'g'), '(?is)<style\b[^>]*>.*?</style>', ' ', 'g'), '<[^>]+>', ' ', 'g'), '\s+', ' ', 'g')) as text
          from pages)""",
    ),
    # the character references that occur in the given pages; the ampersand comes last
    "html_to_text_decoded": (
        html_text_decoded,
        r"""select page_id, md5(text) as text_md5, length(text) as n_chars from (select page_id, trim(regexp_replace(regexp_replace(
          replace(replace(replace(replace(regexp_replace(regexp_replace(html, '(?is)<script\b[^>]*>.*?</script>', ' ', 'g'), '(?is)<style\b[^>]*>.*?</style>', ' ', 'g'),
          '&quot;', '"'), '&middot;', '·'), '&copy;', '©'), '&amp;', '&'), '<[^>]+>', ' ', 'g'), '\s+', ' ', 'g')) as text from pages)""",
    ),
    "page_links": (page_links, f"select page_id, position, url, text from ({LINKS_SQL})"),
    "links_in_course_scope": (
        links_in_scope,
        f"""select page_id, position, url from ({LINKS_SQL}) where regexp_matches(url, '^https?:')
          and lower(regexp_extract(url, '://([^/?#]*)', 1)) = lower(regexp_extract(page_url, '://([^/?#]*)', 1))""",
    ),
    "links_in_scope": (
        lms_scope,
        """select page_id, url from (select page_id, substr('c' || page_id % 4, 2) as want, cast(page_id % 3 as varchar) as unit,
          case when page_id % 5 = 0 then 'http://other.example.edu' else 'https://LMS.example.edu' end
          || case page_id % 7 when 0 then '/d2l/logout/' when 1 then '/x/' else '/d2l/le/' end
          || case when page_id % 2 = 0 then page_id % 3 || '/Home' else 'list?a=1&ou=' || page_id % 3 end as url from pages)
          where url like 'https://LMS%' and url like '%/d2l/le/%' and want = unit""",
    ),
    "relevant_links": (relevant_links, f"select page_id, position, text from ({NAMED_SQL}) where {LMS_SQL}"),
    "relevant_publisher_links": (relevant_publisher_links, f"select page_id, position, text from ({NAMED_SQL}) where {PUBLISHER_SQL}"),
    "tool_scores": (
        tool_scores, f"with h as (select page_id, position, lower(text || ' ' || url) as hay from ({NAMED_SQL})) select * from ({SLOTS_SQL}) where score > 0",
    ),
    "artifact_ids": (
        artifact_ids,
        "select page_id, lower(regexp_extract(url, '://([^/?#]*)', 1)) || '-d2l-nav-page-' || substr(sha1(url), 1, 10) as id from pages",
    ),
    "publisher_nav_plan": (
        nav_plan,
        f"""select cast(page_id as varchar) as course_id, cast(step as int) as step, position, text from (select *, row_number() over (partition by page_id order by position) as step
          from ({NAMED_SQL}) where regexp_matches(url, '^https?:') and lower(regexp_extract(url, '://([^/?#]*)', 1)) = lower(regexp_extract(page_url, '://([^/?#]*)', 1))
          and {PUBLISHER_SQL} and url <> page_url)""",
    ),
    "relevant_topics": (relevant_topics, f"select page_id, position, title, module_title from ({TOPICS_SQL}) where not regexp_matches({TOPIC_HAY}, '{_alternation(L.SKIP + L.LMS_SKIP + L.TOPIC_SKIP)}')"),
    "relevant_wrappers": (relevant_wrappers, f"select page_id, position, title, module_title from ({TOPICS_SQL}) where {WRAPPER_SQL}"),
    "publisher_nav_plan_picked": (
        nav_plan_picked,
        f"""with i as (select *, row_number() over (partition by page_id order by position) as n, count(*) over (partition by page_id) as total from ({NAMED_SQL}) where {INSIDE_SQL}),
          c as (select *, total - (n - 1) as rank from i where page_id % 3 = 0 and n % 2 = 1 union all select *, n from i where page_id % 3 <> 0 and {PUBLISHER_SQL})
          select cast(page_id as varchar) as course_id, row_number() over (partition by page_id order by rank) as step, position, text from c where url <> page_url""",
    ),
    "publisher_nav_plan_labels": (
        nav_plan_labels,
        f"""with i as (select *, row_number() over (partition by page_id order by position) as n from ({NAMED_SQL}) where position % 2 = 1),
          f as (select page_id, lower(trim(text)) as label, arg_min({{'n': n, 'p': position, 't': text}}, n) as f from i where {PUBLISHER_SQL} group by all)
          select course_id, step, position, text from (select cast(page_id as varchar) as course_id, row_number() over (partition by page_id order by f.n) as step, f.p as position, f.t as text from f) where step <= 5""",
    ),
    "expand_frontier": (
        frontier,
        """with recursive top as (select max(page_id) as last from pages), walk as (select page_id % 10 as site, 1 as i, [min(page_id)] as q, [0] as lv, (select last from top) as last from pages group by 1 union all
          select site, i + 1, q || c, lv || list_transform(c, lambda x: lv[i] + 1), last from (select *, list_filter([q[i] + 20, q[i] + 10, q[i] + 50], lambda x: x <= last and not list_contains(q, x)) as c
            from walk where i <= len(q)))
          select 's' || site as course_id, 'http://x.example.com/' || q[i] as url, i as visit, lv[i] as level from walk where i <= len(q)""",
    ),
    "classify_modules": (
        modules,
        rf"""select page_id, case when regexp_matches(lower(t), '{P.SYLLABUS_WORDS}') then 'syllabus' when regexp_matches(lower(t), '{P.EXTERNAL_WORDS}') then 'external' end as kind,
          regexp_matches(t, '{P.WEEK_MODULE}') or regexp_matches(t, '{P.SCHEDULE_MODULE}') as schedule, regexp_matches(t, '{P.LISTING_TOPIC}') as listing
          from (select page_id, ({MODULES_SQL})[page_id % {len(MODULES)} + 1] as t from pages)""",
    ),
}
