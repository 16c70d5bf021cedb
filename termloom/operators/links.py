"""Links of captured pages: scope, relevance, seeds, breadth-first frontier and picks."""

from __future__ import annotations

import re
import uuid
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from termloom.functions import text as X
from termloom.functions import urls as U
from termloom.functions.scan import ranked
from termloom.session import checkpoint_dir, stage

COURSE = ["student_id", "course_id"]
# links of a course that one task walks by itself
QUEUED = 1 << 18
# courses, tools and announcements of which one task makes seeds, on average
PER_TASK = 1 << 16

# Words that decide whether a navigation target is followed.
SKIP = (
    "etext", "e-text", "ebook", "etextbook", "textbook", "read the book", "revel", "video", "lecture", "webinar",
    "streaming", "media player", "podcast", "youtube", "sam.cengage", "help.pearson", "support.pearson", "plus.pearson",
    "help.cengage", "support.cengage", "purchase", "shop", "cart", "checkout", "subscribe", "buy now", "instructor",
    "accessibility statement", "privacy policy", "terms of use", "account settings", "sign out", "log out", "logout",
    "profile", "dynamic study", "study area", "study module", "mobile app", "download app", "library", "documentary",
    "audio book", "audiobook", "chapter reading", "learning path", "mindtap reader", "cengage unlimited",
)
INCLUDE = (
    "assignment", "assignments", "grade", "grades", "grading", "score", "scores", "result", "results", "progress",
    "performance", "calendar", "due", "deadline", "quiz", "quizzes", "test", "tests", "exam", "exams", "homework",
    "classwork", "activity", "activities", "submission", "submissions", "feedback", "report", "analytics", "overview",
    "dashboard", "announcement", "todo",
)
INCLUDE_TOKEN = r"(?i)\b(course\s*work|classwork|schoolwork)\b"
LMS_SKIP = (
    "classlist", "class list", "virtual classroom", "online rooms", "chat", "instant message", "collaboration",
    "course builder", "manage dates", "import / export", "import/export", "permissions", "impersonat", "media gallery",
    "lecture capture", "panopto", "kaltura", "echo360", "teams meeting", "live session", "bookmark", "subscription",
)
LMS_INCLUDE = (
    "syllabus", "policy", "policies", "late", "grading", "grade breakdown", "extra credit", "weight", "outline",
    "course info", "course information", "expectation", "dropbox", "rubric", "discuss", "discussion", "module",
    "announce", "news", "schedule",
)
LMS_FORCED = (
    "content", "grades", "assignment", "dropbox", "quiz", "survey", "calendar", "class progress", "rubric", "competenc",
    "outcome", "discuss", "syllabus",
)
TOPIC_SKIP = ("kaltura", "panopto", "echo360", "lecture capture", "panopto video")
WRAPPER_FRAGMENTS = (
    "/dropbox/", "/grades", "/quizzes", "/calendar/", "/assignments", "/news/", "/le/news/", "/lms/news",
)
TOOL_FRAGMENTS = (
    "/dropbox/", "/grades", "/quizzes", "/content/", "/calendar/", "/assignments", "/news/", "/le/news/", "/lms/news",
)
PUBLISHER_HOSTS = ("pearson.com", "pearsoned.com", "pearsoncmg.com")
FILE_ENDINGS = (".js", ".css", ".png", ".jpg", ".gif", ".svg", ".ico")
SURFACES = (
    # slot, page kind, words of tool links that take the slot over
    ("content", "tool_content", (" content", "/content/", "/le/content")),
    ("assignments", "tool_assignments", ("assignment", "dropbox", "/dropbox/")),
    ("quizzes", "tool_quizzes-exams", ("quiz", "quizzes", "exam", "test", "/quizzing/")),
    ("grades", "tool_grades", ("grade", "/lms/grades/", "/grades/")),
    ("announcements", "announcements_index", ("announce", "news", "/lms/news/")),
    ("calendar", "tool_calendar", ("calendar", "/le/calendar/")),
)
DEFAULT_PATHS = (
    # slot, page kind, title, path below the LMS root
    ("content", "tool_content", "Content", "/d2l/le/content/%s/Home"),
    ("assignments", "tool_assignments", "Assignments", "/d2l/lms/dropbox/dropbox.d2l?ou=%s"),
    ("quizzes", "tool_quizzes-exams", "Quizzes / Exams", "/d2l/lms/quizzing/user/quizzes_list.d2l?ou=%s"),
    ("grades", "tool_grades", "Grades", "/d2l/lms/grades/my_grades/main.d2l?ou=%s"),
    ("calendar", "tool_calendar", "Calendar", "/d2l/le/calendar/%s"),
    ("announcements", "announcements_index", "Announcements", "/d2l/lms/news/main.d2l?ou=%s"),
)


def any_of(words: tuple[str, ...]) -> str:
    """Alternation that finds any of the plain substrings."""
    return "|".join(re.escape(w) for w in words)


def normalize_urls(links: DataFrame, column: str = "url") -> DataFrame:
    return links.withColumn("normalized_url", U.normalized(F.col(column)))


# ---------------------------------------------------------------- scope


def is_web(url: Column) -> Column:
    return U.scheme(url).isin("http", "https")


def in_lms_scope(url: Column, lms_course_id: Column, lms_host: Column) -> Column:
    """On the LMS host and scoped to the course, by path segment or by the `ou` parameter."""
    u = F.trim(url)
    path = F.lower(U.path(u))
    units = U.query_values(u, "ou")
    named = F.array_contains(units, lms_course_id)
    scoped = F.array_contains(F.split(U.path(u), "/"), lms_course_id) | named
    return (
        is_web(u) & (U.host(u) == F.lower(lms_host)) & (U.host(u) != "") & ~path.rlike("/logout|/log-out")
        & path.contains("/d2l/") & ((F.size(units) == 0) | named) & scoped
    )


def in_course_scope(url: Column, course_url: Column) -> Column:
    """Same host, and neither a different snapshot nor a different deployment."""
    agree = lambda name: F.coalesce(U.query_value(url, name) == U.query_value(course_url, name), F.lit(True))
    same_host = (U.host(url) != "") & (U.host(url) == U.host(course_url))
    return is_web(url) & same_host & agree("snapshotId") & agree("deploymentId")


def in_publisher_scope(url: Column) -> Column:
    h = U.host(url)
    return (
        is_web(url) & h.rlike(any_of(PUBLISHER_HOSTS)) & ~h.isin("www.pearson.com", "pearson.com")
        & ~h.rlike(r"^(help|support|plus)\.")
    )


def is_tool_frame(url: Column) -> Column:
    u = F.lower(url)
    return u.contains("mylab.pearson.com/courses/") & ~u.rlike("(" + any_of(FILE_ENDINGS) + ")$")


def links_in_scope(links: DataFrame, scope: DataFrame) -> DataFrame:
    """Links of each course that its scope row (lms_course_id, lms_host) admits."""
    joined = links.join(scope.select(*COURSE, "lms_course_id", "lms_host"), COURSE)
    return joined.where(in_lms_scope(F.col("url"), F.col("lms_course_id"), F.col("lms_host"))).select(*links.columns)


# ---------------------------------------------------------------- relevance


def _hay(*parts: Column) -> Column:
    return F.concat_ws(" ", *[F.coalesce(p, F.lit("")) for p in parts])


def publisher_relevant(text: Column, url: Column) -> Column:
    hay = _hay(text, url)
    low = F.lower(hay)
    return ~low.rlike(any_of(SKIP)) & (low.rlike(any_of(INCLUDE)) | hay.rlike(INCLUDE_TOKEN))


def _forced(name: Column) -> Column:
    return F.lower(F.trim(F.coalesce(name, F.lit("")))).rlike(any_of(LMS_FORCED))


def _signalled(name: Column, url: Column, module: Column | None = None) -> Column:
    """Name, module and the path and query of the URL carry an include word; the host does not count."""
    hay = _hay(name, module if module is not None else F.lit(""), F.concat(U.path(url), F.lit("?"), U.query(url)))
    return F.lower(hay).rlike(any_of(INCLUDE + LMS_INCLUDE)) | hay.rlike(INCLUDE_TOKEN)


def lms_relevant(name: Column, url: Column) -> Column:
    low = F.lower(_hay(name, url))
    keep = _forced(name) | F.lower(url).rlike(any_of(TOOL_FRAGMENTS)) | _signalled(name, url)
    return ~low.rlike(any_of(SKIP + LMS_SKIP)) & keep


def topic_relevant(title: Column, url: Column, module: Column) -> Column:
    return ~F.lower(_hay(title, url, module)).rlike(any_of(SKIP + LMS_SKIP + TOPIC_SKIP))


def wrapper_relevant(title: Column, url: Column, module: Column) -> Column:
    low = F.lower(_hay(title, url, module))
    keep = _forced(title) | _forced(module) | F.lower(url).rlike(any_of(WRAPPER_FRAGMENTS)) | _signalled(title, url, module)
    return ~low.rlike(any_of(SKIP + LMS_SKIP)) & keep


def relevant_links(links: DataFrame, *, platform: str = "lms") -> DataFrame:
    """Links worth following: skip words first, then forced names, URL fragments and include words."""
    test = lms_relevant if platform == "lms" else publisher_relevant
    return links.where(test(F.col("text"), F.col("url")))


def relevant_topics(topics: DataFrame, *, wrappers: bool = False) -> DataFrame:
    """Topics of a content page (title, url, module_title) worth opening: all but recordings and the like; `wrappers`: pages that embed a
    tool, which must carry a signal themselves, in their module or in their URL."""
    test = wrapper_relevant if wrappers else topic_relevant
    return topics.where(test(F.col("title"), F.col("url"), F.col("module_title")))


# ---------------------------------------------------------------- links of pages


def page_links(pages: DataFrame, *, scope: Column | None = None, max_links: int | None = None) -> DataFrame:
    """Distinct followable links of each page in document order; the first `max_links` of them if that is given."""
    anchor = r"(?is)<a\b[^>]*?\bhref\s*=\s*[\"']([^\"']*)[\"'][^>]*>(.*?)</a>"
    hrefs, texts = (F.regexp_extract_all("html", F.lit(anchor), F.lit(g)) for g in (1, 2))
    found = F.arrays_zip(hrefs.alias("href"), texts.alias("inner"))
    kept = F.filter(
        F.transform(found, lambda a, i: F.struct(i.alias("pos"), F.trim(a["href"]).alias("href"), a["inner"].alias("inner"))),
        lambda a: (a["href"] != "") & ~F.lower(a["href"]).rlike("^(#|javascript:|mailto:)"),
    )
    ids = [c for c in pages.columns if c != "html"]
    each = pages.select(*ids, F.explode(kept).alias("a")).select(
        *[F.col(c).alias("page_url") if c == "url" else F.col(c) for c in ids], F.col("a.pos").alias("pos"),
        U.resolved(F.col("url"), F.col("a.href")).alias("url"), F.col("a.inner").alias("inner"),
    )
    if scope is not None:
        each = each.where(scope)
    keys = ["page_url" if c == "url" else c for c in ids]
    first = each.withColumn("normalized_url", U.normalized(F.col("url"))).groupBy(*keys, "normalized_url").agg(
        F.min(F.struct("pos", "url", "inner")).alias("s")
    )
    order = Window.partitionBy(*keys).orderBy("s.pos")  # the anchors of one page
    text = X.squash(F.regexp_replace("s.inner", r"<[^>]+>", " "))
    numbered = first.withColumn("position", F.row_number().over(order))
    return (numbered if max_links is None else numbered.where(F.col("position") <= max_links)).select(
        *keys, "position", F.col("s.url").alias("url"), "normalized_url", text.alias("text")
    )


def tool_scores(tools: DataFrame) -> DataFrame:
    """How many words of each slot a tool link carries; slots it does not touch are left out."""
    hay = F.lower(_hay(F.col("name"), F.col("url")))
    slots = F.array(*[
        F.struct(
            F.lit(slot).alias("slot"), F.lit(kind).alias("page_kind"),
            reduce(lambda a, w: a + F.when(hay.contains(w), 1).otherwise(0), words, F.lit(0)).alias("score"),
        )
        for slot, kind, words in SURFACES
    ])
    return tools.select("*", F.explode(F.filter(slots, lambda s: s["score"] > 0)).alias("s")).select(*tools.columns, "s.*")


def _dealt(*frames: DataFrame) -> list[DataFrame]:
    """`frames` dealt by course into tasks of about PER_TASK rows, however few files they come from; all into the same number, so they can be joined as they lie."""
    spark = frames[0].sparkSession
    tasks = max(spark.sparkContext.defaultParallelism, -(-sum(f.count() for f in frames) // PER_TASK))
    return [f.repartition(tasks, *COURSE) for f in frames]


def seed_targets(courses: DataFrame, tools: DataFrame, announcements: DataFrame) -> DataFrame:
    """First pages of each course: seven default surfaces, tool links in their place, then announcement pages.

    Equal URLs of a course are combined where they are made, by a sort of the rows of the task, hence the rows are dealt before.
    """
    courses, tools, announcements = _dealt(courses, tools, announcements)
    root = F.regexp_extract("home_url", r"^(.*?)(/d2l/home/[^/]*)?$", 1)
    entry = lambda i, slot, kind, url, title: F.struct(
        F.lit(i).alias("order"), F.lit(slot).alias("slot"), F.lit(kind).alias("page_kind"), url.alias("url"), title.alias("title")
    )
    defaults = F.array(
        entry(0, "home", "course_home", F.col("home_url"), F.col("name")),
        *[
            entry(i, slot, kind, F.concat(root, F.format_string(path.replace("%s", "%1$s"), F.col("d2l_course_id"))), F.lit(title))
            for i, (slot, kind, title, path) in enumerate(DEFAULT_PATHS, 1)
        ],
    )
    best = tool_scores(tools).groupBy(*COURSE, "slot").agg(
        F.min(F.struct((-F.col("score")).alias("rank"), "position", "url", "name")).alias("b")
    )
    # at most one entry per slot, so a course is joined as one row
    taken = best.groupBy(*COURSE).agg(F.map_from_entries(F.collect_list(F.struct("slot", F.struct("b.url", "b.name")))).alias("taken"))
    slots = courses.join(taken, COURSE, "left").select(*COURSE, "taken", F.explode(defaults).alias("d"))
    tool = F.col("taken")[F.col("d.slot")]
    surfaces = slots.select(
        *COURSE, F.struct(F.lit(0).alias("part"), F.col("d.order").cast("long").alias("at")).alias("at"), "d.page_kind",
        F.coalesce(tool["url"], "d.url").alias("url"), F.coalesce(tool["name"], "d.title").alias("title"),
    )
    news = announcements.select(
        *COURSE, F.struct(F.lit(1).alias("part"), F.col("position").cast("long").alias("at")).alias("at"),
        F.lit("announcement_detail").alias("page_kind"), "url", "title",
    )
    first = surfaces.unionByName(news).groupBy(*COURSE, "url").agg(F.min(F.struct("at", "page_kind", "title")).alias("f"))
    return first.select(*COURSE, "f.at", F.lit("d2l").alias("source_platform"), "f.page_kind", "url", "f.title")


def _walk(page_budget: int | None):
    """The visit order of one course, level by level, from its seeds and its links."""
    first = lambda v: (v is not None, v)  # noqa: E731  nulls come first
    listed = lambda df, *names: zip(*([None if pd.isna(v) else v for v in df[n].tolist()] for n in names), strict=True)

    def run(seeds: pd.DataFrame, links: pd.DataFrame) -> pd.DataFrame:
        after: dict[str, list] = {}
        for a, key, url, position in listed(links, "from_key", "key", "url", "position"):
            if a is not None:
                after.setdefault(a, []).append((key, url, position))
        found = [(key, url, (0, first(position))) for key, url, position in listed(seeds, "key", "url", "position")]
        seen, out, level = set(), [], 0
        while found:
            best: dict = {}
            for key, url, at in found:
                if key is None or key not in seen:
                    here = (at, first(url))
                    if key not in best or here < best[key]:
                        best[key] = here
            ordered = sorted(best, key=lambda k: (best[k][0], first(k)))
            if page_budget is not None:
                ordered = ordered[: max(page_budget - len(out), 0)]
            start = len(out)
            out += [(key, best[key][1][1], start + n, level) for n, key in enumerate(ordered, 1)]
            seen.update(k for k in ordered if k is not None)
            level += 1
            found = [(key, url, (visit, first(position))) for k, _, visit, _ in out[start:] if k is not None for key, url, position in after.get(k, ())]
        done = pd.DataFrame(out, columns=["key", "url", "visit", "level"])
        for c in reversed(COURSE):
            done.insert(0, c, [seeds[c].iloc[0]] * len(done) if len(seeds) else [])
        return done

    return run


def expand_frontier(seeds: DataFrame, links: DataFrame, *, page_budget: int | None = None, queued: int = QUEUED) -> DataFrame:
    """Breadth-first visit order per course over captured links, each URL once; at most `page_budget` pages if that is given.

    seeds: course keys, url, position; links: course keys, from_url, url, position. A course of at most `queued` links is walked in one
    step, all courses side by side, however deep it is. The levels of larger courses are numbered over range partitions, one level after
    the other, so no task gathers a level of one of these.
    """
    known = links.where(" and ".join(f"{c} is not null" for c in COURSE))
    edges = stage(known.select(*COURSE, U.normalized(F.col("from_url")).alias("from_key"), U.normalized(F.col("url")).alias("key"), "url", F.col("position").cast("long").alias("position")))
    start = seeds.select(*COURSE, U.normalized(F.col("url")).alias("key"), "url", F.col("position").cast("long").alias("position"))
    large = stage(edges.groupBy(*COURSE).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > queued).select(*COURSE))
    some = not large.isEmpty()
    rest = (lambda df: df.join(large, COURSE, "left_anti")) if some else (lambda df: df)
    spec = ", ".join(f"{c} {start.schema[c].dataType.simpleString()}" for c in COURSE) + ", key string, url string, visit bigint, level int"
    walked = rest(start).groupBy(*COURSE).cogroup(rest(edges).groupBy(*COURSE)).applyInPandas(_walk(page_budget), spec)
    if not some:
        return walked
    return walked.unionByName(_by_levels(start.join(large, COURSE, "left_semi"), edges.join(large, COURSE, "left_semi"), page_budget))


def _by_levels(seeds: DataFrame, edges: DataFrame, page_budget: int | None) -> DataFrame:
    """The same with one distributed step per level; with a budget a level keeps at most the pages it still admits."""
    edges = stage(edges)
    start = seeds.select(*COURSE, "key", "url", F.struct(F.lit(0).cast("long").alias("parent"), F.col("position").alias("at")).alias("at"))

    def admitted(candidates: DataFrame, used: Column) -> DataFrame:
        """First occurrence of every new URL, numbered after the pages already visited."""
        first = candidates.groupBy(*COURSE, "key").agg(F.min(F.struct("at", "url")).alias("f"), F.max(used).alias("_used"))
        numbered = ranked(first, COURSE, ["f.at", "key"], "_n")
        if page_budget is not None:
            numbered = numbered.where((F.col("_n") <= page_budget) & (F.col("_n") + F.col("_used") <= page_budget))
        return numbered.withColumn("visit", F.col("_n") + F.col("_used")).select(
            *COURSE, "key", F.col("f.url").alias("url"), F.col("visit").cast("long").alias("visit")
        )

    level = stage(admitted(start, F.lit(0)).withColumn("level", F.lit(0)))
    # all levels lie below one folder: a plan does not grow with their number
    folder = f"{checkpoint_dir(seeds.sparkSession)}/visited-{uuid.uuid4().hex}"
    visited = seeds.sparkSession.read.schema(level.schema).option("recursiveFileLookup", True)
    level.write.parquet(f"{folder}/0")
    depth = 0
    while not level.isEmpty():
        depth += 1
        so_far = visited.parquet(folder)
        used = so_far.groupBy(*COURSE).agg(F.count(F.lit(1)).alias("_so_far"))
        frontier = level.select(*COURSE, F.col("key").alias("from_key"), F.col("visit").alias("_parent"))
        # the edge table is scanned once per level
        found = (
            edges.join(frontier, [*COURSE, "from_key"])
            .join(so_far.select(*COURSE, "key"), [*COURSE, "key"], "left_anti")
            .join(used if page_budget is None else used.where(F.col("_so_far") < page_budget), COURSE)
            .withColumn("at", F.struct(F.col("_parent").alias("parent"), F.col("position").alias("at")))
        )
        path = f"{folder}/{depth}"
        admitted(found, F.col("_so_far")).withColumn("level", F.lit(depth)).write.parquet(path)
        level = seeds.sparkSession.read.schema(level.schema).parquet(path)
    return visited.parquet(folder)


# ---------------------------------------------------------------- picks


def valid_picks(pages: DataFrame, picks: DataFrame, *, platform: str = "lms") -> DataFrame:
    """Links to follow per page. A proposal is cleaned of repeats and out-of-range indices; pages without one use words.

    pages: page_id, page_url, links array<struct<url,text>>; picks: page_id, follow array<int>, notes, error.
    """
    test = lms_relevant if platform == "lms" else publisher_relevant
    fallback_name = "heuristic_d2l" if platform == "lms" else "heuristic_after_llm_error"
    joined = pages.join(picks, "page_id", "left")
    proposed = F.array_distinct(F.filter("follow", lambda i: (i >= 0) & (i < F.size("links"))))
    by_words = F.filter(
        F.transform("links", lambda link, i: F.when(test(link["text"], link["url"]), i)), lambda i: i.isNotNull()
    )
    used = F.col("follow").isNotNull() & F.col("error").isNull()
    return joined.withColumn("follow_indices", F.when(used, proposed).otherwise(by_words)).select(
        "page_id", "page_url", F.when(used, F.col("notes")).alias("notes"), "follow_indices",
        F.when(~used, fallback_name).alias("fallback"), "error",
        F.transform("follow_indices", lambda i: F.get("links", i)).alias("followed"),
    )


def artifact_ids(artifacts: DataFrame, identity: str = "url") -> DataFrame:
    return artifacts.withColumn("id", X.artifact_key(F.col("course_id"), F.col("page_kind"), F.col(identity)))


def publisher_nav_plan(
    links: DataFrame, picks: DataFrame | None = None, *, platform: str, budget: int | None = None, max_links: int | None = None
) -> DataFrame:
    """Publisher pages to open per course, in link order; the first `max_links` links and `budget` pages where those are given.

    links: course keys, position, page_url, url (absolute), text, has_href. Picks (course keys, position, rank) replace the
    word test where a course has any.
    """
    url, text = F.col("url"), F.col("text")
    mindtap = platform == "cengage_mindtap"
    inside = in_course_scope(url, F.col("page_url")) if mindtap else (~F.col("has_href") | in_publisher_scope(url))
    listed = ranked(links.where(inside), COURSE, ["position"], "_n")
    if max_links is not None:
        listed = listed.where(F.col("_n") <= max_links)
    if picks is None:
        chosen = listed.where(publisher_relevant(text, url)).withColumn("_rank", F.col("_n"))
    else:
        picked = picks.select(*COURSE, (F.col("index") + 1).alias("_n"), F.col("rank").alias("_rank"))
        with_picks = listed.join(picked, [*COURSE, "_n"])
        without = listed.join(picks.select(*COURSE).distinct(), COURSE, "left_anti").where(publisher_relevant(text, url))
        chosen = with_picks.unionByName(without.withColumn("_rank", F.col("_n")))
    key = U.normalized(url) if mindtap else F.lower(F.trim(text))
    keyed = chosen.withColumn("_key", key)
    if mindtap:
        keyed = keyed.where(F.col("_key") != U.normalized(F.col("page_url")))
    first = keyed.groupBy(*COURSE, "_key").agg(F.min(F.struct("_rank", "position", "url", "text")).alias("f"))
    numbered = ranked(first, COURSE, ["f._rank"], "step")
    return (numbered if budget is None else numbered.where(F.col("step") <= budget)).select(
        *COURSE, "step", "f.position", "f.url", "f.text"
    )


def activity_id(focus_tag: Column, heading_id: Column) -> Column:
    """Activity of a publisher row: before the dash of its focus tag, else after the heading prefix."""
    return F.coalesce(
        F.when(focus_tag.contains("-"), F.substring_index(focus_tag, "-", 1)),
        F.when(heading_id.startswith("activity-heading-"), F.substr(heading_id, F.lit(len("activity-heading-") + 1))),
    )


def detail_urls(rows: DataFrame, *, max_details: int | None = None) -> DataFrame:
    """Detail page of each publisher row, from the parameters of the course URL; rows without them are skipped."""
    url = F.col("course_url")
    snapshot, deployment, isbn = (U.query_value(url, n) for n in ("snapshotId", "deploymentId", "eISBN"))
    query = F.concat(
        F.lit("deploymentId="), deployment, F.lit("&eISBN="), isbn, F.lit("&id="), F.col("activity_id"), F.lit("&snapshotId="), snapshot, F.lit("&")
    )
    frag = F.regexp_extract(url, r"(#.*)$", 1)
    out = rows.withColumn("activity_id", activity_id(F.col("focus_tag"), F.col("heading_id"))).withColumn(
        "detail_url", F.concat(F.regexp_extract(url, r"^([^?#]*)", 1), F.lit("?"), query, frag)
    ).where("detail_url is not null")
    if max_details is None:
        return out
    order = Window.partitionBy(*COURSE).orderBy("position")
    return out.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= max_details).drop("_n")


def distinct_surfaces(frames: DataFrame) -> DataFrame:
    """Tool frames, first per (normalised URL, navigation label), with the page kind of their URL."""
    label = F.lower(F.trim(F.coalesce("nav_label", F.lit(""))))
    tools = frames.where(is_tool_frame(F.col("url"))).withColumns({"_key": U.normalized(F.col("url")), "_label": label})
    first = tools.groupBy(*COURSE, "_key", "_label").agg(F.min(F.struct("position", "url", "nav_label")).alias("f"))
    assignments = F.col("f.url").contains("mylab.pearson.com/courses/") & F.col("f.url").contains("/assignments")
    return first.select(
        *COURSE, "f.position", "f.url", "f.nav_label",
        F.when(assignments, "external_assignments_frame").otherwise("external_course_frame").alias("page_kind"),
    )
