"""Column expressions for titles, keys, identifiers, numbers and due texts.

Everything here is a plain Column expression that stays inside code generation.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Tokens that end a scraped title, words that carry no identity, roll-up rows.
STATUS_TAIL = r"(?i)(submitted|not started|in progress|grading in progress|counts towards grade).*$"
TRAILING_DUE = r"(?i)\b(?:due|in class)\b$"
# 'Title: Unit n … Code: …' keeps the title; 'Pre-requisite: a: b: c' keeps the first two parts
UNIT_CONTEXT = r"(?i)^([^:]*+):\s*unit\b[^:]*\b(?:code|apply)\b.*$"
PREREQUISITE = r"(?i)^(pre-requisite)\s*:\s*([^:]*?)\s*:[^:]*:.*$"
PROGRAMMING_EXERCISE = r"(?i)programming\s+exercise\s+(\d+(?:\.\d+)?)"
ROLLUP_TITLE = (
    r"(?i)\b(final calculated grade|current grade|course total|total grade|weighted total|final grade)\b"
)
ROLLUP_KEEP = r"attendance|participation|discussion"
MONTHS = ("JAN", "FEB", "MAR", "APR", "MAY", "JUN", "JUL", "AUG", "SEP", "OCT", "NOV", "DEC")


# every white space character, spelled out: several times faster than the Unicode-aware \s; visible ASCII is turned away by the first test
SPACE = r"[[\x00-\x20\x7f-\u3000]&&[\s\x1c-\x1f\x85\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]]"


def squash(c: Column) -> Column:
    """Collapse every run of white space to one blank and trim the ends."""
    return F.trim(F.regexp_replace(c, SPACE + "+", " "))


def any_word(c: Column, *words: str) -> Column:
    """Cheap test for plain substrings, used to skip a pattern that cannot match."""
    hit = c.contains(words[0])
    for w in words[1:]:
        hit = hit | c.contains(w)
    return hit


def blank_to_null(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def truthy(c: Column) -> Column:
    """Non-null and non-empty, as a boolean that is never null."""
    return F.coalesce(c != F.lit(""), F.lit(False))


def positive_or_missing(c: Column) -> Column:
    """The number, or null where it is zero."""
    return F.nullif(c, F.lit(0).cast("double"))


def dashed(c: Column) -> Column:
    """Lower-cased text with every run of other characters turned into one dash."""
    return F.btrim(F.regexp_replace(F.lower(c), r"[^a-z0-9]+", "-"), F.lit("-"))


def slug(c: Column) -> Column:
    """URL-safe form of a text; 'item' when nothing is left."""
    return F.regexp_replace(dashed(c), "^$", "item")


def name_key(c: Column) -> Column:
    """Key of a category name; null when nothing is left."""
    return blank_to_null(dashed(c))


def without_due(c: Column) -> Column:
    """Text without a trailing 'due' or 'in class'."""
    return F.regexp_replace(c, TRAILING_DUE, "")


def display_title(title: Column) -> Column:
    """Readable title: status tail, unit context and trailing 'due' removed.

    Every step mentions the one before it once, so the expression stays small however often it is reused.
    """
    spaced = squash(F.regexp_replace(title, r"([a-z0-9])([A-Z])", "$1 $2"))
    bare = F.btrim(F.regexp_replace(spaced, STATUS_TAIL, ""), F.lit(" :-|"))
    short = F.regexp_replace(F.rtrim(F.regexp_replace(bare, UNIT_CONTEXT, "$1")), PREREQUISITE, "$1: $2")
    return F.coalesce(blank_to_null(F.btrim(without_due(short), F.lit(" :-"))), title)


def exercise_key(title: Column) -> Column:
    """Key of a numbered programming exercise, else null."""
    named = F.lower(title).contains("programming")
    number = F.when(named, blank_to_null(F.regexp_extract(title, PROGRAMMING_EXERCISE, 1)))
    return F.concat(F.lit("programming-exercise-"), F.replace(number, F.lit("."), F.lit("-")))


def canonical_key(title: Column, shown: Column | None = None) -> Column:
    """Key under which source rows of one real assignment meet; `shown` is the display title if already known."""
    readable = display_title(title) if shown is None else shown
    return F.coalesce(exercise_key(title), slug(without_due(F.lower(readable))))


def snapshot_key(title: Column) -> Column:
    """Key used while the parts of one course snapshot are merged."""
    bare = F.regexp_replace(F.trim(F.lower(title)), r"(?: - due| due| in class)$", "")
    return F.coalesce(exercise_key(title), slug(bare))


def fact_key(title: Column) -> Column:
    """Key used while extracted facts are consolidated."""
    return slug(F.regexp_replace(squash(F.lower(title)), r"\s*:\s*unit.*$", ""))


def is_rollup(title: Column) -> Column:
    """Totals of the grade book, but not attendance-like items that mention a grade."""
    t = F.coalesce(title, F.lit(""))
    return any_word(F.lower(t), "grade", "total") & t.rlike(ROLLUP_TITLE) & ~F.lower(t).rlike(ROLLUP_KEEP)


def source_identifier(url: Column) -> Column:
    """Event id, else quick-link code, else news id of a link; null when none is present."""
    return F.coalesce(
        blank_to_null(F.regexp_extract(url, r"/event/(\d+)", 1)),
        blank_to_null(F.regexp_extract(url, r"[?&]rcode=([^&#]+)", 1)),
        blank_to_null(F.regexp_extract(url, r"/news/\d+/(\d+)/view", 1)),
    )


def course_key(code: Column, semester: Column) -> Column:
    term = F.coalesce(blank_to_null(semester), F.lit("unknown-term"))
    return F.concat(slug(code), F.lit("-"), slug(term))


def assignment_key(course_id: Column, title: Column, link: Column | None = None) -> Column:
    own = snapshot_key(title)
    stable = own if link is None else F.coalesce(source_identifier(link), own)
    return F.concat(course_id, F.lit("-"), stable)


def publisher_key(prefix: str, course_id: Column, identity: Column) -> Column:
    digest = F.substring(F.sha1(F.encode(identity, "UTF-8")), 1, 8)
    return F.concat(F.lit(prefix + "-"), course_id, F.lit("-"), F.substring(slug(identity), 1, 20), F.lit("-"), digest)


def artifact_key(course_id: Column, kind: Column, identity: Column) -> Column:
    digest = F.substring(F.sha1(F.encode(identity, "UTF-8")), 1, 10)
    return F.concat(course_id, F.lit("-"), slug(kind), F.lit("-"), digest)


def infer_type(title: Column) -> Column:
    """Assignment type by the words of its title, as the snapshot normaliser decides it."""
    t = F.lower(title)
    return (
        F.when(t.rlike("quiz|exam|test"), "exam")
        .when(t.contains("lab"), "lab")
        .when(t.contains("discussion"), "discussion")
        .when(t.contains("project"), "project")
        .when(t.contains("reading"), "reading")
        .otherwise("homework")
    )


def infer_fact_type(title: Column) -> Column:
    """Same vocabulary with the order used for extracted facts."""
    t = F.lower(title)
    return (
        F.when(t.contains("quiz"), "exam")
        .when(t.rlike("lab|programming exercise"), "lab")
        .when(t.contains("discussion"), "discussion")
        .when(t.contains("project"), "project")
        .when(t.contains("reading"), "reading")
        .when(t.rlike("exam|test"), "exam")
        .otherwise("homework")
    )


def infer_status(title: Column) -> Column:
    t = F.lower(title)
    return F.when(~t.contains("in class") & t.contains("due"), "upcoming").otherwise("available")


def platform_of(*parts: Column) -> Column:
    """Publisher platform named in any of the texts; null when none is."""
    hay = F.lower(F.concat_ws(" ", *[blank_to_null(p) for p in parts]))
    return F.when(hay.rlike("cengage|mindtap"), "cengage_mindtap").when(
        hay.rlike("pearson|mastering|mylab"), "pearson_mylab"
    )


# ---------------------------------------------------------------- numbers


def number(c: Column) -> Column:
    return F.trim(c).try_cast("double")


def fraction(text: Column) -> tuple[Column, Column]:
    """Both sides of 'a / b'; null on both sides unless both are numbers."""
    left = number(F.regexp_extract(text, r"(?s)^([^/]*)/(.*)$", 1))
    right = number(F.regexp_extract(text, r"(?s)^([^/]*)/(.*)$", 2))
    both = left.isNotNull() & right.isNotNull()
    return F.when(both, left), F.when(both, right)


def percent(text: Column) -> Column:
    return number(F.replace(text, F.lit("%"), F.lit("")))


POINTS = r"(?i)(--|\d+(?:\.\d+)?)\s*/\s*(\d+(?:\.\d+)?)\s*points?"


def points(text: Column) -> tuple[Column, Column]:
    """Earned and possible of 'a/b points'; '--' means nothing earned yet."""
    return (
        F.regexp_extract(text, POINTS, 1).try_cast("double"),
        F.regexp_extract(text, POINTS, 2).try_cast("double"),
    )


def rounded(c: Column, places: int) -> Column:
    """Half-up rounding of the decimal value, free of binary noise."""
    return F.round(c.cast("decimal(28,8)"), places).cast("double")


def ratio_pct(earned: Column, possible: Column) -> Column:
    return F.round(earned / positive_or_missing(possible) * 100, 2)


def score(text: Column) -> tuple[Column, Column, Column]:
    """Earned, possible and percentage of a score text ('a/b points' before 'x%')."""
    earned, possible = points(text)
    shown = F.regexp_extract(text, r"(\d+(?:\.\d+)?)%", 1).try_cast("double")
    pct = F.when(possible.isNotNull(), ratio_pct(earned, possible)).otherwise(shown)
    return earned, possible, pct


MINUTES = r"(?i)about\s+(\d+)(?:-(\d+))?\s+minutes"


def minutes(text: Column) -> Column:
    """Mean of 'about a-b minutes', halves rounded to the even minute."""
    low = F.regexp_extract(text, MINUTES, 1).try_cast("int")
    high = F.coalesce(F.regexp_extract(text, MINUTES, 2).try_cast("int"), low)
    return F.bround((low + high) / 2, 0).cast("int")


def as_fraction(c: Column) -> Column:
    """A weight as a fraction of one: percentages are divided, out-of-range values are null."""
    return F.when(c.between(0, 1), c).when((c > 1) & (c <= 100), c / 100.0)


def fraction_of_text(c: Column) -> Column:
    return as_fraction(F.coalesce(number(c), number(F.rtrim(F.trim(c), F.lit("%")))))


def meaning_zero(grade_pct: Column, earned: Column, possible: Column) -> Column:
    """An explicit zero stands for work that was not handed in."""
    return F.coalesce(grade_pct <= 0, F.lit(False)) | F.coalesce((earned <= 0) & (possible > 0), F.lit(False))


# ---------------------------------------------------------------- due texts


def in_zone(local: Column, tz: str) -> Column:
    return F.to_utc_timestamp(local, tz)


def due_month_day(text: Column, reference: Column, tz: str) -> Column:
    """'MON D [h:mm AM]' in the reference's local year; 23:59 when no time is given."""
    tokens = F.split(squash(text), " ")
    month = F.array_position(F.array(*[F.lit(m) for m in MONTHS]), F.upper(F.get(tokens, F.lit(0))))
    day = F.get(tokens, F.lit(1)).try_cast("int")
    clock = F.when(
        F.size(tokens) >= 4, F.concat_ws(" ", F.get(tokens, F.lit(2)), F.get(tokens, F.lit(3)))
    ).otherwise(F.lit("11:59 PM"))
    year = F.year(F.from_utc_timestamp(reference, tz))
    stamp = F.concat_ws(" ", year, month, day, clock)
    parsed = F.try_to_timestamp(stamp, F.lit("yyyy M d h:mm a"))
    return F.when((month > 0) & day.isNotNull() & (F.size(tokens) >= 2), in_zone(parsed, tz))


def due_long(text: Column, tz: str, *, comma_only: bool = False) -> Column:
    """'Mar 1, 2026 11:59 PM' and its long-month and comma-less forms."""
    compact = squash(text)
    formats = ["MMM d, yyyy h:mm a", "MMMM d, yyyy h:mm a"]
    if not comma_only:
        formats.append("MMM d yyyy h:mm a")
    return in_zone(F.coalesce(*[F.try_to_timestamp(compact, F.lit(f)) for f in formats]), tz)


def due_flexible(text: Column, reference: Column, tz: str) -> Column:
    return F.coalesce(due_month_day(text, reference, tz), due_long(text, tz))


def due_slashed(text: Column, tz: str) -> Column:
    """'03/25/2026 10:59 PM' with two- or four-digit year, blank before AM/PM optional."""
    t = F.regexp_replace(F.upper(squash(text)), r"\s*([AP]M)$", " $1")
    short = F.try_to_timestamp(t, F.lit("M/d/yy h:mm a"))
    # two digits from 69 on are years of the last century
    short = F.when(F.year(short) >= 2069, short - F.make_interval(years=F.lit(100))).otherwise(short)
    return in_zone(F.coalesce(F.try_to_timestamp(t, F.lit("M/d/yyyy h:mm a")), short), tz)


HAS_OFFSET = r"(Z|[+-]\d{2}:?\d{2})$"


def iso_instant(text: Column) -> Column:
    """ISO date-time text as an instant; texts without an offset are UTC."""
    t = F.trim(text)
    return F.when(t.rlike(r"^\d{4}-\d{2}-\d{2}"), t.try_cast("timestamp"))


def iso_local_date(text: Column) -> Column:
    """Calendar date written in an ISO text that carries an offset; null otherwise."""
    t = F.trim(text)
    return F.when(t.rlike(r"T.*" + HAS_OFFSET) & iso_instant(t).isNotNull(), F.substring(t, 1, 10).try_cast("date"))


def local_date(instant: Column, tz: str) -> Column:
    return F.to_date(F.from_utc_timestamp(instant, tz))
