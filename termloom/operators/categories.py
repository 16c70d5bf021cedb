"""What rows ask of the grade categories of their course, worked out once per course and carried in its struct."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from termloom.functions import text as X

# Words that stand for an assignment type inside category names, for course grades and for the weight of a row.
TYPE_ALIASES = {
    "homework": ("homework", "hw", "exercise", "assignment", "problem"),
    "exam": ("exam", "quiz", "test"),
    "lab": ("lab",),
    "discussion": ("discussion",),
    "project": ("project",),
    "reading": ("reading",),
}
TYPE_HINTS = {
    "homework": ("homework", "programming exercise", "mindtap", "mylab", "assignment", "problem"),
    "lab": ("lab", "laboratory"),
    "exam": ("exam", "quiz", "test"),
    "project": ("project", "paper"),
    "discussion": ("discussion",),
    "reading": ("reading", "chapter"),
}


def normal_text(c: Column) -> Column:
    return F.coalesce(X.squash(F.lower(c)), F.lit(""))


def category_weight(weight: Column) -> Column:
    """Weight of a category in percent: values up to 1.5 are fractions; zero and below are missing."""
    return F.when(weight > 0, F.when(weight <= 1.5, F.round(weight * 100, 4)).otherwise(weight))


def place(type_: Column, types: dict[str, tuple]) -> Column:
    """Place of a type in `types`; null for other types."""
    return F.coalesce(*[F.when(type_ == t, i) for i, t in enumerate(types)])


def named_by(category: Column, alias: Column) -> Column:
    """Does a category name hold the alias, or the alias the name."""
    return category["lower"].contains(alias) | alias.contains(category["lower"])


def _any(tests: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, tests)


def _named(value: Column, build) -> Column:
    """`build` of a value that is computed once: an array of one value gives it a name."""
    return F.get(F.transform(F.array(value), build), F.lit(0))


def for_grades(grade_categories: Column) -> dict[str, Column]:
    """Fields of the course struct that grades are made of.

    `graded`: the categories in their order with the forms of their name and weight. `category_of`: per type of TYPE_ALIASES the key of the first
    category that names it. `blended`: whether any category carries a weight.
    """
    graded = F.transform(
        grade_categories,
        lambda c: F.struct(
            c["name"].alias("name"), F.lower(c["name"]).alias("lower"), X.name_key(c["name"]).alias("key"), c["weight"].alias("weight"),
            category_weight(c["weight"]).alias("weight_pct"),
        ),
    )
    first = lambda cats, words: F.get(F.filter(cats, lambda c: c["key"].isNotNull() & _any([named_by(c, F.lit(w)) for w in words])), F.lit(0))["key"]
    return {
        "graded": graded,
        "category_of": _named(graded, lambda cats: F.array(*[first(cats, words) for words in TYPE_ALIASES.values()])),
        "blended": F.coalesce(F.exists(grade_categories, lambda c: F.coalesce(c["weight"] > 0, F.lit(False))), F.lit(False)),
    }


def for_weights(grade_categories: Column) -> dict[str, Column]:
    """The field of the course struct that weights and labels are made of.

    `weighing`: the categories in their order, their names in normal form, with one bit per type of TYPE_HINTS whose words they hold.
    """
    texts = F.transform(
        grade_categories,
        lambda c: F.struct(c["name"].alias("name"), normal_text(c["name"]).alias("normal"), X.as_fraction(c["weight"]).alias("share")),
    )
    bits = lambda c: reduce(
        lambda a, b: a + b, [F.when(_any([c["normal"].contains(w) for w in words]), 1 << i).otherwise(0) for i, words in enumerate(TYPE_HINTS.values())]
    )
    weighing = F.transform(texts, lambda c: F.struct(c["name"].alias("name"), c["normal"].alias("normal"), c["share"].alias("share"), bits(c).alias("stands_for")))
    return {"weighing": weighing}
