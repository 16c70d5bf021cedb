"""Joins of rows that are many times larger than the files they come from, by which Spark sizes them, must not be broadcast."""

from termloom.llm import line_dedup, simhash_golay
from termloom.llm.common import ready


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_keys_of_fingerprints_are_not_broadcast(spark):
    ready(spark)
    found = simhash_golay.links(spark.createDataFrame([(0,), (1,), (7,), (1 << 40,), (-1,)], "fp long"))
    assert "BroadcastHashJoin" not in plan_of(found) and "SortMergeJoin" in plan_of(found)
    assert {(r["a"], r["b"]) for r in found.collect()} == {(0, 1), (0, 7), (1, 7), (0, 1 << 40), (1, 1 << 40), (7, 1 << 40)}


def test_characters_of_lines_are_not_broadcast(spark):
    ready(spark)
    line = "a line of some forty characters or so, no. "
    texts = [line + "1", line + "2", "another line that is like no other line here", line + "12"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    none = spark.createDataFrame([], "h1 long, h2 long, first decimal(38,0)")
    found = line_dedup.near_links(docs, none)
    assert "BroadcastHashJoin" not in plan_of(found) and plan_of(found).count("SortMergeJoin") == 2
    assert len({(r["a"], r["b"]) for r in found.collect()}) == 3
