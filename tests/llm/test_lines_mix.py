"""Line classes next to brute force, lines of documents without an id, the mix with its texts."""

import random

import numpy as np

from termloom.llm import line_dedup, mixing
from termloom.llm.common import ready

DOCS = "doc_id long, text string, source string, copies string, row long, doc long"


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def removed_lines(docs):
    """Line numbers that go, by brute force over all pairs of different lines."""
    every = [(i, k, line) for i, text in docs for k, line in enumerate(text.split("\n")) if line.strip(" \t\r")]
    lines = sorted({line for _, _, line in every})
    root = {line: line for line in lines}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for k, a in enumerate(lines):
        for b in lines[k + 1 :]:
            short = min(len(a), len(b))
            allowed = 2 if short >= 30 else 1 if short >= 12 else 0
            if abs(len(a) - len(b)) <= allowed and allowed and edits(a, b) <= allowed:
                root[find(a)] = find(b)
    first = {}
    for i, k, line in sorted(every):
        first.setdefault(find(line), (i, k))
    return {(i, k) for i, k, line in every if first[find(line)] != (i, k)}


def changed(rng, line, n):
    letters = list(line)
    for _ in range(n):
        k = rng.randrange(len(letters))
        kind = rng.randrange(3)
        if kind == 0:
            letters.insert(k, rng.choice("abcé"))
        elif kind == 1 and len(letters) > 1:
            del letters[k]
        else:
            letters[k] = rng.choice("abc天")
    return "".join(letters)


def test_line_classes_equal_brute_force(spark):
    ready(spark)
    rng = random.Random(8)
    base = ["".join(rng.choice("abc ") for _ in range(n)).strip() or "x" for n in [5, 11, 12, 13, 20, 28, 29, 30, 31, 32, 33, 45, 60] for _ in range(3)]
    texts = []
    for i in range(120):
        texts.append((i, "\n".join(changed(rng, rng.choice(base), rng.choice((0, 1, 1, 2, 3))) for _ in range(rng.randrange(1, 5)))))
    rows = [(i, t, "s", "c", 1, 2) for i, t in texts]
    got = {}
    for r in line_dedup.kept_lines(spark.createDataFrame(rows, DOCS).repartition(4)).collect():
        got[r["doc"]["doc_id"]] = (r["n_removed"], r["kept"])
    gone = removed_lines(texts)
    for i, text in texts:
        kept = [line for k, line in enumerate(text.split("\n")) if (i, k) not in gone]
        assert got[i] == (len(text.split("\n")) - len(kept), "\n".join(kept))


def test_lines_without_an_id_stay_once(spark):
    ready(spark)
    line = "a line that stands in two documents without an id"
    rows = [(None, line + "\nfirst", "s", "c", 1, 2), (None, line + "\nsecond", "s", "c", 1, 2), (3, "x\n" + line, "s", "c", 1, 2), (3, "y\n" + line, "s", "c", 1, 2)]
    got = [r["kept"] for r in line_dedup.kept_lines(spark.createDataFrame(rows, DOCS)).collect()]
    assert sum(line in t for t in got) == 1 and any(t in ("x\n" + line, "y\n" + line) for t in got)
    got = [r["kept"] for r in line_dedup.kept_lines(spark.createDataFrame(rows[:2], DOCS)).collect()]
    assert sum(line in t for t in got) == 1


def test_a_wide_rest_is_shared_by_all_sizes():
    rng = np.random.default_rng(1)
    size = rng.permutation(np.arange(1, 5001))
    count = np.full(5000, 40)
    total = int((size * count).sum())
    take = mixing.fit(size, count, total // 3)
    assert int((take * size).sum()) == total // 3 and take.min() >= 13 and (take > 14).sum() <= 8


def test_the_mix_returns_its_texts(spark):
    ready(spark)
    rows = [(k % 7 if k % 5 else None, "w " * (k % 9 + 1), ("a", "b", None)[k % 3], "old", k, k) for k in range(60)]
    docs = spark.createDataFrame(rows, DOCS)
    got = mixing.mixed(docs).collect()
    assert got[0].asDict().keys() == {"doc_id", "text", "source", "row", "doc", "copies"} and len({r["row"] for r in got}) == len(got)
    by_row = {r[4]: r for r in rows}
    assert all((r["doc_id"], r["text"], r["source"]) == by_row[r["row"]][:3] and 1 <= r["copies"] <= 3 for r in got)
    assert mixing.mixed(docs.limit(0)).count() == 0
