"""Periodic runs of words by enumeration of maximal pairs.

A run is a stretch of consecutive words with smallest period q, at least max(least, 4 q) words long, that no neighbouring word extends
keeping period q. For its first word i and j = i + q, the words before i and j differ (or there is none), and the texts from i and j agree on exactly
length - q words: (i, j) is a maximal pair. Conversely a maximal pair whose distance q is at most a third of the words it agrees on is
the whole of a run of period q, so nothing is extended; of pairs with the same stretch the smallest distance is its period.

Maximal pairs come from the tree of LCP intervals, bottom-up: groups of suffixes that agree on l words are merged in descending order of l, and each
merge pairs positions of the two groups that have different left words and lie within l / 3 of each other. A group keeps its positions sorted, as
lists of stretches with the same left word, so a position skips those that share its own. The smaller group probes the larger.

Only words that can lie in a run enter the tree: all 5-word shingles of a run recur in it, so a run lies within a stretch of
positions whose shingles recur, and these stretches are cut down until nothing falls away. All of this is exact.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termloom.llm.common import arrow_map

LEAST = 6
# consecutive repeats of the period a run holds at least
TIMES = 4
SHINGLE = 5


def words_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of all texts, one after the other, and the number of the text of each word."""
    lists = pc.ascii_split_whitespace(texts.cast(pa.string()))
    flat, owner = lists.flatten(), pc.list_parent_indices(lists)
    solid = pc.not_equal(flat, "")
    return flat.filter(solid), owner.filter(solid).to_numpy().astype(np.int64)


def recurring(words: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(at, part): positions of words that can lie in a run, stretch by stretch, and the number of the stretch.

    A stretch is a maximal row of positions whose shingle of 5 words recurs in the same text, with the words of the last shingle; then the same
    is asked within each stretch. Equal hashes of different shingles only keep more words.
    """
    at, part = np.arange(len(words), dtype=np.int64), group
    while True:
        n = len(at)
        if n < LEAST:
            return at[:0], part[:0]
        mixed = part[: n - SHINGLE + 1].astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
        held = words[at].astype(np.uint64) + np.uint64(1)
        for k in range(SHINGLE):
            mixed = (mixed ^ held[k : n - SHINGLE + 1 + k]) * np.uint64(0x9E3779B97F4A7C15)
            mixed ^= mixed >> np.uint64(29)
        inside = np.flatnonzero(part[: n - SHINGLE + 1] == part[SHINGLE - 1 :])
        ordered = np.sort(mixed[inside])
        twice = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
        if not len(twice):
            return at[:0], part[:0]
        place = np.minimum(np.searchsorted(twice, mixed[inside]), len(twice) - 1)
        starts = inside[twice[place] == mixed[inside]]
        new = np.flatnonzero(np.r_[True, (np.diff(starts) != 1) | (part[starts[1:]] != part[starts[:-1]])])
        first = starts[new]
        last = starts[np.r_[new[1:] - 1, len(starts) - 1]]
        wide = last - first + SHINGLE >= LEAST
        first, size = first[wide], (last - first + SHINGLE)[wide]
        ends = np.cumsum(size)
        part = np.repeat(np.arange(len(size), dtype=np.int64), size)
        at = at[np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - size, size) + np.repeat(first, size)]
        if len(at) >= n:
            return at, part


def suffixes(words: np.ndarray, part: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Suffix array of all stretches, and the words that neighbours in it share; suffixes of two stretches share none."""
    n = len(words)
    _, rank = np.unique(part * (int(words.max()) + 1) + words, return_inverse=True)
    levels = [rank]
    longest = int(np.bincount(part).max())
    step = 1
    while step < longest and int(rank.max()) + 1 < n:
        then = np.zeros(n, dtype=np.int64)
        then[: n - step] = np.where(part[step:] == part[: n - step], rank[step:] + 1, 0)
        _, rank = np.unique(rank * (n + 1) + then, return_inverse=True)
        levels.append(rank)
        step *= 2
    order = np.empty(n, dtype=np.int64)
    order[rank] = np.arange(n)
    shared = np.zeros(n - 1, dtype=np.int64)
    for k in range(len(levels) - 1, -1, -1):
        a, b = order[:-1] + shared, order[1:] + shared
        inside = (a < n) & (b < n)
        same = np.zeros(n - 1, dtype=bool)
        same[inside] = levels[k][a[inside]] == levels[k][b[inside]]
        shared[same] += 1 << k
    return order, shared


class Group:
    """Positions that share a prefix: sorted, with the first position of each stretch of equal left words."""

    __slots__ = ("places", "heads")

    def __init__(self, place: int):
        self.places, self.heads = [place], [place]

    def add(self, place: int, left: list[int]) -> None:
        places, own = self.places, left[place]
        k = bisect_left(places, place)
        if k < len(places):
            after = places[k]
            was = k == 0 or left[places[k - 1]] != left[after]
            if was and left[after] == own:
                del self.heads[bisect_left(self.heads, after)]
            elif not was and left[after] != own:
                insort(self.heads, after)
        if k == 0 or left[places[k - 1]] != own:
            insort(self.heads, place)
        places.insert(k, place)

    def others(self, place: int, reach: int, left: list[int]) -> list[int]:
        """Positions within `reach` that have another left word."""
        places, own, out = self.places, left[place], []
        k, end = bisect_left(places, place - reach), bisect_right(places, place + reach)
        while k < end:
            if left[places[k]] != own:
                out.append(places[k])
                k += 1
                continue
            head = bisect_right(self.heads, places[k])
            if head == len(self.heads):
                break
            k = bisect_left(places, self.heads[head])
        return out


def maximal_pairs(order: np.ndarray, shared: np.ndarray, left: list[int]) -> list[tuple[int, int, int]]:
    """(i, j, l): maximal pairs i < j that agree on l >= 5 words and are at most l / 3 apart."""
    out, by_first, by_last = [], {}, {}
    # intervals of the tree from the deepest up: the boundary with the longest shared prefix joins the groups at its sides
    deep = np.flatnonzero(shared >= SHINGLE)
    deep = deep[np.argsort(-shared[deep], kind="stable")]
    for k, length in zip(deep.tolist(), shared[deep].tolist()):
        first, a = by_last.pop(k, None) or (k, Group(int(order[k])))
        last, b = by_first.pop(k + 1, None) or (k + 1, Group(int(order[k + 1])))
        by_first.pop(first, None)
        by_last.pop(last, None)
        small, large = (a, b) if len(a.places) <= len(b.places) else (b, a)
        reach = length // (TIMES - 1)
        for place in small.places:
            for other in large.others(place, reach, left):
                out.append((min(place, other), max(place, other), length))
        for place in small.places:
            large.add(place, left)
        by_first[first] = (last, large)
        by_last[last] = (first, large)
    return out


def runs_of(words: np.ndarray, group: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, length, period) of each run, by start and period; starts count over all texts, `group` numbers the texts."""
    at, part = recurring(words, group)
    if not len(at):
        return []
    picked = words[at]
    left = np.where(np.r_[True, part[1:] != part[:-1]], -1, np.r_[-1, picked[:-1]]).tolist()
    period = {}
    for i, j, length in maximal_pairs(*suffixes(picked, part), left):
        stretch = (int(at[i]), length + j - i)
        period[stretch] = min(period.get(stretch, j - i), j - i)
    return sorted((start, length, q) for (start, length), q in period.items())


def periodic_runs(docs: DataFrame, keys: list[str], column: str = "text") -> DataFrame:
    """`keys` of each row, with n_words, `starts`, `lengths`, `periods` of the runs of its text by start and period, and `collapsed`.

    `collapsed` is the text's words joined by one space, without those that a run contains after its first period. Null and empty texts have no words
    and no runs. Rows that repeat come back as often; an empty table gives no rows. Whole texts are processed, in batches of rows.
    """

    def work(batch: pa.RecordBatch) -> dict:
        n = batch.num_rows
        flat, owner = words_of(batch.column(len(keys)))
        ids = flat.dictionary_encode().indices.to_numpy().astype(np.int64)
        begin = np.searchsorted(owner, np.arange(n + 1))
        found = [([], [], []) for _ in range(n)]
        gone = np.zeros(len(ids) + 1, dtype=np.int64)
        for start, length, q in runs_of(ids, owner):
            text = int(owner[start])
            for values, value in zip(found[text], (start - int(begin[text]), length, q)):
                values.append(value)
            gone[start + q] += 1
            gone[start + length] -= 1
        stay = np.cumsum(gone)[:-1] == 0
        lists = pa.ListArray.from_arrays(np.searchsorted(owner[stay], np.arange(n + 1)).astype(np.int32), flat.filter(pa.array(stay)))
        out = {name: batch.column(k) for k, name in enumerate(keys)}
        starts, lengths, periods = zip(*found) if n else ((), (), ())
        return out | {"n_words": np.diff(begin), "starts": starts, "lengths": lengths, "periods": periods, "collapsed": pc.binary_join(lists, " ")}

    kinds = {k: docs.schema[k].dataType.simpleString().replace("bigint", "long") for k in keys}
    out = kinds | {"n_words": "long", "starts": "array<long>", "lengths": "array<long>", "periods": "array<long>", "collapsed": "string"}
    return arrow_map(docs.select(*keys, F.col(column).cast("string").alias(column)), out, work)


def rewritten(docs: DataFrame) -> DataFrame:
    """(doc_id, text): by the crc32 of the doc_id, one text in ten is made to repeat p of its words from word a on."""
    h = F.crc32(F.col("doc_id").cast("long").cast("string"))
    words = F.when(h % 10 == 0, F.filter(F.split("text", "[\\x20\\x09-\\x0D]+"), lambda w: w != ""))
    picked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.floor(h / 10).alias("g"), words.alias("words"))
    placed = picked.withColumn("n", F.size("words")).withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n")))
    placed = placed.withColumn("p", F.expr("1 + (n - a) div (3 + g % 8)"))
    again = "array_join(transform(sequence(0L, n - 1L), i -> words[int(if(i >= a, a + (i - a) % p, i))]), ' ')"
    return placed.select("doc_id", F.expr(f"if(n > 0, {again}, text)").alias("text"))


def op11(docs: DataFrame) -> DataFrame:
    """One row per document: the number of its runs, the one of most repeats, digests of all runs and of the collapsed text.

    Null doc_ids have no hash, so their texts stay as they are. Else as in `periodic_runs`; columns other than doc_id and text are ignored.
    """
    got = periodic_runs(rewritten(docs), ["doc_id"])
    runs = F.arrays_zip("starts", "lengths", "periods")
    listed = F.array_join(F.transform(runs, lambda r: F.concat(r.starts, F.lit(","), r.lengths, F.lit(","), r.periods, F.lit("\n"))), "")
    # fractions of longs below 2^31 compare exactly by cross products
    better = "case when x.lengths * y.periods > y.lengths * x.periods then x when x.lengths * y.periods < y.lengths * x.periods then y when (x.starts, x.periods) <= (y.starts, y.periods) then x else y end"
    best = F.expr(f"aggregate(runs, runs[0], (x, y) -> {better})")
    got = got.withColumn("runs", runs).withColumn("best", F.when(F.size("runs") > 0, best))
    return got.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("best.starts").alias("start"), F.col("best.lengths").alias("length"), F.col("best.periods").alias("period"),
        F.expr("(1000 * best.lengths) div best.periods").alias("exponent_milli"), F.sha2(listed, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"), "n_words",
    )
