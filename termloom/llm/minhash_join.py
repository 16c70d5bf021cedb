"""Near-duplicate documents by an inverted join of MinHash coordinates, confirmed on full shingle sets.

A document is its set of distinct shingles. Documents with equal sets are one node, named by a hash of the set. A node's signature is the
least hash of its shingles under each of COORDINATES hash functions; two nodes of similarity s agree in a coordinate with probability s. Nodes are posted under each
(coordinate, value), and a pair counts from `matches()` collisions on, a threshold that pairs of the wanted similarity miss with a probability of MISS.

* Counting by prefix: a node's values are ordered from the rarest on. Values held by one node cannot collide and are left out; of s values left, two nodes
  with t collisions share one of the first s - t + 1. Only these are posted, and a node with s < t has no partner at all. Frequent
  values, as of a passage that many documents share, end up behind the prefix.
* Collisions of a pair are counted at once: signatures are kept as bit slices, one long per bit of all coordinates, so the equal coordinates
  of two nodes are those without a difference in any slice.
* A pair whose sets differ in too many shingles is dropped before it leaves the join: of each set the parity of its shingles in each of 512
  classes is kept, and two sets differ in at least as many shingles as they have classes of different parity.
* Skipping: in each list the node whose values are the most frequent is compared with all others. Most groups of copies hang together
  after that, and lists within one component are done. In the lists that are left, only pairs of different components are of interest: those
  off the list's main component with all others. Long lists are not paired as they stand: their nodes are posted again under
  their rarest shingles, by the same rule of prefixes (exact for shingles), and paired there.

All pairs found are confirmed by intersecting the full sets (64-bit hashes of shingles).
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termloom.llm.common import arrow_map, components, maybe_in, stage

WORDS = 5
PERCENT = 85
COORDINATES = 64
SLICES = 8
# longs of parity bits of a set
PARITIES = 8
MISS = 1e-9
# lists of more nodes are split by shingles before they are paired
LONG = 256
# shingles whose hashes are compared at once
BLOCK = 4096
ODD = np.uint64(0x9E3779B97F4A7C15)
FACTORS, SHIFTS = (np.array([xxhash.xxh64_intdigest(f"{name} {c}") | low for c in range(COORDINATES)], dtype=np.uint64) for name, low in (("factor", 1), ("shift", 0)))


def matches(percent: int = PERCENT, coordinates: int = COORDINATES, miss: float = MISS) -> int:
    """The most collisions that pairs of the given similarity fall short of with a probability of at most `miss`."""
    s, below = percent / 100, 0.0
    for t in range(coordinates):
        below += math.comb(coordinates, t) * s**t * (1 - s) ** (coordinates - t)
        if below > miss:
            return max(t, 1)
    return coordinates


def shingle_sets(texts: pa.Array, words: int = WORDS) -> list[np.ndarray]:
    """The hashes of the distinct shingles of each lower-cased text, sorted; empty where there is no word."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts.cast(pa.string())))
    flat, owner = lists.flatten(), pc.list_parent_indices(lists)
    solid = pc.not_equal(flat, "")
    coded = flat.filter(solid).dictionary_encode()
    known = np.array([xxhash.xxh3_64_intdigest(w) for w in coded.dictionary.cast(pa.binary()).to_pylist()], dtype=np.uint64)
    held = known[coded.indices.to_numpy()] if len(known) else known
    begin = np.searchsorted(owner.filter(solid).to_numpy(), np.arange(len(texts) + 1))
    out = []
    for a, b in zip(begin[:-1].tolist(), begin[1:].tolist()):
        width = min(words, b - a)
        mixed = np.full(max(b - a - width + 1, 0) if width else 0, width, dtype=np.uint64)
        for k in range(width):
            mixed = (mixed ^ held[a + k : a + k + len(mixed)]) * ODD
            mixed ^= mixed >> np.uint64(29)
        out.append(np.unique(mixed))
    return out


def signature(shingles: np.ndarray) -> np.ndarray:
    """The least hash of the set under each hash function."""
    least = np.full(COORDINATES, np.iinfo(np.uint64).max, dtype=np.uint64)
    for k in range(0, len(shingles), BLOCK):
        least = np.minimum(least, ((shingles[k : k + BLOCK, None] ^ SHIFTS) * FACTORS).min(axis=0))
    return least


def parities(shingles: np.ndarray) -> np.ndarray:
    """For each class of hashes whether the set holds an odd number of them, as bits of longs."""
    count = np.bincount((shingles >> np.uint64(40)).astype(np.int64) % (64 * PARITIES), minlength=64 * PARITIES)
    return np.packbits((count & 1).astype(bool), bitorder="little").view("<i8")


def described(docs: DataFrame, words: int) -> DataFrame:
    """(doc_id, row, c1, c2, n, s0.., o0.., values) of each row: hash of the set (128 bits), its size, slices of the signature, parities, values.

    `row` is a hash of doc_id and text. Without words n is 0 and the rest null.
    """

    def work(batch: pa.RecordBatch) -> dict:
        sets = shingle_sets(batch.column(2), words)
        full = [k for k, s in enumerate(sets) if len(s)]
        values = (np.array([signature(sets[k]) for k in full], dtype=np.uint64).reshape(-1, COORDINATES) ^ (np.arange(COORDINATES, dtype=np.uint64) * ODD)) * FACTORS
        values ^= values >> np.uint64(32)
        slices = [np.packbits((values >> np.uint64(b) & np.uint64(1)).astype(bool), axis=1, bitorder="little").view("<i8").ravel().tolist() for b in range(SLICES)]
        digests = [xxhash.xxh3_128_digest(sets[k].tobytes()) for k in full]
        c1, c2 = (np.frombuffer(b"".join(d[at : at + 8] for d in digests), dtype="<i8").tolist() for at in (0, 8))

        def spread(column) -> list:
            out = [None] * len(sets)
            for k, v in zip(full, column):
                out[k] = v
            return out

        out = {"doc_id": batch.column(0), "row": batch.column(1), "c1": spread(c1), "c2": spread(c2), "n": [len(s) for s in sets], "values": spread(values.view(np.int64))}
        odd = np.array([parities(sets[k]) for k in full], dtype=np.int64).reshape(-1, PARITIES)
        out |= {f"o{b}": spread(odd[:, b].tolist()) for b in range(PARITIES)}
        return out | {f"s{b}": spread(s) for b, s in enumerate(slices)}

    kinds = dict.fromkeys(["doc_id", "row", "c1", "c2", *FACTS[1:]], "long") | {"values": "array<long>"}
    picked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("doc_id", "text").alias("row"), F.col("text").cast("string").alias("text"))
    return arrow_map(picked, kinds, work)


FACTS = ["node", "n", *(f"s{b}" for b in range(SLICES)), *(f"o{b}" for b in range(PARITIES))]


def side(posts: DataFrame, name: str, columns: list[str]) -> DataFrame:
    return posts.select(*[F.col(c).alias(f"{c}_{name}") for c in columns])


def collide(least: int) -> str:
    """SQL: whether the signatures of sides a and b agree in so many coordinates."""
    return f"bit_count(~({' | '.join(f'(s{b}_a ^ s{b}_b)' for b in range(SLICES))})) >= {least}"


def alike(percent: int) -> str:
    """SQL: whether two sets can be that similar by their sizes and parities; never false for sets that are."""
    differ = " + ".join(f"bit_count(o{b}_a ^ o{b}_b)" for b in range(PARITIES))
    return f"100 * least(n_a, n_b) >= {percent} * greatest(n_a, n_b) and {100 + percent} * ({differ}) <= {100 - percent} * (n_a + n_b)"


def rarest(rows: DataFrame, key: str, need: str) -> DataFrame:
    """Of `rows` (node, n, `key`, df > 1), per node the keys of the prefix: (node, weight, prefix array<struct<at, key>>).

    `need` is SQL for the number of keys a partner must share. `at` is the key's rank among all n keys of the node, those held by no other node first.
    """
    kept = rows.groupBy("node").agg(F.array_sort(F.collect_list(F.struct("df", F.col(key).alias("key")))).alias("held"), F.first("n").alias("n"), F.sum("df").alias("weight"))
    # `held` is bounded by the keys of one node
    kept = kept.withColumn("need", F.expr(need)).where("size(held) >= need")
    return kept.selectExpr("node", "weight", "transform(slice(held, 1, int(greatest(size(held) - need + 1, 0))), (x, i) -> struct(n - size(held) + i + 1 as at, x.key as key)) as prefix")


def pairs_across(posts: DataFrame, roots: DataFrame, on: str) -> DataFrame:
    """Pairs (a, b) of nodes of different components that share a key of `posts` (key, at, node, n, s0..) and meet the condition `on`."""
    placed = stage(posts.join(roots.withColumnRenamed("node", "of"), F.expr("node = of"), "left").withColumn("root", F.coalesce("root", "node")).drop("of"))
    open_ = placed.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select("key")
    counted = placed.join(open_, "key", "left_semi").groupBy("key", "root").agg(F.count("*").alias("size"))
    main = stage(counted.groupBy("key").agg(F.max(F.struct("size", "root")).alias("m")).select(F.col("key").alias("k"), F.col("m.root").alias("main")))
    inside = placed.join(main, F.expr("key = k"))
    columns = ["key", "root", "at", *FACTS]
    left, right = side(inside.where("root <> main"), "a", columns), side(inside, "b", columns)
    found = left.join(right, F.expr(f"key_a = key_b and root_a <> root_b and {on}"))
    return found.select(F.least("node_a", "node_b").alias("a"), F.greatest("node_a", "node_b").alias("b")).distinct()


def full_sets(docs: DataFrame, wanted: DataFrame, words: int) -> DataFrame:
    """(node, shingles) of the nodes `wanted` (node, row), from one row of each."""
    rows = docs.select(F.xxhash64("doc_id", "text").alias("row"), F.col("text").cast("string").alias("text"))
    likely = maybe_in(rows, "row", wanted.select(F.col("row").alias("id"))).where("maybe").drop("maybe")
    picked = likely.join(wanted.select("node", F.col("row").alias("r")), F.expr("row = r")).select("node", "text")

    def work(batch: pa.RecordBatch) -> dict:
        return {"node": batch.column(0), "shingles": [s.view(np.int64) for s in shingle_sets(batch.column(1), words)]}

    return arrow_map(picked, {"node": "long", "shingles": "array<long>"}, work).groupBy("node").agg(F.first("shingles").alias("shingles"))


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough."""
    of = lambda name: sets.select(F.col("node").alias(name), F.col("shingles").alias(f"set_{name}"))
    both = pairs.join(of("a"), "a").join(of("b"), "b").withColumn("common", F.size(F.array_intersect("set_a", "set_b")))
    return both.where(f"100 * common >= {percent} * (size(set_a) + size(set_b) - common)").select("a", "b")


def links(docs: DataFrame, nodes: DataFrame, words: int, percent: int) -> DataFrame:
    """Pairs (a, b) of `nodes` (node, row, n, s0.., o0.., values) that connect all nodes that are connected by similarity."""
    least = matches(percent)
    values = nodes.select("node", F.explode("values").alias("value"))
    several = stage(values.groupBy("value").agg(F.count("*").alias("df")).where("df > 1"))
    rows = values.withColumn("n", F.lit(COORDINATES)).join(several, "value")
    prefixes = rarest(rows, "value", f"{least}")
    posts = stage(prefixes.join(nodes.select("row", *FACTS), "node").select("weight", "row", *FACTS, F.explode("prefix").alias("p")).select("weight", "row", *FACTS, "p.key", "p.at"))
    leaders = posts.groupBy("key").agg(F.max(F.struct("weight", *FACTS)).alias("lead"), F.count("*").alias("members")).where("members > 1")
    leaders = stage(leaders.select(F.col("key").alias("k"), "members", *[F.col(f"lead.{c}").alias(f"{c}_b") for c in FACTS]))
    listed = posts.join(leaders, F.expr("key = k"))
    sets = stage(full_sets(docs, stage(listed.select("node", "row").distinct()), words))
    star = side(posts, "a", ["key", *FACTS]).join(leaders, F.expr(f"key_a = k and node_a <> node_b and {alike(percent)} and {collide(least)}"))
    star = star.select(F.least("node_a", "node_b").alias("a"), F.greatest("node_a", "node_b").alias("b")).distinct()
    first = stage(confirmed(star, sets, percent))
    roots = components(first)
    on = f"{alike(percent)} and {collide(least)}"
    short = pairs_across(posts.join(leaders.where(f"members <= {LONG}"), F.expr("key = k"), "left_semi"), roots, on)
    # lists of many nodes: the nodes' rarest shingles among these lists
    crowd = stage(posts.join(leaders.where(f"members > {LONG}"), F.expr("key = k"), "left_semi").select(*FACTS).distinct())
    shingles = sets.join(crowd.select("node", "n"), "node").select("node", "n", F.explode("shingles").alias("shingle"))
    common = stage(shingles.groupBy("shingle").agg(F.count("*").alias("df")).where("df > 1"))
    # a partner shares at least this many: the smaller set holds `percent` of the larger
    chosen = rarest(shingles.join(common, "shingle"), "shingle", f"({percent} * n + 99) div 100")
    again = chosen.join(crowd, "node").select(*FACTS, F.explode("prefix").alias("p")).select(*FACTS, "p.key", "p.at")
    overlap = f"(({percent} * (n_a + n_b) + {99 + percent}) div {100 + percent})"
    within = f"at_a <= n_a - {overlap} + 1 and at_b <= n_b - {overlap} + 1"
    long = pairs_across(again, roots, f"{within} and {on}")
    second = stage(confirmed(short.unionByName(long).distinct(), sets, percent))
    return first.unionByName(second)


def near_duplicates(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (smallest doc_id of its component).

    Links join documents whose sets of distinct `words`-word shingles have at least `percent` % similarity; with fewer words the whole sequence is the one
    shingle. Null and empty texts have no shingle and no link. Null doc_ids never become a component id unless the component has no other. Repeated rows come back once per row; an empty
    table gives no rows; further columns are ignored.
    """
    marked = stage(described(docs, words))
    facts = [F.min(c).alias(c) for c in ("row", *FACTS[1:])]
    nodes = stage(marked.where("n > 0").groupBy("c1", "c2").agg(F.min("doc_id").alias("first"), F.count("*").alias("rows"), *facts, F.first("values").alias("values")).withColumn("node", F.col("c1")))
    roots = components(links(docs, nodes, words, percent))
    named = nodes.select("c1", "c2", "node", "first", "rows").join(roots, "node", "left")
    least = named.where("root is not null").groupBy("root").agg(F.min("first").alias("least"))
    several = named.where("root is not null or rows > 1").join(least.withColumnRenamed("root", "r"), F.expr("root = r"), "left")
    several = several.select(F.col("c1").alias("k1"), F.col("c2").alias("k2"), F.coalesce("least", "first").alias("component_id"), F.lit(True).alias("named"))
    got = marked.select("doc_id", F.col("n").alias("n_shingles"), "c1", "c2").join(several, F.expr("c1 = k1 and c2 = k2"), "left")
    return got.select("doc_id", "n_shingles", F.when(F.col("named"), F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def op13(docs: DataFrame) -> DataFrame:
    """`near_duplicates` with `kept`: whether the document is the one of its component that stays (false for null doc_ids)."""
    return near_duplicates(docs).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))
