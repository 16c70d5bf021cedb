"""Near-duplicate documents: SimHash fingerprints linked through fuzzy hashing with the binary Golay code.

A fingerprint's 64 bits are cut into segments of 23, 23 and 18 bits. Every 23-bit word lies within 3 bits of exactly one
codeword of the [23, 12, 7] Golay code. A word's keys are its nearest codeword and, if that is 3 bits away, the five
codewords 4 bits away as well; two words that differ in at most 2 bits always share such a key. (Let w be a word half way.
If w has a codeword within 2 bits, that is within 3 of both. Else the 3-bit and the five 4-bit error patterns of w partition
the 23 positions, and walking through the cases leaves a shared key each time.)

Pigeonhole for fingerprints at 4 or fewer differing bits, with e1, e2, e3 errors in the segments:
* e1, e2 <= 2: keys are pairs of codewords of segments 1 and 2;
* e1 >= 3: segments 2 and 3 hold one error at most, so one of them is equal: keys are an exact segment with codewords of the other;
* e2 >= 3: likewise for segments 1 and 3.
The cases exclude each other, and rows are verified in the join condition, so that hardly any pair is emitted twice.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termloom.llm.common import arrow_map, components, maybe_in, stage, utf8

WORDS = 4
BITS = 4
SEED = 42
GENERATOR = 0xC75  # fixed value: x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1
SEGMENTS = ((0, 23), (23, 23), (46, 18))
MASKS = tuple(((1 << n) - 1) << s for s, n in SEGMENTS)
# shingles whose bits are counted at once
BLOCK = 1 << 16


def fingerprint(text: bytes | None, words: int = WORDS) -> int:
    """SimHash of the shingles of `words` lower-cased words, repeats counted; 0 if there is no word."""
    split = (text or b"").lower().split()
    if not split:
        return 0
    norm = b" ".join(split)
    gaps = np.flatnonzero(np.frombuffer(norm, dtype=np.uint8) == 32)
    starts = [0, *(gaps + 1).tolist()][: max(1, len(split) - words + 1)]
    ends = [*gaps.tolist(), len(norm)][words - 1 :] or [len(norm)]
    digest = xxhash.xxh64_intdigest
    counts = np.zeros(64, dtype=np.int64)
    for k in range(0, len(starts), BLOCK):
        h = np.array([digest(norm[s:e], SEED) for s, e in zip(starts[k : k + BLOCK], ends[k : k + BLOCK])], dtype="<u8")
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(starts), bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """(doc_id, row, fp) of each row; fp is the fingerprint as a signed long, row a hash of doc_id and text.

    Null and empty texts have fingerprint 0.
    """

    def work(batch: pa.RecordBatch) -> dict:
        return {"doc_id": batch.column(0), "row": batch.column(1), "fp": [fingerprint(t, words) for t in utf8(batch.column(2))]}

    picked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("doc_id", "text").alias("row"), F.col("text").cast("string").alias("text"))
    return arrow_map(picked, {"doc_id": "long", "row": "long", "fp": "long"}, work)


def golay_tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """By syndrome: the error pattern of least weight (0..3), whether its weight is 3, and the five patterns of weight 4 there."""
    residue = []
    for i in range(23):
        r = 1 << i
        for k in range(i, 10, -1):
            if r >> k & 1:
                r ^= GENERATOR << (k - 11)
        residue.append(r)
    nearest, far = np.zeros(2048, dtype=np.int64), np.zeros(2048, dtype=bool)
    others = np.zeros((2048, 5), dtype=np.int64)
    found = np.zeros(2048, dtype=np.int64)
    for weight in (1, 2, 3, 4):
        for places in combinations(range(23), weight):
            syndrome, pattern = 0, 0
            for p in places:
                syndrome ^= residue[p]
                pattern |= 1 << p
            if weight < 4:
                nearest[syndrome], far[syndrome] = pattern, weight == 3
            elif far[syndrome]:
                others[syndrome, found[syndrome]] = pattern
                found[syndrome] += 1
    return nearest, far, others


def syndromes(v: np.ndarray) -> np.ndarray:
    r = v.copy()
    for k in range(22, 10, -1):
        r ^= np.where(r >> k & 1, GENERATOR << (k - 11), 0)
    return r


def codewords(v: np.ndarray, tables) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys of 23-bit words: for each row 6 codeword indices (first: nearest), which of them count, which are nearest."""
    nearest, far, others = tables
    s = syndromes(v)
    first = (v ^ nearest[s]) >> 11
    rest = (v[:, None] ^ others[s]) >> 11
    use = np.repeat(far[s][:, None], 6, axis=1)
    use[:, 0] = True
    near = np.zeros_like(use)
    near[:, 0] = True
    return np.column_stack([first, rest]), use, near


def keys_of(fps: np.ndarray, tables) -> dict[str, np.ndarray]:
    """All (key, fp, near) rows of the fingerprints. near: bits 0 and 1 say that the first / second codeword is the nearest."""
    u = fps.view(np.uint64)
    seg = [((u >> np.uint64(s)) & np.uint64((1 << n) - 1)).astype(np.int64) for s, n in SEGMENTS]
    coded = [codewords(x, tables) for x in seg]
    keys, owners, nears = [], [], []

    def add(kind: int, key: np.ndarray, use: np.ndarray, near: np.ndarray) -> None:
        rows = np.nonzero(use)[0]
        keys.append(key[use] | kind << 48)
        owners.append(fps[rows])
        nears.append(near[use])

    (c1, u1, n1), (c2, u2, n2) = coded[0], coded[1]
    n = len(fps)
    both = lambda a, b, f: f(a[:, :, None], b[:, None, :]).reshape(n, 36)
    add(0, both(c1, c2, lambda a, b: a << 12 | b), both(u1, u2, np.logical_and), both(n1, n2, lambda a, b: a.astype(np.int8) | b.astype(np.int8) << 1))
    for kind, exact, fuzzy in ((1, 1, 2), (2, 2, 1), (3, 0, 2), (4, 2, 0)):
        c, use, near = coded[fuzzy]
        add(kind, seg[exact][:, None] << 12 | c, use, near.astype(np.int8))
    return {"key": np.concatenate(keys), "fp": np.concatenate(owners), "near": np.concatenate(nears)}


def fuzzy_keys(fps: DataFrame) -> DataFrame:
    tables = golay_tables()

    def work(batch: pa.RecordBatch) -> dict:
        got = keys_of(batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64), tables)
        return {"key": got["key"], "fp": got["fp"], "near": got["near"].astype(np.int8)}

    return arrow_map(fps.select("fp"), {"key": "long", "fp": "long", "near": "tinyint"}, work)


def links(fps: DataFrame) -> DataFrame:
    """Pairs (a, b) of different fingerprints of `fps` (fp) that differ in at most BITS bits, each once or a few times."""
    keys = fuzzy_keys(fps)
    left = keys.selectExpr("key", "fp as a", "near")
    right = keys.selectExpr("key as key_r", "fp as b")
    signed = [m - (1 << 64) if m >> 63 else m for m in MASKS]
    e1, e2, e3 = (f"bit_count((a ^ b) & {m}L)" if m >= 0 else f"bit_count((a ^ b) & ({m}L))" for m in signed)
    kind = "shiftright(key, 48)"
    near1, near2 = "(near & 1) = 1", "(near & 2) = 2"
    cases = (
        f"({kind} = 0 and {e1} <= 2 and {e2} <= 2 and ({e1} > 0 or {near1}) and ({e2} > 0 or {near2}))",
        f"({kind} = 1 and {e1} >= 3 and {e2} = 0 and ({e3} > 0 or {near1}))",
        f"({kind} = 2 and {e1} >= 3 and {e3} = 0 and {e2} = 1)",
        f"({kind} = 3 and {e2} >= 3 and {e1} = 0 and ({e3} > 0 or {near1}))",
        f"({kind} = 4 and {e2} >= 3 and {e3} = 0 and {e1} = 1)",
    )
    on = f"key = key_r and a < b and bit_count(a ^ b) <= {BITS} and ({' or '.join(cases)})"
    # a fingerprint has up to 56 keys, but Spark sizes the keys as if it had one: without the hint it broadcasts tables of many times its threshold
    return left.hint("merge").join(right, F.expr(on)).select("a", "b")


def near_duplicates(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """One row per document: doc_id, row, fp, component_id (smallest doc_id of the component of linked fingerprints).

    Null texts count as empty; documents without words have fingerprint 0 and are linked like any other. Equal fingerprints
    are one node, so groups of copies cost one aggregated row. Null doc_ids never become a component id unless the
    component has no other. Repeated rows come back once per row. An empty table gives no rows; further columns are ignored.
    """
    marked = stage(fingerprints(docs, words))
    nodes = stage(marked.groupBy("fp").agg(F.min("doc_id").alias("first")))
    roots = components(links(nodes))
    named = nodes.join(roots.withColumnRenamed("node", "fp"), "fp").select("fp", "root", "first")
    least = named.groupBy("root").agg(F.min("first").alias("least"))
    linked = named.join(least, "root").select("fp", "least")
    ids = nodes.join(linked, "fp", "left").select("fp", F.coalesce("least", "first").alias("component_id"))
    return marked.join(ids, "fp").select("doc_id", "row", "fp", "component_id")


def one_of_each(docs: DataFrame) -> DataFrame:
    """The columns of `docs`, one row of each component: the smallest doc_id (nulls last), of that the smallest row hash.

    Rows are told apart by the hash of doc_id and text; of rows that repeat both, one stays.
    """
    found = stage(near_duplicates(docs))
    key = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "row")
    grouped = found.groupBy("component_id").agg(F.min(key).alias("best"), F.count("*").alias("n"))
    several = stage(grouped.where("n > 1").select(F.col("component_id").alias("c"), F.col("best.row").alias("best")))
    members = found.join(several, F.expr("component_id <=> c"))
    away = stage(members.where("row <> best").select(F.col("row").alias("gone")).distinct())
    repeats = stage(members.where("row = best").groupBy("row").agg(F.count("*").alias("n")).where("n > 1").select(F.col("row").alias("twice")))
    row = F.xxhash64("doc_id", "text")
    # most rows surely stay; only the others are shuffled
    marked = maybe_in(docs.select(F.struct("*").alias("doc"), row.alias("row")), "row", away.withColumnRenamed("gone", "id"))
    unsure = marked.where("maybe").join(away, F.expr("row = gone"), "left_anti")
    kept = marked.where("not maybe").select("doc.*").unionByName(unsure.select("doc.*"))
    if repeats.isEmpty():
        return kept
    alone = kept.join(repeats, row == F.col("twice"), "left_anti")
    again = kept.join(repeats, row == F.col("twice"), "left_semi").dropDuplicates(["doc_id", "text"])
    return alone.unionByName(again)


def op2(docs: DataFrame) -> DataFrame:
    got = near_duplicates(docs)
    return got.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
