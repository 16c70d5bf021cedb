"""Line deduplication over the whole corpus by a segment-partition edit join; DataFrame functions only.

Equal lines are one class. Lines also join the class of a line within as many edits (code points) as their length allows: BANDS gives the edits for
the shorter of two lines, none below the shortest band. For k edits each line is cut into k + 1 segments, so a line within k edits holds one of
them unchanged, shifted by no more than the edits before it. Segments are indexed by (length, number, text); each line probes, for its own length and
those up to k shorter, the few places where such a segment can lie (position windows from both ends, intersected).

Most segments are found in no other line. The keys that two lines have in common come from one aggregation of all keys; only lines with such a key
get a signature of letter counts, and are joined under those keys where the signatures allow for the edits. Candidates are verified by the bit-parallel
automaton of edit distance, cut to the band of 2 k + 1 diagonals, which with all numbers of errors fits into one long. Linked lines form
classes by connected components.

Of each class the first occurrence stays, in order of (doc_id, line number), then by a hash of the row; all others are removed. Blank lines always stay.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from termloom.llm.common import components, maybe_in, stage

# (characters of the shorter line, edits), from the longest lines on
BANDS = ((30, 2), (12, 1))
# letters whose counts make the signature, in so many classes
LETTERS = "abcdefghijklmnopqrstuvwxyz"
CLASSES = 16
# bits between the error levels of a verification state: a band of up to 7 diagonals
LEVEL = 8


def lines(docs: DataFrame) -> DataFrame:
    """(row, at, pos, line, h1, h2) of each line that is not blank. `at` orders occurrences; h1, h2 are 128 bits of the line's hash.

    Null doc_ids come after all others, by the hash of their row.
    """
    row = F.xxhash64("doc_id", "text")
    unsigned = F.expr("cast(shiftrightunsigned(row, 1) as decimal(20,0)) + 9223372036854775808")
    exploded = docs.select(row.alias("row"), F.col("doc_id").cast("long").alias("id"), F.posexplode(F.split("text", "\n", -1)).alias("pos", "line")).where("trim(both ' \t\r' from line) <> ''")
    first = F.coalesce(F.col("id").cast("decimal(20,0)"), unsigned).cast("decimal(20,0)")
    at = (first * F.lit(1 << 31).cast("decimal(10,0)") + F.col("pos").cast("decimal(10,0)")) * F.lit(1 << 20).cast("decimal(7,0)") + F.expr("cast(row & 1048575 as decimal(7,0))")
    return exploded.select("row", at.cast("decimal(38,0)").alias("at"), "pos", "line", F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(7), "line").alias("h2"))


def key(i: int, length: str, shift: int, threshold: int) -> str:
    """SQL for the hash of segment i of an indexed line of `length`, as found in `line` at that place moved by `shift`."""
    start, end = (f"(({k} * ({length})) div {threshold + 1})" for k in (i, i + 1))
    return f"xxhash64({threshold * 16 + i}, cast({length} as int), substring(line, cast({start} + {shift + 1} as int), cast({end} - {start} as int)))"


def probes(threshold: int) -> list[str]:
    """Keys a line probes besides those of its own index: per length difference and segment, the shifts that both ends allow."""
    out = []
    for delta in range(threshold + 1):
        for i in range(threshold + 1):
            low = max(-i, delta - (threshold - i))
            high = min(i, delta + (threshold - i))
            out += [key(i, f"n - {delta}", shift, threshold) for shift in range(low, high + 1) if delta or shift]
    return out


def by_band(bands: tuple, keys) -> Column:
    """The keys of a line for each band its length takes part in: from the band's shortest line to the longest that is near a shorter band's."""
    parts, longest = [], None
    for shortest, threshold in bands:
        inside = F.col("n") >= shortest
        if longest is not None:
            inside = inside & (F.col("n") < longest + threshold)
        parts.append(F.when(inside, F.array(*[F.expr(k) for k in keys(threshold)])).otherwise(F.array().cast("array<bigint>")))
        longest = shortest
    return F.concat(*parts)


def signature() -> Column:
    """16 counts of letters, modulo 16, in one long; letter k of the alphabet counts in class k modulo 16."""
    total = F.lit(0).cast("long")
    for k in range(CLASSES):
        count = sum((F.octet_length("line") - F.octet_length(F.replace("line", F.lit(c), F.lit(""))) for c in LETTERS[k::CLASSES]), F.lit(0))
        total = total.bitwiseOR(F.shiftleft(count.bitwiseAND(F.lit(15)).cast("long"), 4 * k))
    return total


def allowed(bands: tuple, length: str) -> str:
    """SQL for the edits that two lines may differ by, the shorter of `length`."""
    return "case " + " ".join(f"when {length} >= {shortest} then {threshold}" for shortest, threshold in bands) + " else 0 end"


def apart(limit: str) -> str:
    """Whether two signatures allow for `limit` edits: each edit moves two counts by one at most."""
    nibble = [f"(((shiftright(sig_a, {4 * k}) & 15) - (shiftright(sig_b, {4 * k}) & 15)) & 15)" for k in range(CLASSES)]
    return " + ".join(f"least({d}, 16 - {d})" for d in nibble) + f" <= 2 * ({limit})"


def within(threshold: int) -> str:
    """SQL: whether line_a and line_b are at most `threshold` edits apart.

    Bit d of level e says that, after j characters of b, the first j + d - threshold of a can be had with e edits. A character keeps a bit where
    it equals a's next one; an edit leads to the next level: a replaced character to the same bit, one more in b to the bit below, one more in a to the bit above.
    """
    band = (1 << 2 * threshold + 1) - 1
    equal = " | ".join(f"if(get(chars_a, j + {d - threshold}) <=> chars_b[j], {1 << d}, 0)" for d in range(2 * threshold + 1))
    levels, start = [], 0
    for e in range(threshold + 1):
        was = f"(shiftright(state, {LEVEL * e}) & {band})"
        step = f"({was} & same)"
        if e:
            before = f"(shiftright(state, {LEVEL * (e - 1)}) & {band})"
            step = f"(({step} | {before} | shiftright({before}, 1) | shiftleft({levels[-1]}, 1)) & {band})"
        levels.append(step)
        start |= sum(1 << threshold + d for d in range(e + 1)) << LEVEL * e
    state = " | ".join(f"shiftleft({step}, {LEVEL * e})" for e, step in enumerate(levels))
    masks = f"transform(sequence(0, size(chars_b) - 1), j -> cast({equal} as bigint))"
    at = f"{LEVEL * threshold + threshold} + size(chars_a) - size(chars_b)"
    return f"(abs(size(chars_a) - size(chars_b)) <= {threshold} and (shiftright(aggregate({masks}, {start}L, (state, same) -> {state}), {at}) & 1) = 1)"


def near_links(docs: DataFrame, repeated: DataFrame, bands: tuple = BANDS) -> DataFrame:
    """(a, b): hashes h1 of different lines within the edits that their lengths allow."""
    long = lines(docs).withColumn("n", F.length("line")).where(F.col("n") >= bands[-1][0])
    sorted_out = maybe_in(long, "h1", repeated.select(F.col("h1").alias("id")))
    seen_once = sorted_out.where("not maybe").select("h1", "line", "n")
    first = repeated.select(F.col("h1").alias("r1"), F.col("h2").alias("r2"), "first")
    others = sorted_out.where("maybe").join(first, F.expr("h1 = r1 and h2 = r2"), "left").where("first is null or at = first").select("h1", "line", "n")
    index = by_band(bands, lambda k: [key(i, "n", 0, k) for i in range(k + 1)])
    keyed = stage(seen_once.unionByName(others).select("h1", "line", "n", index.alias("index"), by_band(bands, probes).alias("probes")))
    left = keyed.select("h1", F.lit(True).alias("indexed"), F.explode("index").alias("key"))
    every = left.unionByName(keyed.select("h1", F.lit(False).alias("indexed"), F.explode("probes").alias("key")))
    # keys of two lines at least, one of which has it in its index: line and mark travel as one long, negative where the key is indexed
    narrow = every.select("key", F.expr("(h1 & 9223372036854775807L) | if(indexed, shiftleft(1L, 63), 0L)").alias("of"))
    common = narrow.groupBy("key").agg(F.min("of").alias("low"), F.max("of").alias("high")).where("low < 0 and low <> high")
    common = stage(common.select(F.col("key").alias("id")))
    posts = stage(maybe_in(every, "key", common).where("maybe").join(common, F.expr("key = id"), "left_semi").select("h1", "indexed", "key"))
    chosen = stage(posts.select(F.col("h1").alias("id")).distinct())
    partners = stage(maybe_in(keyed.select("h1", "line", "n"), "h1", chosen).where("maybe").join(chosen, F.expr("h1 = id"), "left_semi").select("h1", "line", "n", signature().alias("sig")))
    signed = posts.join(partners.select(F.col("h1").alias("of"), "n", "sig"), F.expr("h1 = of"))
    side = lambda name, rows: rows.select(*[F.col(c).alias(f"{c}_{name}") for c in ("h1", "n", "sig", "key")])
    # a line probes the keys of its own index too
    near = side("a", signed.where("indexed")).join(side("b", signed), F.expr(f"key_a = key_b and h1_a <> h1_b and {apart(allowed(bands, 'least(n_a, n_b)'))}"))
    pairs = stage(near.select(F.least("h1_a", "h1_b").alias("a"), F.greatest("h1_a", "h1_b").alias("b")).distinct())
    # a character class that takes whole code points
    of = lambda name: partners.select(F.col("h1").alias(name), F.col("n").alias(f"n_{name}"), F.regexp_extract_all("line", F.lit("(?s)."), F.lit(0)).alias(f"chars_{name}"))
    verified = " or ".join(f"(least(n_a, n_b) >= {shortest} and {within(threshold)})" for shortest, threshold in bands)
    # characters as arrays take many times the size of the files they are read from, by which Spark would choose to broadcast them
    return pairs.join(of("a").hint("merge"), "a").join(of("b").hint("merge"), "b").where(F.expr(verified)).select("a", "b")


def removed(docs: DataFrame, bands: tuple = BANDS) -> DataFrame:
    """(row, gone): line numbers to remove, by row (hash of doc_id and text), for rows that lose a line."""
    every = stage(lines(docs).select("row", "at", "pos", "h1", "h2"))
    repeated = stage(every.groupBy("h1", "h2").agg(F.min("at").alias("first"), F.count("*").alias("n")).where("n > 1"))
    classes = components(near_links(docs, repeated, bands)).select(F.col("node").alias("node"), "root")
    members = maybe_in(every, "h1", classes.select(F.col("node").alias("id"))).where("maybe").join(classes, F.expr("h1 = node")).groupBy("node", "root").agg(F.min("at").alias("first"))
    roots = members.groupBy("root").agg(F.min("first").alias("first"))
    near = members.select("node", "root").join(roots, "root").select(F.col("node").alias("n1"), F.col("first").alias("class_first"))
    # a class by near links holds all occurrences of its lines, so it overrides the class by equality
    equal = repeated.select(F.col("h1").alias("r1"), F.col("h2").alias("r2"), "first")
    suspects = maybe_in(every, "h1", repeated.select(F.col("h1").alias("id")).unionByName(near.select(F.col("n1").alias("id")))).where("maybe")
    placed = suspects.join(equal, F.expr("h1 = r1 and h2 = r2"), "left").join(near, F.expr("h1 = n1"), "left")
    gone = placed.where(F.col("at") > F.coalesce("class_first", "first"))
    return gone.groupBy("row").agg(F.collect_set("pos").alias("gone"))  # bounded by the lines of one text


def kept_lines(docs: DataFrame, bands: tuple = BANDS) -> DataFrame:
    """`docs` as struct `doc`, with n_lines, n_removed and `kept`, the text without removed lines.

    Null texts have no lines and stay null; an empty text is one blank line. Null doc_ids come last. Rows that repeat (doc_id, text) count as one
    occurrence, so all of them keep the same lines. Columns of `docs` may have any names. Empty tables give no rows.
    """
    away = removed(docs, bands)
    marked = docs.select(F.struct("*").alias("doc"), F.xxhash64("doc_id", "text").alias("row")).join(away, "row", "left")
    parts = F.split("doc.text", "\n", -1)
    kept = F.when(F.col("gone").isNull(), F.col("doc.text")).otherwise(F.array_join(F.filter(parts, lambda x, i: ~F.array_contains("gone", i)), "\n"))
    # -1 where a text is null
    n_lines = F.when(F.col("doc.text").isNull(), 0).otherwise(F.size(parts)).cast("long")
    return marked.select("doc", n_lines.alias("n_lines"), F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_removed"), kept.alias("kept"))


def dedup_lines(docs: DataFrame) -> DataFrame:
    """The columns of `docs` with repeated lines removed. A document goes only if it lost lines and nothing but blanks is left."""
    got = kept_lines(docs).where("n_removed = 0 or trim(both ' \t\r\n' from kept) <> ''")
    out = {"text": F.col("kept")}
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        out["n_chars"] = F.when(F.col("n_removed") > 0, F.length("kept").cast(kind)).otherwise(F.col("doc.n_chars"))
    return got.select(*[out[c].alias(c) if c in out else F.col("doc").getField(c).alias(c) for c in docs.columns])


def op7(docs: DataFrame) -> DataFrame:
    """`kept_lines` as one row per document: n_lines, n_removed, length and digest of the text that is kept; odd rows as stated there."""
    got = kept_lines(docs)
    digest = F.sha2(F.coalesce("kept", F.lit("")), 256)
    return got.select(F.col("doc.doc_id").alias("doc_id"), "n_lines", "n_removed", F.coalesce(F.length("kept"), F.lit(0)).cast("long").alias("n_chars_kept"), digest.alias("kept_sha256"))
