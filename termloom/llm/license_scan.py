"""Licence scans: TF-IDF cosine of the lines of a file to licence templates, then inheritance from the nearest ancestor directory.

Document frequencies are counted over all files: of the templates' terms first, then of the other words of those texts that a template
may be near to. A word that a template does not hold weighs no more there than the template's heaviest term, so a name on the line of a
notice does not weigh more the larger the table is. Compared are: each line; from each line on, as many lines as the template has words
(and one line less), for notices laid out over lines; a licence file as a whole; each passage of as many words as the template has,
which must reach WHOLE, for notices within other text. What a template cannot be near to is not compared: the cosine is at most the
length of the template's vector over the terms it shares.

A file's own licence is the best of these; its score is 0 if nothing reaches SIMILAR. A licence file (named like one, or holding a notice
as lines of its own, which is a score of WHOLE or more) speaks for its directory; files without an own licence inherit from the nearest
ancestor directory for which a licence file speaks.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termloom.llm.common import arrow_map, stage, utf8

SIMILAR = 0.6
WHOLE = 0.9
# fixed values: short notices by licence identifier
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related rights to this work."),
    ("Proprietary", "All rights reserved."),
)
FILE_NAMES = ("license", "licence", "copying", "notice", "unlicense")
# lower-cases A-Z; every ASCII byte but letters, digits, dot and hyphen becomes a blank
TERMS = bytes(i + 32 if 65 <= i <= 90 else i if 48 <= i <= 57 or 97 <= i <= 122 or i > 127 or i in b".-" else 32 for i in range(256))


def terms(text: bytes) -> list[bytes]:
    return [w for w in (x.strip(b".-") for x in text.translate(TERMS).split()) if w]


def vector(words: list[bytes], weight: dict[bytes, float]) -> dict[bytes, float]:
    out: dict[bytes, float] = {}
    for w in words:
        out[w] = out.get(w, 0.0) + weight[w]
    norm = math.sqrt(sum(x * x for x in out.values())) or 1.0
    return {w: x / norm for w, x in out.items()}


# kinds of compared texts; of equal scores, lines of their own come before a passage
PASSAGE, LINES = 0, 1
NAMES = sorted({name for name, _ in TEMPLATES})
#: what a file's best text is chosen by, ascending: whether it speaks, score, kind, words of the template of a passage, then the first line and the first identifier
RANK = {"notice": "int", "score": "double", "kind": "int", "size": "int", "before": "int", "order": "int"}
NONE = (0, 0.0, 0, 0, 0, 0)


class Matcher:
    """`frequency`: in how many of `files` files a word occurs; a word that is not in it counts as found in one."""

    def __init__(self, frequency: dict[bytes, int], files: int, templates=TEMPLATES):
        self.files = files
        self.rare = self.idf(1)
        self.weight = {w: self.idf(df) for w, df in frequency.items()}
        self.names = [name for name, _ in templates]
        words = [terms(text.encode()) for _, text in templates]
        self.sizes = [len(x) for x in words]
        raw = [{w: self.weight.get(w, self.rare) for w in x} for x in words]
        self.templates = [vector(x, weight) for x, weight in zip(words, raw)]
        self.heaviest = [max(weight.values()) for weight in raw]
        self.shares = [{w: x * x for w, x in t.items()} for t in self.templates]
        self.vocabulary = frozenset(w for t in self.shares for w in t)

    def idf(self, df: int) -> float:
        return math.log((1 + self.files) / (1 + df)) + 1

    def within_reach(self, words: set[bytes], among) -> list[int]:
        """The templates of which `words` hold enough for a cosine of SIMILAR: no cosine is above the length of the shared terms' vector."""
        held = self.vocabulary & words
        return [k for k in among if sum([x for w, x in self.shares[k].items() if w in held]) >= SIMILAR**2 - 1e-9] if held else []

    def cosine(self, words: list[bytes], k: int, weight: dict[bytes, float], other: float) -> float:
        """Cosine to template `k`; `other` is the weight of words not in `weight`."""
        t, heaviest = self.templates[k], self.heaviest[k]
        dot = norm = 0.0
        for w, n in Counter(words).items():
            x = n * (weight.get(w, other) if w in t else min(weight.get(w, other), heaviest))
            norm += x * x
            dot += x * t.get(w, 0.0)
        return dot / math.sqrt(norm) if norm else 0.0

    def rank(self, score: float, k: int, kind: int, line: int) -> tuple:
        score = round(score, 12)
        if score < (SIMILAR if kind == LINES else WHOLE):
            return NONE
        return (int(kind == LINES and score >= WHOLE), score, kind, 0 if kind == LINES else self.sizes[k], -line, -NAMES.index(self.names[k]))

    def texts(self, text: bytes, named: bool) -> Iterator[tuple[int, int, int, list[bytes]]]:
        """(template, kind, first line, words) of all texts within reach of a template."""
        among = self.within_reach(set(terms(text)), range(len(self.names)))
        if not among:
            return
        lines = [x for x in ((i, terms(line)) for i, line in enumerate(text.split(b"\n"))) if x[1]]
        for i, words in lines:
            for k in self.within_reach(set(words), among):
                yield k, LINES, i, words
        flat = [w for _, words in lines for w in words]
        if named:
            for k in among:
                yield k, LINES, 0, flat
        for k in among:
            share, size = self.shares[k], self.sizes[k]
            for at, (i, words) in enumerate(lines):
                if len(words) >= size or share.keys().isdisjoint(words):
                    continue
                block, end = list(words), at + 1
                while end < len(lines) and len(block) < size:
                    before, block, end = block, block + lines[end][1], end + 1
                    if len(block) >= size or end == len(lines):
                        for part in (before, block) if len(before) > len(words) else (block,):
                            if self.within_reach(set(part), (k,)):
                                yield k, LINES, i, part
            # passages: the share of the distinct terms in a sliding window
            counts, held, number = dict.fromkeys(share, 0), 0.0, [i for i, words in lines for _ in words]
            for end, w in enumerate(flat):
                if w in share:
                    counts[w] += 1
                    held += share[w] if counts[w] == 1 else 0.0
                if end >= size and (gone := flat[end - size]) in share:
                    counts[gone] -= 1
                    held -= share[gone] if not counts[gone] else 0.0
                if held >= WHOLE**2 - 1e-6 and end >= size - 1:
                    yield k, PASSAGE, number[end - size + 1], flat[end - size + 1 : end + 1]

    def closed_and_open(self, text: bytes, named: bool) -> tuple[tuple, list[tuple[bytes, int, int, int]]]:
        """The best rank of texts whose words all have a known frequency, and the texts that may be better: (words, template, kind, line)."""
        best, waiting = NONE, {}
        for k, kind, line, words in self.texts(text, named):
            # an unknown word weighs 1 at least, as one that is in every file
            rank = self.rank(self.cosine(words, k, self.weight, 1.0), k, kind, line)
            if all(w in self.weight for w in words):
                best = max(best, rank)
            elif rank > NONE:
                waiting[(b" ".join(words), k, kind, line)] = rank
        return best, [x for x, rank in waiting.items() if rank > best]

    def file(self, text: bytes, named: bool = False) -> tuple[str | None, float, int]:
        """(licence, score, line number); no licence: None, 0.0, -1."""
        best = max((self.rank(self.cosine(words, k, self.weight, self.rare), k, kind, line) for k, kind, line, words in self.texts(text, named)), default=NONE)
        return (NAMES[-best[5]], best[1], -best[4]) if best > NONE else (None, 0.0, -1)


def frequencies(files: DataFrame) -> tuple[dict[bytes, int], int]:
    """In how many files each template term occurs, and the number of files; counted in tasks, summed by term."""
    vocabulary = {w for _, text in TEMPLATES for w in terms(text.encode())}

    def work(batch: pa.RecordBatch) -> dict:
        found: dict[bytes, int] = {}
        n = 0
        for text in utf8(batch.column(0)):
            n += 1
            words = set((text or b"").translate(TERMS).split())
            for w in vocabulary & (words | {x.strip(b".-") for x in words if x[:1] in b".-" or x[-1:] in b".-"}):
                found[w] = found.get(w, 0) + 1
        return {"term": [w.decode() for w in found] + [""], "n": [*found.values(), n]}

    counted = arrow_map(files.select(F.col("text").cast("string")), {"term": "string", "n": "long"}, work)
    rows = counted.groupBy("term").agg(F.sum("n").alias("n")).collect()  # one row per template term
    known = {r["term"].encode(): r["n"] for r in rows}
    total = known.pop(b"", 0)
    return {w: known.get(w, 0) for w in vocabulary}, total


def revived(state: dict) -> Matcher:
    matcher = Matcher.__new__(Matcher)
    matcher.__dict__.update(state)
    return matcher


def counted_words(files: DataFrame, words: DataFrame) -> DataFrame:
    """(word, n): in how many files each of `words` (word) occurs, and some words more.

    Tasks count the words whose bit is set in a map of 2^22 bits, so what is broadcast is bounded; sums by word follow.
    """
    bit = F.crc32("word") % (1 << 22)
    masks = words.groupBy((bit / 64).cast("long").alias("slot")).agg(F.bit_or(F.expr("shiftleft(1L, cast(crc32(word) % 64 as int))")).alias("mask"))
    bits = {r["slot"]: r["mask"] for r in masks.collect()}  # at most 2^16 rows
    held = files.sparkSession.sparkContext.broadcast(bits)

    def work(batch: pa.RecordBatch) -> dict:
        mask, found = held.value.get, {}
        for text in utf8(batch.column(0)):
            for w in set(terms(text or b"")):
                h = zlib.crc32(w) & 0x3FFFFF
                if mask(h >> 6, 0) >> (h & 63) & 1:
                    found[w] = found.get(w, 0) + 1
        return {"word": [w.decode() for w in found], "n": list(found.values())}

    return arrow_map(files.select(F.col("text").cast("string")), {"word": "string", "n": "long"}, work).groupBy("word").agg(F.sum("n").alias("n"))


def scan(files: DataFrame) -> DataFrame:
    """Per file (path, text, and `id` columns are kept): path, own, own_score, own_line, speaks."""
    held = files.sparkSession.sparkContext.broadcast(Matcher(*frequencies(files)).__dict__)  # templates and their terms

    def work(batch: pa.RecordBatch) -> dict:
        paths = batch.column(1).to_pylist()
        named = [(p or "").rsplit("/", 1)[-1].lower().split(".")[0] in FILE_NAMES for p in paths]
        m = revived(held.value)
        got = [m.closed_and_open(t or b"", n) for t, n in zip(utf8(batch.column(2)), named)]
        return {
            "id": batch.column(0), "path": paths, "named": named, **{name: [best[i] for best, _ in got] for i, name in enumerate(RANK)},
            "words": [[x[0].decode() for x in more] for _, more in got], **{name: [[x[i] for x in more] for _, more in got] for i, name in enumerate(("template", "of", "line"), 1)},
        }

    given = files.select(F.col("id").cast("long"), F.col("path").cast("string"), F.col("text").cast("string"))
    kinds = {"id": "long", "path": "string", "named": "boolean", **RANK, "words": "array<string>", "template": "array<int>", "of": "array<int>", "line": "array<int>"}
    # the number is written with the row, so it stays the same for all that follows
    first = stage(arrow_map(given, kinds, work).withColumn("row", F.monotonically_increasing_id()))
    keys, rank = ["row", "id", "path", "named"], F.struct(*RANK)
    done = first.where(F.size("words") == 0).select(*keys, rank.alias("best"))
    waiting = first.where(F.size("words") > 0)
    if not waiting.isEmpty():
        done = done.unionByName(waiting.select(*keys, rank.alias("best")).unionByName(_ranked(given, waiting, held, keys)).groupBy(*keys).agg(F.max("best").alias("best")))
    own = F.when(F.col("best.score") > 0, F.element_at(F.array(*[F.lit(n) for n in NAMES]), 1 - F.col("best.order")))
    return done.select(
        "id", "path", own.alias("own"), F.col("best.score").alias("own_score"), F.when(own.isNull(), -1).otherwise(-F.col("best.before")).alias("own_line"),
        (own.isNotNull() & (F.col("named") | (F.col("best.notice") == 1))).alias("speaks"),
    )


def _ranked(files: DataFrame, waiting: DataFrame, held, keys: list[str]) -> DataFrame:
    """The texts with words outside the templates, ranked by the document frequencies of all their words: `keys` and `best`."""
    texts = waiting.select(*keys, F.explode(F.arrays_zip("words", "template", "of", "line")).alias("t")).select(*keys, "t.*")
    # each text is scored once, however many files hold it
    each = texts.select("words", "template").distinct()
    spread = stage(each.select("words", "template", F.explode(F.array_distinct(F.split("words", " "))).alias("word")))
    known = counted_words(files, spread.select("word").distinct())
    numbered = spread.join(known, "word").groupBy("words", "template").agg(F.collect_list("word").alias("terms"), F.collect_list("n").alias("ns"))

    def score(batch: pa.RecordBatch) -> dict:
        m, out = revived(held.value), []
        for words, k, names, ns in zip(*(c.to_pylist() for c in batch.columns)):
            weight = {w.encode(): m.idf(n) for w, n in zip(names, ns)}
            out.append(m.cosine(words.encode().split(b" "), k, weight, m.rare))
        return {"words": batch.column(0), "template": batch.column(1), "score": out}

    scored = arrow_map(numbered, {"words": "string", "template": "int", "score": "double"}, score)
    joined = texts.join(scored, ["words", "template"])

    def place(batch: pa.RecordBatch) -> dict:
        m = revived(held.value)
        ranks = [m.rank(*x) for x in zip(*(batch.column(i).to_pylist() for i in range(4, 8)))]
        return {**{name: batch.column(i) for i, name in enumerate(keys)}, **{name: [r[i] for r in ranks] for i, name in enumerate(RANK)}}

    placed = arrow_map(joined.select(*keys, "score", "template", "of", "line"), {"row": "long", "id": "long", "path": "string", "named": "boolean", **RANK}, place)
    return placed.select(*keys, F.struct(*RANK).alias("best"))


def directories(path: str = "path"):
    """All ancestor directories of a path, nearest first; the root is ''."""
    parts = F.slice(F.split(path, "/"), 1, F.size(F.split(path, "/")) - 1)
    return F.transform(F.sequence(F.size(parts), F.lit(0), F.lit(-1)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))


def licences(files: DataFrame) -> DataFrame:
    """(id, path, own, own_score, license, origin, from_path) per row of `files` (id, path, text).

    origin: own, inherited or none. If several licence files speak for a directory, the first path in order does, then
    the smallest identifier. Null and empty texts have no licence of their own; a null path has no directory. Repeated rows
    come back each. Without files, and for files no template is near to, nothing is inherited.
    """
    found = stage(scan(files))
    speakers = found.where("speaks and path is not null").withColumn("dir", F.get(directories(), F.lit(0)))
    by_dir = stage(speakers.groupBy("dir").agg(F.min(F.struct("path", "own")).alias("first")).select("dir", F.col("first.path").alias("from_path"), F.col("first.own").alias("theirs")))
    # each directory that files lie in looks up its own ancestors, so a directory of many files is asked for once
    own_dir = F.get(directories(), F.lit(0))
    places = found.where("own is null and path is not null").select(own_dir.alias("place")).distinct()
    chain = F.transform(F.sequence(F.size(F.split("place", "/")), F.lit(0), F.lit(-1)), lambda n: F.array_join(F.slice(F.split("place", "/"), 1, n), "/"))
    ancestors = places.select("place", F.posexplode(chain).alias("up", "dir"))
    nearest = ancestors.join(by_dir, "dir").groupBy("place").agg(F.min(F.struct("up", "from_path", "theirs")).alias("best"))
    joined = found.withColumn("dir_of", F.when(F.col("own").isNull(), own_dir)).join(nearest, F.expr("dir_of = place"), "left")
    origin = F.when(F.col("own").isNotNull(), "own").when(F.col("best").isNotNull(), "inherited").otherwise("none")
    return joined.select("id", "path", "own", "own_score", F.coalesce("own", "best.theirs").alias("license"), origin.alias("origin"), F.when(F.col("own").isNull(), F.col("best.from_path")).alias("from_path"))


def op4(docs: DataFrame) -> DataFrame:
    """Documents as files: source / language / thousands / hundreds / doc_id."""
    level = lambda n: F.floor(F.col("doc_id") / n).cast("long").cast("string")
    path = F.concat_ws("/", F.coalesce("source", F.lit("_")), F.coalesce("lang", F.lit("_")), level(1000), level(100), F.col("doc_id").cast("string"))
    got = licences(docs.select(F.col("doc_id").alias("id"), F.when(F.col("doc_id").isNotNull(), path).alias("path"), "text"))
    return got.select(F.col("id").alias("doc_id"), "path", "own", F.round("own_score", 6).alias("own_score"), "license", "origin", "from_path")
