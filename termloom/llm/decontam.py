"""Benchmark decontamination: a generalised suffix automaton of the test items, and training texts streamed through it.

Items are normalised to words, numbered, and added to one automaton per shard of items (bounded words per shard). A text's
words are numbered by the same vocabulary; the automaton is walked along every stretch in which all neighbouring words
follow each other in some item. Elsewhere the matching length is known to be below two without walking. The
state reached, with the matching length, tells which windows end at a word: WINDOW words of an item, or a whole shorter item.
"""

from __future__ import annotations

import pickle

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termloom.llm.common import stage, utf8

# stands for the missing id of an item
UNNAMED = -(1 << 63)
WINDOW = 10
# words of items in one automaton; more items mean more shards, and one more pass over each text per shard
SHARD_WORDS = 200_000
# a document goes whole if a larger share of its words is hit, or if it has a longer hit stretch, in words
MAX_COVERAGE = 0.5
MAX_STRETCH = 400
# lower-cases A-Z; every other ASCII byte but digits and letters becomes a blank
LETTERS = bytes(i + 32 if 65 <= i <= 90 else i if 48 <= i <= 57 or 97 <= i <= 122 or i > 127 else 32 for i in range(256))


def words_of(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(LETTERS).split()


class Automaton:
    """Generalised suffix automaton over word numbers, with what windows of items end in each state."""

    def __init__(self, items: list[tuple[int, list[bytes]]], window: int = WINDOW):
        self.window = window
        self.vocabulary: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        texts = [(item, [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words]) for item, words in items if words]
        for _, ids in texts:
            last = 0
            for c in ids:
                last = self._extend(last, c)
        self._mark(texts)

    @classmethod
    def loaded(cls, data: bytes) -> Automaton:
        machine = cls.__new__(cls)
        vars(machine).update(pickle.loads(data))
        return machine

    def _clone(self, q: int, length: int) -> int:
        self.next.append(dict(self.next[q]))
        self.length.append(length)
        self.link.append(self.link[q])
        return len(self.next) - 1

    def _extend(self, last: int, c: int) -> int:
        if c in self.next[last]:  # the item goes along a path that exists
            q = self.next[last][c]
            if self.length[q] == self.length[last] + 1:
                return q
            split = self._clone(q, self.length[last] + 1)
            self.link[q] = split
            while last >= 0 and self.next[last].get(c) == q:
                self.next[last][c] = split
                last = self.link[last]
            return split
        new = len(self.next)
        self.next.append({})
        self.length.append(self.length[last] + 1)
        self.link.append(0)
        p = last
        while p >= 0 and c not in self.next[p]:
            self.next[p][c] = new
            p = self.link[p]
        if p >= 0:
            q = self.next[p][c]
            if self.length[q] == self.length[p] + 1:
                self.link[new] = q
            else:
                split = self._clone(q, self.length[p] + 1)
                self.link[q] = self.link[new] = split
                while p >= 0 and self.next[p].get(c) == q:
                    self.next[p][c] = split
                    p = self.link[p]
        return new

    def _mark(self, texts: list[tuple[int, list[int]]]) -> None:
        n = len(self.next)
        order = sorted(range(1, n), key=self.length.__getitem__)
        # the state on the suffix path that holds the last `window` words
        self.at_window = [0] * n
        for v in order:
            if self.length[v] >= self.window:
                above = self.link[v]
                self.at_window[v] = self.at_window[above] if self.length[above] >= self.window else v
        # whole items shorter than a window, by the state that holds them, and the nearest such state at or above
        self.short: dict[int, list[int]] = {}
        self.items: dict[int, set[int]] = {}
        self.short_words: dict[int, int] = {}
        pairs: set[int] = set()
        for item, ids in texts:
            state, length = 0, 0
            for c in ids:
                state, length = self.step(state, length, c)
                if length >= self.window:
                    self.items.setdefault(self.at_window[state], set()).add(item)
            if len(ids) < self.window:
                self.short.setdefault(state, []).append(item)
                self.short_words[state] = len(ids)
            pairs.update(a << 32 | b for a, b in zip(ids, ids[1:]))
        self.nearest_short = [-1] * n
        for v in order:
            self.nearest_short[v] = v if v in self.short else self.nearest_short[self.link[v]]
        self.pairs = np.array(sorted(pairs), dtype=np.int64)
        self.least = min((min(len(ids), self.window) for _, ids in texts), default=self.window)

    def step(self, state: int, length: int, c: int) -> tuple[int, int]:
        while state and c not in self.next[state]:
            state = self.link[state]
            length = self.length[state]
        if c in self.next[state]:
            return self.next[state][c], length + 1
        return 0, 0

    def walk(self, ids: list[int], first: int, spans: list[tuple[int, int]], found: set[int]) -> None:
        """Adds to `spans` the hit stretches [from, to) of the words `ids`, the first of which is word number `first`."""
        state, length = 0, 0
        for at, c in enumerate(ids, first + 1):
            state, length = self.step(state, length, c)
            if length >= self.window:
                spans.append((at - self.window, at))
                found |= self.items[self.at_window[state]]
            v = self.nearest_short[state]
            if v == state and self.short_words[v] > length:
                v = self.nearest_short[self.link[v]]
            while v > 0:
                spans.append((at - self.short_words[v], at))
                found.update(self.short[v])
                v = self.nearest_short[self.link[v]]

    def match(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[int]]:
        spans: list[tuple[int, int]] = []
        found: set[int] = set()
        if not self.vocabulary or len(words) < self.least:
            return spans, found
        number = self.vocabulary.get
        ids = np.array([number(w, 0) for w in words], dtype=np.int64)
        code = ids[:-1] << 32 | ids[1:]
        both = np.flatnonzero((ids[:-1] > 0) & (ids[1:] > 0))
        follows = np.zeros(len(ids) + 1, dtype=bool)  # follows[i]: word i follows word i - 1 in some item
        if len(both) and len(self.pairs):
            place = np.minimum(np.searchsorted(self.pairs, code[both]), len(self.pairs) - 1)
            follows[both[self.pairs[place] == code[both]] + 1] = True
        starts = np.flatnonzero((ids > 0) & ~follows[:-1])
        breaks = np.flatnonzero(~follows)
        ends = breaks[np.searchsorted(breaks, starts, side="right")]
        long = ends - starts >= self.least
        for s, e in zip(starts[long].tolist(), ends[long].tolist()):
            self.walk(ids[s:e].tolist(), s, spans, found)
        return spans, found


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return [(s, e) for s, e in out]


def automata(bench: DataFrame, window: int = WINDOW, shard_words: int = SHARD_WORDS) -> DataFrame:
    """(shard, automaton): one pickled automaton per shard of the items, built in tasks; written once. Null texts have no words; items without an id are one item, UNNAMED."""
    items = bench.select(F.coalesce(F.col("item_id").cast("long"), F.lit(UNNAMED)).alias("item_id"), F.col("text").cast("string").alias("text")).where("text is not null")
    total = items.agg(F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("n")).first()["n"]
    shards = 1 + total // (2 * shard_words)  # a word has at least one letter and one separator

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        pairs = [(int(i), words_of(t.encode())) for i, t in zip(pdf["item_id"], pdf["text"])]
        return pd.DataFrame({"shard": [int(pdf["shard"].iloc[0])], "automaton": [pickle.dumps(vars(Automaton(pairs, window)))]})

    dealt = items.withColumn("shard", F.pmod(F.xxhash64("item_id", "text"), F.lit(shards)))
    return stage(dealt.groupBy("shard").applyInPandas(build, "shard long, automaton binary"))


def hits(docs: DataFrame, bench: DataFrame, window: int = WINDOW, shard_words: int = SHARD_WORDS, keep_text: bool = True) -> DataFrame:
    """All columns of `docs` as struct `doc`, with n_words, n_hit, spans (flat from, to word numbers, merged), items (sorted ids).

    Without `keep_text` the text inside `doc` comes back null.

    Columns of `docs` whose names clash with these are safe inside the struct. Null texts have no words. Repeated rows are
    scanned each for itself. Without items nothing is hit. Items without an id hit like others but are not named.

    The driver holds one automaton, of SHARD_WORDS words at most, and one is broadcast at a time: with several shards the result of each pass but
    the last is written before the next one is read.
    """
    spark = docs.sparkSession
    plain = docs.schema
    out = docs.select(F.struct("*").alias("doc"), F.lit(None).cast("array<long>").alias("spans"), F.lit(None).cast("array<long>").alias("items"), F.lit(0).cast("long").alias("n_words"), F.lit(0).cast("long").alias("n_hit"))
    machines = automata(bench, window, shard_words)
    shards = [r["shard"] for r in machines.select("shard").orderBy("shard").collect()] or [None]
    for k, shard in enumerate(shards):
        row = None if shard is None else machines.where(F.col("shard") == shard).first()
        held = spark.sparkContext.broadcast(bytes(row["automaton"]) if row else None)
        more = k + 1 < len(shards)
        out = _pass(out, held, plain.fieldNames().index("text"), keep_text or more)
        if more:
            out = stage(out)
            held.destroy()
    return out


def _pass(df: DataFrame, held, text_at: int, keep_text: bool) -> DataFrame:
    columns = ["doc", "spans", "items", "n_words", "n_hit"]
    schema = df.select(*columns).schema

    def run(batches):
        data = held.value
        machine = Automaton.loaded(data) if data else None
        for batch in batches:
            doc = batch.column(0)
            texts = utf8(doc.field(text_at).cast(pa.string()))
            spans, items, n_words, n_hit = batch.column(1).to_pylist(), batch.column(2).to_pylist(), [], []
            for k, text in enumerate(texts):
                words = words_of(text)
                n_words.append(len(words))
                got, found = machine.match(words) if machine else ([], set())
                known = spans[k] or []
                pairs = merged([*zip(known[::2], known[1::2]), *got])
                spans[k] = [x for pair in pairs for x in pair]
                n_hit.append(sum(e - s for s, e in pairs))
                items[k] = sorted({*(items[k] or []), *found} - {UNNAMED})
            if not keep_text:
                fields = [doc.field(i) for i in range(doc.type.num_fields)]
                fields[text_at] = pa.nulls(len(doc), fields[text_at].type)
                doc = pa.StructArray.from_arrays(fields, fields=list(doc.type))
            lists = pa.list_(pa.int64())
            rows = [doc, pa.array(spans, lists), pa.array(items, lists), pa.array(n_words, pa.int64()), pa.array(n_hit, pa.int64())]
            yield pa.RecordBatch.from_arrays(rows, names=columns)

    return df.select(*columns).mapInArrow(run, schema)


def without_spans(text: str, spans: list[int]) -> str:
    """The text without the words numbered in `spans`; what stands between two words of a span goes with them."""
    data = text.encode()
    solid = np.frombuffer(data.translate(LETTERS), dtype=np.uint8) != 32
    edge = np.diff(np.concatenate([[False], solid, [False]]).astype(np.int8))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    kept, at = [], 0
    for s, e in zip(spans[::2], spans[1::2]):
        kept.append(data[at : starts[s]])
        at = ends[e - 1]
    return b"".join([*kept, data[at:]]).decode()


def decontaminate(docs: DataFrame, bench: DataFrame, max_coverage: float = MAX_COVERAGE, max_stretch: int = MAX_STRETCH) -> DataFrame:
    """The columns of `docs`. Hit stretches are cut out of the text; documents hit beyond the limits go. Others stay as they are."""
    found = hits(docs, bench)
    longest = F.array_max(F.transform(F.sequence(F.lit(1), F.size("spans"), F.lit(2)), lambda i: F.get("spans", i) - F.get("spans", i - 1)))
    gone = (F.col("n_hit") > 0) & ((F.col("n_hit") > max_coverage * F.col("n_words")) | (longest > max_stretch))
    kept = found.where(~gone)
    schema = kept.select("doc").schema
    text_at = docs.columns.index("text")
    count_at = docs.columns.index("n_chars") if "n_chars" in docs.columns else None

    def run(batches):
        for batch in batches:
            doc, spans = batch.column(0), batch.column(1).to_pylist()
            if any(spans):
                fields = [doc.field(i) for i in range(doc.type.num_fields)]
                texts = fields[text_at].to_pylist()
                for k, s in enumerate(spans):
                    if s:
                        texts[k] = without_spans(texts[k], s)
                fields[text_at] = pa.array(texts, fields[text_at].type)
                if count_at is not None:
                    counts = fields[count_at].to_pylist()
                    fields[count_at] = pa.array([len(t) if s else n for t, s, n in zip(texts, spans, counts)], fields[count_at].type)
                doc = pa.StructArray.from_arrays(fields, fields=list(doc.type))
            yield pa.RecordBatch.from_arrays([doc], names=["doc"])

    return kept.select("doc", "spans").mapInArrow(run, schema).select("doc.*")


def op9(docs: DataFrame, bench: DataFrame) -> DataFrame:
    found = hits(docs.select("doc_id", "text"), bench, keep_text=False)
    names = F.array_join(F.array_sort(F.transform("items", lambda i: i.cast("string"))), ",")
    return found.select(
        F.col("doc.doc_id").cast("long").alias("doc_id"), "n_words", F.col("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(names, 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )
