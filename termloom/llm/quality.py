"""Document quality: supervised subword embeddings. A document is the mean of learned vectors of its hashed words and character
n-grams; a softmax over two outputs gives its score. Trained by numpy stochastic gradient descent on a bounded sample of labels.

A word's features are the word, the character n-grams of the word between marks, and, if it repeats the word before it, one
mark that stands for a word pair of equal words. The score is linear in the mean vector, so after training every bucket's
vector folds into one number (the difference of the two outputs), and a document needs one sum over its words.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termloom.llm.common import arrow_map, stage, utf8

BUCKETS = 1 << 17
DIMENSIONS = 8
NGRAMS = (3, 4)
# labelled rows the model is fitted on, at most: those with the smallest hash of their doc_id
SAMPLE = 4000
EPOCHS = 8
RATE = 0.5
SEED = 11
THRESHOLD = 0.3
# words whose features a worker remembers
REMEMBERED = 400_000
REPEAT = b"\x00repeat"
# longer words (texts without blanks, encoded data) are hashed in blocks of so many bytes and not remembered
SHORT = 128
BLOCK = 1 << 16
# table of CRC-32, for the n-grams of a block at once
CRC = np.arange(256, dtype=np.uint32)
for _ in range(8):
    CRC = np.where(CRC & 1, (CRC >> 1) ^ np.uint32(0xEDB88320), CRC >> 1)


def long_buckets(word: bytes) -> Iterator[np.ndarray]:
    """What buckets_of() gives, in blocks."""
    yield np.array([zlib.crc32(word, SEED) % BUCKETS])
    marked = np.frombuffer(b"<" + word + b">", dtype=np.uint8)
    for n in NGRAMS:
        count = len(marked) - n + 1
        for start in range(0, count, BLOCK):
            stop = min(count, start + BLOCK)
            crc = np.full(stop - start, n ^ 0xFFFFFFFF, dtype=np.uint32)
            for i in range(n):
                crc = CRC[(crc ^ marked[start + i : stop + i]) & 255] ^ (crc >> 8)
            yield ((crc ^ np.uint32(0xFFFFFFFF)) % BUCKETS).astype(np.int64)


def buckets_of(word: bytes) -> list[int]:
    """Bucket of the word, then of all its character n-grams (over bytes)."""
    marked = b"<" + word + b">"
    out = [zlib.crc32(word, SEED) % BUCKETS]
    for n in NGRAMS:
        out += [zlib.crc32(marked[i : i + n], n) % BUCKETS for i in range(len(marked) - n + 1)]
    return out


REPEAT_BUCKETS = buckets_of(REPEAT)[:1] * 8


def features(text: bytes | None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct buckets of a whole text and their counts."""
    counts: dict[bytes, int] = {}
    before = None
    for w in (text or b"").split():
        counts[w] = counts.get(w, 0) + 1
        if w == before:
            counts[REPEAT] = counts.get(REPEAT, 0) + 1
        before = w
    ids, times = [], []
    dense, pending, waiting = None, [], 0
    for w, n in counts.items():
        if len(w) > SHORT:
            dense = np.zeros(BUCKETS) if dense is None else dense
            for block in long_buckets(w):
                pending.append((block, n))
                waiting += len(block)
                if waiting >= BLOCK:
                    dense += _summed(pending)
                    pending, waiting = [], 0
            continue
        found = REPEAT_BUCKETS if w is REPEAT else buckets_of(w)
        ids += found
        times += [n] * len(found)
    if dense is not None:
        dense += _summed([*pending, (np.array(ids, dtype=np.int64), np.array(times, dtype=float))])
        bucket = np.flatnonzero(dense)
        return bucket.astype(np.int32), dense[bucket].astype(np.float32)
    if not ids:
        return np.zeros(0, dtype=np.int32), np.zeros(0, dtype=np.float32)
    bucket, where = np.unique(np.array(ids), return_inverse=True)
    return bucket.astype(np.int32), np.bincount(where, weights=times).astype(np.float32)


def _summed(found: list[tuple[np.ndarray, float | np.ndarray]]) -> np.ndarray:
    """Counts of all buckets, from arrays of buckets and how often each array (or each of its entries) counts."""
    times = [np.broadcast_to(n, block.shape) for block, n in found]
    return np.bincount(np.concatenate([block for block, _ in found]), weights=np.concatenate(times), minlength=BUCKETS)


def train(rows: list[tuple[np.ndarray, np.ndarray, int]], epochs: int = EPOCHS, rate: float = RATE) -> tuple[np.ndarray, float]:
    """(weight of each bucket, bias) of the score's logit."""
    rng = np.random.default_rng(SEED)
    vectors = ((rng.random((BUCKETS, DIMENSIONS)) - 0.5) / DIMENSIONS).astype(np.float32)
    output, bias = np.zeros((2, DIMENSIONS), dtype=np.float32), np.zeros(2, dtype=np.float32)
    total = max(1, epochs * len(rows))
    for k in range(epochs):
        for j, i in enumerate(rng.permutation(len(rows))):
            ids, counts, label = rows[i]
            step = rate * (1 - (k * len(rows) + j) / total)
            share = counts / max(1.0, counts.sum())
            mean = share @ vectors[ids]
            logit = output @ mean + bias
            p = np.exp(logit - logit.max())
            error = p / p.sum()
            error[label] -= 1
            back = error @ output
            output -= step * np.outer(error, mean)
            bias -= 0.1 * step * error
            vectors[ids] -= step * len(ids) ** 0.5 * share[:, None] * back
    return vectors @ (output[1] - output[0]), float(bias[1] - bias[0])


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, held_out: bool = True) -> tuple[np.ndarray, float]:
    """The folded model (BUCKETS floats and a bias). Labels: rows with quality 0 or 1 whose crc32(doc_id as text) mod 5 is not 0.

    The sample is the `sample` labelled rows of smallest hash; its features are counted in tasks and fitted in one task.
    A label whose document is missing is skipped; without any label the model is neutral (0.5 for each text).
    """
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).where("doc_id is not null and quality in (0, 1)")
    if held_out:
        known = known.where(F.crc32(F.col("doc_id").cast("string")) % 5 != 0)
    picked = stage(known.orderBy(F.xxhash64("doc_id"), "doc_id", "quality").limit(sample))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    chosen = texts.join(F.broadcast(picked), "doc_id").select("doc_id", "text", "quality", F.xxhash64("text").alias("text_hash"))  # at most `sample` rows of two numbers

    def count(batch: pa.RecordBatch) -> dict:
        got = [features(t) for t in utf8(batch.column(1))]
        return {"doc_id": batch.column(0), "quality": batch.column(2), "text_hash": batch.column(3), "ids": [i.tolist() for i, _ in got], "counts": [c.tolist() for _, c in got]}

    counted = arrow_map(chosen, {"doc_id": "long", "quality": "int", "text_hash": "long", "ids": "array<int>", "counts": "array<float>"}, count)
    # one text per label, also where documents repeat a doc_id
    counted = counted.groupBy("doc_id", "quality").agg(F.min(F.struct("text_hash", "ids", "counts")).alias("one")).select("doc_id", "quality", "one.ids", "one.counts")

    def learn(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.assign(n=pdf["ids"].map(len)).sort_values(["doc_id", "quality", "n"], kind="stable")
        rows = [(np.asarray(i, dtype=np.int32), np.asarray(c, dtype=np.float32), int(q)) for i, c, q in zip(pdf["ids"], pdf["counts"], pdf["quality"])]
        weights, bias = train(rows)
        return pd.DataFrame({"weights": [weights.astype("<f4").tobytes()], "bias": [bias]})

    model = counted.withColumn("every", F.lit(0)).groupBy("every").applyInPandas(learn, "weights binary, bias double").collect()
    if not model:
        return np.zeros(BUCKETS, dtype=np.float32), 0.0
    return np.frombuffer(bytes(model[0]["weights"]), dtype="<f4"), model[0]["bias"]


class Scorer:
    """Score of whole texts; remembers the sums of the short words it has met."""

    def __init__(self, weights: np.ndarray, bias: float):
        self.weights, self.bias, self.seen = weights.astype(float).tolist(), bias, {}
        self.dense = weights.astype(float)

    def word(self, w: bytes) -> tuple[float, int]:
        if len(w) > SHORT:
            total, n = 0.0, 0
            for block in long_buckets(w):
                total += float(self.dense[block].sum())
                n += len(block)
            return total, n
        if len(self.seen) >= REMEMBERED:
            self.seen.clear()
        ids = buckets_of(w)
        weights = self.weights
        got = self.seen[w] = (sum([weights[i] for i in ids]), len(ids))
        return got

    def score(self, text: bytes | None) -> float:
        total, n, before, repeats = 0.0, 0, None, 0
        seen, word = self.seen.get, self.word
        for w in (text or b"").split():
            s, k = seen(w) or word(w)
            total += s
            n += k
            if w == before:
                repeats += 1
            before = w
        if repeats:
            total += repeats * sum(self.weights[i] for i in REPEAT_BUCKETS)
            n += repeats * len(REPEAT_BUCKETS)
        logit = self.bias + (total / n if n else 0.0)
        return 1 / (1 + np.exp(-logit)) if logit > -700 else 0.0


def scored(docs: DataFrame, model: tuple[np.ndarray, float], column: str = "score") -> DataFrame:
    """`docs` with the score; null and empty texts get the score of the bias alone. Existing columns keep their values."""
    held = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS floats
    schema = docs.select(F.struct("*").alias("doc"), F.lit(0.0).alias(column)).schema
    at = docs.columns.index("text")

    def run(batches):
        scorer = Scorer(*held.value)
        for batch in batches:
            texts = utf8(batch.column(0).field(at).cast(pa.string()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([scorer.score(t) for t in texts], pa.float64())], names=["doc", column])

    return docs.select(F.struct("*").alias("doc")).mapInArrow(run, schema)


def classify(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of `docs`, unchanged, that the classifier accepts."""
    return scored(docs, fit(docs, labels)).where(F.col("score") >= threshold).select("doc.*")


def op10(docs: DataFrame, labels: DataFrame) -> DataFrame:
    model = fit(docs, labels)
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        scorer = Scorer(*held.value)
        for batch in batches:
            scores = [scorer.score(t) for t in utf8(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], names=["doc_id", "score"])

    got = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, score double")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))
    return got.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
