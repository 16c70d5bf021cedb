"""Compression of vectors to short codes: one codebook per part, nearest entries found by slice-and-intersect bitmasks.

A vector's components become integers floor(scale * x), cut into equal consecutive parts. Each part has a codebook of at most 64
entries. To find a part's nearest entry, the entries' coordinates are sorted in every dimension, with a mask of the first 0, 1, 2, ...
entries of that order. The distance to one entry gives a radius that the nearest entry cannot exceed; in every dimension the radius
selects a range of the sorted coordinates, whose entries are the difference of two prefix masks. The AND of these masks over all
dimensions holds every entry that can be nearest, and only those are measured.

Codebooks are learned in rounds over all rows. A task adds up its rows per entry and returns one row per (part, entry, position);
Spark adds these up, and only the new codebooks, whose size does not depend on the table, reach the driver.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PARTS = 8
ENTRIES = 16
ROUNDS = 6
SCALE = 4096
# finite components beyond this many units count as this many, so that sums of all rows fit 38 digits
LIMIT = 1e27
LONGEST = (1 << 63) - 1


def usable(column: str = "embedding") -> Column:
    """Whether a vector is neither null nor empty and holds numbers only."""
    c = F.col(column)
    finite = F.forall(c, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))), F.lit(False)))
    return F.coalesce((F.size(c) > 0) & finite, F.lit(False))


def whole(values: np.ndarray, scale: int = SCALE, parts: int = PARTS) -> np.ndarray:
    """floor(scale * x) as 64-bit integers, or as Python's where squares of differences could exceed these."""
    with np.errstate(over="ignore"):
        scaled = np.clip(np.floor(values.astype(np.float64) * scale), -LIMIT, LIMIT)
    widest = float(np.abs(scaled).max(initial=0.0))
    if values.shape[1] * 4.0 * widest * widest < 2.0**61:
        return scaled.astype(np.int64)
    return np.array([[int(x) for x in row] for row in scaled.tolist()], dtype=object).reshape(scaled.shape)


class Codebook:
    """The entries of one part with, per dimension, their sorted coordinates and prefix masks."""

    def __init__(self, entries: np.ndarray):
        self.entries = entries
        n, self.dims = entries.shape
        self.sorted, self.masks = [], []
        for d in range(self.dims):
            order = np.argsort(entries[:, d], kind="stable")
            masks = np.zeros(n + 1, dtype=np.uint64)
            for k, entry in enumerate(order.tolist()):
                masks[k + 1] = masks[k] | np.uint64(1 << entry)
            self.sorted.append(entries[order, d])
            self.masks.append(masks)
        spread = [s[-1] - s[0] for s in self.sorted]
        self.widest = spread.index(max(spread)) if spread else 0
        self.order = np.argsort(entries[:, self.widest], kind="stable") if self.dims else np.zeros(n, dtype=np.int64)

    def distance(self, rows: np.ndarray, entry) -> np.ndarray:
        gap = rows - self.entries[entry]
        return (gap * gap).sum(axis=1)

    def candidates(self, rows: np.ndarray) -> np.ndarray:
        """For each row a mask of entries that includes each nearest one."""
        every = np.uint64((1 << len(self.entries)) - 1)
        found = np.full(len(rows), every, dtype=np.uint64)
        if not self.dims:
            return found
        # an entry close by in the widest dimension
        at = np.minimum(np.searchsorted(self.sorted[self.widest], rows[:, self.widest]), len(self.entries) - 1)
        bound = self.distance(rows, self.order[at])
        if rows.dtype == object:
            radius = np.array([math.isqrt(b) + 1 for b in bound.tolist()], dtype=object)
        else:
            radius = np.sqrt(bound.astype(np.float64)).astype(np.int64) + 1
        for d in range(self.dims):
            low = np.searchsorted(self.sorted[d], rows[:, d] - radius, side="left")
            high = np.searchsorted(self.sorted[d], rows[:, d] + radius, side="right")
            found &= self.masks[d][high] & ~self.masks[d][low]
        return found

    def nearest(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index, squared distance) of each row's nearest entry; ties go to the lower index."""
        found = self.candidates(rows)
        best = np.full(len(rows), -1, dtype=np.int64)
        least = np.zeros(len(rows), dtype=rows.dtype)
        for k in range(len(self.entries)):
            at = np.flatnonzero(found >> np.uint64(k) & np.uint64(1))
            if not len(at):
                continue
            gap = self.distance(rows[at], k)
            better = (best[at] < 0) | (gap < least[at])
            best[at[better]] = k
            least[at[better]] = gap[better]
        return best, least


def cut(dims: int, parts: int) -> list[tuple[int, int]]:
    return [(p * dims // parts, (p + 1) * dims // parts) for p in range(parts)]


def split(rows: np.ndarray, books: list[Codebook]) -> list[np.ndarray]:
    return [rows[:, a:b] for a, b in cut(rows.shape[1], len(books))]


def matrix(column: pa.Array, dims: int) -> np.ndarray:
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False), dtype=np.float64).reshape(-1, dims)


def kept(vectors: DataFrame) -> DataFrame:
    """(vec_id, label, embedding) of usable vectors."""
    label = F.col("label") if "label" in vectors.columns else F.lit(None).cast("int")
    return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), label.alias("label"), "embedding").where(usable())


def books_of(entries: np.ndarray, parts: int) -> list[Codebook]:
    return [Codebook(entries[:, a:b]) for a, b in cut(entries.shape[1], parts)]


def sums(rows: DataFrame, books: list[Codebook], dims: int, scale: int) -> DataFrame:
    """(part, entry, position, total, n): per task, what a round adds up."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = [np.zeros(b.entries.shape, dtype=object) for b in books]
        count = [np.zeros(len(b.entries), dtype=np.int64) for b in books]
        for batch in batches:
            for p, part in enumerate(split(whole(matrix(batch.column(0), dims), scale), books)):
                index, _ = books[p].nearest(part)
                for k in np.unique(index).tolist():
                    total[p][k] += part[index == k].sum(axis=0).astype(object)
                count[p] += np.bincount(index, minlength=len(count[p]))
        out = [(p, k, d, str(total[p][k, d]), int(count[p][k])) for p, b in enumerate(books) for k in np.flatnonzero(count[p]).tolist() for d in range(b.dims)]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(zip(*out), (pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.int64()))], names=["part", "entry", "position", "total", "n"])

    got = rows.select("embedding").mapInArrow(run, "part int, entry int, position int, total string, n long")
    return got.groupBy("part", "entry", "position").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total"), F.sum("n").alias("n"))


def learn(rows: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> list[Codebook] | None:
    """Codebooks of the usable vectors `rows` (vec_id, label, embedding). Every round reads all rows; None if there is no row.

    They start as the rows of smallest vec_id (nulls last, then by vector), as many as there are if fewer than `entries`.
    """
    assert 1 <= entries <= 64
    first = rows.orderBy(F.col("vec_id").asc_nulls_last(), "embedding").select("embedding").limit(entries).collect()
    if not first:
        return None
    dims = len(first[0][0])
    start = whole(np.array([r[0] for r in first if len(r[0]) == dims], dtype=np.float64), scale)
    books = books_of(start, parts)
    rows = rows.where(F.size("embedding") == dims)
    for _ in range(rounds):
        moved = [b.entries.astype(object) for b in books]
        for r in sums(rows, books, dims, scale).collect():  # parts x entries x positions at most
            moved[r["part"]][r["entry"], r["position"]] = int(r["total"]) // r["n"]
        joined = np.concatenate(moved, axis=1)
        wide = max((abs(x) for x in joined.ravel().tolist()), default=0)
        books = books_of(joined.astype(np.int64) if dims * 4 * wide * wide < 1 << 61 else joined, parts)
    return books


def encode(rows: DataFrame, books: list[Codebook], scale: int = SCALE) -> DataFrame:
    """(vec_id, label, codes, error): the nearest entry's index of each part, and the squared distances added up."""
    dims = sum(b.dims for b in books)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [b.nearest(part) for b, part in zip(books, split(whole(matrix(batch.column(2), dims), scale), books))]
            codes = np.stack([index for index, _ in got], axis=1).astype(np.int32)
            error = [min(int(e), LONGEST) for e in sum(least.astype(object) for _, least in got).tolist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(codes.tolist(), type=pa.list_(pa.int32())), pa.array(error, type=pa.int64())], names=["vec_id", "label", "codes", "error"])

    kind = rows.schema["label"].dataType.simpleString()
    return rows.where(F.size("embedding") == dims).mapInArrow(run, f"vec_id long, label {kind}, codes array<int>, error long")


def decode(codes: DataFrame, books: list[Codebook], scale: int = SCALE) -> DataFrame:
    """`codes` (codes, ...) with `embedding`, the vector that the entries stand for."""
    tables = [F.array(*[F.array(*[F.lit(int(x) / scale) for x in row]) for row in b.entries.tolist()]) for b in books]
    return codes.withColumn("embedding", F.concat(*[t[F.col("codes")[p]] for p, t in enumerate(tables)]))


def op12(vectors: DataFrame) -> DataFrame:
    """One row per usable vector: vec_id, code, error, label_error, codebooks_sha256.

    Vectors that are null, empty or hold null or non-finite components are dropped, as are those of another length than the one of
    smallest vec_id, as no codebook fits them; a length that 8 does not divide is cut as evenly as it can be. Rows
    that repeat come back as often. Null vec_ids stay and order last; without a column `label` all labels are null. Sums beyond 64 bits
    count as the largest long. An empty table gives no rows; further columns are ignored.
    """
    rows = kept(vectors)
    books = learn(rows)
    if books is None:
        return rows.selectExpr("vec_id", "'' as code", "0L as error", "0L as label_error", "'' as codebooks_sha256").where(F.lit(False))
    coded = encode(rows, books)
    listed = ",".join(str(x) for b in books for row in b.entries.tolist() for x in row)
    total = F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit(LONGEST).cast("decimal(38,0)")).cast("long")
    labels = coded.groupBy(F.col("label").alias("of")).agg(total.alias("label_error"))
    code = F.array_join(F.transform("codes", lambda c: F.lower(F.lpad(F.hex(c), 2, "0"))), "")
    joined = coded.join(labels, F.expr("label <=> of"))
    return joined.select("vec_id", code.alias("code"), "error", "label_error", F.sha2(F.lit(listed), 256).alias("codebooks_sha256"))
