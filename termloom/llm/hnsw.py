"""Nearest neighbours by inner product: one hierarchical navigable small-world graph per shard, results merged over shards.

Equal vectors are one node. Nodes are dealt to shards of about SHARD_ROWS by hash. A shard's graph is one row: ids, vectors and the
neighbour lists of all layers as flat arrays. Layer l holds the first n / 16^l nodes of a hash order. Graphs are built from the
top: nodes go in by batches, each batch searches the layer as it stands, takes a diverse set of near nodes, and its nodes are
offered to those in turn. Inner product becomes an angle by one more coordinate that gives all vectors of a shard equal norms.
Each query visits each shard; the candidates are scored again in double precision on the original vectors.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from termloom.llm.common import stage

NEAREST = 20
EVERY = 20
SHARD_ROWS = 4096
DEGREE = 32
BUILD_WIDTH = 64
SEARCH_WIDTH = 96
SHRINK = 16
BATCH = 512
# queries that visit a shard's graph in one task; more queries mean more tasks, each with a copy of the graph
QUERY_BLOCK = 1 << 15
# fan-ins of the tree that keeps the smallest ids of a group of equal vectors
FAN = (64, 8, 1)


def lifted(x: np.ndarray, norm: float | None = None) -> np.ndarray:
    """Vectors with a last coordinate that brings all to the greatest norm."""
    x = x.astype(np.float32)
    square = (x.astype(np.float64) ** 2).sum(axis=1)
    rest = np.sqrt(np.maximum((square.max() if norm is None else norm) - square, 0)).astype(np.float32)
    return np.column_stack([x, rest])


def search_layer(x: np.ndarray, lists: np.ndarray, q: np.ndarray, entries: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Best `width` nodes per query of `q`, best first (-1: none), with similarities; all queries advance in step.

    x: nodes; lists: neighbours per node, -1 padded; entries: start nodes per query, distinct in a row, -1 padded.
    """
    n, b = len(lists), len(q)
    rows = np.arange(b)[:, None]
    seen = np.zeros((b, n + 1), dtype=bool)  # the last column takes the padding
    seen[:, n] = True
    at = entries[:, :width]
    sims = np.where(at >= 0, np.einsum("bmd,bd->bm", x[at], q), -np.inf).astype(np.float32)
    seen[rows, np.where(at >= 0, at, n)] = True
    pad = width - at.shape[1]
    ids = np.pad(at, ((0, 0), (0, pad)), constant_values=-1)
    sims = np.pad(sims, ((0, 0), (0, pad)), constant_values=-np.inf)
    done = ids < 0
    live = np.arange(b)
    while len(live):
        open_ = np.where(done[live], -np.inf, sims[live])
        pick = open_.argmax(axis=1)
        going = open_[np.arange(len(live)), pick] > -np.inf
        live, pick = live[going], pick[going]
        if not len(live):
            break
        done[live, pick] = True
        near = lists[ids[live, pick]]
        near = np.where(near < 0, n, near)
        fresh = ~seen[live[:, None], near]
        seen[live[:, None], near] = True
        near = np.where(fresh, near, -1)
        got = np.where(fresh, np.matmul(x[near], q[live][:, :, None])[:, :, 0], -np.inf).astype(np.float32)
        all_ids = np.concatenate([ids[live], near], axis=1)
        all_sims = np.concatenate([sims[live], got], axis=1)
        all_done = np.concatenate([done[live], ~fresh], axis=1)
        top = np.argpartition(-all_sims, width - 1, axis=1)[:, :width]
        ids[live], sims[live], done[live] = (np.take_along_axis(v, top, axis=1) for v in (all_ids, all_sims, all_done))
    order = np.argsort(-sims, axis=1, kind="stable")
    return np.where(np.isinf(np.take_along_axis(sims, order, axis=1)), -1, np.take_along_axis(ids, order, axis=1)), np.take_along_axis(sims, order, axis=1)


def diverse(x: np.ndarray, owner: np.ndarray, candidates: np.ndarray, degree: int) -> np.ndarray:
    """Per owner up to `degree` of its candidates (-1 padded, distinct): near ones that no chosen one is nearer to, then the nearest rest."""
    v = x[candidates]
    near = np.where(candidates >= 0, np.einsum("bmd,bd->bm", v, x[owner]), -np.inf)
    order = np.argsort(-near, axis=1, kind="stable")
    candidates, near = np.take_along_axis(candidates, order, axis=1), np.take_along_axis(near, order, axis=1)
    v = x[candidates]
    between = np.matmul(v, v.transpose(0, 2, 1))
    b, c = candidates.shape
    chosen = np.zeros((b, c), dtype=bool)
    for j in range(c):
        beaten = (chosen & (between[:, j, :] > near[:, j][:, None])).any(axis=1)
        chosen[:, j] = (candidates[:, j] >= 0) & ~beaten & (chosen.sum(axis=1) < degree)
    rank = np.argsort(np.where(candidates < 0, 2, np.where(chosen, 0, 1)), axis=1, kind="stable")[:, :degree]
    out = np.take_along_axis(candidates, rank, axis=1)
    return np.pad(out, ((0, 0), (0, max(0, degree - c))), constant_values=-1)


def build_layer(x: np.ndarray, n: int, start: int, enter, degree: int, width: int) -> np.ndarray:
    """Neighbour lists of the layer of nodes 0..n-1. The first `start` nodes are joined by comparing all of them."""
    lists = np.full((n, degree), -1, dtype=np.int32)
    start = min(n, max(start, 2 * degree))
    first = np.arange(start)
    sims = x[:start] @ x[:start].T
    np.fill_diagonal(sims, -np.inf)
    wide = np.argsort(-sims, axis=1, kind="stable")[:, : min(width, start - 1)]
    if wide.shape[1]:
        lists[:start] = diverse(x, first, wide.astype(np.int64), degree)
    at = start
    while at < n:
        batch = np.arange(at, min(n, at + min(BATCH, max(degree, at))))
        entries = enter(x[batch])
        found, _ = search_layer(x, lists[:at], x[batch], entries, width)
        among = x[batch] @ x[batch].T
        np.fill_diagonal(among, -np.inf)
        k = min(degree // 2, len(batch) - 1)
        if k > 0:
            found = np.concatenate([found, batch[np.argpartition(-among, k - 1, axis=1)[:, :k]]], axis=1)
        mine = diverse(x, batch, found, degree)
        lists[batch] = mine
        # offer the new nodes to the nodes they chose
        source = np.repeat(batch, degree)
        target = mine.ravel().astype(np.int64)
        source, target = source[target >= 0], target[target >= 0]
        order = np.lexsort((-np.einsum("ij,ij->i", x[source], x[target]), target))
        source, target = source[order], target[order]
        hosts, begin, count = np.unique(target, return_index=True, return_counts=True)
        place = np.arange(len(target)) - np.repeat(begin, count)
        fits = place < width
        offered = np.full((len(hosts), min(width, int(count.max()))), -1, dtype=np.int64)
        offered[np.repeat(np.arange(len(hosts)), count)[fits], place[fits]] = source[fits]
        held = lists[hosts].astype(np.int64)
        offered[(offered[:, :, None] == held[:, None, :]).any(axis=2)] = -1
        for s in range(0, len(hosts), BATCH):
            lists[hosts[s : s + BATCH]] = diverse(x, hosts[s : s + BATCH], np.concatenate([held[s : s + BATCH], offered[s : s + BATCH]], axis=1), degree)
        at = batch[-1] + 1
    return lists


class Graph:
    """Layers of neighbour lists over the rows of `x`, in hash order: layer l covers the first sizes[l] rows."""

    def __init__(self, x: np.ndarray, layers: list[np.ndarray]):
        self.x, self.layers = x, layers

    @classmethod
    def build(cls, x: np.ndarray) -> Graph:
        x = lifted(x)
        sizes = [len(x)]
        while sizes[-1] > 2 * SHRINK:
            sizes.append(-(-sizes[-1] // SHRINK))
        graph = cls(x, [])
        for level in range(len(sizes) - 1, -1, -1):
            above = sizes[level + 1] if level + 1 < len(sizes) else 0
            degree = DEGREE if level == 0 else DEGREE // 2
            graph.layers.insert(0, build_layer(x, sizes[level], above, graph.enter, degree, BUILD_WIDTH))
        return graph

    def enter(self, q: np.ndarray) -> np.ndarray:
        """Start nodes for the layer below those present: the best found in each, from the top."""
        if not self.layers:
            return np.zeros((len(q), 1), dtype=np.int64)
        at = np.tile(np.arange(min(len(self.layers[-1]), SHRINK)), (len(q), 1))
        for lists in reversed(self.layers):
            at, _ = search_layer(self.x, lists, q, at, 8)
        return at

    def search(self, q: np.ndarray, width: int = SEARCH_WIDTH) -> np.ndarray:
        q = np.column_stack([q.astype(np.float32), np.zeros(len(q), dtype=np.float32)])
        out = []
        for s in range(0, len(q), BATCH):
            part = q[s : s + BATCH]
            at = np.tile(np.arange(min(len(self.layers[-1]), SHRINK)), (len(part), 1))
            for lists in self.layers[:0:-1]:
                at, _ = search_layer(self.x, lists, part, at, 8)
            out.append(search_layer(self.x, self.layers[0], part, at, width)[0])
        return np.concatenate(out) if out else np.zeros((0, width), dtype=np.int64)


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, v, dim): rows whose vector is not null or zero and holds only finite numbers."""
    v = F.col("embedding").cast("array<double>")
    whole = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v"), whole.alias("whole")).where("vec_id is not null and whole and exists(v, x -> x <> 0)").select("vec_id", "v", F.size("v").alias("dim"))


def build_index(distinct: DataFrame, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """(dim, shard, ids, vectors, lists, sizes): one row per shard of the vectors `distinct` (rep, v, dim)."""
    shards = max(1, -(-distinct.count() // shard_rows))

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["order", "rep"], kind="stable")
        x = np.stack(pdf["v"].to_numpy())
        graph = Graph.build(x)
        flat = np.concatenate([a.ravel() for a in graph.layers]).astype("<i4")
        row = {"dim": int(pdf["dim"].iloc[0]), "shard": int(pdf["shard"].iloc[0]), "ids": pdf["rep"].tolist(), "vectors": x.astype("<f8").tobytes()}
        return pd.DataFrame([{**row, "lists": flat.tobytes(), "sizes": [len(a) for a in graph.layers]}])

    dealt = distinct.withColumn("shard", F.pmod(F.xxhash64(F.lit(3), "rep"), F.lit(shards)).cast("int")).withColumn("order", F.xxhash64(F.lit(5), "rep"))
    return stage(dealt.groupBy("dim", "shard").applyInPandas(build, "dim int, shard int, ids array<long>, vectors binary, lists binary, sizes array<int>"))


def search(index: DataFrame, queries: DataFrame, k: int, width: int = SEARCH_WIDTH, query_block: int = QUERY_BLOCK) -> DataFrame:
    """(query, query_id, rep, score): per query row (query, query_id, v, dim) the k nearest found in each shard.

    Queries are dealt to blocks of about `query_block` by hash; a task holds one shard's graph and one block.
    """
    blocks = max(1, -(-queries.count() // query_block))
    shards = index.select(F.col("dim").alias("of_dim"), F.col("shard").alias("at"))
    dealt = queries.withColumn("block_q", F.pmod(F.xxhash64(F.lit(9), "query"), F.lit(blocks)).cast("int"))
    asked = dealt.join(shards, F.expr("dim = of_dim")).select("query", "query_id", "v", F.col("of_dim").alias("dim_q"), F.col("at").alias("shard_q"), "block_q")
    copied = index.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))

    def run(graphs: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        if not len(graphs) or not len(asked):
            return pd.DataFrame({"query": [], "query_id": [], "rep": [], "score": []}).astype({"query": "int64", "query_id": "int64", "rep": "int64", "score": "float64"})
        row = graphs.iloc[0]
        ids, dim = np.asarray(row["ids"], dtype=np.int64), int(row["dim"])
        x = np.frombuffer(row["vectors"], dtype="<f8").reshape(-1, dim)
        flat, layers, at = np.frombuffer(row["lists"], dtype="<i4"), [], 0
        for level, n in enumerate(row["sizes"]):
            degree = DEGREE if level == 0 else DEGREE // 2
            layers.append(flat[at : at + n * degree].reshape(n, degree))
            at += n * degree
        q = np.stack(asked["v"].to_numpy())
        found = Graph(lifted(x), layers).search(q, max(width, 2 * k))
        score = np.where(found >= 0, np.einsum("bmd,bd->bm", x[found], q), -np.inf)
        order = np.lexsort((ids[found], -score), axis=1)[:, :k]
        found, score = np.take_along_axis(found, order, axis=1), np.take_along_axis(score, order, axis=1)
        ok = np.isfinite(score)
        rep = np.repeat(np.arange(len(q)), found.shape[1]).reshape(found.shape)[ok]
        return pd.DataFrame({"query": asked["query"].to_numpy()[rep], "query_id": asked["query_id"].to_numpy()[rep], "rep": ids[found[ok]], "score": score[ok]})

    grouped = copied.groupBy("dim", "shard", "block").cogroup(asked.groupBy("dim_q", "shard_q", "block_q"))
    return grouped.applyInPandas(run, "query long, query_id long, rep long, score double")


def smallest_copies(clean: DataFrame, groups: DataFrame, k: int) -> DataFrame:
    """(rep, copy): of vectors that occur more than once, the k smallest ids; a tree of limits, so no task sees a whole group."""
    several = groups.where("n > 1").select(F.col("key").alias("k1"), F.col("rep"))
    out = clean.join(several, F.expr("key = k1")).select("rep", F.col("vec_id").alias("copy")).distinct()
    for salts in FAN:
        part = Window.partitionBy("rep", "salt").orderBy("copy")
        out = out.withColumn("salt", F.pmod(F.xxhash64("copy"), F.lit(salts))).withColumn("place", F.row_number().over(part)).where(F.col("place") <= k).select("rep", "copy")
    return out


def nearest(vectors: DataFrame, k: int = NEAREST, every: int = EVERY) -> DataFrame:
    """(query_id, rank, vec_id, score) of the queries (vec_id divisible by `every`), nearest first, ties to the smaller vec_id.

    Rows without a usable vector or id take no part; rows of other dimensions are never compared. Equal rows are one;
    an id with several vectors is a query and a candidate with each of them. Empty tables give no rows.
    """
    clean = stage(usable(vectors).withColumn("key", F.unhex(F.md5(F.array_join(F.transform("v", lambda x: (x + F.lit(0.0)).cast("string")), ",")))))
    groups = stage(clean.groupBy("key", "dim").agg(F.min("vec_id").alias("rep"), F.count("*").alias("n")))
    # ids that repeat with other vectors would share a node id: nodes are numbered by the hash of their key
    node = F.xxhash64("key")
    firsts = groups.select(F.col("key").alias("k1"), F.col("rep").alias("r1"))
    distinct = stage(clean.join(firsts, F.expr("key = k1 and vec_id = r1")).select(node.alias("rep"), "v", "dim").dropDuplicates(["rep"]))
    queries = clean.where(F.col("vec_id") % every == 0).select(F.xxhash64("vec_id", "key").alias("query"), F.col("vec_id").alias("query_id"), "v", "dim").dropDuplicates(["query"])
    found = search(build_index(distinct), queries, k + 1)
    numbered = groups.withColumn("node", node)
    copies = smallest_copies(clean, numbered.select("key", F.col("node").alias("rep"), "n"), k + 1)
    single = numbered.where("n = 1").select(F.col("node").alias("rep"), F.col("rep").alias("copy"))
    every_copy = single.unionByName(copies)
    spread = found.join(every_copy, "rep").where("copy <> query_id")
    order = Window.partitionBy("query").orderBy(F.col("score").desc(), "copy")
    ranked = spread.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), F.col("copy").alias("vec_id"), "score")


def op3(vectors: DataFrame) -> DataFrame:
    return nearest(vectors)
