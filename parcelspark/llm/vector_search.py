"""Approximate nearest neighbours by largest inner product: one hierarchical
navigable small-world graph per shard.

Vectors are dealt to shards by a hash of their id. Each shard's graph is built in
one task and stored as flat arrays: per layer an ``n x links`` block of neighbour
numbers, nodes ordered by falling level so that a layer holds a prefix of them.
Queries, in blocks, search every shard; the best of all shards are merged.

Inner products become nearness by one more component, ``sqrt(max norm^2 - norm^2)``,
which gives all vectors the same length. Equal vectors are one node. Insertion and
search run for many vectors in step, so that the work is in numpy.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .util import mix, stored

LINKS = 16
BUILD_BEAM = 64
SEARCH_BEAM = 96
#: Vectors per shard, on average; a task holds one shard and a block of queries.
SHARD_ROWS = 8192
QUERY_BLOCK = 8192
_STEP = 256   # vectors that move in step
_WIDEN = 4    # beam entries that each of them expands at once

INDEX = "shard long, dim int, ids binary, vectors binary, layers array<int>, links binary"
FOUND = "query_id long, node long, score double"


def _beam(x: np.ndarray, links: np.ndarray, q: np.ndarray, start: np.ndarray, width: int) -> np.ndarray:
    """[queries, width] nodes of a layer nearest to each query that a beam search finds, nearest first, -1 where none."""
    b, n = len(q), len(links)
    seen = np.zeros((b, n + 1), bool)
    seen[:, n] = True  # stands for -1
    rows = np.arange(b)[:, None]
    ids = np.full((b, width), -1)
    sims = np.full((b, width), -np.inf, np.float32)
    k = min(width, start.shape[1])
    ids[:, :k] = start[:, :k]
    seen[rows, ids] = True
    valid = ids[:, :k] >= 0
    sims[:, :k] = np.where(valid, np.einsum("bkd,bd->bk", x[ids[:, :k]], q), -np.inf)
    done = ids < 0
    while True:
        rank = np.where(done, -np.inf, sims)
        take = np.argpartition(-rank, _WIDEN - 1, axis=1)[:, :_WIDEN] if width > _WIDEN else np.argsort(-rank, axis=1)
        live = np.take_along_axis(rank, take, 1) > -np.inf
        act = np.flatnonzero(live.any(1))
        if not len(act):
            break
        take, live = take[act], live[act]
        done[act[:, None], take] = True
        at = np.where(live, ids[act[:, None], take], -1)
        near = np.where((at >= 0)[:, :, None], links[at], -1).reshape(len(act), -1)
        near = np.where(seen[act[:, None], near], -1, near)
        # The same neighbour from two expanded nodes counts once.
        near = np.sort(near, axis=1)
        near[:, 1:][near[:, 1:] == near[:, :-1]] = -1
        seen[act[:, None], near] = True
        s = np.einsum("bkd,bd->bk", x[near], q[act])
        s[near < 0] = -np.inf
        all_s = np.concatenate([sims[act], s], axis=1)
        all_i = np.concatenate([ids[act], near], axis=1)
        all_d = np.concatenate([done[act], near < 0], axis=1)
        keep = np.argpartition(-all_s, width - 1, axis=1)[:, :width]
        sims[act], ids[act], done[act] = (np.take_along_axis(v, keep, 1) for v in (all_s, all_i, all_d))
        ids[act] = np.where(np.isneginf(sims[act]), -1, ids[act])
        done[act] |= ids[act] < 0
    order = np.argsort(-sims, axis=1, kind="stable")
    return np.take_along_axis(ids, order, 1)


def _choose(x: np.ndarray, node: np.ndarray, near: np.ndarray, m: int) -> np.ndarray:
    """[nodes, m] links out of candidates ``near`` (-1: none): nearest first, skipping a
    candidate that is nearer to a link already chosen than to the node; then the
    nearest of the skipped, while room is left."""
    near = np.where(near == node[:, None], -1, near)
    near = np.sort(near, axis=1)
    near[:, 1:][near[:, 1:] == near[:, :-1]] = -1
    s = np.einsum("bkd,bd->bk", x[near], x[node])
    s[near < 0] = -np.inf
    order = np.argsort(-s, axis=1, kind="stable")
    near, s = np.take_along_axis(near, order, 1), np.take_along_axis(s, order, 1)
    v = x[near]
    between = np.matmul(v, v.transpose(0, 2, 1))
    b, c = near.shape
    chosen = np.zeros((b, c), bool)
    closest = np.full((b, c), -np.inf, np.float32)  # of each candidate to a chosen one
    count = np.zeros(b, int)
    for j in range(c):
        ok = (near[:, j] >= 0) & (s[:, j] > closest[:, j]) & (count < m)
        chosen[:, j] = ok
        count += ok
        closest[ok] = np.maximum(closest[ok], between[ok, j])
    rank = np.where(near < 0, 2 * c + np.arange(c), np.where(chosen, 0, c) + np.arange(c))
    order = np.argsort(rank, axis=1)[:, :m]
    out = np.take_along_axis(near, order, 1)
    if c < m:
        out = np.pad(out, ((0, 0), (0, m - c)), constant_values=-1)
    return out


def _link(x: np.ndarray, links: np.ndarray, node: np.ndarray, near: np.ndarray) -> None:
    """Add nodes with candidates ``near`` to a layer, with links both ways."""
    m = links.shape[1]
    mine = _choose(x, node, near, m)
    links[node] = mine
    src, dst = np.repeat(node, m), mine.ravel()
    src, dst = src[dst >= 0], dst[dst >= 0]
    order = np.argsort(dst, kind="stable")
    src, dst = src[order], dst[order]
    while len(dst):  # up to m new neighbours of a node at a time
        head = np.flatnonzero(np.append(True, dst[1:] != dst[:-1]))
        nth = np.arange(len(dst)) - np.repeat(head, np.diff(np.append(head, len(dst))))
        now = nth < m
        target = dst[head]
        more = np.full((len(target), m), -1)
        more[np.searchsorted(target, dst[now]), nth[now]] = src[now]
        for lo in range(0, len(target), 1024):
            t = target[lo:lo + 1024]
            links[t] = _choose(x, t, np.concatenate([links[t], more[lo:lo + 1024]], axis=1), m)
        src, dst = src[~now], dst[~now]


def levels(ids: np.ndarray) -> np.ndarray:
    """Level of each node: geometric, from a hash of its id, so that a task that runs again builds the same graph."""
    u = (mix(ids.astype(np.int64).view(np.uint64)) >> np.uint64(11)).astype(np.float64) / 2 ** 53
    return np.floor(-np.log(np.maximum(u, 1e-18)) / np.log(LINKS)).astype(int)


def build(x: np.ndarray, level: np.ndarray) -> list[np.ndarray]:
    """Layers, lowest first, of the graph over unit-length ``x`` whose ``level`` falls: ``[n_l, links]`` each."""
    layers: list[np.ndarray] = []
    for at in range(int(level[0]) if len(level) else 0, -1, -1):
        n = int((level >= at).sum())
        links = np.full((n, LINKS * (2 if at == 0 else 1)), -1)
        base = min(n, _STEP)
        sims = x[:base] @ x[:base].T
        np.fill_diagonal(sims, -np.inf)
        k = min(base - 1, BUILD_BEAM)
        if k > 0:
            _link(x, links, np.arange(base), np.argsort(-sims, axis=1)[:, :k])
        lo = base
        while lo < n:
            node = np.arange(lo, min(n, lo + _STEP))
            near = _beam(x, links[:lo], x[node], _entry(x, [links[:0], *layers], x[node], lo), BUILD_BEAM)
            own = x[node] @ x[node].T
            np.fill_diagonal(own, -np.inf)
            k = min(len(node) - 1, LINKS)
            if k > 0:
                near = np.concatenate([near, node[np.argpartition(-own, k - 1, axis=1)[:, :k]]], axis=1)
            _link(x, links, node, near)
            lo = int(node[-1]) + 1
        layers.insert(0, links)
    return layers


def _entry(x: np.ndarray, layers: list[np.ndarray], q: np.ndarray, n: int) -> np.ndarray:
    """Start nodes below the layers above the lowest; node 0 is in every layer."""
    start = np.zeros((len(q), 1), int)
    for links in reversed(layers[1:]):
        start = _beam(x, links, q, start, 8)
    return np.where(start < n, start, 0)


def search(x: np.ndarray, layers: list[np.ndarray], q: np.ndarray, width: int) -> np.ndarray:
    out = np.empty((len(q), width), int)
    for lo in range(0, len(q), _STEP):
        part = q[lo:lo + _STEP]
        out[lo:lo + _STEP] = _beam(x, layers[0], part, _entry(x, layers, part, len(x)), width)
    return out


def _lifted(v: np.ndarray, top: float) -> np.ndarray:
    """Vectors of equal length 1 in one more dimension."""
    v = v / np.sqrt(top)
    rest = np.sqrt(np.maximum(0.0, 1.0 - (v * v).sum(1)))
    return np.concatenate([v, rest[:, None]], axis=1).astype(np.float32)


def points(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """``vec_id, v``: rows that take part (no null id; no null, zero, empty or non-finite vector)."""
    v = F.col(vector_col).cast("array<double>")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    return vectors.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v")).where(F.col("vec_id").isNotNull() & fine)


def build_index(nodes: DataFrame, top: float, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """One row per shard (and dimension) of ``nodes (vec_id, v)``: ids, vectors, layer sizes, flat neighbour arrays."""
    shards = max(1, -(-nodes.count() // shard_rows))

    def run(t: pa.Table) -> pa.Table:
        ids = t.column(2).to_numpy()
        v = t.column(3).combine_chunks().values.to_numpy().reshape(len(ids), -1)
        level = levels(ids)
        order = np.lexsort((ids, -level))
        ids, v, level = ids[order], v[order], level[order]
        layers = build(_lifted(v, top), level)
        flat = np.concatenate([x.ravel() for x in layers]).astype(np.int32)
        return pa.table({"shard": t.column(0)[:1], "dim": t.column(1)[:1], "ids": [ids.tobytes()], "vectors": [v.tobytes()],
                         "layers": pa.array([[len(x) for x in layers]], pa.list_(pa.int32())), "links": [flat.tobytes()]})

    keyed = nodes.select(F.pmod(F.xxhash64("vec_id"), F.lit(shards)).alias("shard"), F.size("v").alias("dim"), "vec_id", "v")
    return stored(keyed.groupBy("shard", "dim").applyInArrow(run, INDEX), "vectors-index")


def search_index(index: DataFrame, queries: DataFrame, top: float, keep: int, beam: int = SEARCH_BEAM) -> DataFrame:
    """``query_id, node, score``: the ``keep`` nearest nodes that each shard finds for each query ``(query_id, q)``."""
    blocks = max(1, -(-queries.count() // QUERY_BLOCK))
    left = index.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    shards = index.select(F.col("shard").alias("to_shard"), F.col("dim").alias("to_dim"))
    right = (queries.withColumn("to_block", F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int"))
             .join(shards, F.size("q") == F.col("to_dim")).select("to_shard", "to_dim", "to_block", "query_id", "q"))

    def run(a: pa.Table, b: pa.Table) -> pa.Table:
        if not a.num_rows or not b.num_rows:
            return pa.table({"query_id": pa.array([], pa.int64()), "node": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        row = a.slice(0, 1).to_pylist()[0]
        ids = np.frombuffer(row["ids"], np.int64)
        v = np.frombuffer(row["vectors"], np.float64).reshape(len(ids), -1)
        flat, layers = np.frombuffer(row["links"], np.int32), []
        for k, n in enumerate(row["layers"]):
            size = n * LINKS * (2 if k == 0 else 1)
            layers.append(flat[:size].reshape(n, -1))
            flat = flat[size:]
        who = b.column("query_id").to_numpy()
        q = b.column("q").combine_chunks().values.to_numpy().reshape(len(who), -1)
        x = _lifted(v, top)
        near = search(x, layers, np.pad(q / np.linalg.norm(q, axis=1, keepdims=True), ((0, 0), (0, 1))).astype(np.float32), max(beam, keep))
        out = ([], [], [])
        for i in range(len(who)):
            at = near[i][near[i] >= 0]
            score = v[at] @ q[i]
            best = np.lexsort((ids[at], -score))[:keep]
            for o, x_ in zip(out, (np.full(len(best), who[i]), ids[at][best], score[best]), strict=True):
                o.append(x_)
        return pa.table({n: np.concatenate(o) for n, o in zip(("query_id", "node", "score"), out, strict=True)})

    return (left.groupBy("shard", "dim", "block").cogroup(right.groupBy("to_shard", "to_dim", "to_block")).applyInArrow(run, FOUND))


def nearest(vectors: DataFrame, k: int = 20, every: int = 20, id_col: str = "vec_id", vector_col: str = "embedding",
            shard_rows: int = SHARD_ROWS) -> DataFrame:
    """``query_id, rank, vec_id, score``: for each row whose id ``every`` divides, the
    ``k`` rows of largest inner product found, nearest first, ties to the smaller id.

    A row is no neighbour of its own id. Rows with a null id or a null, empty, zero
    or non-finite vector take no part; vectors of another dimension are not
    compared. Equal vectors share a node and all of them count. Fewer candidates
    than ``k`` give fewer rows; an empty table gives none; extra columns are ignored.
    """
    rows = points(vectors, id_col, vector_col).distinct()
    # Of equal vectors no more than k + 1 can be wanted by any query.
    same = Window.partitionBy("v").orderBy("vec_id")
    ranked = stored(rows.withColumn("nth", F.row_number().over(same)).where(F.col("nth") <= k + 1)
                    .withColumn("node", F.min("vec_id").over(Window.partitionBy("v"))), "vectors-points")
    nodes = ranked.where("nth = 1").select("vec_id", "v")
    norm = F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)
    top = nodes.agg(F.max(norm)).first()[0]
    queries = rows.where(F.col("vec_id") % every == 0).select(F.col("vec_id").alias("query_id"), F.col("v").alias("q"))
    found = search_index(build_index(nodes, float(top or 1.0), shard_rows), queries, float(top or 1.0), k + 1)
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "node")
    found = found.withColumn("nth", F.row_number().over(best)).where(F.col("nth") <= k + 1).drop("nth")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (found.join(ranked.select("node", "vec_id"), "node").where("vec_id <> query_id")
            .withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))
