"""N-gram Jaccard join by chosen paths.

Documents are sets of five-word shingles; equal sets are one set from the start.
At every node of a recursion tree each set follows those of its tokens whose hash,
seeded by the path so far, is below ``BRANCH / (threshold * size)``: two sets of
Jaccard similarity >= threshold follow at least ``BRANCH`` common tokens in
expectation, dissimilar ones hardly any. Buckets (equal paths) of one set end,
small ones are compared by brute force, larger ones are split on a further token,
down to ``MAX_DEPTH``, where what is left (sets that share nearly everything) is
compared in blocks. Independent runs repeat this until a similar pair is missed
with probability below ``1 - RECALL``.

Brute force in a bucket uses bottom-k sketches with a wide margin and yields
candidate classes (spanning links only, never all pairs). Every class is then
verified once, exactly, on the full sets, in pairs of blocks where it is large.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .util import (
    binaries,
    bit_map,
    components,
    data_buffers,
    documents,
    group_bounds,
    in_bit_map,
    mix,
    seeded,
    signed,
    stored,
    whole_groups,
)
from .words import SHINGLE, shingle_sets, words_of

THRESHOLD = 0.8
RECALL = 0.999
BRANCH = 1.5
MAX_DEPTH = 3
#: Buckets of more sets are split on a further token, while depth is left.
BUCKET = 512
#: Sets per block of a comparison; a task holds two blocks.
BLOCK = 1024
SKETCH = 128
#: Share of a sketch that candidates have in common at least: over five standard errors below 0.8.
SKETCH_SHARE = 0.6
_PAD = np.uint32(0xFFFFFFFF)


def runs_for(recall: float = RECALL, branch: float = BRANCH, depth: int = MAX_DEPTH) -> int:
    """Independent runs after which a pair that needs the whole depth is found with probability ``recall``.
    One level keeps a pair with probability 1 - exp(-branch * what the levels below keep)."""
    kept = 1.0
    for _ in range(depth):
        kept = 1 - math.exp(-branch * kept)
    return max(1, math.ceil(math.log(1 - recall) / math.log(1 - kept)))


def _below(size: np.ndarray, threshold: float) -> np.ndarray:
    """Largest hash that is followed, by set size."""
    share = np.minimum(BRANCH / (threshold * np.maximum(size, 1)), 1.0)
    return np.minimum(share * 2.0 ** 64, 2.0 ** 64 - 2048).astype(np.uint64)


def _features(docs: DataFrame, threshold: float, runs: int, shingle: int) -> DataFrame:
    """Per document: fingerprint and size of its set, first path keys of all runs, bottom-k sketch."""

    def run(batches):
        for batch in batches:
            for w in words_of(batch.column(1)):
                first, h = shingle_sets(w, shingle)
                n = np.diff(first)
                row = np.repeat(np.arange(len(n)), n)
                sums = [np.concatenate(([0], np.cumsum(seeded(h, s), dtype=np.uint64))).astype(np.uint64) for s in (101, 102)]
                limit = _below(n, threshold)[row]
                at, keys = [], []
                for r in range(runs):
                    u = seeded(h, r)
                    ok = np.flatnonzero(u <= limit)
                    at.append(row[ok])
                    keys.append(seeded(u[ok], 1000 + r))
                at, keys = np.concatenate(at), np.concatenate(keys)
                order = np.argsort(at, kind="stable")
                key_bounds = np.searchsorted(at[order], np.arange(len(n) + 1))
                size = np.minimum(n, SKETCH)
                bounds = np.concatenate(([0], np.cumsum(size)))
                low = np.repeat(first[:-1] - bounds[:-1], size) + np.arange(bounds[-1])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(w.lo, w.hi - w.lo), *(pa.array(signed(s[first[1:]] - s[first[:-1]])) for s in sums),
                     pa.array(n.astype(np.int64)), pa.ListArray.from_arrays(pa.array(key_bounds.astype(np.int32)), pa.array(signed(keys[order]))),
                     binaries((h[low] >> np.uint64(32)).astype(np.uint32), bounds)],
                    ["doc_id", "f1", "f2", "n", "keys", "sketch"])

    return docs.mapInArrow(run, "doc_id long, f1 long, f2 long, n long, keys array<long>, sketch binary")


def _children(big: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """``key, node`` one level further down, for the members of large buckets. Here a set's
    tokens are those of its sketch, of which similar sets share the same part as of the whole."""

    def run(batches):
        for batch in batches:
            key = batch.column(0).to_numpy().view(np.uint64)
            offsets, raw = data_buffers(batch.column(2))
            first, token = offsets // 4, raw.view(np.uint32).astype(np.uint64)
            n = np.diff(first)
            row = np.repeat(np.arange(len(n)), n)
            u = mix(mix(token) ^ mix(key)[row])
            ok = np.flatnonzero(u <= _below(n, threshold)[row])
            yield pa.RecordBatch.from_arrays(
                [pa.array(signed(seeded(u[ok], 77) ^ key[row[ok]])), batch.column(1).take(pa.array(row[ok]))], ["key", "node"])

    return big.join(sets.select("node", "sketch"), "node").select("key", "node", "sketch").mapInArrow(
        run, "key long, node long").distinct()


def _shared(members: DataFrame, name: str) -> DataFrame:
    """``key, node, size`` of buckets of two sets or more."""
    sizes = members.groupBy("key").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    return stored(members.join(sizes, "key"), name)


def _each_once(leaves: DataFrame) -> DataFrame:
    """Of buckets of the same members (128 bits of their hashes agree) only one: near copies meet again in every run."""
    same = leaves.groupBy("key").agg(F.bit_xor(F.xxhash64("node")).alias("x"), F.bit_xor(F.xxhash64("node", F.lit(3))).alias("y"),
                                     F.max("size").alias("z"))
    return leaves.join(same.groupBy("x", "y", "z").agg(F.min("key").alias("key")).select("key"), "key", "left_semi")


def _blocks(members: DataFrame, key: str) -> DataFrame:
    """Members dealt to comparisons ``(key, bi, bj)``: one for a group of up to
    ``BLOCK``, else one for each pair of its blocks."""
    m = members.withColumn("nb", F.ceil(F.col("size") / F.lit(BLOCK)).cast("int"))
    m = m.withColumn("b", F.pmod(F.xxhash64(key, "node"), F.col("nb")).cast("int"))
    m = m.withColumn("j", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)))
    return m.withColumn("bi", F.least("b", "j")).withColumn("bj", F.greatest("b", "j")).drop("nb", "j", "size")


def _sketches(column: pa.ChunkedArray) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    out = np.full((len(column), SKETCH), _PAD, np.uint32)
    for i, v in enumerate(column.to_pylist()):
        own = np.frombuffer(v, np.uint32)
        out[i, :len(own)] = own
    return out


def _alike(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray, threshold: float) -> np.ndarray:
    """Whether pairs of sketches may reach the threshold: sizes, then common sketch values."""
    small, large = np.minimum(na, nb), np.maximum(na, nb)
    ok = np.flatnonzero(small >= threshold * large)
    out = np.zeros(len(na), bool)
    for lo in range(0, len(ok), 4096):
        at = ok[lo:lo + 4096]
        both = np.sort(np.concatenate([a[at], b[at]], axis=1), axis=1)
        common = ((both[:, 1:] == both[:, :-1]) & (both[:, 1:] != _PAD)).sum(1)
        out[at] = common >= SKETCH_SHARE * np.minimum(SKETCH, large[at])
    return out


def _spread_labels(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest index reachable over the links (a, b)."""
    label = np.arange(n)
    while len(a):
        low = np.minimum(label[a], label[b])
        before = label.copy()
        np.minimum.at(label, a, low)
        np.minimum.at(label, b, low)
        label = label[label]
        if (label == before).all():
            break
    return label


def _bucket_classes(sk: np.ndarray, n: np.ndarray, threshold: float) -> np.ndarray:
    """Candidate classes of one bucket: each member is compared with those that no class has yet."""
    label = np.full(len(n), -1)
    free = np.arange(len(n))
    while len(free):
        root, queue = free[0], [free[0]]
        label[root], free = root, free[1:]
        while queue and len(free):
            p = queue.pop()
            size = np.maximum(n[free], n[p])
            common = np.isin(sk[free], sk[p][sk[p] != _PAD]).sum(1)
            hit = (common >= SKETCH_SHARE * np.minimum(SKETCH, size)) & (np.minimum(n[free], n[p]) >= threshold * size)
            label[free[hit]] = root
            queue.extend(free[hit])
            free = free[~hit]
    return label


def _candidate_links(leaves: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """``a, b``: spanning links of the candidate classes of each bucket."""

    def run(batches):
        for t in whole_groups(batches, 3):
            bounds, node = group_bounds(t, 3), t.column(3).to_numpy()
            n, sk = t.column(4).to_numpy(), _sketches(t.column(5))
            size = np.diff(bounds)
            group = np.repeat(np.arange(len(size)), size)
            small = size[group] <= 16
            a, b = [], []
            for d in range(1, 16):  # all pairs of small buckets at once
                i = np.flatnonzero((group[d:] == group[:-d]) & small[d:])
                if not len(i):
                    break
                ok = i[_alike(sk[i], sk[i + d], n[i], n[i + d], threshold)]
                a.append(ok)
                b.append(ok + d)
            label = _spread_labels(len(n), np.concatenate(a or [np.zeros(0, int)]), np.concatenate(b or [np.zeros(0, int)]))
            for g in np.flatnonzero(size > 16):
                lo, hi = bounds[g], bounds[g + 1]
                label[lo:hi] = lo + _bucket_classes(sk[lo:hi], n[lo:hi], threshold)
            at = np.flatnonzero(node[label] != node)
            yield pa.RecordBatch.from_arrays([pa.array(node[at]), pa.array(node[label[at]])], ["a", "b"])

    dealt = (_blocks(leaves, "key").join(sets.select("node", "n", "sketch"), "node")
             .select("key", "bi", "bj", "node", "n", "sketch"))
    return (dealt.repartition("key", "bi", "bj").sortWithinPartitions("key", "bi", "bj")
            .mapInArrow(run, "a long, b long").distinct())


def _exact(classes: DataFrame, docs: DataFrame, copies: DataFrame, threshold: float, shingle: int) -> DataFrame:
    """``node, root, links, set_links`` per comparison: exact similarities within the candidate classes."""

    # Only sets of candidates are shuffled: tasks drop other documents by a bit map of
    # fixed size, and the join drops what slips through.
    shared = docs.sparkSession.sparkContext.broadcast(bit_map(classes.select(F.xxhash64("node").alias("h"))))

    def sets(batches):
        hashed = shared.value
        for batch in batches:
            batch = batch.filter(pa.array(in_bit_map(hashed, batch.column(2).to_numpy().view(np.uint64))))
            for w in words_of(batch.column(1)):
                first, h = shingle_sets(w, shingle)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(w.lo, w.hi - w.lo), binaries(h, first)], ["node", "tokens"])

    def run(batches):
        for t in whole_groups(batches, 3):
            bounds = group_bounds(t, 3)
            bi, bj, node, block, weight = (t.column(k).to_numpy() for k in (1, 2, 3, 4, 5))
            tokens = t.column(6).combine_chunks() if t.num_rows else None
            out = ([], [], [], [])
            for g in range(len(bounds) - 1):
                lo, hi = bounds[g], bounds[g + 1]
                own = [np.frombuffer(tokens[i].as_buffer(), np.uint64) for i in range(lo, hi)]
                size = np.array([len(x) for x in own])
                order = np.argsort(size, kind="stable")
                own, size = [own[i] for i in order], size[order]
                who, wt, bl = node[lo:hi][order], weight[lo:hi][order], block[lo:hi][order]
                across = bi[lo] != bj[lo]  # blocks are compared with themselves elsewhere
                _, flat = np.unique(np.concatenate(own), return_inverse=True)
                at = np.concatenate(([0], np.cumsum(size)))
                mark = np.zeros(int(flat.max()) + 1 if len(flat) else 1, np.int32)
                links, distinct, a, b = np.zeros(len(who), np.int64), np.zeros(len(who), np.int64), [], []
                for i in range(len(who) - 1):
                    stop = int(np.searchsorted(size, size[i] / threshold + 1e-9, side="right"))
                    if stop <= i + 1:
                        continue
                    mark[flat[at[i]:at[i + 1]]] = 1
                    common = np.add.reduceat(mark[flat[at[i + 1]:at[stop]]], at[i + 1:stop] - at[i + 1])
                    mark[flat[at[i]:at[i + 1]]] = 0
                    hit = common * (1 + threshold) >= threshold * (size[i] + size[i + 1:stop]) - 1e-9
                    if across:
                        hit &= bl[i + 1:stop] != bl[i]
                    j = i + 1 + np.flatnonzero(hit)
                    links[i] += wt[j].sum()
                    links[j] += wt[i]
                    distinct[i] += len(j)
                    distinct[j] += 1
                    a.append(np.full(len(j), i))
                    b.append(j)
                label = _spread_labels(len(who), np.concatenate(a or [np.zeros(0, int)]), np.concatenate(b or [np.zeros(0, int)]))
                for o, v in zip(out, (who, who[label], links, distinct), strict=True):
                    o.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(o)) for o in out], ["node", "root", "links", "set_links"])

    full = docs.where("doc_id IS NOT NULL").withColumn("h", F.xxhash64("doc_id")).mapInArrow(
        sets, "node long, tokens binary").dropDuplicates(["node"])
    dealt = (_blocks(classes, "class").join(copies, "node").join(full, "node")
             .select("class", "bi", "bj", "node", "b", "copies", "tokens"))
    return (dealt.repartition("class", "bi", "bj").sortWithinPartitions("class", "bi", "bj")
            .mapInArrow(run, "node long, root long, links long, set_links long"))


def jaccard_join(docs: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL, shingle: int = SHINGLE,
                 id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, class_id, n_links, n_sets, n_copies`` of every document row.

    ``class_id`` is the smallest id that the document reaches over links (Jaccard
    similarity of shingle sets >= ``threshold``). ``n_links`` is the number of other
    documents linked with it, exact copies included; ``n_sets`` of other sets;
    ``n_copies`` of other documents of the same set. A text of fewer words than a
    shingle, but not none, has them all as one shingle. Null, empty and wordless
    texts have no set: a class of their own without links. Rows with a null id get
    null results. Rows of one id are one document. An empty table gives an empty
    result; extra columns are ignored.
    """
    picked = documents(docs, id_col, text_col)
    features = stored(_features(picked, threshold, runs_for(recall), shingle), "jaccard-features")
    groups = stored(features.where("n > 0 AND doc_id IS NOT NULL").groupBy("f1", "f2", "n")
                    .agg(F.min("doc_id").alias("node"), F.countDistinct("doc_id").alias("copies")), "jaccard-sets")
    sets = features.join(groups, ["f1", "f2", "n"]).where("doc_id = node").select("node", "n", "keys", "sketch")
    level = _shared(sets.select(F.explode("keys").alias("key"), "node").distinct(), "jaccard-level1")
    leaves = [level.where(F.col("size") <= BUCKET)]
    for depth in range(2, MAX_DEPTH + 1):
        big = level.where(F.col("size") > BUCKET).select("key", "node")
        if big.isEmpty():
            break
        level = _shared(_children(big, sets, threshold), f"jaccard-level{depth}")
        leaves.append(level if depth == MAX_DEPTH else level.where(F.col("size") <= BUCKET))
    found = leaves[0]
    for more in leaves[1:]:
        found = found.union(more)
    classes = components(_candidate_links(_each_once(found), sets, threshold), "jaccard-candidates")
    sizes = classes.groupBy("root").agg(F.count(F.lit(1)).alias("size"))
    classes = classes.join(sizes, "root").select(F.col("root").alias("class"), "node", "size")
    copies = groups.groupBy("node").agg(F.max("copies").alias("copies"))
    exact = stored(_exact(classes, picked, copies, threshold, shingle), "jaccard-exact")
    linked = exact.groupBy("node").agg(F.sum("links").alias("links"), F.sum("set_links").alias("set_links"))
    final = components(exact.select(F.col("node").alias("a"), F.col("root").alias("b")), "jaccard-classes")
    of_set = groups.join(linked, "node", "left").join(final, "node", "left")
    rows = features.select("doc_id", "f1", "f2", "n").join(of_set.select(
        "f1", "f2", "n", "node", "copies", "links", "set_links", "root"), ["f1", "f2", "n"], "left")
    known = F.col("doc_id").isNotNull()
    others = F.coalesce(F.col("copies") - 1, F.lit(0))
    return rows.select(
        "doc_id", F.when(known, F.coalesce("root", "node", "doc_id")).alias("class_id"),
        F.when(known, F.coalesce("links", F.lit(0)) + others).alias("n_links"),
        F.when(known, F.coalesce("set_links", F.lit(0))).alias("n_sets"), F.when(known, others).alias("n_copies"))
