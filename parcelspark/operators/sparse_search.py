"""Sparse top-k cosine retrieval by inverted lists.

Texts are sparse unit vectors: (bucket, weight) of the buckets that occur. The index deals the
texts into shards by a hash of the id; a shard holds, per bucket, a posting list (text,
weight) by falling weight, cut into parts that each know their greatest weight, and the texts'
own terms. A list of a bucket that every text has is so cut by shard and by part.

A query adds up list parts in the order of what they can add at most, twice as many at each
step. What the lists can still add to any text is known at every step; once the k-th best sum so far exceeds it, no
text outside those sums can be a hit. Texts that can still reach the k-th best are then scored
in full from their own terms, as soon as these are fewer than the postings left. Results are exact.

Queries are copied to every shard; the index is moved once, whatever the number of queries: a task
reads a shard and lets the queries stream past it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..schemas import HASH_BUCKETS, TOP_K
from .embedding import _WORD

#: Texts of a shard, on average, and postings of a list part.
SHARD, PART = 1 << 14, 256
#: Parts of lists that the first step of a query reads.
STEP = 1
DIGITS = 6
_MARGIN = 4e-6  # more than one rounding step plus float error
TERMS = "array<struct<bucket:int,weight:float>>"
_FORWARD = -1


def sparse_terms(df: DataFrame, id_col: str, text_col: str, buckets: int = HASH_BUCKETS) -> DataFrame:
    """T7 + T8 in sparse form: ``(id, terms)``, the buckets that occur with their weights, by bucket;
    the same weights as ``embedding.hashed_embedding``. A text without tokens has no terms."""
    kind = pa.list_(pa.struct([("bucket", pa.int32()), ("weight", pa.float32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict[str, int] = {}
        for batch in batches:
            parts, first = [np.zeros((0, 2))], [0]
            for text in batch.column(1).to_pylist():
                ids = [_bucket(t, buckets, cache) for t in _WORD.findall(text.lower())] if text else []
                slot, n = np.unique(np.array(ids, np.int64), return_counts=True)
                parts.append(np.stack([slot, n / np.sqrt(np.dot(n, n)) if len(n) else n], 1))
                first.append(first[-1] + len(slot))
            flat = np.concatenate(parts)
            terms = pa.StructArray.from_arrays([pa.array(flat[:, 0].astype(np.int32)), pa.array(flat[:, 1].astype(np.float32))], fields=list(kind.value_type))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(first, pa.int32()), terms, type=kind)], ["id", "terms"])

    picked = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return picked.mapInArrow(run, f"id {picked.schema['id'].dataType.simpleString()}, terms {TERMS}")


def _bucket(token: str, buckets: int, cache: dict[str, int]) -> int:
    b = cache.get(token)
    if b is None:
        if len(cache) >= 1 << 18:
            cache.clear()
        b = cache[token] = int(hashlib.md5(token.encode()).hexdigest()[:8], 16) % buckets
    return b


@dataclass
class Index:
    """The written index: a table of list parts, and its number of shards and type of id."""

    table: DataFrame
    shards: int
    id_type: str


def _index_schema(id_type: str) -> str:
    return f"shard int, bucket int, part int, greatest float, n int, docs binary, weights binary, terms binary, ids array<{id_type}>"


def build_index(docs: DataFrame, path: str, shard: int = SHARD, part: int = PART, n_docs: int | None = None) -> Index:
    """Write the index of ``(id, terms)`` rows (ids are unique) at ``path``; a row per list part, and per
    shard one row with its ids, in order, and their terms. ``n_docs`` is the number of rows, if it is
    known: counting them runs what they come from."""
    id_type = docs.schema["id"].dataType.simpleString()
    shards = max(1, -(-(docs.count() if n_docs is None else n_docs) // shard))
    schema = _index_schema(id_type)

    def build(table: pa.Table) -> pa.Table:
        table = table.sort_by("id")  # a text's number in the shard is the rank of its id
        terms = table.column("terms").combine_chunks()
        first = terms.offsets.to_numpy().astype(np.int64)
        first = first - first[0]
        flat = terms.flatten()
        slot, weight = flat.field("bucket").to_numpy(), flat.field("weight").to_numpy()
        doc = np.repeat(np.arange(len(first) - 1, dtype=np.int32), np.diff(first))
        order = np.lexsort((doc, -weight, slot))
        heads = np.flatnonzero(np.concatenate(([True], slot[order][1:] != slot[order][:-1]))[:len(order)])
        rows = [(_FORWARD, 0, 0.0, len(first) - 1, first.astype("<i8").tobytes(), weight.astype("<f4").tobytes(), slot.astype("<i4").tobytes(),
                 table.column("id").to_pylist())]
        for s, e in zip(heads, np.append(heads[1:], len(order))):
            for k, i in enumerate(range(s, e, part)):
                own = order[i:min(e, i + part)]
                rows.append((int(slot[own[0]]), k, float(weight[own[0]]), len(own), doc[own].astype("<i4").tobytes(), weight[own].astype("<f4").tobytes(), None, None))
        number = table.column("shard")[0].as_py()
        names = [c.split()[0] for c in schema.split(", ")]
        kinds = [pa.int32(), pa.int32(), pa.int32(), pa.float32(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.list_(table.schema.field("id").type)]
        columns = [[number] * len(rows), *zip(*rows)]
        return pa.table({c: pa.array(list(v), kind) for c, v, kind in zip(names, columns, kinds)})

    dealt = docs.where("id IS NOT NULL AND terms IS NOT NULL").withColumn("shard", F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int"))
    dealt.groupBy("shard").applyInArrow(build, schema).write.mode("overwrite").parquet(path)
    return open_index(docs.sparkSession, path, shards, id_type)


def open_index(spark, path: str, shards: int, id_type: str) -> Index:
    return Index(spark.read.schema(_index_schema(id_type)).parquet(path), shards, id_type)


@dataclass
class Shard:
    """One shard in a task's memory: by bucket its list (texts, weights) with the start and greatest weight
    of each part, and the texts' terms."""

    n: int = 0
    first: np.ndarray | None = None
    slot: np.ndarray | None = None
    weight: np.ndarray | None = None
    ids: list = field(default_factory=list)
    parts: dict[int, list[tuple[float, np.ndarray, np.ndarray]]] = field(default_factory=dict)
    lists: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=dict)

    def add(self, row: dict) -> None:
        docs, weights = row["docs"], np.frombuffer(row["weights"], "<f4").astype(np.float64)
        if row["bucket"] == _FORWARD:
            self.n, self.ids = row["n"], row["ids"]
            self.first, self.slot, self.weight = np.frombuffer(docs, "<i8"), np.frombuffer(row["terms"], "<i4"), weights
        else:  # parts arrive in order
            self.parts.setdefault(row["bucket"], []).append((row["greatest"], np.frombuffer(docs, "<i4"), weights))

    def list_of(self, bucket: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray] | None:
        """(texts, weights, bounds of the parts, their greatest weights) of a bucket, joined when first asked for."""
        if bucket in self.parts:
            greatest, docs, weights = zip(*self.parts.pop(bucket), strict=True)
            bounds = np.cumsum([0, *map(len, docs)])
            self.lists[bucket] = np.concatenate(docs), np.concatenate(weights), bounds, np.array(greatest, np.float64)
        return self.lists.get(bucket)

    def scores(self, docs: np.ndarray, query: dict[int, float]) -> np.ndarray:
        """Full products of some texts with the query, from their own terms."""
        size = self.first[docs + 1] - self.first[docs]
        ends = np.cumsum(size)
        at = np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.first[docs] - ends + size, size)
        wanted, slots = np.array(sorted(query)), self.slot[at]
        place = np.minimum(np.searchsorted(wanted, slots), len(wanted) - 1)
        gain = np.where(wanted[place] == slots, np.array([query[b] for b in wanted.tolist()])[place], 0.0)
        return np.bincount(np.repeat(np.arange(len(docs)), size), gain * self.weight[at], minlength=len(docs))

    def search(self, query: dict[int, float], k: int, pad: bool) -> tuple[np.ndarray, np.ndarray, int]:
        """(texts, distances, postings read) of the ``k`` nearest by (rounded distance, id)."""
        found = [(w, held) for b, w in query.items() if (held := self.list_of(b))]
        # Parts of all lists (list, part, the most that it can add) in the order of that.
        of = np.repeat(np.arange(len(found)), [len(held[3]) for _, held in found])
        part = np.concatenate([np.zeros(0, np.int64), *(np.arange(len(held[3])) for _, held in found)])
        most = np.concatenate([np.zeros(0), *(w * held[3] for w, held in found)])
        order = np.lexsort((part, of, -most))
        of, part, most = of[order], part[order], most[order]
        size = sum(len(held[0]) for _, held in found)
        rest, asked, total, read = np.inf, np.inf, np.zeros(self.n), 0
        candidates, done, step = None, 0, STEP
        while done < len(of):
            docs, gains = [], []
            for i, j in zip(of[done:done + step].tolist(), part[done:done + step].tolist(), strict=True):
                w, (texts, weights, bounds, _) = found[i]
                docs.append(texts[bounds[j]:bounds[j + 1]])
                gains.append(w * weights[bounds[j]:bounds[j + 1]])
            docs = np.concatenate(docs)
            total += np.bincount(docs, np.concatenate(gains), minlength=self.n)
            read += len(docs)
            done, step = done + step, 2 * step
            left = np.zeros(len(found))
            left[of[done:][::-1]] = most[done:][::-1]  # of each list the first part that was not read
            rest = left.sum()
            if self.n > k and rest < 0.9 * asked:  # the k-th best sum is looked up as the rest shrinks
                asked = rest
                kth = np.partition(total, self.n - k)[self.n - k]
                if kth - _MARGIN > rest:
                    able = np.flatnonzero(total + rest >= kth - _MARGIN)
                    if len(able) * len(self.slot) < self.n * (size - read):  # fewer terms than postings left to read
                        candidates = able
                        break
        if candidates is None:
            candidates = np.flatnonzero(total > 0)
            score = total[candidates]
        else:
            score = self.scores(candidates, query)
        micro = np.rint((1.0 - score) * 10 ** DIGITS)
        if pad and (len(candidates) < k or np.partition(micro, k - 1)[k - 1] >= 10 ** DIGITS):
            far = np.flatnonzero(total == 0)[:k]  # at distance 1, lowest ids first
            candidates, score = np.append(candidates, far), np.append(score, np.zeros(len(far)))
            micro = np.append(micro, np.full(len(far), 10 ** DIGITS))
        best = np.lexsort((candidates, micro))[:k]
        return candidates[best], 1.0 - score[best], read


def sparse_topk(index: Index, queries: DataFrame, k: int = TOP_K, pad: bool = False) -> DataFrame:
    """R2 + W1: exact cosine top-k of ``(query_id, terms)`` rows over the indexed texts.

    Returns ``query_id, id, distance`` (rounded) and ``rank``. Texts that share no bucket with the query are
    at distance 1 and do not appear, unless ``pad``: then the lowest ids among them fill up to ``k``.
    A query of null terms is left out; ids of queries are unique.
    """
    spark = queries.sparkSession
    qid = queries.schema["query_id"].dataType.simpleString()
    asked = (queries.where("terms IS NOT NULL").select("query_id", F.col("terms").alias("query"))
             .withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(index.shards - 1)))))
    rows = (index.table.withColumn("kind", F.lit(0)).unionByName(asked.withColumn("kind", F.lit(1)), allowMissingColumns=True)
            .repartition("shard").sortWithinPartitions("shard", "kind", "bucket", "part"))
    columns = ["shard", "bucket", "n", "greatest", "docs", "weights", "terms", "ids"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, shard = None, Shard()
        for batch in batches:
            kinds = batch.column("kind").to_numpy()
            cut = np.flatnonzero(np.append(True, kinds[1:] != kinds[:-1])[:len(kinds)]).tolist()
            for s, e in zip(cut, [*cut[1:], len(kinds)]):
                part = batch.slice(s, e - s)
                if kinds[s] == 0:
                    for row in part.select(columns).to_pylist():
                        if row["shard"] != number:
                            number, shard = row["shard"], Shard()
                        shard.add(row)
                    continue
                found = ([], [], [])
                for row in part.select(["shard", "query_id", "query"]).to_pylist():
                    if row["shard"] != number:  # a shard without texts
                        continue
                    docs, distance, _ = shard.search({t["bucket"]: float(t["weight"]) for t in row["query"]}, k, pad)
                    found[0].extend([row["query_id"]] * len(docs))
                    found[1].extend(shard.ids[i] for i in docs)
                    found[2].extend(distance.tolist())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(found[0], batch.schema.field("query_id").type), pa.array(found[1], batch.schema.field("ids").type.value_type),
                     pa.array(found[2], pa.float64())], ["query_id", "id", "distance"])

    hits = rows.mapInArrow(run, f"query_id {qid}, id {index.id_type}, distance double")
    order = Window.partitionBy("query_id").orderBy("distance", "id")
    return (hits.withColumn("distance", F.round("distance", DIGITS))
            .withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k))


def posting_lists(index: Index) -> DataFrame:
    """One row per bucket of the index: its postings and their greatest weight."""
    return (index.table.where(F.col("bucket") != _FORWARD).groupBy("bucket")
            .agg(F.sum("n").alias("n_postings"), F.max("greatest").cast("double").alias("greatest")))
