"""Inverted lists against a plain search (the registered queries are compared with DuckDB in test_oracle)."""

import numpy as np
import pytest

from parcelspark.operators import sparse_search as S
from parcelspark.operators.embedding import hashed_embedding
from pyspark.sql import functions as F


def plain(docs, query, k, pad):
    """(distance, id) by full products; rounded distance, then id."""
    rows = []
    for i, terms in docs.items():
        if terms is None:
            continue
        dot = sum(w * query[b] for b, w in terms.items() if b in query)
        if pad or any(b in query for b in terms):
            rows.append((round(1.0 - dot, 6), i))
    return sorted(rows)[:k]


def random_texts(rng, n, buckets, skew):
    out = {}
    for i in range(n):
        size = rng.integers(0, 8)
        slot = rng.choice(buckets, size, replace=False)
        w = rng.random(size) ** skew + 1e-3
        norm = np.float32(np.sqrt((w * w).sum())) if size else 1
        out[int(i)] = {int(b): float(np.float32(x / norm)) for b, x in zip(slot, w)}
    return out


def frame(spark, texts, name="id"):
    rows = [(i, None if t is None else [(b, w) for b, w in sorted(t.items())]) for i, t in texts.items()]
    return spark.createDataFrame(rows, f"{name} long, terms {S.TERMS}")


@pytest.mark.parametrize("pad", [True, False])
def test_hits_equal_a_plain_search(spark, tmp_path, pad):
    rng = np.random.default_rng(4)
    docs = random_texts(rng, 400, 30, 3) | {1000: None, 1001: {}}
    docs |= {2000 + i: docs[7] for i in range(6)}  # ties
    queries = random_texts(rng, 40, 30, 1) | {500: {}, 501: {29: 1.0}}
    index = S.build_index(frame(spark, docs), str(tmp_path / "index"), shard=90, part=4)
    assert index.shards == 5
    got = {}
    for r in S.sparse_topk(index, frame(spark, queries | {900: None}, "query_id"), 5, pad).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.distance, r.id))
    for q, terms in queries.items():
        want = [(n + 1, d, i) for n, (d, i) in enumerate(plain(docs, terms, 5, pad))]
        have = sorted(got.get(q, []))
        assert [x[0] for x in have] == [x[0] for x in want]
        assert [x[2] for x in have] == [x[2] for x in want] and np.allclose([x[1] for x in have], [x[1] for x in want], atol=1e-9)
    assert 900 not in got


def test_lists_are_cut_and_few_postings_are_read(spark, tmp_path):
    """A hot bucket that every text has with a small weight is not read where a rare one decides."""
    rng = np.random.default_rng(5)
    docs = {}
    for i in range(3000):
        own = int(rng.integers(1, 200))
        docs[i] = {0: 0.05, own: float(np.sqrt(1 - 0.05 ** 2))}
    index = S.build_index(frame(spark, docs), str(tmp_path / "index"), shard=10_000, part=64)
    hot = index.table.where("bucket = 0")
    assert hot.count() == -(-3000 // 64) and hot.agg({"n": "max"}).first()[0] == 64
    shard = S.Shard()
    for r in index.table.orderBy("bucket", "part").collect():
        shard.add(r.asDict())
    query = {0: 0.3, 17: float(np.sqrt(1 - 0.3 ** 2))}
    found, distance, read = shard.search(query, 3, True)
    assert [(round(float(d), 6), shard.ids[i]) for i, d in zip(found, distance)] == plain(docs, query, 3, True)
    assert read < 0.1 * 3000


def test_terms_are_the_nonzero_slots_of_the_dense_vector(spark):
    texts = [(1, "One two two, three!"), (2, ""), (3, None), (4, "... ?!"), (5, "Ünï çödé 42 " * 50)]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    sparse = {r.id: {t.bucket: t.weight for t in r.terms} for r in S.sparse_terms(df, "doc_id", "text").collect()}
    for r in df.select("doc_id", hashed_embedding(F.col("text")).alias("v")).collect():
        assert sparse[r.doc_id] == {b: w for b, w in enumerate(r.v) if w}


def test_string_ids_empty_index_and_plan(spark, tmp_path):
    df = spark.createDataFrame([("b", "x y"), ("a", "x y"), ("c", "z")], "id string, text string")
    terms = S.sparse_terms(df, "id", "text")
    index = S.build_index(terms, str(tmp_path / "s"))
    asked = S.sparse_terms(df.where("id = 'c'").withColumn("text", F.lit("x")), "id", "text").withColumnRenamed("id", "query_id")
    hits = S.sparse_topk(index, asked, 2)
    assert [(r["rank"], r.id) for r in hits.orderBy("rank").collect()] == [(1, "a"), (2, "b")]
    plan = hits._jdf.queryExecution().toString()
    assert "array<float>" not in plan and "Cartesian" not in plan and "NestedLoop" not in plan
    empty = S.build_index(terms.limit(0), str(tmp_path / "e"))
    assert S.sparse_topk(empty, asked, 2, pad=True).count() == 0


def test_scoring_in_full_costs_less_than_reading_on(spark, tmp_path, monkeypatch):
    """Where most texts can still reach the k-th best, lists are read on instead of scoring them all."""
    rng = np.random.default_rng(6)
    docs = {}
    for i in range(2000):
        w = 1 + 0.05 * rng.random(40)
        docs[i] = {int(b): float(x) for b, x in zip(rng.choice(60, 40, replace=False), w / np.sqrt((w * w).sum()))}
    docs[2000] = {b: float(40 ** -0.5) for b in range(40)}
    index = S.build_index(frame(spark, docs), str(tmp_path / "index"), shard=10_000, part=64)
    shard = S.Shard()
    for r in index.table.orderBy("bucket", "part").collect():
        shard.add(r.asDict())
    scored = []
    scores = S.Shard.scores
    monkeypatch.setattr(S.Shard, "scores", lambda self, ids, query: scored.append(len(ids)) or scores(self, ids, query))
    query = {b: float(40 ** -0.5) for b in range(40)}
    found, distance, read = shard.search(query, 1, False)
    assert [(round(float(d), 6), shard.ids[i]) for i, d in zip(found, distance)] == plain(docs, query, 1, False) == [(0.0, 2000)]
    postings = sum(len(t.keys() & query.keys()) for t in docs.values())
    assert read + sum(scored) * 40 <= 1.05 * postings


def test_index_reads_its_texts_once(spark, tmp_path):
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    texts = spark.createDataFrame([(i, f"word{i} common") for i in range(50)], "doc_id long, text string")
    terms = S.sparse_terms(texts.mapInArrow(count, texts.schema), "doc_id", "text")
    index = S.build_index(terms, str(tmp_path / "index"), shard=20, n_docs=texts.count())
    assert index.shards == 3 and index.table.where("bucket = -1").agg({"n": "sum"}).first()[0] == 50 and seen.value == 50
