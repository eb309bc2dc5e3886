"""The split of exact size, and the search by codes with bounds."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from parcelspark.operators import retrieval as R
from parcelspark.operators import split


@pytest.mark.parametrize("n", [0, 1, 2, 3, 4, 5, 6, 99, 1000, 1001])
def test_exact_split_has_the_exact_size(spark, n):
    df = spark.range(n).withColumnRenamed("id", "key")
    got = split.exact_split(df, "key")
    assert got.count() == n and got.where("is_test").count() == math.ceil(0.2 * n)
    want = sorted((r.h, r.key) for r in df.withColumn("h", split.split_hash("key")).collect())[:math.ceil(0.2 * n)]
    assert {r.key for r in got.where("is_test").collect()} == {k for _, k in want}


def test_exact_split_breaks_ties_by_key_and_ignores_null_keys(spark, monkeypatch):
    monkeypatch.setattr(split, "split_hash", lambda key, seed=42: F.lit(7).cast("bigint"))
    df = spark.createDataFrame([(f"k{i:02d}",) for i in range(20)] + [(None,)], "key string")
    got = split.exact_split(df.repartition(5), "key")
    assert sorted(r.key for r in got.where("is_test").collect()) == [f"k{i:02d}" for i in range(4)]
    assert got.where("key IS NULL AND NOT is_test").count() == 1


def vectors(spark, v, name):
    return spark.createDataFrame([(int(i), [float(a) for a in x]) for i, x in enumerate(v)], f"{name} long, embedding array<double>")


def test_coded_search_equals_the_exact_one(spark):
    rng = np.random.default_rng(2)
    v = rng.normal(size=(700, 16)) * rng.uniform(0.1, 9, size=(700, 1))
    v[100:110] = v[100]  # ties
    v[200] = 0.0
    q = np.concatenate([rng.normal(size=(40, 16)), v[95:105], np.zeros((1, 16))])
    docs, asked = vectors(spark, v, "id"), vectors(spark, q, "query_id")
    index = R.build_cells(docs, n_cells=6)
    exact = {(r.query_id, r["rank"]): (r.id, r.distance) for r in R.exact_topk(docs, asked, 4).collect()}
    got = {(r.query_id, r["rank"]): (r.id, r.distance) for r in R.coded_topk(index, asked, 4, query_block=20, vector_block=100).collect()}
    assert got == exact and len(got) == 4 * len(q)
    # The query without a direction is at distance 1 of everything; of the others few vectors are read.
    read = R.coded_candidates(index, asked.where(f"query_id <> {len(q) - 1}"), 4).count()
    assert read < 0.1 * len(v) * (len(q) - 1)


def test_coded_search_of_fewer_vectors_than_asked_for(spark):
    docs, asked = vectors(spark, np.eye(3), "id"), vectors(spark, np.eye(3)[:2], "query_id")
    index = R.build_cells(docs, n_cells=2)
    assert R.coded_topk(index, asked, 5).count() == 6 and R.coded_topk(index, asked.limit(0), 5).count() == 0


def test_blocks_of_a_large_table_are_larger():
    """Queries are copied to every block: of 20 million vectors there are 611 blocks, not 4,883 of 4,096."""
    assert [R._streamed_blocks(n) for n in (0, 1, 4096, 5000, 200_000)] == [1, 1, 1, 2, 49]
    assert R._streamed_blocks(20_000_000) == 611
    assert all(-(-n // R._streamed_blocks(n)) <= R.LARGE_BLOCK for n in (10**5, 10**6, 10**7, 10**9))


def test_candidates_of_single_precision_lose_nothing():
    """Rows that lie closer together than single precision tells apart, and copies."""
    rng = np.random.default_rng(2)
    base = rng.normal(size=256)
    emb = np.concatenate([base + 1e-6 * rng.normal(size=(300, 256)), np.tile(base, (200, 1)), rng.normal(size=(1500, 256))])
    emb /= np.sqrt((emb * emb).sum(1, keepdims=True))
    ids, q = rng.permutation(len(emb)), np.concatenate([emb[:7], emb[300:302], emb[600:640]])
    got = R._local_topk(ids, emb, np.arange(len(q)), q, 3)
    micro = np.rint((1.0 - q @ emb.T) * 10 ** R.DIGITS)
    for i in range(len(q)):
        assert got[got.query_id == i].id.tolist() == ids[np.lexsort((ids, micro[i]))[:3]].tolist()


def test_totals_of_one_collection_ingest_no_other(spark, monkeypatch):
    from parcelspark.plans import QUERIES, retrieval_queries

    def unwanted(*args, **kwargs):
        raise AssertionError("the other collection is ingested")

    monkeypatch.setattr(retrieval_queries, "input_version", lambda *args: "of-a-test")
    monkeypatch.setattr(retrieval_queries, "markdown_collection", unwanted)
    assert QUERIES["corpus_totals"](spark, "/root/testdata/sf0.001").first().total_chunks > 0
    assert QUERIES["retrieve_preview"](spark, "/root/testdata/sf0.001").count() == 3


def test_single_precision_vectors_are_kept_as_they_are():
    import pyarrow as pa
    rng = np.random.default_rng(3)
    x = rng.random((3000, 8)).astype(np.float32)
    x[1] = 0
    x[2:1000] = x[2:1000] / np.linalg.norm(x[2:1000].astype(np.float64), axis=1, keepdims=True)
    column = pa.array(x.tolist(), pa.list_(pa.float32()))
    raw, norm = R._raw_vectors(column)
    assert raw.dtype == np.float32 and (raw == x).all() and norm[1] == 1.0 and (norm[2:1000] == 1.0).all()
    unit, ids, q = R._vectors(column), np.arange(3000), R._vectors(column)[:20]
    want, got = (R._block_topk(R._Block.of(ids, *v), ids[:20], q, 3) for v in ((unit, np.ones(3000)), (raw, norm)))
    assert want.equals(got)


def test_split_udf_hands_on_bounded_batches(spark, monkeypatch):
    from parcelspark.operators import chunking as C
    texts = ["a b c. " * 40, None, "", "x" * 30, "w " * 500]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    from pyspark.util import PythonEvalType
    monkeypatch.setattr(C, "SPLIT_BATCH_CHARS", 50)
    assert C.recursive_splitter(["\n"], 20, 5).evalType == PythonEvalType.SQL_SCALAR_ARROW_UDF  # no batch of Python strings
    got = {r.i: r.p for r in df.select("i", C.recursive_splitter(["\n", " ", ""], 20, 5)("t").alias("p")).collect()}
    assert got == {i: C.split_recursive(t or "", ["\n", " ", ""], 20, 5) for i, t in enumerate(texts)}
