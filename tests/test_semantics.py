"""Layers 2-4: reference semantics against pandas/numpy on tiny frames,
properties of the chunkers and the store, and a planted-signal model."""

import os
import tempfile

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from parcelspark.operators import chunking as C
from parcelspark.operators import modeling as M
from parcelspark.operators import profile as P
from parcelspark.operators import questions as Q
from parcelspark.operators import retrieval as R
from parcelspark.operators import scoring as S
from parcelspark.functions.text import strip_ws, trim_ws
from parcelspark.operators.embedding import bucket_counts, hashed_embedding, token_buckets
from parcelspark.operators.split import seeded_split
from parcelspark.schemas import MD_SEPARATORS, PDF_SEPARATORS
from parcelspark.sources import store
from parcelspark.sources.documents import read_markdown_tree

from .conftest import SF_SMALL

def test_questions_are_searched_once_and_numbers_cast_where_there_are_digits(spark):
    ws = "\t\n\x0b\f\r \x1c\x1f\x85\xa0\u1680\u2000\u200a\u2028\u2029\u202f\u205f\u3000"
    rows = [(1, None), (2, ""), (3, ws), (4, "in \x1c\xa0\u2003Galle\u3000\xa0, 5 perches how much?"), (5, "in \u3000\u2003, why"),
            (6, "How much is a 1,200.5 sqft 3 bed 2 bath house in Kandy that is 7 years old?"),
            (7, "99999999999 beds, 1,,2 sq ft worth"), (8, ".")]
    df = Q.extract_request(spark.createDataFrame(rows, "question_id long, question string"))
    got = {r.question_id: tuple(r)[2:] for r in df.collect()}
    none = ("none", None, None, None, None, None, None)
    assert got[1] == got[2] == got[3] == (*none, "blank") and got[8] == (*none, "ready")
    assert got[4] == ("predict", 1360.0, None, None, "Galle", None, "bedrooms,bathrooms,age_years", "needs_fields")
    assert got[5] == ("retrieve", None, None, None, "", None, None, "ready")
    assert got[6] == ("predict", 1200.5, 3, 2, "Kandy", 7, "", "ready")
    assert got[7] == ("predict", 12.0, None, None, None, None, "bedrooms,bathrooms,location,age_years", "needs_fields")
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x10000)]))
    ends = spark.createDataFrame([(c + "x" + c,) for c in every], "s string")
    assert ends.where(trim_ws(F.col("s")) != strip_ws(F.col("s"))).count() == 0
    assert ends.where(Q.is_blank(F.substring("s", 1, 1)) != (strip_ws(F.substring("s", 1, 1)) == "")).count() == 0
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    for pattern in (Q.PRICE_CUE_PATTERN, Q.AREA_PATTERN, Q.BEDROOM_PATTERN, Q.AGE_PATTERN):
        assert plan.count(pattern) == 1


# --- profiling ---------------------------------------------------------------


def _frame(spark):
    pdf = pd.DataFrame({
        "x": [1.0, 2.0, None, 4.0, 10.0, 3.5],
        "y": [2.0, 4.1, 6.0, None, 19.0, 7.0],
        "c": [5.0, 5.0, 5.0, 5.0, 5.0, 5.0],
        "s": ["b", "a", "b", "a", None, "c"],
    })
    return pdf, spark.createDataFrame(pdf)


def test_describe_matches_pandas(spark):
    pdf, df = _frame(spark)
    got = {r.column_name: r for r in P.describe_numeric(df, ["x", "y"]).collect()}
    want = pdf[["x", "y"]].describe().transpose()
    for col in ["x", "y"]:
        assert got[col]["count"] == want.loc[col, "count"]
        for ours, theirs in [("mean", "mean"), ("std", "std"), ("min", "min"), ("p25", "25%"),
                             ("p50", "50%"), ("p75", "75%"), ("max", "max")]:
            assert got[col][ours] == pytest.approx(round(want.loc[col, theirs], 4), abs=1e-4)


def test_categorical_top_ties_to_smallest(spark):
    _, df = _frame(spark)
    row = P.describe_categorical(df, ["s"]).first()
    assert (row["count"], row["unique"], row["top"], row["freq"]) == (5, 3, "a", 2)


def test_pairwise_correlation_matches_pandas_and_constant_is_null(spark):
    pdf, df = _frame(spark)
    got = {(r.row_name, r.col_name): r.corr for r in P.correlation_matrix(df, ["x", "y", "c"]).collect()}
    want = pdf[["x", "y", "c"]].corr()
    assert got[("x", "y")] == pytest.approx(want.loc["x", "y"], abs=1e-6)
    assert got[("y", "x")] == got[("x", "y")]
    assert got[("x", "x")] == 1.0
    assert got[("x", "c")] is None and got[("c", "c")] is None


def test_histogram_matches_numpy(spark):
    rng = np.random.default_rng(0)
    vals = rng.normal(size=500).tolist()
    df = spark.createDataFrame([(v,) for v in vals], "v double")
    got = [r.n for r in P.histogram(df, "v", 30).orderBy("bin").collect()]
    want, _ = np.histogram(vals, bins=30)
    assert got == want.tolist()


def test_mode_ties_to_smallest_like_pandas(spark):
    df = spark.createDataFrame([("a", "x"), ("a", "y"), ("b", "y"), ("b", "x"), ("b", "x")],
                               "district string, area string")
    got = {r.district: r.modal_area for r in P.grouped_mode(df, "district", "area").collect()}
    assert got == {"a": "x", "b": "x"}


# --- split -------------------------------------------------------------------


def test_split_independent_of_partitioning(spark):
    df = spark.range(5000).withColumnRenamed("id", "listing_id")
    a = {r.listing_id for r in seeded_split(df, "listing_id").where("is_test").collect()}
    b = {r.listing_id for r in seeded_split(df.repartition(7), "listing_id").where("is_test").collect()}
    assert a == b
    assert 0.17 < len(a) / 5000 < 0.23


# --- location resolution and status --------------------------------------------

VOCAB = ["Colombo", "Galle", "Kandy", "Kandy East"]


@pytest.mark.parametrize("text,want", [
    ("Colombo", "Colombo"), (" in colombo District", "Colombo"), ("galle or kandy", "Galle"),
    ("kandy east", "Kandy East"), ("Atlantis", None), ("", None), ("  KANDY  ", "Kandy"),
])
def test_resolve_location(spark, text, want):
    df = spark.createDataFrame([(text,)], "location string")
    assert df.select(S.resolve_location(F.col("location"), VOCAB)).first()[0] == want


def test_status_precedence(spark):
    li = spark.createDataFrame([("Colombo", "C1", 10.0), ("Kandy", "K1", 20.0)],
                               "district string, area string, perch double")
    ctx = S.ScoringContext(VOCAB, {"kitchen_area_sqft": 100.0}, {"area": "C1"}, (1.0, 50.0),
                           li.groupBy("district").agg(F.mode("area", True).alias("modal_area")))
    req = spark.createDataFrame([
        (1, -1.0, 0, 2, "Atlantis", -3), (2, -1.0, 3, 2, "Colombo", 10), (3, 2700.0, 3, 2, "Kandy", 10),
        (4, 9000000.0, 3, 2, "Colombo", 10)],
        "request_id long, area_sqft double, bedrooms int, bathrooms int, location string, age_years int")
    got = {r.request_id: r.status for r in S.request_status(req, ctx).collect()}
    assert got == {1: "unknown_location", 2: "invalid_input", 3: "ok", 4: "ok"}
    feats = {r.request_id: r for r in S.request_features(req, ctx).collect()}
    assert feats[4].out_of_range and not feats[3].out_of_range
    assert feats[3].area == "K1" and feats[3].year_built == 2016
    leaked = S.ScoringContext(VOCAB, {}, {}, (1.0, 50.0), ctx.modal_area,
                              feature_columns=["perch", "price_lkr"])
    assert {r.status for r in S.request_status(req, leaked).collect()} == {"invalid_model"}


# --- splitting properties ------------------------------------------------------


def _texts():
    rng = np.random.default_rng(1)
    words = ["alpha", "beta", "gamma.", "delta", "eps", "zeta."]
    out = ["", "x" * 99, "y" * 100, "w " * 500, "v" * 1001, "u" * 5000]
    for n in (50, 200, 800, 3000):
        out.append(" ".join(rng.choice(words, size=n)))
    return out


@pytest.mark.parametrize("text", _texts())
def test_recursive_split_properties(text):
    chunks = C.split_recursive(text, PDF_SEPARATORS, 1000, 150)
    assert all(len(c) <= 1000 for c in chunks)
    pos = 0
    for c in chunks:  # every chunk is a substring, in order (overlap may step back)
        found = text.find(c, max(0, pos - 1000))
        assert found >= 0
        pos = found + len(c)
    covered = "".join(chunks).replace(" ", "")
    assert set(text.replace(" ", "")) <= set(covered)
    assert sum(len(c.replace(" ", "")) for c in chunks) >= len(text.replace(" ", ""))


def test_markdown_split_drops_short_and_numbers_after_filter(spark):
    text = "## A\nshort\n\n### B\n" + ("word " * 400) + "\n\ntiny"
    files = spark.createDataFrame([("docs/a.md", text)], "path string, text string")
    split = C.split_markdown_files(files)
    chunks = C.chunk_markdown(split).orderBy("chunk").collect()
    assert [c.chunk for c in chunks] == list(range(len(chunks)))
    assert all(c.chars >= 30 for c in chunks)
    assert chunks[0].id == "docs__a-c0"
    assert C.markdown_report(split).first().skipped >= 1


def test_markdown_pieces_leave_in_batches_of_bounded_size(spark):
    text = "## A\nshort\n\n" + "word " * 40_000
    files = [(f"docs/{i}.md", text) for i in range(16)] + [("none.md", None), ("empty.md", "")]
    batch = pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*files)], ["path", "text"])
    args = (MD_SEPARATORS, 300, 50, 30, C.token_length, C.token_length)
    out = list(C.file_pieces(iter([batch, batch.slice(0, 0), batch.slice(15)]), *args))
    assert [p for b in out for p in b.column("path").to_pylist()] == [p for p, _ in files + files[15:]]
    sizes = [sum(len(p) for row in b.column("kept").to_pylist() for p in row) for b in out]
    assert max(sizes) <= C.SPLIT_BATCH_CHARS + 1.5 * len(text) < sum(sizes)
    chunks = C.chunk_markdown(C.split_markdown_files(spark.createDataFrame(files, "path string, text string")))
    plan = chunks._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "ArrowEvalPython" not in plan  # one Python worker a task
    by_udf = C.chunk_markdown(C.split_markdown_files(spark.createDataFrame(files[:1], "path string, text string"), measure=None),
                              C.token_length, window=299)
    assert sorted(map(tuple, by_udf.collect())) == sorted(
        tuple(r) for r in C.chunk_markdown(C.split_markdown_files(spark.createDataFrame(files[:1], "path string, text string")),
                                           window=299).collect())


def test_markdown_tree_scan(spark):
    root = tempfile.mkdtemp(prefix="md-")
    os.makedirs(f"{root}/nested")
    files = {"notes.md": b"# Notes\n" + b"text " * 50, "nested/notes.md": b"## Same name\n" + b"more " * 50,
             "nested__notes.md": b"collides " * 20, "empty.md": b"", "bad.md": b"ok \xff\xfe bytes " * 10,
             "skip.txt": b"not markdown"}
    for name, data in files.items():
        with open(f"{root}/{name}", "wb") as fh:
            fh.write(data)
    df = read_markdown_tree(spark, root)
    got = {r.path: r.text for r in df.collect()}
    assert set(got) == {"notes.md", "nested/notes.md", "nested__notes.md", "bad.md", "empty.md"}
    assert got["empty.md"] == ""
    report = {r.path: r.chunks for r in C.markdown_report(C.split_markdown_files(df.select("path", "text"))).collect()}
    assert report["empty.md"] == 0
    assert "�" in got["bad.md"]
    ids = {r.id for r in C.chunk_markdown(C.split_markdown_files(df.select("path", "text"))).collect()}
    assert "nested__notes-c0" in ids  # both nested/notes.md and nested__notes.md map here


def test_document_metadata_rules(spark):
    names = ["Real_Estate_Market_Analysis_2023_Q4.pdf", "real_estate_market_analysis_2024_q1_v2.pdf",
             "FSR_2022.pdf", "fsr_2021_Summary.pdf", "notes.pdf", "fsr_20.pdf"]
    df = spark.createDataFrame([(n,) for n in names], "source string")
    got = {r.source: r.m for r in df.select("source", C.document_metadata(F.col("source")).alias("m")).collect()}
    assert got[names[0]].title == "Real Estate Market Analysis 2023 Q4" and got[names[0]].quarter == 4
    assert got[names[1]].period == "2024 Q1"
    assert got[names[2]].doc_type == "financial_stability_review" and got[names[2]].quarter == 0
    assert got[names[3]].title == "Financial Stability Review 2021 (Summary)"
    assert got[names[4]].doc_type == "other" and got[names[4]].title == "notes"
    assert got[names[5]].doc_type == "other" and got[names[5]].year == 0


# --- embedding and retrieval -----------------------------------------------------


def test_python_and_sql_hashing_agree(spark):
    texts = ["Hello, World! hello 42", "Ünïcode straße ÉTÉ", ""]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    rows = df.select(token_buckets(F.col("t")).alias("b"), hashed_embedding(F.col("t")).alias("e")).collect()
    for t, r in zip(texts, rows):
        counts = np.bincount(np.asarray(r.b, dtype=np.int64), minlength=256).astype(float)
        norm = np.linalg.norm(counts)
        want = counts / norm if norm else counts
        assert np.allclose(np.asarray(r.e), want, atol=1e-6)
        assert np.allclose(bucket_counts(t, 256, {}), want, atol=1e-6)


def test_exact_topk_equals_brute_force(spark):
    emb = spark.read.parquet(f"{SF_SMALL}/embeddings.parquet")
    pdf = emb.toPandas()
    mat = np.stack(pdf.embedding.map(lambda v: np.asarray(v, dtype=np.float64)))
    ids = pdf.vec_id.to_numpy()
    got = R.exact_topk(emb, emb.select(F.col("vec_id").alias("query_id"), "embedding"), 3, doc_id="vec_id")
    got = {(r.query_id, r.rank): r.id for r in got.collect()}
    d = np.round(1.0 - mat @ mat.T, 6)
    for qi, q in enumerate(ids):
        order = sorted(range(len(ids)), key=lambda j: (d[qi, j], ids[j]))[:3]
        assert [got[(q, k + 1)] for k in range(3)] == [ids[j] for j in order]


def test_topk_of_union_equals_topk_of_per_collection_topk(spark):
    emb = spark.read.parquet(f"{SF_SMALL}/embeddings.parquet")
    docs = emb.withColumn("coll", F.when(F.col("vec_id") % 2 == 0, "a").otherwise("b"))
    q = emb.select(F.col("vec_id").alias("query_id"), "embedding")
    per = R.exact_topk(docs, q, 3, doc_id="vec_id", group="coll").withColumnRenamed("coll", "collection")
    merged = R.merge_collections(per, {"a": 0, "b": 1}, 3)
    whole = R.exact_topk(emb, q, 3, doc_id="vec_id")
    a = {(r.query_id, r.rank, r.id) for r in merged.collect()}
    b = {(r.query_id, r.rank, r.id) for r in whole.collect()}
    assert a == b


def test_exact_topk_over_many_blocks_equals_one_block(spark):
    """Queries and vectors cut into several blocks give the same hits as one block of each."""
    emb = spark.read.parquet(f"{SF_SMALL}/embeddings.parquet")
    q = emb.select(F.col("vec_id").alias("query_id"), "embedding")
    one = {(r.query_id, r.rank, r.id, r.distance) for r in R.exact_topk(emb, q, 3, doc_id="vec_id").collect()}
    got = R.exact_topk(emb, q, 3, doc_id="vec_id", vector_block=53).collect()
    assert {(r.query_id, r.rank, r.id, r.distance) for r in got} == one


def test_distance_is_cosine_whatever_the_length(spark):
    docs = spark.createDataFrame([(1, [2.0, 0.0]), (2, [0.6, 0.8]), (3, [0.0, 0.0])], "id long, embedding array<double>")
    q = spark.createDataFrame([(0, [3.0, 4.0])], "query_id long, embedding array<double>")
    got = [(r.id, r.distance) for r in R.exact_topk(docs, q, 3).orderBy("rank").collect()]
    assert got == [(2, 0.0), (1, 0.4), (3, 1.0)]


def test_search_without_rows_and_without_collections(spark):
    docs = spark.createDataFrame([], "id long, embedding array<double>")
    q = spark.createDataFrame([(0, "what", [3.0, 4.0]), (1, " ", None)], "query_id long, query string, embedding array<double>")
    assert R.exact_topk(docs, q, 3).count() == 0
    assert {r.query_id: r.status for r in R.answers(q, None).collect()} == {0: "no_collections", 1: "blank"}


def test_filter_of_a_stored_collection_reads_only_its_folders(spark):
    from parcelspark.plans.retrieval_queries import collections
    housing = collections(spark, SF_SMALL)["housing_docs"].where("doc_type = 'market_analysis' AND year >= 2020")
    plan = housing._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(doc_type" in plan and housing.count() > 0


def test_last_of_equal_ids_wins(spark, tmp_path):
    rows = [("a", f"new{i}", i) for i in range(4)] + [("a", "old", -1)]
    df = spark.createDataFrame(rows, "id string, text string, at int")
    store.upsert(spark, str(tmp_path), "c", df, 4, order_by="at")
    assert [tuple(r) for r in store.read_collection(spark, str(tmp_path), "c").select("id", "text").collect()] == [("a", "new3")]


# --- store ---------------------------------------------------------------------


def test_upsert_idempotent_and_rebuild_drops_stale(spark):
    root = tempfile.mkdtemp(prefix="store-")
    mk = lambda rows: spark.createDataFrame(rows, "id string, text string, embedding array<float>")
    v = [0.6, 0.8]
    store.upsert(spark, root, "c", mk([("a", "1", v), ("b", "1", v)]), 2)
    store.upsert(spark, root, "c", mk([("b", "2", v), ("c", "2", v)]), 2)
    once = sorted(tuple(r) for r in store.read_collection(spark, root, "c").select("id", "text").collect())
    store.upsert(spark, root, "c", mk([("b", "2", v), ("c", "2", v)]), 2)
    twice = sorted(tuple(r) for r in store.read_collection(spark, root, "c").select("id", "text").collect())
    assert once == twice == [("a", "1"), ("b", "2"), ("c", "2")]
    store.rebuild(spark, root, "c", mk([("c", "3", v)]), 2)
    assert [tuple(r) for r in store.read_collection(spark, root, "c").select("id", "text").collect()] == [("c", "3")]
    with pytest.raises(ValueError):
        store.upsert(spark, root, "c", mk([("d", "x", v)]), 3)  # different embedding space
    assert list(store.open_collections(spark, root, ["c", "missing"])) == ["c"]


# --- messages ------------------------------------------------------------------


def test_flatten_content_shapes(spark):
    rows = [('"plain text"',), ('[{"type":"text","text":"a"},{"type":"image"},{"type":"text","text":"b "}]',),
            ("[]",), ("42",), ('["a"]',), ('["a", {"type":"text","text":"kept"}, 3, null]',)]
    df = spark.createDataFrame(rows, "content string")
    got = [r[0] for r in df.select(Q.flatten_content(F.col("content"))).collect()]
    assert got == ["plain text", "ab", "", "42", "", "kept"]


def test_routing_and_extraction(spark):
    qs = spark.createDataFrame([
        (1, "What would a 1800 sqft, 3 bedroom, 2 bathroom house in Colombo that is 10 years old cost?"),
        (2, "How have house prices in the Colombo district changed recently? Explain."),
        (3, "Estimate the price of a 5 year old 2200 sqft 4 bed 3 bath house in Kandy, and explain why."),
        (4, "How much is a 10 perches house in Galle?"), (5, "   "), (6, None)],
        "question_id long, question string")
    got = {r.question_id: r for r in Q.extract_request(qs).collect()}
    assert got[1].route == "predict" and got[1].status == "ready"
    assert (got[1].area_sqft, got[1].bedrooms, got[1].bathrooms, got[1].location, got[1].age_years) == \
        (1800.0, 3, 2, "Colombo", 10)
    assert got[2].route == "retrieve"
    assert got[3].route == "both" and got[3].location == "Kandy" and got[3].age_years == 5
    assert got[4].area_sqft == 2720.0 and got[4].status == "needs_fields"
    assert got[4].missing == "bedrooms,bathrooms,age_years"
    assert got[5].status == "blank" and got[6].status == "blank"


# --- planted-signal model --------------------------------------------------------


def _planted(spark, n=4000):
    h = lambda salt: (F.xxhash64(F.col("listing_id"), F.lit(salt)) % 1_000_000).cast("double") / 1e6
    districts = F.array(*[F.lit(d) for d in ["Colombo", "Gampaha", "Galle", "Kandy", "Matara"]])
    df = spark.range(n).withColumnRenamed("id", "listing_id").select(
        "listing_id",
        (F.lit(4.0) + F.abs(h(1)) * 36).alias("perch"),
        (F.lit(1) + (F.abs(h(2)) * 6).cast("int")).alias("bedrooms"),
        (F.lit(1) + (F.abs(h(3)) * 5).cast("int")).alias("bathrooms"),
        (F.lit(35.0) + F.abs(h(4)) * 215).alias("kitchen_area_sqft"),
        F.element_at(districts, (F.abs(h(5)) * 5).cast("int") + 1).alias("district"),
        F.lit("A").alias("area"), F.lit(1).alias("parking_spots"), F.lit("Yes").alias("has_garden"),
        F.lit("No").alias("has_ac"), F.lit("pipe").alias("water_supply"), F.lit("grid").alias("electricity"),
        F.lit(1).alias("floors"), (F.lit(1980) + (F.abs(h(6)) * 45).cast("int")).alias("year_built"))
    effect = F.when(F.col("district") == "Colombo", 5e6).otherwise(0.0)
    noise = (F.abs(h(7)) - 0.5) * 2e6
    return df.withColumn("price_lkr", F.lit(1e6) * F.col("perch") + F.lit(2e6) * F.col("bedrooms")
                         + F.lit(1e6) * F.col("bathrooms") + effect + noise)


def test_planted_signal_linear_r2_and_leak_guard(spark):
    split = seeded_split(_planted(spark), "listing_id")
    models = M.fit_models(split, num_trees=5)
    scores = {r.model: r for r in M.compare_models(split, models).collect()}
    assert scores["Linear Regression"].r2 > 0.95
    assert M.best_model(M.compare_models(split, models)).first().model == "Linear Regression"
    with pytest.raises(ValueError):
        M.feature_stages(numeric=["perch", "price_lkr"])


def test_unknown_category_is_all_zero_block(spark):
    split = seeded_split(_planted(spark, 500), "listing_id")
    model = M.fit_models(split, num_trees=2)["Linear Regression"]
    rows = M.training_rows(split).limit(1).withColumn("district", F.lit("Atlantis"))
    known = M.training_rows(split).limit(1)
    feats_u = M.encoded_long(model, rows.withColumn("is_test", F.lit(True)))
    feats_k = M.encoded_long(model, known)
    assert feats_k.count() == feats_u.count() + 1


def test_distributed_exact_quantiles_match_numpy_with_hot_value(spark):
    from parcelspark.operators.quantiles import exact_quantiles
    rng = np.random.default_rng(3)
    vals = np.concatenate([rng.exponential(1000.0, 4000), np.full(2000, 42.0), rng.normal(0, 5, 1000)])
    df = spark.createDataFrame([(float(v), float(v) * 2 if i % 3 else None) for i, v in enumerate(vals)],
                               "a double, b double")
    probs = [0.0, 0.1, 0.25, 0.5, 0.75, 0.99, 1.0]
    got = exact_quantiles(df, ["a", "b"], probs, bins=8, finish_at=50)   # forces several rounds
    b = np.array([float(v) * 2 for i, v in enumerate(vals) if i % 3])
    for p in probs:
        assert got[("a", p)] == pytest.approx(np.quantile(vals, p), rel=1e-12, abs=1e-9)
        assert got[("b", p)] == pytest.approx(np.quantile(b, p), rel=1e-12, abs=1e-9)


def test_exact_quantiles_with_infinities(spark):
    from parcelspark.operators.quantiles import exact_quantiles
    vals = [float(i) for i in range(40)] + [float("inf"), float("-inf"), float("nan")]
    df = spark.createDataFrame([(v,) for v in vals], "a double")
    got = exact_quantiles(df, ["a"], [0.0, 0.5, 1.0], bins=8, finish_at=5)
    assert got == {("a", 0.0): float("-inf"), ("a", 0.5): 19.5, ("a", 1.0): float("inf")}


# --- written intermediates and repeated questions ------------------------------

def test_materialize_writes_under_checkpoint_dir(spark):
    from parcelspark.session import ensure_checkpoint_dir, materialize
    src = spark.range(0, 1000).withColumn("x", F.col("id") * 2).coalesce(1)
    out = materialize(src, "unit")
    base = ensure_checkpoint_dir(spark).rstrip("/").split(":")[-1]
    files = out.inputFiles()                                   # reads the written table only
    assert files and all(base in f for f in files)
    assert sorted(tuple(r) for r in out.collect()) == [(i, 2 * i) for i in range(1000)]


def test_search_of_repeated_texts_equals_search_of_each_text(spark):
    """Hits are computed per distinct query text and joined back: every
    question asking the same text gets the same hits as that text alone."""
    from parcelspark.plans.retrieval_queries import collections, search
    bench = spark.read.parquet(f"{SF_SMALL}/benchmark.parquet").select("item_id", "text").limit(5)
    texts = [r.text for r in bench.collect()]
    rows = [(i, texts[i % len(texts)]) for i in range(3 * len(texts))] + [(99, None)]
    queries = spark.createDataFrame(rows, "query_id long, query string")
    colls = collections(spark, SF_SMALL)
    hits = search(queries, colls).select("query_id", "rank", "collection", "id", "distance").collect()
    by_q = {}
    for h in hits:
        by_q.setdefault(h.query_id, []).append((h.rank, h.collection, h.id, h.distance))
    assert 99 not in by_q
    unique = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "query_id long, query string")
    alone = {}
    for h in search(unique, colls).select("query_id", "rank", "collection", "id", "distance").collect():
        alone.setdefault(h.query_id, []).append((h.rank, h.collection, h.id, h.distance))
    for j in range(3 * len(texts)):
        assert sorted(by_q[j]) == sorted(alone[j % len(texts)])


# --- long questions, other scripts, failed writes ------------------------------

def test_route_and_location_of_long_and_broken_questions(spark):
    from parcelspark.operators import questions as q
    text = "What would a house " + "with a view " * 50 + "\nin Colombo cost, and is now a good time to buy?"
    row = spark.createDataFrame([(text,)], "t string").select(
        F.col("t").rlike(q.PRICE_CUE_PATTERN).alias("price"), F.col("t").rlike(q.REPORT_CUE_PATTERN).alias("report"),
        F.regexp_extract("t", q.LOCATION_PATTERN, 1).alias("place")).first()
    assert (row.price, row.report, row.place) == (True, True, "Colombo")


def test_tokens_of_any_script_agree_between_engines(spark):
    import re

    from parcelspark.operators.embedding import TOKEN_WORD, tokens
    texts = ["für straße été", "Привет, мир 12", "a_b-c d́e", "東京 2024年"]
    got = [r.k for r in spark.createDataFrame([(t,) for t in texts], "t string").select(tokens(F.col("t")).alias("k")).collect()]
    assert got == [re.findall(TOKEN_WORD, t.lower()) for t in texts]
    assert all(got)


def test_a_failed_write_does_not_block_a_collection(spark, tmp_path):
    from parcelspark.sources import store
    (tmp_path / "c" / "v1").mkdir(parents=True)
    df = spark.createDataFrame([("a", "x")], "id string, text string")
    assert store.upsert(spark, str(tmp_path), "c", df, 4) == 1
    assert [tuple(r) for r in store.read_collection(spark, str(tmp_path), "c").collect()] == [("a", "x")]


def test_profiles_take_nan_as_missing(spark):
    df = spark.createDataFrame([(1.0, "a"), (2.0, "a"), (float("nan"), "b"), (4.0, "b")], "perch double, k string")
    d = P.describe_numeric(df, ["perch"]).first()
    want = pd.Series([1.0, 2.0, np.nan, 4.0]).describe()
    assert (d["count"], d["max"], d["p50"]) == (3, 4.0, 2.0)
    assert d["mean"] == pytest.approx(want["mean"], abs=1e-4) and d["std"] == pytest.approx(want["std"], abs=1e-4)
    got = {(r.column_name, r.stat): r.num_value for r in P.default_values(df, ["perch"], ["k"], "perch").collect()}
    assert got["perch", "max"] == 4.0 and got["perch", "min"] == 1.0
    assert P.correlation_matrix(df, ["perch"]).first().corr == 1.0


# --- CSV contract, large vocabularies ------------------------------------------

def test_csv_listings_contract(spark, tmp_path):
    from parcelspark.sources.listings_csv import TRAINING_REQUIRED, read_listings_csv
    with pytest.raises(FileNotFoundError, match="price_lkr"):
        read_listings_csv(spark, str(tmp_path / "absent.csv"))
    path = tmp_path / "li.csv"
    path.write_text('perch,bedrooms,bathrooms,district,year_built,price_lkr,note\n'
                    '1.5,3.0,2,"a ""b"", c",2001,10,x\nNA,NaN,n/a,None,,-nan,NULL\n1,3.7,2e0,d,2001.0,1e3,y\n')
    got = [tuple(r) for r in read_listings_csv(spark, str(path)).collect()]
    assert got == [(1.5, 3, 2, 'a "b", c', 2001, 10.0, "x"), (None,) * 7, (1.0, None, 2, "d", 2001, 1000.0, "y")]
    with pytest.raises(ValueError, match="has_garden"):
        read_listings_csv(spark, str(path), TRAINING_REQUIRED)


def test_join_form_of_locations_equals_array_form(spark):
    texts = ["Colombo", " in colombo District", "galle or kandy", "kandy east", "Atlantis", "", "  KANDY  ", None, "xkandyx"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, location string")
    vocab = spark.createDataFrame([(v,) for v in VOCAB], "district string")
    want = df.select("i", S.resolve_location(F.col("location"), VOCAB).alias("d")).collect()
    got = S.resolve_location_join(df, vocab).select("i", F.col("resolved_district").alias("d")).collect()
    assert sorted(got) == sorted(want) or sorted(map(repr, got)) == sorted(map(repr, want))


def test_a_vocabulary_too_large_for_a_plan(spark):
    train = spark.range(200_000).select(F.concat(F.lit("Town-"), F.lpad(F.col("id").cast("string"), 6, "0")).alias("district"))
    ctx = S.location_context(train, 2026)
    assert ctx.vocabulary is None
    req = spark.createDataFrame([(1, 10.0, 1, 1, "in town-123456 north", 1), (2, 10.0, 1, 1, "Town-1", 1)],
                                "request_id long, area_sqft double, bedrooms int, bathrooms int, location string, age_years int")
    got = {r.request_id: (r.resolved_district, r.status) for r in
           S.request_status(req, ctx).select("request_id", "resolved_district", "status").collect()}
    assert got == {1: ("Town-123456", "ok"), 2: (None, "unknown_location")}


def test_alignment_and_leak_check_of_a_bundle(spark):
    df = spark.createDataFrame([(1, 2, 3.0)], "x int, id int, perch double")
    assert [tuple(r) for r in M.align_columns(df, ["perch", "bedrooms"], keep=["id"]).collect()] == [(2, 3.0, 0.0)]
    with pytest.raises(ValueError):
        M.check_no_leak(["perch"], ["district", "price_lkr"])
