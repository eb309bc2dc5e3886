"""Embedding and retrieval queries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from ..operators import retrieval as R
from ..operators import sparse_search as S
from ..operators.chunking import corpus_totals
from ..operators.embedding import PROJECTED, embed_table, hashed_embedding, model_embedding, projection_model, sparse_weights
from ..operators.ingest import markdown_collection, page_collection
from ..schemas import COLLECTION_ORDER, HASH_BUCKETS, SMOKE_QUESTION, TOP_K
from ..session import materialize, scratch_path
from ..sources import store
from ..sources.documents import markdown_from_documents, pages_from_documents
from ..sources.tables import input_version, read_table
from .registry import ORACLE, register
from .sql_common import with_ctes
from .text_queries import DOCFILES_CTE, META_CTE, NORM_PAGES_CTE, PAGES_CTE, norm_sql


def weights_ctes(name: str, source: str, id_expr: str, text_expr: str) -> list[str]:
    """DuckDB twin of the hashed embedder: long-form unit weights ``{name}_w``."""
    return [
        f"""{name}_tok AS (SELECT {id_expr} AS id,
              unnest(regexp_split_to_array(lower({text_expr}), '[^\\p{{L}}\\p{{N}}]+')) AS t FROM {source})""",
        f"""{name}_cnt AS (SELECT id, CAST(('0x' || substr(md5(t), 1, 8))::BIGINT % {HASH_BUCKETS} AS INTEGER)
              AS bucket, count(*) AS cnt FROM {name}_tok WHERE t <> '' GROUP BY 1, 2)""",
        f"""{name}_w AS (SELECT c.id, c.bucket, CAST(CAST(c.cnt / n.norm AS FLOAT) AS DOUBLE) AS w
              FROM {name}_cnt c JOIN (SELECT id, sqrt(sum(cnt * cnt)) AS norm FROM {name}_cnt GROUP BY id) n
              ON n.id = c.id)""",
    ]


def pairs_cte(name: str, qname: str, dname: str, q_ids: str, d_ids: str) -> str:
    """All (query, doc) distances; pairs sharing no bucket are at distance 1."""
    return f"""{name} AS (
  SELECT q.id AS query_id, d.id, 1.0 - coalesce(s.dot, 0.0) AS raw_distance
  FROM (SELECT {q_ids}) q CROSS JOIN (SELECT {d_ids}) d
  LEFT JOIN (SELECT qw.id AS query_id, dw.id, sum(qw.w * dw.w) AS dot
             FROM {qname}_w qw JOIN {dname}_w dw ON dw.bucket = qw.bucket GROUP BY 1, 2) s
    ON s.query_id = q.id AND s.id = d.id
)"""


def _benchmark_queries(spark, sf_dir):
    return read_table(spark, sf_dir, "benchmark").select(
        F.col("item_id").alias("query_id"), F.col("text").alias("query"))


def _embedded(queries):
    return queries.withColumn("embedding", hashed_embedding(F.col("query")))


# --- T7 / T8 -----------------------------------------------------------------

@register("hashed_embeddings", with_ctes(*weights_ctes("d", "documents", "doc_id", "text")) + """
SELECT id AS doc_id, bucket, round(w, 6) AS weight FROM d_w
""")
def hashed_embeddings(spark, sf_dir):
    """T7 + T8: hashed term-frequency embedding of every document, long form."""
    docs = embed_table(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return sparse_weights(docs, "doc_id")


@register("projected_embeddings", with_ctes(
    *weights_ctes("d", "documents", "doc_id", "text")[:2],
    f"""signs AS (SELECT b AS bucket, j, 1 - 2 * (('0x' || substr(md5(b || ':' || j), 1, 8))::BIGINT % 2) AS sign
          FROM range({HASH_BUCKETS}) r(b), range({PROJECTED}) s(j))""",
    "v AS (SELECT id, j, sum(cnt * sign) AS v FROM d_cnt JOIN signs USING (bucket) GROUP BY id, j)") + """
SELECT v.id AS doc_id, CAST(j AS INTEGER) AS slot, round(v / norm, 6) + 0.0 AS weight
FROM v JOIN (SELECT id, sqrt(sum(v * v)) AS norm FROM v GROUP BY id) n ON n.id = v.id WHERE v <> 0
""")
def projected_embeddings(spark, sf_dir):
    """Every document through the model slot (a model loaded once per worker, batches of texts), long form."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    embed = model_embedding(projection_model(), PROJECTED)
    return (docs.select("doc_id", F.posexplode(embed(F.col("text"))).alias("slot", "weight")).where("weight <> 0")
            .select("doc_id", F.col("slot").cast("int").alias("slot"), (F.round("weight", 6) + 0.0).alias("weight")))


# --- R2: sparse retrieval, benchmark -> documents ----------------------------

_SPARSE_SQL = with_ctes(
    *weights_ctes("q", "benchmark", "item_id", "text"),
    *weights_ctes("d", "documents", "doc_id", "text"),
    pairs_cte("pairs", "q", "d", "item_id AS id FROM benchmark", "doc_id AS id FROM documents"),
) + """
SELECT query_id, CAST(rank AS INTEGER) AS rank, id AS doc_id, round(raw_distance, 6) + 0.0 AS distance
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(raw_distance, 6), id) AS rank
      FROM pairs) WHERE rank <= 3
"""


def sparse_index(spark, sf_dir):
    """Inverted index of the documents, written once for the present state of the table."""
    path = scratch_path(spark, f"sparse-index-{input_version(spark, sf_dir, 'documents')}")
    if path not in _SPARSE:
        docs = read_table(spark, sf_dir, "documents")
        _SPARSE[path] = S.build_index(S.sparse_terms(docs, "doc_id", "text"), path, n_docs=docs.count())
    return S.open_index(spark, path, _SPARSE[path].shards, _SPARSE[path].id_type)


#: Path of an index written in this process -> its number of shards and type of id.
_SPARSE: dict = {}


def _sparse_hits(spark, sf_dir, pad):
    queries = S.sparse_terms(read_table(spark, sf_dir, "benchmark"), "item_id", "text").withColumnRenamed("id", "query_id")
    hits = S.sparse_topk(sparse_index(spark, sf_dir), queries, TOP_K, pad)
    return hits.select("query_id", "rank", F.col("id").alias("doc_id"), "distance")


@register("retrieve_sparse", _SPARSE_SQL)
def retrieve_sparse(spark, sf_dir):
    """R2 + W1 + J5: exact cosine top-3 of every benchmark item over all documents by inverted
    lists of hashed terms, filled up with documents at distance 1."""
    return _sparse_hits(spark, sf_dir, pad=True)


@register("retrieve_sparse_hits", with_ctes(
    *weights_ctes("q", "benchmark", "item_id", "text"), *weights_ctes("d", "documents", "doc_id", "text")) + """
SELECT query_id, CAST(rank AS INTEGER) AS rank, id AS doc_id, distance
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, id) AS rank
      FROM (SELECT qw.id AS query_id, dw.id, round(1.0 - sum(qw.w * dw.w), 6) + 0.0 AS distance
            FROM q_w qw JOIN d_w dw ON dw.bucket = qw.bucket GROUP BY 1, 2)) WHERE rank <= 3
""")
def retrieve_sparse_hits(spark, sf_dir):
    """R2 as an equi-join on buckets gives it: documents that share no bucket never appear."""
    return _sparse_hits(spark, sf_dir, pad=False)


@register("posting_lists", with_ctes(*weights_ctes("d", "documents", "doc_id", "text")) + """
SELECT bucket, count(*) AS n_postings, round(max(w), 6) AS greatest FROM d_w GROUP BY bucket
""")
def posting_lists(spark, sf_dir):
    """The posting lists of the inverted index: postings and greatest weight per bucket."""
    return S.posting_lists(sparse_index(spark, sf_dir)).withColumn("greatest", F.round("greatest", 6))


# --- R1: dense retrieval over the embeddings table ---------------------------

@register("retrieve_dense", """
SELECT query_id, CAST(rank AS INTEGER) AS rank, id, round(raw_distance, 6) + 0.0 AS distance
FROM (SELECT q.vec_id AS query_id, d.vec_id AS id,
             1.0 - list_dot_product(CAST(q.embedding AS DOUBLE[]), CAST(d.embedding AS DOUBLE[])) AS raw_distance,
             row_number() OVER (PARTITION BY q.vec_id ORDER BY
               round(1.0 - list_dot_product(CAST(q.embedding AS DOUBLE[]), CAST(d.embedding AS DOUBLE[])), 6),
               d.vec_id) AS rank
      FROM embeddings q CROSS JOIN embeddings d)
WHERE rank <= 3
""")
def retrieve_dense(spark, sf_dir):
    """R1 + W1: exact cosine top-3 of every vector against the whole table
    (block matrix product)."""
    emb = read_table(spark, sf_dir, "embeddings")
    hits = R.exact_topk(emb, emb.select(F.col("vec_id").alias("query_id"), "embedding"),
                        TOP_K, doc_id="vec_id")
    return hits.select("query_id", "rank", "id", "distance")


@register("retrieve_ann_recall")
def retrieve_ann_recall(spark, sf_dir):
    """recall@3 against exact search, and the share of full vectors read, of k-means cells (1, 2 and 4 of
    20 probed) and of codes with bounds (0 probed: every code is read, and of the vectors what is left)."""
    emb = read_table(spark, sf_dir, "embeddings")
    queries = emb.select(F.col("vec_id").alias("query_id"), "embedding")
    exact = materialize(R.exact_topk(emb, queries, TOP_K, doc_id="vec_id"), "exact-hits")
    index = R.build_cells(emb, n_cells=20, doc_id="vec_id")
    pairs = sum(index.sizes.values()) * queries.count()
    out = []
    for n_probe in (1, 2, 4):
        approx = R.ivf_topk(index, queries, n_probe=n_probe)
        out.append(R.recall_at_k(approx, exact).withColumn("n_probe", F.lit(n_probe)).withColumn("share_read", F.lit(n_probe / len(index.sizes))))
    read = R.coded_candidates(index, queries).count() / pairs
    out.append(R.recall_at_k(R.coded_topk(index, queries), exact).withColumn("n_probe", F.lit(0)).withColumn("share_read", F.lit(read)))
    return reduce(lambda a, b: a.unionByName(b), out).select("n_probe", "recall", F.round("share_read", 6).alias("share_read"), "n_queries")


@register("retrieve_coded", ORACLE["retrieve_dense"])
def retrieve_coded(spark, sf_dir):
    """R3 without loss: codes of a byte a number with error bounds pick what is scored in full; the hits
    are those of the exact search."""
    emb = read_table(spark, sf_dir, "embeddings")
    index = R.build_cells(emb, n_cells=20, doc_id="vec_id")
    hits = R.coded_topk(index, emb.select(F.col("vec_id").alias("query_id"), "embedding"))
    return hits.select("query_id", "rank", "id", "distance")


@register("retrieve_all_cells", ORACLE["retrieve_dense"])
def retrieve_all_cells(spark, sf_dir):
    """R3 with every cell probed: the cell index loses nothing, so the hits are those of the
    exact search."""
    emb = read_table(spark, sf_dir, "embeddings")
    index = R.build_cells(emb, n_cells=20, doc_id="vec_id")
    hits = R.ivf_topk(index, emb.select(F.col("vec_id").alias("query_id"), "embedding"), n_probe=20)
    return hits.select("query_id", "rank", "id", "distance")


@register("retrieve_no_collections", """
SELECT item_id AS query_id, 'no_collections' AS status FROM benchmark WHERE trim(text) <> ''
""")
def retrieve_no_collections(spark, sf_dir):
    """Every query keeps a row when the store holds no collection to search."""
    queries = _benchmark_queries(spark, sf_dir)
    return R.answers(queries, search(queries, {})).select("query_id", "status")


# --- Two collections, merged (S7, U1, W2, T9, X10, X11) ----------------------

def collections(spark, sf_dir, names=COLLECTION_ORDER):
    """The stored collections, ingested once for the present state of ``documents`` when first asked for:
    ``housing_docs``, fixed-width chunks of the document pages, laid out by type and year;
    ``markdown_docs``, each document as one Markdown file. Opening them checks that the
    model, space and dimension stored with each agree (T9)."""
    root = scratch_path(spark, f"collections-{input_version(spark, sf_dir, 'documents')}")
    if "housing_docs" in names and not store.versions(spark, root, "housing_docs"):
        store.rebuild(spark, root, "housing_docs", page_collection(pages_from_documents(spark, sf_dir), chunker="fixed"),
                      HASH_BUCKETS, partition_by=["doc_type", "year"])
    if "markdown_docs" in names and not store.versions(spark, root, "markdown_docs"):
        store.rebuild(spark, root, "markdown_docs", markdown_collection(markdown_from_documents(spark, sf_dir), split=False),
                      HASH_BUCKETS)
    return {n: df for n, df in store.open_collections(spark, root).items() if n in names}


def search(queries, colls: dict, k: int = TOP_K):
    """Search the stored collections in fixed order, merge, label and format hits; None
    if there is no collection (``answers`` then says so for every query).

    Hits depend only on the query text, so each distinct text is searched once
    (keyed by its SHA-256) and the hits are joined back to every query asking
    it: repeated questions cost one shuffle, not another pass over the chunks.
    """
    names = [n for n in COLLECTION_ORDER if n in colls]
    if not names:
        return None
    union = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True),
                   [colls[n].withColumn("collection", F.lit(n)) for n in names])
    key = F.sha2(F.col("query"), 256)
    texts = queries.where(F.col("query").isNotNull()).select(key.alias("query_id"), "query").distinct()
    per = R.exact_topk(union, _embedded(texts), k, group="collection")
    merged = R.merge_collections(per, {n: i for i, n in enumerate(names)}, k)
    merged = merged.withColumn("raw_distance", F.col("distance"))
    details = union.select("collection", "id", "text", "source", "page")
    by_text = merged.join(details, ["collection", "id"]).withColumnRenamed("query_id", "text_key")
    asked = queries.select("query_id", key.alias("text_key"))
    hits = asked.join(by_text, "text_key").drop("text_key")
    return (hits.withColumn("label", R.hit_label())
                .withColumn("relevance", R.relevance_text("distance"))
                .withColumn("block", R.hit_block()))


_HOUSING_CTE = """
housing AS (
  SELECT regexp_replace(f.source, '(.)\\.[^.]*$', '\\1') || '-p' || f.page_number || '-c' || f.chunk AS id,
         f.text, f.source, f.page_number AS page, m.doc_type, m.year
  FROM (SELECT source, page_number, i AS chunk, substring(text, 1 + i * 850, 1000) AS text
        FROM (SELECT source, page_number, text,
                     unnest(range(0, CAST(greatest(1, ceil((chars - 150) / 850.0)) AS BIGINT))) AS i
              FROM norm_pages WHERE kept)) f
  JOIN meta m ON m.filename = f.source
)"""

_MD_CTE = """
md AS (
  SELECT replace(regexp_replace(path, '\\.md$', ''), '/', '__') || '-c0' AS id, text,
         'doc_' || doc_id || '.md' AS source, CAST(NULL AS INTEGER) AS page
  FROM (SELECT concat_ws('/', lang, source, 'doc_' || doc_id || '.md') AS path, doc_id, text FROM documents)
)"""


def merged_ctes(housing_filter: str = "TRUE", q_source: str = "benchmark", q_id: str = "item_id",
                q_text: str = "text") -> list[str]:
    """DuckDB twin of ``search``: both collections, per-collection top 3,
    merged top 3 and hit labels (CTE ``hits``) for the queries in
    ``q_source``."""
    return [DOCFILES_CTE, PAGES_CTE, NORM_PAGES_CTE, META_CTE, _HOUSING_CTE, _MD_CTE,
            f"housing_f AS (SELECT * FROM housing WHERE {housing_filter})",
            *weights_ctes("q", q_source, q_id, q_text),
            *weights_ctes("h", "housing_f", "id", "text"),
            *weights_ctes("m", "md", "id", "text"),
            pairs_cte("hp", "q", "h", f"{q_id} AS id FROM {q_source}", "id FROM housing_f"),
            pairs_cte("mp", "q", "m", f"{q_id} AS id FROM {q_source}", "id FROM md"),
            """per AS (
  SELECT * FROM (
    SELECT *, row_number() OVER (PARTITION BY query_id, collection ORDER BY round(raw_distance, 6), id) AS crank
    FROM (SELECT 'housing_docs' AS collection, 0 AS collection_rank, * FROM hp
          UNION ALL SELECT 'markdown_docs', 1, * FROM mp)) WHERE crank <= 3
)""",
            """merged AS (
  SELECT * FROM (
    SELECT *, row_number() OVER (PARTITION BY query_id
                                 ORDER BY round(raw_distance, 6), collection_rank, id) AS rank
    FROM per) WHERE rank <= 3
)""",
            """hits AS (
  SELECT m.query_id, CAST(m.rank AS INTEGER) AS rank, m.collection, m.id,
         round(m.raw_distance, 6) + 0.0 AS distance, m.raw_distance, d.text, d.source, d.page,
         CASE WHEN d.page IS NOT NULL AND d.page <> 0
              THEN coalesce(d.source, 'unknown source') || ' (page ' || d.page || ')'
              ELSE coalesce(d.source, 'unknown source') END AS label
  FROM merged m JOIN (SELECT 'housing_docs' AS collection, id, text, source, page FROM housing_f
                      UNION ALL SELECT 'markdown_docs', id, text, source, page FROM md) d
    ON d.collection = m.collection AND d.id = m.id
)"""]


def _merged_sql(housing_filter: str = "TRUE", tail: str = "") -> str:
    return with_ctes(*merged_ctes(housing_filter)) + tail


_RELEVANCE = "format('{:.3f}', 1.0 - round(raw_distance, 6))"


@register("retrieve_merged", _merged_sql(tail=f"""
SELECT query_id, rank, collection, id, distance, label, {_RELEVANCE} AS relevance FROM hits
"""))
def retrieve_merged(spark, sf_dir):
    """S7 + U1 + W1 + W2 + T9 + X10 + X11: benchmark items against two
    collections with different metadata, merged and re-ranked."""
    hits = search(_benchmark_queries(spark, sf_dir), collections(spark, sf_dir))
    return hits.select("query_id", "rank", "collection", "id", "distance", "label", "relevance")


@register("retrieve_answers", _merged_sql(tail=f"""
, blocks AS (
  SELECT query_id, string_agg('[' || rank || '] ' || label || '  |  relevance ' || {_RELEVANCE}
                              || chr(10) || {norm_sql('text')}, chr(10) || chr(10) ORDER BY rank) AS answer
  FROM hits GROUP BY query_id
)
SELECT b.item_id AS query_id, CASE WHEN a.answer IS NULL THEN 'no_hits' ELSE 'ok' END AS status,
       md5(a.answer) AS answer_md5, length(a.answer) AS answer_chars
FROM benchmark b LEFT JOIN blocks a ON a.query_id = b.item_id
"""))
def retrieve_answers(spark, sf_dir):
    """R6 + X11: one formatted answer per query (rank, label, relevance,
    collapsed excerpt), with a status for blank or hitless queries."""
    queries = _benchmark_queries(spark, sf_dir)
    hits = search(queries, collections(spark, sf_dir))
    out = R.answers(queries, hits)
    return out.select("query_id", "status", F.md5("answer").alias("answer_md5"),
                      F.char_length("answer").alias("answer_chars"))


@register("retrieve_filtered", _merged_sql(
    housing_filter="doc_type = 'market_analysis' AND year >= 2020",
    tail="\nSELECT query_id, rank, collection, id, distance, label FROM hits\n"))
def retrieve_filtered(spark, sf_dir):
    """The PDF collection narrowed by metadata (market analyses from 2020)
    before the search; the stored collection is laid out by type and year, so only the
    folders of those are read."""
    colls = collections(spark, sf_dir)
    colls["housing_docs"] = colls["housing_docs"].where(
        (F.col("doc_type") == "market_analysis") & (F.col("year") >= 2020))
    hits = search(_benchmark_queries(spark, sf_dir), colls)
    return hits.select("query_id", "rank", "collection", "id", "distance", "label")


@register("retrieve_preview", with_ctes(
    DOCFILES_CTE, PAGES_CTE, NORM_PAGES_CTE, META_CTE, _HOUSING_CTE,
    f"smoke AS (SELECT 0 AS item_id, '{SMOKE_QUESTION}' AS text)",
    *weights_ctes("q", "smoke", "item_id", "text"),
    *weights_ctes("h", "housing", "id", "text"),
    pairs_cte("hp", "q", "h", "item_id AS id FROM smoke", "id FROM housing")) + f"""
SELECT p.query_id, CAST(p.rank AS INTEGER) AS rank, p.id, round(p.raw_distance, 6) + 0.0 AS distance,
       {_RELEVANCE.replace('raw_distance', 'p.raw_distance')} AS relevance, h.source, h.page,
       replace(substring(h.text, 1, 160), chr(10), ' ') AS preview
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(raw_distance, 6), id) AS rank
      FROM hp) p JOIN housing h ON h.id = p.id
WHERE p.rank <= 3
""")
def retrieve_preview(spark, sf_dir):
    """R5 + X12: the post-ingest check: a fixed question against the whole
    PDF collection, top 3 with relevance and a 160-character preview."""
    housing = collections(spark, sf_dir, ["housing_docs"])["housing_docs"]
    question = spark.createDataFrame([(0, SMOKE_QUESTION)], "query_id int, query string")
    hits = R.exact_topk(housing, _embedded(question), TOP_K)
    hits = hits.join(housing.select("id", "text", "source", "page"), "id")
    return R.with_preview(hits).select(
        "query_id", "rank", "id", "distance", R.relevance_text("distance").alias("relevance"),
        "source", "page", "preview")


@register("corpus_totals", with_ctes(DOCFILES_CTE, PAGES_CTE, NORM_PAGES_CTE, META_CTE, _HOUSING_CTE) + f"""
SELECT count(*) AS total_chunks, round(avg(length(text)), 4) AS avg_chars, {HASH_BUCKETS} AS dimension,
       count(DISTINCT id) AS vectors_held
FROM housing
""")
def corpus_totals_query(spark, sf_dir):
    """Chunks, mean chunk length, embedding dimension, vectors held."""
    housing = collections(spark, sf_dir, ["housing_docs"])["housing_docs"]
    return corpus_totals(housing)
