"""Store and streaming queries."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import scoring as S
from ..operators.ingest import page_collection
from ..schemas import HASH_BUCKETS
from ..session import materialize, scratch_path
from ..sources import store
from ..sources.documents import pages_of
from ..sources.requests import price_requests
from ..sources.tables import listings_table, read_table
from ..streaming.ingest import ARRIVAL, ingest_stream, with_arrival
from ..streaming.scoring import score_stream, start_parquet_sink
from .ml_queries import AS_OF_YEAR, _split
from .registry import ORACLE, register
from .scoring_queries import linear_predictor
from .sql_common import with_ctes
from .text_queries import DOCFILES_CTE, NORM_PAGES_CTE

REVISION = " [rev 2]"


def _batches(spark, sf_dir):
    """Two overlapping ingest batches covering every document: first the
    English and French documents, then the French, German and Spanish ones
    with revised text (so the French chunks are replaced)."""
    docs = read_table(spark, sf_dir, "documents")
    first = docs.where(F.col("lang").isin("en", "fr"))
    second = docs.where(~F.col("lang").eqNullSafe("en")).withColumn("text", F.concat("text", F.lit(REVISION)))
    return (page_collection(pages_of(first), chunker="fixed"),
            page_collection(pages_of(second), chunker="fixed"))


def _first_row(rows):
    """The row of the least id (a null one comes first). Ids alone are read to find it, then the part of a file that has it."""
    least = rows.agg(F.min(F.struct("id")).alias("r")).first()["r"]
    return rows.where(F.col("id").eqNullSafe(least["id"] if least else None)).limit(1)


def _store_root(spark):
    return scratch_path(spark, f"store-{uuid.uuid4().hex}")


_CHUNKS_SQL = with_ctes(DOCFILES_CTE, f"""
pages AS (
  SELECT filename AS source, lang, CAST(i AS INTEGER) AS page_number, lines[i] AS text
  FROM (SELECT filename, lang, lines, unnest(generate_series(1, len(lines))) AS i
        FROM (SELECT filename, lang, string_split(CASE WHEN rev THEN text || '{REVISION}' ELSE text END,
                                                  chr(10)) AS lines
              FROM (SELECT *, TRUE AS rev FROM docfiles WHERE lang IS DISTINCT FROM 'en'
                    UNION ALL SELECT *, FALSE AS rev FROM docfiles WHERE lang = 'en')))
)""", NORM_PAGES_CTE.replace("SELECT source, page_number, t AS text", "SELECT source, page_number, t AS text")) + """
SELECT regexp_replace(source, '(.)\\.[^.]*$', '\\1') || '-p' || page_number || '-c' || i AS id,
       md5(substring(text, 1 + i * 850, 1000)) AS text_md5, length(substring(text, 1 + i * 850, 1000)) AS chars,
       source
FROM (SELECT source, page_number, text,
             unnest(range(0, CAST(greatest(1, ceil((chars - 150) / 850.0)) AS BIGINT))) AS i
      FROM norm_pages WHERE kept)
"""

_REBUILD_SQL = _CHUNKS_SQL.replace("UNION ALL SELECT *, FALSE AS rev FROM docfiles WHERE lang = 'en'", "")


def _final(df):
    return df.select("id", F.md5("text").alias("text_md5"), "chars", "source")


@register("upsert_chunks", _CHUNKS_SQL)
def upsert_chunks(spark, sf_dir):
    """S5 + S10: ingest batch one, upsert batch two; replaced ids carry the
    revised text, others stay. The second upsert is applied twice to show it
    is idempotent."""
    root = _store_root(spark)
    first, second = _batches(spark, sf_dir)
    store.upsert(spark, root, "housing_docs", first, HASH_BUCKETS)
    store.upsert(spark, root, "housing_docs", second, HASH_BUCKETS)
    store.upsert(spark, root, "housing_docs", second, HASH_BUCKETS)
    return _final(store.read_collection(spark, root, "housing_docs"))


@register("rebuild_chunks", _REBUILD_SQL)
def rebuild_chunks(spark, sf_dir):
    """Ingest batch one, then rebuild with batch two only: ids that only
    batch one had are gone."""
    root = _store_root(spark)
    first, second = _batches(spark, sf_dir)
    store.upsert(spark, root, "housing_docs", first, HASH_BUCKETS)
    store.rebuild(spark, root, "housing_docs", second, HASH_BUCKETS)
    return _final(store.read_collection(spark, root, "housing_docs"))


@register("stream_upsert", _CHUNKS_SQL)
def stream_upsert(spark, sf_dir):
    """The same two batches arriving as files in a watched directory, chunked and embedded as
    a stream and upserted per micro-batch; the second file also holds what it replaces, in front."""
    root = _store_root(spark)
    inbox = scratch_path(spark, f"inbox-{uuid.uuid4().hex}")
    docs = read_table(spark, sf_dir, "documents")
    schema = docs.schema
    docs.where(F.col("lang").isin("en", "fr")).write.parquet(f"{inbox}/batch1")
    stream = with_arrival(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1000).parquet(f"{inbox}/*"))

    def to_chunks(df):
        return page_collection(pages_of(df, [ARRIVAL]), chunker="fixed", carry=[ARRIVAL])

    def ingest():
        ingest_stream(spark, stream, to_chunks, root, "housing_docs", ckpt, order_by=ARRIVAL).awaitTermination()

    ckpt = scratch_path(spark, f"ckpt-{uuid.uuid4().hex}")
    ingest()
    second = docs.where(~F.col("lang").eqNullSafe("en"))
    both = second.withColumn("rev", F.lit(0)).union(second.withColumn("text", F.concat("text", F.lit(REVISION))).withColumn("rev", F.lit(1)))
    both.repartition("doc_id").sortWithinPartitions("doc_id", "rev").drop("rev").write.parquet(f"{inbox}/batch2")
    ingest()
    return _final(store.read_collection(spark, root, "housing_docs"))


_ID = "regexp_replace(source, '(.)\\.[^.]*$', '\\1') || '-p' || page_number || '-c' || i"
_SMALL_SQL = (_CHUNKS_SQL.replace("SELECT *, TRUE AS rev FROM docfiles WHERE lang IS DISTINCT FROM 'en'\n                    UNION ALL ", "")
              .replace("FROM docfiles WHERE lang = 'en'", "FROM docfiles WHERE lang IN ('en', 'fr')")
              .replace("md5(substring(text, 1 + i * 850, 1000))",
                       f"md5(substring(text, 1 + i * 850, 1000) || CASE WHEN {_ID} = min({_ID}) OVER () THEN '{REVISION}' ELSE '' END)"))


@register("upsert_small_batches", _SMALL_SQL)
def upsert_small_batches(spark, sf_dir):
    """One chunk upserted again and again into the stored pages, until its bucket has been compacted:
    layers merge on read, and every other row stays."""
    root, name = _store_root(spark), "housing_docs"
    first, _ = _batches(spark, sf_dir)
    store.upsert(spark, root, name, first, HASH_BUCKETS)
    one = materialize(_first_row(store.read_collection(spark, root, name)), "one-chunk")
    for n in range(store.MAX_LAYERS + 1):
        text = F.concat("text", F.lit(REVISION if n == store.MAX_LAYERS else f" [draft {n}]"))
        store.upsert(spark, root, name, one.withColumn("text", text), HASH_BUCKETS)
    return _final(store.read_collection(spark, root, name))


@register("stream_score", ORACLE["score_requests_linear"])
def stream_score(spark, sf_dir):
    """Requests arriving as files are scored by the one-feature linear model in a
    stateless append stream; equals the batch scoring."""
    train = _split(spark, sf_dir).where(~F.col("is_test"))
    ctx = S.build_context(listings_table(spark, sf_dir), train, as_of_year=AS_OF_YEAR)
    inbox = scratch_path(spark, f"requests-{uuid.uuid4().hex}")
    requests = price_requests(spark, sf_dir, AS_OF_YEAR)
    requests.write.parquet(inbox)
    stream = spark.readStream.schema(requests.schema).parquet(inbox)
    out = scratch_path(spark, f"scored-{uuid.uuid4().hex}")
    ckpt = scratch_path(spark, f"ckpt-{uuid.uuid4().hex}")
    start_parquet_sink(score_stream(stream, ctx, linear_predictor(train)), out, ckpt).awaitTermination()
    return spark.read.parquet(out).withColumn("price", F.round("price", 2))
