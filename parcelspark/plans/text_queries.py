"""Document and chunking queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import WS_CLASS, file_stem, normalise_ws
from ..operators import chunking as C
from ..schemas import MIN_CHUNK_CHARS, PDF_CHUNK_SIZE, PUBLISHER
from ..sources.documents import document_filenames, markdown_from_documents, pages_from_documents
from ..sources.tables import read_table
from .registry import register
from .sql_common import with_ctes

def norm_sql(expr: str) -> str:
    return "trim(regexp_replace(" + expr + ", '" + WS_CLASS + "+', ' ', 'g'))"


DOCFILES_CTE = """
docfiles AS (
  SELECT *, CASE doc_id % 6
      WHEN 0 THEN 'Real_Estate_Market_Analysis_' || y || '_Q' || q || '_d' || doc_id || '.pdf'
      WHEN 1 THEN 'real_estate_market_analysis_' || y || '_q' || q || '_v2_d' || doc_id || '.pdf'
      WHEN 2 THEN 'FSR_' || y || '_d' || doc_id || '.pdf'
      WHEN 3 THEN 'fsr_' || y || '_Summary_d' || doc_id || '.pdf'
      WHEN 4 THEN source || '_notes_d' || doc_id || '.pdf'
      ELSE 'fsr_' || substr(y, 3, 2) || '_d' || doc_id || '.pdf' END AS filename
  FROM (SELECT *, CAST(2015 + (doc_id // 7) % 10 AS VARCHAR) AS y,
               CAST(1 + (doc_id // 3) % 4 AS VARCHAR) AS q FROM documents)
)"""

PAGES_CTE = """
pages AS (
  SELECT filename AS source, CAST(i AS INTEGER) AS page_number, lines[i] AS text
  FROM (SELECT filename, lines, unnest(generate_series(1, len(lines))) AS i
        FROM (SELECT filename, string_split(text, chr(10)) AS lines FROM docfiles))
)"""

NORM_PAGES_CTE = f"""
norm_pages AS (
  SELECT source, page_number, t AS text, length(t) AS chars, length(t) >= 100 AS kept
  FROM (SELECT source, page_number, {norm_sql('text')} AS t FROM pages)
)"""

_MA = r"(?i)real_estate_market_analysis_(\d{4})_q(\d)"
_FSR = r"(?i)fsr_(\d{4})"

META_CTE = f"""
meta AS (
  SELECT filename, stem,
    CASE WHEN regexp_matches(stem, '{_MA}') THEN 'market_analysis'
         WHEN regexp_matches(stem, '{_FSR}') THEN 'financial_stability_review' ELSE 'other' END AS doc_type,
    CASE WHEN regexp_matches(stem, '{_MA}') OR regexp_matches(stem, '{_FSR}') THEN '{PUBLISHER}'
         ELSE 'unknown' END AS publisher,
    CASE WHEN regexp_matches(stem, '{_MA}') THEN CAST(regexp_extract(stem, '{_MA}', 1) AS INTEGER)
         WHEN regexp_matches(stem, '{_FSR}') THEN CAST(regexp_extract(stem, '{_FSR}', 1) AS INTEGER)
         ELSE 0 END AS year,
    CASE WHEN regexp_matches(stem, '{_MA}') THEN CAST(regexp_extract(stem, '{_MA}', 2) AS INTEGER)
         ELSE 0 END AS quarter,
    CASE WHEN regexp_matches(stem, '{_MA}') THEN CAST(CAST(regexp_extract(stem, '{_MA}', 1) AS INTEGER) AS VARCHAR)
              || ' Q' || CAST(CAST(regexp_extract(stem, '{_MA}', 2) AS INTEGER) AS VARCHAR)
         WHEN regexp_matches(stem, '{_FSR}') THEN CAST(CAST(regexp_extract(stem, '{_FSR}', 1) AS INTEGER) AS VARCHAR)
         ELSE 'unknown' END AS period,
    CASE WHEN regexp_matches(stem, '{_MA}') THEN 'Real Estate Market Analysis '
              || CAST(CAST(regexp_extract(stem, '{_MA}', 1) AS INTEGER) AS VARCHAR)
              || ' Q' || CAST(CAST(regexp_extract(stem, '{_MA}', 2) AS INTEGER) AS VARCHAR)
         WHEN regexp_matches(stem, '{_FSR}') THEN 'Financial Stability Review '
              || CAST(CAST(regexp_extract(stem, '{_FSR}', 1) AS INTEGER) AS VARCHAR)
              || CASE WHEN contains(lower(stem), 'summary') THEN ' (Summary)' ELSE '' END
         ELSE stem END AS title
  FROM (SELECT filename, regexp_replace(filename, '(.)\\.[^.]*$', '\\1') AS stem FROM docfiles)
)"""


@register("normalised_documents", f"""
SELECT doc_id, length(t) AS chars, md5(t) AS text_md5
FROM (SELECT doc_id, {norm_sql('text')} AS t FROM documents)
""")
def normalised_documents(spark, sf_dir):
    """X1 + X14: whitespace-collapsed text, its length in code points and hash."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", normalise_ws(F.col("text")).alias("t"))
    return docs.select("doc_id", F.char_length("t").alias("chars"), F.md5("t").alias("text_md5"))


@register("document_metadata", with_ctes(DOCFILES_CTE, META_CTE) + """
SELECT d.doc_id, m.filename, m.stem, m.doc_type, m.publisher, m.year, m.quarter, m.period, m.title
FROM docfiles d JOIN meta m ON m.filename = d.filename
""")
def document_metadata(spark, sf_dir):
    """X2 + X3: metadata from the file-name convention."""
    docs = document_filenames(read_table(spark, sf_dir, "documents").select("doc_id", "source"))
    return docs.select("doc_id", "filename", file_stem(F.col("filename")).alias("stem"),
                       C.document_metadata(F.col("filename")).alias("m")).select(
        "doc_id", "filename", "stem", "m.*")


@register("page_filter_report", with_ctes(DOCFILES_CTE, PAGES_CTE, NORM_PAGES_CTE) + """
SELECT source, count(*) AS pages, count_if(NOT kept) AS skipped, count_if(kept) AS kept
FROM norm_pages GROUP BY source
""")
def page_filter_report(spark, sf_dir):
    """S3 + F3 + A14: pages per document, how many are too short to keep."""
    return C.page_report(pages_from_documents(spark, sf_dir))


@register("chunk_fixed", with_ctes(DOCFILES_CTE, PAGES_CTE, NORM_PAGES_CTE, META_CTE, """
fixed AS (
  SELECT source, page_number, i AS chunk, substring(text, 1 + i * 850, 1000) AS text
  FROM (SELECT source, page_number, text,
               unnest(range(0, CAST(greatest(1, ceil((chars - 150) / 850.0)) AS BIGINT))) AS i
        FROM norm_pages WHERE kept)
)""") + """
SELECT regexp_replace(f.source, '(.)\\.[^.]*$', '\\1') || '-p' || f.page_number || '-c' || f.chunk AS id,
       f.source, f.page_number AS page, CAST(f.chunk AS INTEGER) AS chunk, length(f.text) AS chars,
       md5(f.text) AS text_md5, m.doc_type, m.year, m.quarter
FROM fixed f JOIN meta m ON m.filename = f.source
""")
def chunk_fixed(spark, sf_dir):
    """T3 + T6 + X4: fixed 1000-character windows with 150 overlap."""
    chunks = C.chunk_pages_fixed(pages_from_documents(spark, sf_dir))
    return chunks.select("id", "source", "page", "chunk", "chars", F.md5("text").alias("text_md5"),
                         "doc_type", "year", "quarter")


@register("chunk_recursive")
def chunk_recursive(spark, sf_dir):
    """T1 + T6 + X4: recursive character split (1000 / 150, paragraph ->
    sentence -> word -> character)."""
    chunks = C.chunk_pages(pages_from_documents(spark, sf_dir))
    return chunks.select("id", "source", "page", "chunk", "chars", F.md5("text").alias("text_md5"),
                         "doc_type", "publisher", "year", "quarter", "period", "title")


@register("chunk_recursive_check", with_ctes(DOCFILES_CTE, PAGES_CTE, NORM_PAGES_CTE) + """
SELECT source, page_number AS page, TRUE AS fits, TRUE AS taken_from_page, TRUE AS starts, TRUE AS ends
FROM norm_pages WHERE kept
""")
def chunk_recursive_check(spark, sf_dir):
    """T1 per kept page: no chunk over the size, each one a stretch of the page, the first at its
    start and the last at its end."""
    pages = pages_from_documents(spark, sf_dir)
    chunks = C.chunk_pages(pages).select("source", "page", "chunk", "chars", F.col("text").alias("piece"))
    whole = C.normalise_pages(pages).where("kept").select("source", F.col("page_number").alias("page"), "text")
    last = F.max_by("piece", "chunk")
    return whole.join(chunks, ["source", "page"], "left").groupBy("source", "page").agg(
        F.bool_and(F.coalesce(F.col("chars") <= PDF_CHUNK_SIZE, F.lit(False))).alias("fits"),
        F.bool_and(F.coalesce(F.contains("text", "piece"), F.lit(False))).alias("taken_from_page"),
        F.startswith(F.first("text"), F.min_by("piece", "chunk")).alias("starts"),
        F.endswith(F.first("text"), last).alias("ends"))


@register("chunk_markdown_check", """
SELECT concat_ws('/', lang, source, 'doc_' || doc_id || '.md') AS path, TRUE AS long_enough, TRUE AS taken_from_file
FROM documents
""")
def chunk_markdown_check(spark, sf_dir):
    """T2 + F4 per file, those without a piece included: kept pieces are long enough and stretches of the file."""
    files = markdown_from_documents(spark, sf_dir)
    kept = C.split_markdown_files(files, measure=None).select("path", "kept")
    return files.join(kept, "path").select(
        "path", F.forall("kept", lambda p: F.char_length(p) >= MIN_CHUNK_CHARS).alias("long_enough"),
        F.forall("kept", lambda p: F.contains(F.coalesce("text", F.lit("")), p)).alias("taken_from_file"))


@register("document_report")
def document_report(spark, sf_dir):
    """Pages, skipped pages and recursive chunks per document."""
    pages = pages_from_documents(spark, sf_dir)
    return C.document_report(pages, C.chunk_pages(pages))


# T4 in SQL: sentences end after each ". " (split on it and put it back on
# every piece but the last); a recursive walk over the sentences carries the
# current chunk number and its length, starting a new chunk whenever the next
# sentence would not fit.
_SENTENCES_SQL = "WITH RECURSIVE " + with_ctes(
    f"""parts AS (
  SELECT doc_id, string_split({norm_sql('text')}, '. ') AS p FROM documents
)""",
    """sent AS (
  SELECT doc_id, i, s FROM (
    SELECT doc_id, i, CASE WHEN i < len(p) THEN p[i] || '. ' ELSE p[i] END AS s
    FROM (SELECT doc_id, p, unnest(generate_series(1, len(p))) AS i FROM parts))
  WHERE s <> ''
)""",
    f"""walk AS (
  SELECT doc_id, i, 0 AS chunk, length(s) AS cur FROM sent WHERE i = 1
  UNION ALL
  SELECT w.doc_id, n.i,
         CASE WHEN w.cur + length(n.s) <= {C.PDF_CHUNK_SIZE} THEN w.chunk ELSE w.chunk + 1 END,
         CASE WHEN w.cur + length(n.s) <= {C.PDF_CHUNK_SIZE} THEN w.cur + length(n.s) ELSE length(n.s) END
  FROM walk w JOIN sent n ON n.doc_id = w.doc_id AND n.i = w.i + 1
)""").removeprefix("WITH ") + """
SELECT doc_id, CAST(chunk AS INTEGER) AS chunk, length(t) AS chars, md5(t) AS text_md5
FROM (SELECT w.doc_id, w.chunk, string_agg(n.s, '' ORDER BY n.i) AS t
      FROM walk w JOIN sent n ON n.doc_id = w.doc_id AND n.i = w.i GROUP BY w.doc_id, w.chunk)
"""


@register("chunk_sentences", _SENTENCES_SQL)
def chunk_sentences(spark, sf_dir):
    """T4 + W3: whole sentences packed up to 1000 characters per chunk."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", normalise_ws(F.col("text")).alias("t"))
    return docs.select("doc_id", F.posexplode(C.pack_sentences(F.col("t"))).alias("chunk", "text")).select(
        "doc_id", F.col("chunk").cast("int").alias("chunk"), F.char_length("text").alias("chars"),
        F.md5("text").alias("text_md5"))


@register("chunk_markdown")
def chunk_markdown(spark, sf_dir):
    """T2 + F4 + W3 + X5 + T5: token-measured Markdown-aware split."""
    split = C.split_markdown_files(markdown_from_documents(spark, sf_dir))
    return C.chunk_markdown(split).select("id", "path", "source", "chunk", "chars", "over_window",
                                          F.md5("text").alias("text_md5"))


@register("markdown_report")
def markdown_report(spark, sf_dir):
    """Chunks and skipped fragments per Markdown file."""
    return C.markdown_report(C.split_markdown_files(markdown_from_documents(spark, sf_dir), measure=None))
