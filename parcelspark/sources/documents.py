"""Document sources (S3, S4): page tables and Markdown trees.

The reference decodes PDFs into pages; here a page table
``(source, page_number, text)`` is the input. ``pages_from_documents`` derives
one from the driver's ``documents`` table (each document is a file, each of
its lines a page). ``read_binary_pages`` is the slot for a real decoder over
``binaryFile``; ``read_markdown_tree`` scans a directory of ``.md`` files.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from urllib.parse import unquote

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import read_table


def document_filenames(docs: DataFrame) -> DataFrame:
    """Give every document a file name in one of the naming conventions the
    metadata rules recognise (and some they do not), unique per document."""
    k = F.col("doc_id")
    year = (F.lit(2015) + F.floor(k / 7) % 10).cast("string")
    quarter = (F.lit(1) + F.floor(k / 3) % 4).cast("string")
    tag = F.concat(F.lit("_d"), k.cast("string"), F.lit(".pdf"))
    v = k % 6
    name = (F.when(v == 0, F.concat(F.lit("Real_Estate_Market_Analysis_"), year, F.lit("_Q"), quarter, tag))
             .when(v == 1, F.concat(F.lit("real_estate_market_analysis_"), year, F.lit("_q"), quarter,
                                    F.lit("_v2"), tag))
             .when(v == 2, F.concat(F.lit("FSR_"), year, tag))
             .when(v == 3, F.concat(F.lit("fsr_"), year, F.lit("_Summary"), tag))
             .when(v == 4, F.concat(F.col("source"), F.lit("_notes"), tag))
             .otherwise(F.concat(F.lit("fsr_"), F.substring(year, 3, 2), tag)))
    return docs.withColumn("filename", name)


def pages_from_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S3 (re-aimed): one row per page, 1-based page numbers, whole texts."""
    return pages_of(read_table(spark, sf_dir, "documents"))


def pages_of(documents: DataFrame, carry: Sequence[str] = ()) -> DataFrame:
    """Page table of any frame shaped like ``documents`` (batch or stream); ``carry`` names further
    columns that go along."""
    docs = document_filenames(documents.select("doc_id", "source", "text", *carry))
    return docs.select(
        F.col("filename").alias("source"), *carry,
        F.posexplode(F.split(F.col("text"), "\n")).alias("pos", "text"),
    ).select("source", (F.col("pos") + 1).cast("int").alias("page_number"), "text", *carry)


def markdown_from_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S4 input shape ``(path, text)`` from the documents table: each document
    is a Markdown file at ``{lang}/{source}/doc_{id}.md`` (nested folders, so
    path-based ids are exercised)."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "text")
    return docs.select(
        F.concat_ws("/", "lang", "source", F.concat(F.lit("doc_"), F.col("doc_id").cast("string"),
                                                    F.lit(".md"))).alias("path"),
        "text")


def read_markdown_tree(spark: SparkSession, root: str) -> DataFrame:
    """Every ``*.md`` under ``root`` as ``(path, source, text)``.

    Whole files via ``binaryFile``, bad UTF-8 bytes replaced, paths relative to
    ``root`` in POSIX form. An empty tree gives an empty table, not an error.
    A zero-length file has an empty text: Spark's scan skips it, so the files that the scan
    has listed are joined to what it has read.
    """
    root = root.rstrip("/")
    df = (spark.read.format("binaryFile")
          .option("recursiveFileLookup", True)
          .option("pathGlobFilter", "*.md")
          .load(root)
          .select(F.make_valid_utf8(F.col("content").cast("string")).alias("text"),
                  F.col("path").alias("file_path")))
    rel = F.regexp_replace(F.regexp_replace("file_path", r"^file:/*", "/"), "^.*?" + _escape(root) + "/", "")
    read = df.select(rel.alias("path"), "text")
    listed = spark.createDataFrame([(unquote(f),) for f in df.inputFiles()], "file_path string").select(rel.alias("path"))
    return listed.join(read, "path", "left").select(
        "path", F.element_at(F.split("path", "/"), -1).alias("source"), F.coalesce("text", F.lit("")).alias("text"))


def _escape(s: str) -> str:
    import re
    return re.escape(s)


def read_binary_pages(spark: SparkSession, directory: str,
                      decode: Callable[[bytes], list[str]], glob: str = "*.pdf") -> DataFrame:
    """S3 decoder slot: ``binaryFile`` scan, then ``decode(bytes) -> [page text]``
    per file inside ``mapInPandas``; page numbers from 1. Rows are in no order: ``(source, page_number)``
    is that of the files by name. Raises if the directory holds no matching file."""
    files = (spark.read.format("binaryFile").option("pathGlobFilter", glob).load(directory)
             .select(F.element_at(F.split("path", "/"), -1).alias("source"), "content"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(src, i + 1, txt) for src, blob in zip(pdf["source"], pdf["content"])
                    for i, txt in enumerate(decode(bytes(blob)))]
            yield pd.DataFrame(rows, columns=["source", "page_number", "text"])

    pages = files.mapInPandas(run, "source string, page_number int, text string")
    if files.limit(1).count() == 0:
        raise FileNotFoundError(f"No {glob} files found in {directory}")
    return pages
