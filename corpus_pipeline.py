"""Corpus pipeline: five stages over whole documents, each one operator of ``parcelspark.llm``.

Every stage but the last returns the columns of ``documents``; each is judged on
what its predecessor kept.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parcelspark.llm import decontaminate, jaccard_join, language_id, line_dedup, packing
from parcelspark.llm.util import stored
from parcelspark.session import ensure_checkpoint_dir, ship_package


def _ready(spark: SparkSession) -> None:
    ensure_checkpoint_dir(spark)
    ship_package(spark)


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents in a learned language; rejected: no text, no letter, or costlier than plain bytes.
    Where no language could be learned (no labelled text), every document with a letter stays."""
    _ready(spark)
    model = language_id.train(docs)
    if not model.langs:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    return language_id.classify(docs, model).where(language_id.accepted()).select(*docs.columns)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Remove later occurrences of three-line windows; a document that loses every line goes. ``n_chars`` follows the text."""
    _ready(spark)
    out = line_dedup.dedup_lines(docs).where("n_removed = 0 OR n_removed < n_lines")
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.char_length("text").cast("long")).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)


def near_copy_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near copies the document of the smallest id stays; documents without an id or words stay."""
    _ready(spark)
    classes = jaccard_join.jaccard_join(docs).where("doc_id <> class_id").select(F.col("doc_id").alias("_copy")).distinct()
    return docs.join(classes, F.col("doc_id") == F.col("_copy"), "left_anti").select(*docs.columns)


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents of which benchmark windows cover a word in twenty or more."""
    _ready(spark)
    items = spark.read.parquet(f"{sf_dir.rstrip('/')}/benchmark.parquet")
    hits = decontaminate.contamination(docs, items).where(decontaminate.contaminated())
    gone = stored(hits.select(F.col("doc_id").alias("_hit")).distinct(), "pipeline-contaminated")
    return docs.join(gone, F.col("doc_id") == F.col("_hit"), "left_anti").select(*docs.columns)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack what is left into sequences of 1024 tokens."""
    _ready(spark)
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("language", language_stage),
    ("lines", line_stage),
    ("near_copies", near_copy_stage),
    ("benchmark", benchmark_stage),
    ("packing", packing_stage),
]

#: The learned language model and the tokenizer cannot be written in SQL; the tests hold the stages against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet and read again by the next."""
    _ready(spark)
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
