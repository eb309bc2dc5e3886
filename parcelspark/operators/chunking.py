"""Page filtering, chunking and ingest reports.

Chunking is a narrow stage: every page or file is split where it lies, then
``posexplode`` gives one row per chunk with a 0-based position. Only the
recursive splitter (T1/T2) runs Python, over whole texts: an Arrow-batched
UDF for pages, ``mapInArrow`` for files, whose pieces leave in batches of
bounded size; the fixed-width (T3) and sentence-packing (T4) variants are
built-in expressions.
"""

from __future__ import annotations

import re
from collections import deque
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import file_stem, markdown_chunk_id, normalise_ws, pdf_chunk_id
from ..schemas import (MARKET_ANALYSIS_PATTERN, MARKET_ANALYSIS_TYPE, MD_CHUNK_OVERLAP,
                       MD_CHUNK_SIZE, MD_SEPARATORS, MIN_CHUNK_CHARS, MIN_PAGE_CHARS,
                       MODEL_TOKEN_WINDOW, PDF_CHUNK_OVERLAP, PDF_CHUNK_SIZE, PDF_SEPARATORS,
                       PUBLISHER, STABILITY_REVIEW_PATTERN, STABILITY_REVIEW_TYPE)

# ---------------------------------------------------------------------------
# Recursive splitting (per-text helper, run inside a UDF)
# ---------------------------------------------------------------------------

#: Characters of pieces that a batch of split texts holds, the last text's beyond it.
SPLIT_BATCH_CHARS = 1 << 20
_TOKEN = re.compile(r"\w+|[^\w\s]")


def token_length(text: str) -> int:
    """Default token count for T2: words and single punctuation marks."""
    return len(_TOKEN.findall(text))


def _split_keep(text: str, sep: str) -> list[str]:
    """Split on ``sep``, keeping it at the start of the following piece."""
    if sep == "":
        return list(text)
    parts = text.split(sep)
    out = [parts[0]] + [sep + p for p in parts[1:]]
    return [p for p in out if p != ""]


def _merge(pieces: list[str], size: int, overlap: int, length: Callable[[str], int]) -> list[str]:
    """Greedily pack pieces into chunks of at most ``size``; start each new
    chunk with the tail of the previous one, up to ``overlap``."""
    chunks: list[str] = []
    window: deque[tuple[str, int]] = deque()
    total = 0
    for piece in pieces:
        n = length(piece)
        if window and total + n > size:
            text = "".join(p for p, _ in window).strip()
            if text:
                chunks.append(text)
            while window and (total > overlap or (total + n > size and total > 0)):
                total -= window.popleft()[1]
        window.append((piece, n))
        total += n
    text = "".join(p for p, _ in window).strip()
    if text:
        chunks.append(text)
    return chunks


def split_recursive(text: str, separators: list[str], size: int, overlap: int,
                    length: Callable[[str], int] = len) -> list[str]:
    """Split on the first separator present in the text; pieces still
    too long are split again with the separators after it; short pieces are
    merged back up to ``size`` with ``overlap``."""
    if not text:
        return []
    sep, rest = separators[-1], []
    for i, s in enumerate(separators):
        if s == "" or s in text:
            sep, rest = s, separators[i + 1:]
            break
    out: list[str] = []
    short: list[str] = []
    for piece in _split_keep(text, sep):
        if length(piece) < size:
            short.append(piece)
            continue
        if short:
            out.extend(_merge(short, size, overlap, length))
            short = []
        if rest:
            out.extend(split_recursive(piece, rest, size, overlap, length))
        else:
            out.append(piece)
    if short:
        out.extend(_merge(short, size, overlap, length))
    return out


def recursive_splitter(separators: list[str], size: int, overlap: int,
                       length: Callable[[str], int] = len) -> Callable[[Column], Column]:
    """An Arrow UDF ``text -> array<string>`` for the given parameters. One text and the pieces of some are Python
    strings at a time, whatever the batch holds."""
    @F.arrow_udf("array<string>")
    def split(texts: pa.Array) -> pa.Array:
        kind = pa.list_(pa.string())
        done, held, chars = [pa.array([], kind)], [], 0
        for t in texts:
            held.append(split_recursive(t.as_py() or "", separators, size, overlap, length))
            chars += sum(map(len, held[-1]))
            if chars >= SPLIT_BATCH_CHARS:
                done.append(pa.array(held, kind))
                held, chars = [], 0
        return pa.concat_arrays([*done, pa.array(held, kind)])
    return split


# ---------------------------------------------------------------------------
# Pages -> chunks
# ---------------------------------------------------------------------------

def document_metadata(source: Column) -> Column:
    """File-name convention -> metadata struct (two patterns in order,
    case-insensitive, anywhere in the stem)."""
    stem = file_stem(source)
    is_market = stem.rlike(MARKET_ANALYSIS_PATTERN)
    is_review = stem.rlike(STABILITY_REVIEW_PATTERN)
    m_year = F.regexp_extract(stem, MARKET_ANALYSIS_PATTERN, 1)
    m_quarter = F.regexp_extract(stem, MARKET_ANALYSIS_PATTERN, 2)
    r_year = F.regexp_extract(stem, STABILITY_REVIEW_PATTERN, 1)
    summary = F.when(F.lower(stem).contains("summary"), F.lit(" (Summary)")).otherwise(F.lit(""))
    pick = lambda m, r, o: F.when(is_market, m).when(is_review, r).otherwise(o)
    m_y, m_q, r_y = m_year.try_cast("int"), m_quarter.try_cast("int"), r_year.try_cast("int")
    return F.struct(
        pick(F.lit(MARKET_ANALYSIS_TYPE), F.lit(STABILITY_REVIEW_TYPE), F.lit("other")).alias("doc_type"),
        pick(F.lit(PUBLISHER), F.lit(PUBLISHER), F.lit("unknown")).alias("publisher"),
        pick(m_y, r_y, F.lit(0)).alias("year"),
        pick(m_q, F.lit(0), F.lit(0)).alias("quarter"),
        pick(F.concat(m_y.cast("string"), F.lit(" Q"), m_q.cast("string")), r_y.cast("string"),
             F.lit("unknown")).alias("period"),
        pick(F.concat(F.lit("Real Estate Market Analysis "), m_y.cast("string"), F.lit(" Q"),
                      m_q.cast("string")),
             F.concat(F.lit("Financial Stability Review "), r_y.cast("string"), summary),
             stem).alias("title"),
    )


def normalise_pages(pages: DataFrame) -> DataFrame:
    """X1 + X14 on a page table; adds ``chars`` and ``kept``."""
    text = normalise_ws(F.col("text"))
    return (pages.withColumn("text", text)
                 .withColumn("chars", F.char_length("text"))
                 .withColumn("kept", F.col("chars") >= MIN_PAGE_CHARS))


def page_report(pages: DataFrame) -> DataFrame:
    """F3 + A14 (page part): pages, skipped and kept per source document."""
    norm = normalise_pages(pages)
    return norm.groupBy("source").agg(
        F.count(F.lit(1)).alias("pages"),
        F.count_if(~F.col("kept")).alias("skipped"),
        F.count_if(F.col("kept")).alias("kept"))


def _explode_chunks(kept: DataFrame, chunks: Column, carry: Sequence[str] = ()) -> DataFrame:
    """One row per chunk with inherited metadata, page, chunk, chars, id; ``carry`` names columns
    of the page that go along."""
    meta = document_metadata(F.col("source"))
    exploded = kept.select("source", "page_number", *carry, meta.alias("meta"),
                           F.posexplode(chunks).alias("chunk", "text"))
    return exploded.select(
        pdf_chunk_id(F.col("source"), F.col("page_number"), F.col("chunk")).alias("id"),
        "text", "meta.*", "source", F.col("page_number").alias("page"),
        F.col("chunk").cast("int").alias("chunk"),
        F.char_length("text").alias("chars"), *carry)


def chunk_pages(pages: DataFrame, size: int = PDF_CHUNK_SIZE, overlap: int = PDF_CHUNK_OVERLAP,
                separators: list[str] | None = None, carry: Sequence[str] = ()) -> DataFrame:
    """T1 + T6 + X4: normalise, drop short pages, split recursively by
    characters, one row per chunk. The filter runs before the Python stage."""
    kept = normalise_pages(pages).where(F.col("kept"))
    split = recursive_splitter(list(separators or PDF_SEPARATORS), size, overlap, len)
    return _explode_chunks(kept, split(F.col("text")), carry)


def fixed_chunks(text: Column, size: int = PDF_CHUNK_SIZE, overlap: int = PDF_CHUNK_OVERLAP) -> Column:
    """Fixed-width windows of ``size`` characters advancing by
    ``size - overlap``; built-in functions only."""
    step = size - overlap
    n = F.greatest(F.lit(1), F.ceil((F.char_length(text) - F.lit(overlap)) / F.lit(float(step))))
    return F.transform(F.sequence(F.lit(0), (n - 1).cast("int")),
                       lambda i: F.substring(text, i * step + 1, size))


def chunk_pages_fixed(pages: DataFrame, size: int = PDF_CHUNK_SIZE,
                      overlap: int = PDF_CHUNK_OVERLAP, carry: Sequence[str] = ()) -> DataFrame:
    kept = normalise_pages(pages).where(F.col("kept"))
    return _explode_chunks(kept, fixed_chunks(F.col("text"), size, overlap), carry)


def pack_sentences(text: Column, size: int = PDF_CHUNK_SIZE) -> Column:
    """T4: split after each ". " and pack whole sentences greedily up to
    ``size`` characters, no overlap. Lossless; a sentence longer than ``size``
    stays one chunk."""
    sentences = F.filter(F.split(text, r"(?<=\. )"), lambda s: s != "")
    empty = F.array().cast("array<string>")

    def step(acc, s):
        last = F.element_at(acc, -1)
        fits = (F.size(acc) > 0) & (F.char_length(last) + F.char_length(s) <= size)
        grown = F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.concat(last, s)))
        return F.when(fits, grown).otherwise(F.concat(acc, F.array(s)))

    return F.aggregate(sentences, empty, step)


SPLIT_FILES = "path string, kept array<string>, lengths array<int>, skipped int"


def file_pieces(batches: Iterator[pa.RecordBatch], separators: list[str], size: int, overlap: int, min_chars: int,
                length: Callable[[str], int], measure: Callable[[str], int] | None) -> Iterator[pa.RecordBatch]:
    """``SPLIT_FILES`` rows of batches of (path, text). One text and the pieces of some are Python
    strings at a time, whatever the batches hold."""
    names = SPLIT_FILES.replace(",", "").split()[::2]

    def flush(lo: int, hi: int) -> pa.RecordBatch:
        held = [batch.column(0).slice(lo, hi - lo), pa.array(kept, pa.list_(pa.string())),
                pa.array(lengths, pa.list_(pa.int32())), pa.array(skipped, pa.int32())]
        for rows in (kept, lengths, skipped):
            rows.clear()
        return pa.RecordBatch.from_arrays(held, names)

    kept: list[list[str]] = []
    lengths: list[list[int] | None] = []
    skipped: list[int] = []
    for batch in batches:
        lo = chars = 0
        for i, text in enumerate(batch.column(1)):
            pieces = [p.strip(" ") for p in split_recursive(text.as_py() or "", separators, size, overlap, length)]
            own = [p for p in pieces if len(p) >= min_chars]
            kept.append(own)
            lengths.append([measure(p) for p in own] if measure else None)
            skipped.append(len(pieces) - len(own))
            chars += sum(map(len, own))
            if chars >= SPLIT_BATCH_CHARS:
                yield flush(lo, i + 1)
                lo, chars = i + 1, 0
        if kept:
            yield flush(lo, batch.num_rows)


def split_markdown_files(files: DataFrame, size: int = MD_CHUNK_SIZE,
                         overlap: int = MD_CHUNK_OVERLAP, separators: list[str] | None = None,
                         min_chars: int = MIN_CHUNK_CHARS,
                         length: Callable[[str], int] = token_length,
                         measure: Callable[[str], int] | None = token_length) -> DataFrame:
    """T2 + F4: split each file by tokens, strip pieces, keep those of at
    least ``min_chars`` characters; one row per file with the kept pieces, their
    lengths by ``measure`` (null without one) and the number skipped."""
    seps = list(separators or MD_SEPARATORS)

    def run(batches):
        return file_pieces(batches, seps, size, overlap, min_chars, length, measure)

    return files.select("path", "text").mapInArrow(run, SPLIT_FILES).select(
        "path", F.element_at(F.split("path", "/"), -1).alias("source"), "kept", "lengths", "skipped")


def chunk_markdown(split_files: DataFrame, length: Callable[[str], int] | None = None,
                   window: int = MODEL_TOKEN_WINDOW) -> DataFrame:
    """W3 + X5 + T5: number the kept pieces of each file from 0 (after the
    short-piece filter), build path-based ids, flag chunks whose token length
    (as the split has measured it, or by ``length``) exceeds the embedding model's window."""
    pieces = F.arrays_zip("kept", F.coalesce("lengths", F.array().cast("array<int>")).alias("lengths"))
    chunks = split_files.select("path", "source", F.posexplode(pieces).alias("chunk", "piece")).select(
        "path", "source", "chunk", F.col("piece.kept").alias("text"), F.col("piece.lengths").alias("tokens"))
    tokens = F.pandas_udf(lambda texts: texts.map(length), "int")(F.col("text")) if length else F.col("tokens")
    return chunks.select(
        markdown_chunk_id(F.col("path"), F.col("chunk")).alias("id"),
        "text", "source", "path", F.col("chunk").cast("int").alias("chunk"),
        F.char_length("text").alias("chars"),
        (tokens > window).alias("over_window"))


def markdown_report(split_files: DataFrame) -> DataFrame:
    """Chunks kept and fragments skipped per file (empty files included)."""
    return split_files.select("path", F.size("kept").alias("chunks"), "skipped")


def document_report(pages: DataFrame, chunks: DataFrame) -> DataFrame:
    """Pages, skipped and chunks per document; documents without chunks
    stay (left join of two per-source aggregates)."""
    per_chunk = chunks.groupBy("source").agg(F.count(F.lit(1)).alias("chunks"))
    return (page_report(pages).join(per_chunk, "source", "left")
            .select("source", "pages", "skipped", F.coalesce("chunks", F.lit(0)).alias("chunks")))


def corpus_totals(chunks: DataFrame, embedding: str | None = "embedding") -> DataFrame:
    """Chunk count, mean chunk length, embedding dimension, rows held."""
    exprs = [F.count(F.lit(1)).alias("total_chunks"),
             F.round(F.avg("chars"), 4).alias("avg_chars")]
    if embedding:
        exprs.append(F.max(F.size(embedding)).alias("dimension"))
    exprs.append(F.count_distinct("id").alias("vectors_held"))
    return chunks.agg(*exprs)
