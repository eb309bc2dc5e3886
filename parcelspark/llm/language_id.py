"""Language identification by prediction with partial matching (PPM).

For each language a byte context tree of variable order (up to three bytes)
counts which byte followed which context in a bounded sample of labelled texts.
A byte costs ``-log2`` of its share after the longest known context; one that was
not seen there pays the escape (escape method C: distinct / (total + distinct))
and is looked up after the next shorter context with the bytes already ruled out
excluded, down to a uniform choice among bytes never seen. The statistics are
frozen, so each (context, byte) has one exact code length per language; these are
tabulated, and a text's code lengths are sums over its whole bytes.
"""

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .util import pieces_of, stored, text_buffers

ORDER = 3
#: Bytes of labelled text that each language is learned from, in expectation.
TRAIN_BYTES = 1_500_000
#: Characters of the pieces of texts that the learning sample takes or leaves.
PIECE = 2048
#: Code length, in bits a byte, beyond which a text is in none of the learned languages: plain bytes need 8.
REJECT_BITS = 8.0
RESULT = "lang_pred string, score double, bits_per_byte double"
_PAD = 0x0A  # what stands before a text


def held_out(id_col: Column) -> Column:
    """Documents kept out of the learning: crc32 of the id's text, modulo 4, is 2."""
    return F.coalesce(F.pmod(F.crc32(id_col.cast("string")), F.lit(4)) == 2, F.lit(False))


@dataclass
class Model:
    langs: list[str]
    byte_class: np.ndarray  # 256 -> class; 0: byte never learned
    n_classes: int
    row: np.ndarray         # three classes -> row of the table
    cost: np.ndarray        # [langs, row * n_classes + class] float32


def grams(docs: DataFrame, lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """``lang, gram, n``: how often each byte follows each three bytes; partial counts per batch, summed by Spark."""

    def run(batches):
        for batch in batches:
            langs = batch.column(0).to_pylist()
            offsets, raw = text_buffers(batch.column(1))
            parts = []
            for lo, hi in pieces_of(offsets):
                sizes = np.diff(offsets[lo:hi + 1])
                n = int(sizes.sum() + ORDER * (hi - lo))
                if not n:
                    continue
                data = np.full(n, _PAD, np.uint8)
                at = np.arange(offsets[hi] - offsets[lo]) + np.repeat(np.arange(1, hi - lo + 1) * ORDER, sizes)
                data[at] = raw[offsets[lo]:offsets[hi]]
                gram = np.zeros(len(at), np.int64)
                for k in range(ORDER, -1, -1):
                    gram = (gram << 8) + data[at - k]
                names, ids = np.unique([langs[r] or "" for r in range(lo, hi)], return_inverse=True)
                both, count = np.unique((np.repeat(ids, sizes) << 32) + gram, return_counts=True)
                parts.append(pa.RecordBatch.from_arrays(
                    [pa.array(names[both >> 32].tolist(), pa.string()), pa.array(both & 0xFFFFFFFF), pa.array(count.astype(np.int64))],
                    ["lang", "gram", "n"]))
            yield from parts

    picked = docs.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"))
    return picked.mapInArrow(run, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def sample(docs: DataFrame, train_bytes: int, id_col: str, lang_col: str, text_col: str) -> DataFrame:
    """Pieces of ``PIECE`` characters of labelled documents that are not held out, thinned by a hash of
    the id, the text and the piece's number to about ``train_bytes`` per language (all of a language that
    has fewer). One long text is so learned from in part, and rows without an id differ by their texts."""
    known = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & ~held_out(F.col(id_col)))
    known = known.select(F.col(id_col).cast("string").alias("id"), F.col(lang_col).cast("string").alias("lang"),
                         F.col(text_col).cast("string").alias("text"))
    share = known.groupBy("lang").agg((F.lit(float(train_bytes)) / F.greatest(F.sum(F.octet_length("text")), F.lit(1))).alias("share"))
    share = stored(share, "language-shares")  # a row per language: written, so that its size is known and the texts stay where they are
    numbers = F.sequence(F.lit(0), F.floor((F.length("text") - 1) / PIECE).cast("int"))
    one = known.where("text <> ''").join(share, "lang").withColumn("h", F.xxhash64("id", "text", F.lit("ppm")))
    rank = F.pmod(F.xxhash64("h", "piece"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    return (one.select("lang", "text", "share", "h", F.explode(numbers).alias("piece")).where(rank < F.col("share"))
            .select("lang", F.substring("text", F.col("piece") * PIECE + 1, F.lit(PIECE)).alias("text")))


def train(docs: DataFrame, train_bytes: int = TRAIN_BYTES, id_col: str = "doc_id", lang_col: str = "lang",
          text_col: str = "text") -> Model:
    """Learn one tree per language, with every context of the sample. The driver gets at most a row per four
    bytes and language of the bounded sample, and builds the table of code lengths."""
    rows = grams(sample(docs, train_bytes, id_col, lang_col, text_col)).toPandas()
    return build(rows["lang"].to_numpy(object), rows["gram"].to_numpy(np.int64), rows["n"].to_numpy(np.int64))


def build(lang: np.ndarray, gram: np.ndarray, n: np.ndarray) -> Model:
    langs = sorted(set(lang.tolist()))
    parts = [(gram >> s) & 0xFF for s in (24, 16, 8, 0)]
    seen = np.unique(np.concatenate([*parts, [_PAD]])).astype(int)
    byte_class = np.zeros(256, np.int64)
    byte_class[seen] = np.arange(1, len(seen) + 1)
    a = len(seen) + 1
    x, y, z, s = (byte_class[p] for p in parts)
    which = np.searchsorted(langs, lang) if langs else np.zeros(0, int)
    # Rows: order 0, then each known context of order 1, 2 and 3; parents come first.
    keys, parent, row = [np.zeros(1, np.int64)], [np.zeros(1, np.int64)], np.zeros(a ** 3, np.int32)
    context = {1: z, 2: y * a + z, 3: (x * a + y) * a + z}
    row_of = {0: np.zeros(1, np.int32)}
    base = 1
    for order in (1, 2, 3):
        known = np.unique(context[order])
        shorter = row_of[order - 1]
        table = np.tile(shorter, a)  # a context that is not known stands for its suffix
        up = table[known]
        table[known] = base + np.arange(len(known))
        row_of[order] = table
        keys.append(known)
        parent.append(up)
        base += len(known)
    row = row_of[3]
    count = np.zeros((base, a), np.float64)
    cost = np.zeros((max(1, len(langs)), base * a), np.float32)
    sizes = np.cumsum([0, *(len(k) for k in keys)])
    for li in range(len(langs)):
        count[:] = 0
        own = which == li
        for order in range(4):
            here = np.zeros(int(own.sum()), np.int64) if order == 0 else row_of[order][context[order][own]]
            np.add.at(count, (here, s[own]), n[own])
        bits = cost[li].reshape(base, a)
        for order in range(4):
            for lo in range(sizes[order], sizes[order + 1], 4096):
                rows = np.arange(lo, min(lo + 4096, sizes[order + 1]))
                bits[rows] = _code_lengths(count, rows, order, parent, sizes, 256 - len(seen))
    return Model(langs, byte_class, a, row, cost)


def _code_lengths(count: np.ndarray, rows: np.ndarray, order: int, parent: list[np.ndarray], sizes: np.ndarray,
                  unseen: int) -> np.ndarray:
    """Bits of each byte class after the contexts ``rows``: method C with exclusion, from the full context down."""
    bits = np.zeros((len(rows), count.shape[1]))
    coded = np.zeros(bits.shape, bool)   # classes that have their code
    escaped = np.zeros(len(rows))
    at = rows
    while True:
        here = np.where(coded, 0.0, count[at])
        total, distinct = here.sum(1), (here > 0).sum(1)
        new = here > 0
        with np.errstate(divide="ignore"):
            own = -np.log2(here / np.maximum(total + distinct, 1)[:, None])
            out = -np.log2(distinct / np.maximum(total + distinct, 1))
        bits[new] = (escaped[:, None] + own)[new]
        coded |= new
        escaped = escaped + np.where(distinct > 0, out, 0.0)
        if order == 0:
            break
        at = parent[order][at - sizes[order]]
        order -= 1
    left = (~coded).sum(1) - 1 + unseen  # class 0 stands for every byte never learned
    rest = escaped + np.log2(np.maximum(left, 1))
    return np.where(coded, bits, rest[:, None])


def code_lengths(model: Model, column: pa.Array) -> np.ndarray:
    """[rows, langs] exact code lengths in bits of whole texts."""
    offsets, raw = text_buffers(column)
    out = np.zeros((len(offsets) - 1, len(model.langs)))
    a, pad = model.n_classes, model.byte_class[_PAD]
    for lo, hi in pieces_of(offsets, 1 << 20):
        b = raw[offsets[lo]:offsets[hi]]
        if not len(b):
            continue
        c = model.byte_class[b]
        heads = (offsets[lo:hi] - offsets[lo])[np.diff(offsets[lo:hi + 1]) > 0]
        tails = np.append(heads[1:], len(b))
        shifted = []
        for k in (1, 2, 3):
            p = np.empty_like(c)
            p[k:] = c[:-k]
            p[:k] = pad
            for j in range(k):  # the first bytes of a text look back at the pad
                p[(heads + j)[heads + j < tails]] = pad
            shifted.append(p)
        at = model.row[(shifted[2] * a + shifted[1]) * a + shifted[0]].astype(np.int64) * a + c
        rows = np.flatnonzero(np.diff(offsets[lo:hi + 1]) > 0) + lo
        for li in range(len(model.langs)):
            out[rows, li] = np.add.reduceat(model.cost[li][at], heads, dtype=np.float64)
    return out


def _letters(column: pa.Array) -> np.ndarray:
    """Rows with a letter of any script."""
    return pc.fill_null(pc.match_substring_regex(column, r"\p{L}"), False).to_numpy(zero_copy_only=False)


def classify(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred``, ``score`` and ``bits_per_byte`` added (replacing columns of these names).

    ``lang_pred`` is the language of the shortest code (ties: first by name), and
    ``score`` its probability if all languages are equally likely beforehand.
    ``und`` with score 0 and null bits: a null text, a text without a letter, or a model
    without languages. All other columns, nulls and repeated rows stay as they are.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        m = shared.value
        for texts in batches:
            column = pa.Array.from_pandas(texts, type=pa.string())
            bits = code_lengths(m, column)
            size = np.maximum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False), 1)
            ok = _letters(column) & (len(m.langs) > 0)
            if not len(m.langs):
                bits = np.zeros((len(texts), 1))
            best = bits.argmin(1)
            low = bits[np.arange(len(bits)), best]
            score = np.where(ok, 1 / np.exp2(np.maximum(low[:, None] - bits, -1000)).sum(1), 0.0)
            names = np.array([*m.langs, "und"], object)
            yield pd.DataFrame({"lang_pred": names[np.where(ok, best, len(m.langs))], "score": score,
                                "bits_per_byte": pd.Series(np.where(ok, low / size, np.nan)).where(ok, None)})

    udf = F.pandas_udf(predict, RESULT)
    kept = [c for c in docs.columns if c.lower() not in ("lang_pred", "score", "bits_per_byte", "_ppm")]
    return (docs.select(*(F.col(f"`{c}`") for c in kept), udf(F.col(text_col).cast("string")).alias("_ppm"))
            .select(*(F.col(f"`{c}`") for c in kept), "_ppm.lang_pred", "_ppm.score", "_ppm.bits_per_byte"))


def accepted(max_bits: float = REJECT_BITS) -> Column:
    """Rows of ``classify`` that are in a learned language: not ``und``, and coded in fewer bits than plain bytes."""
    return (F.col("lang_pred") != "und") & (F.col("bits_per_byte") < max_bits)
