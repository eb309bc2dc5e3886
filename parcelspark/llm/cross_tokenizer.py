"""Cross-tokenizer alignment by sparse products.

Both tokenizers cut the same bytes. The incidence of token occurrences and bytes is a
sparse matrix per tokenizer, A and B, built by hand in CSR form (row bounds and column
numbers). The product A * transpose(B), row by row as Gustavson does it (for each
nonzero (i, k) of A add row k of the other factor), has a nonzero for every overlapping
pair of tokens, whose value is the number of bytes they share. Places where tokens of both
end cut the text into groups; the product of the two group incidences links all tokens of
a group. Products are formed for a slice of about a megabyte of bytes at a time.

How common a pair of ids is comes from the whole corpus. Documents are worked on in blocks;
a block counts its distinct pairs once, so that what is shuffled by pair is a row per block
and pair, not per document; corpus counts come back to the block in the same way.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .packing import encoder
from .token_counts import byte_alphabet
from .util import binaries, documents, pieces_of, stored, text_buffers

#: Bytes of which a product is formed at a time, and of a block of documents (a longer text is a block of its own).
SLICE, BLOCK = 1 << 20, 1 << 23
LINK = "struct<a:int,b:int,bytes:int>"
ALIGNED = f"doc_id long, a_ids array<int>, b_ids array<int>, groups string, links array<{LINK}>, n_shared long"
BLOCKS = ("block long, doc_id array<long>, n_a array<long>, n_b array<long>, n_groups array<long>, n_links array<long>, "
          "n_shared array<long>, groups_sha256 array<string>, pairs array<long>, n_docs array<long>, "
          "first array<long>, pair binary, times binary")
RESULT = ("doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, "
          "groups_sha256 string, n_shared long")
_PER_DOC = ["n_a", "n_b", "n_groups", "n_links", "n_shared"]


@dataclass
class CSR:
    """Rows ``i`` hold the columns ``columns[first[i]:first[i+1]]``, each with the value 1."""

    first: np.ndarray
    columns: np.ndarray

    def transposed(self, n_columns: int) -> CSR:
        rows = np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))
        order = np.argsort(self.columns, kind="stable")
        return CSR(np.concatenate(([0], np.cumsum(np.bincount(self.columns, minlength=n_columns)))), rows[order])


def intervals(bounds: np.ndarray, lo: int, hi: int) -> CSR:
    """Incidence of the tokens between ``bounds`` with the bytes ``lo:hi`` that they lie on."""
    cut = np.clip(bounds, lo, hi) - lo
    return CSR(cut, np.arange(hi - lo))


def gustavson(a: CSR, b: CSR, n_columns: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Nonzeros (row, column, value) of the product of two incidence matrices, by row and column."""
    reach = np.diff(b.first)[a.columns]
    rows = np.repeat(np.repeat(np.arange(len(a.first) - 1), np.diff(a.first)), reach)
    ends = np.cumsum(reach)
    at = np.arange(len(rows)) + np.repeat(b.first[a.columns] - ends + reach, reach)
    key = rows * n_columns + b.columns[at]
    if (key[1:] < key[:-1]).any():
        key.sort()
    heads = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))[:len(key)])
    return key[heads] // n_columns, key[heads] % n_columns, np.diff(np.append(heads, len(key)))


def overlaps(a_bounds: np.ndarray, b_bounds: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(A token, B token, shared bytes) of all overlapping pairs, by slices of whole A tokens.
    The bounds are the byte offsets of both tokenizers' tokens over the same bytes."""
    i, n = 0, len(a_bounds) - 1
    while i < n:
        j = int(np.searchsorted(a_bounds, a_bounds[i] + SLICE, side="right")) - 1
        j = min(n, max(j, i + 1))
        lo, hi = int(a_bounds[i]), int(a_bounds[j])
        u = int(np.searchsorted(b_bounds, lo, side="right")) - 1
        v = int(np.searchsorted(b_bounds, hi, side="left"))
        bytes_of_b = intervals(b_bounds[u:v + 1], lo, hi).transposed(hi - lo)
        x, y, shared = gustavson(intervals(a_bounds[i:j + 1], lo, hi), bytes_of_b, v - u)
        yield x + i, y + u, shared
        i = j


class Pair:
    """Two tokenizers: a byte-level vocabulary (text of its ``tokenizers`` JSON file) and a piece model (bytes)."""

    def __init__(self, spec: str, model: bytes):
        import sentencepiece

        self.spec, self.fast, self.library = spec, encoder(spec), None
        self.pieces = sentencepiece.SentencePieceProcessor(model_proto=model)
        byte = {c: b for b, c in byte_alphabet().items()}
        vocab = json.loads(spec)["model"]["vocab"]
        self.a_bytes = [b""] * (max(vocab.values()) + 1)
        for token, i in vocab.items():
            self.a_bytes[i] = bytes(byte.get(c, 0) for c in token)
        self.b_bytes = [self._piece(i) for i in range(self.pieces.get_piece_size())]
        self.a_size, self.b_size = (np.array([len(x) for x in t], np.int64) for t in (self.a_bytes, self.b_bytes))
        va, vb = len(self.a_bytes), len(self.b_bytes)
        #: Decimal ids with what follows them: A and more of A, A and then B, B and more of B, B and the next group.
        self.shown = [b"%d%s" % (i, end) for n, end in ((va, b","), (va, b"|"), (vb, b","), (vb, b";")) for i in range(n)]

    def _piece(self, i: int) -> bytes:
        piece = self.pieces.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if self.pieces.is_byte(i) else piece.replace("▁", " ").encode()

    def by_bytes(self, text: str) -> np.ndarray:
        try:
            return self.fast.encode_to_numpy(text, disallowed_special=()).astype(np.int64)
        except (KeyboardInterrupt, SystemExit):
            raise
        except BaseException:  # millions of blanks: an error, or a panic, which is no Exception
            if self.library is None:
                from tokenizers import Tokenizer
                self.library = Tokenizer.from_str(self.spec)
                self.library.encode_special_tokens = True
            return np.array(self.library.encode(text, add_special_tokens=False).ids, np.int64)

    def tokens(self, texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Ids of each text by both tokenizers; none where they do not spell a blank and the text."""
        none = np.zeros(0, np.int64)
        decoded = [t.decode() for t in texts]
        for text, raw, b in zip(decoded, texts, self.pieces.encode(decoded, num_threads=1)):
            if not raw or b"".join(map(self.b_bytes.__getitem__, b)) != b" " + raw:
                yield none, none
                continue
            a = self.by_bytes(" " + text)
            same = b"".join(map(self.a_bytes.__getitem__, a.tolist())) == b" " + raw
            yield (a, np.array(b, np.int64)) if same else (none, none)


@dataclass
class Alignment:
    """Texts aligned together: tokens of all of them in order, with ``a_of[d]:a_of[d+1]`` text d's."""

    a: np.ndarray
    b: np.ndarray
    a_of: np.ndarray
    b_of: np.ndarray
    a_bounds: np.ndarray
    b_bounds: np.ndarray
    a_group: np.ndarray
    b_group: np.ndarray
    group_of: np.ndarray


def align(pair: Pair, texts: list[bytes]) -> Alignment:
    both = list(pair.tokens(texts))
    none = [np.zeros(0, np.int64)]
    a, b = (np.concatenate([x[k] for x in both] or none) for k in (0, 1))
    a_of, b_of = (np.cumsum([0, *(len(x[k]) for x in both)]) for k in (0, 1))
    a_bounds, b_bounds = (np.concatenate(([0], np.cumsum(size[ids]))) for size, ids in ((pair.a_size, a), (pair.b_size, b)))
    ends = np.intersect1d(a_bounds[1:], b_bounds[1:], assume_unique=True)
    # Each text's last tokens end together, so no group reaches beyond its text.
    return Alignment(a, b, a_of, b_of, a_bounds, b_bounds, np.searchsorted(ends, a_bounds[1:]), np.searchsorted(ends, b_bounds[1:]),
                     np.searchsorted(ends, a_bounds[a_of], side="right"))


def shared_sizes(m: Alignment) -> np.ndarray:
    """Shared-group links of each A token: the row lengths of (A tokens x groups) * (groups x B tokens)."""
    n = int(m.group_of[-1])
    groups = CSR(np.arange(len(m.b) + 1), m.b_group).transposed(n)
    return np.diff(groups.first)[m.a_group]


def shared_links(m: Alignment) -> tuple[np.ndarray, np.ndarray]:
    """(A token, B token) of all pairs in one group: the nonzeros of that product. Their number is the
    sum of the products of a group's sizes; ``shared_sizes`` counts without making them."""
    n = int(m.group_of[-1])
    x, y, _ = gustavson(CSR(np.arange(len(m.a) + 1), m.a_group), CSR(np.arange(len(m.b) + 1), m.b_group).transposed(n), len(m.b))
    return x, y


def shown_groups(pair: Pair, m: Alignment) -> list[bytes]:
    """``a1,a2|b1;a3|b2,b3`` of each text."""
    va, vb, n = len(pair.a_bytes), len(pair.b_bytes), int(m.group_of[-1])
    last_a, last_b = (np.append(g[1:] != g[:-1], True)[:len(g)] for g in (m.a_group, m.b_group))
    before_b = np.concatenate(([0], np.cumsum(np.bincount(m.b_group, minlength=n))))
    upto_a = np.cumsum(np.bincount(m.a_group, minlength=n))
    order = np.empty(len(m.a) + len(m.b), np.int64)
    order[np.arange(len(m.a)) + before_b[m.a_group]] = m.a + va * last_a
    order[np.arange(len(m.b)) + upto_a[m.b_group]] = 2 * va + m.b + vb * last_b
    ends = (m.a_of + m.b_of).tolist()
    return [b"".join([pair.shown[c] for c in order[s:e].tolist()])[:-1] for s, e in zip(ends, ends[1:])]


def _pair_of(docs: DataFrame, vocabulary: str, model: str):
    with open(vocabulary, encoding="utf-8") as f, open(model, "rb") as g:
        files = docs.sparkSession.sparkContext.broadcast((f.read(), g.read()))
    return lambda: Pair(*files.value)


def _texts(column: pa.Array) -> Iterator[tuple[int, int, list[bytes]]]:
    offsets, raw = text_buffers(column)
    for lo, hi in pieces_of(offsets):
        yield lo, hi, [raw[offsets[r]:offsets[r + 1]].tobytes() for r in range(lo, hi)]


def aligned(docs: DataFrame, vocabulary: str, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Token ids, groups and links of every row: ``doc_id, a_ids, b_ids, groups, links, n_shared``.

    ``vocabulary`` and ``model`` are the paths, on the driver, of a byte-level BPE file in the
    ``tokenizers`` JSON format (A, which reads a blank and the text) and of a ``sentencepiece`` model
    (B); their content, of fixed size, is broadcast. ``links`` are the pairs of tokens (numbered in
    their text from 0) that share bytes; ``groups`` shows the ids between places where tokens of both
    end; ``n_shared`` counts the pairs of tokens in one group. Strings of special tokens are plain text.

    A text that is null, empty, or not spelt by either tokenizer (a model may change it) has no tokens.
    Null ids and repeated rows are kept as they are; extra columns are ignored; an empty table gives an
    empty result. A very long text is worked on whole by its task, its products slice by slice.
    """
    load = _pair_of(docs, vocabulary, model)

    def run(batches):
        pair = load()
        kind = pa.struct([("a", pa.int32()), ("b", pa.int32()), ("bytes", pa.int32())])
        for batch in batches:
            for lo, hi, texts in _texts(batch.column(1)):
                m = align(pair, texts)
                x, y, shared = (np.concatenate(c) for c in zip((np.zeros(0, np.int64),) * 3, *overlaps(m.a_bounds, m.b_bounds)))
                doc = np.searchsorted(m.a_of, x, side="right") - 1
                links = pa.StructArray.from_arrays([pa.array(v, pa.int32()) for v in (x - m.a_of[doc], y - m.b_of[doc], shared)], fields=list(kind))
                total = np.concatenate(([0], np.cumsum(shared_sizes(m))))[m.a_of]

                def lists(of, values):
                    return pa.ListArray.from_arrays(pa.array(of, pa.int32()), values)
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(lo, hi - lo), lists(m.a_of, pa.array(m.a, pa.int32())), lists(m.b_of, pa.array(m.b, pa.int32())),
                    pa.array([s.decode() for s in shown_groups(pair, m)], pa.string()),
                    lists(np.searchsorted(doc, np.arange(hi - lo + 1)), links), pa.array(np.diff(total))],
                    ["doc_id", "a_ids", "b_ids", "groups", "links", "n_shared"])

    return documents(docs, id_col, text_col).mapInArrow(run, ALIGNED)


class _Block:
    """Documents gathered until they make up a block."""

    def __init__(self, shift: int):
        self.shift, self.n, self.size = shift, 0, 0
        self.ids, self.columns, self.shas, self.keys, self.times = [], {c: [] for c in _PER_DOC}, [], [], []

    def add(self, pair: Pair, ids: pa.Array, m: Alignment) -> None:
        n_docs = len(m.a_of) - 1
        n_links = np.zeros(n_docs, np.int64)
        for x, y, _ in overlaps(m.a_bounds, m.b_bounds):
            doc = np.searchsorted(m.a_of, x, side="right") - 1
            n_links += np.bincount(doc, minlength=n_docs)
            key, times = np.unique(((doc + self.n) << self.shift) | (m.a[x] * len(pair.b_bytes) + m.b[y]), return_counts=True)
            self.keys.append(key)
            self.times.append(times)
        shared = np.concatenate(([0], np.cumsum(shared_sizes(m))))[m.a_of]
        for c, v in zip(_PER_DOC, (np.diff(m.a_of), np.diff(m.b_of), np.diff(m.group_of), n_links, np.diff(shared))):
            self.columns[c].append(v)
        self.shas += [hashlib.sha256(s).hexdigest() if s else "" for s in shown_groups(pair, m)]
        self.ids.append(ids)
        self.n += n_docs
        self.size += int(m.a_bounds[-1])

    def row(self, block: int) -> pa.RecordBatch:
        none = [np.zeros(0, np.int64)]
        key, times = np.concatenate(self.keys or none), np.concatenate(self.times or none)
        order = np.argsort(key, kind="stable")
        key, times = key[order], times[order]
        heads = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))[:len(key)])
        times = np.add.reduceat(times, heads) if len(heads) else times
        key = key[heads]
        pairs, at, n_docs = np.unique(key & ((1 << self.shift) - 1), return_inverse=True, return_counts=True)
        first = np.searchsorted(key >> self.shift, np.arange(self.n + 1))
        lists = [pa.chunked_array(self.ids).combine_chunks(), *(np.concatenate(self.columns[c]) for c in _PER_DOC), pa.array(self.shas, pa.string()), pairs, n_docs, first]
        one = [pa.ListArray.from_arrays(pa.array([0, len(v)], pa.int32()), v if isinstance(v, pa.Array) else pa.array(v, pa.int64())) for v in lists]
        whole = np.array([0, len(key)])
        return pa.RecordBatch.from_arrays(
            [pa.array([block], pa.int64()), *one, binaries(at.reshape(-1).astype(np.int32), whole), binaries(times.astype(np.int32), whole)],
            [c.split()[0] for c in BLOCKS.split(", ")])


def blocks(docs: DataFrame, vocabulary: str, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per block of documents: their counts, the block's distinct pairs of ids with the number of
    its documents that hold each, and which document holds which pair how often."""
    load = _pair_of(docs, vocabulary, model)

    def run(batches):
        pair = load()
        shift = (len(pair.a_bytes) * len(pair.b_bytes)).bit_length()
        number = TaskContext.get().partitionId() << 32
        held = _Block(shift)
        for batch in batches:
            for lo, hi, texts in _texts(batch.column(1)):
                held.add(pair, batch.column(0).slice(lo, hi - lo), align(pair, texts))
                if held.size >= BLOCK or held.n >= 1 << 20:
                    yield held.row(number)
                    number, held = number + 1, _Block(shift)
        if held.n:
            yield held.row(number)

    return documents(docs, id_col, text_col).mapInArrow(run, BLOCKS)


def corpus_alignment(docs: DataFrame, vocabulary: str, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256, n_shared`` of every row.

    A pair of ids counts in how many rows of the table it is linked. ``n_best`` are the links whose
    pair's count is the highest that their A id has (ties included), ``count_sum`` the sum of the counts
    over the links. For parameters, odd texts and odd rows see ``aligned``; a row without tokens has
    zeros and an empty ``groups_sha256``. Repeated rows count as often as they stand in the table.
    """
    import sentencepiece

    b_ids = sentencepiece.SentencePieceProcessor(model_file=model).get_piece_size()
    table = stored(blocks(docs, vocabulary, model, id_col, text_col), "alignment-blocks")
    counts = (table.select(F.explode(F.arrays_zip("pairs", "n_docs")).alias("p"))
              .groupBy(F.col("p.pairs").alias("pair")).agg(F.sum("p.n_docs").alias("n"))
              .withColumn("a", F.expr(f"pair div {b_ids}")))
    counts = stored(counts, "alignment-counts")
    highest = counts.groupBy("a").agg(F.max("n").alias("most"))
    counts = counts.join(highest, "a").select("pair", "n", (F.col("n") == F.col("most")).alias("best"))
    # Rows by block and pair; of a block there are as many as it has distinct pairs.
    told = (table.select("block", F.posexplode("pairs").alias("at", "pair")).join(counts, "pair")
            .groupBy("block").agg(F.array_sort(F.collect_list(F.struct("at", "n", "best"))).alias("told"))
            .select("block", F.col("told.n").alias("n"), F.col("told.best").alias("best")))
    wanted = ["doc_id", *_PER_DOC, "groups_sha256", "first", "pair", "times", "n", "best"]

    def run(batches):
        for batch in batches:
            for r in range(batch.num_rows):
                got = {c: batch.column(c)[r] for c in wanted}
                ids, sha = got["doc_id"].values, got["groups_sha256"].values
                each = {c: got[c].values for c in _PER_DOC}
                first = got["first"].values.to_numpy()
                at, times = (np.frombuffer(got[c].as_py(), np.int32).astype(np.int64) for c in ("pair", "times"))
                best, total = np.zeros(len(first) - 1, np.int64), np.zeros(len(first) - 1, np.int64)
                if len(at):
                    n, top = got["n"].values.to_numpy(), got["best"].values.to_numpy(zero_copy_only=False)
                    sums = (np.concatenate(([0], np.cumsum(v))) for v in (times * top[at], times * n[at]))
                    best, total = (np.diff(s[first]) for s in sums)
                yield pa.RecordBatch.from_arrays(
                    [ids, *(each[c] for c in _PER_DOC[:4]), pa.array(best), pa.array(total), sha, each["n_shared"]],
                    [c.split()[0] for c in RESULT.split(", ")])

    return table.join(told, "block", "left").select(*wanted).mapInArrow(run, RESULT)
