"""Best-fit-decreasing packing with a segment tree over remaining capacities.

Tokenising and cutting run on the rows. Best fit decreasing sees only lengths,
so the packing of any number of pieces follows from how many pieces each length
has: at most ``capacity`` counts. The plan opens and fills *groups* of equal bins
(same remaining capacity, consecutive numbers); a segment tree over the
remaining capacities finds the tightest group that still fits in logarithmic
time. Pieces of one length are interchangeable: each gets its rank among them,
counted in salted shares, and finds its bin in the plan. The result is that of
the serial algorithm, and no task, group or driver holds the pieces.
"""

from __future__ import annotations

import json
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .token_counts import PATTERN, byte_alphabet
from .util import documents, stored

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
PACKED = PIECES + ", sequence_id long, offset long"
#: Pieces of one length that a ranking window orders at most, on average.
SHARE = 1 << 16


def encoder(spec: str):
    """Encoder of the byte-level vocabulary in ``spec`` (a ``tokenizers`` JSON
    text). The file's ids are the merge ranks, so ``tiktoken`` gives the ids that
    ``tokenizers`` gives (compared in the tests) at a fifth of its time. It gives up
    on white space of about a million characters; see ``ids_of``."""
    import tiktoken

    spec = json.loads(spec)
    byte = {c: b for b, c in byte_alphabet().items()}
    special = {t["content"]: t["id"] for t in spec.get("added_tokens") or []}
    ranks = {bytes(byte[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in special}
    return tiktoken.Encoding("packing", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special)


def ids_of(spec: str):
    """Function from a text to its ids: by ``tiktoken``, or by ``tokenizers`` where that gives up."""
    fast, library = encoder(spec), None

    def ids(text: str):
        nonlocal library
        try:
            return fast.encode_to_numpy(text, allowed_special="all")
        except ValueError:
            if library is None:
                from tokenizers import Tokenizer
                library = Tokenizer.from_str(spec)
            return library.encode(text, add_special_tokens=False).ids

    return ids


def cut(docs: DataFrame, vocabulary: str, capacity: int, end_id: int,
        id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces of at most ``capacity`` tokens of every document: all but its first are of ``capacity``."""
    with open(vocabulary, encoding="utf-8") as f:
        spec = docs.sparkSession.sparkContext.broadcast(f.read())

    def run(batches):
        ids_in = ids_of(spec.value)
        for batch in batches:
            rows, piece, start, length, crc = [], [], [], [], []
            for r, text in enumerate(batch.column(1)):
                text = text.as_py()
                ids = np.append(ids_in(text) if text else [], end_id).astype("<u4")
                first = len(ids) % capacity or capacity
                for k, e in enumerate(range(first, len(ids) + 1, capacity)):
                    s = max(0, e - capacity)
                    part = ids[s:e]
                    rows.append(r)
                    piece.append(k)
                    start.append(s)
                    length.append(len(part))
                    crc.append(zlib.crc32(part.tobytes()))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(rows, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()),
                 pa.array(length, pa.int64()), pa.array(crc, pa.int64())],
                ["doc_id", "piece", "start", "length", "ids_crc32"])

    return documents(docs, id_col, text_col).mapInArrow(run, PIECES)


class OpenBins:
    """Groups of open bins by remaining capacity, under a segment tree that knows which capacities are open."""

    def __init__(self, capacity: int):
        self.size = 1 << capacity.bit_length()
        self.open = bytearray(2 * self.size)
        self.groups: list[list[tuple[int, int]]] = [[] for _ in range(capacity + 1)]

    def _mark(self, room: int) -> None:
        i = self.size + room
        self.open[i] = bool(self.groups[room])
        while i > 1:
            i >>= 1
            self.open[i] = self.open[2 * i] | self.open[2 * i + 1]

    def put(self, room: int, first: int, n: int) -> None:
        self.groups[room].append((first, n))
        self._mark(room)

    def take(self, room: int) -> tuple[int, int]:
        group = self.groups[room].pop()
        self._mark(room)
        return group

    def tightest(self, need: int) -> int | None:
        """Smallest open remaining capacity of at least ``need``."""
        i = self.size + need
        if self.open[i]:
            return need
        while i > 1:
            if i % 2 == 0 and self.open[i + 1]:
                i += 1
                while i < self.size:
                    i = 2 * i if self.open[2 * i] else 2 * i + 1
                return i - self.size
            i >>= 1
        return None


def plan(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """Best fit decreasing on counts by length: rows (length, first rank, pieces, first bin, offset).
    Pieces ``rank .. rank+pieces-1`` of the length go to consecutive bins at that offset."""
    bins, rows, n_bins = OpenBins(capacity), [], 0
    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        while left:
            room = bins.tightest(length)
            if room is None:
                room, first, n = capacity, n_bins, -(-left // (capacity // length))
                n_bins += n
            else:
                first, n = bins.take(room)
            each = room // length  # a bin just filled is the tightest again while it has room
            full = min(n, left // each)
            rest = left - full * each if full < n else 0
            rest = min(rest, each)
            for group, size, times in ((first, full, each), (first + full, 1, rest)):
                if not size or not times:
                    continue
                for t in range(times):
                    rows.append((length, rank, size, group, capacity - room + t * length))
                    rank += size
                left -= size * times
                bins.put(room - times * length, group, size)
            used = full + (rest > 0)
            if used < n:
                bins.put(room, first + used, n - used)
    return rows


def pack(docs: DataFrame, vocabulary: str, capacity: int = 1024, end_id: int = 2,
         id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pack every document's tokens, ``end_id`` last, into sequences of ``capacity`` tokens.

    One row per piece: ``doc_id, piece, start, length, ids_crc32, sequence_id,
    offset``. Only documents of more than ``capacity`` tokens are cut, so that the first
    piece takes what the others, of ``capacity`` tokens each, leave. A null or
    empty text is the one token ``end_id``; null ids and repeated rows are packed
    like others; an empty table gives an empty result; extra columns are ignored.
    """
    pieces = stored(cut(docs, vocabulary, capacity, end_id, id_col, text_col), "packing-pieces")
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    rows = plan(counts, capacity)  # at most `capacity` counts reach the driver
    shares = max(1, sum(counts.values()) // SHARE)
    salted = pieces.withColumn("share", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(shares)))
    inner = Window.partitionBy("length", "share").orderBy("doc_id", "piece", "ids_crc32")
    before = Window.partitionBy("length").orderBy("share").rowsBetween(Window.unboundedPreceding, -1)
    base = (salted.groupBy("length", "share").agg(F.count(F.lit(1)).alias("n"))
            .select("length", "share", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base")))
    ranked = (salted.withColumn("rn", F.row_number().over(inner)).join(base, ["length", "share"])
              .select("doc_id", "piece", "start", "length", "ids_crc32",
                      (F.col("base") + F.col("rn") - 1).cast("long").alias("rank")))
    table = np.array(sorted(rows), np.int64).reshape(-1, 5)
    shared = docs.sparkSession.sparkContext.broadcast(table)

    def place(batches):
        t = shared.value
        # (length, rank) in one ordered number per plan row: lengths hold fewer than 2**44 pieces.
        key = (t[:, 0] << 44) + t[:, 1]
        for batch in batches:
            length, rank = (batch.column(i).to_numpy(zero_copy_only=False) for i in (3, 5))
            at = np.searchsorted(key, (length << 44) + rank, side="right") - 1
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:5], pa.array(t[at, 3] + rank - t[at, 1]), pa.array(t[at, 4])],
                ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return ranked.mapInArrow(place, PACKED)
