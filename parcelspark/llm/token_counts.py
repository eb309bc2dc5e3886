"""Token counts by heap-and-linked-list byte-pair merging.

A word piece starts as one symbol per byte, chained by ``prev``/``next``. A heap
holds the mergeable neighbours by (rank, place); the lowest is popped, its two
symbols become one, and the two pairs around the new symbol are pushed. Tokens
= initial symbols - merges; identifiers are never produced.

Spark hands out the rows; a task keeps the counts of pieces it has met in a
dictionary of bounded size (it is emptied when full, which costs time, not results).
"""

from __future__ import annotations

import heapq
import json
import re

import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame

from .util import documents

#: Splits a text before the merges (the pattern of the vocabulary file's byte-level pre-tokenizer; fixed value).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
SCHEMA = "doc_id long, n_bytes long, n_tokens long, over_limit boolean"
#: Pieces that a task remembers at most, of either kind.
CACHE = 300_000


def byte_alphabet() -> dict[int, str]:
    """The printable character that stands for each byte in the vocabulary file:
    printable Latin-1 stands for itself, the rest for U+0100 onwards in order."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(0x100 + i) for i, b in enumerate(rest)}


class _Irregular(Exception):
    """A chunk that white space surrounds: the text is cut by the pattern as a whole."""


class Counter:
    """Counts tokens under the byte-level vocabulary in ``spec`` (the text of its JSON file)."""

    def __init__(self, spec: str):
        spec = json.loads(spec)
        model = spec["model"]
        vocab = model["vocab"]
        self.symbol = [vocab[c] for _, c in sorted(byte_alphabet().items())]
        self.merge: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.merge[vocab[a], vocab[b]] = (rank, vocab[a + b])
        added = [t["content"] for t in spec.get("added_tokens") or []]
        self.added = re.compile("|".join(re.escape(t) for t in sorted(added, key=len, reverse=True))) if added else None
        self.first_of_added = added
        self.cut = regex.compile(PATTERN).findall
        self.pieces: dict[str, int] = {}
        outer = self

        class Chunks(dict):
            """Tokens of a chunk that a single space precedes. Both its ends are no white
            space, so the space belongs to the chunk's first piece and no piece crosses."""

            def __missing__(self, chunk: str) -> int:
                if not chunk or chunk[0].isspace() or chunk[-1].isspace():
                    raise _Irregular
                n = outer.by_pieces(" " + chunk)
                if len(self) >= CACHE:
                    self.clear()
                self[chunk] = n
                return n

        self.chunks = Chunks()

    def merged(self, piece: bytes) -> int:
        sym = [self.symbol[b] for b in piece]
        n = len(sym)
        merge = self.merge
        heap = []
        for i in range(n - 1):
            if (m := merge.get((sym[i], sym[i + 1]))) is not None:
                heap.append((m[0], i, sym[i], sym[i + 1], m[1]))
        if not heap:
            return n
        heapq.heapify(heap)
        nxt, prev = list(range(1, n + 1)), list(range(-1, n - 1))
        count = n
        while heap:
            _, i, a, b, new = heapq.heappop(heap)
            j = nxt[i]
            if sym[i] != a or j >= n or sym[j] != b:
                continue  # one of the two has been merged meanwhile
            sym[i], sym[j] = new, -1
            k = nxt[i] = nxt[j]
            count -= 1
            if k < n:
                prev[k] = i
                if (m := merge.get((new, sym[k]))) is not None:
                    heapq.heappush(heap, (m[0], i, new, sym[k], m[1]))
            if (h := prev[i]) >= 0 and (m := merge.get((sym[h], new))) is not None:
                heapq.heappush(heap, (m[0], h, sym[h], new, m[1]))
        return count

    def by_pieces(self, text: str) -> int:
        known, total = self.pieces, 0
        for piece in self.cut(text):
            n = known.get(piece)
            if n is None:
                n = self.merged(piece.encode())
                if len(known) >= CACHE:
                    known.clear()
                if len(piece) < 64:
                    known[piece] = n
            total += n
        return total

    def plain(self, text: str) -> int:
        """Tokens of a text without added tokens."""
        head, *rest = text.split(" ")
        if head and head[-1].isspace():
            return self.by_pieces(text)
        try:
            return self.by_pieces(head) + sum(map(self.chunks.__getitem__, rest)) if head else self.by_pieces(text)
        except _Irregular:
            return self.by_pieces(text)

    def __call__(self, text: str | None) -> int:
        if not text:
            return 0
        if self.added is None or not any(t in text for t in self.first_of_added):
            return self.plain(text)
        parts = self.added.split(text)
        return len(parts) - 1 + sum(self.plain(p) for p in parts if p)


def count_tokens(docs: DataFrame, vocabulary: str, limit: int = 512,
                 id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` of every row.

    ``vocabulary`` is the path, on the driver, of a byte-level BPE file in the
    ``tokenizers`` JSON format; its content (a file of fixed size) is broadcast.
    Added tokens inside a text count as one each, as the library does by default.
    A null or empty text has 0 bytes and 0 tokens; null ids and repeated rows are
    kept as they are; an empty table gives an empty result; extra columns are ignored.
    """
    with open(vocabulary, encoding="utf-8") as f:
        spec = docs.sparkSession.sparkContext.broadcast(f.read())

    def run(batches):
        counter = Counter(spec.value)
        for batch in batches:
            text = batch.column(1)
            n_bytes = pc.fill_null(pc.binary_length(text), 0).cast(pa.int64())
            n = pa.array([counter(t) for t in text.to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), n_bytes, n, pc.greater(n, limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return documents(docs, id_col, text_col).mapInArrow(run, SCHEMA)
