"""Words and word shingles of whole texts as numpy arrays.

A word is a maximal run of ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]`` after A-Z are
lower-cased: digits, a-z and every non-ASCII character. Each byte of a
non-ASCII character is >= 0x80, so the rule holds byte by byte and a whole Arrow
buffer is cut at once. Words are 64-bit polynomial hashes of their bytes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

from .util import mix, pieces_of, text_buffers

_LOWER = np.zeros(256, np.uint8)
_LOWER[0x30:0x3A] = np.arange(0x30, 0x3A)
_LOWER[0x61:0x7B] = np.arange(0x61, 0x7B)
_LOWER[0x41:0x5B] = np.arange(0x61, 0x7B)
_LOWER[0x80:] = np.arange(0x80, 0x100)
_P = 0x100000001B3 * 2 + 0x9E37

#: Words of a shingle wherever a contract names no other size.
SHINGLE = 5


@dataclass
class Words:
    """Words of the rows ``lo:hi`` of a batch. ``first[i]:first[i+1]`` are row ``lo+i``'s."""

    lo: int
    hi: int
    first: np.ndarray
    hashes: np.ndarray
    starts: np.ndarray  # byte offsets in ``data``
    data: np.ndarray    # lower-cased bytes, 0 where no word is
    ends: np.ndarray    # byte offset where each row ends

    def joined(self, row: int, a: int, b: int) -> str:
        """Words ``a:b`` of a row (counted from its first), joined by single spaces."""
        i, j = self.first[row] + a, self.first[row] + b
        if i >= j:
            return ""
        stop = self.starts[j] if j < self.first[row + 1] else self.ends[row]
        return b" ".join(self.data[self.starts[i]:stop].tobytes().replace(b"\0", b" ").split()).decode()


def words_of(column: pa.Array) -> Iterator[Words]:
    offsets, raw = text_buffers(column)
    for lo, hi in pieces_of(offsets):
        yield _cut(lo, hi, offsets[lo:hi + 1] - offsets[lo], raw[offsets[lo]:offsets[hi]])


def _cut(lo: int, hi: int, off: np.ndarray, raw: np.ndarray) -> Words:
    data = _LOWER[raw]
    inside = data != 0
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    heads = off[:-1][off[:-1] < off[1:]]
    begins[heads] = inside[heads]
    starts = np.flatnonzero(begins)
    first = np.searchsorted(starts, off)
    if len(starts) == 0:
        return Words(lo, hi, first, np.zeros(0, np.uint64), starts, data, off[1:])
    at = np.arange(len(data))
    at[starts[0]:] -= np.repeat(starts, np.diff(np.append(starts, len(data))))
    # Separators weigh nothing; their place is cut to the longest word so that the table of powers stays short.
    longest = int(at[inside].max()) + 1
    powers = np.cumprod(np.concatenate(([1], np.full(longest - 1, _P, np.uint64))), dtype=np.uint64)
    value = data.astype(np.uint64) * powers[np.where(inside, at, 0)]
    return Words(lo, hi, first, mix(np.add.reduceat(value, starts)), starts, data, off[1:])


def runs(first: np.ndarray, hashes: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(word index, hash) of every run of ``k`` consecutive words inside one row."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    total = np.zeros(n, np.uint64)
    for j in range(k):
        total = total * np.uint64(0x9FB21C651E98DF25) + hashes[j:j + n]
    row_end = np.repeat(first[1:], np.diff(first))[:n]
    at = np.flatnonzero(np.arange(n) + k <= row_end)
    return at, mix(total[at])


def shingles(words: Words, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of every ``k``-word shingle, repeats included, in row order;
    a row of fewer words, but not none, has its whole word sequence as its one shingle."""
    at, h = runs(words.first, words.hashes, k)
    row = np.searchsorted(words.first, at, side="right") - 1
    sizes = np.diff(words.first)
    short = np.flatnonzero((sizes > 0) & (sizes < k))
    if len(short):
        extra = np.empty(len(short), np.uint64)
        for i, r in enumerate(short):
            part = words.hashes[words.first[r]:words.first[r + 1]]
            extra[i] = runs(np.array([0, len(part)]), part, len(part))[1][0] ^ np.uint64(len(part))
        row = np.concatenate([row, short])
        h = np.concatenate([h, extra])
        order = np.argsort(row, kind="stable")
        row, h = row[order], h[order]
    return row, h


def shingle_sets(words: Words, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(offsets per row, distinct shingle hashes of each row in ascending order)."""
    row, h = shingles(words, k)
    order = np.lexsort((h, row))
    row, h = row[order], h[order]
    if len(h):
        new = np.ones(len(h), bool)
        new[1:] = (row[1:] != row[:-1]) | (h[1:] != h[:-1])
        row, h = row[new], h[new]
    return np.searchsorted(row, np.arange(words.hi - words.lo + 1)), h
