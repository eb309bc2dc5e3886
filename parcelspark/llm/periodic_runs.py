"""Periodic runs of words (maximal repetitions) by recompression.

The words of a piece of texts are one sequence of symbols, with a symbol of its own
between texts. Block compression (``a a a`` becomes one symbol) and pair compression
(``a b`` becomes one symbol where the alphabet's halves say so) alternate until each
text is a few symbols: a run-length grammar whose levels hold, for every symbol, its
parent and its first child. Equal stretches are parsed alike but for a few symbols at
their ends, so the longest common extension of two places climbs the levels while the
symbols agree and goes down again where they differ: a logarithmic number of steps, done
for many pairs of places at a time.

A run of period q that is 2q long or longer holds two neighbouring points of the grid
0, q, 2q, ... So the pairs of neighbouring grid points of all periods (a harmonic sum)
are all candidates, and their extensions to both sides give the exact runs.

Spark hands out the rows; a text is whole in one task, and nothing is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .util import documents, mix, pieces_of, text_buffers

RUN = "struct<start:long,length:long,period:long>"
SCHEMA = f"doc_id long, n_words long, runs array<{RUN}>, collapsed string"
#: Words of the shortest run.
MIN_WORDS = 12
#: Pairs of places that are compared at a time.
PAIRS = 1 << 20
#: Bytes of text that share a grammar; a longer text has one of its own.
PIECE = 1 << 20
#: Symbols that the longest text has at the top of the grammar.
TOP = 8


@dataclass
class Level:
    """Symbols of a level. ``parent[k]`` is the place of symbol k's parent in the next level;
    ``first[p]`` that of parent p's first child (one entry more, for the end). ``blocks``: the
    parents are blocks of one symbol, else single symbols or pairs."""

    symbols: np.ndarray
    parent: np.ndarray | None = None
    first: np.ndarray | None = None
    blocks: bool = False


def _named(keys: np.ndarray, fresh: int) -> tuple[np.ndarray, int]:
    """Symbols for equal keys, counted from ``fresh``; the next unused symbol."""
    kinds, symbol = np.unique(keys, return_inverse=True)
    return symbol.reshape(-1) + fresh, fresh + len(kinds)


def _next(level: Level, heads: np.ndarray, blocks: bool) -> np.ndarray:
    """Set the level's links to the next one, whose symbols begin at ``heads``; the first children."""
    at = np.flatnonzero(heads)
    level.parent = (np.cumsum(heads) - 1).astype(np.int32)
    level.first = np.append(at, len(heads)).astype(np.int32)
    level.blocks = blocks
    return at


def grammar(symbols: np.ndarray, most: int) -> list[Level]:
    """Levels of the run-length grammar of a sequence that begins and ends with a negative symbol.

    Negative symbols (each once) separate texts and are never merged; ``most`` is the number of
    other symbols. The last level has at most ``TOP`` symbols between two separators.
    """
    levels = [Level(symbols)]
    fresh, rounds = most, 0
    while True:
        now = levels[-1].symbols
        ends = np.flatnonzero(now < 0)
        if len(ends) < 2 or np.diff(ends).max() - 1 <= TOP:
            return levels
        same = now[1:] == now[:-1]
        if same.any():
            at = _next(levels[-1], np.concatenate(([True], ~same)), True)
            size = np.diff(levels[-1].first)
            out = now[at]
            long = np.flatnonzero(size > 1)
            out[long], fresh = _named((out[long] << 32) | size[long], fresh)
            levels.append(Level(out))
            now = out
        # Each round deals the alphabet into two halves anew; a pair is a left symbol before a right one.
        side = (mix(now.astype(np.uint64) + np.uint64(rounds * 0x9E3779B9)) >> np.uint64(40)) & np.uint64(1) != 0
        inner = (now[:-1] >= 0) & (now[1:] >= 0)
        pairs = [inner & side[:-1] & ~side[1:], inner & ~side[:-1] & side[1:]]
        pair = max(pairs, key=np.count_nonzero)
        rounds += 1
        if not pair.any():
            continue
        at = _next(levels[-1], np.concatenate(([True], ~pair)), False)
        out = now[at]
        long = np.flatnonzero(np.diff(levels[-1].first) > 1)
        out[long], fresh = _named((out[long] << 32) | now[at[long] + 1], fresh)
        levels.append(Level(out))


def extensions(levels: list[Level], x: np.ndarray, y: np.ndarray, forward: bool) -> np.ndarray:
    """Length of the longest common extension of each two places: of what begins at ``x`` and
    ``y``, or, backward, of what ends there (the places themselves included)."""
    step = 1 if forward else -1
    result = np.zeros(len(x), np.int64)
    stopped: list[tuple] = []
    who, a, b = np.arange(len(x)), x.astype(np.int64), y.astype(np.int64)

    def edge(first, p, k):  # is k where the extension enters its parent p
        return first[p] == k if forward else first[p + 1] == k + 1

    def left(first, p, k):  # symbols of the parent from k on, in the extension's direction
        return first[p + 1] - k if forward else k + 1 - first[p]

    for level in levels:
        halted, climbed = [], []
        while len(who):
            same = level.symbols[a] == level.symbols[b]
            if not same.all():
                halted.append((who[~same], a[~same], b[~same]))
                who, a, b = who[same], a[same], b[same]
            if level.parent is None:
                a, b = a + step, b + step
                continue
            p, q = level.parent[a], level.parent[b]
            up = edge(level.first, p, a) & edge(level.first, q, b)
            if up.any():
                climbed.append((who[up], p[up].astype(np.int64), q[up].astype(np.int64)))
                who, a, b, p, q = who[~up], a[~up], b[~up], p[~up], q[~up]
            move = np.minimum(left(level.first, p, a), left(level.first, q, b)) if level.blocks else 1
            a, b = a + step * move, b + step * move
        stopped.append(_joined(halted))
        who, a, b = _joined(climbed)
    who, a, b = (np.zeros(0, np.int64),) * 3
    for t in range(len(levels) - 1, -1, -1):
        level, begin = levels[t], stopped[t]
        if len(who):  # from the level above: its symbols differ, so only a few of these agree
            a, b = (level.first[a], level.first[b]) if forward else (level.first[a + 1] - 1, level.first[b + 1] - 1)
            a, b = a.astype(np.int64), b.astype(np.int64)
            going = np.arange(len(who))
            while len(going):
                going = going[level.symbols[a[going]] == level.symbols[b[going]]]
                move = 1
                if level.blocks:
                    u, v = a[going], b[going]
                    move = np.minimum(left(level.first, level.parent[u], u), left(level.first, level.parent[v], v))
                a[going] += step * move
                b[going] += step * move
        who, a, b = (np.concatenate(c) for c in zip((who, a, b), begin))
    result[who] = np.abs(a - x[who])
    return result


def _joined(parts: list[tuple]) -> tuple:
    if not parts:
        return (np.zeros(0, np.int64),) * 3
    return tuple(np.concatenate(c) for c in zip(*parts))


def grid_pairs(first: np.ndarray, size: np.ndarray, symbols: np.ndarray) -> Iterator[tuple]:
    """(text, period, earlier place, later place) of neighbouring grid points of every period up to
    half a text, where the words there or right before them agree; ``PAIRS`` pairs at a time."""
    half = np.where(size >= MIN_WORDS, size // 2, 0)
    done = np.cumsum(half)
    total = int(done[-1]) if len(done) else 0
    lo = 0
    while lo < total:
        text = np.searchsorted(done, np.arange(lo, min(total, lo + PAIRS // 8)), side="right")
        period = np.arange(lo, lo + len(text)) - (done - half)[text] + 1
        count = (size[text] - 1) // period
        ends = np.cumsum(count)
        take = max(1, int(np.searchsorted(ends, PAIRS, side="right")))  # a period of one text at least
        text, period, count, ends = text[:take], period[:take], count[:take], ends[:take]
        lo += take
        q = np.repeat(period, count)
        nth = np.arange(len(q)) - np.repeat(ends - count, count)
        x = np.repeat(first[text], count) + nth * q
        y = x + q
        near = (symbols[x] == symbols[y]) | (symbols[x - 1] == symbols[y - 1])
        yield np.repeat(text, count)[near], q[near], x[near], y[near]


def runs_of(texts: list[list], least: int = MIN_WORDS) -> list[np.ndarray]:
    """Runs (start, length, period) of each word list, by start and period."""
    known: dict = {}
    parts, size = [np.array([-1], np.int64)], np.array([len(w) for w in texts], np.int64)
    for d, words in enumerate(texts):
        parts += [np.array([known.setdefault(w, len(known)) for w in words], np.int64), np.array([-2 - d], np.int64)]
    symbols = np.concatenate(parts)
    first = np.cumsum(size + 1) - size
    levels = grammar(symbols, len(known))
    found = np.zeros((0, 4), np.int64)
    for text, q, x, y in grid_pairs(first, size, symbols):
        if not len(q):
            continue
        behind = extensions(levels, x - 1, y - 1, False)
        ahead = extensions(levels, x, y, True)
        good = behind + ahead >= np.maximum(q, least - q)
        start = x - behind - first[text]
        rows = np.stack([text, start, behind + ahead + q, q], 1)[good]
        rows = np.concatenate([found, rows])
        rows = rows[np.lexsort((rows[:, 3], rows[:, 2], rows[:, 1], rows[:, 0]))]
        # One stretch is found under the multiples of its period too; the least is its period.
        new = np.ones(len(rows), bool)
        new[1:] = (rows[1:, :3] != rows[:-1, :3]).any(1)
        found = rows[new]
    found = found[np.lexsort((found[:, 3], found[:, 1], found[:, 0]))]
    bounds = np.searchsorted(found[:, 0], np.arange(len(texts) + 1))
    return [found[bounds[d]:bounds[d + 1], 1:] for d in range(len(texts))]


def collapsed(words: list, runs: np.ndarray) -> list:
    """The words outside runs and those of each run's first period."""
    if not len(runs):
        return words
    change = np.zeros(len(words) + 1, np.int64)
    np.add.at(change, runs[:, 0] + runs[:, 2], 1)
    np.add.at(change, runs[:, 0] + runs[:, 1], -1)
    return [words[i] for i in np.flatnonzero(np.cumsum(change[:-1]) == 0)]


def periodic_runs(docs: DataFrame, least: int = MIN_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_words, runs, collapsed`` of every row.

    A word is a maximal run of bytes other than blank and 0x09 to 0x0D. A run is a longest
    stretch of at least ``least`` words, and of twice its smallest period, whose words agree
    with those a period before them; ``runs`` lists them (word number, words, period) by start
    and period. ``collapsed`` holds the words, joined by blanks, without what a run repeats.

    A null or empty text has no words, no runs and an empty ``collapsed``. Null ids and
    repeated rows are kept as they are; extra columns are ignored; an empty table gives an
    empty result. A very long text is worked on whole by its task, with memory of about a
    hundred bytes a word.
    """

    def run(batches):
        kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
        for batch in batches:
            offsets, raw = text_buffers(batch.column(1))
            for lo, hi in pieces_of(offsets, PIECE):
                texts = [raw[offsets[r]:offsets[r + 1]].tobytes().split() for r in range(lo, hi)]
                runs = runs_of(texts, least)
                flat = np.concatenate(runs) if runs else np.zeros((0, 3), np.int64)
                ends = np.cumsum([0, *map(len, runs)]).astype(np.int32)
                rows = pa.StructArray.from_arrays([pa.array(flat[:, k]) for k in range(3)], fields=list(kind.value_type))
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(lo, hi - lo), pa.array([len(w) for w in texts], pa.int64()),
                    pa.ListArray.from_arrays(pa.array(ends), rows, type=kind),
                    pa.array([b" ".join(collapsed(w, r)) for w, r in zip(texts, runs)], pa.binary()).cast(pa.string()),
                ], ["doc_id", "n_words", "runs", "collapsed"])

    return documents(docs, id_col, text_col).mapInArrow(run, SCHEMA)


def looped(doc_id: Column, text: Column) -> tuple[Column, Column, Column]:
    """Words of a text, and where and how a tenth of the documents (by hash of the id) is made to
    loop: (words, first looped word, period); the period is null for the others."""
    h = F.crc32(doc_id.cast("string").cast("binary"))
    words = F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "")
    n = F.size(words)
    g = F.floor(h / 10)
    begin = F.when((h % 10 == 0) & (n > 0), F.pmod(g, n.cast("long")))
    return words, begin, (F.lit(1) + F.floor((n - begin) / (3 + g % 8))).cast("int")


def with_loops(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, text``, where the words of a tenth of the documents repeat from a place on."""
    words, begin, period = looped(F.col("doc_id"), F.col("text"))
    parts = (documents(docs, id_col, text_col)
             .withColumn("_a", begin.cast("int")).withColumn("_p", period)
             .withColumn("_w", F.when(F.col("_p").isNotNull(), words)))
    head = F.slice("_w", F.lit(1), F.col("_a"))
    again = F.array_repeat(F.slice("_w", F.col("_a") + 1, F.col("_p")),
                           F.ceil((F.size("_w") - F.col("_a")) / F.col("_p")).cast("int"))
    text = F.array_join(F.slice(F.concat(head, F.flatten(again)), F.lit(1), F.size("_w")), " ")
    return parts.select("doc_id", F.when(F.col("_p").isNull(), F.col("text")).otherwise(text).alias("text"))


def digest(found: DataFrame) -> DataFrame:
    """One row per document of ``periodic_runs``: the number of runs, the longest run, and digests."""
    longest = F.expr("array_min(transform(runs, r -> struct(-r.length as size, r.start as start, r.period as period)))")
    lines = F.transform("runs", lambda r: F.concat_ws(",", *(r[c].cast("string") for c in ("start", "length", "period"))))
    return (found.withColumn("_best", longest)
            .select("doc_id", "n_words", F.size("runs").cast("long").alias("n_runs"), F.col("_best.start").alias("start"),
                    (-F.col("_best.size")).alias("length"), F.col("_best.period").alias("period"),
                    F.expr("-1000 * _best.size div _best.period").alias("exponent_milli"),
                    F.sha2(F.concat(F.array_join(lines, "\n"), F.when(F.size("runs") > 0, "\n").otherwise("")), 256).alias("runs_sha256"),
                    F.sha2("collapsed", 256).alias("collapsed_sha256")))
