"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize

_MASK = (1 << 64) - 1


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once as Parquet under ``spark.checkpoint.dir`` and read
    back. The lineage is cut; a lost executor costs only its running tasks."""
    return materialize(df, name)


def documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the two columns that an operator needs, so that extra columns of any name cannot clash."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def mix(h: np.ndarray) -> np.ndarray:
    """Bijective scrambling of uint64 values (xor-shift, multiply)."""
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0x9E3779B97F4A7C15)
    h = h ^ (h >> np.uint64(29))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def seeded(h: np.ndarray, seed: int) -> np.ndarray:
    return mix(h + np.uint64((seed * 0xD6E8FEB86659FD93 + 0x632BE59BD9B4E019) & _MASK))


def signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(offsets int64 [n+1], bytes) of a string column, without a copy; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    return data_buffers(column)


def data_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(offsets int64 [n+1], bytes) of a string or binary column without nulls."""
    n = len(column)
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    if n == 0 or offsets is None:
        return np.zeros(n + 1, np.int64), np.zeros(0, np.uint8)
    off = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset:column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return off - off[0], raw[off[0]:off[-1]]


def pieces_of(offsets: np.ndarray, limit: int = 1 << 21) -> Iterator[tuple[int, int]]:
    """Ranges of rows whose texts hold about ``limit`` bytes together: what numpy
    works on at a time stays bounded (a longer text is a range of its own)."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = int(np.searchsorted(offsets, offsets[lo] + limit, side="right")) - 1
        hi = min(n, max(hi, lo + 1))
        yield lo, hi
        lo = hi


#: Bits of a map of hashes (2 MB, whatever the input's size).
MAP_BITS = 24


def bit_map(hashes: DataFrame) -> np.ndarray:
    """Bit map of the hashes in column ``h``: at most ``2**MAP_BITS`` bits reach the driver, in 2**19 words."""
    bit = F.col("h").bitwiseAND(F.lit((1 << MAP_BITS) - 1))
    rows = (hashes.select(F.shiftright(bit, 5).cast("int").alias("w"), F.expr("shiftleft(1L, cast(h & 31 as int))").alias("b"))
            .groupBy("w").agg(F.bit_or("b").alias("b")).toPandas())
    bits = np.zeros(1 << (MAP_BITS - 5), np.uint32)
    bits[rows["w"].to_numpy(np.int64)] = rows["b"].to_numpy(np.int64).astype(np.uint32)
    return bits


def in_bit_map(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    low = h & np.uint64((1 << MAP_BITS) - 1)
    return (bits[low >> np.uint64(5)] >> (low & np.uint64(31)).astype(np.uint32)) & np.uint32(1) != 0


def components(edges: DataFrame, name: str, max_rounds: int = 60) -> DataFrame:
    """Connected components of an undirected graph ``(a long, b long)``.

    Alternating large-star and small-star contractions, each a pre-aggregated
    ``min`` and a join, until the edges stop changing (logarithmically many
    rounds). Every round is a written table. Returns ``(node, root)`` with the
    smallest node of the component as root, for nodes that have an edge.
    Null ends and loops are ignored; an empty input gives an empty result.
    Raises if the graph has not converged after ``max_rounds`` rounds.
    """
    cur = stored(
        edges.where("a IS NOT NULL AND b IS NOT NULL AND a <> b")
        .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), f"{name}-edges")
    state = None
    for r in range(max_rounds):
        both = cur.union(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = (both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .where("u <> v").distinct())
        low2 = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (large.join(low2, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .union(low2.select("u", F.col("m").alias("v")))
                 .where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
        cur = stored(small, f"{name}-round{r}")
        now = cur.agg(F.count(F.lit(1)), F.sum(F.hash("u", "v").cast("long")),
                      F.sum(F.xxhash64("u", "v") % 1000003)).first()
        if now == state:
            return cur.select(F.col("u").alias("node"), F.col("v").alias("root")).union(
                cur.select("v", "v").distinct())
        state = now
    raise RuntimeError(f"components: no fixed point after {max_rounds} rounds")


def whole_groups(batches, n_keys: int) -> Iterator[pa.Table]:
    """Tables of complete groups from Arrow batches that are sorted by their first
    ``n_keys`` columns; only the group at a batch's end is carried over."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        last = [batch.column(k)[batch.num_rows - 1] for k in range(n_keys)]
        begin = 0
        if held and all(held[-1].column(k)[held[-1].num_rows - 1] == batch.column(k)[0] for k in range(n_keys)):
            same = _prefix(batch, [batch.column(k)[0] for k in range(n_keys)])
            held.append(batch.slice(0, same))
            begin = same
            if same == batch.num_rows:
                continue
        if held:
            yield pa.Table.from_batches(held)
            held = []
        rest = batch.slice(begin)
        tail = _suffix(rest, last)
        if rest.num_rows > tail:
            yield pa.Table.from_batches([rest.slice(0, rest.num_rows - tail)])
        held = [rest.slice(rest.num_rows - tail)]
    if held:
        yield pa.Table.from_batches(held)


def _matches(batch: pa.RecordBatch, key: list) -> np.ndarray:
    ok = np.ones(batch.num_rows, bool)
    for k, v in enumerate(key):
        ok &= batch.column(k).to_numpy(zero_copy_only=False) == v.as_py()
    return ok


def _prefix(batch: pa.RecordBatch, key: list) -> int:
    ok = _matches(batch, key)
    return int(np.argmin(ok)) if not ok.all() else batch.num_rows


def _suffix(batch: pa.RecordBatch, key: list) -> int:
    ok = _matches(batch, key)[::-1]
    return int(np.argmin(ok)) if not ok.all() else batch.num_rows


def group_bounds(table: pa.Table, n_keys: int) -> np.ndarray:
    """Row bounds of the groups of a sorted table: group g is ``bounds[g]:bounds[g+1]``."""
    new = np.zeros(table.num_rows, bool)
    new[:1] = True
    for k in range(n_keys):
        v = table.column(k).to_numpy()
        new[1:] |= v[1:] != v[:-1]
    return np.append(np.flatnonzero(new), table.num_rows)


def binaries(values: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """Binary column whose row i holds ``values[bounds[i]:bounds[i+1]]``."""
    data = np.ascontiguousarray(values)
    return pa.BinaryArray.from_buffers(pa.binary(), len(bounds) - 1, [
        None, pa.py_buffer((bounds * data.itemsize).astype(np.int32).tobytes()), pa.py_buffer(data.tobytes())])
