"""Correlations of wide tables from blocked co-moments.

For every pair of columns the rows where both are present give a count, the sums of either
column, their squares and their products. Per Arrow batch those of all pairs are five matrix
products; a task adds its batches up and hands on square blocks of the matrices, which meet by
block and are added. The plan has the same few operators for five columns and for five hundred.

Values are taken from a centre (the column's mean) first, so that the sums keep their digits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Columns of a block, and parts in which a block's partial sums are first added.
BLOCK, PARTS = 64, 32
#: A column whose squared deviations are this small beside its squares is constant.
CONSTANT = 1e-12
_SUMS = "bi int, bj int, part int, sums binary"
_PAIRS = "i int, j int, corr double"


def _number(column: str) -> Column:
    return F.nanvl(F.col(f"`{column}`").cast("double"), F.lit(None).cast("double"))


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    """Rows x columns; missing values are NaN."""
    return np.stack([c.to_numpy(zero_copy_only=False).astype(np.float64) for c in batch.columns], 1)


def centres(numbers: DataFrame, n_columns: int) -> np.ndarray:
    """Mean of each column (0 for one without a value)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, s = np.zeros(n_columns, np.int64), np.zeros(n_columns)
        for batch in batches:
            x = _matrix(batch)
            n += (~np.isnan(x)).sum(0)
            s += np.nansum(x, axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(n_columns, dtype=np.int32)), pa.array(n), pa.array(s)], ["i", "n", "s"])

    rows = numbers.mapInArrow(run, "i int, n long, s double").groupBy("i").agg(F.sum("n").alias("n"), F.sum("s").alias("s")).collect()  # one a column
    out = np.zeros(n_columns)
    for r in rows:
        out[r["i"]] = r["s"] / r["n"] if r["n"] else 0.0
    return out


def _added(table: pa.Table) -> np.ndarray:
    total = None
    for value in table.column("sums").to_pylist():
        own = np.frombuffer(value, "<f8")
        total = own.copy() if total is None else total + own
    return total


def correlations(df: DataFrame, columns: list[str]) -> DataFrame:
    """``i, j, corr`` for all pairs of ``columns`` by number: Pearson correlation over the rows where both
    are present (null and NaN are missing); null if either is constant there or fewer than two rows are."""
    k = len(columns)
    numbers = df.select(*(_number(c).alias(f"c{i}") for i, c in enumerate(columns)))
    centre = centres(numbers, k)
    edges = list(range(0, k, BLOCK))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, s, q, p = (np.zeros((k, k)) for _ in range(4))
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _matrix(batch) - centre
            have = ~np.isnan(x)
            x[~have] = 0.0
            m = have.astype(np.float64)
            n += m.T @ m
            s += x.T @ m        # sum of column i over the rows where column j is present
            q += (x * x).T @ m
            p += x.T @ x
        part = TaskContext.get().partitionId() % PARTS
        rows = []
        for a in edges:
            for b in edges:
                if a <= b:
                    i, j = slice(a, a + BLOCK), slice(b, b + BLOCK)
                    block = np.stack([n[i, j], s[i, j], s[j, i].T, q[i, j], q[j, i].T, p[i, j]])
                    rows.append((a, b, part, block.astype("<f8").tobytes()))
        yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows), (pa.int32(), pa.int32(), pa.int32(), pa.binary()))],
                                         ["bi", "bj", "part", "sums"])

    def add(table: pa.Table) -> pa.Table:
        first = [table.column(c)[0].as_py() for c in ("bi", "bj", "part")]
        return pa.table({"bi": pa.array(first[:1], pa.int32()), "bj": pa.array(first[1:2], pa.int32()),
                         "part": pa.array(first[2:], pa.int32()), "sums": pa.array([_added(table).tobytes()], pa.binary())})

    def finish(table: pa.Table) -> pa.Table:
        a, b = table.column("bi")[0].as_py(), table.column("bj")[0].as_py()
        n, si, sj, qi, qj, p = _added(table).reshape(6, min(BLOCK, k - a), min(BLOCK, k - b))
        with np.errstate(divide="ignore", invalid="ignore"):
            vi, vj = qi - si * si / n, qj - sj * sj / n
            corr = (p - si * sj / n) / (np.sqrt(vi) * np.sqrt(vj))
        corr[~((n > 1) & (vi > CONSTANT * qi) & (vj > CONSTANT * qj))] = np.nan
        i, j = (g.reshape(-1) for g in np.meshgrid(np.arange(a, a + corr.shape[0]), np.arange(b, b + corr.shape[1]), indexing="ij"))
        value = np.clip(np.where(i == j, np.where(np.isnan(corr.reshape(-1)), np.nan, 1.0), corr.reshape(-1)), -1.0, 1.0)
        if a != b:
            i, j, value = np.concatenate([i, j]), np.concatenate([j, i]), np.concatenate([value, value])
        return pa.table({"i": pa.array(i, pa.int32()), "j": pa.array(j, pa.int32()), "corr": pa.array(value, pa.float64(), mask=np.isnan(value))})

    parts = numbers.mapInArrow(run, _SUMS).groupBy("bi", "bj", "part").applyInArrow(add, _SUMS)
    return parts.groupBy("bi", "bj").applyInArrow(finish, _PAIRS)
