"""M1: seeded, partition-independent train/test split.

``randomSplit`` draws per partition, so the same seed gives different rows after
a repartition or an executor retry. Hashing a unique key instead gives the same
rows on every run, on any cluster shape, and in DuckDB.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schemas import SPLIT_SEED, TEST_FRACTION

_RANGE = 4294967296.0  # 2**32


def split_hash(key: str | Column, seed: int = SPLIT_SEED) -> Column:
    """First 32 bits of md5('<seed>:<key>') as a non-negative bigint."""
    key = F.col(key) if isinstance(key, str) else key
    digest = F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string")))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint")


def is_test_row(key: str | Column, seed: int = SPLIT_SEED,
                test_fraction: float = TEST_FRACTION) -> Column:
    return split_hash(key, seed) < F.lit(test_fraction * _RANGE)


def seeded_split(df: DataFrame, key: str, seed: int = SPLIT_SEED,
                 test_fraction: float = TEST_FRACTION) -> DataFrame:
    """Add a boolean ``is_test`` column; one table instead of two copies."""
    return df.withColumn("is_test", is_test_row(key, seed, test_fraction))


_LOW_BITS = 16


def exact_split(df: DataFrame, key: str, seed: int = SPLIT_SEED, test_fraction: float = TEST_FRACTION) -> DataFrame:
    """Add ``is_test`` for exactly ``ceil(test_fraction * n)`` rows: those of the smallest (hash, key).

    No row is sorted or moved: one pass counts the rows by the hash's upper half, which finds the part
    that the last test row lies in, a second counts that part by the lower half, and the rows of one hash
    that are left are ordered by key. Rows are then marked by the pair they are compared with. Keys are
    unique and not null; rows without a key are training rows and do not count.
    """
    hashed = df.where(F.col(key).isNotNull()).select(split_hash(key, seed).alias("h"), F.col(key).alias("k"))
    upper = F.shiftright("h", _LOW_BITS)
    parts = sorted((r["p"], r["n"]) for r in hashed.groupBy(upper.alias("p")).agg(F.count(F.lit(1)).alias("n")).collect())  # at most 2**16
    wanted = math.ceil(test_fraction * sum(n for _, n in parts))
    if wanted <= 0:
        return df.withColumn("is_test", F.lit(False))
    part, left = _holding(parts, wanted)
    inside = hashed.where(upper == part)
    values = sorted((r["h"], r["n"]) for r in inside.groupBy("h").agg(F.count(F.lit(1)).alias("n")).collect())  # at most 2**16
    last, left = _holding(values, left)
    key_of_last = inside.where(F.col("h") == last).select("k").orderBy("k").limit(left).agg(F.max("k").alias("k")).first()["k"]
    h = split_hash(key, seed)
    return df.withColumn("is_test", F.coalesce((h < last) | ((h == last) & (F.col(key) <= F.lit(key_of_last))), F.lit(False)))


def _holding(counts: list[tuple[int, int]], rank: int) -> tuple[int, int]:
    """The value that holds the row of 1-based ``rank`` in order, and that row's rank among the value's."""
    for value, n in counts:
        if rank <= n:
            return value, rank
        rank -= n
    raise ValueError("fewer rows than asked for")


def split_counts(df: DataFrame) -> DataFrame:
    """Rows per side of a split table."""
    return (df.groupBy(F.when(F.col("is_test"), "test").otherwise("train").alias("side"))
              .agg(F.count(F.lit(1)).alias("n_rows")))
