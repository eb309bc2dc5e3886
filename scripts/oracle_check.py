"""Run registered queries in Spark and their DuckDB twins; compare results.

Usage: python scripts/oracle_check.py [sf_dir] [name ...]

Compares row count, column names and an order-insensitive hash of the values,
as the correctness gate does. Prints one line per query and a short diff on a
mismatch.
"""

from __future__ import annotations

import hashlib
import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402

from parcelspark.plans import ORACLE, QUERIES  # noqa: E402
from parcelspark.session import get_session  # noqa: E402
from parcelspark.sources.tables import TABLES  # noqa: E402


def _norm(v):
    if v is None:
        return None
    if hasattr(v, "item") and not isinstance(v, (list, tuple)):
        try:
            v = v.item()
        except Exception:
            pass
    if isinstance(v, float):
        if math.isnan(v):
            return None
        return v
    if hasattr(v, "tolist"):
        v = v.tolist()
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, _norm(x)) for k, x in v.items()))
    return v


def _rows(records, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_norm(r[i]) for i in order) for r in records), key=repr)


def _digest(rows):
    h = hashlib.sha256()
    for r in rows:
        h.update(repr(r).encode())
    return h.hexdigest()[:16]


def main(argv):
    sf_dir = "/root/testdata/sf0.01"
    names = []
    for a in argv:
        if a.startswith("/"):
            sf_dir = a
        else:
            names.append(a)
    names = names or sorted(QUERIES)
    spark = get_session(shuffle_partitions=8)
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    failures = 0
    for name in names:
        t0 = time.time()
        try:
            sdf = QUERIES[name](spark, sf_dir)
            s_cols = sdf.columns
            s_rows = _rows([tuple(r) for r in sdf.collect()], s_cols)
        except Exception as exc:  # report and carry on
            failures += 1
            print(f"FAIL  {name}: spark error {type(exc).__name__}: {str(exc)[:400]}")
            continue
        ts = time.time() - t0
        if name not in ORACLE:
            print(f"ROWS  {name}: {len(s_rows)} rows, no oracle ({ts:.1f}s)")
            continue
        try:
            res = con.execute(ORACLE[name])
            d_cols = [d[0] for d in res.description]
            d_rows = _rows(res.fetchall(), d_cols)
        except Exception as exc:
            failures += 1
            print(f"FAIL  {name}: duckdb error {type(exc).__name__}: {str(exc)[:400]}")
            continue
        same_cols = sorted(s_cols) == sorted(d_cols)
        same = same_cols and len(s_rows) == len(d_rows) and _digest(s_rows) == _digest(d_rows)
        if same:
            print(f"OK    {name}: {len(s_rows)} rows ({ts:.1f}s)")
            continue
        failures += 1
        print(f"DIFF  {name}: spark {len(s_rows)} rows {sorted(s_cols)}; duckdb {len(d_rows)} rows {sorted(d_cols)}")
        shown = 0
        d_set = set(d_rows)
        for r in s_rows:
            if r not in d_set:
                print("   spark only:", str(r)[:300])
                shown += 1
                if shown >= 3:
                    break
        s_set = set(s_rows)
        shown = 0
        for r in d_rows:
            if r not in s_set:
                print("   duckdb only:", str(r)[:300])
                shown += 1
                if shown >= 3:
                    break
    print(f"{len(names) - failures}/{len(names)} passed")
    return 1 if failures else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
