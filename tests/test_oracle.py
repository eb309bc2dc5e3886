"""Layer 1: every query with a SQL twin equals DuckDB on the same tables."""

import math

import pytest

from parcelspark.plans import ORACLE, QUERIES

from .conftest import SF_SMALL


def _norm(v):
    if isinstance(v, float) and math.isnan(v):
        return None
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    return v


def _rows(records, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_norm(r[i]) for i in order) for r in records), key=repr)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_matches_duckdb(spark, duck, name):
    sdf = QUERIES[name](spark, SF_SMALL)
    s_rows = _rows([tuple(r) for r in sdf.collect()], sdf.columns)
    res = duck.execute(ORACLE[name])
    cols = [d[0] for d in res.description]
    d_rows = _rows(res.fetchall(), cols)
    assert sorted(sdf.columns) == sorted(cols)
    assert len(s_rows) == len(d_rows)
    assert s_rows == d_rows


def test_every_query_has_a_docstring():
    for name, fn in QUERIES.items():
        assert fn.__doc__ or name in ORACLE, name
