"""Periodic runs by recompression against a word-by-word search."""

import hashlib
import random
import re
import zlib

import duckdb
import numpy as np
import pytest

from parcelspark.llm import periodic_runs, queries

from ..conftest import SF_SMALL


def brute(words, least=12):
    """Every run by comparing all words a period apart."""
    found = {}
    for q in range(1, len(words) // 2 + 1):
        i = 0
        while i + q < len(words):
            if words[i] != words[i + q]:
                i += 1
                continue
            start = i
            while i + q < len(words) and words[i] == words[i + q]:
                i += 1
            if i + q - start >= max(least, 2 * q):
                found.setdefault((start, i + q - start), q)
    return sorted((s, n, q) for (s, n), q in found.items())


def fibonacci(n):
    a, b = "a", "ab"
    while len(b) < n:
        a, b = b, b + a
    return list(b[:n])


@pytest.mark.parametrize("seed", range(20))
def test_runs_equal_brute_force(seed):
    rng = random.Random(seed)
    texts = [[], ["x"], ["x"] * 500, list("abcab" * 40), fibonacci(300)]
    for _ in range(12):
        n, kinds = rng.choice([5, 13, 40, 150, 400]), rng.choice([1, 2, 3, 5, 50])
        words = [str(rng.randrange(kinds)) for _ in range(n)]
        if rng.random() < 0.6:
            a = rng.randrange(n)
            p = 1 + (n - a) // (3 + rng.randrange(8))
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
        texts.append(words)
    rng.shuffle(texts)
    assert [list(map(tuple, r.tolist())) for r in periodic_runs.runs_of(texts)] == list(map(brute, texts))


def test_extensions_equal_a_direct_comparison():
    rng = np.random.default_rng(3)
    word = rng.integers(0, 2, 900)
    word[300:600] = word[:300]
    symbols = np.concatenate([[-1], word, [-2]]).astype(np.int64)
    levels = periodic_runs.grammar(symbols, 2)
    x = rng.integers(1, 900, 2000)
    y = np.minimum(900, x + rng.integers(1, 400, 2000))
    keep = x < y
    for forward, step in ((True, 1), (False, -1)):
        got = periodic_runs.extensions(levels, x[keep], y[keep], forward)
        for n, i, j in zip(got, x[keep], y[keep]):
            k = 0
            while symbols[i + step * k] == symbols[j + step * k]:
                k += 1
            assert n == k


def test_query_equals_plain_python(spark):
    got = {r.doc_id: r for r in queries.QUERIES["op11_periodic_runs"](spark, SF_SMALL).collect()}
    texts = dict(duckdb.sql(f"SELECT doc_id, text FROM '{SF_SMALL}/documents.parquet'").fetchall())
    assert set(got) == set(texts)
    assert any(r.n_runs for r in got.values())
    for i, text in texts.items():
        words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        n, h = len(words), zlib.crc32(str(i).encode())
        g = h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[k] if k < a else words[a + (k - a) % p] for k in range(n)]
        runs = brute(words)
        gone = {k for s, m, q in runs for k in range(s + q, s + m)}
        kept = " ".join(w for k, w in enumerate(words) if k not in gone)
        s, m, q = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None,) * 3)
        r = got[i]
        assert (r.n_words, r.n_runs, r.start, r.length, r.period) == (n, len(runs), s, m, q)
        assert r.exponent_milli == (None if s is None else 1000 * m // q)
        assert r.runs_sha256 == hashlib.sha256("".join(f"{s},{m},{q}\n" for s, m, q in runs).encode()).hexdigest()
        assert r.collapsed_sha256 == hashlib.sha256(kept.encode()).hexdigest()


def test_odd_rows(spark, odd_docs, no_docs):
    out = periodic_runs.periodic_runs(odd_docs).collect()
    by = {r.doc_id: r for r in out}
    assert len(out) == odd_docs.count()
    assert [tuple(x) for x in by[7].runs] == [(0, 60_000, 1)] and by[7].collapsed == "a"
    for i in (3, 4):
        assert (by[i].n_words, by[i].runs, by[i].collapsed) == (0, [], "")
    assert by[None].n_words == 6 and by[10].collapsed.endswith("\U0001f600")
    assert by[8].runs[0].period == 11 and periodic_runs.periodic_runs(no_docs).count() == 0
    empty = {r.doc_id: r for r in periodic_runs.digest(periodic_runs.periodic_runs(periodic_runs.with_loops(odd_docs))).collect()}
    assert empty[3].start is None and empty[3].runs_sha256 == hashlib.sha256(b"").hexdigest() == empty[4].collapsed_sha256


def test_no_shuffle(spark, odd_docs):
    plan = periodic_runs.digest(periodic_runs.periodic_runs(periodic_runs.with_loops(odd_docs)))._jdf.queryExecution().toString()
    assert "Exchange" not in plan
