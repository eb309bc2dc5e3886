"""Operators of the training-data subpackage against plain Python on small inputs."""

import hashlib
import re
import time
import zlib
from collections import Counter

import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from parcelspark.llm import (decontaminate, jaccard_join, language_id, license_scan, line_dedup, packing, queries,
                             secret_scan, substring_dedup, token_counts, vector_search)

from ..conftest import SF_SMALL

VOCABULARY = public_tokenizers.path(queries.VOCABULARY)
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def words(text):
    return WORD.findall((text or "").translate(LOWER))


@pytest.fixture(scope="module")
def texts():
    return dict(duckdb.sql(f"SELECT doc_id, text FROM '{SF_SMALL}/documents.parquet'").fetchall())


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(VOCABULARY)


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_query_equals_duckdb(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF_SMALL}/{t}.parquet'")
    got = queries.QUERIES[name](spark, SF_SMALL)
    want = con.execute(queries.ORACLE[name])
    cols = [d[0] for d in want.description]
    assert sorted(cols) == sorted(got.columns)
    assert sorted(tuple(r) for r in got.select(*cols).collect()) == sorted(want.fetchall())


def test_token_counts_equal_the_library(spark, texts, library):
    got = {r.doc_id: r for r in queries.QUERIES["op1_token_counts"](spark, SF_SMALL).collect()}
    for i, text in texts.items():
        n = len(library.encode(text, add_special_tokens=False).ids)
        assert (got[i].n_bytes, got[i].n_tokens, got[i].over_limit) == (len(text.encode()), n, n > 512)


@pytest.mark.parametrize("text", [
    "", " ", "a", "  two  spaces ", "tail \n", "\n\n x", "don't I'LL 12é3", "a<|endoftext|>b <|endoftext|>", "x" * 5000,
    "é  z \x1c\x85 w", "\U0001f600\U0001f600 z", "a\r\n\tb  c", "=-" * 300, " " * 999 + "q"])
def test_token_counter_on_odd_texts(library, text):
    with open(VOCABULARY) as f:
        spec = f.read()
    ids = library.encode(text, add_special_tokens=False).ids
    assert token_counts.Counter(spec)(text) == len(ids)
    assert packing.encoder(spec).encode(text, allowed_special="all") == ids


def _check_packing(rows, texts, library, capacity=1024):
    by_doc, bins = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        bins.setdefault(r.sequence_id, []).append(r)
    assert set(by_doc) == set(texts)
    for i, parts in by_doc.items():
        ids = [*library.encode(texts[i] or "", add_special_tokens=False).ids, 2]
        parts.sort(key=lambda r: r.piece)
        assert [p.piece for p in parts] == list(range(len(parts)))
        at = 0
        for p in parts:
            own = np.array(ids[p.start:p.start + p.length], "<u4").tobytes()
            assert p.start == at and p.ids_crc32 == zlib.crc32(own)
            at += p.length
        assert at == len(ids) and (len(parts) == 1 or len(ids) > capacity)
    for parts in bins.values():
        at = 0
        for p in sorted(parts, key=lambda r: r.offset):
            assert p.offset == at
            at += p.length
        assert at <= capacity
    return bins


def test_packing_round_trip_and_serial_best_fit(spark, texts, library):
    rows = queries.QUERIES["op10_packing"](spark, SF_SMALL).collect()
    bins = _check_packing(rows, texts, library)
    rooms = []
    for n in sorted((r.length for r in rows), reverse=True):
        fits = [i for i, room in enumerate(rooms) if room >= n]
        if fits:
            rooms[min(fits, key=lambda i: rooms[i])] -= n
        else:
            rooms.append(1024 - n)
    assert sorted(1024 - sum(p.length for p in b) for b in bins.values()) == sorted(rooms)


def test_search_recall(spark):
    got = queries.QUERIES["op2_vector_search"](spark, SF_SMALL).collect()
    rows = duckdb.sql(f"SELECT vec_id, embedding FROM '{SF_SMALL}/embeddings.parquet'").fetchall()
    ids, v = np.array([r[0] for r in rows]), np.array([r[1] for r in rows])
    asked = [i for i in range(len(ids)) if ids[i] % 20 == 0]
    found = {(r.query_id, r.vec_id): r for r in got}
    assert len(found) == len(got) == 20 * len(asked)
    hits = 0
    for i in asked:
        score = v @ v[i]
        score[i] = -np.inf
        hits += sum((ids[i], ids[j]) in found for j in np.lexsort((ids, -score))[:20])
    assert hits >= 0.9 * len(got)
    for r in got:
        assert r.score == pytest.approx(float(v[ids == r.query_id][0] @ v[ids == r.vec_id][0]), abs=1e-12)


def test_search_with_shards_lengths_copies_and_bad_vectors(spark):
    rng = np.random.default_rng(1)
    v = rng.normal(size=(600, 8)) * rng.uniform(0.1, 5, size=(600, 1))
    v[100:160] = v[100]
    rows = [(i, x.tolist()) for i, x in enumerate(v)]
    bad = [(1000, None), (1020, []), (1040, [0.0] * 8), (1060, [float("nan")] * 8), (1080, [float("inf")] * 8),
           (1100, [None] * 8), (None, [1.0] * 8), (1120, [1.0, 2.0])]
    df = spark.createDataFrame(rows + bad + rows[:1], "vec_id long, embedding array<double>").withColumn("rank", F.lit(1))
    got = vector_search.nearest(df, shard_rows=150).collect()
    by = {}
    for r in sorted(got, key=lambda r: (r.query_id, r.rank)):
        by.setdefault(r.query_id, []).append(r.vec_id)
    assert set(by) == {i for i in range(600) if i % 20 == 0}
    hits = 0
    for q, have in by.items():
        s = v @ v[q]
        s[q] = -np.inf
        want = np.lexsort((np.arange(600), -s))[:20].tolist()
        hits += len(set(want) & set(have))
        assert len(have) == len(set(have)) == 20 and q not in have
    assert hits >= 0.9 * 20 * len(by)
    assert vector_search.nearest(df.limit(0)).count() == 0


def test_license_scan_against_whole_text_search(spark, texts, odd_docs, no_docs):
    got = {r.doc_id: r for r in queries.QUERIES["op3_license_scan"](spark, SF_SMALL).collect()}
    for i, text in texts.items():
        w = words(text)
        base = [(j, label) for p, label in license_scan.PHRASES.items()
                for j in range(len(w)) if w[j:j + len(p.split())] == p.split()]
        assert (got[i].n_words, got[i].n_base) == (len(w), len(base))
        assert got[i].first_word == min((j for j, _ in base), default=None)
        assert got[i].last_word == max((j for j, _ in base), default=None)
        assert got[i].base_labels == ",".join(sorted({x for _, x in base}))
        assert set(filter(None, got[i].base_labels.split(","))) <= set(got[i].labels.split(","))
    s = license_scan.Scanner(license_scan.PHRASES, license_scan.NOTICES, 0.1)
    for text in ("x licenced under the apache licence version 2 0 y", "permission is hereby grantd free of charge to any persn obtaining a copy"):
        assert any(p.search(text) for p, *_ in s.notices) and s.fuzzy(text)
    odd = {r.doc_id: r for r in license_scan.scan(odd_docs).collect()}
    assert odd[13].labels == "apache,mit" and odd[3].n_words == 0 and odd[3].first_word is None
    assert license_scan.scan(no_docs).count() == 0


def _edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_fuzzy_notices_equal_brute_force():
    """Every notice from every word to every word by edit distance: each place alike enough is met by a
    span, and each span is as far from its notice as it says."""
    notices = [("released under the mit license", "mit"), ("all rights reserved", "proprietary"), ("licensed under cc by 4 0", "cc-by")]
    scanner = license_scan.Scanner({}, notices, 0.1)
    rng = np.random.default_rng(6)
    hits = 0
    for _ in range(120):
        words_ = []
        for _ in range(int(rng.integers(1, 5))):
            words_ += [["overall", "the", "reservedly", "mit", "by", "x"][k] for k in rng.integers(0, 6, int(rng.integers(0, 4)))]
            c = list(notices[int(rng.integers(3))][0])
            for _ in range(int(rng.integers(0, 4))):
                i = int(rng.integers(len(c)))
                c[i:i + int(rng.integers(2))] = ["", "q", " "][int(rng.integers(3))]
            words_ += "".join(c).split()
        text = " ".join(words_)
        got = scanner.fuzzy(text)
        starts = np.cumsum([0, *(len(w) + 1 for w in words_)])
        for label, s, e, errors, like in got:
            notice = next(n for n, x in notices if x == label)
            assert _edit_distance(text[s:e], notice) == errors and like == 1 - errors / len(notice)
            assert (s == 0 or text[s - 1] == " ") and (e == len(text) or text[e] == " ")
        for notice, _ in notices:
            most = int(len(notice) * 0.1)
            for i in range(len(words_)):
                for j in range(i + 1, len(words_) + 1):
                    s, e = int(starts[i]), int(starts[j]) - 1
                    if abs(e - s - len(notice)) <= most and _edit_distance(text[s:e], notice) <= most:
                        hits += 1
                        assert any(a < e and s < b for _, a, b, *_ in got), (text, text[s:e], got)
    assert hits > 100


def test_fuzzy_notices_one_after_the_other_and_in_linear_time():
    s = license_scan.Scanner(license_scan.PHRASES, license_scan.NOTICES, 0.1)
    text = "releasxd under the mit licence released under the mit license released under teh mit license"
    assert [(text[a:b], e) for _, a, b, e, _ in s.fuzzy(text)] == [
        ("releasxd under the mit licence", 2), ("released under the mit license", 0), ("released under teh mit license", 2)]
    assert s.fuzzy("overall rights reservedly") == []
    for seed in ("permission is ", "redistribution and ", "all rights reserved ", "mit license "):
        begun = time.time()
        long = (seed * 80_000)[:1_000_000]
        s.fuzzy(long)
        s.base(long.encode())
        assert time.time() - begun < 10, seed


def test_language_accuracy_on_held_out(spark, odd_docs, no_docs):
    out = queries.QUERIES["op4_language_id"](spark, SF_SMALL).join(
        spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in out if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in out)
    assert len(held) and sum(r.lang == r.lang_pred for r in held) >= 0.95 * len(held)
    model = language_id.train(odd_docs)
    got = {r.doc_id: r for r in language_id.classify(odd_docs, model).collect()}
    assert {got[i].lang_pred for i in (3, 4, 5)} == {"und"} and got[3].score == 0 and got[3].bits_per_byte is None
    assert language_id.classify(no_docs, language_id.train(no_docs)).count() == 0


def test_learning_sample_takes_pieces(spark):
    """One long text without an id is learned in part; a small language whole."""
    rng = np.random.default_rng(0)
    long = " ".join("".join(chr(97 + c) for c in rng.integers(0, 26, 6)) for _ in range(40_000))
    df = spark.createDataFrame([(None, long, "xx"), (None, "kurz und klein", "yy"), (4, None, "xx")], "doc_id long, text string, lang string")
    size = {r.lang: r.n for r in language_id.sample(df, 50_000, "doc_id", "lang", "text").groupBy("lang").agg(F.sum(F.length("text")).alias("n")).collect()}
    assert 20_000 <= size["xx"] <= 90_000 and size["yy"] == 14
    assert language_id.train(df, 50_000).langs == ["xx", "yy"]


def _plain_ppm(train, text, order=3):
    """Bits of ``text`` after ``train`` (bytes): counts per context, escape method C with exclusion, pads in front."""
    counts = {}
    for part in train:
        padded = b"\n" * order + part
        for i in range(order, len(padded)):
            for k in range(order + 1):
                counts.setdefault(padded[i - k:i], Counter())[padded[i]] += 1
    padded, bits = b"\n" * order + text, 0.0
    for i in range(order, len(padded)):
        done = set()
        for k in range(order, -1, -1):
            here = {b: n for b, n in counts.get(padded[i - k:i], {}).items() if b not in done}
            if not here:
                continue
            whole = sum(here.values()) + len(here)
            if padded[i] in here:
                bits -= np.log2(here[padded[i]] / whole)
                break
            bits -= np.log2(len(here) / whole)
            done |= set(here)
        else:
            bits += np.log2(256 - len(done))
    return bits


def test_code_lengths_equal_a_plain_ppm(spark):
    train = {"aa": ["banana bandana ananas", "bad ban", "é è"], "bb": ["the cat sat on the mat", "that hat"]}
    rows = [(4 * k, t, lang) for k, (lang, t) in enumerate((g, t) for g, ts in train.items() for t in ts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    known = {r.doc_id for r in df.where(~language_id.held_out(F.col("doc_id"))).collect()}
    model = language_id.train(df)
    texts = ["banana", "the hat", "zebra 42!", "é", "b", "that bandana sat", ""]
    got = language_id.code_lengths(model, pa.array(texts))
    for j, lang in enumerate(model.langs):
        own = [t.encode() for i, t, g in rows if g == lang and i in known]
        for i, text in enumerate(texts):
            assert got[i, j] == pytest.approx(_plain_ppm(own, text.encode()), abs=1e-3), (lang, text)


def test_ppm_codes_are_complete():
    """After any context the shares of all 256 bytes sum to at most 1 (exactly 1 with exclusion)."""
    text = b"banana bandana ananas"
    padded = b"\n\n\n" + text
    grams = Counter(tuple(padded[i:i + 4]) for i in range(len(text)))
    gram = np.array([(a << 24) + (b << 16) + (c << 8) + d for a, b, c, d in grams])
    m = language_id.build(np.array(["x"] * len(gram), object), gram, np.array(list(grams.values())))
    cost = m.cost[0].reshape(-1, m.n_classes)
    unseen = 256 - (m.n_classes - 1)
    total = (2.0 ** -cost[:, 1:]).sum(1) + unseen * 2.0 ** -cost[:, 0]
    assert np.allclose(total, 1, atol=1e-3)


def test_jaccard_join_equals_brute_force(spark, texts):
    got = {r.doc_id: r for r in queries.QUERIES["op7_jaccard_join"](spark, SF_SMALL).collect()}
    _check_classes(got, texts)


def _check_classes(got, texts):
    sets = {i: frozenset(tuple(w[j:j + 5]) for j in range(max(1, len(w) - 4))) if (w := words(t)) else frozenset() for i, t in texts.items()}
    root = {i: i for i in sets}
    links = Counter()

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and 9 * len(sets[a] & sets[b]) >= 4 * (len(sets[a]) + len(sets[b])):
                links[a] += 1
                links[b] += 1
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    assert {i: (r.class_id, r.n_links) for i, r in got.items()} == {i: (find(i), links[i]) for i in ids}


def test_jaccard_join_of_large_near_copy_groups(spark, monkeypatch):
    """Buckets beyond their bounds: splitting on further tokens, comparisons in pairs of blocks."""
    monkeypatch.setattr(jaccard_join, "BUCKET", 4)
    monkeypatch.setattr(jaccard_join, "BLOCK", 8)
    base = [f"w{i}" for i in range(60)]
    texts = {i: " ".join([*base[:50], *(f"u{i}_{j}" for j in range(i % 4)), *base[50:]]) for i in range(60)}
    texts |= {100 + i: " ".join(f"z{i}_{j}" for j in range(30)) for i in range(10)}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    _check_classes({r.doc_id: r for r in jaccard_join.jaccard_join(df).collect()}, texts)


def test_jaccard_join_on_odd_rows(spark, odd_docs, no_docs):
    got = jaccard_join.jaccard_join(odd_docs).collect()
    by = {r.doc_id: r for r in got}
    assert len(got) == odd_docs.count() and by[None].class_id is None
    assert {by[i].class_id for i in (0, 1, 2, 11)} == {0} and (by[0].n_links, by[0].n_sets, by[0].n_copies) == (3, 2, 1)
    assert by[3].class_id == 3 and by[4].class_id == 4 and by[4].n_links == 0
    assert jaccard_join.jaccard_join(no_docs).count() == 0


def test_passages_cover_long_common_runs(spark, texts, odd_docs, no_docs):
    rows = queries.QUERIES["op5_substring_dedup"](spark, SF_SMALL).collect()
    w = {i: words(t) for i, t in texts.items()}
    first, need = {}, set()
    for i in sorted(w):
        for j in range(len(w[i]) - 49):
            if first.setdefault(tuple(w[i][j:j + 50]), i) != i:
                need.add(i)
    assert len(need - {r.doc_id for r in rows}) <= 0.02 * len(need)
    for r in rows:
        a, b = w[r.doc_id][r.start_word:r.end_word], w[r.src_doc_id][r.src_start_word:r.src_end_word]
        assert r.src_doc_id < r.doc_id and max(len(a), len(b)) >= 50 and r.n_match <= substring_dedup._edits(
            np.array([hash(x) for x in a]), np.array([hash(x) for x in b]))
        assert r.identity >= 0.8
    odd = {(r.doc_id, r.src_doc_id) for r in substring_dedup.passages(odd_docs).collect()}
    assert {(1, 0), (2, 0), (11, 0)} <= odd
    assert substring_dedup.passages(no_docs).count() == 0


def test_every_long_common_run_has_a_row(spark, texts):
    """Every 50-word run that an earlier document holds lies in a row of its document."""
    w = {i: words(t) for i, t in texts.items()}
    spans = {}
    for r in queries.QUERIES["op5_substring_dedup"](spark, SF_SMALL).collect():
        spans.setdefault(r.doc_id, []).append((r.start_word, r.end_word))
    first, missed = {}, []
    for i in sorted(w):
        for j in range(len(w[i]) - 49):
            if first.setdefault(tuple(w[i][j:j + 50]), i) != i and not any(s <= j and j + 50 <= e for s, e in spans.get(i, [])):
                missed.append((i, j))
    assert not missed


def _own_words(name, n):
    return [f"{name}q{k}" for k in range(n)]


def _spans_of(spark, texts):
    df = spark.createDataFrame([(i, " ".join(t)) for i, t in texts.items()], "doc_id long, text string")
    return {(r.doc_id, r.src_doc_id, r.start_word, r.end_word, r.src_start_word, r.src_end_word)
            for r in substring_dedup.passages(df).collect()}


def test_passage_whose_pieces_stood_in_other_documents(spark):
    p = _own_words("p", 60)
    got = _spans_of(spark, {0: p[:30] + _own_words("a", 40), 1: _own_words("b", 40) + p[30:],
                            2: _own_words("c", 20) + p + _own_words("d", 20), 3: _own_words("e", 30) + p + _own_words("f", 30)})
    assert got == {(3, 2, 30, 90, 20, 80)}
    # Pieces that overlap, so that few 50-word runs are new.
    got = _spans_of(spark, {0: p[:45] + _own_words("a", 40), 1: _own_words("b", 40) + p[12:], 2: p, 3: _own_words("e", 30) + p})
    assert (3, 2, 30, 90, 0, 60) in got


def test_passages_quoted_before_or_twice(spark):
    p = _own_words("p", 60)
    source = _own_words("a", 20) + p + _own_words("b", 20)
    quoted = p[:40] + _own_words("c", 100) + p
    assert (1, 0, 140, 200, 20, 80) in _spans_of(spark, {0: source, 1: quoted})
    twice = _own_words("c", 30) + p + _own_words("d", 100) + p
    assert {(1, 0, 30, 90, 20, 80), (1, 0, 190, 250, 20, 80)} <= _spans_of(spark, {0: source, 1: twice})
    # Also when the later copy is altered, so that no 50-word run of it is in the source.
    altered = [*p[:20], "x1", *p[21:40], "x2", *p[41:]]
    got = _spans_of(spark, {0: source, 1: p[:40] + _own_words("c", 100) + altered})
    assert (1, 0, 140, 200, 20, 80) in got


def _edited(rng, p, share):
    """``p`` with about that share of its words replaced, followed by a new one, or left out."""
    out = []
    for x in p:
        kind = rng.integers(3) if rng.random() < share else 3
        out += {0: ["new"], 1: [x, "new"], 2: [], 3: [x]}[int(kind)]
    return out


def test_recall_of_edited_passages(spark):
    rng = np.random.default_rng(5)

    def some(n):
        return [f"v{k}" for k in rng.integers(3000, size=n)]
    cases = [(60, 0.05), (60, 0.1), (80, 0.15), (80, 0.2), (60, 10), (60, 7)]  # a share, or every so many words
    rows, pairs = [], {}
    for n, edit in cases * 20:
        p, i = some(n), len(rows)
        q = _edited(rng, p, edit) if edit < 1 else ["new" if k % edit == edit - 1 else x for k, x in enumerate(p)]
        rows += [(i, " ".join(some(100) + p + some(100))), (i + 1, " ".join(some(100) + q + some(100)))]
        pairs.setdefault((n, edit), set()).add((i + 1, i))
    got = {(r.doc_id, r.src_doc_id): r for r in substring_dedup.passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert set(got) <= set().union(*pairs.values())
    for (n, edit), mine in pairs.items():
        have = [got[k] for k in mine if k in got]
        assert len(have) >= (0.8 if edit in (0.2, 7) else 0.95) * len(mine), (n, edit)
        assert sum(r.src_end_word - r.src_start_word for r in have) >= 0.75 * n * len(have)


def test_edited_passages_whose_pieces_were_elsewhere_first(spark):
    rng = np.random.default_rng(11)

    def some(n):
        return [f"v{k}" for k in rng.integers(3000, size=n)]
    pieces, holders, pairs = [], [], set()
    for n in range(20):
        p = some(60)
        q = ["new" if k % 10 == 9 else x for k, x in enumerate(p)]
        pieces += [some(40) + p[k:k + 14] + some(40) for k in range(0, 60, 10)]
        holders += [(1000 + n, some(80) + p + some(80)), (2000 + n, some(50) + q + some(90))]
        pairs.add((2000 + n, 1000 + n))
    rows = [*enumerate(pieces), *holders]
    got = [(r.doc_id, r.src_doc_id) for r in substring_dedup.passages(spark.createDataFrame(
        [(i, " ".join(w)) for i, w in rows], "doc_id long, text string")).collect()]
    assert len(got) == len(set(got)) and set(got) <= pairs and len(got) >= 0.9 * len(pairs)


def test_passages_of_other_sources_lie_in_no_other():
    found, inner = (0, 60, 5, 0, 60, 60, 1.0), (10, 60, 7, 10, 60, 50, 1.0)
    wide = (100, 180, 9, 0, 80, 70, 0.875)
    assert substring_dedup.with_others([found], [inner]) == [found]
    assert substring_dedup.with_others([found, (110, 170, 9, 10, 70, 60, 1.0)], [wide, (100, 180, 12, 0, 80, 70, 0.875), (100, 170, 8, 0, 70, 60, 1.0)]) == [found, wide]
    assert substring_dedup.with_others([], [inner]) == [inner]


def test_equal_texts_are_one_passage(spark):
    p, q = _own_words("p", 70), _own_words("q", 60)
    got = _spans_of(spark, {0: p, 1: q + p, 2: q + p, 3: q + p, 4: q[:40], 5: q[:40]})
    assert got == {(1, 0, 60, 130, 0, 70), (2, 1, 0, 130, 0, 130), (3, 1, 0, 130, 0, 130)}


def test_contamination_on_odd_rows(spark, odd_docs, no_docs):
    items = spark.createDataFrame([(1, " ".join(f"w{i} x{i * 7 % 97}" for i in range(10, 20))), (2, "ONE!"), (3, None), (4, "..."),
                                   (5, "one"), (None, "null id text"), (6, "absent words here")], "item_id long, text string")
    out = decontaminate.contamination(odd_docs, items).collect()
    got = {r.doc_id: r for r in out}
    assert len(out) == odd_docs.count()
    assert got[0].n_hit == 20 and list(got[0].items) == ["1"] and got[6].n_hit == 1 and list(got[6].items) == ["2", "5"]
    assert got[None].n_hit == 3 and list(got[None].items) == [] and got[3].n_words == 0
    assert decontaminate.contamination(no_docs, items).count() == 0
    assert {r.n_hit for r in decontaminate.contamination(odd_docs, items.limit(0)).collect()} == {0}


def test_line_dedup_on_odd_rows(spark, odd_docs, no_docs):
    out = line_dedup.dedup_lines(odd_docs).collect()
    got = {r.doc_id: r for r in out}
    assert len(out) == odd_docs.count() and got[3].text is None and got[3].n_lines == 0 and got[4].text == ""
    assert got[8].n_removed == 5 and got[9].n_removed == 3 and got[9].text.count("\n") == 2
    assert got[0].n_removed == 0 and line_dedup.dedup_lines(no_docs).count() == 0


def test_secret_scan_on_odd_rows(spark, odd_docs, no_docs):
    out = secret_scan.digest(secret_scan.scan(odd_docs)).collect()
    got = {r.doc_id: r for r in out}
    assert len(out) == odd_docs.count()
    # "token=secret" is a match of too short a value and takes its text with it.
    assert (got[12].n_assign, got[12].n_access, got[12].spans) == (0, 1, "access:27:47")
    assert got[3].base_sha256 == hashlib.sha256(b"").hexdigest() and got[3].spans == ""
    assert secret_scan.digest(secret_scan.scan(no_docs)).count() == 0


def test_secret_standing(spark):
    rows = [(i, 'password="live9secret9value"' if i == 0 else "token: copied9everywhere9", f"o{i}") for i in range(5)]
    got = {r.doc_id: r for r in secret_scan.digest(secret_scan.scan(
        spark.createDataFrame(rows, "doc_id long, text string, source string"))).collect()}
    assert got[0].n_live == 1 and got[1].n_example == 1 and got[0].n_example == 0
    # One owner: copies in many of its repositories are an example, in a few they are shared.
    rows = [(i, "token: copied9everywhere9" if i < 20 else "secret = own9value9here", "o") for i in range(24)] + [(30, "token: only9one9holder", "o")]
    got = {r.doc_id: r for r in secret_scan.digest(secret_scan.scan(
        spark.createDataFrame(rows, "doc_id long, text string, source string"))).collect()}
    assert (got[0].n_example, got[0].n_repos, got[20].n_shared, got[20].n_repos, got[30].n_live) == (1, 20, 1, 4, 1)


def test_counts_and_packing_on_odd_rows(spark, odd_docs, no_docs, library):
    out = token_counts.count_tokens(odd_docs, VOCABULARY).collect()
    assert len(out) == odd_docs.count() and {r.n_tokens for r in out if r.doc_id in (3, 4)} == {0}
    unique = odd_docs.dropDuplicates(["doc_id"])
    _check_packing(packing.pack(unique, VOCABULARY).collect(), {r.doc_id: r.text for r in unique.collect()}, library)
    assert packing.pack(no_docs, VOCABULARY).count() == 0 and token_counts.count_tokens(no_docs, VOCABULARY).count() == 0


def test_only_the_first_piece_is_shorter(spark, library):
    texts = {i: "and " * n for i, n in enumerate((10, 1022, 1023, 1024, 2500, 5119, 5120))} | {7: None, 8: ""}
    rows = packing.pack(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), VOCABULARY).collect()
    _check_packing(rows, texts, library)
    for i, text in texts.items():
        own = sorted((r.piece, r.start, r.length) for r in rows if r.doc_id == i)
        n = len(library.encode(text or "", add_special_tokens=False).ids) + 1
        first = n % 1024 or 1024
        assert own == [(0, 0, first)] + [(k, first + (k - 1) * 1024, 1024) for k in range(1, (n + 1023) // 1024)]


def test_packing_of_very_long_white_space(spark, library):
    texts = {0: "a" + " " * 1_500_000 + "b", 1: "\n" * 1_500_000, 2: "some words", 3: "x" + "\t " * 750_000 + "<|endoftext|>"}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    _check_packing(packing.pack(df, VOCABULARY).collect(), texts, library)


def test_passages_of_a_repetitive_pair_lie_in_no_other(spark):
    base = ("alpha beta gamma delta epsilon zeta eta theta iota " * 20).split()
    other = [*base[:88], "changed", *base[89:]]
    rows = substring_dedup.passages(spark.createDataFrame([(1, " ".join(base)), (2, " ".join(other))], "doc_id long, text string")).collect()
    spans = [(r.start_word, r.end_word, r.src_start_word, r.src_end_word) for r in rows]
    assert {k for p in spans for k in range(p[0], p[1])} == set(range(180))
    for p in spans:
        assert sum(k[0] <= p[0] and p[1] <= k[1] and k[2] <= p[2] and p[3] <= k[3] for k in spans) == 1  # itself


def test_windows_that_share_words_in_both_texts_go_together():
    found = substring_dedup.together([(0, 10, 0, 10), (5, 20, 8, 12), (15, 30, 50, 60), (40, 50, 0, 10), (19, 25, 11, 14)])
    assert sorted(found) == [[0, 1, 4], [2], [3]]


def test_outermost_passages():
    found = [(14, 77, 9, 72, 63, 1.0), (0, 281, 0, 281, 275, 0.97), (0, 281, 0, 281, 281, 1.0), (0, 100, 200, 300, 90, 0.9)]
    assert set(substring_dedup.outermost(found)) == {found[2], found[3]}
