"""Cross-tokenizer alignment against the libraries and a byte-by-byte search."""

import hashlib
from collections import Counter

import duckdb
import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from parcelspark.llm import cross_tokenizer, queries
from parcelspark.llm.token_counts import byte_alphabet

from ..conftest import SF_SMALL

FILES = public_tokenizers.path(queries.VOCABULARY), public_tokenizers.path(queries.PIECES)


@pytest.fixture(scope="module")
def plain():
    """Function from a text to (A ids, B ids, groups, links as token numbers with shared bytes)."""
    a_lib = Tokenizer.from_file(FILES[0])
    a_lib.encode_special_tokens = True
    b_lib = sentencepiece.SentencePieceProcessor(model_file=FILES[1])
    byte = {c: b for b, c in byte_alphabet().items()}

    def piece(i):
        p = b_lib.id_to_piece(i)
        return bytes([int(p[3:5], 16)]) if b_lib.is_byte(i) else p.replace("▁", " ").encode()

    def run(text):
        if not text:
            return [], [], [], []
        a = a_lib.encode(" " + text, add_special_tokens=False).ids
        b = b_lib.encode(text)
        pa, pb = [bytes(byte[c] for c in a_lib.id_to_token(i)) for i in a], [piece(i) for i in b]
        if not b"".join(pa) == b"".join(pb) == (" " + text).encode():
            return [], [], [], []
        of_a, of_b = ([k for k, p in enumerate(x) for _ in p] for x in (pa, pb))
        links = sorted(Counter(zip(of_a, of_b)).items())
        ends_a, ends_b = (np.cumsum([len(p) for p in x]).tolist() for x in (pa, pb))
        groups, i, j = [], 0, 0
        for end in sorted(set(ends_a) & set(ends_b)):
            u, v = ends_a.index(end, i) + 1, ends_b.index(end, j) + 1
            groups.append((a[i:u], b[j:v]))
            i, j = u, v
        return a, b, groups, links

    return run


def shown(groups):
    return ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in groups)


def expected(rows, plain):
    """The contract's columns of every (doc_id, text)."""
    parts = [(i, *plain(t)) for i, t in rows]
    count = Counter()
    for _, a, b, _, links in parts:
        count.update({(a[x], b[y]) for (x, y), _ in links})
    most = Counter()
    for (x, _), n in count.items():
        most[x] = max(most[x], n)
    out = []
    for i, a, b, groups, links in parts:
        own = [count[a[x], b[y]] for (x, y), _ in links]
        out.append((str(i), len(a), len(b), len(groups), len(links), sum(n == most[a[x]] for n, ((x, _), _) in zip(own, links)), sum(own),
                    hashlib.sha256(shown(groups).encode()).hexdigest() if groups else "", sum(len(p) * len(q) for p, q in groups)))
    return sorted(out)


def digest(df):
    return sorted((str(r.doc_id), r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256, r.n_shared) for r in df.collect())


def test_query_equals_plain_python(spark, plain):
    rows = duckdb.sql(f"SELECT doc_id, text FROM '{SF_SMALL}/documents.parquet'").fetchall()
    assert digest(queries.QUERIES["op12_cross_tokenizer"](spark, SF_SMALL)) == expected(rows, plain)


def test_odd_rows_and_small_blocks(spark, odd_docs, no_docs, plain, monkeypatch):
    monkeypatch.setattr(cross_tokenizer, "BLOCK", 200)
    monkeypatch.setattr(cross_tokenizer, "SLICE", 50)
    rows = [(r.doc_id, r.text) for r in odd_docs.collect()]
    more = [(20, "<|endoftext|> and <s> </s> <0x41>"), (21, "double  blank"), (22, " lead"), (23, "tail "), (24, "▁"), (25, "a▁b"), (26, "é́ﬁ"),
            (27, "\U0001f600\U0001f601 你好"), (28, "a\x00b"), (29, "line\nline\r\n\tx"), (30, "​\xad zero")]
    assert digest(cross_tokenizer.corpus_alignment(odd_docs, *FILES)) == expected(rows, plain)
    df = spark.createDataFrame(more, "doc_id long, text string")
    assert digest(cross_tokenizer.corpus_alignment(df, *FILES)) == expected(more, plain)
    assert cross_tokenizer.corpus_alignment(no_docs, *FILES).count() == 0


def test_aligned_gives_ids_groups_and_links(spark, odd_docs, plain):
    out = cross_tokenizer.aligned(odd_docs, *FILES).collect()
    assert len(out) == odd_docs.count()
    texts = {(r.doc_id, r.text) for r in odd_docs.collect()}
    want = {i: plain(t) for i, t in texts}
    for r in out:
        a, b, groups, links = want[r.doc_id]
        assert (r.a_ids, r.b_ids, r.groups) == (a, b, shown(groups))
        assert [((x.a, x.b), x.bytes) for x in r.links] == links
        assert r.n_shared == sum(len(p) * len(q) for p, q in groups)


def test_row_products_equal_dense_ones():
    rng = np.random.default_rng(2)
    for _ in range(20):
        n, k, m = rng.integers(1, 12, 3)
        x, y = rng.random((n, k)) < 0.3, rng.random((k, m)) < 0.3

        def csr(d):
            return cross_tokenizer.CSR(np.concatenate(([0], np.cumsum(d.sum(1)))), np.nonzero(d)[1])
        i, j, v = cross_tokenizer.gustavson(csr(x), csr(y), int(m))
        got = np.zeros((n, m), int)
        got[i, j] = v
        assert (got == x.astype(int) @ y.astype(int)).all() and (v > 0).all()
        t = csr(x).transposed(int(k))
        assert (t.first == csr(x.T).first).all() and (t.columns == csr(x.T).columns).all()


def test_shared_links_are_the_pairs_within_groups(plain):
    with open(FILES[0], encoding="utf-8") as f, open(FILES[1], "rb") as g:
        pair = cross_tokenizer.Pair(f.read(), g.read())
    texts = ["Some unalignable words: éñß \U0001f600 12345", "", "short"]
    m = cross_tokenizer.align(pair, [t.encode() for t in texts])
    x, y = cross_tokenizer.shared_links(m)
    got, want, u, v = set(zip(x.tolist(), y.tolist())), set(), 0, 0
    for t in texts:
        for a, b in plain(t)[2]:
            want |= {(u + i, v + j) for i in range(len(a)) for j in range(len(b))}
            u, v = u + len(a), v + len(b)
    assert got == want and cross_tokenizer.shared_sizes(m).sum() == len(want)
