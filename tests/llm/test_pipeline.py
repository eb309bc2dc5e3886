"""The pipeline's stages against plain Python, each on what its predecessor kept."""

import duckdb
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from parcelspark.llm.util import stored

from ..conftest import SF_SMALL
from .test_operators import _check_packing, words


def test_stages(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    columns, kept = docs.columns, []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stored(stage(spark, docs, SF_SMALL), f"test-{name}")
        assert docs.columns == columns
        kept.append({r.doc_id: r.text for r in docs.collect()})
    language, lines, near, bench = kept
    first, gone = {}, {}
    for i in sorted(language):
        ls = language[i].split("\n")
        for j in range(len(ls) - 2):
            if first.setdefault(tuple(ls[j:j + 3]), (i, j)) != (i, j):
                gone.setdefault(i, set()).update((j, j + 1, j + 2))
    want = {i: [x for j, x in enumerate(t.split("\n")) if j not in gone.get(i, ())] for i, t in language.items()}
    assert lines == {i: "\n".join(ls) for i, ls in want.items() if ls}
    sets = {i: {tuple(w[j:j + 5]) for j in range(max(1, len(w) - 4))} if (w := words(t)) else set() for i, t in lines.items()}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for a in sets:
        for b in sets:
            if a < b and sets[a] and 9 * len(sets[a] & sets[b]) >= 4 * (len(sets[a]) + len(sets[b])):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    assert set(near) == {i for i in sets if find(i) == i}
    items = [words(t) for _, t in duckdb.sql(f"SELECT item_id, text FROM '{SF_SMALL}/benchmark.parquet'").fetchall()]
    windows = {tuple(w[s:s + min(13, len(w))]) for w in items if w for s in range(len(w) - min(13, len(w)) + 1)}
    clean = set()
    for i, t in near.items():
        w, hit = words(t), set()
        for m in {len(x) for x in windows}:
            for s in range(len(w) - m + 1):
                if tuple(w[s:s + m]) in windows:
                    hit.update(range(s, s + m))
        if not (hit and 20 * len(hit) >= len(w)):
            clean.add(i)
    assert set(bench) == clean
    rows = corpus_pipeline.STAGES[-1][1](spark, docs, SF_SMALL).collect()
    _check_packing(rows, bench, Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")))


def test_stages_on_odd_and_no_rows(spark, odd_docs, no_docs):
    for docs in (odd_docs, no_docs):
        for name, stage in corpus_pipeline.STAGES:
            docs = stored(stage(spark, docs, SF_SMALL), f"odd-{name}")
        assert "sequence_id" in docs.columns


def test_language_stage_without_labels_keeps_texts(spark, odd_docs):
    docs = odd_docs.withColumn("lang", F.lit(None).cast("string"))
    kept = {r.doc_id for r in corpus_pipeline.STAGES[0][1](spark, docs, SF_SMALL).collect()}
    assert kept == {r.doc_id for r in odd_docs.collect()} - {3, 4, 5}


def test_run_is_registered(spark):
    import __spark_entry__ as entry
    assert {"pipeline", *(f"op{n}_" for n in range(1, 11))} <= {k if k == "pipeline" else k.split("_")[0] + "_" for k in entry.queries() if k == "pipeline" or k.startswith("op")}
