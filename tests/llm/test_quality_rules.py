"""Quality rules against plain Python and DuckDB."""

import re
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from parcelspark.llm import quality_rules

from ..conftest import SF_SMALL

BLANKS = r"[^\x20\x09-\x0D]+"


def base(text):
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed by the contract's words."""
    text = text or ""
    words = re.findall(BLANKS, text)
    windows = Counter(tuple(words[i:i + 5]) for i in range(len(words) - 4))
    covered = {i + k for i in range(len(words) - 4) if windows[tuple(words[i:i + 5])] > 1 for k in range(5)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(BLANKS, line):
            dup += line in seen
            seen.add(line)
    n = len(words)
    return n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered), n < 10 or 100 * len(covered) > 20 * n


def test_base_columns_equal_plain_python(spark, odd_docs, no_docs):
    texts = duckdb.sql(f"SELECT doc_id, text FROM '{SF_SMALL}/documents.parquet'").fetchall()
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    for df, rows in ((docs, texts), (odd_docs, [(r.doc_id, r.text) for r in odd_docs.collect()])):
        got = sorted((str(r.doc_id), r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed)
                     for r in quality_rules.quality(df).collect())
        assert got == sorted((str(i), *base(t)) for i, t in rows)
    assert quality_rules.quality(no_docs).count() == 0


@pytest.mark.parametrize("text", ["a b c d e " * 3, "x " * 40, "a b c d e f a b c d e g", "a\tb\n\nc\x0bd", "\n \n", "l\nl\n l\nl ", "é è \x1f"])
def test_base_columns_of_odd_texts(spark, text):
    df = spark.createDataFrame([(1, text, "en")], "doc_id long, text string, lang string")
    r = quality_rules.quality(df).first()
    assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == base(text)


def test_proposed_words_hold_every_common_one(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    proposed = {r.token for r in quality_rules.proposed_words(docs).collect()}
    words = docs.select("lang", F.explode(quality_rules.words_of(F.col("text"))).alias("word")).select("lang", F.xxhash64("word").alias("token"))
    counts = words.groupBy("lang", "token").count().collect()
    total = Counter()
    for r in counts:
        total[r.lang] += r["count"]
    common = {r.token for r in counts if r["count"] * quality_rules.COMMON >= total[r.lang]}
    assert common and common <= proposed


def test_clean_texts_stay_and_odd_ones_go(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "text", "lang")
    rows = [tuple(r) for r in docs.collect()]
    clean = [(i, t, g) for i, t, g in rows if not base(t)[5] and len(t) > 600 and not re.search(r"\*\*\*|&&&|\$\$\$|%%%|###| \| ", t)]
    # Marks behind each word, and words of no language's common ones; a few texts that make up little of their language.
    short = [r for r in clean if len(r[1]) < 3000]
    odd = [(100_000 + i, " ".join(f"{w}###" for w in t.split()), g) for i, t, g in short[:5]]
    odd += [(200_000 + i, re.sub("[a-z]", lambda m: chr(ord("a") + (ord(m[0]) - 84) % 26), t), g) for i, t, g in short[:9] if len(t) > 1500]
    out = {r.doc_id: r for r in quality_rules.quality(spark.createDataFrame(rows + odd, "doc_id long, text string, lang string")).collect()}
    assert sum(out[i].kept for i, *_ in clean) >= 0.99 * len(clean)
    assert not [out[i] for i, *_ in odd if out[i].kept]


def test_without_languages_the_base_rules_decide(spark):
    text = " ".join(f"word{i} other{i}" for i in range(100))
    df = spark.createDataFrame([(1, text, None), (None, "few words", None), (2, text, None)], "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in quality_rules.quality(df).collect()}
    assert got[1].kept and got[2].kept and not got[None].kept and got[1].char_distance is None


def test_no_python_in_the_plan(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    plan = quality_rules.histograms(docs.select("doc_id", "text", "lang"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
