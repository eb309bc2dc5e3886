"""Registered queries of the training-data operators, and their DuckDB twins."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir
from . import (cross_tokenizer, decontaminate, jaccard_join, language_id, license_scan, line_dedup, packing, periodic_runs,
               quality_rules, secret_scan, substring_dedup, token_counts, vector_search)

QUERIES: dict = {}
ORACLE: dict[str, str] = {}
VOCABULARY = "byte_bpe_50k.json"
PIECES = "piece_bpe_32k.model"


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ensure_checkpoint_dir(spark)
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


@query
def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document by heap-and-linked-list byte-pair merging."""
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY))


@query
def op2_vector_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest vectors of every twentieth one, from one small-world graph per shard."""
    return vector_search.nearest(table(spark, sf_dir, "embeddings"))


@query
def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact license phrases and fuzzy short notices of every document."""
    return license_scan.scan(table(spark, sf_dir, "documents"))


@query
def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document by PPM code length, learned from documents that are not held out."""
    docs = table(spark, sf_dir, "documents")
    model = language_id.train(docs)
    out = language_id.classify(docs.select("doc_id", "text"), model)
    return out.select("doc_id", language_id.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "bits_per_byte")


@query
def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fuzzy passages of 50 words or more that a document shares with an earlier one."""
    return substring_dedup.passages(table(spark, sf_dir, "documents"))


@query
def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document inside windows of benchmark items."""
    hits = decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return hits.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                       F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
                       decontaminate.contaminated().alias("contaminated"))


@query
def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class and links of every document at Jaccard similarity 0.8 of five-word shingles, by chosen paths."""
    return jaccard_join.jaccard_join(table(spark, sf_dir, "documents"))


@query
def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the lines of repeated three-line windows."""
    return line_dedup.dedup_lines(table(spark, sf_dir, "documents")).select("doc_id", "text", "n_lines", "n_removed")


@query
def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secret spans of every document, judged by how many owners hold each value."""
    return secret_scan.digest(secret_scan.scan(table(spark, sf_dir, "documents")))


@query
def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of 1024 tokens, best fit decreasing."""
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY))


@query
def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Periodic runs of every document's words, a tenth of the documents made to loop, by recompression."""
    looped = periodic_runs.with_loops(table(spark, sf_dir, "documents"))
    return periodic_runs.digest(periodic_runs.periodic_runs(looped))


@query
def op12_cross_tokenizer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of two tokenizers linked where they overlap, and how common each document's links are in the corpus."""
    return cross_tokenizer.corpus_alignment(table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY), public_tokenizers.path(PIECES))


@query
def op13_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base rules and distance from the languages' histograms of every document."""
    out = quality_rules.quality(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "nearest",
                      F.round("char_distance", 6).alias("char_distance"), F.round("word_distance", 6).alias("word_distance"))


_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = rf"regexp_extract_all(coalesce({_LOWER}, ''), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

ORACLE["op6_decontaminate"] = rf"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item_id, {_WORDS} AS w FROM benchmark),
win AS (SELECT item_id, least(13, len(w)) AS m, unnest(range(len(w) - least(13, len(w)) + 1)) AS s, w FROM b WHERE len(w) > 0),
iw AS (SELECT DISTINCT item_id, m, array_to_string(w[s + 1:s + m], ' ') AS words FROM win),
dw AS (SELECT doc_id, w, m, unnest(range(greatest(0, len(w) - m + 1))) AS s FROM d, (SELECT DISTINCT m FROM iw)),
hit AS (SELECT DISTINCT doc_id, s, dw.m, item_id FROM dw JOIN iw ON iw.m = dw.m AND iw.words = array_to_string(w[s + 1:s + dw.m], ' ')),
pos AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + m)) AS p FROM hit) GROUP BY doc_id),
it AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS items FROM (SELECT DISTINCT doc_id, item_id FROM hit) GROUP BY doc_id)
SELECT d.doc_id, len(d.w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(d.w) AS contaminated
FROM d LEFT JOIN pos ON pos.doc_id = d.doc_id LEFT JOIN it ON it.doc_id = d.doc_id
"""

ORACLE["op8_line_dedup"] = """
WITH d AS (SELECT doc_id, text, string_split(text, chr(10)) AS ls FROM documents),
win AS (SELECT doc_id, i, ls[i + 1] || chr(10) || ls[i + 2] || chr(10) || ls[i + 3] AS w
        FROM (SELECT doc_id, ls, unnest(range(len(ls) - 2)) AS i FROM d WHERE len(ls) > 2)),
later AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY w ORDER BY doc_id, i) AS rn FROM win) WHERE rn > 1),
gone AS (SELECT DISTINCT doc_id, i + k AS i FROM later, (SELECT unnest([0, 1, 2]) AS k)),
kept AS (SELECT l.doc_id, string_agg(line, chr(10) ORDER BY l.i) AS text, count(*) AS n
         FROM (SELECT doc_id, unnest(ls) AS line, unnest(range(len(ls))) AS i FROM d) l
         ANTI JOIN gone g ON g.doc_id = l.doc_id AND g.i = l.i GROUP BY l.doc_id)
SELECT d.doc_id, CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(kept.text, '') END AS text,
       coalesce(len(ls), 0) AS n_lines, coalesce(len(ls), 0) - coalesce(n, 0) AS n_removed
FROM d LEFT JOIN kept ON kept.doc_id = d.doc_id
"""


def _duck_spans(k: int, kind: str, pattern: str, group: int, least: int) -> str:
    p = secret_scan._pattern(kind, pattern, least).replace("'", "''")
    return f"""SELECT doc_id, {k} AS rank, '{kind}' AS kind, gaps, sizes, vals, unnest(range(len(vals))) AS i, {least} AS least
FROM (SELECT doc_id, list_transform(string_split_regex(t, '{p}'), lambda x: length(x)) AS gaps,
             list_transform(regexp_extract_all(t, '{p}', 0), lambda x: length(x)) AS sizes, regexp_extract_all(t, '{p}', {group}) AS vals
      FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)) WHERE len(vals) > 0"""


ORACLE["op9_secret_scan"] = f"""
WITH raw AS ({' UNION ALL '.join(_duck_spans(k, *x) for k, x in enumerate(secret_scan.BASE + secret_scan.ADDED))}),
s AS (SELECT doc_id, rank, kind, vals[i + 1] AS v, list_sum(gaps[1:i + 1]) + coalesce(list_sum(sizes[1:i]), 0) AS start, sizes[i + 1] AS size
      FROM raw WHERE length(vals[i + 1]) >= least),
o AS (SELECT v, count(DISTINCT source) AS n_owners, count(DISTINCT doc_id) AS n_repos FROM s JOIN documents USING (doc_id) GROUP BY v),
j AS (SELECT s.*, n_repos, kind || ':' || CAST(start AS BIGINT) || ':' || CAST(start + size AS BIGINT) AS shown,
             CASE WHEN regexp_matches(s.v, '{secret_scan.PLACEHOLDER}') OR n_owners >= {secret_scan.MIN_OWNERS} OR n_repos >= {secret_scan.MIN_REPOS} THEN 'example'
                  WHEN n_owners <= 1 AND n_repos <= {secret_scan.LIVE_REPOS} THEN 'live' ELSE 'shared' END AS standing FROM s JOIN o ON o.v = s.v),
a AS (SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access,
             count(*) FILTER (kind = 'hex') AS n_hex, string_agg(shown, ',' ORDER BY start, rank) FILTER (rank < {len(secret_scan.BASE)}) AS base,
             string_agg(shown, ',' ORDER BY start, rank) AS spans, count(*) FILTER (standing = 'live') AS n_live,
             count(*) FILTER (standing = 'shared') AS n_shared, count(*) FILTER (standing = 'example') AS n_example,
             max(n_repos) AS n_repos FROM j GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_live, 0) AS n_live,
       coalesce(n_shared, 0) AS n_shared, coalesce(n_example, 0) AS n_example, coalesce(n_repos, 0) AS n_repos
FROM documents d LEFT JOIN a ON a.doc_id = d.doc_id
"""


_CLASS_SQL = ", ".join(f"length(t) - length(regexp_replace(t, '{p.replace(chr(39), chr(39) * 2)}', '', 'g')) AS {k}"
                        for k, p in {**quality_rules.CLASSES, "lower": "[a-z]", "space": quality_rules.SPACE}.items())
ORACLE["op13_quality_rules"] = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, lang, coalesce(text, '') AS t FROM documents),
w AS (SELECT r, doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws FROM d),
win AS (SELECT r, i, ws[i + 1:i + 5] AS v FROM (SELECT r, ws, unnest(range(len(ws) - 4)) AS i FROM w WHERE len(ws) > 4)),
rep AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, v) AS c FROM win) WHERE c > 1),
cov AS (SELECT r, count(DISTINCT i + k) AS n FROM rep, range(5) t(k) GROUP BY r),
ln AS (SELECT r, count(*) - count(DISTINCT l) AS n FROM (SELECT r, unnest(string_split(t, chr(10))) AS l FROM d)
       WHERE regexp_matches(l, '[^\x20\x09-\x0D]') GROUP BY r),
base AS (SELECT w.r, w.doc_id, len(ws) AS n_words, length(array_to_string(ws, '')) AS word_chars,
                length(t) - length(regexp_replace(t, '{quality_rules.SYMBOLS}', '', 'g')) AS n_symbols, coalesce(ln.n, 0) AS n_dup_lines,
                coalesce(cov.n, 0) AS n_repeat_words, len(ws) < 10 OR 100 * coalesce(cov.n, 0) > 20 * len(ws) AS base_failed
         FROM w LEFT JOIN cov ON cov.r = w.r LEFT JOIN ln ON ln.r = w.r),
lw AS (SELECT r, lang, ws FROM w JOIN d USING (r)),
cl AS (UNPIVOT (SELECT r, lang, upper, digit, sentence, mark, control, "lower", space,
                       n - upper - digit - sentence - mark - control - "lower" - space AS wide FROM (SELECT r, lang, {_CLASS_SQL}, length(t) AS n FROM d))
       ON COLUMNS(* EXCLUDE (r, lang)) INTO NAME token VALUE n),
e AS (SELECT r, lang, 'c' AS kind, token, n FROM cl WHERE n > 0
      UNION ALL SELECT r, lang, 'w', token, count(*) FROM (SELECT r, lang, unnest(ws) AS token FROM lw) GROUP BY ALL),
own AS (SELECT e.* FROM e JOIN base USING (r) WHERE lang IS NOT NULL AND (kind = 'w' OR NOT base_failed)),
tot AS (SELECT lang, kind, sum(n) AS total FROM own GROUP BY ALL),
ref AS (SELECT lang, kind, token, sum(n) / any_value(total) AS q
        FROM own JOIN tot USING (lang, kind) GROUP BY lang, kind, token HAVING kind = 'c' OR sum(n) * {quality_rules.COMMON} >= any_value(total)),
oth AS (SELECT lang, greatest(1 - coalesce(sum(q) FILTER (kind = 'w'), 0), 0) AS other FROM ref GROUP BY lang),
m AS (SELECT r, kind, sum(n) AS m FROM e GROUP BY ALL),
j AS (SELECT e.r, ref.lang, kind, n / m AS p, q FROM e JOIN m USING (r, kind) JOIN ref USING (kind, token)),
s AS (SELECT r, lang, kind, sum((p * log2(2 * p / (p + q)) + q * log2(2 * q / (p + q))) / 2) AS s, sum(p) AS p, sum(q) AS q FROM j GROUP BY ALL),
x AS (SELECT b.r, o.lang, other, mc.m AS n_chars, coalesce(mw.m, 0) AS n_lw, sc.s AS cs, sc.p AS cp, sc.q AS cq,
             coalesce(sw.s, 0) AS ws, coalesce(sw.p, 0) AS wp, coalesce(sw.q, 0) AS wq
      FROM base b JOIN m mc ON mc.r = b.r AND mc.kind = 'c' LEFT JOIN m mw ON mw.r = b.r AND mw.kind = 'w'
      JOIN s sc ON sc.r = b.r AND sc.kind = 'c' JOIN oth o ON o.lang = sc.lang LEFT JOIN s sw ON sw.r = b.r AND sw.kind = 'w' AND sw.lang = o.lang),
y AS (SELECT r, lang, n_chars, n_lw, sqrt(greatest(cs + (1 - cq) / 2 + (1 - cp) / 2, 0)) AS cd,
             sqrt(greatest(ws + greatest(1 - other - wq, 0) / 2
               + (CASE WHEN 1 - wp > 0 THEN (1 - wp) * log2(2 * (1 - wp) / (1 - wp + other)) ELSE 0 END
                  + CASE WHEN other > 0 THEN other * log2(2 * other / (greatest(1 - wp, 0) + other)) ELSE 0 END) / 2, 0)) AS wd FROM x),
best AS (SELECT r, any_value(n_chars) AS n_chars, any_value(n_lw) AS n_lw,
                min({{'s': cd + CASE WHEN n_lw > 0 THEN wd ELSE 0 END, 'lang': lang, 'cd': cd, 'wd': CASE WHEN n_lw > 0 THEN wd END}}) AS b FROM y GROUP BY r)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND (coalesce(n_chars, 0) < {quality_rules.MIN_CHARS} OR coalesce(b.cd, 0) <= {quality_rules.MAX_CHAR_DISTANCE})
         AND (coalesce(n_lw, 0) < {quality_rules.MIN_JUDGED_WORDS} OR coalesce(b.wd, 0) <= {quality_rules.MAX_WORD_DISTANCE}) AS kept,
       b.lang AS nearest, round(b.cd, 6) AS char_distance, round(b.wd, 6) AS word_distance
FROM base LEFT JOIN best ON best.r = base.r
"""
