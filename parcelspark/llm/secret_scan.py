"""Secret scan with corpus-wide ownership frequency.

Candidates are found in whole texts by pattern, their values hashed, and each hash
is counted over the corpus by distinct repositories and distinct owners: a value
that many owners hold is a widely copied example, one that a single owner holds is
a live-looking credential. DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .util import stored

#: kind, pattern, group that holds the value, its least length; base kinds first (fixed values).
BASE = [
    ("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    ("access", r"AKIA[A-Z0-9]+", 0, 16),
    ("hex", r"[0-9a-f]+", 0, 32),
]
#: Kinds that this scan adds (fixed values).
ADDED = [
    ("bearer", r"(?i)bearer\x20+([A-Za-z0-9+/_.=-]+)", 1, 16),
    ("forge", r"gh[pousr]_[A-Za-z0-9]+", 0, 24),
    ("jwt", r"eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 0, 24),
    ("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 10),
]
#: What a text must hold for a kind to occur; saves the exact patterns on all other texts.
HINTS = {
    "assign": r"(?i)(password|passwd|secret|token|api_?key)",
    "access": r"AKIA[A-Z0-9]{12}",
    "hex": r"[0-9a-f]{32}",
    "bearer": r"(?i)bearer\x20",
    "forge": r"gh[pousr]_",
    "jwt": r"eyJ[A-Za-z0-9_-]+\.",
    "pem": r"-----BEGIN ",
}
PLACEHOLDER = r"(?i)(example|sample|changeme|placeholder|dummy|x{6}|1234567|abcdef)"
#: A value that so many owners, or so many repositories, hold is a widely copied example.
MIN_OWNERS, MIN_REPOS = 3, 10
#: A live-looking value has one owner and stands in so many repositories at most.
LIVE_REPOS = 2


def _pattern(kind: str, pattern: str, least: int) -> str:
    # A maximal run shorter than the least length holds no match of that length
    # either, so the plain runs can ask for it at once.
    if kind == "hex":
        return "[0-9a-f]{%d,}" % least
    return pattern


def _found(text: Column, kind: str, pattern: str, group: int) -> Column:
    """Array of (gap before the match, match length, value): the leftmost non-overlapping matches in order."""
    p = F.lit(pattern)
    zipped = F.arrays_zip(
        F.transform(F.split(text, pattern, -1), lambda x: F.length(x)).alias("gap"),
        F.transform(F.regexp_extract_all(text, p, F.lit(0)), lambda x: F.length(x)).alias("size"),
        F.regexp_extract_all(text, p, F.lit(group)).alias("value"))
    return F.when(text.rlike(HINTS[kind]), F.transform(zipped, lambda z: F.struct(
        z["gap"].alias("gap"), z["size"].alias("size"), z["value"].alias("value"))))


def candidates(docs: DataFrame, kinds: list, id_col: str, text_col: str, repo_col: str, owner_col: str) -> DataFrame:
    """One row per document: its columns of interest and the matches of each kind, without the text."""
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    found = F.filter(F.array(*(F.struct(F.lit(k).alias("rank"), F.lit(kind).alias("kind"), F.lit(least).alias("least"),
                                        _found(text, kind, _pattern(kind, pattern, least), group).alias("found"))
                               for k, (kind, pattern, group, least) in enumerate(kinds))),
                     lambda x: x["found"].isNotNull())
    return docs.select(
        F.monotonically_increasing_id().alias("row"), F.col(f"`{id_col}`").cast("long").alias("doc_id"),
        F.col(f"`{repo_col}`").cast("string").alias("repo"), F.col(f"`{owner_col}`").cast("string").alias("owner"),
        found.alias("kinds"))


def scan(docs: DataFrame, kinds: list | None = None, min_owners: int = MIN_OWNERS, min_repos: int = MIN_REPOS, id_col: str = "doc_id",
         text_col: str = "text", repo_col: str = "doc_id", owner_col: str = "source") -> DataFrame:
    """One row per span: ``row, doc_id, kind, kind_rank, start, end, value_hash, n_repos, n_owners, standing``;
    and, for documents without a span, one row whose ``kind`` is null.

    ``repo_col`` and ``owner_col`` name a row's repository and its owner; where a table has none, each
    document stands for a repository and its source for the owner. Positions are code points, end
    exclusive. ``standing`` is ``example`` (at least ``min_owners`` owners or ``min_repos`` repositories, or a
    placeholder word in it), ``live`` (one owner, ``LIVE_REPOS`` repositories at most) or ``shared``.
    Null owners and repositories count as none. A very long text is matched whole by its task. A null text is empty;
    null ids and repeated rows (each with its own ``row``) are kept; an empty table
    gives an empty result; extra columns are ignored.
    """
    kinds = BASE + ADDED if kinds is None else kinds
    table = stored(candidates(docs, kinds, id_col, text_col, repo_col, owner_col), "secret-candidates")
    each = (table.select("row", "doc_id", "repo", "owner", F.explode("kinds").alias("k"))
            .select("row", "doc_id", "repo", "owner", "k.rank", "k.kind", "k.least", F.posexplode("k.found").alias("nth", "f"))
            .where("f.value IS NOT NULL"))
    before = Window.partitionBy("row", "rank").orderBy("nth").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(F.col("f.gap") + F.col("f.size")).over(before)
    spans = (each.withColumn("end", end.cast("long")).where(F.length("f.value") >= F.col("least"))
             .select("row", "doc_id", "repo", "owner", "rank", "kind", (F.col("end") - F.col("f.size")).alias("start"), "end",
                     F.sha2("f.value", 256).alias("value_hash"), F.col("f.value").rlike(PLACEHOLDER).alias("placeholder")))
    # Distinct (value, holder) first, so that a value which everybody holds is one count, not one group of rows.
    owners = spans.where("owner IS NOT NULL").groupBy("value_hash", "owner").count().groupBy("value_hash").agg(
        F.count(F.lit(1)).alias("n_owners"))
    repos = spans.where("repo IS NOT NULL").groupBy("value_hash", "repo").count().groupBy("value_hash").agg(
        F.count(F.lit(1)).alias("n_repos"))
    standing = (F.when(F.col("placeholder") | (F.col("n_owners") >= min_owners) | (F.col("n_repos") >= min_repos), "example")
                .when((F.col("n_owners") <= 1) & (F.col("n_repos") <= LIVE_REPOS), "live").otherwise("shared"))
    judged = (spans.join(owners, "value_hash", "left").join(repos, "value_hash", "left")
              .na.fill(0, ["n_owners", "n_repos"]).withColumn("standing", standing)
              .select("row", "kind", F.col("rank").alias("kind_rank"), "start", "end", "value_hash", "n_repos", "n_owners", "standing"))
    return table.select("row", "doc_id").join(judged, "row", "left")


def digest(spans: DataFrame) -> DataFrame:
    """One row per document of ``scan``: counts by base kind, the digest of the base spans, all spans, their
    standings, and the most repositories that hold one of its values."""
    base = [k for k, *_ in BASE]
    shown = F.concat_ws(":", "kind", F.col("start").cast("string"), F.col("end").cast("string"))
    per = spans.groupBy("row", "doc_id").agg(
        *(F.count_if(F.col("kind") == k).alias(f"n_{k}") for k in base),
        F.array_sort(F.collect_list(F.when(F.col("kind").isNotNull(), F.struct("start", "kind_rank", "kind", shown.alias("s"))))).alias("all"),
        *(F.count_if(F.col("standing") == s).alias(f"n_{s}") for s in ("live", "shared", "example")),
        F.coalesce(F.max("n_repos"), F.lit(0)).alias("n_repos"))
    mine = F.filter("all", lambda x: x["kind"].isin(base))
    return per.select(
        "doc_id", *(f"n_{k}" for k in base),
        F.sha2(F.array_join(F.transform(mine, lambda x: x["s"]), ","), 256).alias("base_sha256"),
        F.array_join(F.transform("all", lambda x: x["s"]), ",").alias("spans"), "n_live", "n_shared", "n_example", "n_repos")
