"""Line dedup by overlapping three-line windows.

Every window of three consecutive lines is hashed. A window that occurs more than
once in the whole table keeps its first occurrence, by (document id, text, line);
the lines that any later occurrence covers are removed, overlapping windows merged.
DataFrame functions only: a pre-aggregated minimum per window, a join, one array
of line numbers per document.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WINDOW = 3


def _windows(keyed: DataFrame) -> DataFrame:
    """``doc_id, _tk, i, h1, h2`` of every window; 128 hash bits, as windows are many."""
    lines = keyed.select("doc_id", "_tk", F.transform(F.split("text", "\n", -1), lambda x: F.struct(
        F.xxhash64(x).alias("a"), F.xxhash64(F.lit(7), x).alias("b"))).alias("ls")).where(F.size("ls") >= WINDOW)
    return (lines.select("doc_id", "_tk", F.posexplode(F.transform(
        F.sequence(F.lit(1), F.size("ls") - (WINDOW - 1)), lambda i: F.struct(
            F.xxhash64(*(F.get("ls", i + (k - 1)).a for k in range(WINDOW))).alias("h1"),
            F.xxhash64(*(F.get("ls", i + (k - 1)).b for k in range(WINDOW))).alias("h2")))).alias("i", "h"))
            .select("doc_id", "_tk", "i", "h.h1", "h.h2"))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with the lines of repeated windows removed from the text column, and
    ``n_lines long`` and ``n_removed long`` added (replacing columns of these names).

    Lines end at ``\\n``; line breaks between kept lines stay. A text of fewer than
    three lines has no window and stays whole, a null text stays null (0 lines). A
    text that loses every line becomes empty. Rows with the same id and text are one
    document: they are treated alike. A null id sorts first. An empty table gives an
    empty result; other columns stay as they are.
    """
    kept = [c for c in docs.columns if c.lower() not in ("n_lines", "n_removed", "_tk", "_flags", "_ls")]
    keyed = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    keyed = keyed.withColumn("_tk", F.xxhash64("text"))
    windows = _windows(keyed)
    first = (windows.groupBy("h1", "h2")
             .agg(F.min(F.struct("doc_id", "_tk", "i")).alias("at"), F.count(F.lit(1)).alias("n")).where("n > 1"))
    flagged = windows.join(first, ["h1", "h2"], "left").select("doc_id", "_tk", "i", F.coalesce(
        ~F.struct("doc_id", "_tk", "i").eqNullSafe(F.col("at")) & F.col("n").isNotNull(), F.lit(False)).alias("later"))
    # The places of later occurrences, one array per document that has any.
    flags = (flagged.where("later").groupBy("doc_id", "_tk").agg(F.collect_set("i").alias("_flags"))
             .select(F.col("doc_id").alias("_id"), F.col("_tk").alias("_key"), "_flags"))
    rows = docs.select(*(F.col(f"`{c}`") for c in kept), F.xxhash64(F.col(text_col).cast("string")).alias("_tk"))
    out = rows.join(flags, F.col(f"`{id_col}`").cast("long").eqNullSafe(F.col("_id")) & (F.col("_tk") == F.col("_key")), "left")
    ls = F.split(F.col(f"`{text_col}`").cast("string"), "\n", -1)
    removed = F.array_distinct(F.flatten(F.transform("_flags", lambda i: F.array(*(i + k for k in range(WINDOW))))))
    out = out.withColumn("_ls", ls).withColumn("_flags", removed)
    # Positions not removed, looked up by index: linear in the lines of a text.
    stay = F.array_except(F.sequence(F.lit(0), F.size("_ls") - 1), F.col("_flags"))
    text = F.when(F.col("_flags").isNull(), F.col(f"`{text_col}`").cast("string")).otherwise(
        F.array_join(F.transform(stay, lambda i: F.get("_ls", i)), "\n"))
    return out.select(
        *(text.alias(c) if c == text_col else F.col(f"`{c}`") for c in kept),
        F.when(F.col("_ls").isNull(), 0).otherwise(F.size("_ls")).cast("long").alias("n_lines"),
        F.coalesce(F.size("_flags"), F.lit(0)).cast("long").alias("n_removed"))
