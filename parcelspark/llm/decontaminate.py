"""Benchmark decontamination as a prefix-filtered set join.

An item's windows (13 consecutive words; a shorter item is one window) must be
contained whole in a document. Seen as a set join on five-word shingles with
containment 1, one shingle of each window is a necessary prefix: its rarest one
in the corpus. So: count the benchmark's shingles over all documents, order them
by rarity, join only prefix shingles with the documents' shingles, apply the
length and position bounds, and compare the window's words exactly.

What tasks get of the benchmark is a bit map of fixed size (which shingles can
occur at all); the benchmark itself is joined, never broadcast or collected.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .util import bit_map, documents, in_bit_map, signed, stored
from .words import SHINGLE, runs, words_of

WINDOW = 13


def item_windows(items: DataFrame, id_col: str = "item_id", text_col: str = "text", window: int = WINDOW,
                 shingle: int = SHINGLE) -> DataFrame:
    """``item_id, words, m, shingles``: every window of every item with its shingles in order; null texts have none."""

    def run(batches):
        for batch in batches:
            ids, out = batch.column(0), ([], [], [], [])
            for w in words_of(batch.column(1)):
                for r in range(w.hi - w.lo):
                    n = int(w.first[r + 1] - w.first[r])
                    m = min(n, window)
                    for s in range(n - m + 1 if n else 0):
                        own = w.hashes[w.first[r] + s:w.first[r] + s + m]
                        _, h = runs(np.array([0, m]), own, min(shingle, m))
                        out[0].append(w.lo + r)
                        out[1].append(w.joined(r, s, s + m))
                        out[2].append(m)
                        out[3].append(signed(h).tolist())
            yield pa.RecordBatch.from_arrays(
                [ids.take(pa.array(out[0], pa.int64())), pa.array(out[1], pa.string()), pa.array(out[2], pa.int32()),
                 pa.array(out[3], pa.list_(pa.int64()))], ["item_id", "words", "m", "shingles"])

    return items.select(F.col(id_col).cast("string").alias("item_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(
        run, "item_id string, words string, m int, shingles array<long>")


def _sizes(shingles: DataFrame) -> list[int]:
    return sorted(r["q"] for r in shingles.select("q").distinct().collect())  # at most SHINGLE numbers


def _frequencies(docs: DataFrame, shingles: DataFrame) -> DataFrame:
    """``q, h, n``: how often each shingle of ``shingles`` may occur in the documents, counted per task first."""
    shared = docs.sparkSession.sparkContext.broadcast((_sizes(shingles), bit_map(shingles)))

    def run(batches):
        sizes, bits = shared.value
        for batch in batches:
            for w in words_of(batch.column(1)):
                for q in sizes:
                    _, h = runs(w.first, w.hashes, q)
                    h, n = np.unique(h[in_bit_map(bits, h)], return_counts=True)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(h), q, np.int32)), pa.array(signed(h)), pa.array(n.astype(np.int64))], ["q", "h", "n"])

    return docs.mapInArrow(run, "q int, h long, n long").groupBy("q", "h").agg(F.sum("n").alias("n"))


def _candidates(docs: DataFrame, prefixes: DataFrame, window: int) -> DataFrame:
    """One row per document: its word count, and the places of prefix shingles with the words around."""
    shared = docs.sparkSession.sparkContext.broadcast((_sizes(prefixes), bit_map(prefixes)))
    places = pa.list_(pa.struct([("q", pa.int32()), ("h", pa.int64()), ("pos", pa.int64()), ("lo", pa.int64()), ("around", pa.string())]))

    def run(batches):
        sizes, bits = shared.value
        for batch in batches:
            found, n_words = [[] for _ in range(batch.num_rows)], np.zeros(batch.num_rows, np.int64)
            for w in words_of(batch.column(1)):
                n_words[w.lo:w.hi] = np.diff(w.first)
                for q in sizes:
                    at, h = runs(w.first, w.hashes, q)
                    ok = np.flatnonzero(in_bit_map(bits, h))
                    at, h = at[ok], signed(h[ok])
                    for row, i, x in zip(np.searchsorted(w.first, at, side="right") - 1, at, h, strict=True):
                        pos, n = int(i - w.first[row]), int(w.first[row + 1] - w.first[row])
                        lo = max(0, pos - (window - q))
                        found[w.lo + row].append({"q": q, "h": int(x), "pos": pos, "lo": lo,
                                                  "around": w.joined(row, lo, min(n, pos + window))})
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_words), pa.array(found, places)],
                                             ["doc_id", "n_words", "places"])

    return docs.mapInArrow(run, "doc_id long, n_words long, places array<struct<q:int,h:long,pos:long,lo:long,around:string>>")


def contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text",
                  item_id_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """One row per document row: ``doc_id, n_words, n_hit, items``.

    ``n_hit`` is the number of words inside any occurrence of a window, ``items``
    the distinct ids, as strings in ascending order, of items with one. Null or
    wordless texts and items have no words, windows or hits; items with a null id
    count for ``n_hit`` but are not listed. Items of the same words count alike;
    null document ids and repeated rows are kept; an empty benchmark hits nothing,
    an empty table gives an empty result; extra columns are ignored.
    """
    picked = documents(docs, id_col, text_col)
    windows = stored(item_windows(items, item_id_col, item_text_col, window), "decontaminate-windows")
    distinct = windows.dropDuplicates(["words"]).select("words", "m", F.least("m", F.lit(SHINGLE)).alias("q"), "shingles")
    each = distinct.select("words", "m", "q", F.posexplode("shingles").alias("off", "h"))
    common = _frequencies(picked, each.select("q", "h").distinct())
    rarest = Window.partitionBy("words").orderBy(F.coalesce("n", F.lit(0)), "h", "off")
    prefix = stored(each.join(common, ["q", "h"], "left").withColumn("nth", F.row_number().over(rarest))
                    .where("nth = 1 AND n > 0").select("words", "m", "q", "h", "off"), "decontaminate-prefixes")
    found = stored(_candidates(picked, prefix, window).withColumn("row", F.monotonically_increasing_id()), "decontaminate-places")
    place = found.where(F.size("places") > 0).select("row", "n_words", F.explode("places").alias("p")).select("row", "n_words", "p.*")
    start = F.col("pos") - F.col("off")
    exact = F.array_join(F.slice(F.split("around", " "), (start - F.col("lo") + 1).cast("int"), F.col("m")), " ") == F.col("words")
    # Position bound (the window starts in the text), length bound (it ends there), then its words.
    hits = stored(place.join(prefix, ["q", "h"]).where((start >= F.col("lo")) & (start + F.col("m") <= F.col("n_words"))).where(exact)
                  .select("row", start.alias("start"), (start + F.col("m")).alias("end"), "words").distinct(), "decontaminate-hits")
    before = Window.partitionBy("row").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    covered = (hits.select("row", "start", "end").distinct()
               .withColumn("done", F.coalesce(F.max("end").over(before), F.lit(0)))
               .groupBy("row").agg(F.sum(F.greatest(F.lit(0), F.col("end") - F.greatest("start", "done"))).alias("n_hit")))
    names = (hits.select("row", "words").distinct().join(windows.select("words", "item_id"), "words")
             .where("item_id IS NOT NULL").groupBy("row").agg(F.array_sort(F.collect_set("item_id")).alias("items")))
    return (found.select("row", "doc_id", "n_words").join(covered, "row", "left").join(names, "row", "left")
            .select("doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
                    F.coalesce("items", F.array().cast("array<string>")).alias("items")))


def contaminated(share: int = 20) -> Column:
    """Rows of ``contamination`` of which at least one word in ``share`` is hit."""
    return (F.col("n_hit") > 0) & (F.col("n_hit") * share >= F.col("n_words"))
