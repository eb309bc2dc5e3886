"""Quality rules by distribution divergence. DataFrame functions only.

Two histograms of a document, of the classes of its characters and of its common words,
are compared with those of every language by Jensen-Shannon distance; the nearest
language counts. A histogram of too few characters or words is not judged.

Words stand for themselves as 64-bit hashes, in the repeated windows and in the histograms.

A language's references cover all its documents. A frequent-items sketch per language
proposes words (with a bound under which none is missed); a second pass over the texts makes
the histograms inside the rows and keeps the proposed words of each, which then are counted
exactly. The words that make up a 1/500 or more of the language's words are its common ones:
at most 500 a language. Character classes are summed over the documents that pass the base
rules. Only numbers by document and language are shuffled, never texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .util import stored

#: Base rules (fixed values).
MIN_WORDS, MAX_REPEATED_PERCENT, WINDOW = 10, 20, 5
SYMBOLS = r"[#*$%&|<>]"
SPACE = r"[\x20\x09-\x0D]+"
#: A common word makes up one in so many of a language's words at least.
COMMON = 500
#: The sketch of 3/4 * 2**15 counters is off by at most 3.5 / 2**15 of a language's words, a twentieth of
#: a common word's share, so every common one is among the first ``PROPOSED`` it returns.
TRACKED, PROPOSED = 24_000, 1000
#: Least characters and words of a histogram that is judged, and the greatest distances that pass.
MIN_CHARS, MIN_JUDGED_WORDS = 300, 150
MAX_CHAR_DISTANCE, MAX_WORD_DISTANCE = 0.3, 0.35
#: Character classes beside a-z and white space; what none of them holds is ``wide`` (not ASCII).
CLASSES = {"upper": "[A-Z]", "digit": "[0-9]", "sentence": """[.,;:!?'"()-]""", "mark": r"[#$%&*+/<=>@\[\]\\^_`{|}~]",
           "control": r"[\x00-\x08\x0E-\x1F\x7F]"}
BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
#: Kinds of a histogram's entries; the token of a class is its place in ``CLASS_NAMES``.
MARK, CHAR, WORD = 0, 1, 2
CLASS_NAMES = [*CLASSES, "lower", "space", "wide"]


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(text, SPACE), "")


_BASE_TYPE = "struct<doc_id:bigint," + ",".join(f"{c}:{'boolean' if c == 'base_failed' else 'bigint'}" for c in BASE) + ">"


def _entry(kind: int, token: Column, n: Column, base: Column | None = None) -> Column:
    return F.struct(F.lit(kind).alias("kind"), token.cast("long").alias("token"), n.cast("long").alias("n"),
                    (F.lit(None) if base is None else base).cast(_BASE_TYPE).alias("base"))


def features(docs: DataFrame) -> DataFrame:
    """``docs`` (``doc_id, text`` without nulls, and others) with the base columns, ``n_chars``, ``hashes`` of
    the words and ``classes``: an array of (``CHAR``, class, characters) of the classes that occur."""
    out = docs.withColumn("_w", words_of(F.col("text")))
    # Hashes of 1, 2, 4 and 5 words from each place, each from two shorter ones.
    out = out.withColumn("_h1", F.transform("_w", lambda x: F.xxhash64(x)))
    for size, left, right in ((2, 1, 1), (4, 2, 2), (5, 4, 1)):
        n = f"greatest(size(_w) - {size - 1}, 0)"
        out = out.withColumn(f"_h{size}", F.expr(
            f"zip_with(slice(_h{left}, 1, {n}), slice(_h{right}, {left + 1}, {n}), (a, b) -> xxhash64(a, b))"))
    # Only a text with a window found twice is sorted: (window, place), then the places beside an equal window.
    out = (out.withColumn("_s", F.expr("CASE WHEN size(array_distinct(_h5)) < size(_h5) THEN sort_array(transform(_h5, (h, i) -> struct(h, i))) END"))
           .withColumn("_p", F.expr("sort_array(transform(filter(_s, (x, k) -> x.h = get(_s, k - 1).h OR x.h = get(_s, k + 1).h), x -> x.i))"))
           .withColumn("_l", F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
           .withColumn("_x", F.translate("text", "abcdefghijklmnopqrstuvwxyz \t\n\x0b\x0c\r", "")))
    covered = F.expr(f"aggregate(transform(_p, (x, k) -> least({WINDOW}, coalesce(get(_p, k + 1) - x, {WINDOW}))), 0L, (a, x) -> a + x)")
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED_PERCENT * F.col("n_words"))
    out = out.withColumns({
        "n_words": F.size("_w").cast("long"),
        "word_chars": F.length(F.array_join("_w", "")).cast("long"),
        "n_symbols": F.regexp_count("_x", F.lit(SYMBOLS)).cast("long"),
        "n_dup_lines": (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long"),
        "n_repeat_words": F.coalesce(covered, F.lit(0)).cast("long"),
        "n_chars": F.length("text").cast("long"),
        "_n": F.array(*(F.regexp_count("_x", F.lit(p)) for p in CLASSES.values())),
    })
    some = {k: F.get("_n", F.lit(i)) for i, k in enumerate(CLASSES)}
    some |= {"lower": F.col("word_chars") - F.length("_x"), "space": F.col("n_chars") - F.col("word_chars"),
             "wide": F.length("_x") - F.aggregate("_n", F.lit(0), lambda a, x: a + x)}
    classes = F.filter(F.array(*(_entry(CHAR, F.lit(i), some[k]) for i, k in enumerate(CLASS_NAMES))), lambda x: x["n"] > 0)
    return out.withColumn("classes", classes).withColumn("base_failed", failed).withColumnRenamed("_h1", "hashes").drop(
        "_w", "_h2", "_h4", "_h5", "_s", "_p", "_l", "_x", "_n")


def proposed_words(docs: DataFrame) -> DataFrame:
    """Hashes of the words that can be common in some language, by a sketch per language over all its documents."""
    words = docs.where("lang IS NOT NULL").select("lang", F.explode(words_of(F.col("text"))).alias("word"))
    top = words.groupBy("lang").agg(F.expr(f"approx_top_k(xxhash64(word), {PROPOSED}, {TRACKED})").alias("top"))
    return top.select(F.explode("top.item").alias("token")).distinct()


def histograms(docs: DataFrame) -> DataFrame:
    """Entries ``row, lang, base_failed, n_chars, n_words, kind, token, n, base`` of every row's histograms:
    ``CHAR``, character classes; ``WORD``, the proposed words; and one ``MARK``, which holds ``base`` (``doc_id``
    and the base columns)."""
    proposed = stored(proposed_words(docs), "quality-proposed").withColumnRenamed("token", "_token")
    ordered = (features(docs.withColumn("row", F.monotonically_increasing_id())).drop("text")
               .withColumn("_t", F.sort_array("hashes")).drop("hashes")
               .withColumn("_i", F.expr("CASE WHEN size(_t) = 0 THEN array() ELSE filter(sequence(0, size(_t) - 1), "
                                        "i -> i = 0 OR get(_t, i) <> get(_t, i - 1)) END")))
    # The base columns ride on the mark alone, so that a word's entry stays small.
    words = F.expr(f"transform(_i, (i, k) -> struct({WORD} AS kind, get(_t, i) AS token, cast(coalesce(get(_i, k + 1), size(_t)) - i AS bigint) AS n, "
                   f"cast(NULL AS {_BASE_TYPE}) AS base))")
    mark = F.array(_entry(MARK, F.lit(None), F.lit(None), F.struct("doc_id", *BASE)))
    each = ordered.select("row", "lang", "base_failed", "n_chars", "n_words", F.explode(F.concat(mark, "classes", words)).alias("e"))
    known = (F.col("_token") == F.col("e.token")) & (F.col("e.kind") == WORD)
    return (each.join(proposed, known, "left").where((F.col("e.kind") != WORD) | F.col("_token").isNotNull())
            .select("row", "lang", "base_failed", "n_chars", "n_words", "e.*"))


def references(table: DataFrame) -> DataFrame:
    """``kind, token, lang, q, other`` from ``histograms``: the share of each character class and common word in
    each language, and the share of the language's words that are not common."""
    own = table.where("lang IS NOT NULL")
    sums = stored(own.where(F.col("kind") == MARK).groupBy("lang").agg(
        F.sum("n_words").alias("w"), F.sum(F.when(~F.col("base_failed"), F.col("n_chars"))).alias("c")), "quality-sums")
    counts = own.where((F.col("kind") == WORD) | ((F.col("kind") == CHAR) & ~F.col("base_failed"))).groupBy("lang", "kind", "token").agg(F.sum("n").alias("n"))
    shares = (counts.join(sums, "lang").withColumn("total", F.when(F.col("kind") == WORD, F.col("w")).otherwise(F.col("c")))
              .where((F.col("kind") == CHAR) | (F.col("n") * COMMON >= F.col("total")))
              .select("lang", "kind", "token", (F.col("n") / F.col("total")).alias("q")))
    shares = stored(shares, "quality-shares")
    common = shares.where(F.col("kind") == WORD).groupBy("lang").agg(F.sum("q").alias("common"))
    return shares.join(common, "lang", "left").select(
        "kind", "token", "lang", "q", F.greatest(1 - F.coalesce("common", F.lit(0.0)), F.lit(0.0)).alias("other"))


def _part(p: Column, q: Column) -> Column:
    """What a token of shares p and q adds to the divergence (base 2); 0 log 0 = 0."""
    def side(a, b):
        return F.when(a > 0, a * F.log2(2 * a / (a + b))).otherwise(F.lit(0.0))
    return (side(p, q) + side(q, p)) / 2


def divergences(table: DataFrame, refs: DataFrame) -> DataFrame:
    """``row, nearest, char_distance, word_distance`` from ``histograms``: the distances to the language of
    the smallest sum of both, ties to the first name. Rows without a character have none."""
    p = F.col("n") / F.when(F.col("kind") == WORD, F.col("n_words")).otherwise(F.col("n_chars"))
    met = table.where(F.col("kind") != MARK).drop("lang").join(refs, ["kind", "token"]).withColumn("p", p)

    def total(kind, value):
        return F.sum(F.when(F.col("kind") == kind, value).otherwise(F.lit(0.0)))
    # A reference token that the document lacks adds half its share, and so does one that the reference lacks;
    # all words that are not common are one token.
    sums = met.groupBy("row", "lang").agg(
        F.max("n_words").alias("n_words"), F.max("other").alias("other"),
        *(total(k, v).alias(f"{name}{i}") for name, k in (("c", CHAR), ("w", WORD)) for i, v in enumerate((_part(F.col("p"), F.col("q")), F.col("p"), F.col("q")))))
    chars = F.col("c0") + (1 - F.col("c1")) / 2 + (1 - F.col("c2")) / 2
    words = (F.col("w0") + F.greatest(1 - F.col("other") - F.col("w2"), F.lit(0.0)) / 2
             + _part(F.greatest(1 - F.col("w1"), F.lit(0.0)), F.col("other")))
    near = sums.select("row", "lang", F.sqrt(F.greatest(chars, F.lit(0.0))).alias("cd"),
                       F.when(F.col("n_words") > 0, F.sqrt(F.greatest(words, F.lit(0.0)))).alias("wd"))
    best = near.groupBy("row").agg(F.min(F.struct((F.col("cd") + F.coalesce("wd", F.lit(0.0))).alias("s"), "lang", "cd", "wd")).alias("b"))
    return best.select("row", F.col("b.lang").alias("nearest"), F.col("b.cd").alias("char_distance"), F.col("b.wd").alias("word_distance"))


def quality(docs: DataFrame, max_char_distance: float = MAX_CHAR_DISTANCE, max_word_distance: float = MAX_WORD_DISTANCE,
            id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Base columns, distances and verdict of every row.

    ``doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, n_chars,
    nearest, char_distance, word_distance, kept``. A document is kept if it passes the base rules, and
    each histogram of ``MIN_CHARS`` characters or ``MIN_JUDGED_WORDS`` words lies within its greatest
    distance of the nearest language.

    A null or empty text has zero counts and null distances, and fails the base rules. Documents without
    a language are judged but no part of a reference; without any language all distances are null and the
    base rules decide. Null ids and repeated rows are kept as they are; extra columns are ignored; an empty
    table gives an empty result. A very long text is worked on whole by its task.
    """
    docs = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"),
                       F.col(f"`{lang_col}`").cast("string").alias("lang"))
    table = stored(histograms(docs), "quality-histograms")
    near = divergences(table, stored(references(table), "quality-references"))
    rows = table.where(F.col("kind") == MARK).select("row", "base", "n_chars").join(near, "row", "left").select(
        "base.*", "n_chars", "nearest", "char_distance", "word_distance")
    alike = (((F.col("n_chars") < MIN_CHARS) | (F.coalesce("char_distance", F.lit(0.0)) <= max_char_distance))
             & ((F.col("n_words") < MIN_JUDGED_WORDS) | (F.coalesce("word_distance", F.lit(0.0)) <= max_word_distance)))
    return rows.withColumn("kept", ~F.col("base_failed") & alike)
