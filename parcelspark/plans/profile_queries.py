"""Profiling queries over the listings table."""

from __future__ import annotations

import uuid
from itertools import combinations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import profile as P
from ..schemas import CATEGORICAL_FEATURES, LISTINGS, NA_STRINGS, NUMERIC_FEATURES, PROFILE_REQUIRED
from ..session import scratch_path
from ..sources.listings_csv import TRAINING_REQUIRED, read_listings_csv
from ..sources.tables import listings_table
from .registry import register
from .sql_common import LISTINGS_CTE, with_ctes

_ALL = [f.name for f in LISTINGS.fields]
_NUM = [f.name for f in LISTINGS.fields if isinstance(f.dataType, T.NumericType)]
_STR = [f.name for f in LISTINGS.fields if isinstance(f.dataType, T.StringType)]
_DBL = {f.name for f in LISTINGS.fields if isinstance(f.dataType, T.DoubleType)}
_W = with_ctes(LISTINGS_CTE)


def _miss(c: str) -> str:
    return f"({c} IS NULL OR isnan({c}))" if c in _DBL else f"{c} IS NULL"


def _union(parts: list[str]) -> str:
    return "\nUNION ALL\n".join(parts)


def _corr_sql(a: str, b: str) -> str:
    both = f"{a} IS NOT NULL AND {b} IS NOT NULL"
    xa, xb = f"CASE WHEN {both} THEN CAST({a} AS DOUBLE) END", f"CASE WHEN {both} THEN CAST({b} AS DOUBLE) END"
    return f"covar_pop({xa}, {xb}) / nullif(stddev_pop({xa}) * stddev_pop({xb}), 0)"


_MISSING_SQL = _W + _union([
    f"SELECT '{c}' AS column_name, count_if({_miss(c)}) AS n_missing, count(*) AS n_rows, "
    f"{len(_ALL)} AS n_columns FROM listings" for c in _ALL])

_DESCRIBE_SQL = _W + _union([
    f"""SELECT '{c}' AS column_name, count({c}) AS count, round(avg({c}::DOUBLE), 4) AS mean,
       round(stddev_samp({c}::DOUBLE), 4) AS std, round(min({c}::DOUBLE), 4) AS min,
       round(quantile_cont({c}::DOUBLE, 0.25), 4) AS p25, round(quantile_cont({c}::DOUBLE, 0.5), 4) AS p50,
       round(quantile_cont({c}::DOUBLE, 0.75), 4) AS p75, round(max({c}::DOUBLE), 4) AS max FROM listings"""
    for c in _NUM])

_CATEGORICAL_SQL = with_ctes(LISTINGS_CTE, "counts AS (\n" + _union([
    f"SELECT '{c}' AS column_name, {c} AS value, count(*) AS cnt FROM listings "
    f"WHERE {c} IS NOT NULL GROUP BY {c}" for c in _STR]) + "\n)", """ranked AS (
  SELECT *, row_number() OVER (PARTITION BY column_name ORDER BY cnt DESC, value) AS rk FROM counts
)""") + """
SELECT column_name, sum(cnt) AS count, count(*) AS unique,
       max(CASE WHEN rk = 1 THEN value END) AS top, max(cnt) AS freq
FROM ranked GROUP BY column_name"""

_TARGET_CORR_SQL = _W + _union([
    f"SELECT '{c}' AS column_name, round({_corr_sql(c, 'price_lkr')}, 6) + 0.0 AS corr FROM listings"
    for c in _NUM if c != "price_lkr"])

_MATRIX_SQL = with_ctes(LISTINGS_CTE, "pairs AS (\n" + _union(
    [f"SELECT '{a}' AS row_name, '{b}' AS col_name, {_corr_sql(a, b)} AS corr FROM listings"
     for a, b in combinations(_NUM, 2)]
    + [f"SELECT '{b}' AS row_name, '{a}' AS col_name, {_corr_sql(a, b)} AS corr FROM listings"
       for a, b in combinations(_NUM, 2)]
    + [f"SELECT '{c}' AS row_name, '{c}' AS col_name, "
       f"stddev_pop({c}::DOUBLE) / nullif(stddev_pop({c}::DOUBLE), 0) AS corr FROM listings" for c in _NUM]
) + "\n)") + "SELECT row_name, col_name, round(corr, 6) + 0.0 AS corr, round(corr, 2) + 0.0 AS corr_2dp FROM pairs"


def _range_sql(col: str, name: str) -> str:
    return f"""{name} AS (
  SELECT CASE WHEN lo = hi THEN lo - 0.5 ELSE lo END AS lo, CASE WHEN lo = hi THEN hi + 0.5 ELSE hi END AS hi
  FROM (SELECT min({col}) AS lo, max({col}) AS hi FROM listings WHERE {col} IS NOT NULL AND NOT isnan({col}))
)"""


def _bin_sql(col: str, rng: str, bins: int) -> str:
    return (f"least(CAST(floor({float(bins)} * ({col} - {rng}.lo) / ({rng}.hi - {rng}.lo)) AS INTEGER) + 1, "
            f"{bins})")


_HIST_SQL = with_ctes(LISTINGS_CTE, _range_sql("price_lkr", "rng"), f"""
counts AS (SELECT {_bin_sql('price_lkr', 'rng', 30)} AS bin, count(*) AS n
           FROM listings, rng WHERE price_lkr IS NOT NULL AND NOT isnan(price_lkr) GROUP BY 1)
""") + """
SELECT b.bin, round(rng.lo + (b.bin - 1) * ((rng.hi - rng.lo) / 30.0), 4) AS bin_lo,
       round(rng.lo + b.bin * ((rng.hi - rng.lo) / 30.0), 4) AS bin_hi, coalesce(c.n, 0) AS n
FROM rng, (SELECT CAST(unnest(range(1, 31)) AS INTEGER) AS bin) b LEFT JOIN counts c ON c.bin = b.bin
"""

_BINS2_SQL = with_ctes(LISTINGS_CTE, _range_sql("perch", "rx").replace(
    "WHERE perch IS NOT NULL AND NOT isnan(perch)",
    "WHERE perch IS NOT NULL AND NOT isnan(perch) AND price_lkr IS NOT NULL AND NOT isnan(price_lkr)"),
    _range_sql("price_lkr", "ry").replace(
    "WHERE price_lkr IS NOT NULL AND NOT isnan(price_lkr)",
    "WHERE perch IS NOT NULL AND NOT isnan(perch) AND price_lkr IS NOT NULL AND NOT isnan(price_lkr)")) + f"""
SELECT {_bin_sql('perch', 'rx', 20)} AS x_bin, {_bin_sql('price_lkr', 'ry', 20)} AS y_bin, count(*) AS n
FROM listings, rx, ry
WHERE perch IS NOT NULL AND NOT isnan(perch) AND price_lkr IS NOT NULL AND NOT isnan(price_lkr)
GROUP BY 1, 2
"""


def _mode_sql(c: str) -> str:
    return (f"(SELECT CAST({c} AS VARCHAR) FROM listings WHERE {c} IS NOT NULL GROUP BY {c} "
            f"ORDER BY count(*) DESC, {c} LIMIT 1)")


_NUM_DEFAULTS = [c for c in NUMERIC_FEATURES if c != "price_lkr"]
_DEFAULTS_SQL = _W + _union(
    [f"SELECT '{c}' AS column_name, 'median' AS stat, median({c}::DOUBLE) AS num_value, "
     f"CAST(NULL AS VARCHAR) AS str_value FROM listings" for c in _NUM_DEFAULTS]
    + [f"SELECT '{c}' AS column_name, 'mode' AS stat, CAST(NULL AS DOUBLE) AS num_value, "
       f"{_mode_sql(c)} AS str_value" for c in CATEGORICAL_FEATURES]
    + ["SELECT 'perch' AS column_name, 'min' AS stat, min(perch) AS num_value, "
       "CAST(NULL AS VARCHAR) AS str_value FROM listings",
       "SELECT 'perch' AS column_name, 'max' AS stat, max(perch) AS num_value, "
       "CAST(NULL AS VARCHAR) AS str_value FROM listings"])

_MODAL_AREA_SQL = with_ctes(LISTINGS_CTE, """counts AS (
  SELECT district, area, count(*) AS cnt FROM listings
  WHERE district IS NOT NULL AND area IS NOT NULL GROUP BY district, area
)""", """ranked AS (
  SELECT *, row_number() OVER (PARTITION BY district ORDER BY cnt DESC, area) AS rk FROM counts
)""") + "SELECT district, area AS modal_area FROM ranked WHERE rk = 1"


@register("missing_counts", _MISSING_SQL)
def missing_counts(spark, sf_dir):
    """A1 + A3: missing values per column, with the table shape."""
    return P.missing_counts(listings_table(spark, sf_dir))


def _duck_type(c: str) -> str:
    """DuckDB's type name of a column as Spark spells it."""
    t = f"lower(typeof(any_value({c})))"
    return (f"CASE {t} WHEN 'varchar' THEN 'string' WHEN 'integer' THEN 'int' "
            f"WHEN 'smallint' THEN 'smallint' ELSE {t} END")


_IS_NUMERIC = ("(s.data_type IN ('bigint', 'int', 'smallint', 'tinyint', 'double', 'float') "
               "OR s.data_type LIKE 'decimal%')")

_COLUMN_TYPES_SQL = with_ctes(LISTINGS_CTE) + f"""
SELECT CAST(s.position AS INTEGER) AS position, s.column_name, s.data_type,
       {_IS_NUMERIC} AS is_numeric, s.n_values
FROM (SELECT unnest(l) AS s FROM (SELECT [{", ".join(
    f"{{'position': {i}, 'column_name': '{c}', 'data_type': {_duck_type(c)}, 'n_values': count({c})}}"
    for i, c in enumerate(LISTINGS.names))}] AS l FROM listings))
"""


@register("column_types", _COLUMN_TYPES_SQL)
def column_types(spark, sf_dir):
    """A2 + F2: column types and which are numeric (booleans are not)."""
    return P.column_types(listings_table(spark, sf_dir))


@register("describe_numeric", _DESCRIBE_SQL)
def describe_numeric(spark, sf_dir):
    """A4: count, mean, sample std, min, exact 25/50/75%, max per numeric column."""
    return P.describe_numeric(listings_table(spark, sf_dir))


@register("describe_categorical", _CATEGORICAL_SQL)
def describe_categorical(spark, sf_dir):
    """A5: count, unique, top (ties to the smallest) and its frequency per text column."""
    return P.describe_categorical(listings_table(spark, sf_dir))


@register("price_correlations", _TARGET_CORR_SQL)
def price_correlations(spark, sf_dir):
    """A6 + W4: correlation of each numeric column with the price, descending."""
    return P.target_correlations(listings_table(spark, sf_dir))


@register("correlation_matrix", _MATRIX_SQL)
def correlation_matrix(spark, sf_dir):
    """Pairwise-complete correlation matrix in long form, with 2-decimal labels."""
    return P.correlation_matrix(listings_table(spark, sf_dir))


@register("price_histogram", _HIST_SQL)
def price_histogram(spark, sf_dir):
    """30 equal-width price bins, empty bins kept."""
    return P.histogram(listings_table(spark, sf_dir), "price_lkr", 30)


@register("price_size_bins", _BINS2_SQL)
def price_size_bins(spark, sf_dir):
    """20 x 20 binned counts of land size against price (the scatter as a table)."""
    return P.binned_pairs(listings_table(spark, sf_dir), "perch", "price_lkr", 20, 20)


@register("default_values", _DEFAULTS_SQL)
def default_values(spark, sf_dir):
    """A10 + A11 + A13: medians, modes and the size range used to fill requests."""
    return P.default_values(listings_table(spark, sf_dir), NUMERIC_FEATURES, CATEGORICAL_FEATURES)


@register("district_modal_area", _MODAL_AREA_SQL)
def district_modal_area(spark, sf_dir):
    """The modal sub-area of each district."""
    return P.grouped_mode(listings_table(spark, sf_dir).where("area IS NOT NULL"), "district", "area")


# --- S1, S2, U2: listings from CSV ---------------------------------------------

_GAPS = {"kitchen_area_sqft": 7, "district": 11}   # columns given missing-value strings in every n-th row


def _contract_row(f) -> str:
    kept = f"FILTER (WHERE listing_id % {_GAPS[f.name]} <> 0)" if f.name in _GAPS else ""
    total = (f"round(sum(CAST({f.name} AS DOUBLE)) {kept}, 2)" if isinstance(f.dataType, T.NumericType)
             else "CAST(NULL AS DOUBLE)")
    return (f"SELECT '{f.name}' AS column_name, '{f.dataType.simpleString()}' AS data_type, "
            f"{f.name in PROFILE_REQUIRED} AS required, count({f.name}) {kept} AS n_values, {total} AS total FROM listings")


@register("schema_contract", _W + "\n" + "\nUNION ALL\n".join(_contract_row(f) for f in LISTINGS.fields))
def schema_contract(spark, sf_dir):
    """S1 + S2 + U2: the listings written as CSV, with every missing-value string somewhere, and read
    back through the column contract: type, count and sum of each column."""
    path = scratch_path(spark, f"listings-csv-{uuid.uuid4().hex}")
    li = listings_table(spark, sf_dir)
    na = F.array(*[F.lit(x) for x in NA_STRINGS])
    for c, n in _GAPS.items():
        text = F.element_at(na, (F.floor(F.col("listing_id") / n) % len(NA_STRINGS) + 1).cast("int"))
        li = li.withColumn(c, F.when(F.col("listing_id") % n == 0, text).otherwise(F.col(c).cast("string")))
    li.write.option("header", True).option("escape", '"').csv(path)
    back = read_listings_csv(spark, path, [*PROFILE_REQUIRED, *TRAINING_REQUIRED])
    types = back.schema
    exprs = [F.struct(F.count(f.name).alias("n"), (
        F.round(F.sum(F.col(f.name).cast("double")), 2) if f.dataType.simpleString() != "string"
        else F.lit(None).cast("double")).alias("total")).alias(f.name) for f in types]
    info = spark.createDataFrame([(f.name, f.dataType.simpleString(), f.name in PROFILE_REQUIRED) for f in types],
                                 "column_name string, data_type string, required boolean")
    long = back.agg(*exprs).unpivot([], back.columns, "column_name", "s")
    return info.join(long, "column_name").select("column_name", "data_type", "required",
                                                 F.col("s.n").alias("n_values"), F.col("s.total").alias("total"))
