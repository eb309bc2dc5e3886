"""Split and holdout queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.metrics import linear_holdout
from ..operators.split import exact_split, seeded_split, split_counts
from ..sources.tables import listings_table
from .registry import register
from .sql_common import LISTINGS_CTE, SPLIT_CTE, with_ctes


def _split_listings_table(spark, sf_dir):
    return seeded_split(listings_table(spark, sf_dir), "listing_id")


@register("holdout_metrics", with_ctes(LISTINGS_CTE, SPLIT_CTE, """
complete AS (SELECT * FROM split WHERE perch IS NOT NULL AND price_lkr IS NOT NULL),
coef AS (SELECT regr_slope(price_lkr, perch) AS slope, regr_intercept(price_lkr, perch) AS intercept
         FROM complete WHERE NOT is_test),
scored AS (SELECT price_lkr AS label, coef.intercept + coef.slope * perch AS prediction
           FROM complete, coef WHERE is_test)
""") + """
SELECT count(*) AS n,
       round(avg(abs(prediction - label)), 4) AS mae,
       round(sqrt(avg((prediction - label) * (prediction - label))), 4) AS rmse,
       round(1.0 - sum((prediction - label) * (prediction - label)) / (count(*) * var_pop(label)), 6) AS r2
FROM scored
""")
def holdout_metrics(spark, sf_dir):
    """Flagship: seeded split -> OLS on perch -> MAE/RMSE/R2 on held-out rows."""
    return linear_holdout(_split_listings_table(spark, sf_dir), "perch", "price_lkr")


@register("train_test_counts", with_ctes(LISTINGS_CTE, SPLIT_CTE) + """
SELECT CASE WHEN is_test THEN 'test' ELSE 'train' END AS side, count(*) AS n_rows
FROM split GROUP BY 1
""")
def train_test_counts(spark, sf_dir):
    """M1: rows on each side of the seeded hash split."""
    return split_counts(_split_listings_table(spark, sf_dir))


@register("exact_split", with_ctes(LISTINGS_CTE) + """
SELECT CASE WHEN rn <= ceil(0.2 * n) THEN 'test' ELSE 'train' END AS side, count(*) AS n_rows,
       CAST(sum(listing_id) AS BIGINT) AS id_sum, max(listing_id) AS last_id
FROM (SELECT listing_id, count(*) OVER () AS n,
             row_number() OVER (ORDER BY ('0x' || substr(md5('42:' || CAST(listing_id AS VARCHAR)), 1, 8))::BIGINT, listing_id) AS rn
      FROM listings) GROUP BY 1
""")
def exact_split_rows(spark, sf_dir):
    """M1: the split of exact size, ceil(0.2 n) test rows by (hash, key)."""
    side = F.when(F.col("is_test"), "test").otherwise("train").alias("side")
    return exact_split(listings_table(spark, sf_dir), "listing_id").groupBy(side).agg(
        F.count(F.lit(1)).alias("n_rows"), F.sum("listing_id").cast("long").alias("id_sum"), F.max("listing_id").alias("last_id"))


@register("listings_view", with_ctes(LISTINGS_CTE) + """
SELECT count(*) AS n_rows, count(perch) AS n_with_lines,
       count(DISTINCT district) AS n_districts, count(DISTINCT area) AS n_areas,
       round(sum(price_lkr), 2) AS total_price, CAST(sum(bedrooms) AS BIGINT) AS total_bedrooms
FROM listings
""")
def listings_view(spark, sf_dir):
    """The derived listings table, summarised (its shape is the test contract)."""
    df = listings_table(spark, sf_dir)
    return df.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count("perch").alias("n_with_lines"),
        F.count_distinct("district").alias("n_districts"),
        F.count_distinct("area").alias("n_areas"),
        F.round(F.sum("price_lkr"), 2).alias("total_price"),
        F.sum("bedrooms").cast("bigint").alias("total_bedrooms"),
    )
