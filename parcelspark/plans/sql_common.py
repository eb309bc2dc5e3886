"""DuckDB twins of shared building blocks, used by the oracle SQL strings."""

from __future__ import annotations

# The listings table of ``sources.tables.listings`` in DuckDB SQL.
LISTINGS_CTE = """
listings AS (
  SELECT o.o_orderkey AS listing_id,
         li.kitchen_area_sqft, li.bedrooms, li.bathrooms, li.perch,
         r.r_name AS district, n.n_name AS area,
         CAST(o.o_custkey % 4 AS INTEGER) AS parking_spots,
         o.o_orderstatus AS has_garden,
         CASE WHEN c.c_acctbal >= 0 THEN 'Yes' ELSE 'No' END AS has_ac,
         c.c_mktsegment AS water_supply,
         o.o_orderpriority AS electricity,
         CAST(o.o_orderkey % 3 + 1 AS INTEGER) AS floors,
         CAST(year(o.o_orderdate) AS INTEGER) AS year_built,
         li.price_lkr
  FROM orders o
  LEFT JOIN (
    SELECT l_orderkey,
           CAST(count(*) AS INTEGER) AS bedrooms,
           CAST(1 + count_if(l_returnflag = 'R') AS INTEGER) AS bathrooms,
           sum(l_quantity) AS perch,
           round(35.0::DOUBLE + 2150.0::DOUBLE * avg(l_discount), 2) AS kitchen_area_sqft,
           round(sum(l_extendedprice), 2) AS price_lkr
    FROM lineitem GROUP BY l_orderkey
  ) li ON o.o_orderkey = li.l_orderkey
  LEFT JOIN customer c ON o.o_custkey = c.c_custkey
  LEFT JOIN nation n ON c.c_nationkey = n.n_nationkey
  LEFT JOIN region r ON n.n_regionkey = r.r_regionkey
)"""

# Seeded split: a row is in the test set when the first 32 bits of
# md5('42:' || key) fall below 20% of the 32-bit range.
SPLIT_CTE = """
split AS (
  SELECT *, ('0x' || substr(md5('42:' || CAST(listing_id AS VARCHAR)), 1, 8))::BIGINT
            < 858993459.2 AS is_test
  FROM listings
)"""


def with_ctes(*ctes: str) -> str:
    return "WITH " + ",\n".join(c.strip() for c in ctes) + "\n"
