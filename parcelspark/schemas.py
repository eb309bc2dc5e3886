"""Schemas and fixed values.

Everything under "Fixed values" must equal the behaviour being reproduced for
results to match; it is stated here once, in plain text, and imported elsewhere.
"""

from __future__ import annotations

from pyspark.sql import types as T

# ---------------------------------------------------------------------------
# Fixed values (must stay equal to the reproduced behaviour)
# ---------------------------------------------------------------------------

TARGET = "price_lkr"
NUMERIC_FEATURES = ["kitchen_area_sqft", "bedrooms", "bathrooms", "perch"]
CATEGORICAL_FEATURES = [
    "district",
    "area",
    "parking_spots",
    "has_garden",
    "has_ac",
    "water_supply",
    "electricity",
    "floors",
    "year_built",
]
PROFILE_REQUIRED = ["perch", "bedrooms", "bathrooms", "district", "year_built", "price_lkr"]
LOCATION_COLUMN = "district"
SUBAREA_COLUMN = "area"
YEAR_BUILT_COLUMN = "year_built"
LAND_AREA_COLUMN = "perch"

SPLIT_SEED = 42
TEST_FRACTION = 0.2
SQFT_PER_PERCH = 272.25
SQFT_PER_PERCH_QUOTE = 272  # "if the user quotes perches, multiply by 272"

# Document ingest
PDF_CHUNK_SIZE = 1000
PDF_CHUNK_OVERLAP = 150
PDF_SEPARATORS = ["\n\n", "\n", ". ", " ", ""]
MIN_PAGE_CHARS = 100
MD_CHUNK_SIZE = 300
MD_CHUNK_OVERLAP = 50
MD_SEPARATORS = ["\n## ", "\n### ", "\n\n", "\n", ". ", " ", ""]
MIN_CHUNK_CHARS = 30
MODEL_TOKEN_WINDOW = 256
PREVIEW_CHARS = 160

# Filename conventions -> document metadata (case-insensitive, searched anywhere)
MARKET_ANALYSIS_PATTERN = r"(?i)real_estate_market_analysis_(\d{4})_q(\d)"
STABILITY_REVIEW_PATTERN = r"(?i)fsr_(\d{4})"
PUBLISHER = "Central Bank of Sri Lanka"
MARKET_ANALYSIS_TYPE = "market_analysis"
STABILITY_REVIEW_TYPE = "financial_stability_review"

# Retrieval
TOP_K = 3
COLLECTION_ORDER = ["housing_docs", "markdown_docs"]
EMBEDDING_MODEL_NAME = "hashed-tf-256"
HASH_BUCKETS = 256
SMOKE_QUESTION = "How did house asking prices in Colombo change?"

# Strings that pandas' CSV reader turns into missing values by default
NA_STRINGS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
    "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a",
    "nan", "null",
]

# ---------------------------------------------------------------------------
# Schemas
# ---------------------------------------------------------------------------

LISTINGS = T.StructType([
    T.StructField("listing_id", T.LongType()),
    T.StructField("kitchen_area_sqft", T.DoubleType()),
    T.StructField("bedrooms", T.IntegerType()),
    T.StructField("bathrooms", T.IntegerType()),
    T.StructField("perch", T.DoubleType()),
    T.StructField("district", T.StringType()),
    T.StructField("area", T.StringType()),
    T.StructField("parking_spots", T.IntegerType()),
    T.StructField("has_garden", T.StringType()),
    T.StructField("has_ac", T.StringType()),
    T.StructField("water_supply", T.StringType()),
    T.StructField("electricity", T.StringType()),
    T.StructField("floors", T.IntegerType()),
    T.StructField("year_built", T.IntegerType()),
    T.StructField("price_lkr", T.DoubleType()),
])

PAGE = T.StructType([
    T.StructField("source", T.StringType()),
    T.StructField("page_number", T.IntegerType()),
    T.StructField("text", T.StringType()),
])

PRICE_REQUEST = T.StructType([
    T.StructField("request_id", T.LongType()),
    T.StructField("area_sqft", T.DoubleType()),
    T.StructField("bedrooms", T.IntegerType()),
    T.StructField("bathrooms", T.IntegerType()),
    T.StructField("location", T.StringType()),
    T.StructField("age_years", T.IntegerType()),
])

QUESTION = T.StructType([
    T.StructField("question_id", T.LongType()),
    T.StructField("question", T.StringType()),
])
