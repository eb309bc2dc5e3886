"""Listings from CSV files.

The header is checked against the columns a job needs before anything is computed, strings
that stand for a missing value become null, and the known columns get their types.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schemas import CATEGORICAL_FEATURES, LISTINGS, NA_STRINGS, NUMERIC_FEATURES, PROFILE_REQUIRED, TARGET

#: What training needs, where profiling needs ``PROFILE_REQUIRED``.
TRAINING_REQUIRED = [*NUMERIC_FEATURES, *CATEGORICAL_FEATURES, TARGET]


def check_columns(found: list[str], required: list[str], what: str) -> None:
    """An error that lists the missing columns and those found."""
    missing = [c for c in required if c not in found]
    if missing:
        raise ValueError(f"{what} is missing required columns: {missing}. Found: {found}")


def read_listings_csv(spark: SparkSession, path: str, required: list[str] = PROFILE_REQUIRED,
                      multi_line: bool = False) -> DataFrame:
    """CSV files with a header, one or a folder of them, as a listings table.

    Raises ``FileNotFoundError`` if the path does not exist and ``ValueError`` if a required
    column is absent. Missing-value strings and numbers that cannot be read become null; columns
    that are not of the listings schema stay text. ``multi_line`` allows line breaks
    inside quotes, at the price of one task a file.
    """
    try:
        raw = (spark.read.option("header", True).option("escape", '"').option("multiLine", multi_line)
               .option("inferSchema", False).csv(path))
    except AnalysisException as absent:
        if absent.getCondition() != "PATH_NOT_FOUND":
            raise
        raise FileNotFoundError(f"No listings at {path}. Columns needed: {', '.join(required)}.") from absent
    check_columns(raw.columns, required, f"Listings at {path}")
    types = {f.name: f.dataType for f in LISTINGS.fields}
    return raw.select(*[_typed(c, types.get(c, T.StringType())).alias(c) for c in raw.columns])


def _typed(column: str, dtype: T.DataType):
    value = F.when(~F.col(f"`{column}`").isin(NA_STRINGS), F.col(f"`{column}`"))
    if not isinstance(dtype, T.IntegralType):
        return value.try_cast(dtype)
    # A column with gaps is often written as 3.0; what is not whole, or beyond what a double holds exactly, is no such number.
    number = value.try_cast("double")
    whole = F.when((F.abs(number) <= 2.0 ** 53) & (F.floor(number) == number), number)
    return F.coalesce(value.try_cast(dtype), whole.try_cast(dtype))
