"""Pages of a result."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def page(df: DataFrame, number: int = 1, size: int = 10) -> DataFrame:
    """Page `number`, from 1; the order must be total for pages not to overlap."""
    if number < 1 or size < 1:
        raise ValueError("pages and their sizes start at 1")
    return df.offset((number - 1) * size).limit(size)


def totals(df: DataFrame, size: int = 10) -> DataFrame:
    """(total_rows, total_pages) of a result."""
    return df.agg(F.count("*").alias("total_rows")).withColumn("total_pages", F.ceil(F.col("total_rows") / size).cast("long"))
