"""Inserts, updates and deletes as plans for a table's next snapshot."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def row(df: DataFrame, values: tuple[Any, ...]) -> DataFrame:
    """One row with a table's schema from positional values; points become arrays, dates come from ISO text."""
    if len(values) != len(df.columns):
        raise ValueError(f"{len(df.columns)} values are needed, {len(values)} given")
    columns = []
    for value, f in zip(values, df.schema, strict=True):
        if isinstance(value, tuple):
            value = F.array(*[F.lit(float(v)) for v in value])
            columns.append(value.cast(f.dataType).alias(f.name))
        elif value is not None and isinstance(f.dataType, (T.DateType, T.TimestampType, T.NumericType)):
            columns.append(F.lit(value).cast("string").try_cast(f.dataType).alias(f.name))
        else:
            columns.append(F.lit(value).cast(f.dataType).alias(f.name))
    return df.sparkSession.range(1).select(*columns)


def inserted(df: DataFrame, values: tuple[Any, ...], key: str | None = None) -> DataFrame:
    if key is not None and values[df.columns.index(key)] is None:
        raise ValueError(f"{key} needs a value")
    return df.unionByName(row(df, values))


def deleted(df: DataFrame, where: Column) -> DataFrame:
    """Rows for which the condition is not true (unknown counts as not true)."""
    return df.where(~F.coalesce(where, F.lit(False)))


def updated(df: DataFrame, changes: dict[str, Column], where: Column) -> DataFrame:
    hit = F.coalesce(where, F.lit(False))
    return df.select(*[F.when(hit, changes[c].cast(df.schema[c].dataType)).otherwise(F.col(c)).alias(c) if c in changes else F.col(c) for c in df.columns])
