"""Keyed access under the duplicate-key policies of the index kinds.

A table is kept in load order by a position column (`_pos`); a policy says which rows of one key a lookup sees.
Every policy is a filter or one aggregation, so equality and ranges on the key reach the Parquet scan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import fresh_path

#: Keys of an index page: (page bytes - header) // entry bytes.
PAGE = (4096 - 4) // 8


def last_wins(df: DataFrame, key: str, pos: str) -> DataFrame:
    """One row a key: the last loaded (B+ tree)."""
    return _picked(df, key, F.max_by(F.struct(*df.columns), F.col(pos)))


def first_match(df: DataFrame, key: str, pos: str) -> DataFrame:
    """One row a key: the first loaded (extendible hash, ISAM base, sequential file)."""
    return _picked(df, key, F.min_by(F.struct(*df.columns), F.col(pos)))


def _picked(df: DataFrame, key: str, row: Column) -> DataFrame:
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(row.alias("_row")).select(*[F.col(f"_row.`{c}`").alias(c) for c in df.columns])


def base_and_overflow(df: DataFrame, key: str, pos: str) -> DataFrame:
    """Adds `_rn`: 1 for a key's base row, more for its overflow rows, in load order."""
    return df.withColumn("_rn", F.row_number().over(Window.partitionBy(key).orderBy(pos)))


def point(df: DataFrame, key: str, value, pos: str, kind: str) -> DataFrame:
    """What a lookup of one key returns for an index kind; the filter comes first, so it is pushed to the scan."""
    rows = df.where(F.col(key) == F.lit(value))
    if kind == "rtree":
        return rows
    return rows.orderBy(F.desc(pos) if kind == "btree" else F.asc(pos)).limit(1)


def between(df: DataFrame, key: str, low, high, pos: str, kind: str) -> DataFrame:
    """Inclusive range; one row a key for the B+ tree, all duplicates otherwise."""
    rows = df.where(F.col(key).between(F.lit(low), F.lit(high)))
    return last_wins(rows, key, pos) if kind == "btree" else rows


def all_for(df: DataFrame, key: str, value, pos: str) -> DataFrame:
    """Every row of a key, base and overflow, in load order."""
    return df.where(F.col(key) == F.lit(value)).orderBy(pos)


def _first(df: DataFrame, key: str, value, pos: str, last: bool = False) -> DataFrame:
    return df.where(F.col(key) == F.lit(value)).agg((F.max if last else F.min)(pos).alias("_first"))


def without_first(df: DataFrame, key: str, value, pos: str) -> DataFrame:
    """Deletes one row of a key, the first loaded: the next one takes its place."""
    return df.join(F.broadcast(_first(df, key, value, pos)), F.col(key).eqNullSafe(F.lit(value)) & (F.col(pos) == F.col("_first")), "left_anti")  # one row


def updated_first(df: DataFrame, key: str, value, pos: str, changes: dict[str, Column], last: bool = False) -> DataFrame:
    """Changes one row of a key, the first loaded (with `last` the last: what a B+ tree finds)."""
    hit = F.col(key).eqNullSafe(F.lit(value)) & (F.col(pos) == F.col("_first"))
    return df.join(F.broadcast(_first(df, key, value, pos, last)), how="left").select(*[F.when(hit, changes[c]).otherwise(F.col(c)).alias(c) if c in changes else F.col(c) for c in df.columns])  # one row


def updated_or_inserted(df: DataFrame, key: str, value, pos: str, changes: dict[str, Column]) -> DataFrame:
    """Changes a key's base row (ISAM); a key that is absent gets a row of the changes, nulls elsewhere."""
    held = df.agg(F.count_if(F.col(key) == F.lit(value)).alias("_n"), F.coalesce(F.max(pos), F.lit(-1)).alias("_last")).where("_n = 0")
    own = {key: F.lit(value), pos: F.col("_last") + 1} | changes
    new = held.select(*[own.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in df.schema])
    return updated_first(df, key, value, pos, changes).unionByName(new)


def merged(main: DataFrame, added: DataFrame, key: str, pos: str, live: Column | None = None) -> DataFrame:
    """A sequential file's scan, and what its main part is rebuilt from: main and added rows that are live, by key."""
    rows = main.unionByName(added)
    return (rows if live is None else rows.where(live)).orderBy(key, pos)


def _parts(main: DataFrame, added: DataFrame) -> DataFrame:
    return main.withColumn("_in", F.lit(0)).unionByName(added.withColumn("_in", F.lit(1)))


def sequential_point(main: DataFrame, added: DataFrame, key: str, value, pos: str) -> DataFrame:
    """One row of a key: of the main part, or without one there of the added part."""
    return _parts(main, added).where(F.col(key) == F.lit(value)).orderBy("_in", pos).limit(1).drop("_in")


def sequential_between(main: DataFrame, added: DataFrame, key: str, low, high, pos: str) -> DataFrame:
    """All rows of an inclusive range by key, those of the main part before added ones."""
    return _parts(main, added).where(F.col(key).between(F.lit(low), F.lit(high))).orderBy(key, "_in", pos).drop("_in")


def sequential_without(main: DataFrame, added: DataFrame, key: str, value, pos: str) -> DataFrame:
    """Both parts without the row that sequential_point() finds."""
    found = sequential_point(main, added, key, value, pos).select(F.col(pos).alias("_first"))
    return main.unionByName(added).join(F.broadcast(found), F.col(key).eqNullSafe(F.lit(value)) & (F.col(pos) == F.col("_first")), "left_anti")  # one row


def page_directory(df: DataFrame, key: str, page: int = PAGE) -> DataFrame:
    """(page, first_key, keys): the first key of each page of `page` distinct keys.

    Keys are numbered without a global window: they are written in ranges, so that files follow one another; a row's
    number is its place in its file after the counts of the files before."""
    spark, path = df.sparkSession, fresh_path(df.sparkSession, "keys")
    keys = df.where(F.col(key).isNotNull()).select(F.col(key).alias("key")).distinct()
    keys.repartitionByRange("key").sortWithinPartitions("key").write.parquet(path)
    number = F.regexp_extract(F.col("_metadata.file_name"), r"part-(\d+)", 1).cast("int")
    placed = spark.read.schema(keys.schema).parquet(path).select("key", number.alias("part"), F.col("_metadata.row_index").alias("at"))
    counts = placed.groupBy("part").agg(F.count("*").alias("n"))  # one row a file
    before = counts.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    numbered = placed.join(before, "part").withColumn("page", F.floor((F.col("before") + F.col("at")) / page).cast("long"))
    return numbered.groupBy("page").agg(F.min("key").alias("first_key"), F.count("*").alias("keys"))


def statistics(df: DataFrame, key: str, kind: str, page: int = PAGE) -> DataFrame:
    """Counts an index reports about itself."""
    base = [F.count("*").alias("total_rows"), F.count_distinct(key).alias("distinct_keys")]
    if kind == "btree":
        base.append(F.ceil(F.count_distinct(key) / page).cast("long").alias("leaves"))
    elif kind == "isam":
        base += [(F.count("*") - F.count_distinct(key)).alias("overflow"), F.ceil(F.count_distinct(key) / page).cast("long").alias("pages")]
    elif kind == "seq":
        base += [F.min(key).alias("min_key"), F.max(key).alias("max_key")]
    return df.where(F.col(key).isNotNull()).agg(*base)


def directory_histogram(df: DataFrame, key: str, depth: int = 2) -> DataFrame:
    """Rows and keys of each slot of a hash directory of 2**depth slots, integers hashing to themselves."""
    return df.groupBy(F.pmod(key, F.lit(1 << depth)).alias("slot")).agg(F.count("*").alias("n_rows"), F.count_distinct(key).alias("n_keys"))


def lookup(df: DataFrame, key: str, keys: DataFrame) -> DataFrame:
    """Rows of any of the keys in a table."""
    return df.join(keys.select(key).distinct(), key, "left_semi")


def summary(df: DataFrame, by: str, value: str) -> DataFrame:
    """Count, mean, population deviation, least and most of a measure by group."""
    v = F.col(value)
    return df.groupBy(by).agg(F.count("*").alias("n"), F.round(F.avg(v), 6).alias("mean"), F.round(F.stddev_pop(v), 6).alias("std"), F.min(v).alias("least"), F.max(v).alias("most"))
