"""Extendible hashing of documents into shards of at most a byte limit.  DataFrame functions only.

A shard is a prefix of the key hash's bits.  One pass over the documents sums their bytes by a prefix of `depth` bits
(map-side combined); those cells, 16 to 32 for each shard, are what the directory is made from.  It starts as one bucket
and goes down bit by bit: buckets that fit are shards and leave with their cells, only the others are split on another
bit.  A cell that is too large itself is refined by further bits of its own rows' hashes, and only it; a bucket of
one key cannot be split and is marked.  The directory holds the shards alone, and is joined on (bits, prefix).
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..runtime import mark, sweep
from .common import unused, written

LIMIT = 1 << 20
BITS = 60


def _hash(key: Column) -> Column:
    """60 bits of the key's MD5."""
    return F.conv(F.substring(F.md5(key), 1, 15), 16, 10).cast("long")


def _prefix(bits: Column, h: str = "h", of: int = BITS) -> Column:
    """The first `bits` of the `of` bits of h."""
    return F.call_function("shiftright", F.col(h), F.lit(of) - bits)


def _sums() -> list[Column]:
    return [F.sum("bytes").alias("bytes"), F.sum("rows").alias("rows"), F.min("first").alias("first"), F.max("last").alias("last")]


#: Rows of a number or two up to which a table is broadcast.
BROADCAST = 1 << 17
SALTS = 8


def _small(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST else df


def _descended(cells: DataFrame, low: int, depth: int, limit: int) -> tuple[list[DataFrame], DataFrame]:
    """The shards of `low` to `depth` bits, and the cells that are too large at depth.

    cells: (cell, bytes, rows, first, last) by depth-bit prefixes, all in buckets that are too large at low - 1 bits."""
    shards = []
    for bits in range(low, depth + 1):
        sums = written(cells.groupBy(_prefix(F.lit(bits), "cell", depth).alias("prefix")).agg(*_sums()), "buckets")
        fits = f"bytes <= {limit} or first = last"
        shards.append(sums.where(fits).select(F.lit(bits).alias("bits"), "prefix", F.col("bytes").alias("shard_bytes"), F.col("rows").alias("shard_rows")))
        large = sums.where(f"not ({fits})").select("prefix")
        n = large.count()
        if not n:
            return shards, cells.limit(0)
        cells = cells.withColumn("prefix", _prefix(F.lit(bits), "cell", depth)).join(_small(large, n), "prefix", "left_semi").drop("prefix")
        if bits == depth or n < 1 << max(0, bits - 1):  # half of the buckets have left: so do their cells
            cells = written(cells, "cells")
    return shards, cells


def directory(sized: DataFrame, limit: int) -> DataFrame:
    """(bits, prefix, shard_bytes, shard_rows): the shards for rows (h, bytes).  bits is a shard's local depth."""
    since = mark()
    total = sized.agg(F.coalesce(F.sum("bytes"), F.lit(0))).first()[0]
    depth = min(BITS, max(1, math.ceil(math.log2(max(1, total / limit)))) + 4)
    sized = sized.select("h", "bytes", F.lit(1).cast("long").alias("rows"), F.col("h").alias("first"), F.col("h").alias("last"))
    low, found, inside = 0, [], sized
    while True:
        cells = written(inside.groupBy(_prefix(F.lit(depth)).alias("cell")).agg(*_sums()), "cells")
        shards, rest = _descended(cells, low, depth, limit)
        found += shards
        n = rest.count()
        if depth == BITS or not n:
            out = written(reduce(DataFrame.unionByName, found), "directory")
            sweep(sized.sparkSession, since, out._plinth_path)
            return out
        inside = sized.withColumn("at", _prefix(F.lit(depth))).join(_small(rest.select(F.col("cell").alias("at")), n), "at", "left_semi")
        low, depth = depth + 1, min(BITS, depth + 8)


def _sized(docs: DataFrame, key: str, body: str) -> DataFrame:
    return docs.select(F.col(f"`{key}`").alias("key"), _hash(F.coalesce(F.col(f"`{key}`").cast("string"), F.lit(""))).alias("h"), F.coalesce(F.octet_length(F.col(f"`{body}`")), F.lit(0)).cast("long").alias("bytes"))


def _placed(rows: DataFrame, found: DataFrame, limit: int) -> DataFrame:
    """rows (.., h) with their shard; the rows of a hot key are dealt over SALTS tasks."""
    depths = [r[0] for r in found.select("bits").distinct().collect()]  # at most BITS + 1 numbers
    tried = F.explode(F.array(*[F.lit(d) for d in sorted(depths)] or [F.lit(0)])).alias("bits")
    salted = found.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    own = rows.withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(SALTS))).select("*", tried).withColumn("prefix", _prefix(F.col("bits")))
    digits = F.when(F.col("bits") == 0, "").otherwise(F.call_function("lpad", F.bin("prefix"), F.col("bits"), F.lit("0")))
    joined = own.join(salted, ["bits", "prefix", "salt"])
    return joined.select(*rows.columns, digits.alias("shard"), F.col("bits").alias("local_depth"), "shard_bytes", (F.col("shard_bytes") > limit).alias("indivisible"))


def shard(docs: DataFrame, limit: int = LIMIT, key: str = "doc_id", body: str = "text") -> DataFrame:
    """(doc_id, shard, local_depth, shard_bytes, indivisible) of every row of docs.

    `shard` is the bucket's hash prefix in binary digits ("" when one shard holds all).  A row's bytes are its text's
    UTF-8 bytes (null: 0), however long it is.  Null keys hash like the empty string; rows with equal keys always share
    a shard, and one of a single key that exceeds the limit is marked indivisible: no further bit could split it.
    Ties: a bucket of exactly `limit` bytes fits.  An empty table gives an empty result."""
    sized = written(_sized(docs, key, body), "sized")
    return _placed(sized.select("key", "h"), directory(sized, limit), limit).drop("h").withColumnRenamed("key", key)


def write_shards(docs: DataFrame, path: str, limit: int = LIMIT, key: str = "doc_id", body: str = "text") -> DataFrame:
    """Writes docs with all its columns as Parquet, one folder a shard (`shard=p0110`) of one file, and returns the directory.

    A shard's rows meet in one task, which holds no more than the limit; an indivisible shard has as many files as it
    holds limits, its rows dealt by a hash of key and text."""
    sized = written(_sized(docs, key, body).select("h", "bytes"), "sized")
    found = directory(sized, limit)
    shard_, h, file = (unused(c, docs.columns) for c in ("shard", "_h", "_file"))
    places = _placed(sized.select("h").distinct(), found, limit).select(F.col("h").alias(h), F.concat(F.lit("p"), "shard").alias(shard_), F.when(F.col("indivisible"), F.ceil(F.col("shard_bytes") / limit)).otherwise(1).cast("int").alias(file))
    keyed = docs.withColumn(h, _hash(F.coalesce(F.col(f"`{key}`").cast("string"), F.lit(""))))
    out = keyed.join(places, h).withColumn(file, F.pmod(F.xxhash64(F.col(f"`{key}`"), F.col(f"`{body}`")), F.col(file)))
    n = max(1, found.count())
    out.repartition(min(n, 1 << 16), shard_, file).sortWithinPartitions(shard_, file).drop(h, file).write.partitionBy(shard_).parquet(path)
    return found
