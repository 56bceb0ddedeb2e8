"""Helpers shared by the operators: the cluster's shared folder, written tables and word handling."""

from __future__ import annotations

import threading
from contextlib import contextmanager

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import delete, fresh_path, settle

#: Class of the characters that part words, as the contracts write it.
WORD = r"[^\x20\x09-\x0D]+"


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_writing, _writers = threading.Lock(), [0, "false"]


@contextmanager
def _cleaning(spark: SparkSession):
    """Shuffle files of plans that run meanwhile go when they end.  Writes may overlap: the last one restores the setting."""
    with _writing:
        if not _writers[0]:
            _writers[1] = spark.conf.get(_CLEANUP, "false")
            spark.conf.set(_CLEANUP, "true")
        _writers[0] += 1
    try:
        yield
    finally:
        with _writing:
            _writers[0] -= 1
            if not _writers[0]:
                spark.conf.set(_CLEANUP, _writers[1])


def written(df: DataFrame, label: str, codec: str = "snappy") -> DataFrame:
    """df as a Parquet table in the shared folder, reread: its lineage is cut and a lost executor takes nothing along.

    The write's shuffle files go when it ends, as the plan is not run again."""
    spark, path = df.sparkSession, fresh_path(df.sparkSession, label)
    with _cleaning(spark):
        df.write.option("compression", codec).parquet(path)
    settle(spark)
    out = spark.read.schema(df.schema).parquet(path)
    out._plinth_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes tables made by written() that nothing reads any more."""
    for df in tables:
        path = getattr(df, "_plinth_path", None)
        if path:
            delete(df.sparkSession, path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def with_columns(df: DataFrame, names: list[str]) -> DataFrame:
    """Just the named columns; extra ones, whatever their names, are left behind."""
    return df.select(*[F.col(f"`{n}`") for n in names])


def dealt_join(left: DataFrame, right: DataFrame, keys: list[str], by: list[str], how: str = "inner", salts: int = 8) -> DataFrame:
    """left joined with right, which has few rows a key: left's rows of one key are dealt over `salts` tasks by a hash of
    `by`, and right's rows are repeated for each."""
    salt = unused("_salt", [*left.columns, *right.columns])
    own = left.withColumn(salt, F.pmod(F.xxhash64(*by), F.lit(salts)).cast("int"))
    return own.join(right.withColumn(salt, F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))), [*keys, salt], how).drop(salt)


def unused(name: str, columns: list[str]) -> str:
    """name, lengthened until no column is called so (Spark ignores case)."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def let(value: Column, body) -> Column:
    """body(value) with value computed once a row, however often body uses it."""
    return F.transform(F.array(value), body)[0]


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser, on a copy."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def odd_constants(n: int, seed: int) -> np.ndarray:
    return mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed)) | np.uint64(1)


#: A word of more bytes is never cached, so that a cache's size is bounded by its number of words.
LONG_WORD = 256


class WordHash(dict):
    """Word (bytes) -> 64-bit hash; keeps at most `most` words of at most LONG_WORD bytes."""

    most = 300_000

    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh3_64_intdigest(word)
        if len(word) <= LONG_WORD:
            if len(self) >= self.most:
                self.clear()
            self[word] = h
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def grams(ids: np.ndarray, n: int, constants: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each run of n ids."""
    size = len(ids) - n + 1
    h = ids[:size] * constants[0]
    for j in range(1, n):
        h += ids[j : j + size] * constants[j]
    return mix(h)


def blocks(batch, columns: list[str], most: int = 8 << 20):
    """Lists of a batch's values, column by column, in slices of about `most` bytes of the last (binary) column."""
    import pyarrow as pa
    import pyarrow.compute as pc

    *_, last = columns
    sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column(last)), 0).to_numpy(zero_copy_only=False))
    at = 0
    while at < batch.num_rows:
        upto = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + most, "right")))
        part = batch.slice(at, upto - at)
        yield [part.column(c).to_pylist() if pa.types.is_binary(part.column(c).type) else part.column(c) for c in columns]
        at = upto
