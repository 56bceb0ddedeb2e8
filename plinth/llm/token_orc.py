"""Token ids as ORC: run-length encoded integers, row indexes and Bloom filters on doc_id, in ascending doc_id order.

Texts are range-partitioned and sorted before they are tokenised, so ids are made where they are written and never
shuffled.  Part files follow one another in doc_id order; readers split a file by stripe and prune stripes and row
groups by the statistics and Bloom filters of doc_id.
"""

from __future__ import annotations

import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..runtime import delete, fresh_path, ship
from .common import blocks, with_columns, written
from .tokens import END, encoder, ids_array, tokenizer_path

SCHEMA = "doc_id long, tie long, ids array<int>"
#: Pieces that a worker surely remembers, some 200 bytes each, and up to as many older ones: new ones take most of the time.
PIECES = 600_000
ORC = {
    "compression": "zstd",
    "orc.stripe.size": str(16 << 20),
    "orc.row.index.stride": "1000",
    "orc.bloom.filter.columns": "doc_id",
    "orc.bloom.filter.fpp": "0.01",
}


def _tokens(path: str):
    def run(batches):
        own = encoder(path, PIECES)
        for batch in batches:
            for ids, ties, texts in blocks(batch, ["doc_id", "tie", "text"], 2 << 20):
                parts = [own.encode((t or b"").decode()) + END for t in texts]
                yield pa.RecordBatch.from_arrays([ids, ties, ids_array(parts)], names=["doc_id", "tie", "ids"])

    return run


def _digests(batches):
    for batch in batches:
        ids = batch.column("ids")
        ends, data = ids.offsets.to_pylist(), memoryview(ids.values.to_numpy()).cast("B")
        crc = [zlib.crc32(data[4 * a : 4 * b]) for a, b in zip(ends, ends[1:], strict=False)]
        n = [b - a for a, b in zip(ends, ends[1:], strict=False)]
        yield pa.RecordBatch.from_arrays([batch.column("file"), batch.column("doc_id"), batch.column("tie"), pa.array(n, pa.int64()), pa.array(crc, pa.int64())], names=["file", "doc_id", "tie", "n_tokens", "ids_crc32"])


def write_tokens(docs: DataFrame, path: str, tokenizer: str | None = None) -> None:
    """Writes each row's ids and the end id 0.  Rows with one doc_id follow one another, ordered by a hash of the text;
    null doc_ids come first; null texts are the end id alone; an empty table makes an empty ORC table.  However many rows
    repeat each other wholly, they are dealt over ranges by where they came from; a text of any length is one row."""
    ship(docs.sparkSession)
    docs = with_columns(docs, ["doc_id", "text"]).select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("tie"), F.col("text").cast("binary").alias("text"))
    ordered = docs.withColumn("part", F.spark_partition_id()).repartitionByRange("doc_id", "tie", "part").drop("part").sortWithinPartitions("doc_id", "tie")
    ordered.mapInArrow(_tokens(tokenizer or tokenizer_path("byte_bpe_50k.json")), SCHEMA).write.options(**ORC).orc(path)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """(file, doc_id, tie, ids): one row a document; a filter on doc_id prunes files, stripes and row groups."""
    number = F.regexp_extract(F.col("_metadata.file_name"), r"part-(\d+)", 1).cast("int")
    return spark.read.schema(SCHEMA).orc(path).select(number.alias("file"), "doc_id", "tie", "ids")


def index(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document in the files; start counts the ids before it.

    The running sum is taken within a file; the files' totals, one row a file, give each file's own start."""
    ship(spark)
    rows = written(read_tokens(spark, path).mapInArrow(_digests, "file int, doc_id long, tie long, n_tokens long, ids_crc32 long"), "digests")
    inside = Window.partitionBy("file").orderBy(F.asc_nulls_first("doc_id"), "tie").rowsBetween(Window.unboundedPreceding, -1)
    before = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    totals = rows.groupBy("file").agg(F.sum("n_tokens").alias("total")).select("file", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("base"))
    placed = rows.withColumn("before", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0))).join(totals, "file")
    return placed.select("doc_id", (F.col("base") + F.col("before")).alias("start"), "n_tokens", "ids_crc32")


def round_trip(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    spark = docs.sparkSession
    path = fresh_path(spark, "orc")
    write_tokens(docs, path, tokenizer)
    out = index(spark, path)  # rests on digests, which are a table
    delete(spark, path)
    return out
