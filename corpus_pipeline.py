"""From raw documents to packed training sequences: quality, near duplicates, repeated passages, leaks, packing.

Every stage takes (spark, docs, sf_dir); its result is written to the shared folder as Parquet and reread as the next
one's docs.  All but the last return the columns of documents.  Rows without a doc_id leave at the near-duplicate stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plinth.llm import classifier, decontam, minhash, packing, phrases
from plinth.llm.common import discard, table, written
from plinth.runtime import mark, sweep


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, trained on labels, accepts."""
    return classifier.accepted(docs, classifier.fit(docs, table(spark, sf_dir, "labels")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group: that with the smallest doc_id.  A similarity of 0.8 links.

    Of rows that share that doc_id one stays, the first by a hash of its text: repeated rows are copies, too."""
    kept = minhash.near_duplicates(docs, percent=80).where("kept").select("doc_id").distinct()
    one = F.min_by(F.struct(*[F.col(f"`{c}`") for c in docs.columns]), F.xxhash64("text")).alias("row")
    return docs.join(kept, "doc_id", "left_semi").groupBy("doc_id").agg(one).select("row.*")


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the passages of 20 words or more that already stand in an earlier document."""
    return phrases.cleaned(docs)


def leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no item of the benchmark."""
    found = decontam.contaminated(docs, table(spark, sf_dir, "benchmark")).where("contaminated").select("doc_id")
    return docs.join(found, "doc_id", "left_anti")


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every piece of every document with its place in a packed sequence."""
    return packing.pack(docs)


STAGES = [
    ("quality classifier", quality),
    ("MinHash near-dedup", near_duplicates),
    ("substring dedup", repeated_passages),
    ("benchmark decontamination", leaks),
    ("best-fit packing", sequences),
]

#: A trained classifier and tokenizers have no SQL; tests compare run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's result.  What earlier stages keep on the way is deleted when their own result is written."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        before, since = docs, mark()
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        sweep(spark, since, docs._plinth_path)
        discard(before)
    return STAGES[-1][1](spark, docs, sf_dir)
