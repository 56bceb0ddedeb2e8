"""The operators over their whole tables, with production parameters: name -> function(spark, sf_dir) -> DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import classifier, decontam, minhash, oracles, packing, phrases, quality_rules, sharding, token_orc, urlfilter, warc
from .common import table


def op1_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


def op2_warc_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judged(table(spark, sf_dir, "documents"))


def op4_extendible_hashing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents"))


def op5_phrase_automata(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.digest(table(spark, sf_dir, "documents"))


def op6_latent_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return classifier.score(docs, classifier.fit(docs, table(spark, sf_dir, "labels")))


def op8_token_orc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_orc.round_trip(table(spark, sf_dir, "documents"))


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.verdicts(table(spark, sf_dir, "pages"))


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_minhash_dedup, op2_warc_transactions, op3_quality_rules, op4_extendible_hashing, op5_phrase_automata, op6_latent_decontamination, op7_quality_classifier, op8_token_orc, op9_best_fit_packing, op10_url_filter)}
#: The other operators rest on trained models or tokenizers, which SQL has not; brute-force tests stand for them.
ORACLES: dict[str, str] = {"op1_minhash_dedup": oracles.OP1, "op2_warc_transactions": oracles.OP2, "op4_extendible_hashing": oracles.OP4, "op5_phrase_automata": oracles.OP5}
