"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import arrow_output, decontaminate, importance, licenses, line_templates, minhash, pii, prefix_trie, quality, sharding, simhash, token_counts, transducer
from ._common import benchmark, documents


def op1_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transducer.digests(documents(spark, sf_dir), "byte_bpe_50k.json")


def op2_line_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_templates.drop_recurring_lines(documents(spark, sf_dir).select("doc_id", "text"), count="n_dropped")


def op3_quality_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(documents(spark, sf_dir))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(documents(spark, sf_dir), "word_bpe_49k.json")


def op5_benchmark_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(documents(spark, sf_dir), benchmark(spark, sf_dir)).drop("text_hash")


def op6_interleaved_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(documents(spark, sf_dir))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(documents(spark, sf_dir)).drop("text_hash")


def op8_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(documents(spark, sf_dir))


def op9_arrow_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return arrow_output.round_trip(spark, documents(spark, sf_dir), "word_bpe_49k.json", end_id=1)


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(licenses.with_paths(documents(spark, sf_dir)))


def op11_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.similar_sets(documents(spark, sf_dir))


def op12_importance_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.resample(documents(spark, sf_dir), benchmark(spark, sf_dir))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.trie(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


QUERIES = {f.__name__: f for f in (op1_bpe_round_trip, op2_line_templates, op3_quality_votes, op4_token_counts, op5_benchmark_leaks, op6_interleaved_shards, op7_simhash, op8_personal_data, op9_arrow_ids, op10_license_scan, op11_minhash, op12_importance_resample, op13_prefix_trie)}
ORACLES: dict[str, str] = {"op10_license_scan": licenses.oracle(), "op11_minhash": minhash.ORACLE, "op12_importance_resample": importance.ORACLE, "op13_prefix_trie": prefix_trie.ORACLE}
