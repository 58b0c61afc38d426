"""The training-data pipeline: quality rules, line dedup, near-duplicates, benchmark decontamination, encoding.

Each stage is (spark, docs, sf_dir) -> DataFrame; its rows are written as Parquet and read again as the next stage's docs. What a stage
wrote for itself is deleted when its rows are written.

All stages take null doc_ids and null or empty texts (these fail the quality rules, but the other stages handle them as stated), texts of
any length, repeated rows, empty tables (no rows come out) and further columns of any name, which are dropped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from millrace.llm import decontaminate, line_templates, quality, simhash, transducer
from millrace.llm._common import DOCUMENT_COLUMNS, benchmark, documents, only_rows


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base test or the rules' posterior rejects go, null and empty texts with them. Repeated rows share a verdict. If
    no document passes the base test, none is left."""
    return quality.kept_documents(docs.select(*DOCUMENT_COLUMNS))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of recurring templates go; documents stay, with an empty text if all their lines went. Null texts stay null; rows of equal doc_id
    and text are treated alike; n_chars follows the text."""
    return line_templates.drop_recurring_lines(docs.select(*DOCUMENT_COLUMNS))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents with a five-word similarity of 0.8 or more the one with the smallest doc_id stays (of those without doc_id
    one; of rows that share it the one with the smallest text hash). Null and empty texts are alike. Texts of under five words are one shingle."""
    own = docs.select(*DOCUMENT_COLUMNS)
    return simhash.one_of_each_group(own, simhash.similar_documents(own))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go. Null and empty texts hold none; an empty benchmark table removes nothing; of rows with
    one doc_id and other texts each is judged by its own."""
    return decontaminate.clean_documents(docs.select(*DOCUMENT_COLUMNS), benchmark(spark, sf_dir))


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every document that is left, encoded and decoded again; null text counts as empty, and
    repeated rows each give a row."""
    return transducer.digests(docs, "byte_bpe_50k.json")


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("encoding", encoding),
]

#: Fitted votes, hash-based groups and token ids are beyond SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = only_rows(spark, lambda stage=stage, docs=docs: stage(spark, docs, sf_dir), f"stage-{name}", always=True)
    return STAGES[-1][1](spark, docs, sf_dir)
