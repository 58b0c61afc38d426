"""Operator 6: proportional stratified interleaving into shards.

Rows are shuffled with a seed and ranked within their source; a row's fractional rank is (rank + 1/2) / (rows of its source).
Sorted by fractional rank, any stretch of rows holds each source in proportion, so cutting the order into equal stretches gives
shards of the same mixture. Law ``rows``: shard sizes differ by one row at most.

A source may hold any part of the rows: ranks come from a range-dealt sort of narrow rows (no text) and the row counts of its
partitions, never from one task for a source. Both orders are total up to exact repeats, which are interchangeable.

Defined results: null text has no bytes (size 16, CRC 0); null source is a source of its own; null or equal doc_ids are ordered
by their CRC; further columns are ignored; an empty table gives no rows. Fewer rows than shards leave the last shards empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..tables import ranked

SHARDS, SEED = 40, 20_240_229

def interleave(docs: DataFrame, shards: int = SHARDS, seed: int = SEED, source: str = "source") -> DataFrame:
    """doc_id, source, size, text_crc32, position (from 0 in the interleaved order), shard and slot of every row."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(source).cast("string").alias("source"), (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    rows = rows.withColumn("_draw", F.xxhash64(F.lit(seed), "doc_id", "text_crc32"))
    within = ranked(rows, [F.asc_nulls_first("source"), F.asc("_draw"), F.asc("doc_id"), F.asc("text_crc32"), F.asc("size")], "_rank", "strata", group="source")
    share = (F.col("_rank") + 0.5) / F.col("_rank_of")
    placed = ranked(within.select("doc_id", "source", "size", "text_crc32", share.alias("_share")), [F.asc("_share"), F.asc_nulls_first("source"), F.asc("doc_id"), F.asc("text_crc32"), F.asc("size")], "position", "interleaved")
    # shard = floor(position * shards / count); the first position of shard s is ceil(s * count / shards)
    count = within.count()
    placed = placed.withColumn("shard", F.expr(f"CAST(position * {shards}L DIV {max(count, 1)}L AS INT)"))
    return placed.withColumn("slot", F.expr(f"position - (shard * {count}L + {shards - 1}L) DIV {shards}L"))


def shard_documents(docs: DataFrame, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    placed = interleave(docs, shards, seed)
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "source", "position")
