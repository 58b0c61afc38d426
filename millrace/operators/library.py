"""Library upkeep: filters, duplicates, upserts, cascades, citations and audits, as joins and aggregates of whole tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.gates import has_visible_text

CITATIONS_REVOKED = "\n\n[sources withdrawn: a cited document changed]"


def filtered(docs: DataFrame, text: str = "", tag: str | None = None, favorites: bool = False, sort: str = "newest") -> DataFrame:
    """Documents by favourite mark, tag, and text within title, file name or a tag (case and accents ignored), the newest first or by title."""
    has = lambda c: F.contains(F.collate(c, "UNICODE_CI_AI"), F.collate(F.lit(text), "UNICODE_CI_AI"))
    out = docs.where("is_favorite") if favorites else docs
    if tag is not None:
        out = out.where(F.array_contains("tags", tag))
    if text:
        out = out.where(has(F.col("title")) | has(F.col("file_name")) | F.exists("tags", has))
    return out.orderBy(F.desc("created_at"), "doc_id") if sort == "newest" else out.orderBy("title", "doc_id")


def recent(rows: DataFrame, group: str, newest: Column, *ties: str) -> DataFrame:
    return rows.withColumn("position", F.row_number().over(Window.partitionBy(group).orderBy(newest, *ties)))


def deduplicated(docs: DataFrame) -> DataFrame:
    """doc_id, kb_id, survivor, survivor_status, kept: within a knowledge base the first arrival of each content stays."""
    w = Window.partitionBy("kb_id", "content_hash").orderBy("created_at", "doc_id")
    first = docs.select("*", F.first("doc_id").over(w).alias("survivor"), F.first("status").over(w).alias("survivor_status"))
    return first.select("doc_id", "kb_id", "survivor", "survivor_status", (F.col("doc_id") == F.col("survivor")).alias("kept"))


def upserted(old: DataFrame, new: DataFrame, immutable: list[str], mutable: list[str], key: str = "doc_id") -> DataFrame:
    """Rows after an upsert with ``action`` (kept, inserted, updated, refused): a change of an immutable field is refused."""
    o, n = old.select(key, *(F.col(c).alias(f"o_{c}") for c in immutable + mutable), F.lit(True).alias("in_old")), new.select(key, *(F.col(c).alias(f"n_{c}") for c in immutable + mutable), F.lit(True).alias("in_new"))
    j = o.join(n, key, "full_outer")
    differs = reduce(lambda a, b: a | b, (~F.col(f"o_{c}").eqNullSafe(F.col(f"n_{c}")) for c in immutable)) if immutable else F.lit(False)
    action = F.when(F.col("in_new").isNull(), "kept").when(F.col("in_old").isNull(), "inserted").when(differs, "refused").otherwise("updated")
    fresh = F.col("action").isin("inserted", "updated")
    return j.withColumn("action", action).select(key, "action", *(F.when(fresh, F.col(f"n_{c}")).otherwise(F.col(f"o_{c}")).alias(c) for c in immutable + mutable))


def ready_or_refused(upserts: DataFrame, chunks: DataFrame) -> DataFrame:
    """Upserted documents with a fresh chunk_count; one that would become ready without chunks, or with chunks of several encoders, is refused."""
    n = chunks.groupBy("doc_id").agg(F.count("*").alias("n"), F.count_distinct("encoder_signature").alias("s"))
    j = upserts.join(n, "doc_id", "left")
    fine = F.coalesce((F.col("n") >= 1) & (F.col("s") == 1), F.lit(False))
    bad = F.col("action").isin("inserted", "updated") & (F.col("status") == "ready") & ~fine
    return j.withColumn("bad", bad).withColumn("action", F.when(F.col("bad"), "refused").otherwise(F.col("action"))).withColumn("status", F.when(F.col("bad"), F.col("old_status")).otherwise(F.col("status"))).withColumn("chunk_count", F.coalesce("n", F.lit(0))).drop("n", "s", "old_status", "bad")


def replaced_chunks(old: DataFrame, new: DataFrame, valid_docs: DataFrame) -> DataFrame:
    """All chunks of a document change together, and only if the new set is valid."""
    accepted = new.join(valid_docs.select("doc_id"), "doc_id", "left_semi")
    return old.join(accepted.select("doc_id").distinct(), "doc_id", "left_anti").unionByName(accepted)


def valid_sets(chunks: DataFrame) -> DataFrame:
    """doc_id of chunk sets with ordinals 0..n-1, text, and one encoder signature."""
    g = chunks.groupBy("doc_id").agg(F.count("*").alias("n"), F.count_distinct("ordinal").alias("d"), F.min("ordinal").alias("lo"), F.max("ordinal").alias("hi"), F.count_distinct("encoder_signature").alias("s"), F.min(F.length(F.trim("text"))).alias("t"))
    return g.where("n = d AND lo = 0 AND hi = n - 1 AND s = 1 AND t > 0").select("doc_id")


def without(rows: DataFrame, deleted: DataFrame, key: str) -> DataFrame:
    return rows.join(deleted.select(key).distinct(), key, "left_anti")


def source_validity(sources: DataFrame, chunks: DataFrame, docs: DataFrame) -> DataFrame:
    """conv_id, seq, position, chunk_id, unchanged, valid: a cited chunk is still there with the same text, page and (where both sides have it)
    media; and then of the same knowledge base, with a finite score, readable, and its document ready."""
    media = "media" in sources.columns and "media" in chunks.columns
    c = chunks.select("chunk_id", F.col("text").alias("c_text"), F.col("page").alias("c_page"), F.col("kb_id").alias("c_kb"), "doc_id", *([F.col("media").alias("c_media")] if media else [])).join(docs.select("doc_id", "status"), "doc_id", "left")
    j = sources.join(c, "chunk_id", "left")
    same = F.col("text").eqNullSafe(F.col("c_text")) & F.col("page").eqNullSafe(F.col("c_page")) & F.col("doc_id").isNotNull()
    if media:
        same = same & F.col("media").eqNullSafe(F.col("c_media"))
    finite = ~F.isnan("score") & (F.abs("score") < float("inf"))
    valid = same & F.coalesce((F.col("status") == "ready") & (F.col("kb_id") == F.col("c_kb")) & finite & has_visible_text(F.col("c_text")), F.lit(False))
    return j.select("conv_id", "seq", "position", "chunk_id", same.alias("unchanged"), valid.alias("valid"))


def revoked(sources: DataFrame, chunks: DataFrame, docs: DataFrame, messages: DataFrame) -> DataFrame:
    """conv_id, seq, n_sources, revoked, content: one changed source empties a message's whole list and puts a notice at its end. What is
    left keeps its numbers."""
    v = source_validity(sources, chunks, docs)
    g = v.groupBy("conv_id", "seq").agg(F.count("*").alias("n"), F.bool_and("unchanged").alias("fine"))
    rows = g.join(messages.select("conv_id", "seq", "content"), ["conv_id", "seq"])
    return rows.select("conv_id", "seq", F.when(F.col("fine"), F.col("n")).otherwise(0).alias("n_sources"), (~F.col("fine")).alias("revoked"), F.concat("content", F.when(F.col("fine"), "").otherwise(CITATIONS_REVOKED)).alias("content"))


def recovered(docs: DataFrame, chunks: DataFrame) -> DataFrame:
    """Interrupted documents count as failed; chunk counts are taken anew."""
    n = chunks.groupBy("doc_id").agg(F.count("*").alias("n"))
    hanging = F.col("status") == "indexing"
    return docs.join(n, "doc_id", "left").select("doc_id", F.when(hanging, "failed").otherwise(F.col("status")).alias("status"), F.when(hanging, "import was interrupted").alias("error_message"), F.coalesce("n", F.lit(0)).alias("chunk_count"))


def orphans(children: dict[str, tuple[DataFrame, str, DataFrame, str]]) -> DataFrame:
    """relation, key of rows without the row that they refer to; children: relation -> (rows, key, parents, parent key)."""
    found = [rows.select(F.col(k).alias("_k")).join(parents.select(F.col(pk).alias("_k")), "_k", "left_anti").select(F.lit(name).alias("relation"), F.col("_k").cast("string").alias("key")) for name, (rows, k, parents, pk) in children.items()]
    return reduce(DataFrame.unionByName, found)


def chunk_audit(chunks: DataFrame, vector_fine: Column) -> DataFrame:
    """doc_id, problem: a row for each rule that a document's chunks break. The rules on media hold where chunks have the columns media_kind,
    doc_kind, media_signature, media_recipe and frame_times."""
    rules = {
        "repeated ids": F.count("*") != F.count_distinct("chunk_id"),
        "ordinals": (F.min("ordinal") != 0) | (F.max("ordinal") != F.count("*") - 1) | (F.count_distinct("ordinal") != F.count("*")),
        "page": F.bool_or(F.col("page") <= 0),
        "blank text": F.bool_or(F.trim("text") == ""),
        "vector": F.bool_or(~vector_fine),
        "dims": F.bool_or(F.col("dims") != F.size("embedding")),
        "signatures": F.count_distinct("encoder_signature") != 1,
    }
    if {"media_kind", "doc_kind", "media_signature", "media_recipe", "frame_times"} <= set(chunks.columns):
        rules |= {
            "media kind": F.bool_or(~F.col("media_kind").eqNullSafe(F.col("doc_kind"))),
            "media signature": F.count_distinct(F.coalesce("media_signature", F.lit(""))) > 1,
            "media recipe": F.count_distinct(F.coalesce("media_recipe", F.lit(""))) > 1,
            "frame times": F.bool_or((F.col("media_kind") == "video") & (F.coalesce(F.size("frame_times"), F.lit(0)) < 1)),
        }
    g = chunks.groupBy("doc_id").agg(*(c.alias(r) for r, c in rules.items()))
    return g.select("doc_id", F.explode(F.filter(F.array(*(F.when(F.col(f"`{r}`"), F.lit(r)) for r in rules)), lambda x: x.isNotNull())).alias("problem"))
