"""Registered queries: library upkeep, integrity, media timelines."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..catalog import query
from ..functions import gates
from ..operators import library, timeline, versions
from ..sources import ingest
from ..tables import own_path
from .views import Tables, with_tables

# ---- filters and order


@query("filter_documents", with_tables("SELECT doc_id, title FROM docs WHERE is_favorite AND list_contains(tags, 'en') AND (contains(title, 'src1') OR contains(file_name, 'src1') OR len(list_filter(tags, lambda x: contains(x, 'src1'))) > 0)", "docs"))
def filter_documents(t: Tables):
    return library.filtered(t.docs(), text="SRC1", tag="en", favorites=True).select("doc_id", "title")


_RECENT = """SELECT kind, kb_id, id, row_number() OVER (PARTITION BY kind, kb_id ORDER BY updated_at DESC, id) AS position FROM (SELECT 'document' AS kind, kb_id, doc_id AS id, updated_at FROM docs
 UNION ALL SELECT 'conversation', kb_id, conv_id, TIMESTAMP '2024-01-01' + to_minutes(conv_id % 97) FROM kb_conversations UNION ALL SELECT 'note', kb_id, note_id, TIMESTAMP '2024-01-01' + to_minutes(note_id % 89) FROM notes)"""


@query("recent_items", with_tables(_RECENT, "docs", "kb_conversations", "notes"))
def recent_items(t: Tables):
    """All documents, conversations and notes of each library, the newest first."""
    at = lambda k, n: F.timestamp_seconds(F.lit(1_704_067_200) + 60 * (F.col(k) % n))
    kinds = {"document": t.docs().select("kb_id", F.col("doc_id").alias("id"), "updated_at"), "conversation": t.kb_conversations().select("kb_id", F.col("conv_id").alias("id"), at("conv_id", 97).alias("updated_at")), "note": t.notes().select("kb_id", F.col("note_id").alias("id"), at("note_id", 89).alias("updated_at"))}
    rows = reduce(DataFrame.unionByName, (rows.select(F.lit(kind).alias("kind"), "*", F.struct(F.lit(kind).alias("kind"), "kb_id").alias("list")) for kind, rows in kinds.items()))
    return ingest.in_order(rows, F.desc("updated_at"), F.asc("id"), group="list").select("kind", "kb_id", "id", "position")


@query("chunk_counts", with_tables("SELECT doc_id, count(*) AS n FROM chunks GROUP BY doc_id", "chunks"))
def chunk_counts(t: Tables):
    return t.chunks().groupBy("doc_id").agg(F.count("*").alias("n"))


@query("document_chunks", with_tables("SELECT doc_id, chunk_id, ordinal FROM chunks ORDER BY doc_id, ordinal", "chunks"))
def document_chunks(t: Tables):
    return t.chunks().select("doc_id", "chunk_id", "ordinal").orderBy("doc_id", "ordinal")


@query("distinct_signatures", with_tables("SELECT doc_id, count(DISTINCT s) AS n, count(DISTINCT s) = 1 AS uniform FROM (SELECT doc_id, CASE WHEN doc_id % 23 = 0 AND ordinal = 1 THEN 'sig-c' ELSE encoder_signature END AS s FROM chunks) GROUP BY doc_id", "chunks"))
def distinct_signatures(t: Tables):
    """Of each document; every twenty-third has a second chunk from another encoder."""
    n = F.count_distinct(F.when((F.col("doc_id") % 23 == 0) & (F.col("ordinal") == 1), "sig-c").otherwise(F.col("encoder_signature")))
    return t.chunks().groupBy("doc_id").agg(n.alias("n"), (n == 1).alias("uniform"))


@query("kb_counts", with_tables("SELECT d.kb_id, count(*) AS documents, coalesce(any_value(c.n), 0) AS chunks, coalesce(any_value(v.n), 0) AS conversations, coalesce(any_value(n.n), 0) AS notes FROM docs d LEFT JOIN (SELECT kb_id, count(*) AS n FROM chunks GROUP BY kb_id) c ON c.kb_id = d.kb_id LEFT JOIN (SELECT kb_id, count(*) AS n FROM kb_conversations GROUP BY kb_id) v ON v.kb_id = d.kb_id LEFT JOIN (SELECT kb_id, count(*) AS n FROM notes GROUP BY kb_id) n ON n.kb_id = d.kb_id GROUP BY d.kb_id", "docs", "chunks", "kb_conversations", "notes"))
def kb_counts(t: Tables):
    count = lambda df, name: df.groupBy("kb_id").agg(F.count("*").alias(name))
    out = count(t.docs(), "documents")
    for name, rows in (("chunks", t.chunks()), ("conversations", t.kb_conversations()), ("notes", t.notes())):
        out = out.join(count(rows, name), "kb_id", "left")
    return out.na.fill(0, ["chunks", "conversations", "notes"])


@query("checks_summary", with_tables("SELECT kb_id, count(*) FILTER (status = 'ready' AND byte_count > 500) AS passed, count(*) AS total FROM docs GROUP BY kb_id", "docs"))
def checks_summary(t: Tables):
    ok = (F.col("status") == "ready") & (F.col("byte_count") > 500)
    return t.docs().groupBy("kb_id").agg(F.sum(ok.cast("long")).alias("passed"), F.count("*").alias("total"))


# ---- duplicates and writes


@query("dedupe_content", with_tables("SELECT doc_id, kb_id, first_value(doc_id) OVER w AS survivor, first_value(status) OVER w AS survivor_status, doc_id = first_value(doc_id) OVER w AS kept FROM docs WINDOW w AS (PARTITION BY kb_id, content_hash ORDER BY created_at, doc_id)", "docs"))
def dedupe_content(t: Tables):
    return library.deduplicated(t.docs())


def _incoming(t: Tables):
    """An upsert: every fifth document again with a new status, some of them with another size, content, file name, path or kind of media, and some new
    ones."""
    d = _identified(t).where("doc_id % 5 = 0")
    other = lambda k, c, value: F.when(F.col("doc_id") % 70 == k, value).otherwise(F.col(c)).alias(c)
    fields = [other(10, "byte_count", F.col("byte_count") + 1), other(20, "content_hash", F.lit("other")), other(30, "file_name", F.lit("x.txt")), other(40, "relative_path", F.lit("x")), other(50, "media", F.lit("video"))]
    changed = d.select("doc_id", "kb_id", *fields, F.lit("ready").alias("status"))
    return changed.unionByName(d.select((-1 - F.col("doc_id")).alias("doc_id"), "kb_id", *_IDENTITY, F.lit("indexing").alias("status")))


#: What tells a document's original file; it may not change.
_IDENTITY = ["byte_count", "content_hash", "file_name", "relative_path", "media"]


def _identified(t: Tables):
    """The documents with the path of their original and, for every fourth, the kind of media."""
    return t.docs().withColumn("relative_path", F.concat(F.substring("content_hash", 1, 2), F.lit("/"), F.col("file_name"))).withColumn("media", F.when(F.col("doc_id") % 4 == 0, "image"))


_UPSERTS = """c AS (SELECT doc_id, count(*) AS n, count(DISTINCT encoder_signature) AS s FROM changed_chunks GROUP BY doc_id),
 u AS (SELECT d.doc_id, status, byte_count, coalesce(n, 0) AS n, CASE WHEN d.doc_id % 5 <> 0 THEN 'kept' WHEN d.doc_id % 70 IN (10, 20, 30, 40, 50) OR coalesce(s, 0) <> 1 THEN 'refused' ELSE 'updated' END AS action FROM docs d LEFT JOIN c ON c.doc_id = d.doc_id)"""


@query("upsert_documents", with_tables("SELECT doc_id, action, byte_count, CASE action WHEN 'updated' THEN 'ready' ELSE status END AS status, n AS chunk_count FROM u UNION ALL SELECT -1 - doc_id, 'inserted', byte_count, 'indexing', 0 FROM docs WHERE doc_id % 5 = 0", "docs", "changed_chunks", extra=_UPSERTS))
def upsert_documents(t: Tables):
    """Documents without chunks, or of another original file, are not made ready."""
    out = library.upserted(_identified(t), _incoming(t), ["kb_id", *_IDENTITY], ["status"]).join(t.docs().select("doc_id", F.col("status").alias("old_status")), "doc_id", "left")
    return library.ready_or_refused(out, t.changed_chunks()).select("doc_id", "action", "byte_count", "status", "chunk_count")


_REPLACED = "SELECT doc_id, CASE WHEN doc_id % 3 <> 0 OR n IS NULL THEN 'kept' WHEN doc_id % 4 = 0 THEN 'refused' ELSE 'replaced' END AS outcome, CASE WHEN doc_id % 3 = 0 AND doc_id % 4 <> 0 AND n IS NOT NULL THEN 'ready' ELSE status END AS status, coalesce(n, 0) AS chunk_count, s AS signatures FROM docs LEFT JOIN (SELECT doc_id, count(*) AS n, string_agg(DISTINCT CASE WHEN doc_id % 3 = 0 AND doc_id % 4 <> 0 THEN 'sig-c' ELSE encoder_signature END, ',') AS s FROM chunks GROUP BY doc_id) USING (doc_id) UNION ALL SELECT -1, 'missing', NULL, 0, NULL"


@query("replace_chunks", with_tables(_REPLACED, "chunks", "docs"))
def replace_chunks(t: Tables):
    """New sets for every third document as one act; those of every fourth start at the wrong ordinal and are refused, and one is of a document that there
    is not. What counts is read back from the version that is current then."""
    store = versions.Versioned(t.spark, own_path(t.spark, "chunk-versions"))
    old = t.chunks().select("chunk_id", "doc_id", "ordinal", "text", "encoder_signature")
    store.replace(old)
    new = old.where("doc_id % 3 = 0").withColumn("ordinal", F.when(F.col("doc_id") % 4 == 0, F.col("ordinal") + 1).otherwise(F.col("ordinal"))).withColumn("encoder_signature", F.lit("sig-c"))
    lost = t.spark.createDataFrame([("x", -1, 0, "text", "sig-c")], new.schema)
    out = versions.replace_chunks(store, new.unionByName(lost), t.docs())
    signatures = store.read().groupBy("doc_id").agg(F.array_join(F.sort_array(F.collect_set("encoder_signature")), ",").alias("signatures"))
    return out.join(signatures, "doc_id", "left").select("doc_id", "outcome", "status", "chunk_count", "signatures")


@query("upsert_notes", with_tables("SELECT doc_id AS note_id, CASE WHEN doc_id % 7 <> 0 THEN 'kept' WHEN doc_id % 14 = 0 THEN 'refused' ELSE 'updated' END AS action, CASE WHEN doc_id % 7 = 0 AND doc_id % 14 <> 0 THEN 'new ' || title ELSE title END AS title FROM docs", "docs"))
def upsert_notes(t: Tables):
    old = t.docs().select(F.col("doc_id").alias("note_id"), "kb_id", "title")
    new = old.where("note_id % 7 = 0").select("note_id", F.when(F.col("note_id") % 14 == 0, "elsewhere").otherwise(F.col("kb_id")).alias("kb_id"), F.concat(F.lit("new "), "title").alias("title"))
    return library.upserted(old, new, ["kb_id"], ["title"], "note_id").select("note_id", "action", "title")


_LEFT = {
    "documents": "docs WHERE kb_id NOT IN ('src1', 'src2')",
    "chunks": "chunks WHERE kb_id NOT IN ('src1', 'src2')",
    "notes": "notes WHERE kb_id NOT IN ('src1', 'src2')",
    "conversations": "kb_conversations WHERE kb_id NOT IN ('src1', 'src2')",
    "messages": "messages WHERE conv_id % 20 NOT IN (1, 2)",
    "sources": "message_sources WHERE conv_id % 20 NOT IN (1, 2)",
}


@query("cascade_delete", with_tables(" UNION ALL ".join(f"SELECT '{k}' AS kind, count(*) AS n FROM {v}" for k, v in _LEFT.items()), "chunks", "docs", "notes", "kb_conversations", "messages", "message_sources"))
def cascade_delete(t: Tables):
    """What is left of each table when two knowledge bases are deleted."""
    gone = t.docs().select("kb_id").distinct().where("kb_id IN ('src1', 'src2')")
    conversations = t.kb_conversations()
    lost = conversations.join(gone, "kb_id", "left_semi").select("conv_id")
    left = {k: library.without(rows, gone, "kb_id") for k, rows in (("documents", t.docs()), ("notes", t.notes()), ("conversations", conversations))}
    chunks = t.chunks()
    left["chunks"] = library.without(chunks, chunks.select("doc_id").join(left["documents"].select("doc_id"), "doc_id", "left_anti"), "doc_id")
    left |= {"messages": library.without(t.messages(), lost, "conv_id"), "sources": library.without(t.message_sources(), lost, "conv_id")}
    out = None
    for kind, rows in left.items():
        n = rows.agg(F.count("*").alias("n")).select(F.lit(kind).alias("kind"), "n")
        out = n if out is None else out.unionByName(n)
    return out


# ---- citations and integrity

_SAME = "coalesce(c.text = s.text AND c.page = s.page, false)"
_VALID = f"v AS (SELECT s.conv_id, s.seq, s.position, s.chunk_id, {_SAME} AS unchanged, {_SAME} AND d.status = 'ready' AND c.kb_id = s.kb_id AND isfinite(s.score) AND trim(c.text) <> '' AS valid FROM (SELECT *, CASE WHEN conv_id % 8 = 0 THEN 'src0' ELSE 'src' || ((conv_id + position) % (SELECT count(*) FROM documents) % 20) END AS kb_id, CASE WHEN (conv_id + seq) % 9 = 0 AND position = 1 THEN 'NaN'::DOUBLE ELSE 0.5 END AS score FROM message_sources) s LEFT JOIN changed_chunks c ON c.chunk_id = s.chunk_id LEFT JOIN docs d ON d.doc_id = c.doc_id)"


def _cited(t: Tables):
    """Sources with the knowledge base of their conversation, which for every eighth is another, and scores, some of which are no numbers."""
    n = t.read("documents").agg(F.count("*")).scalar()
    kb = F.when(F.col("conv_id") % 8 == 0, "src0").otherwise(F.concat(F.lit("src"), ((F.col("conv_id") + F.col("position")) % n % 20).cast("string")))
    return t.message_sources().withColumn("kb_id", kb).withColumn("score", F.when(((F.col("conv_id") + F.col("seq")) % 9 == 0) & (F.col("position") == 1), float("nan")).otherwise(0.5))


@query("revoke_citations", with_tables(f"SELECT v.conv_id, v.seq, CASE WHEN bool_and(unchanged) THEN count(*) ELSE 0 END AS n_sources, NOT bool_and(unchanged) AS revoked, md5(any_value(m.content) || CASE WHEN bool_and(unchanged) THEN '' ELSE '{library.CITATIONS_REVOKED}' END) AS h FROM v JOIN messages m ON m.conv_id = v.conv_id AND m.seq = v.seq GROUP BY v.conv_id, v.seq", "message_sources", "changed_chunks", "docs", "messages", extra=_VALID))
def revoke_citations(t: Tables):
    out = library.revoked(_cited(t), t.changed_chunks(), t.docs(), t.messages())
    return out.select("conv_id", "seq", "n_sources", "revoked", F.md5(F.col("content").cast("binary")).alias("h"))


@query("validate_citations", with_tables("SELECT conv_id, seq, bool_and(coalesce(valid, false)) AS valid FROM v GROUP BY ALL", "message_sources", "changed_chunks", "docs", extra=_VALID))
def validate_citations(t: Tables):
    return library.source_validity(_cited(t), t.changed_chunks(), t.docs()).groupBy("conv_id", "seq").agg(F.bool_and("valid").alias("valid"))


@query("recover_interrupted", with_tables("SELECT d.doc_id, CASE WHEN status = 'indexing' THEN 'failed' ELSE status END AS status, CASE WHEN status = 'indexing' THEN 'import was interrupted' END AS error_message, coalesce(c.n, 0) AS chunk_count FROM docs d LEFT JOIN (SELECT doc_id, count(*) AS n FROM changed_chunks GROUP BY doc_id) c ON c.doc_id = d.doc_id", "docs", "changed_chunks"))
def recover_interrupted(t: Tables):
    return library.recovered(t.docs(), t.changed_chunks())


@query("retry_targets", with_tables("SELECT doc_id, status = 'failed' AS retry FROM docs WHERE status <> 'indexing'", "docs"))
def retry_targets(t: Tables):
    return t.docs().where("status <> 'indexing'").select("doc_id", (F.col("status") == "failed").alias("retry"))


@query("changed_original", with_tables("SELECT doc_id, doc_id % 17 = 0 AS refused FROM docs", "docs"))
def changed_original(t: Tables):
    """Originals read again; every seventeenth has changed since."""
    now = t.read("documents").select("doc_id", F.sha2(F.when(F.col("doc_id") % 17 == 0, F.concat("text", F.lit("x"))).otherwise(F.col("text")), 256).alias("now"))
    return t.docs().select("doc_id", "content_hash").join(now, "doc_id").select("doc_id", (F.col("content_hash") != F.col("now")).alias("refused"))


@query("orphan_check", with_tables("SELECT 'source -> chunk' AS relation, s.chunk_id AS key FROM message_sources s WHERE NOT EXISTS (SELECT 1 FROM changed_chunks c WHERE c.chunk_id = s.chunk_id) UNION ALL SELECT 'label -> document', doc_id::VARCHAR FROM labels l WHERE NOT EXISTS (SELECT 1 FROM docs d WHERE d.doc_id = l.doc_id AND d.doc_id % 19 <> 0) UNION ALL SELECT 'chunk -> document', doc_id::VARCHAR FROM chunks c WHERE NOT EXISTS (SELECT 1 FROM docs d WHERE d.doc_id = c.doc_id AND d.doc_id % 29 <> 0) UNION ALL SELECT 'document -> kb', kb_id FROM docs WHERE kb_id = 'src3' UNION ALL SELECT 'source -> message', conv_id::VARCHAR FROM message_sources WHERE conv_id % 11 = 0 UNION ALL SELECT 'message -> conversation', conv_id::VARCHAR FROM messages WHERE conv_id % 13 = 0 UNION ALL SELECT 'conversation -> kb', kb_id FROM kb_conversations WHERE kb_id NOT IN (SELECT kb_id FROM docs WHERE kb_id <> 'src3') UNION ALL SELECT 'note -> kb', kb_id FROM notes WHERE kb_id = 'src3' UNION ALL SELECT 'source -> document', doc_id::VARCHAR FROM message_sources s JOIN chunks c USING (chunk_id) WHERE doc_id % 29 = 0 UNION ALL SELECT 'chunk -> kb', kb_id FROM chunks WHERE kb_id = 'src3'", "message_sources", "changed_chunks", "chunks", "docs", "messages", "kb_conversations", "notes"))
def orphan_check(t: Tables):
    """Chunks, documents, a knowledge base and messages that were deleted without what refers to them."""
    docs, sources = t.docs(), t.message_sources()
    kbs = docs.select("kb_id").distinct().where("kb_id <> 'src3'")
    return library.orphans({
        "source -> chunk": (sources, "chunk_id", t.changed_chunks(), "chunk_id"),
        "label -> document": (t.read("labels"), "doc_id", docs.where("doc_id % 19 <> 0"), "doc_id"),
        "chunk -> document": (t.chunks(), "doc_id", docs.where("doc_id % 29 <> 0"), "doc_id"),
        "document -> kb": (docs, "kb_id", kbs, "kb_id"),
        "chunk -> kb": (t.chunks(), "kb_id", kbs, "kb_id"),
        "conversation -> kb": (t.kb_conversations(), "kb_id", kbs, "kb_id"),
        "note -> kb": (t.notes(), "kb_id", kbs, "kb_id"),
        "message -> conversation": (t.messages(), "conv_id", t.kb_conversations().where("conv_id % 13 <> 0"), "conv_id"),
        "source -> message": (sources, "conv_id", t.messages().where("conv_id % 11 <> 0"), "conv_id"),
        "source -> document": (sources.join(t.chunks().select("chunk_id", "doc_id"), "chunk_id"), "doc_id", docs.where("doc_id % 29 <> 0"), "doc_id"),
    })


_BROKEN = "broken AS (SELECT chunk_id, doc_id, ordinal + CASE WHEN doc_id % 6 = 0 THEN 2 ELSE 0 END AS ordinal, CASE WHEN doc_id % 10 = 0 THEN 0 ELSE 1 END AS page, CASE WHEN doc_id % 15 = 0 THEN '  ' ELSE text END AS text, CASE WHEN doc_id % 14 = 0 THEN 32 ELSE dims END AS dims, encoder_signature || CASE WHEN doc_id % 23 = 0 THEN ordinal ELSE 0 END AS signature, embedding FROM chunks)"
_RULES = {"ordinals": "min(ordinal) <> 0 OR max(ordinal) <> count(*) - 1 OR count(DISTINCT ordinal) <> count(*)", "page": "min(page) <= 0", "blank text": "bool_or(trim(text) = '')", "dims": "bool_or(dims <> len(embedding))", "signatures": "count(DISTINCT signature) > 1"}


@query("audit_chunks", with_tables(" UNION ALL ".join(f"SELECT doc_id, '{k}' AS problem FROM broken GROUP BY doc_id HAVING {v}" for k, v in _RULES.items()), "chunks", extra=_BROKEN))
def audit_chunks(t: Tables):
    """Chunk sets with wrong ordinals, pages, blank texts, dimensions or signatures chosen by document id."""
    d = F.col("doc_id")
    broken = t.chunks(embedded=True).withColumn("encoder_signature", F.concat("encoder_signature", F.when(d % 23 == 0, F.col("ordinal")).otherwise(0).cast("string"))).withColumn("ordinal", F.when(d % 6 == 0, F.col("ordinal") + 2).otherwise(F.col("ordinal")))
    broken = broken.withColumn("page", F.when(d % 10 == 0, 0).otherwise(1)).withColumn("text", F.when(d % 15 == 0, "  ").otherwise(F.col("text"))).withColumn("dims", F.when(d % 14 == 0, 32).otherwise(F.col("dims")))
    return library.chunk_audit(broken, gates.vector_ok(F.col("embedding"), 64))


# ---- media timelines

_SEGS = """segs AS (SELECT asset_id, kind, k AS ordinal, round(CASE WHEN k = 0 THEN 0 WHEN short AND k = n - 1 THEN duration - 0.02 ELSE 10.0 * k END, 6)::DOUBLE AS start_s,
 round(CASE WHEN k = n - 1 THEN duration WHEN short AND k = n - 2 THEN duration - 0.02 ELSE 10.0 * (k + 1) END, 6)::DOUBLE AS end_s
 FROM (SELECT asset_id, kind, duration, n, n > 1 AND round(duration - 10 * (n - 1), 9) > 0 AND round(duration - 10 * (n - 1), 9) < 0.02 AS short, unnest(range(0, n)) AS k
 FROM (SELECT *, greatest(ceil(duration / 10.0), 1)::BIGINT AS n FROM assets WHERE duration > 0 AND (kind <> 'audio' OR duration >= 0.02))))"""


@query("plan_segments", with_tables("SELECT asset_id, kind, ordinal, start_s, end_s FROM segs", "assets", extra=_SEGS))
def plan_segments(t: Tables):
    return timeline.segments(t.assets())


@query("frame_times", with_tables("SELECT asset_id, ordinal, i, round(start_s + (end_s - start_s) * (i + 0.5) / c, 6) AS at_s FROM (SELECT *, unnest(range(0, c)) AS i FROM (SELECT *, greatest(1, least(8, ceil(round(end_s - start_s, 9))))::BIGINT AS c FROM segs WHERE kind = 'video'))", "assets", extra=_SEGS))
def frame_times(t: Tables):
    s = timeline.segments(t.assets()).where("kind = 'video'")
    return s.select("asset_id", "ordinal", F.posexplode(timeline.frame_times(F.col("start_s"), F.col("end_s"))).alias("i", "at_s")).withColumn("i", F.col("i").cast("long"))


@query("segment_overlap", with_tables("SELECT s.asset_id, s.ordinal, count(t.asset_id) AS n_tracks, count(t.asset_id) > 0 AS has_audio FROM segs s LEFT JOIN tracks t ON t.asset_id = s.asset_id AND t.start_s < s.end_s AND t.end_s > s.start_s AND t.end_s > t.start_s GROUP BY s.asset_id, s.ordinal", "assets", "tracks", extra=_SEGS))
def segment_overlap(t: Tables):
    return timeline.with_audio(timeline.segments(t.assets()), t.tracks()).select("asset_id", "ordinal", "n_tracks", "has_audio")


@query("image_frames", with_tables("SELECT clip_id, count(*) AS n_frames, min(frame) = 0 AND max(frame) = count(*) - 1 AND count(DISTINCT frame) = count(*) AS contiguous FROM frames WHERE NOT (clip_id % 9 = 0 AND frame = 1) GROUP BY clip_id", "frames"))
def image_frames(t: Tables):
    """Frames of each clip; every ninth clip lacks its second one."""
    return timeline.frame_gaps(t.frames().where("NOT (clip_id % 9 = 0 AND frame = 1)"))


@query("coverage_audit", with_tables("SELECT s.asset_id, NOT bool_or(s.asset_id % 8 = 0 AND n > 1) AS covered FROM (SELECT *, count(*) OVER (PARTITION BY asset_id) AS n FROM segs) s GROUP BY s.asset_id", "assets", extra=_SEGS))
def coverage_audit(t: Tables):
    """Planned segments; every eighth asset of more than one lacks its first."""
    s = timeline.segments(t.assets())
    n = s.groupBy("asset_id").agg(F.count("*").alias("n"))
    return timeline.coverage_audit(s.join(n, "asset_id").where("NOT (asset_id % 8 = 0 AND n > 1 AND ordinal = 0)"), t.assets())


@query("ocr_merge", "SELECT conv_id, coalesce(string_agg(t, chr(10) ORDER BY first), '') AS text, count(t) > 0 AS readable FROM (SELECT conv_id, CASE WHEN trim(role) <> '' THEN trim(role) END AS t, min(turn) AS first FROM conversations GROUP BY ALL) GROUP BY conv_id")
def ocr_merge(t: Tables):
    """Recognised texts that repeat: the role of each turn."""
    return timeline.merged_ocr(t.read("conversations"), "conv_id", "turn", "role")


@query("pixel_budget", with_tables("SELECT clip_id, frame, CAST(sum(width * height) OVER w AS BIGINT) AS pixels, sum(width * height) OVER w <= 200000 AND greatest(width, height) <= 480 AND width * height <= 100000 AS fits FROM frames WINDOW w AS (PARTITION BY clip_id ORDER BY frame ROWS UNBOUNDED PRECEDING)", "frames"))
def pixel_budget(t: Tables):
    return timeline.pixel_budget(t.frames(), 200_000, 480, 100_000)
