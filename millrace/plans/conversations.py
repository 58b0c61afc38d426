"""Registered queries: conversations, citations, exports."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..catalog import query
from ..operators import rag, search
from .search import _SEARCH
from .views import Tables, with_tables


@query("history_window", with_tables("SELECT conv_id, seq, role, content FROM (SELECT conv_id, seq, role, content[1:1200] AS content, row_number() OVER (PARTITION BY conv_id ORDER BY seq DESC) AS r FROM messages) WHERE r <= 4 AND role IN ('user', 'assistant')", "messages"))
def history_window(t: Tables):
    return rag.history(t.messages())


@query("build_context", with_tables("SELECT t.query_id, md5(string_agg('<source index=\"' || t.rank || '\">' || chr(10) || d.title || ' · page ' || c.page || chr(10) || 'original text' || chr(10) || c.text || chr(10) || '</source>', chr(10) || chr(10) ORDER BY t.rank)) AS h FROM top t JOIN docs d ON d.doc_id = t.doc_id JOIN chunks c ON c.chunk_id = t.chunk_id GROUP BY t.query_id", "queries", "chunks", "docs", extra=_SEARCH))
def build_context(t: Tables):
    hits = search.with_text(search.search(t.queries(), t.ready_chunks(), None, vectors=t.ready_vectors()), t.chunks(), t.docs())
    return rag.context(hits).select("query_id", F.md5(F.col("context").cast("binary")).alias("h"))


@query("extract_citations", with_tables("SELECT conv_id, seq, i - 1 AS position, m[i] AS marker FROM (SELECT conv_id, seq, m, unnest(range(1, len(m) + 1)) AS i FROM (SELECT conv_id, seq, regexp_extract_all(content, '\\[([0-9]+)\\]', 1) AS m FROM answers))", "answers"))
def extract_citations(t: Tables):
    return rag.citations(t.answers()).withColumn("position", F.col("position").cast("long"))


@query("check_citations", with_tables("SELECT conv_id, seq, (seq + conv_id) % 5 IN (0, 1) AS ok FROM answers", "answers"))
def check_citations(t: Tables):
    return t.answers().select("conv_id", "seq", rag.citations_ok(F.col("content"), F.col("n_sources")).alias("ok"))


@query("pair_exchanges", with_tables("SELECT conv_id, seq, complete FROM (SELECT conv_id, seq, role, coalesce(lead(role) OVER (PARTITION BY conv_id ORDER BY seq) = 'assistant', false) AS complete FROM messages) WHERE role = 'user'", "messages"))
def pair_exchanges(t: Tables):
    return rag.exchanges(t.messages())


@query("conversation_title", with_tables("SELECT conv_id, trim(trim(content)[1:80]) AS title FROM messages QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY role <> 'user', seq) = 1", "messages"))
def conversation_title(t: Tables):
    return _titles(t)


def _titles(t: Tables):
    first = F.min_by("content", F.struct((F.col("role") != "user").alias("r"), "seq"))
    return t.messages().groupBy("conv_id").agg(first.alias("content")).select("conv_id", rag.conversation_title(F.col("content")).alias("title"))


@query("answer_context_check", with_tables("SELECT t.query_id, bool_and(c.doc_id IS NOT NULL) AS intact FROM top t LEFT JOIN changed_chunks c ON c.chunk_id = t.chunk_id GROUP BY t.query_id", "queries", "chunks", "docs", "changed_chunks", extra=_SEARCH))
def answer_context_check(t: Tables):
    hits = search.search(t.queries(), t.ready_chunks(), None, vectors=t.ready_vectors())
    still = t.changed_chunks().select("chunk_id", F.lit(True).alias("there"))
    return hits.join(still, "chunk_id", "left").groupBy("query_id").agg(F.bool_and(F.coalesce("there", F.lit(False))).alias("intact"))


@query("export_conversation_md", with_tables("""SELECT m.conv_id, md5('# ' || any_value(t.title) || chr(10) || chr(10) || 'Knowledge base: src' || (m.conv_id % 20) || chr(10) || chr(10) || string_agg('## ' || m.role || chr(10) || chr(10) || m.content || coalesce(chr(10) || chr(10) || '### Sources' || chr(10) || chr(10) || s.cited, ''), chr(10) || chr(10) ORDER BY m.seq) || chr(10)) AS h
 FROM messages m JOIN (SELECT conv_id, trim(trim(content)[1:80]) AS title FROM messages QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY role <> 'user', seq) = 1) t ON t.conv_id = m.conv_id
 LEFT JOIN (SELECT conv_id, seq, string_agg('[' || (position + 1) || '] ' || coalesce(d.title, 'Untitled') || ' · page ' || s.page || chr(10) || chr(10) || '> ' || replace(s.text, chr(10), chr(10) || '> '), chr(10) || chr(10) ORDER BY position) AS cited FROM message_sources s LEFT JOIN docs d ON d.doc_id = substring(s.chunk_id, 1, 8)::BIGINT AND d.doc_id % 6 <> 0 GROUP BY ALL) s ON s.conv_id = m.conv_id AND s.seq = m.seq GROUP BY m.conv_id""", "messages", "message_sources", "docs"))
def export_conversation_md(t: Tables):
    """With the name of the knowledge base and each source under its document's title and page; every sixth document is gone."""
    titles = t.docs().where("doc_id % 6 <> 0").select(F.col("doc_id").alias("d"), "title")
    sources = t.message_sources().join(titles, F.substring("chunk_id", 1, 8).cast("long") == F.col("d"), "left")
    label = F.concat(F.coalesce("title", F.lit("Untitled")), F.lit(" · page "), F.col("page").cast("string"))
    out = rag.conversation_markdown(t.messages(), _titles(t).join(t.kb_conversations().withColumnRenamed("kb_id", "kb_name"), "conv_id"), sources, label)
    return out.select("conv_id", F.md5(F.col("markdown").cast("binary")).alias("h"))


@query("export_note_md", "SELECT doc_id, regexp_replace(source || '/' || lang || ':' || doc_id, '[/\\\\:\\n\\r]', '-', 'g')[1:80] || '.md' AS file_name, md5('# ' || CASE WHEN doc_id % 4 = 0 THEN 'Untitled note' ELSE source END || chr(10) || chr(10) || text || chr(10)) AS h FROM documents")
def export_note_md(t: Tables):
    name = F.concat("source", F.lit("/"), "lang", F.lit(":"), F.col("doc_id").cast("string"))
    title = F.when(F.col("doc_id") % 4 == 0, "  ").otherwise(F.col("source"))
    return t.read("documents").select("doc_id", rag.safe_file_name(name).alias("file_name"), F.md5(rag.note_markdown(title, F.col("text")).cast("binary")).alias("h"))
