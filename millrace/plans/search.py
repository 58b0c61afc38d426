"""Registered queries: vectors, hybrid search, topic tags."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..catalog import query
from ..functions import text, vectors
from ..operators import search, tags
from ..sources import ingest
from ..tables import ranked, written
from .views import Tables, with_tables

# ---- vectors


@query("role_prefix", with_tables("SELECT doc_id AS id, 'document: ' || title AS input FROM docs UNION ALL SELECT -1 - query_id, 'query: ' || text FROM queries", "docs", "queries"))
def role_prefix(t: Tables):
    rows = t.docs().select(F.col("doc_id").alias("id"), F.lit("document").alias("role"), F.col("title").alias("t")).unionByName(t.queries().select((-1 - F.col("query_id")).alias("id"), F.lit("query").alias("role"), F.col("text").alias("t")))
    return rows.select("id", vectors.role_prefix(F.col("role"), F.col("t")).alias("input"))


@query("embed_batches", with_tables("SELECT chunk_id, ordinal // 8 AS batch, ordinal % 8 AS index, CASE WHEN doc_id % 37 <> 0 THEN 'hashing-64' END AS encoder_signature, CASE WHEN doc_id % 37 <> 0 THEN 64 ELSE 0 END AS dims, doc_id % 37 <> 0 AS unit, CASE WHEN doc_id % 37 = 0 THEN 'signature other' END AS problem FROM chunks", "chunks"))
def embed_batches(t: Tables):
    """Every whole chunk encoded by the stand-in encoder, eight of a document at once; batches of every thirty-seventh document come back under another
    signature and are refused."""
    from ..functions import gates

    def encoder():
        encode = vectors.hashing_encoder(64)()
        return lambda texts: vectors.Response(encode(x.split("\x00", 1)[1] for x in texts), "other" if int(texts[0].split("\x00", 1)[0]) % 37 == 0 else "hashing-64")

    c = t.chunks().withColumn("told", F.concat(F.col("doc_id").cast("string"), F.lit("\x00"), F.col("text"))).withColumn("of", F.col("doc_id") * 1_000_000 + F.floor(F.col("ordinal") / 8))
    out = vectors.embed_in_batches(c, "chunk_id", "told", encoder, "hashing-64", 64, batch="of")
    return out.select("chunk_id", (F.col("batch") % 1_000_000).alias("batch"), F.col("index").cast("long").alias("index"), "encoder_signature", F.coalesce(F.when(F.col("embedding").isNotNull(), F.size("embedding")), F.lit(0)).alias("dims"), F.coalesce(F.when(F.col("embedding").isNotNull(), gates.unit_norm_ok(F.col("embedding"), 1e-3)), F.lit(False)).alias("unit"), "problem")


@query("truncate_dims", "SELECT vec_id, k, i, round(e[i] / sqrt(list_sum(list_transform(e[1:k], lambda x: x * x))), 6) AS x FROM (SELECT vec_id, embedding::DOUBLE[] AS e, k, unnest(range(1, k + 1)) AS i FROM embeddings CROSS JOIN (SELECT unnest([8, 16, 32]) AS k))")
def truncate_dims(t: Tables):
    e = t.read("embeddings")
    out = None
    for k in (8, 16, 32):
        rows = e.select("vec_id", F.lit(k).alias("k"), F.posexplode(vectors.truncated(F.col("embedding"), k)).alias("i", "x")).select("vec_id", "k", (F.col("i") + 1).cast("long").alias("i"), F.round("x", 6).alias("x"))
        out = rows if out is None else out.unionByName(rows)
    return out


_NEAREST = """WITH sims AS (SELECT q.query_id, e.vec_id, round(list_cosine_similarity(q.embedding::DOUBLE[], e.embedding::DOUBLE[]), 6) AS cosine FROM {q} q CROSS JOIN embeddings e)
 SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY cosine DESC, vec_id) AS rank, vec_id, cosine, count(*) OVER (PARTITION BY query_id) AS compared FROM sims QUALIFY rank <= 10"""


@query("cosine", _NEAREST.format(q="(SELECT item_id AS query_id, e.embedding FROM benchmark JOIN embeddings e ON e.vec_id = item_id % (SELECT count(*) FROM embeddings))"))
def cosine(t: Tables):
    """The ten nearest of all vectors for each query, and how many it was compared with."""
    return search.nearest(t.queries(), t.vectors(), 10).withColumn("rank", F.col("rank").cast("long"))


@query("encoder_identity", "SELECT source, sha256('{\"model\":[\"hashing\"],\"prefix\":[\"document: \"],\"revision\":[\"' || source || '\"]}') AS signature FROM (SELECT DISTINCT source FROM documents)")
def encoder_identity(t: Tables):
    fields = {"revision": F.col("source"), "model": F.lit("hashing"), "prefix": F.lit("document: ")}
    return t.read("documents").select("source").distinct().select("source", vectors.encoder_signature(fields).alias("signature"))


@query("vector_alignment", "SELECT a.vec_id, a.embedding = b.e AS equal, round(list_max(list_transform(range(1, 65), lambda i: abs(a.embedding[i]::DOUBLE - b.e[i]::DOUBLE))), 6) AS max_error FROM embeddings a JOIN (SELECT vec_id, CASE WHEN vec_id % 10 = 0 THEN list_transform(embedding, lambda x: (x * 0.5)::FLOAT) ELSE embedding END AS e FROM embeddings) b ON a.vec_id = b.vec_id")
def vector_alignment(t: Tables):
    """The vectors of one encoder against those of another, which halves every tenth."""
    a = t.read("embeddings").select("vec_id", "embedding")
    b = a.select("vec_id", F.when(F.col("vec_id") % 10 == 0, F.transform("embedding", lambda x: (x * 0.5).cast("float"))).otherwise(F.col("embedding")).alias("other"))
    error = F.array_max(F.zip_with("embedding", "other", lambda x, y: F.abs(x.cast("double") - y.cast("double"))))
    return a.join(b, "vec_id").select("vec_id", (F.col("embedding") == F.col("other")).alias("equal"), F.round(error, 6).alias("max_error"))


# ---- hybrid search

_TERMS = "list_slice(list_sort(list_distinct(list_filter(regexp_split_to_array(lower(q.text), '[\\s\\p{P}]+'), lambda w: w <> ''))), 1, 64)"
_COS = "list_cosine_similarity({a}::DOUBLE[], {b}::DOUBLE[])"
_SCORED = f"""scored AS (SELECT q.query_id, c.chunk_id, c.doc_id, c.text,
 round({_COS.format(a='q.embedding', b='c.embedding')} + 0.08 * CASE WHEN len({_TERMS}) > 0 THEN len(list_filter({_TERMS}, lambda w: contains(lower(d.title || chr(10) || c.text), w))) / len({_TERMS})::DOUBLE ELSE 0 END, 6) AS score
 FROM queries q JOIN chunks c ON c.kb_id = q.kb_id JOIN docs d ON d.doc_id = c.doc_id AND d.status = 'ready')"""
_DEDUP = "best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY query_id, doc_id, text ORDER BY score DESC, chunk_id) = 1)"
_TOP = "top AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank, chunk_id, doc_id, score FROM best QUALIFY rank <= 6)"
_SEARCH = f"{_SCORED}, {_DEDUP}, {_TOP}"


@query("search_topk", with_tables("SELECT * FROM top", "queries", "chunks", "docs", extra=_SEARCH))
def search_topk(t: Tables):
    return search.search(t.queries(), t.ready_chunks(), None, vectors=t.ready_vectors()).withColumn("rank", F.col("rank").cast("long"))


@query("lexical_terms", with_tables(f"SELECT q.query_id, array_to_string({_TERMS}, ' ') AS terms FROM queries q", "queries"))
def lexical_terms(t: Tables):
    return t.queries().select("query_id", F.array_join(text.lexical_terms(F.col("text")), " ").alias("terms"))


_LEXICAL = f"SELECT q.query_id, c.chunk_id, round(len(list_filter({_TERMS}, lambda w: contains(lower(d.title || chr(10) || c.text), w))) / len({_TERMS})::DOUBLE, 6) AS score FROM queries q JOIN chunks c ON c.kb_id = q.kb_id JOIN docs d ON d.doc_id = c.doc_id"


@query("lexical_score", with_tables(_LEXICAL, "queries", "chunks", "docs"))
def lexical_score(t: Tables):
    """Every query with every chunk of its knowledge base, whatever its document's status."""
    return search.scored(t.queries(), t.titled_chunks(), None, lexical=1.0, semantic=0.0, distinct=False).select("query_id", "chunk_id", "score")


@query("hybrid_score", with_tables("SELECT query_id, chunk_id, score FROM scored", "queries", "chunks", "docs", extra=_SCORED))
def hybrid_score(t: Tables):
    """Every query with every chunk of a ready document of its knowledge base."""
    return search.scored(t.queries(), t.ready_chunks(), None, distinct=False, vectors=t.ready_vectors()).select("query_id", "chunk_id", "score")


_MEDIA = "CASE WHEN c.doc_id % 5 = 0 THEN 'image' END"
_KINDS = _SCORED.replace("c.doc_id, c.text,", f"c.doc_id, {_MEDIA} AS media, c.text,").replace("contains(lower(d.title || chr(10) || c.text), w)", "contains(lower(d.title || CASE WHEN c.doc_id % 5 = 0 AND c.doc_id % 10 <> 0 THEN '' ELSE chr(10) || c.text END), w)")
_KEPT = "best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY query_id, doc_id, CASE WHEN media IS NULL THEN 'text ' || text ELSE chunk_id END ORDER BY score DESC, chunk_id) = 1)"


@query("search_dedupe", with_tables("SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank, chunk_id, media FROM best", "queries", "chunks", "docs", extra=f"{_KINDS}, {_KEPT}"))
def search_dedupe(t: Tables):
    """Every fifth document is a picture, every tenth with text that was read from it; hits in media never collapse. All hits, in their
    order: ranges of it are dealt out, no task sorts all hits of a query."""
    c = t.ready_chunks().withColumn("media", F.when(F.col("doc_id") % 5 == 0, "image")).withColumn("text_source", F.when(F.col("doc_id") % 10 == 0, "ocr"))
    hits = written(search.scored(t.queries(), c, None, vectors=t.ready_vectors()).select("query_id", "chunk_id", "doc_id", "score"), "all-hits")
    hits = ranked(hits, [F.asc("query_id"), F.desc("score"), F.asc("chunk_id")], "rank", "ranked-hits", group="query_id")
    return hits.select("query_id", (F.col("rank") + 1).alias("rank"), "chunk_id", F.when(F.col("doc_id") % 5 == 0, "image").alias("media"))


_READABLE = _SEARCH.replace("AND d.status = 'ready')", "AND d.status = 'ready' WHERE c.doc_id % 4 <> 0)")


@query("search_readable_only", with_tables("SELECT * FROM top", "queries", "chunks", "docs", extra=_READABLE))
def search_readable_only(t: Tables):
    """Rows without citable text (every fourth document) are left out before ranking."""
    return search.search(t.queries(), t.ready_chunks().where("doc_id % 4 <> 0"), None, vectors=t.ready_vectors()).withColumn("rank", F.col("rank").cast("long"))


_SEGMENTS = f"""scored AS (SELECT q.query_id, q.segment, c.chunk_id, c.doc_id, c.text, round({_COS.format(a='q.embedding', b='c.embedding')}, 6) AS score
 FROM query_segments q JOIN chunks c ON c.kb_id = q.kb_id JOIN docs d ON d.doc_id = c.doc_id AND d.status = 'ready'),
 best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY query_id, segment, doc_id, text ORDER BY score DESC, chunk_id) = 1),
 per AS (SELECT * FROM best QUALIFY row_number() OVER (PARTITION BY query_id, segment ORDER BY score DESC, chunk_id) <= 6),
 merged AS (SELECT query_id, chunk_id, doc_id, max(score) AS score FROM per GROUP BY ALL)"""


@query("search_multivector", with_tables("SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank, chunk_id, doc_id, score FROM merged QUALIFY rank <= 6", "query_segments", "chunks", "docs", extra=_SEGMENTS))
def search_multivector(t: Tables):
    return search.search_segments(t.query_segments(), t.ready_chunks(), None, vectors=t.ready_vectors()).withColumn("rank", F.col("rank").cast("long"))


_SPACES = """SELECT kb_id, count(*) FILTER (other) AS violations, count(*) FILTER (m) AS media_violations FROM (SELECT kb_id, dims <> 64 OR encoder_signature <> 'sig-a' AS other,
 doc_id % 5 = 0 AND (doc_id % 3 = 0 OR doc_id % 35 = 0) AS m FROM chunks) WHERE other OR m GROUP BY kb_id"""


@query("space_check", with_tables(_SPACES, "chunks"))
def space_check(t: Tables):
    """Media are those of ``search_dedupe``; some come from another encoder for media, some were cut by another recipe."""
    media = t.chunks().withColumn("media", F.when(F.col("doc_id") % 5 == 0, "image"))
    media = media.withColumn("media_signature", F.when(F.col("media").isNotNull(), F.when(F.col("doc_id") % 3 == 0, "m-2").otherwise("m-1"))).withColumn("recipe", F.when(F.col("doc_id") % 7 == 0, "r-0").otherwise("r-1"))
    return search.space_violations(media, 64, "sig-a", "m-1", "r-1")


@query("kb_isolation", with_tables("SELECT t.query_id, bool_and(c.kb_id = q.kb_id) AS isolated FROM top t JOIN chunks c ON c.chunk_id = t.chunk_id JOIN queries q ON q.query_id = t.query_id GROUP BY t.query_id", "queries", "chunks", "docs", extra=_SEARCH))
def kb_isolation(t: Tables):
    hits = search.search(t.queries(), t.ready_chunks(), None, vectors=t.ready_vectors()).join(t.chunks().select("chunk_id", F.col("kb_id").alias("c_kb")), "chunk_id").join(t.queries().select("query_id", "kb_id"), "query_id")
    return hits.groupBy("query_id").agg(F.bool_and(F.col("c_kb") == F.col("kb_id")).alias("isolated"))


@query("drop_stale_hits", with_tables("SELECT t.query_id, t.chunk_id FROM top t JOIN docs d ON d.doc_id = t.doc_id WHERE d.doc_id % 6 <> 0", "queries", "chunks", "docs", extra=_SEARCH))
def drop_stale_hits(t: Tables):
    return search.live_hits(search.search(t.queries(), t.ready_chunks(), None, vectors=t.ready_vectors()), t.docs().where("doc_id % 6 <> 0")).select("query_id", "chunk_id")


@query("untitled_default", with_tables("SELECT t.query_id, t.chunk_id, CASE WHEN d.doc_id % 6 <> 0 THEN d.title ELSE 'Untitled' END AS title FROM top t JOIN docs d ON d.doc_id = t.doc_id", "queries", "chunks", "docs", extra=_SEARCH))
def untitled_default(t: Tables):
    hits = search.search(t.queries(), t.ready_chunks(), None, vectors=t.ready_vectors())
    return search.with_text(hits, t.chunks(), t.docs().where("doc_id % 6 <> 0")).select("query_id", "chunk_id", "title")


@query("results_json", with_tables("SELECT t.query_id, t.rank, d.title || ' · page ' || c.page AS source, md5(c.text) AS text_md5, t.score, t.chunk_id, t.doc_id FROM top t JOIN docs d ON d.doc_id = t.doc_id JOIN chunks c ON c.chunk_id = t.chunk_id", "queries", "chunks", "docs", extra=_SEARCH))
def results_json(t: Tables):
    """Hits written as JSON and read back, so that both engines see the same fields."""
    hits = search.with_text(search.search(t.queries(), t.ready_chunks(), None, vectors=t.ready_vectors()), t.chunks(), t.docs())
    source = F.concat(F.col("title"), F.lit(" · page "), F.col("page").cast("string"))
    j = hits.select("query_id", "rank", F.to_json(F.struct(source.alias("source"), "text", "score", "chunk_id", F.col("doc_id").alias("document_id"))).alias("json"))
    f = F.from_json("json", "source string, text string, score double, chunk_id string, document_id long")
    return j.select("query_id", F.col("rank").cast("long").alias("rank"), f["source"].alias("source"), F.md5(f["text"].cast("binary")).alias("text_md5"), f["score"].alias("score"), f["chunk_id"].alias("chunk_id"), f["document_id"].alias("doc_id"))


# ---- topic tags

_CATALOG = "catalog AS (SELECT * FROM (VALUES " + ", ".join(f"({i}, '{a}', '{b}', [{', '.join(repr(x) for x in c)}])" for i, (a, b, c) in enumerate(tags.TOPICS)) + ") AS v(position, label, description, terms))"
_FREQ = "freq AS (SELECT kb_id, tag, count(*) AS n FROM (SELECT kb_id, unnest(tags) AS tag FROM docs) GROUP BY ALL)"


@query("tag_frequency", with_tables("SELECT * FROM freq", "docs", extra=_FREQ))
def tag_frequency(t: Tables):
    return tags.tag_frequency(t.docs())


@query("all_tags", with_tables("SELECT DISTINCT kb_id, tag FROM freq ORDER BY ALL", "docs", extra=_FREQ))
def all_tags(t: Tables):
    return tags.tag_frequency(t.docs()).select("kb_id", "tag").distinct().orderBy("kb_id", "tag")


_OWN = "SELECT kb_id, trim(tag) AS label, 'Documents about ' || trim(tag) AS description, [lower(trim(tag))] AS terms, 'library' AS source FROM freq WHERE trim(tag) <> '' AND length(trim(tag)) <= 32 AND lower(trim(tag)) NOT IN (SELECT lower(label) FROM catalog) QUALIFY row_number() OVER (PARTITION BY kb_id ORDER BY n DESC, tag) <= " + str(tags.MAX_CANDIDATES - len(tags.TOPICS))
_CANDIDATES = f"candidates AS (SELECT k.kb_id, label, description, terms, 'catalog' AS source, position::BIGINT AS key FROM catalog CROSS JOIN (SELECT DISTINCT kb_id FROM freq) k UNION ALL SELECT *, ('0x' || md5(label)[1:8])::BIGINT FROM ({_OWN}))"


def _candidates(t: Tables):
    return tags.candidates(tags.catalog(t.spark), tags.tag_frequency(t.docs()))


@query("tag_candidates", with_tables("SELECT kb_id, label, description, source FROM candidates", "docs", extra=f"{_CATALOG}, {_FREQ}, {_CANDIDATES}"))
def tag_candidates(t: Tables):
    return _candidates(t).select("kb_id", "label", "description", "source")


@query("candidate_prompt", with_tables("SELECT DISTINCT kb_id, 'query: ' || label || ': ' || description AS prompt FROM catalog CROSS JOIN (SELECT DISTINCT kb_id FROM docs)", "docs", extra=_CATALOG))
def candidate_prompt(t: Tables):
    kbs = t.docs().select("kb_id").distinct()
    return kbs.crossJoin(F.broadcast(tags.catalog(t.spark))).select("kb_id", vectors.role_prefix(F.lit("query"), tags.prompt(F.col("label"), F.col("description"))).alias("prompt"))


@query("sample_chunks", "SELECT source AS kb_id, doc_id FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS i, count(*) OVER (PARTITION BY source) AS n FROM documents) WHERE n <= 24 OR list_contains(list_transform(range(0, 24), lambda k: k * (n - 1) // 23), i)")
def sample_chunks(t: Tables):
    return tags.sample_evenly(t.read("documents").select(F.col("source").alias("kb_id"), "doc_id"), "kb_id", "doc_id", large=True)


_SAMPLED = "sampled AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY ordinal) - 1 AS i, count(*) OVER (PARTITION BY doc_id) AS n_chunks FROM chunks) WHERE n_chunks <= 24 OR list_contains(list_transform(range(0, 24), lambda k: k * (n_chunks - 1) // 23), i))"
_EVIDENCE = f"{_SAMPLED}, evidence AS (SELECT d.doc_id, lower(any_value(d.title) || chr(10) || string_agg(substring(c.text, 1, 4000), chr(10) ORDER BY c.ordinal)) AS evidence FROM docs d JOIN sampled c ON c.doc_id = d.doc_id GROUP BY d.doc_id)"


def _evidence(t: Tables):
    return tags.evidence(tags.sample_evenly(t.chunks().select("doc_id", "ordinal", "text"), "doc_id", "ordinal"), t.docs())


@query("tag_evidence", with_tables("SELECT doc_id, md5(evidence) AS h FROM evidence", "docs", "chunks", extra=_EVIDENCE))
def tag_evidence(t: Tables):
    return _evidence(t).select("doc_id", F.md5(F.col("evidence").cast("binary")).alias("h"))


_ANCHOR = "list_bool_or(list_transform(terms, lambda w: CASE WHEN regexp_matches(lower(w), '^[\\x00-\\x7F]+$') THEN regexp_matches(evidence, '(^|[^a-z0-9])' || lower(w) || '([^a-z0-9]|$)') ELSE contains(evidence, lower(w)) END))"


@query("tag_anchor", with_tables(f"SELECT e.doc_id, label, {_ANCHOR} AS anchored FROM evidence e JOIN docs d USING (doc_id) JOIN candidates k ON k.kb_id = d.kb_id", "docs", "chunks", extra=f"{_EVIDENCE}, {_CATALOG}, {_FREQ}, {_CANDIDATES}"))
def tag_anchor(t: Tables):
    """The topics and, for each document, its knowledge base's own tags."""
    return tags.anchors(_evidence(t), tags.TOPICS, _candidates(t).where("source = 'library'"))


_SIMS = f"""sims AS (SELECT c.doc_id, k.label, c.ordinal AS sample, round(0.5 + 0.5 * {_COS.format(a='c.embedding', b='v.embedding')}, 6) AS similarity
 FROM sampled c JOIN candidates k ON k.kb_id = c.kb_id JOIN embeddings v ON v.vec_id = k.key % (SELECT count(*) FROM embeddings)),
 semantic AS (SELECT doc_id, label, round(0.65 * max(similarity) + 0.35 * avg(similarity) FILTER (r <= greatest(1, ceil(n / 4.0))) + 1e-9, 6) AS semantic
 FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, label ORDER BY similarity DESC) AS r, count(*) OVER (PARTITION BY doc_id, label) AS n FROM sims) GROUP BY ALL)"""


def _semantic(t: Tables):
    """The vectors of each document's sampled chunks against those of the topics and own tags of its knowledge base."""
    sampled = tags.sample_evenly(t.chunks(embedded=True).select("doc_id", "kb_id", "ordinal", "embedding"), "doc_id", "ordinal")
    key = F.coalesce(F.col("position").cast("long"), F.conv(F.substring(F.md5(F.col("label").cast("binary")), 1, 8), 16, 10).cast("long"))
    return tags.semantic(sampled, t._embedded(_candidates(t), key))


@query("tag_semantic", with_tables("SELECT * FROM semantic", "chunks", "docs", extra=f"{_SAMPLED}, {_CATALOG}, {_FREQ}, {_CANDIDATES}, {_SIMS}"))
def tag_semantic(t: Tables):
    return _semantic(t)


_SELECT = f"""anchors AS (SELECT e.doc_id, label, {_ANCHOR} AS anchored FROM evidence e JOIN docs d USING (doc_id) JOIN candidates k ON k.kb_id = d.kb_id),
 ranked AS (SELECT s.doc_id, s.label, s.semantic, a.anchored, round(s.semantic + CASE WHEN anchored THEN 0.07 ELSE 0 END, 6) AS rank FROM semantic s JOIN anchors a ON a.doc_id = s.doc_id AND a.label = s.label),
 w AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY semantic, label) AS pos, count(*) OVER (PARTITION BY doc_id) AS n, round(max(semantic) OVER (PARTITION BY doc_id) - min(semantic) OVER (PARTITION BY doc_id), 6) AS spread, max(rank) OVER (PARTITION BY doc_id) AS best FROM ranked),
 m AS (SELECT *, max(CASE WHEN pos = n // 2 + 1 THEN semantic END) OVER (PARTITION BY doc_id) AS median FROM w),
 passed AS (SELECT * FROM m WHERE spread >= 0.015 AND semantic >= CASE WHEN anchored THEN 0.30 ELSE 0.48 END AND semantic >= round(median + CASE WHEN anchored THEN 0.05 ELSE 0.08 END, 6) AND rank >= round(best - 0.10, 6))"""


@query("tag_select", with_tables("SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY rank DESC, label) AS position, label, rank FROM passed QUALIFY position <= 5", "docs", "chunks", extra=f"{_EVIDENCE}, {_CATALOG}, {_FREQ}, {_CANDIDATES}, {_SIMS}, {_SELECT}"))
def tag_select(t: Tables):
    """Topics and own tags of the document's knowledge base, by meaning and by words."""
    anchored = tags.anchors(_evidence(t), tags.TOPICS, _candidates(t).where("source = 'library'"))
    return tags.select(_semantic(t).join(anchored, ["doc_id", "label"])).withColumn("position", F.col("position").cast("long"))


@query("tag_targets", with_tables("SELECT doc_id, row_number() OVER (PARTITION BY kb_id ORDER BY created_at, doc_id) AS position FROM docs WHERE status = 'ready' AND len(tags) = 0", "docs"))
def tag_targets(t: Tables):
    return ingest.in_order(tags.targets(t.docs()), F.asc("created_at"), F.asc("doc_id")).select("doc_id", "position")


@query("tag_apply", with_tables("SELECT doc_id, CASE WHEN status = 'ready' AND len(tags) = 0 AND doc_id % 9 <> 0 THEN 'written' ELSE 'stale' END AS outcome, 'topic,' || lang AS new_tags FROM docs WHERE doc_id % 2 = 0", "docs"))
def tag_apply(t: Tables):
    """Proposals for every other document; those for every ninth were read before a change."""
    d = t.docs()
    proposed = d.where("doc_id % 2 = 0").select("doc_id", F.when(F.col("doc_id") % 9 == 0, F.col("updated_at") - F.expr("INTERVAL 1 SECOND")).otherwise(F.col("updated_at")).alias("seen_at"), F.array(F.lit("topic"), "lang").alias("new_tags"))
    return tags.apply(d, proposed)


@query("normalize_tags", "SELECT doc_id, array_to_string(list_transform(list_slice(list_sort(list_distinct(list_filter(list_transform(regexp_split_to_array(text, '[.,]'), lambda x: trim(x)), lambda x: x <> ''))), 1, 12), lambda x: x[1:32]), '|') AS tags FROM documents")
def normalize_tags(t: Tables):
    return t.read("documents").select("doc_id", F.array_join(tags.normalized(F.split("text", "[.,]")), "|").alias("tags"))


@query("parse_tag_input", "SELECT doc_id, array_to_string(list_sort(list_distinct(list_filter(list_transform(regexp_split_to_array(text, '[,，、;；\\n]'), lambda x: trim(x)), lambda x: x <> ''))), '|') AS tags FROM documents")
def parse_tag_input(t: Tables):
    return t.read("documents").select("doc_id", F.array_join(tags.parsed_input(F.col("text")), "|").alias("tags"))
