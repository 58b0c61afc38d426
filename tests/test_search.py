"""Search in blocks, media-aware ranking, topics of each library, tables of one query only."""

import random
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace import tables
from millrace.functions import vectors
from millrace.operators import search, tags

CHUNKS = "kb_id string, chunk_id string, doc_id long, text string, embedding array<float>, title string"


def corpus(rng, n, dims=8):
    words = ["alpha", "beta", "gam", "gamma", "delta", "ta", "é", "中文"]
    rows = []
    for i in range(n):
        v = [rng.choice([-1.0, 0.0, 0.5, 1.0]) for _ in range(dims - (i % 11 == 0))]
        rows.append((f"kb{i % 2 if i % 5 else 0}", f"c{i:04d}", i // 6, " ".join(rng.choices(words, k=rng.randrange(4))), None if i % 13 == 0 else v, f"Title {i // 6}"))
    return rows


def plain_cosine(a, b):
    if not a or not b or len(a) != len(b):
        return 0.0
    na, nb = np.linalg.norm(a), np.linalg.norm(b)
    return float(np.dot(a, b) / (na * nb)) if na and nb else 0.0


@pytest.mark.parametrize("block", [5, 64, 8192])
def test_blocks_give_what_all_pairs_give(spark, block):
    rng = random.Random(block)
    rows = corpus(rng, 150)
    queries = [(i, f"kb{i % 3}", rng.choice(["alpha gamma", "ta, BETA!", "", "中文é"]), [rng.choice([-1.0, 0.0, 1.0]) for _ in range(8)]) for i in range(40)]
    q = spark.createDataFrame(queries, "query_id long, kb_id string, text string, embedding array<float>")
    c = spark.createDataFrame(rows, CHUNKS)
    hits = search.deduplicated(search.scored(q, c, 4, block=block), "query_id")
    got = {}
    for r in search.ranked(hits, 4, "query_id").collect():
        got.setdefault(r.query_id, []).append((r.rank, r.chunk_id, r.score))
    terms = {r.query_id: r.t for r in q.select("query_id", search.lexical_terms(F.col("text")).alias("t")).collect()}
    for i, kb, _, v in queries:
        scores = []
        for k, cid, doc, text, e, title in rows:
            if k == kb:
                body = (title + "\n" + text).lower()
                share = sum(t in body for t in terms[i]) / len(terms[i]) if terms[i] else 0.0
                scores.append((-round(plain_cosine(v, e) + 0.08 * share, 6), cid, (doc, text)))
        seen, want = set(), []
        for s, cid, key in sorted(scores):
            if key not in seen and len(want) < 4:
                seen.add(key)
                want.append((len(want) + 1, cid, pytest.approx(-s, abs=2e-6)))
        assert sorted(got.get(i, [])) == want


def test_each_vector_is_compared(spark):
    rng = np.random.default_rng(3)
    e = spark.createDataFrame([(i, rng.normal(size=4).round(2).tolist()) for i in range(70)], "vec_id long, embedding array<float>")
    q = e.where("vec_id < 7").withColumnRenamed("vec_id", "query_id")
    out = search.nearest(q, e, 3, block=16).collect()
    assert {r.compared for r in out} == {70} and len(out) == 21
    assert all(r.vec_id == r.query_id and r.cosine == 1.0 for r in out if r.rank == 1)


def test_media_hits_never_collapse(spark):
    rows = [("k", "a", 1, "label", [1.0, 0.0], "t"), ("k", "b", 1, "label", [1.0, 0.0], "t"), ("k", "c", 2, "same", [0.9, 0.1], "t"), ("k", "d", 2, "same", [0.9, 0.1], "t"), ("k", "e", 2, "label", [0.5, 0.5], "t")]
    c = spark.createDataFrame(rows, CHUNKS).withColumn("media", F.when(F.col("doc_id") == 1, "image")).withColumn("text_source", F.when(F.col("chunk_id") == "b", "ocr"))
    q = spark.createDataFrame([(1, "k", "label", [1.0, 0.0])], "query_id long, kb_id string, text string, embedding array<float>")
    hits = search.ranked(search.deduplicated(search.scored(q, c, 12), "query_id"), 12, "query_id").orderBy("rank").collect()
    # of media only text that was read from them counts: b, not a, has the term
    assert [(r.chunk_id, r.score) for r in hits] == [("b", 1.08), ("a", 1.0), ("c", pytest.approx(0.993884)), ("e", pytest.approx(0.787107))]


def test_media_spaces(spark):
    rows = [("k", 8, "s", None, None, None), ("k", 8, "s", "image", "m", "r"), ("k", 8, "s", "image", "m", "old"), ("k", 8, "s", "audio", None, "r"), ("k", 4, "s", None, None, None), ("l", 8, "s", None, None, None)]
    c = spark.createDataFrame(rows, "kb_id string, dims int, encoder_signature string, media string, media_signature string, recipe string")
    assert [tuple(r) for r in search.space_violations(c, 8, "s", "m", "r").collect()] == [("k", 1, 2)]
    assert [tuple(r) for r in search.space_violations(c, 8, "s").collect()] == [("k", 1, 3)]
    assert [tuple(r) for r in search.space_violations(c.drop("media"), 8, "s").collect()] == [("k", 1, 0)]


def test_many_queries_of_one_library(spark):
    """Queries stream: no term-by-query table, no query table in a task."""
    q = spark.range(3_000).select(F.col("id").alias("query_id"), F.lit("k").alias("kb_id"), F.concat_ws(" ", F.lit("common"), *(F.concat(F.lit(p), F.col("id").cast("string")) for p in "abcdefgh")).alias("text"), F.transform(F.sequence(F.lit(1), F.lit(768)), lambda x: F.sin(x * F.col("id")).cast("float")).alias("embedding"))
    c = spark.range(40).select(F.lit("k").alias("kb_id"), F.col("id").cast("string").alias("chunk_id"), F.col("id").alias("doc_id"), F.concat(F.lit("common b"), F.col("id").cast("string"), F.lit(" rest")).alias("text"), F.transform(F.sequence(F.lit(1), F.lit(768)), lambda x: F.cos(x * F.col("id")).cast("float")).alias("embedding"), F.lit("t").alias("title"))
    out = search.scored(q, c, 2, semantic=0.0, lexical=1.0)
    top = out.groupBy("query_id").agg(F.max_by("chunk_id", "score").alias("c"), F.sum("compared").alias("n")).where("query_id BETWEEN 10 AND 39")
    assert all(r.c == str(r.query_id) and r.n == 40 for r in top.collect()) and out.select("query_id").distinct().count() == 3_000


def test_a_library_s_own_tag_wins(spark):
    docs = spark.createDataFrame([(1, "k", "t", ["harbour", "the"]), (2, "k", "t", ["harbour"]), (3, "l", "t", ["Harbour "])], "doc_id long, kb_id string, title string, tags array<string>")
    topics = spark.createDataFrame([(0, "Law", "courts", ["court"]), (1, "Harbour", "ships", ["ship"])], "position int, label string, description string, terms array<string>")
    own = tags.candidates(topics, tags.tag_frequency(docs))
    assert sorted((r.kb_id, r.label, r.source) for r in own.collect()) == [("k", "Harbour", "catalog"), ("k", "Law", "catalog"), ("k", "the", "library"), ("l", "Harbour", "catalog"), ("l", "Law", "catalog")]
    encoded = tags.encoded(own, vectors.hashing_encoder(16), "h")
    assert encoded.count() == 5 and {len(r.embedding) for r in encoded.collect()} == {16}
    the = encoded.where("label = 'the'").first().embedding
    other = [-x for x in the]
    chunks = spark.createDataFrame([(1, "k", 0, "on the quay", the), (1, "k", 1, "a court", the), (2, "k", 0, "they", other)], "doc_id long, kb_id string, ordinal int, text string, embedding array<float>")
    scored = tags.semantic(chunks, encoded, block=1)
    anchored = tags.anchors(tags.evidence(chunks, docs), [(r.label, r.description, r.terms) for r in topics.collect()], own.where("source = 'library'"))
    assert {(r.doc_id, r.label) for r in anchored.where("anchored").collect()} == {(1, "Law"), (1, "the")}
    assert [(r.label, r.position) for r in tags.select(scored.join(anchored, ["doc_id", "label"])).where("doc_id = 1").collect()][0] == ("the", 1)


def test_tag_patterns_take_any_characters(spark):
    df = spark.createDataFrame([(["c++"], "uses c++ here"), (["a\\Eb"], "x a\\Eb y"), (["en"], "then"), (["中"], "x中y")], "terms array<string>, text string")
    assert [r[0] for r in df.select(tags._anchored_by(F.col("terms"), F.col("text"))).collect()] == [True, True, False, True]


def test_tables_of_one_query_go_with_it(spark):
    root = tables.shared_dir(spark)
    exists = lambda path: spark._jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark._jsc.hadoopConfiguration()).exists(spark._jvm.org.apache.hadoop.fs.Path(path))
    paths = []

    def make(n):
        first = tables.written(spark.range(n), f"first{n}")
        inner = tables.only_rows(spark, lambda: tables.written(first, "inner").where("id > 0"), "inner-rows")
        paths.extend(p for p in (tables._scope.get() or []))
        return inner.where("id < 50")

    def run(n):
        return tables.only_rows(spark, lambda: make(n), f"rows{n}").count()

    with ThreadPoolExecutor(2) as pool:
        assert list(pool.map(run, [10, 100])) == [9, 49]
    assert len(paths) == 4 and all(p.startswith(root) and not exists(p) for p in paths)
    with pytest.raises(ZeroDivisionError):
        tables.only_rows(spark, lambda: (make(5), 1 / 0), "x")
    assert not any(map(exists, paths))
    assert tables.only_rows(spark, lambda: spark.range(3), "none").count() == 3
