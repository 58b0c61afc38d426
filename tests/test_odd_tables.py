"""Queries against their SQL on small tables of odd rows that the given tables lack."""

import random

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from pyspark.sql import functions as F

from millrace import catalog
from millrace.operators import chunk, tags
from millrace.plans.views import Tables
from millrace.sources import ingest


def plain(x):
    return round(x, 5) if isinstance(x, float) else x


def same(spark, folder, name, **tables):
    """Asserts that a query gives what its SQL gives on the tables, and returns the rows."""
    con = duckdb.connect()
    for table, data in tables.items():
        pq.write_table(data, f"{folder}/{table}.parquet")
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    df = catalog.QUERIES[name](spark, str(folder))
    got = sorted((tuple(plain(r[c]) for c in sorted(df.columns)) for r in df.collect()), key=repr)
    want = con.execute(catalog.ORACLES[name])
    at = [[d[0] for d in want.description].index(c) for c in sorted(df.columns)]
    assert got == sorted((tuple(plain(r[i]) for i in at) for r in want.fetchall()), key=repr)
    return got


def test_ports_of_five_digits(spark, tmp_path):
    ids = [1, 4, 65_533, 65_536, 99_997, 100_000, 3, 6, 9, 2, 8]
    urls = ["http://localhost:65536" if i == 3 else None if i == 6 else "http://localhost\n" if i == 9 else "x" for i in ids]
    got = same(spark, tmp_path, "loopback_url", pages=pa.table({"page_id": pa.array(ids, pa.int64()), "url": pa.array(urls, pa.string())}))
    assert {r[0] for r in got} == {True, False, None}


def test_media_of_short_texts(spark, tmp_path):
    ids = list(range(27 * 4))
    texts = ["", "ab", None, "a whole text"]
    got = same(spark, tmp_path, "sniff_media", documents=pa.table({"doc_id": pa.array(ids, pa.int64()), "text": pa.array([texts[i // 27] for i in ids])}))
    assert [r[1] for r in got if r[0] % 27 == 16] == ["bmp"] * 4


def test_anchors_read_each_text_once(spark):
    texts = ["the c++ code, a.b", "then c+ 中文", "xa.by über", "", "a b  c++"]
    topics = [("a", "", ["the"]), ("b", "", ["C++", "über"]), ("c", "", ["a.b", "文"]), ("d", "", ["a b"])]
    rows = spark.createDataFrame([(i, f"k{i % 2}", t) for i, t in enumerate(texts)], "doc_id long, kb_id string, evidence string")
    own = spark.createDataFrame([("k1", "x", ["then"]), ("k1", "y", ["b"])], "kb_id string, label string, terms array<string>")
    out = tags.anchors(rows, topics, own)
    got = {(r.doc_id, r.label) for r in out.where("anchored").collect()}
    one = lambda *t: rows.select("doc_id", tags.anchored(list(t), F.col("evidence")).alias("x"), "kb_id").where("x").collect()
    assert got == {(r.doc_id, label) for label, _, t in topics for r in one(*t)} | {(r.doc_id, r0) for r0, t in (("x", "then"), ("y", "b")) for r in one(t) if r.kb_id == "k1"}
    assert out.count() == 5 * 4 + 2 * 2
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "RLIKE" not in plan.upper() and "Union" not in plan


def test_decoding_keeps_a_second_mark(spark):
    values = [b"\0\0\xfe\xff" * 2 + "a".encode("utf-32-be"), b"\xff\xfe\0\0" * 2 + "a".encode("utf-32-le"), b"\xed\xa0\x80", b"\xff", b"\xff\xfe\x00\xd8", None]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v binary")
    assert [r.t for r in df.select("i", ingest.decode_text(F.col("v")).alias("t")).orderBy("i").collect()] == ["\ufeffa", "\ufeffa", None, None, None, None]


def library(gap=False):
    """Forty documents of one knowledge base and a query; with ``gap`` not every chunk has a vector."""
    rng = np.random.default_rng(5)
    vectors = [i for i in range(70) if not gap or i % 3]
    words = ["the", "quay", "café", "of", "stone."]
    texts = [" ".join(rng.choice(words, size=400 if i % 4 == 0 else 5)) if i % 9 else "same " * 1040 for i in range(40)]
    return {
        "documents": pa.table({"doc_id": pa.array([20 * i for i in range(40)], pa.int64()), "text": texts, "lang": ["en"] * 40, "source": ["src0"] * 40, "n_chars": pa.array([len(t) for t in texts], pa.int64())}),
        "labels": pa.table({"doc_id": pa.array([20], pa.int64()), "quality": pa.array([1], pa.int32()), "toxic": pa.array([0], pa.int32())}),
        "embeddings": pa.table({"vec_id": pa.array(vectors, pa.int64()), "embedding": pa.array(rng.normal(size=(len(vectors), 64)).tolist(), pa.list_(pa.float32())), "label": pa.array([0] * len(vectors), pa.int32())}),
        "benchmark": pa.table({"item_id": pa.array([20, 40], pa.int64()), "text": ["the quay", "stone café of"]}),
    }


@pytest.mark.parametrize("name, least", [("lexical_score", 100), ("hybrid_score", 80), ("search_dedupe", 60)])
def test_all_pairs_are_told(spark, tmp_path, name, least):
    assert len(same(spark, tmp_path, name, **library())) >= least


def test_vectors_with_gaps(spark, tmp_path):
    assert same(spark, tmp_path, "search_topk", **library(gap=True))


def test_texts_stay_where_they_are_cut(spark, tmp_path):
    for table, data in library().items():
        pq.write_table(data, f"{tmp_path}/{table}.parquet")
    t = Tables(spark, str(tmp_path))
    for df in (t._cut_chunks(), t.ready_chunks(), t.titled_chunks()):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "Join" not in plan and "Exchange hashpartitioning" not in plan
    assert "text#" not in t.ready_vectors()._jdf.queryExecution().executedPlan().toString()


def test_slices_are_windows_of_graphemes(monkeypatch):
    rng = random.Random(4)
    pieces = ["a", "é", "ß", ".", "\n", " ", "\u00ad", "©", "…", "。", "中", "！", "\x00", "\x85"]
    texts = ["".join(rng.choices(pieces, k=rng.randrange(400))) for _ in range(200)] + ["", " " * 90, "a" * 500]
    sizes = [(rng.randrange(1, 90), rng.randrange(100)) for _ in texts]
    assert all(chunk.SINGLE.fullmatch(t) for t in texts) and not any(map(chunk.SINGLE.fullmatch, ["\r", "e\u0301", "か\u3099", "\U0001f468\u200d"]))
    got = [chunk.cut(t, *s) for t, s in zip(texts, sizes)]
    monkeypatch.setattr(chunk, "SINGLE", chunk.re.compile("(?!)"))
    assert got == [chunk.cut(t, *s) for t, s in zip(texts, sizes)]
