import random

import numpy as np
import pytest
from millrace.llm import clusters as C
from millrace.llm import minhash as M
from millrace.llm import queries
from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, k1 string, component_id int, id string"


def words(rng, n):
    return [f"w{rng.randrange(10**6)}" for _ in range(n)]


def brute(rows, shingle=4, similarity=0.8):
    """(n, component, kept) by doc_id, from all pairs."""

    def grams(text):
        w = (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ\t\n\v\f\r", "abcdefghijklmnopqrstuvwxyz     ")).split(" ")
        w = [x for x in w if x]
        return {tuple(w[i : i + shingle]) for i in range(len(w) - shingle + 1)} if len(w) >= shingle else {tuple(w)} if w else set()

    sets = {d: grams(t) for d, t in rows}
    low = {d: d for d in sets}
    changed = True
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and len(sets[a] & sets[b]) >= similarity * len(sets[a] | sets[b]) - 1e-12]
    while changed:
        changed = False
        for a, b in links:
            m = min(low[a], low[b])
            changed |= low[a] != m or low[b] != m
            low[a] = low[b] = m
    return {d: (len(sets[d]), low[d], low[d] == d) for d in sets}


def found(df, **options):
    return {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in M.similar_sets(df, **options).collect()}


def test_signatures_estimate_similarity_of_small_and_large_sets():
    rng = np.random.default_rng(1)
    for size in (5, 20, 2000):
        same = []
        for _ in range(300):
            h = np.unique(rng.integers(0, 2**64, size, dtype=np.uint64))
            a, b = h, h[: len(h) * 4 // 5]
            same.append((M.signature(a) == M.signature(b)).mean())
        assert abs(np.mean(same) - 0.8) < 0.03, size
    one = M.signature(np.array([7], np.uint64))
    assert (one == 7).all()


def test_bands_catch_pairs_at_the_limit():
    rng = np.random.default_rng(2)
    for size in (5, 10, 100, 1000):
        for _ in range(400):
            h = np.unique(rng.integers(0, 2**64, size, dtype=np.uint64))
            part = np.sort(rng.choice(h, len(h) * 4 // 5, replace=False))
            assert (M.bands(M.signature(h)) == M.bands(M.signature(part))).any()


def test_every_bin_probes_all_bins():
    order = M.donors(64)
    assert all(sorted(row) == list(range(64)) for row in order.tolist())
    assert len({tuple(row) for row in order.tolist()}) == 64


def family(rng, base, copies, edits):
    out = []
    for _ in range(copies):
        own = list(base)
        for _ in range(rng.randrange(edits)):
            own[rng.randrange(len(own))] = f"x{rng.randrange(50)}"
        out.append(" ".join(own))
    return out


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    texts = []
    for size in (3, 4, 8, 60, 200):
        for _ in range(4):
            texts += family(rng, words(rng, size), 12, 2 + size // 12)
    texts += ["One two", "one\ttwo", "one two three", "", None, " \n", "a b c d", "A b\nc  d", "a b c d e"]
    rng.shuffle(texts)
    return [(3 * i + 1, t) for i, t in enumerate(texts)]


def test_components_equal_all_pairs(spark, rows):
    df = spark.createDataFrame([(d, t, "k", 1, "i") for d, t in rows], SCHEMA)
    want = brute(rows)
    assert found(df) == want
    assert any(not kept for _, _, kept in want.values()) and len({c for _, c, _ in want.values()}) > 30


def test_large_clusters_in_blocks_equal_all_pairs(spark):
    """Leaders, the main component and what stays apart, in blocks of a few texts."""
    rng = random.Random(4)
    base = words(rng, 80)
    texts = family(rng, base, 70, 9) + [" ".join(words(rng, 80)) for _ in range(5)]
    rows = list(enumerate(texts))
    df = spark.createDataFrame([(i, 0, t) for i, t in rows], "id long, cluster long, text string")
    df = df.withColumn("n", F.lit(0)).withColumn("n", F.udf(lambda t: len(C.text_hashes(t, 4)), "int")("text"))
    got = {r.id: r.component for r in C.within_clusters(df, 4, 0.8, block=600, leaders=3).collect()}
    want = {d: c for d, (_, c, _) in brute(rows).items()}
    assert {d: got.get(d, d) for d in want} == want
    assert len(set(want.values())) > 6


def test_nulls_repeats_and_empty_tables(spark):
    df = spark.createDataFrame([(5, "a b c d e"), (5, "a b c d e"), (None, "a b c d e"), (None, "q r s t"), (None, None), (7, ""), (7, None)], "doc_id long, text string")
    got = sorted((str(r.doc_id), r.n_shingles, str(r.component_id), r.kept) for r in M.similar_sets(df).collect())
    assert got == [("5", 2, "5", True), ("5", 2, "5", True), ("7", 0, "7", True), ("7", 0, "7", True), ("None", 0, "None", True), ("None", 1, "None", True), ("None", 2, "5", False)]
    assert M.similar_sets(df.limit(0)).count() == 0


def test_query_gives_the_contract_columns(spark):
    out = queries.QUERIES["op11_minhash"](spark, "/root/testdata/sf0.001")
    assert [(f.name, f.dataType.simpleString()) for f in out.schema] == [("doc_id", "bigint"), ("n_shingles", "bigint"), ("component_id", "bigint"), ("kept", "boolean")]
