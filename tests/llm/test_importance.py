import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from millrace.llm import importance as I
from millrace.llm import queries

HOSTILE = [None, "", " \n ", "One", "a b", "A  b-C", "ünï über x", "tab\tand\x85next\xa0word z", "x" * 3000 + " y", "1 2 3 4 1 2 3 4", "\x1c\x1d\x1e\x1f é", "日本 語 テスト", "\x7f a \x00 b"]


def features(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    return len(w), [" ".join(w[i : i + k]) for k in (1, 2, 3) for i in range(len(w) - k + 1)]


def brute(docs, target):
    bucket = lambda g: zlib.crc32(g.encode()) % 10_000
    s = Counter(bucket(g) for _, t in docs for g in features(t)[1])
    t = Counter(bucket(g) for x in target for g in features(x)[1])
    all_s, all_t = s.total(), t.total()
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (all_s + 10000) / ((s[b] + 1) * (all_t + 10000))))
    out = {}
    for d, text in docs:
        n, f = features(text)
        weight = sum(gain(bucket(g)) for g in f)
        h = int(hashlib.sha256(f"42:{d}".encode()).hexdigest()[:8], 16)
        out[d] = [len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, n]
    open_ = sorted((d for d in out if out[d][4] >= 20), key=lambda d: (-out[d][2], d))
    for k, d in enumerate(open_[: len(open_) * 5 // 100]):
        out[d][3] = k + 1
    return {d: tuple(v[:4]) for d, v in out.items()}


def result(df):
    return {r.doc_id: (r.n_features, r.weight, r.score, r.rank) for r in df.collect()}


def test_composed_crcs_are_those_of_the_strings():
    rng = random.Random(1)
    texts = HOSTILE + [" ".join(rng.choice(["The", "cat", "ünd", "x" * rng.randrange(1, 90)]) for _ in range(rng.randrange(40))) for _ in range(50)]
    payloads, counts, words = I.words_found([(t or "").encode().translate(I.SCANNED) for t in texts])
    got = [Counter() for _ in texts]
    for crc, of in I.runs(payloads, counts, words):
        for c, k in zip(crc.tolist(), of.tolist()):
            got[k][c] += 1
    assert [Counter(zlib.crc32(g.encode()) for g in features(t)[1]) for t in texts] == got
    assert counts.tolist() == [features(t)[0] for t in texts]


@pytest.mark.parametrize("n", [0, 1, 2, 5, 64, 1001])
def test_zero_byte_tables(n):
    a, b = b"some words", bytes(range(1, n + 1)) if n < 250 else b"z" * n
    shifted = I.shifted(np.array([zlib.crc32(a)], np.uint32), I.zero_bytes(n)[None], np.zeros(1, np.int64))
    assert int(shifted[0]) ^ zlib.crc32(b) == zlib.crc32(a + b)


def test_resample_equals_brute_force(spark):
    rng = random.Random(2)
    vocabulary = [f"w{k}" for k in range(300)]
    docs = list(enumerate(HOSTILE + [" ".join(rng.choices(vocabulary[k % 5 :: 5] + vocabulary[:9], k=rng.randrange(60))) for k in range(260)]))
    target = [" ".join(rng.choices(vocabulary[::5], k=30)) for _ in range(6)] + [None]
    got = result(I.resample(spark.createDataFrame([(d, t, "x") for d, t in docs], "doc_id long, text string, score string"), spark.createDataFrame([(t,) for t in target], "text string")))
    assert got == brute(docs, target)
    assert sum(r[3] is not None for r in got.values()) > 5


def test_small_batches_give_the_same(spark, monkeypatch):
    texts = [(t or "").encode().translate(I.SCANNED) for t in HOSTILE]
    whole = I.words_found(texts)
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array(range(len(HOSTILE))), pa.array(HOSTILE)], names=["doc_id", "text"])
    parts = list(I.texts_in([batch], limit=10))
    assert len(parts) > 3 and [d for b, _ in parts for d in b.column("doc_id").to_pylist()] == list(range(len(HOSTILE)))
    assert [t for _, own in parts for t in own] == texts
    assert np.concatenate([I.words_found(own)[1] for _, own in parts]).tolist() == whole[1].tolist()


def test_nulls_repeats_and_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a " * 25), (1, "a " * 25), (None, "b " * 30), (2, None)], "doc_id long, text string")
    none = spark.createDataFrame([], "text string")
    out = I.resample(docs, none, percent=50)
    rows = sorted(((str(r.doc_id), r.n_features, r.weight, r.rank) for r in out.collect()), key=str)
    assert [r[:2] for r in rows] == [("1", 72), ("1", 72), ("2", 0), ("None", 87)]
    assert rows[2][2:] == (0, None) and sum(r[3] is not None for r in rows) == 1
    assert I.resample(docs.limit(0), none).count() == 0


def test_query_gives_the_contract_columns(spark):
    out = queries.QUERIES["op12_importance_resample"](spark, "/root/testdata/sf0.001")
    assert [(f.name, f.dataType.simpleString()) for f in out.schema] == [(c, "bigint") for c in ("doc_id", "n_features", "weight", "score", "rank")]
