import zlib

from millrace.llm import sharding as S


def check(spark, rows, shards):
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, shard string, slot long")
    out = S.interleave(df, shards).collect()
    n = len(rows)
    assert sorted(r.position for r in out) == list(range(n))
    sizes = {}
    for r in out:
        sizes.setdefault(r.shard, []).append(r)
        assert r.shard == r.position * shards // n
    assert max(map(len, sizes.values())) - min([len(sizes.get(s, [])) for s in range(shards)]) <= 1
    for s, rs in sizes.items():
        assert sorted(r.slot for r in rs) == list(range(len(rs)))
    want = sorted((d is None, d or 0, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for d, t, *_ in rows)
    assert sorted((r.doc_id is None, r.doc_id or 0, r.size, r.text_crc32) for r in out) == want
    return out


def test_mixture(spark):
    rows = [(i, f"text {i}", "hot" if i % 3 == 0 else f"s{i % 7}", "", 0) for i in range(2000)]
    out = check(spark, rows, 10)
    of = {}
    for r in out:
        of.setdefault(r.source, {}).setdefault(r.shard, []).append(r)
    for source, by in of.items():
        n = sum(map(len, by.values()))
        assert all(abs(len(by.get(s, [])) - n / 10) <= 2 for s in range(10)), source
    again = {(r.doc_id, r.shard, r.slot) for r in S.interleave(spark.createDataFrame(rows, "doc_id long, text string, source string, shard string, slot long").repartition(7), 10).collect()}
    assert again == {(r.doc_id, r.shard, r.slot) for r in out}
    assert {(r.doc_id, r.shard) for r in S.interleave(spark.createDataFrame(rows, "doc_id long, text string, source string, shard string, slot long"), 10, seed=1).collect()} != {(r.doc_id, r.shard) for r in out}


def test_order_is_the_method(spark):
    """Positions follow fractional ranks of the seeded order, computed here row by row."""
    rows = [(i, f"t{i}", "a" if i < 30 else "b", "", 0) for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, shard string, slot long")
    draws = {r.doc_id: r.d for r in df.selectExpr("doc_id", f"xxhash64({S.SEED}, doc_id, crc32(cast(text as binary))) d").collect()}
    share = {}
    for s in "ab":
        own = sorted((draws[d], d) for d, _, x, *_ in rows if x == s)
        share |= {d: ((k + 0.5) / len(own), s, d) for k, (_, d) in enumerate(own)}
    want = {d: k for k, d in enumerate(sorted(share, key=share.get))}
    assert {r.doc_id: r.position for r in S.interleave(df, 4).collect()} == want


def test_awkward_rows(spark):
    rows = [(None, None, None, "x", 1), (None, None, None, "x", 1), (1, "", "a", None, None), (1, "", "a", None, None), (2, "é" * 50_000, "a", "", 0)]
    check(spark, rows, 2)
    check(spark, rows, 40)
    assert S.interleave(spark.createDataFrame([], "doc_id long, text string, source string")).count() == 0
    out = S.shard_documents(spark.createDataFrame([(1, "a", "s")], "doc_id long, text string, source string")).collect()
    assert [(r.doc_id, r.law, r.shard, r.slot, r.grown_shard) for r in out] == [(1, "rows", 0, 0, None)]
