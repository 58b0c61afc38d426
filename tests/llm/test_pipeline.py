"""The stages on a small corpus with planted junk, boilerplate, copies and leaks."""

import random

import corpus_pipeline
from millrace.llm import simhash
from millrace.llm._common import DOCUMENT_COLUMNS

WORDS = "the of and to in is river stone house garden morning letter wrote walked bright small near old quiet village bridge music winter summer field horse".split()
ITEM = "a careful reader counts every lantern along the harbour wall before the evening tide returns to cover the lower steps again"


def prose(rnd, n=150):
    return " ".join(rnd.choice(WORDS) + ("." if k % 12 == 11 else "") for k in range(n))


def corpus():
    rnd = random.Random(8)
    texts = {i: prose(rnd) + f"\n{prose(rnd, 40)}" for i in range(60)}
    texts[60] = texts[3]
    texts[61] = texts[3]
    texts[62] = "JUNK!! " * 100
    texts[63] = texts[10] + "\n" + ITEM
    texts[64] = None
    texts[65] = "too short"
    for i in range(20, 30):
        texts[i] += "\nSubscribe to our weekly letter about bridges and rivers"
    return texts


def test_stages(spark, tmp_path):
    texts = corpus()
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in texts.items()], "doc_id long, text string, lang string, source string, n_chars long")
    spark.createDataFrame([(0, ITEM)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    ids = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, str(tmp_path))
        if name != "encoding":
            assert docs.columns == DOCUMENT_COLUMNS
        path = f"{tmp_path}/{name}"
        docs.write.parquet(path)
        docs = spark.read.parquet(path)
        rows = docs.collect()
        ids[name] = {r.doc_id for r in rows}
        assert len(rows) == len(ids[name])
        if name == "line_dedup":
            assert not any("Subscribe" in r.text for r in rows) and all(r.n_chars == len(r.text) for r in rows)
    assert ids["quality_rules"] == set(range(64)) - {62}
    assert ids["line_dedup"] == ids["quality_rules"]
    assert ids["near_dedup"] == ids["line_dedup"] - {60, 61} - ({63} if 63 not in ids["near_dedup"] else set())
    assert ids["decontamination"] == ids["near_dedup"] - {63} == ids["encoding"]
    assert {r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect()} == ids["encoding"]


def test_one_of_each_group(spark):
    rows = [(3, "a b c d", "x"), (2, "a b c d", "x"), (2, "a b c d", "y"), (2, "other words are here", "x"), (None, "lone one here", "x"), (None, "lone one here", "z"), (None, "a b c d", "x"), (7, None, "x"), (8, None, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, h string")
    out = simhash.one_of_each_group(df, simhash.similar_documents(df))
    assert out.columns == df.columns
    got = sorted(((r.doc_id, r.text) for r in out.collect()), key=str)
    assert [x for x in got if x[0] == 7] == [(7, None)] and not [x for x in got if x[0] in (3, 8)]
    assert len([x for x in got if x[0] is None]) == 1 and 1 <= len([x for x in got if x[0] == 2]) <= 2
    assert simhash.one_of_each_group(df.limit(0), simhash.similar_documents(df.limit(0))).count() == 0


def test_quality_stage_takes_nulls(spark):
    df = spark.createDataFrame([(None, None, None, None, None), (1, None, "en", "s", 0)], "doc_id long, text string, lang string, source string, n_chars long")
    assert corpus_pipeline.quality_rules(spark, df, "").count() == 0
    assert corpus_pipeline.line_dedup(spark, df, "").count() == 2


def test_two_runs_at_once(spark, tmp_path):
    """Each run deletes its own tables only."""
    from concurrent.futures import ThreadPoolExecutor

    texts = corpus()
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in texts.items()], "doc_id long, text string, lang string, source string, n_chars long")
    for k in (0, 1):
        spark.createDataFrame([(0, ITEM)], "item_id long, text string").write.parquet(f"{tmp_path}/{k}/benchmark.parquet")
        docs.where(f"doc_id % 2 = {k} OR doc_id > 40").write.parquet(f"{tmp_path}/{k}/documents.parquet")
    run = lambda k: {r.doc_id for r in corpus_pipeline.run(spark, f"{tmp_path}/{k}").collect()}
    alone = [run(k) for k in (0, 1)]
    with ThreadPoolExecutor(2) as pool:
        assert list(pool.map(run, (0, 1))) == alone
