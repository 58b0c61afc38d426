"""File listings, versions that change as one act, interval joins, checked encoder batches."""

import os
import random

import pytest
from pyspark.sql import functions as F

from millrace.functions import vectors
from millrace.operators import timeline, versions
from millrace.sources import listing


@pytest.fixture
def tree(tmp_path):
    root = tmp_path / "root"
    for name in ("a.txt", "b/c.txt", "b/.hidden.txt", ".dot/d.txt", "b/e/f/g.txt", "tool.app/inside.txt", "deep/Doc.RTFD/x", "b/é ü.txt"):
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(name)
    os.symlink(root / "a.txt", root / "link.txt")
    os.symlink(root / "b", root / "linked")
    os.symlink(root, root / "b" / "loop")
    os.mkfifo(root / "pipe")
    return root


def names(df, root):
    return [(r.path.removeprefix(f"{root}/"), r.length) for r in df.where("problem IS NULL").collect()]


def test_folders_are_listed_without_hidden_files_links_and_packages(spark, tree):
    want = [("a.txt", 5), ("b/c.txt", 7), ("b/e/f/g.txt", 11), ("b/é ü.txt", len("b/é ü.txt".encode()))]
    assert names(listing.files(spark, [str(tree)]), tree) == want
    assert names(listing.files(spark, [f"file://{tree}/", str(tree / "b"), str(tree / "b" / "c.txt")]), tree) == want


def test_chosen_paths(spark, tree):
    chosen = [str(tree / x) for x in ("b/.hidden.txt", "link.txt", "linked", "tool.app", "tool.app/inside.txt", ".dot", "pipe", "lost.txt")]
    out = listing.files(spark, spark.createDataFrame([(p, 1) for p in chosen], "path string, other int"))
    # hidden ones may be chosen, with what is in them; links and packages may not, a file in a package may
    assert names(out, tree) == [(".dot/d.txt", 10), ("b/.hidden.txt", 13), ("tool.app/inside.txt", 19)]
    assert [(r.path.removeprefix(f"{tree}/"), r.problem.split(":")[0]) for r in out.where("problem IS NOT NULL").collect()] == [("lost.txt", "FileNotFoundError"), ("pipe", "neither a file nor a folder")]
    assert listing.files(spark, []).count() == 0


def test_versions_change_as_one_act(spark, tmp_path):
    store = versions.Versioned(spark, f"file://{tmp_path}/store")
    with pytest.raises(FileNotFoundError):
        store.read()
    first = store.replace(spark.range(3))
    assert sorted(r.id for r in store.read().collect()) == [0, 1, 2]
    kept_open = store.read()
    bad = spark.range(8, numPartitions=4).select(F.when(F.col("id") < 6, F.col("id")).otherwise(F.raise_error(F.lit("killed halfway")).cast("long")).alias("id"))
    with pytest.raises(Exception, match="killed halfway"):
        store.replace(bad)
    with pytest.raises(versions.Refused) as e:
        store.replace(spark.range(30), lambda rows: rows.where("id > 3"))
    assert len(e.value.problems) == 20
    assert store.names() == [first] and sorted(r.id for r in store.read().collect()) == [0, 1, 2]
    second = store.replace(store.read().where("id > 0"))
    assert store.names() == [second, first] and kept_open.count() == 3
    third = store.replace(spark.range(1))
    folders = {f for f in os.listdir(tmp_path / "store") if not f.startswith(".")}
    assert folders == {"CURRENT", f"v-{second}", f"v-{third}"} and store.read().count() == 1


def test_a_pointer_that_cannot_move_leaves_the_version_before(spark, tmp_path, monkeypatch):
    store = versions.Versioned(spark, f"file://{tmp_path}/store")
    store.replace(spark.range(3))
    monkeypatch.setattr(store, "_point", lambda text: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        store.replace(spark.range(9))
    assert store.read().count() == 3 and len([f for f in os.listdir(tmp_path / "store") if f.startswith("v-")]) == 1


def test_chunk_sets_are_replaced_whole(spark, tmp_path):
    store = versions.Versioned(spark, f"file://{tmp_path}/chunks")
    schema = "chunk_id string, doc_id long, ordinal int, text string, encoder_signature string"
    store.replace(spark.createDataFrame([("a", 1, 0, "x", "s"), ("b", 1, 1, "y", "s"), ("c", 2, 0, "x", "s"), ("d", 3, 0, "z", "s")], schema))
    docs = spark.createDataFrame([(1, "failed"), (2, "indexing"), (3, "ready"), (4, "indexing"), (5, "failed")], "doc_id long, status string")
    new = [("e", 1, 0, "n", "t"), ("f", 2, 0, "n", "t"), ("g", 2, 2, "n", "t"), ("h", 4, 0, "n", "t"), ("i", 4, 1, "m", "t"), ("j", 9, 0, "n", "t")]
    out = versions.replace_chunks(store, spark.createDataFrame(new, schema), docs)
    assert sorted(map(tuple, out.collect())) == [(1, "replaced", "ready", 1), (2, "refused", "indexing", 1), (3, "kept", "ready", 1), (4, "replaced", "ready", 2), (5, "kept", "failed", 0), (9, "missing", None, 0)]
    assert sorted(r.chunk_id for r in store.read().collect()) == ["c", "d", "e", "h", "i"]


def test_overlaps_equal_all_pairs(spark):
    rng = random.Random(7)
    spans = [(a, i, 10.0 * i, 10.0 * i + rng.choice([10, 3, 0.5, 25])) for a in range(3) for i in range(25)]
    tracks = []
    for _ in range(300):
        start = rng.choice([rng.uniform(-20, 260), 10.0 * rng.randrange(26)])
        tracks.append((rng.randrange(4), start, start + rng.choice([0, 0.001, 10, 10, 31, 320, 10_240, 1e9, 1e13, -5])))
    s = spark.createDataFrame(spans, "asset_id long, ordinal int, start_s double, end_s double")
    t = spark.createDataFrame(tracks, "asset_id long, start_s double, end_s double")
    got = sorted((r.asset_id, r.ordinal, r.t_start, r.t_end) for r in timeline.overlaps(s, t, "asset_id").collect())
    assert got == sorted((a, i, b, e) for a, i, x, y in spans for k, b, e in tracks if k == a and b < y and e > x and e > b)
    heard = timeline.with_audio(s, t)
    assert heard.count() == 75 and heard.where("has_audio <> (n_tracks > 0)").count() == 0


def test_tracks_of_one_asset_are_spread(spark):
    """Join keys hold time bins: a hundred thousand tracks of one asset meet no more than a few spans each."""
    t = spark.range(100_000).select(F.lit(1).cast("long").alias("asset_id"), (F.col("id") * 3.0).alias("start_s"), (F.col("id") * 3.0 + 2).alias("end_s"))
    assets = spark.createDataFrame([(1, "video", 300_000.0)], "asset_id long, kind string, duration double")
    out = timeline.with_audio(timeline.segments(assets), t)
    sums = out.selectExpr("count(*) AS n", "sum(n_tracks) AS t", "max(n_tracks) AS m").first()
    assert (sums.n, sums.m) == (30_000, 4) and sums.t == sum(-(-(3 * i + 2) // 10) - 3 * i // 10 for i in range(100_000))


def encoder_of(faults):
    def build():
        def encode(texts):
            own = [[1.0, 0.0] for _ in texts]
            fault = next((f for t, f in faults.items() if t in texts), None)
            if fault == "raise":
                raise RuntimeError("down")
            if fault == "count":
                return vectors.Response(own + own[:1], "s")
            if fault == "nan":
                own[-1] = [float("nan"), 0.0]
            if fault == "dims":
                own[0] = [1.0]
            if fault == "none":
                own[0] = None
            if fault == "zero":
                own[0] = [0.0, 0.0]
            return vectors.Response(own, "other" if fault == "signature" else "s")

        return encode

    return build


def test_a_wrong_batch_is_refused_and_the_next_goes_on(spark):
    rows = [(i, f"t{i}" if i != 5 else None, i // 4) for i in range(34)]
    df = spark.createDataFrame(rows, "id long, text string, part long")
    faults = {"t0": "raise", "t4": "count", "t9": "nan", "t12": "dims", "t16": "none", "t20": "zero", "t24": "signature"}
    out = {r.id: r for r in vectors.embed_in_batches(df, "id", "text", encoder_of(faults), "s", 2, batch="part").collect()}
    problems = ["RuntimeError: down", "5 vectors for 4 texts", "vectors that are not finite", "vectors of 1, 2 dimensions", "vectors of 0, 2 dimensions", "vectors of length zero", "signature other", None, None]
    assert len(out) == 34 and [out[i].problem for i in range(34)] == [problems[i // 4] for i in range(34)]
    assert all((r.embedding is None) == (r.problem is not None) and r.batch == r.id // 4 and r['index'] == r.id % 4 for r in out.values())
    assert {r.encoder_signature for r in out.values()} == {None, "s"}


def test_batches_of_neighbours(spark):
    df = spark.range(50, numPartitions=3).select(F.col("id").cast("string").alias("id"), F.lit("x").alias("text"), F.lit(1).alias("k"))
    out = vectors.embed_in_batches(df, "id", "text", vectors.signed(vectors.hashing_encoder(4), "h"), "h", 4)
    counts = [r["count"] for r in out.groupBy("batch").count().collect()]
    assert sum(counts) == 50 and max(counts) == 8 and out.where("problem IS NOT NULL").count() == 0
    wrong = vectors.embed_in_batches(df, "id", "text", vectors.signed(vectors.hashing_encoder(4), "h"), "h", 5)
    assert {r.problem for r in wrong.collect()} == {"vectors of 4 dimensions"}
    assert vectors.embed_in_batches(df.limit(0), "id", "text", vectors.signed(vectors.hashing_encoder(4), "h"), "h").count() == 0
