import random
import re

import numpy as np
import xxhash

from millrace.llm import simhash as S


def brute_fingerprint(text, k=3):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not w:
        return 0
    grams = [" ".join(w[i : i + k]) for i in range(len(w) - k + 1)] or [" ".join(w)]
    hs = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute_components(fps):
    """fps: {rep: fingerprint}; smallest rep reachable over links of at most two differing bits."""
    reps = sorted(fps)
    root = {r: r for r in reps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(reps):
        for b in reps[i + 1 :]:
            if (fps[a] ^ fps[b]).bit_count() <= 2:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {r: find(r) for r in reps}


def clustered(rnd, n, centres, flips):
    out = set()
    while len(out) < n:
        x = rnd.choice(centres)
        for _ in range(rnd.randrange(flips)):
            x ^= 1 << rnd.randrange(64)
        out.add(x)
    return {i * 3 + 1: x for i, x in enumerate(out)}


def test_fingerprint_matches_brute_force():
    rnd = random.Random(3)
    texts = [None, "", " \t\n", "one", "One two", "a b c", "A\x0bB\x0cc\rD é É \xa0x", "x " * 500]
    texts += [" ".join(rnd.choice(["The", "cat", "sat", "ON", "ünd"]) for _ in range(rnd.randrange(60))) for _ in range(60)]
    for t in texts:
        assert S.fingerprint(t) == brute_fingerprint(t)


def test_long_text_in_steps():
    t = " ".join(str(i % 977) for i in range(140_000))
    assert S.fingerprint(t) == brute_fingerprint(t)


def test_tree_finds_all():
    rnd = random.Random(5)
    values = np.array(list(clustered(rnd, 3000, [rnd.getrandbits(64) for _ in range(20)], 6).values()), np.uint64)
    tree = S.GrayTree(values)
    q, at = tree.within(values, 2)
    got = {(int(values[i]), int(tree.values[j])) for i, j in zip(q, at)}
    want = {(int(a), int(b)) for a in values for b in values[np.bitwise_count(values ^ a) <= 2]}
    assert got == want


def test_masks_catch_every_pair():
    rnd = random.Random(6)
    for radius, (blocks, keep) in S.BLOCKS.items():
        for level in (1, 2, 3) if radius <= 2 else (1,):
            ms = S.masks(level, radius)
            assert len(ms) == S.comb(blocks, keep) ** level
            for _ in range(300):
                differing = sum(1 << i for i in rnd.sample(range(64), radius))
                assert any(not m & differing for m in ms)


def brute_similar(texts, k=5, least=0.8):
    ids = sorted(texts)
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if S.jaccard(texts[a], texts[b], k) >= least:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: find(i) for i in ids}


def test_similar_documents(spark):
    rnd = random.Random(12)
    vocabulary = ["".join(rnd.choice("abcdefghijklmnop") for _ in range(rnd.randrange(2, 9))) for _ in range(3000)]
    texts = {}
    for group in range(12):
        base = [rnd.choice(vocabulary) for _ in range(220)]
        for copy in range(5):
            own = list(base)
            for _ in range(copy % 3):
                own[rnd.randrange(220)] = rnd.choice(vocabulary)
            texts[len(texts)] = " ".join(own)
        texts[len(texts)] = " ".join(w if k % 7 else rnd.choice(vocabulary) for k, w in enumerate(base))  # similarity under 0.8
    want = brute_similar(texts)
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    for node, block in ((4096, S.BLOCK), (4, 1000)):
        got = {r.doc_id: r.component_id for r in S.similar_documents(df, node=node, block=block).collect()}
        assert sum(got[i] == want[i] for i in texts) >= 0.95 * len(texts)
        assert all(want[got[i]] == want[i] for i in texts)  # nothing is linked that brute force does not link


def test_components_with_full_nodes(spark):
    rnd = random.Random(7)
    fps = clustered(rnd, 1500, [rnd.getrandbits(64) for _ in range(4)], 7)
    df = spark.createDataFrame([(S._signed(x), r) for r, x in fps.items()], "fp long, rep long")
    want = brute_components(fps)
    for node in (4096, 64, 8):
        got = {r.id: r.component for r in S.components(S.links(df, node=node)).collect()}
        assert {r: got.get(r, r) for r in fps} == want


def test_long_chain(spark):
    ids = list(range(400))
    random.Random(1).shuffle(ids)
    edges = spark.createDataFrame(list(zip(ids, ids[1:])), "a long, b long")
    assert {r.id: r.component for r in S.components(edges).collect()} == dict.fromkeys(ids, 0)


def test_awkward_rows(spark):
    schema = "doc_id long, text string, fingerprint string, component_id string, rep int"
    rows = [(5, None, "x", "y", 1), (4, "", "x", "y", 1), (None, "alone here now", None, None, None), (None, "a b c", "", "", 0), (9, "a b c", "", "", 0), (9, "A B c", "", "", 0), (7, "w " * 60_000, "", "", 0)]
    out = {(r.doc_id, r.fingerprint, r.component_id) for r in S.near_duplicates(spark.createDataFrame(rows, schema)).collect()}
    fp = lambda t: f"{brute_fingerprint(t):016x}"
    assert out == {(5, "0" * 16, 4), (4, "0" * 16, 4), (None, fp("alone here now"), None), (None, fp("a b c"), 9), (9, fp("a b c"), 9), (7, fp("w " * 60_000), 7)}
    assert S.near_duplicates(spark.createDataFrame([], schema)).count() == 0


def test_similar_documents_between_rejected_texts(spark):
    """Texts of the same distinct words in other orders: fingerprints are equal, so closeness says nothing of the shingles."""
    rnd = random.Random(21)
    words = [f"w{i}" for i in range(120)]
    texts = {}
    for _ in range(40):
        order = rnd.sample(words, len(words))
        for _ in range(3):
            own = list(order)
            k = rnd.randrange(119)
            own[k], own[k + 1] = own[k + 1], own[k]
            texts[len(texts)] = " ".join(own)
    ids = list(texts)
    rnd.shuffle(ids)
    texts = {i: texts[j] for i, j in enumerate(ids)}
    want = brute_similar(texts)
    assert len(set(want.values())) < len(texts)
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    for node, block in ((4096, S.BLOCK), (4, 1000)):
        assert {r.doc_id: r.component_id for r in S.similar_documents(df, node=node, block=block).collect()} == want


def groups_of(edges, ids):
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    return {i: find(i) for i in ids}


def test_links_of_full_nodes(spark):
    """Rows under one node are dealt in blocks, pass on few edges, and are joined as all their pairs are."""
    rnd = random.Random(9)
    fps = clustered(rnd, 600, [rnd.getrandbits(64) for _ in range(5)], 12)
    fps |= {10_000 + i: 7 for i in range(100)}
    sketch = {i: bytes(rnd.choice((1, 2)) if rnd.random() < 0.05 * (i % 4) else 1 for _ in range(S.BINS)) for i in fps}
    n = {i: 100 + 30 * (i % 2) for i in fps}
    table = {i: S.np.frombuffer(x, S.np.uint8)[None] for i, x in sketch.items()}
    near = [(a, b) for a in fps for b in fps if a < b and (fps[a] ^ fps[b]).bit_count() <= 7 and min(n[a], n[b]) >= 0.8 * max(n[a], n[b]) and S.alike(table[a], table[b], 0.8)[0]]
    df = spark.createDataFrame([(S._signed(x), i, n[i], n[i], bytearray(sketch[i])) for i, x in fps.items()], "fp long, id long, n int, shared int, sketch binary")
    for node in (4096, 8):
        edges = [(r.a, r.b) for r in S.alike_links(df, 7, node, 0.8).collect()]
        assert all(a > b for a, b in edges) and groups_of(edges, fps) == groups_of(near, fps)
        assert node == 8 or len(edges) < 120 * len(fps)
    rows = spark.createDataFrame([(k, 5, i) for k in (1, 2) for i in range(500)], "mask int, bits long, id long")
    dealt = S.in_blocks(rows, ["mask", "bits"], spark.createDataFrame([(1, 5, 4)], "mask int, bits long, blocks int"))
    sizes = {(r.mask, r.i, r.j): r["count"] for r in dealt.groupBy("mask", "i", "j").count().collect()}
    assert sizes[2, 0, 0] == 500 and len(sizes) == 11 and max(v for k, v in sizes.items() if k[0] == 1) < 350


def test_many_texts_of_one_fingerprint(spark):
    """20,000 texts of the same words in other orders, and 100 that differ by a word at the end."""
    rnd = random.Random(4)
    words = [f"w{i}" for i in range(60)]
    texts = {i: " ".join(rnd.sample(words, 60)) for i in range(20_000)}
    for i in range(100):
        texts[20_000 + i] = texts[i] + " w1"
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in S.similar_documents(df).collect()}
    assert all(got[20_000 + i] == i for i in range(100)) and len(set(got.values())) == 20_000


def test_copies_with_changes_of_their_own_do_not_meet(spark):
    """A group of near copies under the similarity: none reaches the index, but for pairs that are similar."""
    rnd = random.Random(31)
    words = [f"w{i}" for i in range(5000)]
    base = rnd.sample(words, 150)
    texts = {i: " ".join(w if rnd.random() > 0.06 else rnd.choice(words) for w in base) for i in range(400)}
    texts |= {400 + i: f"{texts[i]} end" for i in range(20)}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    want = brute_similar(texts)
    assert {r.doc_id: r.component_id for r in S.similar_documents(df).collect()} == want
    hs = {i: set(S.shingle_hashes(t.encode().split(), 5).tolist()) for i, t in texts.items()}
    got = {r.id: r.alone for r in S.alone(spark.createDataFrame([(i, S._signed(h)) for i, own in hs.items() for h in own], "id long, h long")).collect()}
    seen = S.np.unique(S.np.array([h for own in hs.values() for h in own], S.np.uint64), return_counts=True)
    once = {h for h, n in zip(seen[0].tolist(), seen[1].tolist()) if n == 1}
    assert {i: len(own & once) for i, own in hs.items() if own & once} == got and sum(n > 0.2 * 146 for i, n in got.items() if 20 <= i < 400) > 200


def test_recall_on_given_documents(spark):
    """Pairs of similarity 0.8 or more among the given documents, found by shingles in common."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    texts, first = {}, {}
    for r in docs.orderBy("doc_id").collect():
        if first.setdefault(r.text, r.doc_id) == r.doc_id:
            texts[r.doc_id] = r.text
    sets = {i: {*zip(*((t or "").lower().split()[k:] for k in range(5)))} for i, t in texts.items()}
    shared = {}
    for i, s in sets.items():
        for g in s:
            shared.setdefault(g, []).append(i)
    pairs = {(a, b) for l in shared.values() if 1 < len(l) < 200 for a in l for b in l if a < b}  # noqa: E741
    similar = {(a, b) for a, b in pairs if S.jaccard(texts[a], texts[b], 5) >= 0.8}
    got = {r.doc_id: r.component_id for r in S.similar_documents(docs).collect()}
    assert similar and sum(got[a] == got[b] for a, b in similar) >= 0.9 * len(similar)
    assert all(got[i] == got[first[t]] for i, t in ((r.doc_id, r.text) for r in docs.collect()))
