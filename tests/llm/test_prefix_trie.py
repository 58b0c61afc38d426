import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from millrace.llm import prefix_trie as T
from millrace.llm import queries

SCHEMA = "conv_id long, turn long, role string, text string, depth int, key string"


def brute(rows):
    """The nodes as {(conv_id, depth): the other columns}, by a dictionary of prefixes."""
    turns = {}
    for c, turn, role, text in sorted((r for r in rows if r[0] is not None), key=lambda r: (r[0], r[1] is not None, r[1] or 0, r[2] or "")):
        turns.setdefault(c, []).append((role or "", text or ""))
    built = {}
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % 4
        built[c] = tuple(turns.get(c - c % 20, [])[:h] + own[h:])
    members = {}
    for c, t in built.items():
        for d in range(len(t) + 1):
            members.setdefault(t[:d], []).append(c)
    count = lambda text: len(re.findall(r"[^\x20\x09-\x0D]+", text))
    children = {p: [q for q in members if len(q) == len(p) + 1 and q[: len(p)] == p] for p in members}
    out = {}
    for p, cs in members.items():
        below = [q for q in members if q[: len(p)] == p]
        ends = ",".join(map(str, sorted(c for c in cs if len(built[c]) == len(p))))
        out[min(cs), len(p)] = (
            min(members[p[:-1]]) if p else None, len(cs), len(children[p]), sum(not children[q] for q in below),
            sum((len(members[q]) - 1) * (count(q[-1][1]) if q else 0) for q in below), hashlib.sha256(ends.encode()).hexdigest(),
        )
    return out


def found(df):
    rows = df.collect()
    out = {(r.conv_id, r.depth): (r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256) for r in rows}
    assert len(out) == len(rows)
    return out


def conversations(seed, n, hot=0):
    rng = random.Random(seed)
    rows = []
    for c in rng.sample(range(1, 90), n):
        for k in range(1 if c % 7 == 0 else rng.randrange(1, 6)):
            rows.append((c, None if k == 0 and c % 3 == 0 else k, rng.choice(["user", None]), rng.choice(["a b", "a  b c", "x", None, "é\xa0z"])))
    for c in range(100, 100 + hot):
        rows += [(c, 0, "user", "same"), (c, 1, "assistant", "words here")]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed, block", [(1, 1 << 19), (2, 12), (3, 4), (4, 1)])
def test_equals_a_dictionary_of_prefixes(spark, seed, block):
    rows = conversations(seed, 45, hot=30)
    df = spark.createDataFrame([(*r, 0, "k") for r in rows], SCHEMA)
    assert found(T.trie(df, block=block)) == brute(rows)


def test_binary_searches_equal_scans():
    rng = np.random.default_rng(5)
    for n in (1, 2, 3, 17, 64):
        values = rng.integers(0, 4, n)
        table = T.SparseTable(values)
        for at in range(n + 1):
            for bound in range(6):
                a, b = np.array([at]), np.array([bound])
                right = next((k for k in range(at, n) if values[k] < bound), n)
                left = next((k + 1 for k in range(at - 1, -1, -1) if values[k] < bound), 0)
                assert (table.right(a, b)[0], table.left(a, b)[0]) == (right, left)
                for end in range(at + 1, n + 1):
                    assert table.least(a, np.array([end]))[0] == values[at:end].min()


def test_nulls_turnless_and_empty_tables(spark):
    h = {c: zlib.crc32(str(c).encode()) % 4 for c in range(200)}
    lone = next(c for c in range(21, 200) if h[c] >= 1 and c % 20)  # its first turn is another's, which does not exist
    rows = [(lone, 1, "user", "a"), (None, 1, "user", "left out"), (3, None, None, None), (3, None, None, None)]
    df = spark.createDataFrame([(*r, 0, "k") for r in rows], SCHEMA)
    got = found(T.trie(df, block=1))
    assert got == brute(rows) and got[3, 0][1] == 2
    only = spark.createDataFrame([(lone, 1, "user", "a", 0, "k")], SCHEMA)
    assert found(T.trie(only)) == {(lone, 0): (None, 1, 0, 1, 0, hashlib.sha256(str(lone).encode()).hexdigest())}
    assert T.trie(df.limit(0)).count() == 0


def test_long_conversation(spark):
    rows = [(20, k, "user", f"t{k}") for k in range(3000)] + [(21, k, "user", f"t{k}") for k in range(2990)]
    got = T.trie(spark.createDataFrame([(*r, 0, "k") for r in rows], SCHEMA), block=500)
    sums = got.selectExpr("count(*) AS n", "max(depth) AS d", "max(saved_tokens) AS s", "sum(n_children) AS c").first()
    assert (sums.n, sums.d, sums.s, sums.c) == (3001, 3000, 2990, 3000)


def test_query_gives_the_contract_columns(spark):
    out = queries.QUERIES["op13_prefix_trie"](spark, "/root/testdata/sf0.001")
    names = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens"]
    assert [(f.name, f.dataType.simpleString()) for f in out.schema] == [*((c, "bigint") for c in names), ("ends_sha256", "string")]
