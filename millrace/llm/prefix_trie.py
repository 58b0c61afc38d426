"""Operator 13: the trie of conversations' prefixes, from sorted sequences and range minima over their longest common prefixes.

Turns are digests (16 bytes of role and text), a conversation is the string of its turns' digests, so texts are not sorted or shuffled and the
order of these strings is one in which conversations with a common prefix are neighbours. The order is dealt out by ranges (by conv_id
within equal conversations) and read in blocks of ``BLOCK`` turns. In a block, LCP values of neighbours go into a sparse table of range
minima; every candidate prefix, a conversation and a depth at which it differs from the one before, searches the left and the right end of its
interval of members by binary descent in that table, each independently of all others and without a stack. What a node needs are sums and
minima over its interval: members, their smallest conv_id (a second sparse table), leaves, children, and words, as prefix sums.

Only prefixes of a block's first or last conversation can go on in another block. These *open* nodes are added up by their digest: each
block counts what starts in it, told the last conversation of the block before (and the first of the next) by a table with one
row a block. So neither a hot first turn nor a hot conversation comes together in one task; a chunk of the conv_ids that end at an open
node is one string a block, and strings are hashed in order, one after another.

One conversation's digests and word counts (24 bytes a turn), not its texts, form a row.

Defined results: turns are ordered by turn (null first), then role, then digest; null role or text is empty; turns without conv_id belong to
no conversation and are left out; repeated rows are turns of their own; further columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._common import WORD, shipped, written

FAMILY, HEADS = 20, 4
#: Turns of a block (a longer conversation is a block of its own).
BLOCK = 1 << 19
_DIGEST = 16
#: Columns of a node as a block gives it; ``open`` tells those that may go on in another block, ``above`` the open parent's key.
_NODE = "block long, key binary, depth long, open boolean, above binary, conv_id long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved long, ends string, ends_sha256 string"


def rebuilt(turns: DataFrame, family: int = FAMILY, heads: int = HEADS) -> DataFrame:
    """conv_id, path (digests of its rebuilt turns, joined) and words (of each turn's text): a conversation starts with the first
    h = crc32(conv_id) % ``heads`` turns of the first of its ``family``, in place of its own."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    own = turns.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), role.alias("role"),
        F.md5(F.concat_ws(":", F.octet_length(role), role, text).cast("binary")).alias("digest"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("words"),
    )  # fmt: skip
    # what comes together is a digest and a number for each turn; sort_array puts null turns first
    own = own.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "digest", "words"))).alias("t"))
    own = own.select("conv_id", F.transform("t", lambda t: F.struct(t["digest"].alias("digest"), t["words"].alias("words"))).alias("t"))
    own = written(own.withColumn("h", (F.crc32(F.col("conv_id").cast("string").cast("binary")) % heads).cast("int")).withColumn("base", F.expr(f"conv_id - conv_id % {family}")), "turns")
    bases = own.where("conv_id = base").select(F.col("conv_id").alias("b"), F.slice("t", 1, heads - 1).alias("first"))
    both = own.join(bases, own.base == bases.b, "left")
    head = F.slice(F.coalesce("first", F.array().cast("array<struct<digest:string,words:bigint>>")), F.lit(1), F.col("h"))
    both = both.select("conv_id", F.concat(head, F.slice("t", F.col("h") + 1, F.greatest(F.size("t") - F.col("h"), F.lit(0)))).alias("t"))
    return both.select("conv_id", F.unhex(F.array_join("t.digest", "")).alias("path"), F.col("t.words").alias("words"))


class SparseTable:
    """Minima of all ranges of an array whose lengths are powers of two."""

    def __init__(self, values: np.ndarray):
        self.levels = [values]
        while len(self.levels[-1]) > 1 << (len(self.levels) - 1):
            last, step = self.levels[-1], 1 << (len(self.levels) - 1)
            self.levels.append(np.minimum(last[:-step], last[step:]))

    def least(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The minimum of each range start <= i < end; no range is empty."""
        level = np.frexp((end - start).astype(np.float64))[1] - 1
        out = np.empty(len(start), self.levels[0].dtype)
        for k in np.unique(level).tolist():
            at = np.flatnonzero(level == k)
            out[at] = np.minimum(self.levels[k][start[at]], self.levels[k][end[at] - (1 << k)])
        return out

    def right(self, start: np.ndarray, bound: np.ndarray) -> np.ndarray:
        """For each start the first position from there on whose value is under ``bound``, or the array's length."""
        at, size = start.copy(), len(self.levels[0])
        for k in range(len(self.levels) - 1, -1, -1):
            fits = at + (1 << k) <= size
            fits[fits] = self.levels[k][at[fits]] >= bound[fits]
            at[fits] += 1 << k
        return at

    def left(self, end: np.ndarray, bound: np.ndarray) -> np.ndarray:
        """For each end the last position before it whose value is under ``bound``, plus one; 0 if there is none."""
        at = end.copy()
        for k in range(len(self.levels) - 1, -1, -1):
            fits = at >= 1 << k
            fits[fits] = self.levels[k][at[fits] - (1 << k)] >= bound[fits]
            at[fits] -= 1 << k
        return at


def common(a: bytes, b: bytes) -> int:
    """How many leading turns two paths share."""
    low, high = 0, min(len(a), len(b)) // _DIGEST
    while low < high:
        mid = (low + high + 1) // 2
        low, high = (mid, high) if a[: mid * _DIGEST] == b[: mid * _DIGEST] else (low, mid - 1)
    return low


def neighbours(paths: list[bytes]) -> np.ndarray:
    """The LCP of each path with the one before it; 0 for the first."""
    return np.array([0, *map(common, paths, paths[1:])], np.int64)


def keys_of(path: bytes, depths: int) -> list[bytes]:
    """The keys of a path's prefixes of 0 to ``depths`` turns."""
    state, out = hashlib.blake2b(digest_size=16), []
    for d in range(depths + 1):
        out.append(state.digest())
        state.update(path[d * _DIGEST : (d + 1) * _DIGEST])
    return out


def nodes_of(conv: np.ndarray, paths: list[bytes], words: list[np.ndarray], previous: bytes | None, following: bytes | None) -> dict[str, list]:
    """Columns of the nodes of one block: its conversations in order, and the paths that stand before and after it (None at the ends).

    Sums hold what starts in the block, so that those of one node in several blocks add up: a node's words count in the block where it starts.
    """
    n = len(conv)
    size = np.array([len(p) // _DIGEST for p in paths], np.int64)
    # cumulative words by conversation and depth, at offset[i] + depth
    offset = np.concatenate([[0], np.cumsum(size + 1)])
    total = np.zeros(int(offset[-1]), np.int64)
    for i, w in enumerate(words):
        np.cumsum(w, out=total[offset[i] + 1 : offset[i + 1]])
    lcp = neighbours(paths)
    before = -1 if previous is None else common(previous, paths[0])
    after = -1 if following is None else common(paths[-1], following)
    lcp[0] = before
    nxt = np.append(lcp[1:], after)
    leaf = np.concatenate([[0], np.cumsum(nxt < size)])
    full = np.concatenate([[0], np.cumsum(total[offset[:-1] + size])])
    started = np.maximum(lcp, 0)
    fresh = np.concatenate([[0], np.cumsum(total[offset[:-1] + size] - total[offset[:-1] + started])])
    # candidates: each conversation with each depth at which it is the first in this block to go there
    least = np.append(-1, lcp[1:]) + 1
    many = np.maximum(size - least + 1, 0)
    i = np.repeat(np.arange(n), many)
    d = np.arange(len(i)) - np.repeat(np.cumsum(many) - many, many) + least[i]
    table, smallest = SparseTable(lcp[1:]) if n > 1 else None, SparseTable(conv)
    l = table.left(i, d) if table else i  # noqa: E741
    r = (table.right(i, d) if table else i) + 1
    open_ = ((l == 0) & (d <= before)) | ((r == n) & (d <= after))
    # children start where the LCP is the node's depth (or less, at its first member) and the conversation goes on
    on = np.flatnonzero(size > lcp)
    inner = np.lexsort((on, lcp[on]))
    order = lcp[on][inner] * (n + 1) + on[inner]
    children = np.searchsorted(order, d * (n + 1) + r) - np.searchsorted(order, d * (n + 1) + l + 1)
    starts = (lcp[l] <= d) & (size[l] > d)
    children += starts
    head = np.where(d > 0, total[offset[l] + np.maximum(d - 1, 0)], 0)
    # each member has the words of its turns from the node's on; each node of the subtree has its own once, where it starts
    of_members = full[r] - full[l] - (r - l) * head
    at_first = total[offset[l] + size[l]] - np.maximum(total[offset[l] + np.minimum(started[l], size[l])], head)
    once = fresh[r] - fresh[l + 1] + at_first
    low = smallest.least(l, r)
    # members that end at the node come first among its members, in order of conv_id
    same = np.flatnonzero(np.append(True, (lcp[1:] < size[1:]) | (size[1:] != size[:-1])))
    until = np.append(same[1:], n)[np.searchsorted(same, l, side="right") - 1]
    ends = [",".join(map(str, conv[a:b].tolist())) if size[a] == k else "" for a, b, k in zip(l.tolist(), until.tolist(), d.tolist())]
    # parents: the smallest conv_id over the interval one turn up
    up = np.maximum(d - 1, 0)
    pl = table.left(l, up) if table else l
    pr = (table.right(l, up) if table else l) + 1
    parent = smallest.least(pl, pr)
    parent_open = (d > 0) & (((pl == 0) & (up <= before)) | ((pr == n) & (up <= after)))
    first, last = keys_of(paths[0], max(before, 0)), keys_of(paths[-1], max(after, 0))
    key = [None if not o else first[k] if a == 0 and k <= before else last[k] for o, a, k in zip(open_.tolist(), l.tolist(), d.tolist())]
    above = [None if not o else first[k] if a == 0 and k <= before else last[k] for o, a, k in zip(parent_open.tolist(), pl.tolist(), up.tolist())]
    return {
        "key": key, "depth": d, "open": open_, "above": above, "conv_id": low, "parent_conv_id": [None if k == 0 or o else p for k, o, p in zip(d.tolist(), parent_open.tolist(), parent.tolist())],
        "n_convs": r - l, "n_children": children, "n_leaves": leaf[r] - leaf[l], "saved": of_members - once,
        "ends": [e if o else None for e, o in zip(ends, open_.tolist())], "ends_sha256": [None if o else hashlib.sha256(e.encode()).hexdigest() for e, o in zip(ends, open_.tolist())],
    }  # fmt: skip


def in_order(conversations: DataFrame, block: int = BLOCK) -> DataFrame:
    """The conversations (conv_id, path, words) in order of path and conv_id, with their block and the row they are ``at`` within it."""
    shipped(conversations.sparkSession)

    def run(batches):
        task, turns, rows = TaskContext.get().partitionId() << 32, 0, 0
        for b in batches:
            sizes = np.array([len(p.as_buffer()) // _DIGEST + 1 for p in b.column("path")], np.int64)
            until = turns + np.cumsum(sizes)
            number = task + (until - sizes) // block
            at = np.arange(rows, rows + len(sizes))
            turns, rows = int(until[-1]) if len(until) else turns, rows + len(sizes)
            yield pa.RecordBatch.from_arrays([pa.array(number), pa.array(at), *(b.column(c) for c in ("conv_id", "path", "words"))], names=["block", "at", "conv_id", "path", "words"])

    dealt = conversations.repartitionByRange("path", "conv_id").sortWithinPartitions("path", "conv_id")
    return written(dealt.select("conv_id", "path", "words").mapInArrow(run, "block long, at long, conv_id long, path binary, words array<long>"), "sorted")


def nodes_in_blocks(rows: DataFrame) -> DataFrame:
    """The nodes of each block (``_NODE``); rows as from ``in_order``."""

    def close(block, conv, paths, words):
        previous = paths.pop(0) if conv[0] is None else None
        following = paths.pop() if conv[-1] is None else None
        words = [w for w, c in zip(words, conv) if c is not None]
        columns = nodes_of(np.array([c for c in conv if c is not None], np.int64), paths, words, previous, following)
        columns["block"] = np.full(len(columns["depth"]), block)
        return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) for f in schema], schema=schema)

    schema = pa.schema([(n, {"long": pa.int64(), "binary": pa.binary(), "boolean": pa.bool_(), "string": pa.string()}[t]) for n, t in (c.split(" ") for c in _NODE.split(", "))])

    def run(batches):
        now, held = None, ([], [], [])
        for b in batches:
            blocks, conv = b.column("block").to_numpy(), b.column("conv_id").to_pylist()
            words = b.column("words")
            values, bounds = words.values.to_numpy(), words.offsets.to_numpy()
            for k, path in enumerate(b.column("path")):
                if blocks[k] != now:
                    if held[0]:
                        yield close(now, *held)
                    now, held = blocks[k], ([], [], [])
                held[0].append(conv[k])
                held[1].append(path.as_py())
                held[2].append(values[bounds[k] : bounds[k + 1]])
        if held[0]:
            yield close(now, *held)

    # a row for each block: where it starts and ends
    bounds = rows.groupBy("block").agg(F.min_by("path", "at").alias("first"), F.max_by("path", "at").alias("last"), F.max("at").alias("at"))
    beside = Window.partitionBy(F.lit(0)).orderBy("block")
    bounds = bounds.select("block", "at", F.lag("last").over(beside).alias("previous"), F.lead("first").over(beside).alias("following"))
    none = [F.lit(None).cast("long").alias("conv_id"), F.array().cast("array<bigint>").alias("words")]
    around = F.array(F.struct(F.lit(-1).cast("long").alias("at"), F.col("previous").alias("path")), F.struct((F.col("at") + 1).alias("at"), F.col("following").alias("path")))
    around = bounds.select("block", F.explode(around).alias("e")).where("e.path IS NOT NULL").select("block", "e.at", none[0], "e.path", none[1])
    return rows.unionByName(around).repartition("block").sortWithinPartitions("block", "at").mapInArrow(run, _NODE)


def hashed_ends(chunks: DataFrame) -> DataFrame:
    """(key, hash): SHA-256 of the chunks (key, block, ends) of each key, in order and comma-joined; a task holds one chunk at a time."""

    def run(batches):
        now, state = None, None
        for b in batches:
            for key, ends in zip(b.column("key").to_pylist(), b.column("ends")):
                if key == now:
                    state.update(b",")
                else:
                    if state:
                        yield pa.RecordBatch.from_arrays([pa.array([now], pa.binary()), pa.array([state.hexdigest()])], names=["key", "hash"])
                    now, state = key, hashlib.sha256()
                state.update(ends.as_py().encode())
        if state:
            yield pa.RecordBatch.from_arrays([pa.array([now], pa.binary()), pa.array([state.hexdigest()])], names=["key", "hash"])

    return chunks.repartition("key").sortWithinPartitions("key", "block").select("key", "ends").mapInArrow(run, "key binary, hash string")


def trie(turns: DataFrame, family: int = FAMILY, heads: int = HEADS, block: int = BLOCK) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens and ends_sha256 of every node."""
    nodes = written(nodes_in_blocks(in_order(rebuilt(turns, family, heads), block)), "nodes")
    sums = ["n_convs", "n_children", "n_leaves", "saved"]
    parts = nodes.where("open")
    whole = parts.groupBy("key").agg(F.first("depth").alias("depth"), F.first("above").alias("above"), F.min("conv_id").alias("conv_id"), *(F.sum(c).alias(c) for c in sums))
    whole = written(whole.join(hashed_ends(parts.where("ends <> ''")), "key", "left").withColumn("ends_sha256", F.coalesce("hash", F.sha2(F.lit(""), 256))).drop("hash"), "open-nodes")
    names = whole.select(F.col("key").alias("k"), F.col("conv_id").alias("parent"))
    whole = whole.join(names, whole.above == names.k, "left").select("conv_id", "depth", F.col("parent").alias("parent_conv_id"), *sums, "ends_sha256")
    # an open parent is looked up within the block, where few nodes share it
    at_block = parts.select(F.col("block").alias("b"), "key").join(names, F.col("key") == names.k).select("b", "k", "parent")
    inner = nodes.where("NOT open")
    under = inner.where("above IS NOT NULL").join(at_block, (F.col("block") == F.col("b")) & (F.col("above") == F.col("k"))).withColumn("parent_conv_id", F.col("parent"))
    columns = ["conv_id", "depth", "parent_conv_id", *sums, "ends_sha256"]
    out = inner.where("above IS NULL").select(*columns).unionByName(under.select(*columns)).unionByName(whole)
    return out.withColumnRenamed("saved", "saved_tokens")


#: The same rows by SQL: prefixes as digests, and every node added to all its ancestors.
ORACLE = r"""
WITH bits AS (SELECT list_transform(range(256), lambda b: list_reduce([b::BIGINT, 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, CASE WHEN x & 1 = 1 THEN 3988292384 ELSE 0 END))) AS crc),
t AS MATERIALIZED (
    SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, '')) AS k, coalesce(role, '') AS r, coalesce(text, '') AS x
    FROM conversations WHERE conv_id IS NOT NULL),
h AS MATERIALIZED (
    SELECT c, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, length(c::VARCHAR) + 1), lambda i: ascii((c::VARCHAR)[i])::BIGINT)),
        lambda x, b: xor(crc[(xor(x, b) & 255) + 1], x >> 8)), 4294967295) % 4 AS h FROM (SELECT DISTINCT c FROM t), bits),
own AS (SELECT h.c, 0 AS part, k, r, x FROM h JOIN t ON t.c = h.c - h.c % 20 WHERE k <= h UNION ALL SELECT h.c, 1, k, r, x FROM h JOIN t ON t.c = h.c WHERE k > h),
turns AS MATERIALIZED (SELECT c, row_number() OVER (PARTITION BY c ORDER BY part, k) AS d, md5(length(r) || ':' || r || ':' || x) AS m, len(regexp_extract_all(x, '[^ 	-]+')) AS w FROM own),
p AS MATERIALIZED (
    SELECT c, d, md5(string_agg(m, '') OVER (PARTITION BY c ORDER BY d)) AS key, w FROM turns
    UNION ALL SELECT c, 0, '', 0 FROM h),
size AS (SELECT c, max(d) AS size FROM p GROUP BY c),
n AS MATERIALIZED (
    SELECT d, key, min(c) AS conv_id, count(*) AS n, min(w) AS w, sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (WHERE size = d), '')) AS ends
    FROM p JOIN size USING (c) GROUP BY d, key),
up AS (SELECT n.d, n.key, n.n, n.w, q.d AS above, q.key AS above_key FROM n JOIN p q ON q.c = n.conv_id AND q.d <= n.d),
parents AS MATERIALIZED (SELECT up.d, up.key, n.conv_id AS parent, n.key AS parent_key FROM up JOIN n ON n.d = above AND n.key = above_key WHERE above = up.d - 1),
children AS MATERIALIZED (SELECT d - 1 AS d, parent_key AS key, count(*) AS children FROM parents GROUP BY ALL),
below AS (
    SELECT above AS d, above_key AS key, sum((n - 1) * w) AS saved, count(*) FILTER (children.children IS NULL) AS leaves
    FROM up LEFT JOIN children ON children.d = up.d AND children.key = up.key GROUP BY ALL)
SELECT conv_id, d AS depth, parent AS parent_conv_id, n AS n_convs, coalesce(children, 0)::BIGINT AS n_children, leaves::BIGINT AS n_leaves, saved::BIGINT AS saved_tokens, ends AS ends_sha256
FROM n JOIN below USING (d, key) LEFT JOIN children USING (d, key) LEFT JOIN parents USING (d, key)
"""
