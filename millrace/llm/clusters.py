"""Links on full shingle sets within clusters of candidates, and connected components: what the near-duplicate operators share.

A cluster is any set of texts outside of which its members have no links. Small ones are compared in one task each. A large one (over ``BLOCK``
shingles) first loses the texts with more shingles that no other member has than the similarity allows: they cannot be linked. The
others meet ``LEADERS`` of their number, in blocks of the cluster, which joins a group of look-alikes at the cost of its size. Only what
stays apart from the largest component then meets the rest, block against block; members of that component do not meet one
another again. No step passes on pairs: a task gives one edge for each text that it joins.

Cost: members x (``LEADERS`` + members outside of the largest component). Where a large cluster is of texts that are neither linked nor told apart by shingles of
their own, this is the square of its size, dealt over tasks of at most two blocks.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import shipped, written

#: Shingles of a block of texts that are compared by a task, and texts that all others of a large cluster meet first.
BLOCK, LEADERS = 1 << 18, 64
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def shingle_hashes(words: list[bytes], shingle: int) -> np.ndarray:
    """Sorted hashes of the distinct shingles of a text's words, the ones that ``jaccard`` compares."""
    import xxhash

    if len(words) < shingle:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), 7)], np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    n, out = len(words) - shingle + 1, np.zeros(len(words) - shingle + 1, np.uint64)
    for i in range(shingle):
        out = (out ^ (out >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + h[i : i + n]
    out = (out ^ (out >> np.uint64(32))) * np.uint64(0x94D049BB133111EB)
    return np.unique(out ^ (out >> np.uint64(29)))


def local_groups(reps: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each fingerprint of a node the smallest rep of those linked with it, directly or through others."""
    label = reps.copy()
    while len(a):
        low = np.minimum(label[a], label[b])
        if (label[a] == low).all() and (label[b] == low).all():
            break
        np.minimum.at(label, a, low)
        np.minimum.at(label, b, low)
    return label


def components(edges: DataFrame) -> DataFrame:
    """(id, component) of every end of an edge (a, b): component is the smallest id reachable.

    Alternating star steps: large-star links a node's larger neighbours to its smallest, small-star its smaller ones. Minima are
    taken by partial aggregation, and a node with very many links only meets one row in the join. Each step is
    written in the shared folder.
    """
    edges = written(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    seen = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("low"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("low").alias("b")).where("a <> b").distinct()
        large = written(large, "large-star")
        least = large.groupBy("a").agg(F.min("b").alias("low"))
        small = large.join(least, "a").select(F.explode(F.array("a", "b")).alias("a"), F.col("low").alias("b")).where("a <> b").distinct()
        edges = written(small, "small-star")
        now = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if now == seen:
            break
        seen = now
    roots = edges.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct()
    return edges.select(F.col("a").alias("id"), F.col("b").alias("component")).unionByName(roots)


def in_blocks(rows: DataFrame, keys: list[str], blocks: DataFrame) -> DataFrame:
    """The rows with columns i, j, side: of groups (``keys``) with a number of ``blocks`` (others have one), each two blocks i <= j meet by
    themselves, so that no task holds more than two of them; ``side`` tells the blocks."""
    own = rows.join(blocks, keys, "left").withColumn("blocks", F.coalesce("blocks", F.lit(1))).withColumn("own", F.expr("CAST(pmod(xxhash64(id), blocks) AS INT)"))
    others = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda k: F.struct(F.least(k, "own").alias("i"), F.greatest(k, "own").alias("j"), (k < F.col("own")).cast("int").alias("side")))
    return own.withColumn("p", F.explode(others)).select(*rows.columns, "p.i", "p.j", "p.side")


def whole_groups(batches, columns: list[str], keys: int):
    """(columns, starts, ends) of whole groups from sorted batches: arrays of rows, and the bounds of each run of equal values of the
    first ``keys`` of them. What is held back is one group."""
    held: list[np.ndarray] = []
    for piece in itertools.chain(batches, [None]):
        own = held
        if piece is not None:
            own = [piece.column(k).to_numpy(zero_copy_only=False) for k in columns]
            if held:
                own = [np.concatenate(z) for z in zip(held, own)]
        if not own or not len(own[0]):
            continue
        changes = np.flatnonzero(np.logical_or.reduce([z[1:] != z[:-1] for z in own[:keys]])) + 1
        starts, ends = np.r_[0, changes], np.r_[changes, len(own[0])]
        if piece is not None:  # the last group may go on in the next batch
            held = [z[starts[-1] :] for z in own]
            starts, ends = starts[:-1], ends[:-1]
        if len(starts):
            yield own, starts, ends


def edge_batches(found):
    """Record batches of the edges (a, b) that come in pieces."""
    out, size = [], 0
    for a, b in found:
        out.append((a, b))
        size += len(a)
        if size >= 1 << 16:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(z)) for z in zip(*out)], names=["a", "b"])
            out, size = [], 0
    if size:
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(z)) for z in zip(*out)], names=["a", "b"])


def star(ids: np.ndarray, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges from each of the rows that the pairs (x, y) join to the smallest id among those joined with it."""
    rows, at = np.unique(np.r_[x, y], return_inverse=True)
    own = ids[rows]
    low = local_groups(own, at[: len(x)], at[len(x) :])
    return own[low != own], low[low != own]


def alone(rows: DataFrame) -> DataFrame:
    """id, alone: how many of the hashes (id, h), each once an id, no other id has."""
    return rows.groupBy("h").agg(F.count("*").alias("n"), F.min("id").alias("id")).where("n = 1").groupBy("id").agg(F.count("*").alias("alone"))


def shingles_of(texts: DataFrame, shingle: int) -> DataFrame:
    """(id, h) for each distinct shingle of each text (id, text)."""
    shipped(texts.sparkSession)

    def run(batches):
        for b in batches:
            for i, t in zip(b.column("id").to_pylist(), b.column("text")):
                h = shingle_hashes((t.as_py() or "").encode().translate(LOWER).split(), shingle).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(h), i)), pa.array(h)], names=["id", "h"])

    return texts.select("id", "text").mapInArrow(run, "id long, h long")


def text_hashes(text: str | None, shingle: int) -> np.ndarray:
    return shingle_hashes((text or "").encode().translate(LOWER).split(), shingle)


def forest(hashes: list[np.ndarray], similarity: float, side: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Edges (x, y) that join the same of these sets as all links do (with ``side``, all links between sets of different sides).

    Breadth first: a set is compared with those that nothing has reached yet, so sets that are all linked are compared once each. Hashes in
    common are counted on bit maps of those that two of the sets have.
    """
    sizes = np.array([len(h) for h in hashes])
    _, at = np.unique(np.concatenate(hashes), return_inverse=True)
    twice = np.bincount(at) > 1
    column = np.cumsum(twice) - 1
    width = -(-int(twice.sum()) // 64) or 1
    bits = np.zeros((len(hashes), width * 8), np.uint8)
    ends = np.cumsum(sizes)
    for k, end in enumerate(ends.tolist()):
        own = at[end - sizes[k] : end]
        own = column[own[twice[own]]]
        np.bitwise_or.at(bits[k], own >> 3, (1 << (own & 7)).astype(np.uint8))
    words = bits.view(np.uint64)
    # those that share too little with all others are linked with none
    open_ = np.flatnonzero(np.bitwise_count(words).sum(axis=1, dtype=np.int64) >= similarity * sizes - 1e-9)
    found = [np.zeros((2, 0), np.int64)]
    while len(open_) > 1:
        reached, open_ = [int(open_[0])], open_[1:]
        while reached and len(open_):
            x = reached.pop()
            fits = np.minimum(sizes[open_], sizes[x]) >= similarity * np.maximum(sizes[open_], sizes[x]) - 1e-9
            if side is not None:
                fits &= side[open_] != side[x]
            at = np.flatnonzero(fits)
            if not len(at):
                continue
            y = open_[at]
            # a few megabytes of bit maps at a time
            step = max(1, (1 << 19) // width)
            common = np.concatenate([np.bitwise_count(words[y[k : k + step]] & words[x]).sum(axis=1, dtype=np.int64) for k in range(0, len(y), step)])
            near = common >= similarity * (sizes[y] + sizes[x] - common) - 1e-9
            if near.any():
                found.append(np.stack([y[near], np.full(int(near.sum()), x)]))
                reached += y[near].tolist()
                open_ = np.delete(open_, at[near])
    return tuple(np.concatenate(found, axis=1))


def links_of_blocks(dealt: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """(a, b), a > b, for rows dealt to tasks (cluster, i, j): those of side 0 among each other if i = j, else those of side 0 against side 1."""
    shipped(dealt.sparkSession)

    def links(batches):
        for (_, i, j, side, ids, texts), starts, ends in whole_groups(batches, ["cluster", "i", "j", "side", "id", "text"], 3):
            for s, e in zip(starts.tolist(), ends.tolist()):
                if e - s > 1:
                    x, y = forest([text_hashes(t, shingle) for t in texts[s:e]], similarity, side[s:e] if i[s] != j[s] else None)
                    if len(x):
                        of = ids[s:e]
                        yield star(of, x, y)

    def run(batches):
        yield from edge_batches(links(batches))

    keys = ["cluster", "i", "j"]
    return dealt.select(*keys, "side", "id", "text").repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, "a long, b long").where("a <> b").distinct()


def within_clusters(rows: DataFrame, shingle: int, similarity: float, block: int = BLOCK, leaders: int = LEADERS) -> DataFrame:
    """(id, component) of every text that is linked with another of its cluster. rows: cluster, id, n (distinct shingles), text, one row for an id."""
    spans = rows.groupBy("cluster").agg(F.sum("n").alias("all")).where(F.col("all") > block)
    large = written(spans.select("cluster"), "large-clusters")
    one = [F.lit(0).alias(c) for c in ("i", "j", "side")]
    if large.isEmpty():
        return components(links_of_blocks(rows.select("cluster", "id", "text", *one), shingle, similarity))
    within = links_of_blocks(rows.join(large, "cluster", "left_anti").select("cluster", "id", "text", *one), shingle, similarity)
    inside = rows.join(large, "cluster", "left_semi")
    lonely = alone(shingles_of(inside, shingle))
    inside = inside.join(lonely.hint("merge"), "id", "left").where(F.coalesce("alone", F.lit(0)) <= (1 - similarity) * F.col("n") + 1e-9)
    inside = written(inside.select("cluster", "id", "n", "text"), "large-cluster-texts")
    spans = written(inside.groupBy("cluster").agg(F.count("*").alias("members"), F.ceil(F.sum("n") / block).cast("int").alias("blocks")), "cluster-blocks")
    own = inside.join(spans, "cluster").withColumn("p", F.expr("CAST(pmod(xxhash64(id), blocks) AS INT)"))
    first = F.expr(f"pmod(xxhash64(id, 7), members) < {leaders}")
    met = own.select("cluster", "id", "text", F.col("p").alias("i"), F.lit(-1).alias("j"), F.lit(0).alias("side"))
    met = met.unionByName(own.where(first).select("cluster", "id", "text", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("i"), F.lit(-1).alias("j"), F.lit(1).alias("side")))
    edges = written(within.unionByName(links_of_blocks(met, shingle, similarity)), "leader-links")
    joined = components(edges)
    own = inside.join(joined.hint("merge"), "id", "left").withColumn("component", F.coalesce("component", "id"))
    main = own.groupBy("cluster", "component").agg(F.count("*").alias("k")).groupBy("cluster").agg(F.max_by("component", F.struct("k", "component")).alias("main"))
    own = own.join(main, "cluster").withColumn("rest", (F.col("component") != F.col("main")).cast("int"))
    own = written(own.select("cluster", "id", "n", "rest", "text"), "cluster-rests")
    share = own.groupBy("cluster").agg(*(F.ceil(F.sum(F.when(F.col("rest") == k, F.col("n"))) / block).cast("int").alias(name) for k, name in ((1, "u"), (0, "g")))).where("u > 0")
    dealt = own.join(share, "cluster").withColumn("p", F.expr("CAST(IF(rest = 1, pmod(xxhash64(id), u), u + pmod(xxhash64(id), g)) AS INT)"))
    # the rest's blocks 0 .. u - 1 meet all blocks, those of the main component (u .. u + g - 1) only the rest's
    others = F.transform(F.sequence(F.lit(0), F.when(F.col("rest") == 1, F.col("u") + F.col("g")).otherwise(F.col("u")) - 1), lambda k: F.struct(F.least(k, "p").alias("i"), F.greatest(k, "p").alias("j"), (k < F.col("p")).cast("int").alias("side")))
    dealt = dealt.select("cluster", "id", "text", F.explode(others).alias("m")).select("cluster", "id", "text", "m.i", "m.j", "m.side")
    return components(edges.unionByName(links_of_blocks(dealt, shingle, similarity)))
