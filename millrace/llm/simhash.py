"""Operator 7: SimHash near-duplicates through a Gray-order hierarchical index.

Fingerprints: 64 bits; a bit is set if it is set in over half of the XXH64 hashes (seed 42) of a text's word shingles.

Index (figures for radius 2): the distinct fingerprints go under *upper nodes*, each a mask and the bits shared under it. A mask keeps two of four
16-bit blocks, so two fingerprints that differ in at most two bits meet under at least one of the six masks. A node that would
hold more than ``NODE`` fingerprints is replaced by its children, whose masks keep two of four 8-bit blocks of what was free,
and then two of four 4-bit blocks; with 8 free bits a node has 256 distinct fingerprints at most. So no group of look-alikes
ends up in one task, and rows grow in proportion to fingerprints (6, 36 or 216 for each). Wider radii take more masks of fewer
bits (120 of 19 for radius 7) and no children: a full node's rows meet in blocks there (``in_blocks``). Below a node, fingerprints lie in
Gray order, in which neighbours share long bit patterns; blocks of them form a tree whose inner nodes hold the mask and value
of the bits that all below have in common. A search goes down the tree with the differences to these patterns added up
and leaves out a whole group as soon as they exceed the radius. Each node's task passes on one link from a fingerprint to
the smallest document of its local group, not all pairs.

Groups are the connected components of all links, found by alternating large-star and small-star steps, each written in the
shared checkpoint folder.

Defined results: null text counts as empty; texts without words have fingerprint zero and are linked like any other; repeated
rows and equal texts share a fingerprint and a group; a group's id is its smallest doc_id (null only if all of them are);
further columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import itertools
from functools import reduce
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import positional, shipped, written
from .clusters import BLOCK, LOWER, alone, components, edge_batches, in_blocks, local_groups, shingle_hashes, shingles_of, star, whole_groups, within_clusters

SHINGLE, RADIUS = 3, 2
#: Fingerprints under an upper node before its children take over, parts of an inner node of the tree, and fingerprints that are
#: compared without a tree.
NODE, FAN, LEAF = 4096, 16, 32
#: Of ``similar_documents``: fingerprints of a text, bytes of a sketch, standard deviations by which an estimate
#: must be off to rule something out, the part of all shingles (one in ``PART``) of the first count, and standard deviations there.
VIEWS, BINS, SURE, PART, LEFT_SURE = 2, 128, 4, 16, 3
_ONES = np.uint64(0xFFFFFFFFFFFFFFFF)


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """The SimHash of a text; words are runs of anything but ASCII white space, A-Z are lowered."""
    import xxhash

    words = (text or "").encode().translate(LOWER).split()
    n, digest = len(words), xxhash.xxh64_intdigest
    if not n:
        return 0
    set_in, total, step = np.zeros(64, np.int64), max(1, n - shingle + 1), 1 << 16
    for at in range(0, total, step):
        part = words[at : min(at + step, total) + shingle - 1]
        grams = [b" ".join(part)] if n < shingle else map(b" ".join, zip(*(part[i:] for i in range(shingle))))
        h = np.array([digest(g, 42) for g in grams], dtype="<u8")
        set_in += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * set_in > total, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, text_hash and fingerprint (a long of the same 64 bits) of every whole text."""
    shipped(docs.sparkSession)

    def run(batches):
        for b in batches:
            values = np.array([fingerprint(t.as_py(), shingle) for t in b.column("text")], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("text_hash"), pa.array(values)], names=["doc_id", "text_hash", "fingerprint"])

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), "text")
    return own.mapInArrow(run, "doc_id long, text_hash long, fingerprint long")


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


#: By radius: into how many blocks the free bits are cut, and how many of them a mask keeps. All but ``radius`` blocks of a
#: linked pair agree, so some mask keeps only blocks that agree.
BLOCKS = {0: (4, 2), 1: (4, 2), 2: (4, 2), 3: (6, 3), 4: (7, 3), 5: (8, 3), 6: (9, 3), 7: (10, 3)}


def masks(level: int, radius: int = RADIUS) -> list[int]:
    """Masks of the upper nodes of a level (for radius 2: 6, 36 or 216 with 32, 48 or 56 bits); children follow one another."""
    found = [0]
    blocks, keep = BLOCKS[radius]
    for _ in range(level):
        out = []
        for mask in found:
            free = [i for i in range(64) if not mask >> i & 1]
            cuts = [round(len(free) * k / blocks) for k in range(blocks + 1)]
            parts = [free[i:j] for i, j in zip(cuts, cuts[1:])]
            out += [mask | sum(1 << i for part in kept for i in part) for kept in combinations(parts, keep)]
        found = out
    return found


def placed(fps: DataFrame, node: int = NODE, radius: int = RADIUS) -> DataFrame:
    """(mask, bits, fp, rep): every fingerprint under each of its upper nodes, full ones replaced by their children."""
    out, step = [], 1_000_000
    children = comb(*BLOCKS[radius])
    first = F.array(*(F.struct(F.lit(i).alias("mask"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("bits")) for i, m in enumerate(masks(1, radius))))
    keyed = fps.select("fp", "rep", F.explode(first).alias("node")).select((F.col("node.mask") + step).alias("mask"), "node.bits", "fp", "rep")
    for level in (1, 2):
        full = written(keyed.groupBy("mask", "bits").count().where(F.col("count") > node).select("mask", "bits"), f"full-{level}")
        if full.isEmpty():
            return reduce(DataFrame.unionByName, [*out, keyed])
        out.append(keyed.join(full, ["mask", "bits"], "left_anti"))
        # the masks of a level are a fixed list
        table = fps.sparkSession.createDataFrame([(step * level + i // children, step * (level + 1) + i, _signed(m)) for i, m in enumerate(masks(level + 1, radius))], "parent int, mask int, kept long")
        inside = keyed.join(full, ["mask", "bits"], "left_semi").select(F.col("mask").alias("parent"), "fp", "rep")
        keyed = inside.join(F.broadcast(table), "parent").select("mask", F.col("fp").bitwiseAND(F.col("kept")).alias("bits"), "fp", "rep")
    return reduce(DataFrame.unionByName, [*out, keyed])


def gray_rank(x: np.ndarray) -> np.ndarray:
    """Position of each value in the reflected Gray code: the prefix exclusive-or of its bits."""
    x = x.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        x ^= x >> np.uint64(shift)
    return x


class GrayTree:
    """Fingerprints in Gray order, and above them levels of groups of FAN with the bits that all in a group share."""

    def __init__(self, values: np.ndarray):
        self.order = np.argsort(gray_rank(values), kind="stable")
        self.values = values[self.order]
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []  # (mask, pattern), lowest first
        mask, pattern = np.full(len(values), _ONES), self.values
        while len(pattern) > 1:
            starts = np.arange(0, len(pattern), FAN)
            every, some = np.bitwise_and.reduceat(pattern, starts), np.bitwise_or.reduceat(pattern, starts)
            mask = np.bitwise_and.reduceat(mask, starts) & ~(every ^ some)
            pattern = every & mask
            self.levels.append((mask, pattern))

    def within(self, queries: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
        """(query, value) positions with at most ``radius`` differing bits, values in Gray order."""
        q = np.arange(len(queries))
        at = np.zeros(len(queries), np.int64)
        for level in range(len(self.levels) - 1, -1, -1):
            mask, pattern = self.levels[level]
            near = np.bitwise_count((queries[q] ^ pattern[at]) & mask[at]) <= radius  # else the whole group is out
            q, at = q[near], at[near]
            below = len(self.values) if level == 0 else len(self.levels[level - 1][0])
            q = np.repeat(q, FAN)
            at = (at[:, None] * FAN + np.arange(FAN)).ravel()
            q, at = q[at < below], at[at < below]
        near = np.bitwise_count(queries[q] ^ self.values[at]) <= radius
        return q[near], at[near]


def near_pairs(values: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(a, b, differing bits) of the linked pairs among the fingerprints of a node, each pair once."""
    if len(values) <= LEAF:
        a, b = np.triu_indices(len(values), 1)
        bits = np.bitwise_count(values[a] ^ values[b]).astype(np.int64)
        near = bits <= radius
        return a[near], b[near], bits[near]
    tree, found = GrayTree(values), []
    for i in range(0, len(values), 512):
        q, at = tree.within(tree.values[i : i + 512], radius)
        q = q + i
        keep = q < at
        q, at = q[keep], at[keep]
        found.append((tree.order[q], tree.order[at], np.bitwise_count(tree.values[q] ^ tree.values[at]).astype(np.int64)))
    return tuple(np.concatenate(x) for x in zip(*found))


def links(fps: DataFrame, radius: int = RADIUS, node: int = NODE) -> DataFrame:
    """(a, b), a > b: from a fingerprint's rep to the smallest rep of its group under an upper node. fps: fp, rep, one row each."""
    if radius not in (0, 1, 2):
        raise ValueError("radius must be 0, 1 or 2; alike_links takes wider ones")
    shipped(fps.sparkSession)

    def run(batches):
        held: list[np.ndarray] = []

        def close(mask, bits, fp, rep):
            cut = np.flatnonzero((mask[1:] != mask[:-1]) | (bits[1:] != bits[:-1])) + 1
            starts, ends = np.r_[0, cut], np.r_[cut, len(mask)]
            several = ends - starts > 1
            a, b = [], []
            for s, e in zip(starts[several].tolist(), ends[several].tolist()):
                if e - s == 2:
                    if (int(fp[s]) ^ int(fp[s + 1])).bit_count() <= radius:
                        a.append(max(rep[s], rep[s + 1]))
                        b.append(min(rep[s], rep[s + 1]))
                    continue
                own = rep[s:e]
                x, y, _ = near_pairs(fp[s:e], radius)
                low = local_groups(own, x, y)
                a += own[low != own].tolist()
                b += low[low != own].tolist()
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

        for batch in batches:
            columns = [batch.column(c).to_numpy() for c in ("mask", "bits", "fp", "rep")]
            columns[2] = columns[2].view(np.uint64)
            if held:
                columns = [np.concatenate(x) for x in zip(held, columns)]
            if not len(columns[0]):
                continue
            # the last node may go on in the next batch
            other = np.flatnonzero((columns[0] != columns[0][-1]) | (columns[1] != columns[1][-1]))
            last = int(other[-1]) + 1 if len(other) else 0
            if last:
                yield close(*(c[:last] for c in columns))
            held = [c[last:] for c in columns]
        if held and len(held[0]):
            yield close(*held)

    dealt = placed(fps, node, radius).repartition("mask", "bits").sortWithinPartitions("mask", "bits")
    return dealt.mapInArrow(run, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS, node: int = NODE) -> DataFrame:
    """doc_id, text_hash, fingerprint (16 hexadecimal digits) and component_id of every row."""
    prints = written(fingerprints(docs, shingle), "fingerprints")
    # one row for each distinct fingerprint; those of rows without doc_id only cannot name a group
    fps = written(prints.groupBy(F.col("fingerprint").alias("fp")).agg(F.min("doc_id").alias("rep")), "distinct-fingerprints")
    found = components(links(fps.where("rep IS NOT NULL"), radius, node))
    groups = fps.join(found, fps.rep == found.id, "left").select("fp", F.coalesce("component", "rep").alias("component_id"))
    return prints.join(groups, prints.fingerprint == groups.fp).select("doc_id", "text_hash", _hexadecimal("fingerprint"), "component_id")


def _hexadecimal(fingerprint: str):
    return F.lower(F.lpad(F.hex(fingerprint), 16, "0")).alias("fingerprint")


def jaccard(a: str | None, b: str | None, shingle: int) -> float:
    """Share of common shingles of two texts' words (A-Z lowered); shorter texts are one shingle, empty ones are alike."""

    def grams(text):
        w = (text or "").encode().translate(LOWER).split()
        return set(zip(*(w[i:] for i in range(shingle)))) if len(w) >= shingle else {tuple(w)}

    x, y = grams(a), grams(b)
    return len(x & y) / len(x | y)


def word_fingerprints(words: list[bytes]) -> list[int]:
    """``VIEWS`` fingerprints of a text's distinct words, each of bits of its own."""
    import xxhash

    if not words:
        return [0] * VIEWS
    own, out = set(words), []
    h = np.fromiter((xxhash.xxh64_intdigest(w, 42) for w in own), np.uint64, len(own))
    for _ in range(VIEWS):
        set_in = np.unpackbits(h.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        out.append(int(np.packbits(2 * set_in > len(h), bitorder="little").view("<u8")[0]))
        h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return out


def sketch(hashes: np.ndarray) -> bytes:
    """One byte for each of ``BINS`` equal parts of the range of hashes: of the least hash in it, 0 if there is none."""
    out = np.zeros(BINS, np.uint8)
    part, first = np.unique((hashes >> np.uint64(64 - BINS.bit_length() + 1)).astype(np.int64), return_index=True)
    out[part] = hashes[first] % np.uint64(255) + np.uint64(1)
    return out.tobytes()


def alike(a: np.ndarray, b: np.ndarray, similarity: float) -> np.ndarray:
    """Whether the texts of two tables of sketches may be similar: the estimate, parts that agree among those that either text fills,
    is at most ``SURE`` of its standard deviations too low."""
    filled = np.maximum(((a > 0) | (b > 0)).sum(axis=1), 1)
    same = ((a == b) & (a > 0)).sum(axis=1)
    return same / filled >= similarity - SURE * np.sqrt(similarity * (1 - similarity) / filled)


def described(docs: DataFrame, shingle: int) -> DataFrame:
    """doc_id, text_hash, n (distinct shingles), v0, v1 (fingerprints of distinct words), sketch and some (the shingles' hashes in one of ``PART``
    parts of their range) of every whole text."""
    shipped(docs.sparkSession)
    names = ["doc_id", "text_hash", "n", *(f"v{i}" for i in range(VIEWS)), "sketch", "some"]

    def run(batches):
        for b in batches:
            ns, views, sketches, some = [], [], [], []
            for t in b.column("text"):
                words = (t.as_py() or "").encode().translate(LOWER).split()
                h = shingle_hashes(words, shingle)
                ns.append(len(h))
                views.append(word_fingerprints(words))
                sketches.append(sketch(h))
                some.append(h[: np.searchsorted(h, np.uint64((1 << 64) // PART))].view(np.int64))
            of = np.array(views, np.uint64).reshape(-1, VIEWS).view(np.int64)
            columns = [b.column("doc_id"), b.column("text_hash"), pa.array(ns, pa.int32()), *(pa.array(of[:, i]) for i in range(VIEWS)), pa.array(sketches, pa.binary()), pa.array(some, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), "text")
    return own.mapInArrow(run, f"doc_id long, text_hash long, n int, {', '.join(f'v{i} long' for i in range(VIEWS))}, sketch binary, some array<long>")


def alike_links(rows: DataFrame, radius: int, node: int, similarity: float) -> DataFrame:
    """(a, b), a > b: edges that join the same ids as all pairs do whose fingerprints are near, whose n shingles, ``shared`` of which other texts
    have too, allow the similarity, and whose sketches do not rule it out. rows: fp, id, n, shared, sketch.

    In small nodes each pair is looked at in the first node that both are in, in large ones each row once. A node passes on an edge for each id that it joins, not its pairs."""
    shipped(rows.sparkSession)
    blocks, keep = BLOCKS[radius]
    cuts = [round(64 * k / blocks) for k in range(blocks + 1)]
    parts = [np.uint64(sum(1 << i for i in range(s, e))) for s, e in zip(cuts, cuts[1:])]
    last_kept = np.array([kept[-1] for kept in combinations(range(blocks), keep)])
    every = masks(1, radius)

    def chosen(x, y, n, shared, sketches):
        """Which of the pairs of rows x and y count."""
        common = np.minimum(shared[x], shared[y])
        take = common >= similarity * (n[x] + n[y] - common) - 1e-9
        for at in range(0, len(x), 1 << 16):
            own = at + np.flatnonzero(take[at : at + (1 << 16)])
            take[own] = alike(sketches[x[own]], sketches[y[own]], similarity)
        return take

    def small(start, mask, fp, ids, *of):
        """All groups of at most ``LEAF`` rows at once; ``start``: the first row of each row's group."""
        x, y = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for step in range(1, LEAF):
            at = np.flatnonzero(start[step:] == start[:-step])
            if not len(at):
                break
            at = at[np.bitwise_count(fp[at] ^ fp[at + step]) <= radius]
            x, y = [*x, at], [*y, at + step]
        x, y = np.concatenate(x), np.concatenate(y)
        first = meet_here(fp[x] ^ fp[y], mask[x])
        x, y = x[first], y[first]
        near = chosen(x, y, *of)
        yield star(ids, x[near], y[near])

    def meet_here(differ, mask):
        """Whether the first node in which two rows meet, that of the first blocks that agree, is the one of this mask."""
        last = last_kept[mask]
        return sum(((differ & parts[k]) == 0) & (k <= last) for k in range(blocks)) == keep

    def large(mask, fp, ids, *of):
        """One group, breadth first: a row is searched for in the Gray-order tree of those that nothing has reached yet, so rows that are all alike are
        found once each. The tree is made anew when half of it has been reached.

        A row is told with the one that reached it, and only in the first node in which the two meet: there they are joined, by rows between them at least,
        and by induction over the nodes so are all that are alike."""
        in_order = np.argsort(ids, kind="stable")  # in all nodes the same rows come first
        mask, fp, ids, *of = (z[in_order] for z in (mask, fp, ids, *of))
        open_, frontier, tree, step = np.ones(len(fp), bool), np.zeros(0, np.int64), None, 1
        while open_.any():
            inside = np.flatnonzero(open_)
            if tree is None or 2 * len(inside) < len(rows):
                tree, rows = GrayTree(fp[inside]), inside
            seeds = not len(frontier)
            q, frontier = (inside[:step], frontier) if seeds else (frontier[:step], frontier[step:])
            x, y = tree.within(fp[q], radius)
            x, y = q[x], rows[tree.order[y]]
            keep = open_[y] & (x != y)
            if seeds:
                open_[q] = False
            x, y = x[keep], y[keep]
            near = chosen(x, y, *of)
            x, y = x[near], y[near]
            if seeds and len(q) > 1:
                yield star(ids, x, y)
            found, by = np.unique(y, return_index=True)
            if not seeds or len(q) == 1:
                p = x[by]
                first = meet_here(fp[p] ^ fp[found], mask[p])
                yield np.maximum(ids[p], ids[found])[first], np.minimum(ids[p], ids[found])[first]
            found = found[open_[found]]
            open_[found] = False
            frontier = np.concatenate([frontier, found])
            step = min(512, 2 * step) if len(x) <= 8 * step else 1

    def pairs(batches):
        for (mask, bits, i, j, side, fp, ids, n, shared, sketches), starts, ends in whole_groups(batches, ["mask", "bits", "i", "j", "side", "fp", "id", "n", "shared", "sketch"], 4):
            sizes = ends - starts
            few = (sizes <= LEAF) & (i[starts] == j[starts])
            rows_of = np.flatnonzero(np.repeat(few & (sizes > 1), sizes))
            table = lambda at: np.frombuffer(b"".join(sketches[at]), np.uint8).reshape(-1, BINS)  # noqa: E731, B023
            columns = [mask, fp.view(np.uint64), ids, n, shared]
            if len(rows_of):
                yield from small(np.repeat(starts, sizes)[rows_of], *(z[rows_of] for z in columns), table(rows_of))
            for s, e in zip(starts[~few].tolist(), ends[~few].tolist()):
                yield from large(*(z[s:e] for z in columns), table(np.arange(s, e)))

    def run(batches):
        yield from edge_batches(pairs(batches))

    under = F.array(*(F.struct(F.lit(k).alias("mask"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("bits")) for k, m in enumerate(every)))
    keyed = rows.withColumn("k", F.explode(under)).select("k.mask", "k.bits", *rows.columns)
    full = keyed.groupBy("mask", "bits").count().where(F.col("count") > node).select("mask", "bits", F.ceil(F.col("count") / node).cast("int").alias("blocks"))
    full = written(full, "full-nodes")
    dealt = keyed.select("*", *(F.lit(0).alias(c) for c in ("i", "j", "side"))) if full.isEmpty() else in_blocks(keyed, ["mask", "bits"], full)
    keys = ["mask", "bits", "i", "j"]
    return dealt.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, "a long, b long")


def similar_documents(docs: DataFrame, shingle: int = 5, similarity: float = 0.8, radius: int = 7, node: int = NODE, block: int = BLOCK) -> DataFrame:
    """doc_id, text_hash, fingerprint (of distinct words, the first view), component_id; texts are linked if their fingerprints of one of ``VIEWS``
    views differ in at most ``radius`` bits and the Jaccard similarity of their shingles is at least ``similarity``. Equal texts always are.

    Texts with more than the share 1 - ``similarity`` of shingles that no other text has cannot be similar to any and are not indexed; this is counted
    for a part of all shingles first (texts over the share by ``LEFT_SURE`` standard deviations go), then exactly among the texts left. So a group of
    many copies, each with changes of its own, does not meet. Each view has an index of its own. Texts that it joins, by near fingerprints
    and sketches that do not rule the similarity out, form clusters, within which links are confirmed exactly (``clusters.within_clusters``). Neither
    step passes on pairs, only the edges that join the same texts, and what is joined is not compared again."""
    prints = written(described(docs, shingle), "fingerprints")
    views = [f"v{i}" for i in range(VIEWS)]
    kinds = prints.groupBy("text_hash").agg(F.min("doc_id").alias("rep"), *(F.first(c).alias(c) for c in ("n", "sketch", "some", *views)))
    # numbers once written stay; being small, they shuffle cheaper than hashes
    kinds = written(kinds.withColumn("id", F.monotonically_increasing_id()), "distinct-texts")
    some, most = F.col("some_n"), 1 - similarity
    # merged at every size: how large these tables are depends on how much of the corpus is copied
    left = kinds.select("id", "rep", F.col("text_hash").alias("h"), "n", F.size("some").alias("some_n")).join(alone(kinds.select("id", F.explode("some").alias("h"))).hint("merge"), "id", "left")
    left = left.where(F.coalesce("alone", F.lit(0)) <= most * some + LEFT_SURE * F.sqrt(most * similarity * some))
    left = written(left.select("id", "rep", "h", "n"), "left")
    # only the first document with a text meets it, however many have it
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), "text")
    texts = texts.join(left.hint("merge"), F.col("doc_id").eqNullSafe(F.col("rep")) & (F.col("text_hash") == F.col("h"))).groupBy("id").agg(F.first("text").alias("text"))
    texts = written(texts, "left-texts")
    shared = left.select("id", "n").join(alone(shingles_of(texts, shingle)).hint("merge"), "id", "left").select("id", (F.col("n") - F.coalesce("alone", F.lit(0))).cast("int").alias("shared"), "n")
    own = kinds.select("id", "sketch", *views).join(shared.where(F.col("shared") >= similarity * F.col("n") - 1e-9).hint("merge"), "id")
    own = written(own.select("id", "n", "shared", "sketch", *views), "indexed")
    edges = reduce(DataFrame.unionByName, (alike_links(own.select(F.col(v).alias("fp"), "id", "n", "shared", "sketch"), radius, node, similarity) for v in views))
    clusters = components(edges)
    members = own.select("id", "n").join(clusters.withColumnRenamed("component", "cluster"), "id").join(texts, "id")
    found = within_clusters(written(members.select("cluster", "id", "n", "text"), "cluster-members"), shingle, similarity, block)
    groups = kinds.join(found, "id", "left").select("text_hash", "rep", F.coalesce("component", "id").alias("c"))
    lowest = groups.groupBy("c").agg(F.min("rep").alias("component_id"))
    groups = groups.join(lowest, "c").select("text_hash", "component_id")
    return prints.select("doc_id", "text_hash", F.col("v0").alias("fingerprint")).join(groups, "text_hash").select("doc_id", "text_hash", _hexadecimal("fingerprint"), "component_id")


def one_of_each_group(docs: DataFrame, groups: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, given its ``near_duplicates`` or ``similar_documents``: of each group the one with the smallest doc_id. Where rows share that doc_id, the one
    with the smallest text hash stays, and of wholly equal texts one row; of a group without any doc_id one row stays as well. All columns stay, whatever their names."""
    own, c = positional(docs)
    id_, hash_ = F.col(c["doc_id"]).cast("long"), F.xxhash64(c["text"])
    stays = groups.where("doc_id <=> component_id").groupBy("doc_id", F.when(F.col("doc_id").isNull(), F.col("fingerprint")).alias("alone")).agg(F.min("text_hash").alias("_s"))
    stays = written(stays.select(F.col("doc_id").alias("_d"), "_s").distinct(), "stays")
    kept = own.join(stays.hint("merge"), id_.eqNullSafe(stays["_d"]) & hash_.eqNullSafe(stays["_s"]), "left_semi")
    # only rows of equal doc_id and text, if there are any, have to meet once more
    again = written(groups.groupBy("doc_id", "text_hash").count().where("count > 1").select(F.col("doc_id").alias("_d"), F.col("text_hash").alias("_s")), "again")
    if not again.isEmpty():
        same = id_.eqNullSafe(again["_d"]) & hash_.eqNullSafe(again["_s"])
        one = kept.join(again, same, "left_semi").dropDuplicates([c["doc_id"], c["text"]])
        kept = kept.join(again, same, "left_anti").unionByName(one)
    return kept.select(*(F.col(at).alias(name) for name, at in c.items()))
