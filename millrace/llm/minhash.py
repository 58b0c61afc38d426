"""Operator 11: MinHash near-duplicates by one-permutation hashing.

A text's set is that of its word shingles. One hash function deals a set's hashes into ``BINS`` bins by their leading bits, and the least of
each bin is kept. An empty bin takes the value of a filled one, found by probing bins in an order of its own (optimal densification:
each empty bin draws its donor by itself), so small sets give ``BINS`` values as large ones do. Values are banded; texts with equal bands
share a bucket.

A bucket passes on *star-shaped* edges only, from each member to its smallest: as many edges as members. The components of these
edges are clusters, and links are confirmed on full sets within a cluster (``within_clusters``): two texts that share any bucket are in one
cluster, so stars lose no pair that all pairs of the bucket would give. ``ROWS`` and ``BANDS`` are such that two sets of
similarity 0.8 miss one another in all bands with probability (1 - 0.8^4)^32 = 5e-8.

Defined results: A-Z are lowered; a text of fewer words than a shingle is one shingle; null, empty and wordless texts have no set and are linked
with nothing; equal sets are one class; a component's id is its smallest doc_id (null if all of them are null, and each such row without a
set is its own); repeated rows each give a row; further columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import shipped, written
from .clusters import LOWER, components, shingle_hashes, within_clusters

SHINGLE, SIMILARITY = 4, 0.8
BINS, ROWS = 128, 4
BANDS = BINS // ROWS
_EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads each bit over all."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@lru_cache(maxsize=4)
def donors(bins: int) -> np.ndarray:
    """For each bin (row) all bins in the order in which it probes them when it is empty."""
    keys = mixed(np.arange(bins * bins, dtype=np.uint64) + np.uint64(0x9E3779B97F4A7C15))
    return np.argsort(keys.reshape(bins, bins), axis=1, kind="stable")


def signature(hashes: np.ndarray, bins: int = BINS) -> np.ndarray:
    """One value for each bin, of a set's sorted distinct hashes (at least one); ``bins`` is a power of two."""
    out = np.full(bins, _EMPTY)
    at, first = np.unique((hashes >> np.uint64(64 - bins.bit_length() + 1)).astype(np.int64), return_index=True)
    out[at] = hashes[first]
    filled = np.zeros(bins, bool)
    filled[at] = True
    empty = np.flatnonzero(~filled)
    if len(empty):
        order = donors(bins)[empty]
        out[empty] = out[order[np.arange(len(empty)), filled[order].argmax(axis=1)]]
    return out


def bands(values: np.ndarray, rows: int = ROWS) -> np.ndarray:
    """A key for each band: its number and its values, hashed."""
    parts = values.reshape(-1, rows)
    key = np.arange(len(parts), dtype=np.uint64)
    for k in range(rows):
        key = mixed(key * np.uint64(0x9E3779B97F4A7C15) + parts[:, k])
    return key


def described(docs: DataFrame, shingle: int = SHINGLE, bins: int = BINS, rows: int = ROWS) -> DataFrame:
    """doc_id, text_hash, k1, k2 (128 bits that name the set; null without one), n (its size) and bands of every whole text."""
    import xxhash

    shipped(docs.sparkSession)

    def run(batches):
        for b in batches:
            k1, k2, ns, keys = [], [], [], []
            for t in b.column("text"):
                words = (t.as_py() or "").encode().translate(LOWER).split()
                if not words:
                    k1.append(None), k2.append(None), ns.append(0), keys.append(None)
                    continue
                h = shingle_hashes(words, shingle)
                own = h.tobytes()
                k1.append(xxhash.xxh64_intdigest(own, 1) - (1 << 63))
                k2.append(xxhash.xxh64_intdigest(own, 2) - (1 << 63))
                ns.append(len(h))
                keys.append(bands(signature(h, bins), rows).view(np.int64))
            columns = [b.column("doc_id"), b.column("text_hash"), pa.array(k1, pa.int64()), pa.array(k2, pa.int64()), pa.array(ns, pa.int64()), pa.array(keys, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "text_hash", "k1", "k2", "n", "bands"])

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), "text")
    return own.mapInArrow(run, "doc_id long, text_hash long, k1 long, k2 long, n long, bands array<long>")


def candidate_stars(kinds: DataFrame) -> DataFrame:
    """(a, b), a > b: from each member of a bucket to its smallest. kinds: id, bands."""
    keyed = kinds.select("id", F.explode("bands").alias("key"))
    shared = keyed.groupBy("key").agg(F.min("id").alias("low"), F.count("*").alias("members")).where("members > 1").select("key", "low")
    return keyed.join(shared.hint("merge"), "key").where("id <> low").select(F.col("id").alias("a"), F.col("low").alias("b")).distinct()


def similar_sets(docs: DataFrame, shingle: int = SHINGLE, similarity: float = SIMILARITY, bins: int = BINS, rows: int = ROWS) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row; sets of Jaccard similarity ``similarity`` or more are linked."""
    prints = written(described(docs, shingle, bins, rows), "minhash")
    kinds = prints.where("n > 0").groupBy("k1", "k2").agg(F.min("doc_id").alias("rep"), F.min_by("text_hash", F.coalesce("doc_id", F.lit(1 << 62))).alias("h"), F.first("n").alias("n"), F.first("bands").alias("bands"))
    kinds = written(kinds.withColumn("id", F.monotonically_increasing_id()), "distinct-sets")
    clusters = written(components(candidate_stars(kinds)).withColumnRenamed("component", "cluster"), "clusters")
    near = kinds.select("id", "n", "rep", "h").join(clusters.hint("merge"), "id")
    # a text for each set: that of one document that has it
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), "text")
    texts = texts.join(near.hint("merge"), F.col("doc_id").eqNullSafe(F.col("rep")) & (F.col("text_hash") == F.col("h")))
    members = written(texts.groupBy("id").agg(F.first("cluster").alias("cluster"), F.first("n").alias("n"), F.first("text").alias("text")), "cluster-texts")
    found = within_clusters(members, shingle, similarity)
    groups = kinds.join(found.hint("merge"), "id", "left").select("k1", "k2", "rep", F.coalesce("component", "id").alias("c"))
    lowest = groups.groupBy("c").agg(F.min("rep").alias("component_id"))
    groups = written(groups.join(lowest, "c").select(F.col("k1").alias("g1"), F.col("k2").alias("g2"), "component_id"), "groups")
    own = prints.select("doc_id", F.col("n").alias("n_shingles"), "k1", "k2")
    joined = own.where("k1 IS NOT NULL").join(groups, (F.col("k1") == F.col("g1")) & (F.col("k2") == F.col("g2"))).select("doc_id", "n_shingles", "component_id")
    return joined.unionByName(own.where("k1 IS NULL").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))).withColumn("kept", F.expr("doc_id <=> component_id"))


#: The same rows by plain SQL: an inverted index of shingles, and components by a recursive query.
ORACLE = r"""
WITH RECURSIVE w AS MATERIALIZED (
    SELECT doc_id, string_split_regex(trim(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13), 'abcdefghijklmnopqrstuvwxyz     ')), ' +') AS words FROM documents),
s AS MATERIALIZED (
    SELECT DISTINCT doc_id, unnest(CASE WHEN words = [''] THEN []::VARCHAR[] WHEN len(words) < 4 THEN [array_to_string(words, ' ')]
        ELSE list_transform(range(1, len(words) - 2), lambda i: array_to_string(words[i:i + 3], ' ')) END) AS g FROM w),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
common AS MATERIALIZED (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
links AS MATERIALIZED (SELECT a, b FROM common JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
edges AS MATERIALIZED (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT DISTINCT a AS id, a AS other FROM edges UNION SELECT id, b FROM reach JOIN edges ON a = other),
low AS MATERIALIZED (SELECT id, min(other) AS component_id FROM reach GROUP BY id)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, coalesce(component_id, d.doc_id)::BIGINT AS component_id, coalesce(component_id, d.doc_id) = d.doc_id AS kept
FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN low ON low.id = d.doc_id
"""
