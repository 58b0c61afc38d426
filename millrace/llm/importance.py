"""Operator 12: importance resampling towards a target distribution, features found by Aho-Corasick dictionaries.

Features are runs of one to three words, hashed into buckets by CRC-32. No run is ever built as a string: each distinct word of a batch of
texts goes into an automaton, bounded by delimiters on both sides, and carries its number as a payload, through which it has the CRC of the word, that of the
word after a space, and its length. A scan of the batch emits the payloads in order; as CRC-32 is linear, the CRC of two adjacent pieces
follows from their CRCs and the length of the second (``shifted``), so composing neighbours gives the buckets of all runs in array operations.
A dictionary holds the words of one batch of bounded size, so nothing grows with the vocabulary of the corpus.

Two passes over the texts: the first counts buckets, as one array a task, merged by a sum for each bucket; the gains of the buckets (a table
whose size is the number of buckets) go with the second, which adds them up for each document. Scores are weights plus Gumbel noise from a
hash of seed and doc_id, so the highest scores are a draw without replacement in proportion to the exponent of the weight. Ranks come from a
range-dealt sort.

Defined results: A-Z are lowered; words are runs of digits, a-z and characters beyond ASCII; null and empty texts have no features and weight
0; a null doc_id is hashed as the seed and ":" alone and loses ties; repeated rows are rows of their own (equal scores, ranks in any order
among them); an empty target gives gains by the corpus alone; further columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterable, Iterator
from functools import lru_cache
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..tables import ranked
from ._common import shipped, written

BUCKETS, ORDER = 10_000, 3
SEED, PERCENT, LEAST_WORDS = 42, 5, 20
#: Bytes of text that share a dictionary.
BATCH = 1 << 23
#: Bytes as they are scanned: A-Z lowered, delimiters as spaces.
SCANNED = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


@lru_cache(maxsize=None)
def _byte_step() -> np.ndarray:
    """The linear map of a CRC register by one zero byte, as tables for each of its four bytes."""
    crc = [0] * 256
    for b in range(256):
        x = b
        for _ in range(8):
            x = x >> 1 ^ (0xEDB88320 if x & 1 else 0)
        crc[b] = x
    step = np.array([(v >> 8) ^ crc[v & 255] for k in range(4) for v in (b << 8 * k for b in range(256))], np.uint32)
    return step.reshape(4, 256)


def _apply(tables: np.ndarray, x: np.ndarray) -> np.ndarray:
    return tables[0][x & 255] ^ tables[1][x >> 8 & 255] ^ tables[2][x >> 16 & 255] ^ tables[3][x >> 24]


@lru_cache(maxsize=4096)
def zero_bytes(n: int) -> np.ndarray:
    """The tables (4 x 256) that take the CRC of a string to its part in the CRC of that string followed by ``n`` bytes."""
    if n == 0:
        return (np.arange(256, dtype=np.uint32)[None, :] << (np.arange(4, dtype=np.uint32) * 8)[:, None]).astype(np.uint32)
    if n == 1:
        return _byte_step()
    half = zero_bytes(n // 2)
    twice = _apply(half, half)
    return _apply(_byte_step(), twice) if n % 2 else twice


def shifted(crc: np.ndarray, tables: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Each CRC carried over as many bytes as its row's table (``tables[at]``) is for."""
    return tables[at, 0, crc & 255] ^ tables[at, 1, crc >> 8 & 255] ^ tables[at, 2, crc >> 16 & 255] ^ tables[at, 3, crc >> 24]


def words_found(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """(payloads of the words of all texts in order, number of words of each text, dictionary); texts as ``SCANNED``."""
    import ahocorasick

    # one character a byte, so that lengths are those of UTF-8; a line feed, no character of a word, ends a text
    whole = " \n ".join(["", *(t.decode("latin-1") for t in texts), ""])
    words = list(dict.fromkeys(whole.split(" ")).keys() - {"", "\n"})
    automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
    automaton.add_word(" \n ", -1)
    for k, w in enumerate(words):
        automaton.add_word(f" {w} ", k)
    automaton.make_automaton()
    found = np.fromiter(map(itemgetter(1), automaton.iter(whole)), np.int32)
    counts = np.diff(np.flatnonzero(found < 0)) - 1
    return found[found >= 0], counts, words


def runs(payloads: np.ndarray, counts: np.ndarray, words: list[str], order: int = ORDER) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each length of a run: the CRC of each run of that many words within a text, and the number of its text."""
    if not len(payloads):
        return
    raw = [w.encode("latin-1") for w in words]
    alone = np.fromiter(map(zlib.crc32, raw), np.uint32, len(raw))
    spaced = np.fromiter((zlib.crc32(w, 0xE96CCF45) for w in raw), np.uint32, len(raw))  # 0xE96CCF45: the CRC of a space
    lengths, table_of = np.unique(np.fromiter(map(len, raw), np.int64, len(raw)), return_inverse=True)
    tables = np.stack([zero_bytes(int(n) + 1) for n in lengths])
    of = np.repeat(np.arange(len(counts)), counts)
    crc = alone[payloads]
    yield crc, of
    for k in range(1, order):
        end = payloads[k:]
        crc = shifted(crc[: len(end)], tables, table_of[end]) ^ spaced[end]
        whole = of[k:] == of[: len(of) - k]
        yield crc[whole], of[k:][whole]


def texts_in(batches: Iterable[pa.RecordBatch], column: str = "text", limit: int = BATCH) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Slices of record batches with their texts as they are scanned, of about ``limit`` bytes each."""
    for b in batches:
        start, size, texts = 0, 0, []
        for k, t in enumerate(b.column(column)):
            own = (t.as_py() or "").encode().translate(SCANNED)
            texts.append(own)
            size += len(own)
            if size >= limit:
                yield b.slice(start, k + 1 - start), texts
                start, size, texts = k + 1, 0, []
        if texts:
            yield b.slice(start), texts


def bucket_counts(docs: DataFrame, name: str, buckets: int = BUCKETS, order: int = ORDER) -> DataFrame:
    """(bucket, ``name``): how many features of all texts fall into each bucket that has any."""
    shipped(docs.sparkSession)

    def run(batches):
        total = np.zeros(buckets, np.int64)
        for _, texts in texts_in(batches):
            for crc, _ in runs(*words_found(texts), order):
                total += np.bincount(crc % np.uint32(buckets), minlength=buckets)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(total[some])], names=["bucket", "n"])

    return docs.select("text").mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias(name))


def gains(corpus: DataFrame, target: DataFrame, buckets: int = BUCKETS, order: int = ORDER) -> np.ndarray:
    """The gain of each bucket: 1000 times the logarithm of how much likelier the target is to give it, both smoothed by one. What comes to
    the driver is a row for each bucket."""
    rows = bucket_counts(corpus, "s", buckets, order).join(bucket_counts(target, "t", buckets, order), "bucket", "full").toPandas()
    s, t = np.zeros(buckets), np.zeros(buckets)
    s[rows["bucket"]], t[rows["bucket"]] = rows["s"].fillna(0), rows["t"].fillna(0)
    all_s, all_t = float(s.sum()), float(t.sum())
    return np.array([math.floor(1000 * math.log((y + 1) * (all_s + buckets) / ((x + 1) * (all_t + buckets)))) for x, y in zip(s.tolist(), t.tolist())], np.int64)


def weights(docs: DataFrame, gain: np.ndarray, order: int = ORDER) -> DataFrame:
    """doc_id, n_words, n_features and weight of every whole text."""
    shipped(docs.sparkSession)
    buckets = len(gain)

    def run(batches):
        for b, texts in texts_in(batches):
            payloads, counts, words = words_found(texts)
            total, features = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
            for crc, of in runs(payloads, counts, words, order):
                before = np.concatenate([[0], np.cumsum(gain[crc % np.uint32(buckets)])])
                n = np.bincount(of, minlength=len(texts))
                ends = np.cumsum(n)
                total += before[ends] - before[ends - n]
                features += n
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(counts), pa.array(features), pa.array(total)], names=["doc_id", "n_words", "n_features", "weight"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_words long, n_features long, weight long")


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int = SEED, buckets: int = BUCKETS, order: int = ORDER) -> DataFrame:
    """doc_id, n_features, weight, score and rank of every row; rank is null for those that are not drawn."""
    rows = weights(docs, gains(docs, target, buckets, order), order)
    noise = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    rows = written(rows.withColumn("score", F.col("weight") + F.floor(-1000 * F.log(-F.log((noise + 0.5) / 4294967296.0)))), "weights")
    open_ = rows.where(F.col("n_words") >= least_words)
    drawn = open_.count() * percent // 100
    placed = ranked(open_, [F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("n_features"), F.asc("weight")], "position", "scores")
    out = placed.unionByName(rows.where(F.col("n_words") < least_words).withColumn("position", F.lit(None).cast("long")))
    rank = F.when(F.col("position") < drawn, F.col("position") + 1)
    return out.select("doc_id", "n_features", "weight", "score", rank.alias("rank"))


#: The same rows by SQL, with the CRC of each feature from its bytes.
ORACLE = r"""
WITH bits AS (SELECT list_transform(range(256), lambda b: list_reduce([b::BIGINT, 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, CASE WHEN x & 1 = 1 THEN 3988292384 ELSE 0 END))) AS crc),
w AS (
    SELECT from_target, id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words
    FROM (SELECT false AS from_target, doc_id AS id, text FROM documents UNION ALL SELECT true, item_id, text FROM benchmark)),
f AS MATERIALIZED (
    SELECT from_target, id, unnest(list_concat(words, list_transform(range(1, len(words)), lambda i: words[i] || ' ' || words[i + 1]),
        list_transform(range(1, len(words) - 1), lambda i: words[i] || ' ' || words[i + 1] || ' ' || words[i + 2]))) AS g FROM w),
c AS MATERIALIZED (SELECT from_target, id, g, count(*) AS k FROM f GROUP BY ALL),
h AS MATERIALIZED (
    SELECT g, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(octet_length(encode(g))), lambda i: ('0x' || hex(encode(g))[2 * i + 1:2 * i + 2])::BIGINT)),
        lambda x, b: xor(crc[(xor(x, b) & 255) + 1], x >> 8)), 4294967295) % 10000 AS bucket FROM (SELECT DISTINCT g FROM c), bits),
b AS (SELECT bucket, coalesce(sum(k) FILTER (NOT from_target), 0)::DOUBLE AS s, coalesce(sum(k) FILTER (from_target), 0)::DOUBLE AS t FROM c JOIN h USING (g) GROUP BY bucket),
gain AS (SELECT bucket, floor(1000 * ln((t + 1) * ((SELECT sum(s) FROM b) + 10000) / ((s + 1) * ((SELECT sum(t) FROM b) + 10000))))::BIGINT AS gain FROM b),
score AS (
    SELECT doc_id, n, coalesce(n_features, 0)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight,
        coalesce(weight, 0)::BIGINT + floor(-1000 * ln(-ln((('0x' || sha256('42:' || doc_id)[1:8])::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score
    FROM (SELECT id AS doc_id, len(words) AS n FROM w WHERE NOT from_target)
    LEFT JOIN (SELECT id AS doc_id, sum(k) AS n_features, sum(k * gain) AS weight FROM c JOIN h USING (g) JOIN gain USING (bucket) WHERE NOT from_target GROUP BY id) USING (doc_id))
SELECT doc_id, n_features, weight, score, CASE WHEN n >= 20 AND place <= floor(5 * (SELECT count(*) FROM score WHERE n >= 20) / 100) THEN place END AS rank
FROM (SELECT *, row_number() OVER (PARTITION BY n >= 20 ORDER BY score DESC, doc_id) AS place FROM score)
"""
