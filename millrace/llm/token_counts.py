"""Operator 4: token counts by heap-and-linked-list byte-pair merging.

A pre-token starts as a doubly linked list of byte symbols. A heap holds the ranks of adjacent pairs; the lowest is popped
again and again, merged if it is still there, and its two new neighbour pairs are pushed. The count is the number of initial
symbols less the number of merges; token ids are never built. Counts of words are cached within a bound.

Defined results: null text counts as empty (0 bytes, 0 tokens); special strings count as one token each, as the library's
default has it; repeated rows each give a row; further columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from functools import lru_cache
from heapq import heapify, heappop, heappush

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bpe_tables
from ._common import TwoGenerations, shipped

#: Words of up to so many bytes are cached, and so many of them at most in a worker.
CACHED_BYTES, CACHED = 256, 250_000


def merges(data: bytes, table: bpe_tables.MergeTable) -> int:
    """Number of merges that byte-pair encoding makes in one pre-token."""
    n, rules = len(data), table.merges
    if n < 2:
        return 0
    symbol = list(map(table.first.__getitem__, data))
    symbol[-1] = table.last[data[-1]]
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    heap = [(r >> 32) * n + i for i, (a, b) in enumerate(zip(symbol, symbol[1:])) if (r := rules.get(a << 32 | b)) is not None]
    heapify(heap)
    done = 0
    while heap:
        rank, i = divmod(heappop(heap), n)
        j = after[i]
        if symbol[i] < 0 or j >= n or (rule := rules.get(symbol[i] << 32 | symbol[j])) is None or rule >> 32 != rank:
            continue  # one of the two was merged meanwhile
        symbol[i], symbol[j] = rule & 0xFFFFFFFF, -1
        after[i] = k = after[j]
        done += 1
        if k < n:
            before[k] = i
            if (rule := rules.get(symbol[i] << 32 | symbol[k])) is not None:
                heappush(heap, (rule >> 32) * n + i)
        if (k := before[i]) >= 0 and (rule := rules.get(symbol[k] << 32 | symbol[i])) is not None:
            heappush(heap, (rule >> 32) * n + k)
    return done


class Counter:
    def __init__(self, table: bpe_tables.MergeTable):
        self.table = table
        self.piece = TwoGenerations(self._piece, CACHED, CACHED_BYTES)
        self.word = TwoGenerations(lambda w: self._text(w.decode()), CACHED, CACHED_BYTES)

    def _piece(self, piece: str) -> int:
        data = piece.encode()
        return len(data) - merges(data, self.table)

    def _text(self, text: str) -> int:
        pieces = self.table.pieces(self.table.fold(text))
        return sum(map(self.piece.__getitem__, pieces))

    def count(self, text: str) -> int:
        total = 0
        for special, part in self.table.segments(text):
            if special:
                total += 1
            elif self.table.drops_space:
                # no pre-token holds white space, so words between ASCII spaces are independent
                total += sum(map(self.word.__getitem__, part.encode().split()))
            else:
                total += self._text(part)
        return total


@lru_cache(4)
def counter(path: str) -> Counter:
    return Counter(bpe_tables.load(path))


def count_tokens(docs: DataFrame, path: str, limit: int = 2048) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every whole text."""

    def run(batches):
        c = counter(path)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("n_bytes"), pa.array([c.count(t.as_py()) for t in b.column("text")], pa.int64())], names=["doc_id", "n_bytes", "n_tokens"])

    shipped(docs.sparkSession)
    text = F.coalesce(F.col("text"), F.lit(""))
    return (
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.octet_length(text).cast("long").alias("n_bytes"), text.alias("text"))
        .mapInArrow(run, "doc_id long, n_bytes long, n_tokens long")
        .withColumn("over_limit", F.col("n_tokens") > limit)
    )
