"""Operator 1: BPE encoding and decoding as streaming transducers.

Every pre-token goes through ``Transducer``: bytes in, tokens out once they are stable. The merge list's *sufficient lookahead*
(``bpe_tables.sufficient_lookahead``, computed from the merges) says how many bytes beyond a position settle the token
boundaries before it; tokens that end at least that far before the end of what has arrived leave, the rest is held, and the end of
the pre-token releases it. So a transducer holds a window of a few lookaheads, whatever a pre-token's length. Texts are read in
stretches cut at spaces where a pre-token ends, ids leave in blocks, and caches of what the transducer gave for short pre-tokens and words
stand before it, bounded in number and length.

Decoding feeds ids into ``ByteToText``, an incremental UTF-8 state machine that keeps at most three bytes; malformed bytes
become U+FFFD as in the tokenizers library.

Defined results: null text counts as empty (no ids; both digests those of the empty string; ``encode_documents`` gives an empty list);
null ids decode to null; repeated rows each give a row; further columns are ignored by ``digests`` and kept by the others,
whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

import codecs
import hashlib
from array import array
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import islice, repeat
from operator import or_

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bpe_tables
from ._common import TwoGenerations, shipped

#: Characters of a stretch of text that is read at once, and entries of each cache of a worker.
STRETCH, CACHED = 65_536, 250_000
#: In place of a rank: no rule for this pair.
_NONE = 1 << 62


class _Irregular(Exception):
    """A run of white space at a cut between words: the text has to be cut by the pattern itself."""


class Transducer:
    """One pre-token after another: ``feed`` takes its bytes in parts of any size and gives the tokens that are stable by then,
    ``finish`` the others. What is held is bounded by the lookahead and the size of a part."""

    def __init__(self, encoder: Encoder):
        self.encoder, self.ahead, self.held = encoder, encoder.table.lookahead, b""

    def feed(self, part: bytes) -> list[int]:
        self.held += part
        if len(self.held) <= 2 * self.ahead:
            return []
        lengths, at, done = self.encoder.table.token_bytes, 0, []
        for token in self.encoder.merge_bytes(self.held, ends=False):
            end = at + len(lengths[token])
            if end + self.ahead > len(self.held):
                break
            at = end
            done.append(token)
        self.held = self.held[at:]
        return done

    def finish(self) -> list[int]:
        rest, self.held = self.held, b""
        return self.encoder.merge_bytes(rest)


class Encoder:
    """Text to blocks of token ids (little-endian unsigned 32-bit)."""

    def __init__(self, table: bpe_tables.MergeTable):
        self.table = table
        self.piece = TwoGenerations(lambda piece: b"".join(map(_pack, self.stream_piece([piece.encode()]))), CACHED)
        self.word = TwoGenerations(self._encode_word, CACHED)
        self.high = [i << 32 for i in table.first]
        self.transducer = Transducer(self)

    def merge(self, symbols: list[int], ranks: list[int]) -> list[int]:
        """All merges of one bounded window: the lowest rank first, and of that rank from left to right."""
        get = self.table.merges.get
        while ranks and (best := min(ranks)) != _NONE:
            i = ranks.index(best)
            made = best & 0xFFFFFFFF
            symbols[i : i + 2] = [made]
            del ranks[i]
            if i:
                ranks[i - 1] = get(symbols[i - 1] << 32 | made, _NONE)
            if i < len(ranks):
                ranks[i] = get(made << 32 | symbols[i + 1], _NONE)
        return symbols

    def merge_bytes(self, data: bytes, ends: bool = True) -> list[int]:
        symbols = list(map(self.table.first.__getitem__, data))
        if ends and data:
            symbols[-1] = self.table.last[data[-1]]
        pairs = map(or_, map(self.high.__getitem__, data), symbols[1:])
        return self.merge(symbols, list(map(self.table.merges.get, pairs, repeat(_NONE))))

    def _encode_word(self, word: str) -> bytes:
        """What stands between two single spaces, the first of which belongs to it."""
        if not word or word[0].isspace() or word[-1].isspace():
            raise _Irregular
        return b"".join(map(self.piece.__getitem__, self.table.pieces(f" {word}")))

    def stream_piece(self, parts: Iterable[bytes]) -> Iterator[list[int]]:
        """Tokens of one pre-token that arrives in parts of any size."""
        window = 2 * self.table.lookahead
        for part in parts:
            for at in range(0, len(part), window):
                yield self.transducer.feed(part[at : at + window])
        yield self.transducer.finish()

    def _running(self, text: str) -> Iterator[bytes]:
        """Ids of a text pre-token by pre-token; those too long for the cache leave window by window."""
        spans, longest = self.table.spans(text), self.piece.longest
        while some := list(islice(spans, STRETCH)):
            for a, b in some:
                if b - a <= longest:
                    yield self.piece[text[a:b]]
                else:
                    yield from map(_pack, self.stream_piece(text[i : min(b, i + STRETCH)].encode() for i in range(a, b, STRETCH)))

    def _stretches(self, text: str) -> Iterator[str]:
        """The text cut before single spaces between words, where no pre-token goes on."""
        at = 0
        while len(text) - at > STRETCH:
            cut = text.rfind(" ", at + 1, at + STRETCH)
            while cut > at and (text[cut - 1].isspace() or text[cut + 1].isspace()):
                cut = text.rfind(" ", at + 1, cut)
            if cut <= at:
                break
            yield text[at:cut]
            at = cut
        yield text[at:]

    def blocks(self, text: str) -> Iterator[bytes]:
        """The ids of a whole text, in blocks."""
        t = self.table
        for special, part in t.segments(text):
            if special:
                yield _pack([t.special[part]])
                continue
            for stretch in self._stretches(t.fold(part)):
                first, *words = stretch.split(" ")
                try:
                    if first[-1:].isspace() or len(stretch) > STRETCH:
                        raise _Irregular
                    yield b"".join(map(self.piece.__getitem__, t.pieces(first))) + b"".join(map(self.word.__getitem__, words))
                except _Irregular:
                    yield from self._running(stretch)


def _pack(ids: list[int]) -> bytes:
    return array("I", ids).tobytes()


class ByteToText:
    """Token ids to text: bytes of each token go through an incremental UTF-8 decoder; a cut character waits for its rest."""

    def __init__(self, table: bpe_tables.MergeTable):
        self.token_bytes = table.token_bytes
        self.state = codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, ids: Iterable[int]) -> str:
        return self.state.decode(b"".join(map(self.token_bytes.__getitem__, ids)))

    def feed_packed(self, block: bytes) -> str:
        return self.feed(memoryview(block).cast("I"))

    def finish(self) -> str:
        return self.state.decode(b"", True)


@lru_cache(4)
def encoder(path: str) -> Encoder:
    return Encoder(bpe_tables.load(path))


def encode(text: str | None, path: str) -> list[int]:
    return memoryview(b"".join(encoder(path).blocks(text or ""))).cast("I").tolist()


def decode(ids: Iterable[int], path: str) -> str:
    machine = ByteToText(bpe_tables.load(path))
    return machine.feed(ids) + machine.finish()


def round_trip_digests(text: str | None, path: str) -> tuple[int, str, str]:
    """Number of ids, SHA-256 of the ids and SHA-256 of the text decoded from them, block by block."""
    enc = encoder(path)
    machine, ids, decoded, n = ByteToText(enc.table), hashlib.sha256(), hashlib.sha256(), 0
    for block in enc.blocks(text or ""):
        n += len(block) // 4
        ids.update(block)
        decoded.update(machine.feed_packed(block).encode())
    decoded.update(machine.finish().encode())
    return n, ids.hexdigest(), decoded.hexdigest()


def encode_documents(docs: DataFrame, path: str, text: str = "text", out: str = "token_ids") -> DataFrame:
    """``docs`` with a column of token ids of ``text``; all other columns stay."""
    from pyspark.sql import types as T

    schema = T.StructType([f for f in docs.schema.fields if f.name != out] + [T.StructField(out, T.ArrayType(T.IntegerType(), False))])
    names = [f.name for f in schema.fields[:-1]]

    def run(batches):
        for b in batches:
            column = pa.array([encode(t.as_py(), path) for t in b.column(text)], pa.list_(pa.field("element", pa.int32(), False)))
            yield pa.RecordBatch.from_arrays([*(b.column(n) for n in names), column], names=[*names, out])

    shipped(docs.sparkSession)
    return docs.mapInArrow(run, schema)


def decode_documents(tokens: DataFrame, path: str, ids: str = "token_ids", out: str = "text") -> DataFrame:
    """The inverse of ``encode_documents``: ``out`` is decoded from ``ids`` (null: null)."""
    from pyspark.sql import types as T

    schema = T.StructType([f for f in tokens.schema.fields if f.name not in (ids, out)] + [T.StructField(out, T.StringType())])
    names = [f.name for f in schema.fields[:-1]]

    def run(batches):
        for b in batches:
            column = pa.array([None if (x := v.as_py()) is None else decode(x, path) for v in b.column(ids)], pa.string())
            yield pa.RecordBatch.from_arrays([*(b.column(n) for n in names), column], names=[*names, out])

    shipped(tokens.sparkSession)
    return tokens.mapInArrow(run, schema)


def digests(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every whole text."""

    def run(batches):
        for b in batches:
            rows = [round_trip_digests(t.as_py(), path) for t in b.column("text")]
            n, ids, decoded = zip(*rows) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    shipped(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
