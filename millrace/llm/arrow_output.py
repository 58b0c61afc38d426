"""Operator 9: token ids as Arrow stream files with fixed-size-list batches.

Documents are dealt by ranges of doc_id, sorted, encoded with the tokenizers library, and written by the tasks into the shared
folder. A file holds record batches of equally many rows, each row a fixed-size list of ``length`` ids and one of equally many
mask bits (set: an id, else padding, only in a file's last rows); since rows and batches are of equal length, a memory map gives
any sequence without a copy. Beside each file lies ``.index``, a stream of (doc_id, start, n_tokens) within the file. Task
output goes to a name of its own and is renamed when complete, so a repeated attempt after a lost executor is harmless.

Order: ascending doc_id, null ones first, equal ones by a hash of their text. Null text counts as empty: only the end id is written. Repeated
rows are all written; further columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import itertools
import zlib
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.ipc as ipc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import bpe_tables
from ._common import TwoGenerations, new_path, shipped, written

#: Ids in a sequence, and sequences in a record batch.
LENGTH, ROWS = 2048, 64
#: Encoded words and pre-tokens kept by a worker in each of two generations, and their longest.
CACHED, CACHED_BYTES = 300_000, 128
_STOPS = (b".", b",", b";", b":", b"!", b"?")
INDEX = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64())])


class LibraryEncoder:
    """Ids of a text as the tokenizers library gives them. Where pre-tokens hold no white space, texts are cut at ASCII
    spaces, words into pre-tokens, and the library's model is asked once for each, within bounded caches; other texts go to
    the library whole."""

    def __init__(self, path: str):
        self.table, self.tokenizer = bpe_tables.load(path), bpe_tables.library_tokenizer(path)
        self.kind, self.code = (np.dtype("<u2"), "H") if len(self.table.token_bytes) <= 1 << 16 else (np.dtype("<u4"), "I")
        self.words, self.pieces = TwoGenerations(self._word, CACHED, CACHED_BYTES), TwoGenerations(self._piece, CACHED, CACHED_BYTES)
        self.model, self.alphabet = self.tokenizer.model, bpe_tables.byte_alphabet()

    def _whole(self, text: str) -> bytes:
        return array(self.code, self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def _piece(self, piece: str) -> bytes:
        # printable ASCII stands for itself in the byte alphabet
        plain = piece.isascii() and piece.isprintable()
        return array(self.code, [t.id for t in self.model.tokenize(piece if plain else "".join(map(self.alphabet.__getitem__, piece.encode())))]).tobytes()

    def _word(self, word: bytes) -> bytes:
        if word.isalpha():  # ASCII letters: one pre-token, which folding only lowers
            return self.pieces[word.decode().lower()]
        if word[-1:] in _STOPS and word[:-1].isalpha():
            return self.pieces[word[:-1].decode().lower()] + self.pieces[word[-1:].decode()]
        text = word.decode()
        if text.isalpha() and bpe_tables.is_latin1(text):
            return self.pieces[text.lower()]
        return b"".join(map(self.pieces.__getitem__, self.table.pieces(self.table.fold(text))))

    def encode(self, text: str) -> bytes:
        if not self.table.drops_space or "<|" in text:
            return self._whole(text)
        return b"".join(map(self.words.__getitem__, text.encode().split()))


@lru_cache(4)
def library_encoder(path: str) -> LibraryEncoder:
    return LibraryEncoder(path)


class StreamWriter:
    """Packs the ids of one document after another into sequences and writes batches as they fill."""

    def __init__(self, fs, path: str, kind: np.dtype, length: int = LENGTH, rows: int = ROWS):
        self.fs, self.path, self.kind, self.length, self.rows = fs, path, kind, length, rows
        ids = pa.from_numpy_dtype(kind)
        self.schema = pa.schema([("ids", pa.list_(ids, length)), ("mask", pa.list_(pa.bool_(), length))])
        self.out, self.index_out = fs.open_output_stream(f"{path}.tmp"), fs.open_output_stream(f"{path}.index.tmp")
        self.stream, self.index = ipc.new_stream(self.out, self.schema), ipc.new_stream(self.index_out, INDEX)
        self.held, self.n_held, self.at, self.docs, self.n_docs = [], 0, 0, [], 0

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.docs.append((doc_id, self.at, len(ids)))
        self.at += len(ids)
        self.n_docs += 1
        self.held.append(ids)
        self.n_held += len(ids)
        if self.n_held >= self.length * self.rows:
            self._flush(False)
        if len(self.docs) >= 10_000:
            self._flush_index()

    def _batch(self, flat: np.ndarray, filled: int) -> None:
        mask = np.arange(len(flat)) < filled
        lists = [pa.FixedSizeListArray.from_arrays(pa.array(x), self.length) for x in (flat, mask)]
        self.stream.write_batch(pa.RecordBatch.from_arrays(lists, schema=self.schema))

    def _flush(self, last: bool) -> None:
        flat, size = np.concatenate([np.empty(0, self.kind), *self.held]), self.length * self.rows
        whole = len(flat) // size * size
        for i in range(0, whole, size):
            self._batch(flat[i : i + size], size)
        rest = flat[whole:]
        if last and len(rest):
            padded = np.zeros(-(-len(rest) // self.length) * self.length, self.kind)
            padded[: len(rest)] = rest
            self._batch(padded, len(rest))
            rest = rest[:0]
        self.held, self.n_held = [rest], len(rest)

    def _flush_index(self) -> None:
        if self.docs:
            self.index.write_batch(pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*self.docs)], schema=INDEX))
            self.docs = []

    def close(self) -> None:
        self._flush(True)
        self._flush_index()
        for x in (self.stream, self.index, self.out, self.index_out):
            x.close()
        for name in (self.path, f"{self.path}.index"):
            self.fs.move(f"{name}.tmp", name)


class StreamFile:
    """Random access to the sequences of one file; on a local or mounted file system without copying."""

    def __init__(self, uri: str):
        self.fs, path = pafs.FileSystem.from_uri(uri)
        self.source = pa.memory_map(path) if isinstance(self.fs, pafs.LocalFileSystem) else self.fs.open_input_file(path)
        self.path, self.batches = path, list(ipc.open_stream(self.source))
        self.length = self.batches[0].schema.field("ids").type.list_size if self.batches else LENGTH
        self.rows = self.batches[0].num_rows if self.batches else ROWS

    def __len__(self) -> int:
        return sum(b.num_rows for b in self.batches)

    def flat(self, batch: int) -> np.ndarray:
        return self.batches[batch].column("ids").flatten().to_numpy(zero_copy_only=True)

    def sequence(self, i: int) -> tuple[np.ndarray, pa.BooleanArray]:
        """Ids and mask of the i-th sequence, as views of the file."""
        k, row = divmod(i, self.rows)
        return self.flat(k)[row * self.length : (row + 1) * self.length], self.batches[k].column("mask").flatten().slice(row * self.length, self.length)

    def ids(self, start: int, n: int) -> np.ndarray:
        """n ids from a position on: a view within a batch, a copy across batches."""
        size, out = self.rows * self.length, []
        while n > 0:
            k, at = divmod(start, size)
            out.append(self.flat(k)[at : at + n])
            start, n = start + len(out[-1]), n - len(out[-1])
        return out[0] if len(out) == 1 else np.concatenate(out)



def in_order(uri: str):
    """(doc_id, start, n_tokens, ids) of each document of a file, read from front to back: a batch or two at a time."""
    fs, path = pafs.FileSystem.from_uri(uri)
    with fs.open_input_stream(path) as source, fs.open_input_stream(f"{path}.index") as index:
        flats = (b.column("ids").flatten().to_numpy() for b in ipc.open_stream(source))
        flat, at = np.empty(0, np.uint16), 0
        for batch in ipc.open_stream(index):
            for doc_id, start, n in zip(*(c.to_pylist() for c in batch.columns)):
                parts = []
                while n > sum(map(len, parts)):
                    if at == len(flat):
                        flat, at = next(flats), 0
                    parts.append(flat[at : at + n - sum(map(len, parts))])
                    at += len(parts[-1])
                yield doc_id, start, n, np.concatenate(parts) if len(parts) != 1 else parts[0]


def write_stream_files(docs: DataFrame, path: str, end_id: int, to: str, length: int = LENGTH, rows: int = ROWS) -> DataFrame:
    """Writes the files and returns their manifest: file, uri, n_docs, n_tokens, first_token (ids in all files before it)."""

    def run(batches):
        first = next(batches, None)
        if first is None:
            return
        enc, fs_path = library_encoder(path), None
        context = TaskContext.get()
        number = context.partitionId()
        fs, fs_path = pafs.FileSystem.from_uri(to)
        fs.create_dir(fs_path, recursive=True)
        name = f"part-{number:06d}-{context.taskAttemptId()}.arrows"
        writer, end = StreamWriter(fs, f"{fs_path}/{name}", enc.kind, length, rows), np.array([end_id], enc.kind)
        for b in itertools.chain([first], batches):
            for doc_id, text in zip(b.column("doc_id").to_pylist(), b.column("text")):
                writer.add(doc_id, np.concatenate([np.frombuffer(enc.encode(text.as_py()), enc.kind), end]))
        writer.close()
        yield pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.array([f"{to}/{name}"]), pa.array([writer.n_docs], pa.int64()), pa.array([writer.at], pa.int64())], names=["file", "uri", "n_docs", "n_tokens"])

    shipped(docs.sparkSession)
    dealt = (
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
        .withColumn("tie", F.xxhash64("text"))  # range bounds are sampled on the driver, so no text is in the key
        .repartitionByRange(F.asc_nulls_first("doc_id"), F.asc("tie"))
        .sortWithinPartitions(F.asc_nulls_first("doc_id"), F.asc("tie"))
        .drop("tie")
    )
    manifest = written(dealt.mapInArrow(run, "file long, uri string, n_docs long, n_tokens long"), "manifest")
    # one row a file, so the running total over them is small
    before = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    return manifest.withColumn("first_token", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))


def read_stream_files(manifest: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document in the files, each of which is read by a task of its own."""

    def run(batches):
        for b in batches:
            for uri, first in zip(b.column("uri").to_pylist(), b.column("first_token").to_pylist()):
                docs = in_order(uri)
                while some := list(itertools.islice(((d, s + first, n, zlib.crc32(ids.astype("<u4").tobytes())) for d, s, n, ids in docs), 10_000)):
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*some)], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    shipped(manifest.sparkSession)
    # files are numbered, so ranges of their numbers deal out one to a task
    files = manifest.select("file", "uri", "first_token").repartitionByRange(max(manifest.count(), 1), "file")
    return files.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def round_trip(spark: SparkSession, docs: DataFrame, path: str, end_id: int = 1) -> DataFrame:
    return read_stream_files(write_stream_files(docs, path, end_id, new_path(spark, "arrow-ids")))
