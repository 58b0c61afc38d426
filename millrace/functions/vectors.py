"""Vector columns: cosine, truncation, encoder identity, and the seam for an encoder."""

from __future__ import annotations

import json
import math
from collections.abc import Callable, Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..shipping import shipped
from .gates import squared_norm

#: Texts that an encoder is given at once.
BATCH = 8


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column, norm_a: Column | None = None, norm_b: Column | None = None) -> Column:
    """Cosine in double; 0 for vectors of other lengths, empty ones and zero vectors. Squared norms may be given."""
    square = (squared_norm(a) if norm_a is None else norm_a) * (squared_norm(b) if norm_b is None else norm_b)
    return F.when((F.size(a) == F.size(b)) & (square > 0), dot(a, b) / F.sqrt(square)).otherwise(0.0)


def truncated(v: Column, k: int) -> Column:
    """The first k dimensions, at unit length again."""
    head = F.slice(v, 1, k)
    return F.transform(head, lambda x: x.cast("double") / F.sqrt(squared_norm(head)))


def role_prefix(role: Column, text: Column, query: str = "query: ", document: str = "document: ") -> Column:
    return F.when(role == "query", F.concat(F.lit(query), text)).when(role == "document", F.concat(F.lit(document), text)).otherwise(text)


def encoder_signature(fields: dict[str, Column]) -> Column:
    """SHA-256 of the JSON of named strings in the order of their names."""
    parts = [F.concat(F.lit(json.dumps(k) + ":"), F.to_json(F.array(fields[k]))) for k in sorted(fields)]
    return F.sha2(F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}")), 256)


def embed(df: DataFrame, text: str, encoder: Callable[[], Callable[[list[str]], list[list[float]]]], signature: str, out: str = "embedding") -> DataFrame:
    """``df`` with vectors of a text column from an encoder that is built once in each task and fed BATCH texts at a time."""
    import pandas as pd

    shipped(df.sparkSession)

    def encoded(batches):
        encode = encoder()
        for texts in batches:
            rows: list[list[float]] = []
            for i in range(0, len(texts), BATCH):
                rows += encode(texts.iloc[i : i + BATCH].tolist())
            yield pd.Series(rows)

    # annotations are given as objects: as text, pandas_udf could not resolve the local import
    encoded.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return df.withColumn(out, F.pandas_udf(encoded, "array<float>")(text)).withColumn("encoder_signature", F.lit(signature))


class Response(NamedTuple):
    """What an encoder gives back for a batch: a vector for each text, in their order, and the signature of what made them."""

    vectors: list
    signature: str


def _fault(response: Response | Exception, n: int, signature: str, dims: int | None) -> str | None:
    """Why a response to ``n`` texts cannot be used."""
    if isinstance(response, Exception):
        return f"{type(response).__name__}: {response}"
    if response.signature != signature:
        return f"signature {response.signature}"
    if len(response.vectors) != n:
        return f"{len(response.vectors)} vectors for {n} texts"
    sizes = {len(v) if v is not None else 0 for v in response.vectors}
    if len(sizes) > 1 or 0 in sizes or dims is not None and sizes != {dims}:
        return f"vectors of {', '.join(map(str, sorted(sizes)))} dimensions"
    if any(not math.isfinite(x) for v in response.vectors for x in v):
        return "vectors that are not finite"
    if any(not any(v) for v in response.vectors):
        return "vectors of length zero"
    return None


def embed_in_batches(df: DataFrame, key: str, text: str, encoder: Callable[[], Callable[[list[str]], Response]], signature: str, dims: int | None = None, batch: str | None = None, size: int = BATCH) -> DataFrame:
    """key, batch, index, embedding, encoder_signature, problem: each text encoded in a batch of at most ``size``, and each batch's response checked.

    A response that is an error, of another signature, of another count, of several dimensions or not finite is refused as a whole: its rows come without
    a vector and with the problem, and the next batch goes on. So all vectors there are share one signature. Batches are those of the column
    ``batch`` (in the order of the key), or else neighbours in a partition."""
    shipped(df.sparkSession)
    kind = df.schema[key].dataType.simpleString()

    def run(batches):
        encode, task, number, now, held = encoder(), TaskContext.get().partitionId() << 33, 0, None, []

        def close():
            nonlocal number, held
            rows, held = held, []
            for at in range(0, len(rows), size):
                part = rows[at : at + size]
                try:
                    response = encode([t for _, t in part])
                except Exception as e:  # noqa: BLE001  whatever an encoder raises is a problem of this batch only
                    response = e
                problem = _fault(response, len(part), signature, dims)
                vectors = [None] * len(part) if problem else response.vectors
                name = now if batch else task + number
                number += 1
                yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in part], types[0]), pa.array([name] * len(part), pa.int64()), pa.array(range(len(part)), pa.int32()), pa.array(vectors, pa.list_(pa.float32())), pa.array([None if problem else signature] * len(part), pa.string()), pa.array([problem] * len(part), pa.string())], names=["key", "batch", "index", "embedding", "encoder_signature", "problem"])

        types = [None]
        for b in batches:
            types[0] = b.schema.field("k").type
            numbers = b.column("b").to_pylist()
            for n, k, t in zip(numbers, b.column("k").to_pylist(), b.column("t").to_pylist()):
                if batch and n != now and held or not batch and len(held) == size:
                    yield from close()
                now = n
                held.append((k, t))
        if held:
            yield from close()

    rows = df.select((F.col(batch) if batch else F.lit(0)).cast("long").alias("b"), F.col(key).alias("k"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    if batch:
        rows = rows.repartition("b").sortWithinPartitions("b", "k")
    out = rows.mapInArrow(run, f"key {kind}, batch long, index int, embedding array<float>, encoder_signature string, problem string")
    return out.withColumnRenamed("key", key)


def signed(encoder: Callable, signature: str) -> Callable[[], Callable[[list[str]], Response]]:
    """An encoder of plain lists as one whose responses carry a signature."""

    def build():
        encode = encoder()
        return lambda texts: Response(encode(texts), signature)

    return build


def hashing_encoder(dims: int = 64) -> Callable[[], Callable[[list[str]], list[list[float]]]]:
    """A deterministic stand-in: words hashed to signed dimensions, at unit length."""

    def build():
        import zlib

        def encode(texts: list[str]) -> list[list[float]]:
            out = []
            for t in texts:
                v = [0.0] * dims
                for w in (t or "").lower().split() or [""]:
                    h = zlib.crc32(w.encode())
                    v[h % dims] += 1.0 if h >> 16 & 1 else -1.0
                n = sum(x * x for x in v) ** 0.5
                out.append([x / n for x in v] if n else [1.0] + [0.0] * (dims - 1))
            return out

        return encode

    return build
