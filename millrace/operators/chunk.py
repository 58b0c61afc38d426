"""Boundary-aware chunks of pages, counted in grapheme clusters."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..shipping import shipped

# Graphemes of a chunk, and those that it shares with the one before.
SIZE, OVERLAP = 1200, 160
#: Characters after which a chunk may end.
ENDS = "\n\r。！？!?.;；"
#: Characters that are a grapheme cluster each beside one another: below the combining marks, but for the carriage return, common punctuation, CJK.
SINGLE = re.compile("[\x00-\x0c\x0e-\u02ff\u2010-\u2027\u3001-\u3029\u4e00-\u9fff\uff01-\uff60]*")


def cut(text: str, size: int = SIZE, overlap: int = OVERLAP) -> list[tuple[int, int, str]]:
    """(start, end, text) windows of a page: at most ``size`` graphemes, ended at the last boundary in the last quarter."""
    import regex

    if size <= 0:
        return []
    if SINGLE.fullmatch(text):
        return _cut_single(text, size, overlap)
    units = regex.findall(r"\X", text)
    overlap, n, start, out = max(0, min(overlap, size - 1)), len(units), 0, []
    while start < n:
        end = min(start + size, n)
        if end < n:
            least = start + max(overlap + 1, size * 3 // 4)
            end = next((e for e in range(end, least - 1, -1) if units[e - 1] == "\r\n" or units[e - 1] in ENDS), end)
        piece = "".join(units[start:end])
        if piece.strip():
            out.append((start, end, piece))
        if end >= n:
            break
        start = end - overlap
    return out


def _cut_single(text: str, size: int, overlap: int) -> list[tuple[int, int, str]]:
    """``cut`` where each character is a grapheme cluster: windows are slices."""
    overlap, n, start, out = max(0, min(overlap, size - 1)), len(text), 0, []
    while start < n:
        end = min(start + size, n)
        if end < n:
            least = start + max(overlap + 1, size * 3 // 4)
            end = 1 + max(text.rfind(c, least - 1, end) for c in ENDS) or end
        piece = text[start:end]
        if piece.strip():
            out.append((start, end, piece))
        if end >= n:
            break
        start = end - overlap
    return out


def chunk_pages(pages: DataFrame, size: int = SIZE, overlap: int = OVERLAP, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, page, index (from 0 within the page), start, end, text of each chunk of pages (doc_id, page, text), with the columns ``keep``."""
    names = ["doc_id", "page", *keep]
    own = pages.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("page").cast("int").alias("page"), *keep, "text")
    schema = T.StructType([*own.schema.fields[:-1], *(T.StructField(n, T.LongType()) for n in ("index", "start", "end")), T.StructField("text", T.StringType())])

    def batch(b, rows):
        at, *columns = zip(*rows)
        taken = b.take(pa.array(at))
        return pa.RecordBatch.from_arrays([*(taken.column(n) for n in names), *(pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.string())))], names=[*names, "index", "start", "end", "text"])

    def run(batches):
        for b in batches:
            rows, length = [], 0
            for i, t in enumerate(b.column("text")):
                text = t.as_py() or ""
                rows += [(i, k, *c) for k, c in enumerate(cut(text, size, overlap))]
                length += len(text)
                if rows and length > 1 << 22:
                    yield batch(b, rows)
                    rows, length = [], 0
            if rows:
                yield batch(b, rows)

    shipped(pages.sparkSession)
    return own.mapInArrow(run, schema)


def with_ordinals(chunks: DataFrame) -> DataFrame:
    """Ordinals run through a document over all its pages."""
    return chunks.withColumn("ordinal", F.row_number().over(Window.partitionBy("doc_id").orderBy("page", "start")).cast("long") - 1)


def pages_of(docs: DataFrame, text: Column, separator: str = "\n") -> DataFrame:
    """doc_id, page (from 1), text of each page; blank pages keep their number."""
    return docs.select("doc_id", F.posexplode(F.split(text, separator)).alias("page", "text")).withColumn("page", F.col("page") + 1)


def coverage(chunks: DataFrame) -> DataFrame:
    """doc_id, page, rebuilt: the page's text put together from its chunks less their overlaps."""
    before = F.lag("end").over(Window.partitionBy("doc_id", "page").orderBy("start"))
    fresh = chunks.withColumn("skip", F.greatest(before - F.col("start"), F.lit(0)))
    piece = F.expr("substring(text, CAST(coalesce(skip, 0L) AS INT) + 1)")
    return fresh.groupBy("doc_id", "page").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("start", piece.alias("piece")))), lambda x: x["piece"]), "").alias("rebuilt"))
