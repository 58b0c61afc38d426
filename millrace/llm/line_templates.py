"""Operator 2: line dedup by a log-template tree.

Every line is parsed to a fixed depth: tokens with digits become fields, then the number of tokens and the first ``LEAD`` tokens
name a leaf. In a leaf that lines of enough documents reach, the support of a token at a position is the number of different lines
that have it there. The share ``FIXED`` of a line's tokens with most support are constants, and so are others with at least the
share ``RARE`` of the support of the last of them; the rest vary and become fields, whatever unrelated lines share the leaf.
Templates that recur across documents are dropped from all of them.

Documents count as independent by sketches of the rest of their text (the least hash of its three-word shingles, in four orders), which
exact copies share and near copies nearly always share in some order. A template recurs in as many documents as there are texts that
share no sketch of any order with another text that has the template, plus one for each group that does (the least number of shared sketches of an
order). These must be at least ``DOCUMENTS`` (``LONG_DOCUMENTS`` for templates of ``LONG`` tokens or more), and at least the share ``APART`` of
the texts that have it, since of very many near copies some share no sketch by chance. So the lines of copied documents are
left to document dedup, which keeps one of them, while a line of many documents goes even if some of these are copied.

Lines are reduced to hashes in one pass; counts, leaves and supports are partial aggregates and equi-joins on those. A line or
leaf that very many documents share is dealt over ``SALT`` keys where rows of documents meet it. Line text is only read again for leaves that count.

Defined results: one row for each row of documents, with ``text`` less the dropped lines (their line ends too); null text stays
null; lines without a word are never dropped and a text without drops stays as it is; rows of equal doc_id and text are treated
alike; other columns stay, whatever their names, but ``n_chars``, where there is one, follows a changed text; an empty table gives no rows.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import positional, shipped, written

LEAD, FIXED, RARE = 3, 0.6, 0.5
DOCUMENTS, LONG_DOCUMENTS, LONG, APART = 5, 3, 8, 0.01
#: Keys over which a line or leaf is dealt.
SALT = 16
FIELD = "<*>"
#: Names of a line's sketches and the bits turned over in each order of hashes.
SKETCHES, TURNS = ("s0", "s1", "s2", "s3"), (0, 0xFFFFFFFFFFFFFFFF, 0x5555555555555555, 0xAAAAAAAAAAAAAAAA)
_DIGIT, _FIELD = re.compile(b"[0-9]"), FIELD.encode()


def parse(text: str) -> list[tuple]:
    """(s0, s1, s2, s3, position, leaf, line, masked line) of each line with a word; hashes are signed 64-bit numbers."""
    import xxhash

    digest = xxhash.xxh64_intdigest
    data = text.encode()
    digits = _DIGIT.search(data) is not None
    words: list[bytes] = []
    lines, sizes = [], []
    for at, line in enumerate(data.split(b"\n")):
        if own := line.split():
            if digits and _DIGIT.search(line):
                own = [_FIELD if _DIGIT.search(w) else w for w in own]
            masked = b" ".join(own)
            lines.append((at, _signed(digest(b"%d %b" % (len(own), b" ".join(own[:LEAD])))), _signed(digest(masked)), masked.decode()))
            sizes.append(len(own))
            words += own
    return [(*s, *line) for s, line in zip(sketches(words, sizes), lines)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def sketches(words: list[bytes], sizes: list[int]) -> list[tuple[int, ...]]:
    """For each line, given as its number of words, the sketches of the rest of the text: the least hash of its three-word
    shingles in four orders.

    The line's own shingles are left out, so that a long passage does not stand for the documents that share it; four orders
    keep another shared line from doing so by chance in all of them. A text of one line stands for itself.
    """
    import xxhash

    if not words:
        return []
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    if len(h) > 2:  # hashes of shingles from those of their words
        h = h[:-2] * np.uint64(0x9E3779B97F4A7C15) + (h[1:-1] ^ (h[1:-1] >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + h[2:]
        h = (h ^ (h >> np.uint64(32))) * np.uint64(0x94D049BB133111EB)
        h ^= h >> np.uint64(29)
    line_of = np.repeat(np.arange(len(sizes)), sizes)[: len(h)]
    found = []
    for turn in TURNS:
        turned = h ^ np.uint64(turn)
        first = int(turned.argmin())
        own = line_of[first]
        at, end = np.searchsorted(line_of, (own, own + 1))
        least = int(turned[first])
        other = min([int(x.min()) for x in (turned[:at], turned[end:]) if len(x)], default=least)
        values = [_signed(least)] * len(sizes)
        values[own] = _signed(other)
        found.append(values)
    return list(zip(*found))


def parsed_lines(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, s0 to s3, at, leaf, line, masked: a row for each line with a word, written in the shared folder."""
    shipped(docs.sparkSession)
    names = ["doc_id", "text_hash", *SKETCHES, "at", "leaf", "line", "masked"]
    schema = pa.schema([(n, pa.string() if n == "masked" else pa.int64()) for n in names])

    def batch(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for f, c in zip(schema, zip(*rows))], schema=schema)

    def run(batches):
        for b in batches:
            ids, hashes, texts = b.column("doc_id").to_pylist(), b.column("text_hash").to_pylist(), b.column("text")
            rows, size = [], 0
            for d, h, t in zip(ids, hashes, texts):
                text = t.as_py()
                rows += [(d, h, *line) for line in parse(text)]
                size += len(text)
                if rows and size > 1 << 23:
                    yield batch(rows)
                    rows, size = [], 0
            if rows:
                yield batch(rows)

    own = docs.where("text IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), "text")
    return written(own.mapInArrow(run, ", ".join(f"{n} {'string' if n == 'masked' else 'long'}" for n in names)), "lines")


def having(rows: DataFrame, some: DataFrame, key: str) -> DataFrame:
    """The rows whose key is among ``some`` (distinct keys, with columns to add); each key is dealt over ``SALT``, as any one may have
    a large part of the rows."""
    dealt = some.withColumn("_salt", F.explode(F.array(*map(F.lit, range(SALT)))))
    return rows.withColumn("_salt", F.expr(f"CAST(pmod(xxhash64(text_hash, line), {SALT}) AS INT)")).join(dealt, [key, "_salt"]).drop("_salt")


def templates(lines: DataFrame) -> DataFrame:
    """(line, template, template_text) of every line whose leaf lines of ``LONG_DOCUMENTS`` texts reach."""
    leaves = written(lines.select("leaf", "text_hash").distinct().groupBy("leaf").count().where(F.col("count") >= LONG_DOCUMENTS).select("leaf"), "leaves")
    own = having(lines.select("leaf", "line", "masked", "text_hash"), leaves, "leaf").groupBy("leaf", "line").agg(F.first("masked").alias("masked"))
    own = written(own.withColumn("tokens", F.split("masked", " ")).drop("masked"), "leaf-lines")
    # the leading tokens are those of the leaf: every line of it has them
    sizes = own.groupBy("leaf").agg(F.count("*").alias("lines"))
    at = own.select("leaf", "line", F.posexplode(F.slice("tokens", LEAD + 1, 1 << 30)).alias("at", "token"))
    support = at.groupBy("leaf", "at", "token").agg(F.count("*").alias("support"))
    # a token of one line only need not meet its line again
    shared = at.join(support.where("support > 1"), ["leaf", "at", "token"]).groupBy("leaf", "line").agg(F.collect_list(F.struct("at", "support")).alias("shared"))  # as many as a line has tokens
    dealt = sizes.withColumn("_salt", F.explode(F.array(*map(F.lit, range(SALT)))))
    rows = own.withColumn("_salt", F.expr(f"CAST(pmod(xxhash64(line), {SALT}) AS INT)")).join(dealt, ["leaf", "_salt"]).join(shared, ["leaf", "line"], "left")
    rows = rows.select("leaf", "line", "lines", "tokens", F.col("shared.at").alias("at"), F.col("shared.support").alias("support")).mapInArrow(_generalised, "leaf long, line long, template_text string")
    return rows.select("line", F.xxhash64("leaf", "template_text").alias("template"), "template_text")


def _generalised(batches):
    """Template texts of lines (leaf, line, tokens, lines: those of the leaf) with the supports over one of the tokens beyond the leading ones, in any order."""
    for b in batches:
        texts = []
        for tokens, lines, at, support in zip(b.column("tokens"), b.column("lines").to_pylist(), b.column("at"), b.column("support")):
            own = tokens.as_py()
            supports = np.ones(len(own), np.int64)
            supports[:LEAD] = lines
            if at.is_valid and len(at.values):
                supports[LEAD + at.values.to_numpy()] = support.values.to_numpy()
            least = RARE * np.sort(supports)[::-1][math.ceil(FIXED * len(own)) - 1]
            texts.append(" ".join(t if n >= least else FIELD for t, n in zip(own, supports.tolist())))
        yield pa.RecordBatch.from_arrays([b.column("leaf"), b.column("line"), pa.array(texts, pa.string())], names=["leaf", "line", "template_text"])


def recurring(lines: DataFrame) -> DataFrame:
    """(line, template, template_text, documents, texts) of the lines to drop."""
    of = written(templates(lines), "templates")
    floor = F.when(F.size(F.split("template_text", " ")) >= LONG, LONG_DOCUMENTS).otherwise(DOCUMENTS)
    rows = having(lines.select("line", *SKETCHES, "text_hash"), of.select("line", "template"), "line").groupBy("template", "text_hash").agg(*(F.min(s).alias(s) for s in SKETCHES))
    rows = written(rows, "template-texts")
    texts = written(rows.groupBy("template").agg(F.count("*").alias("texts")).where(F.col("texts") >= LONG_DOCUMENTS), "several")
    rows = rows.join(texts.select("template"), "template")
    each = F.explode(F.array(*(F.struct(F.lit(k).alias("k"), F.col(s).alias("s")) for k, s in enumerate(SKETCHES)))).alias("e")
    by_sketch = rows.select("template", "text_hash", each).groupBy("template", "e.k", "e.s").agg(F.count("*").alias("n"), F.min("text_hash").alias("text_hash"))
    by_sketch = written(by_sketch, "template-sketches")
    alone = by_sketch.where("n = 1").groupBy("template", "text_hash").count().where(F.col("count") == len(SKETCHES)).groupBy("template").agg(F.count("*").alias("alone"))
    groups = by_sketch.where("n > 1").groupBy("template", "k").count().groupBy("template").agg(F.when(F.count("*") == len(SKETCHES), F.min("count")).otherwise(0).alias("groups"))
    found = texts.join(alone, "template", "left").join(groups, "template", "left").withColumn("documents", F.coalesce("alone", F.lit(0)) + F.coalesce("groups", F.lit(0)))
    found = of.join(found, "template").where((F.col("documents") >= floor) & (F.col("documents") >= APART * F.col("texts")))
    return found.select("line", "template", "template_text", "documents", "texts")


def drop_recurring_lines(docs: DataFrame, count: str | None = None) -> DataFrame:
    """``docs`` without recurring lines; ``count`` names a column for the number of lines dropped."""
    lines = parsed_lines(docs)
    found = written(recurring(lines).select("line").distinct(), "recurring")
    drops = having(lines.select("doc_id", "text_hash", "at", "line"), found, "line").groupBy(F.col("doc_id").alias("l_doc_id"), F.col("text_hash").alias("l_hash")).agg(F.array_distinct(F.collect_list("at")).alias("l_drops"))
    drops = written(drops, "drops")
    own, c = positional(docs)
    text = c["text"]
    # merged at every size: whether this side could be broadcast depends on how much of the corpus is boilerplate
    joined = own.join(drops.hint("merge"), own[c["doc_id"]].cast("long").eqNullSafe(drops["l_doc_id"]) & (F.xxhash64(text) == drops["l_hash"]), "left")
    own = joined.select(*c.values(), F.coalesce("l_drops", F.array().cast("array<bigint>")).alias("l_drops"))

    def run(batches):
        for b in batches:
            texts = []
            for t, drop in zip(b.column(text), b.column("l_drops")):
                whole, gone = t.as_py(), set(drop.as_py())
                texts.append("\n".join(x for i, x in enumerate(whole.split("\n")) if i not in gone) if gone else whole)
            yield b.set_column(b.schema.get_field_index(text), text, pa.array(texts, pa.string()))

    out = own.mapInArrow(run, own.schema)
    if "n_chars" in c:
        out = out.withColumn(c["n_chars"], F.when(F.size("l_drops") > 0, F.length(text)).otherwise(F.col(c["n_chars"])).cast(docs.schema["n_chars"].dataType))
    return out.select(*(F.col(at).alias(name) for name, at in c.items()), *([F.size("l_drops").cast("long").alias(count)] if count else []))
