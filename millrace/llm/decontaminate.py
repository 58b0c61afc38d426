"""Operator 5: benchmark decontamination by template windows, in DataFrame operations only.

A text becomes a template: numbers, units after a number, and names (capitalised words inside a sentence) turn into typed
placeholders; other words are lowered and lose punctuation at their edges. Windows of ``WINDOW`` template words of the
documents meet those of the benchmark in a hash join; items of under ``SHORT_ITEM`` words have windows of ``SHORT`` words as well, since
one changed word breaks most of their long ones. Matches of one document and item lie on diagonals (position in the document
less position in the item). A diagonal, or a band of ``BAND`` neighbouring ones (words put in or left out move the rest of a match to another diagonal),
that covers at least ``COVERAGE`` of the item's windows is a candidate. For items with placeholders the
slot values are then aligned, each on the diagonals of the matches that hold it: the same value of the item must stand for the same value in the document throughout, so
re-parameterised questions count and chance template matches do not. Names that follow one another are one placeholder.

Windows with fewer than ``LITERALS`` literal words (short ones: half as many) are no evidence and are left out on the benchmark side. An
item that has only such windows, of numbers and names mostly, is compared by windows of its words with their values, so it is found
as it stands. Items of ``SHORT`` to ``WINDOW`` - 1 words have short windows only, all of which must be found. Those of fewer words say nothing of where
they come from when they stand in a text, and are found exactly in texts that consist of them. The first word of an item, capitalised as such, is a
name where the item stands inside a sentence of a document: its first window counts in either form. The benchmark side is broadcast only if its windows are counted and at
most ``BROADCAST_ROWS``; beyond that it is a shuffled join, in which a window that very many documents hold is dealt over ``SALT`` keys.

Defined results: one row for each contaminated (doc_id, item_id), with its best diagonal. Null and empty texts match nothing;
rows with the same doc_id count as one document if their texts are equal, else each is compared; null doc_ids are compared too;
equal items each match; further columns are ignored; empty tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import written

WINDOW, LITERALS, COVERAGE = 8, 4, 0.5
SHORT, SHORT_ITEM, BAND, SALT = 4, 24, 8, 16
BROADCAST_ROWS = 1_000_000

# Common unit names and signs.
UNITS = "km|m|cm|mm|mi|miles?|ft|feet|inch|inches|yards?|kg|g|mg|lbs?|pounds?|oz|ounces?|tons?|l|ml|liters?|litres?|gallons?|s|sec|seconds?|min|minutes?|h|hours?|days?|weeks?|months?|years?|mph|kmh|%|percent|degrees?|dollars?|cents?|euros?|usd|eur|eggs?|units?"

#: Marks a placeholder: followed by n (number), u (unit) or p (proper name), then the value.
MARK = "\x01"


def words(text: Column) -> Column:
    """Words of a text, lowered, with punctuation at their edges dropped; placeholders are marked and keep their value."""
    clean = F.replace(F.coalesce(text, F.lit("")), F.lit(MARK), F.lit(" "))
    named = F.regexp_replace(clean, r"\p{Lu}(?<=[^\x20\x09-\x0D.!?:][\x20\x09-\x0D]{1}.)\p{Ll}++(?!\p{L})", f"{MARK}p$0")
    named = F.regexp_replace(named, rf"\x20{MARK}p(?<={MARK}p\p{{Lu}}\p{{Ll}}{{1,40}}\x20{MARK}p)", "_")
    glued = F.regexp_replace(named, rf"(?i)([0-9])({UNITS})(?![\p{{L}}\p{{N}}])", "$1 $2")
    number = F.regexp_replace(glued, r"(?<![\p{L}\p{N}\x01.,])[0-9](?:[0-9.,]*+(?<=[0-9]))?+(?![\p{L}\p{N}])", f"{MARK}n$0")
    unit = F.regexp_replace(number, rf"(?i)(\x01n[0-9.,]++[\x20\x09-\x0D]++)({UNITS})(?![\p{{L}}\p{{N}}])", f"$1{MARK}u$2")
    marked = F.when(clean.rlike("[0-9]"), unit).otherwise(named)
    edge = r"[^\p{L}\p{N}\x01%\x20\x09-\x0D]"
    return F.array_remove(F.split(F.lower(marked), rf"{edge}*+[\x20\x09-\x0D]++{edge}*+|\A{edge}++|{edge}++\z"), "")


def template(word: Column) -> Column:
    return F.when(word.startswith(MARK), F.substring(word, 1, 2)).otherwise(word)


def windows(tokens: Column, size: int = WINDOW, values: bool = False) -> Column:
    """Hash of each window of template words (or of words with their values), in order (none: empty)."""
    hashes = F.transform(tokens, lambda t: F.xxhash64(t if values else template(t)))
    of = F.transform(F.array(hashes), lambda h: F.transform(F.sequence(F.lit(0), F.size(h) - size), lambda i: F.xxhash64(*(F.get(h, i + k) for k in range(size)))))
    return F.when(F.size(tokens) < size, F.array().cast("array<bigint>")).otherwise(of[0])


def item_windows(items: DataFrame) -> DataFrame:
    """item_id, size, values, n_windows (usable ones of that size), needed (how many must be found), at, h: usable windows of each distinct item."""
    rows = items.select(F.col("item_id").cast("long").alias("item_id"), words(F.col("text")).alias("item_words")).distinct()
    out = None
    n = F.size("item_words")
    for size in (WINDOW, SHORT, *range(1, SHORT)):
        literal = lambda i: F.size(F.filter(F.slice("item_words", i + 1, size), lambda t: ~t.startswith(MARK))) >= LITERALS * size // WINDOW  # noqa: E731, B023
        indexed = lambda w: F.transform(w, lambda h, i: F.struct(h.alias("h"), i.alias("at")))
        own = rows if size == WINDOW else rows.where((n >= SHORT) & (n < SHORT_ITEM) if size == SHORT else n == size)
        own = own.withColumn("ws", F.filter(indexed(windows(F.col("item_words"), size)), lambda w: literal(w["at"]) & F.lit(size >= SHORT))).withColumn("values", F.size("ws") == 0)
        own = own.withColumn("ws", F.when(F.col("values"), indexed(windows(F.col("item_words"), size, True))).otherwise(F.col("ws"))).withColumn("n_windows", F.size("ws"))
        # inside a sentence of a document, the item's first word looks like a name
        first = F.get("item_words", F.lit(0))
        inside = F.concat(F.array(F.concat(F.lit(f"{MARK}p"), F.when(F.col("values"), first).otherwise(""))), F.slice("item_words", 2, size - 1))
        other = F.when(F.col("values"), windows(inside, size, True)).otherwise(windows(inside, size))
        capital = (F.size("ws") > 0) & (F.get("ws", F.lit(0))["at"] == 0) & ~first.startswith(MARK) & first.rlike(r"^\p{L}") & F.lit(size >= SHORT)
        own = own.withColumn("ws", F.when(capital, F.concat("ws", F.transform(other, lambda h: F.struct(h.alias("h"), F.lit(0).alias("at"))))).otherwise(F.col("ws")))
        needed = F.when(n < WINDOW, F.col("n_windows")).otherwise(COVERAGE * F.col("n_windows"))
        own = own.select("item_id", F.lit(size).alias("size"), "values", "n_windows", needed.cast("double").alias("needed"), F.explode("ws").alias("w")).select("item_id", "size", "values", "n_windows", "needed", "w.at", "w.h")
        out = own if out is None else out.unionByName(own)
    return out


def diagonals(docs: DataFrame, items: DataFrame) -> DataFrame:
    """Candidates (doc_id, text_hash, item_id, size, shift, first_word, hits, n_windows, coverage); hits are (at, shift) of the matches."""
    bench = written(item_windows(items), "item-windows")
    small = bench.count() <= BROADCAST_ROWS
    kinds = {(WINDOW, False)} | {tuple(r) for r in bench.select("size", "values").distinct().collect()}  # at most seven
    # the words are used more than once in the windows, so they are a column of their own, computed once
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), words(F.col("text")).alias("w"))
    hits = None
    for size, values in sorted(kinds):
        of = bench.where((F.col("size") == size) & (F.col("values") == values)).drop("values")
        at = own if size >= SHORT else own.where(F.size("w") == size)
        at = at.select("doc_id", "text_hash", F.posexplode(windows(F.col("w"), size, values)).alias("pos", "h"))
        if small:
            at = at.join(F.broadcast(of), "h")
        else:
            dealt = of.withColumn("salt", F.explode(F.array(*map(F.lit, range(SALT)))))
            at = at.withColumn("salt", F.expr(f"CAST(pmod(xxhash64(text_hash, pos), {SALT}) AS INT)")).join(dealt, ["h", "salt"]).drop("salt")
        hits = at if hits is None else hits.unionByName(at)
    hits = hits.withColumn("shift", F.col("pos") - F.col("at"))
    # the diagonal itself, and the two bands it is in, which overlap by half
    bands = F.array(*(F.struct(F.lit(k).alias("k"), at.cast("long").alias("band")) for k, at in enumerate((F.col("shift"), F.floor(F.col("shift") / BAND), F.floor((F.col("shift") + BAND // 2) / BAND)))))
    of = hits.select("doc_id", "text_hash", "item_id", "size", "n_windows", "needed", "at", "shift", F.explode(bands).alias("b"))
    return (
        of.groupBy("doc_id", "text_hash", "item_id", "size", "b")
        .agg(F.count_distinct("at").alias("matched"), F.min("shift").alias("shift"), F.min(F.struct("at", "shift")).alias("first"), F.max("n_windows").alias("n_windows"), F.max("needed").alias("needed"), F.sort_array(F.collect_set(F.struct("at", "shift"))).alias("hits"))
        .withColumn("coverage", F.col("matched") / F.col("n_windows"))
        .where(F.col("matched") >= F.col("needed"))
        .withColumn("first_word", F.col("first.at") + F.col("first.shift"))
        .drop("b", "first", "matched", "needed")
    )


def _stands_for(slot: Column) -> Column:
    """(item, doc) values of a slot: on the diagonals of the matches that hold it; where none does, on those of the matches next to it, and
    if these differ only where a placeholder of its type stands."""
    shifts = lambda hits: F.array_distinct(F.transform(hits, lambda h: h["shift"]))
    pair = lambda shift: F.struct(slot["value"].alias("item"), F.get(F.col("d_words"), slot["at"] + shift).alias("doc"))
    before, after = F.filter("hits", lambda h: h["at"] <= slot["at"]), F.filter("hits", lambda h: h["at"] > slot["at"])
    holding = F.filter(before, lambda h: slot["at"] < h["at"] + F.col("size"))
    near = shifts(F.concat(F.slice(before, -1, 1), F.slice(after, 1, 1)))
    typed = F.filter(near, lambda x: template(F.get(F.col("d_words"), slot["at"] + x)) == template(slot["value"]))
    of = F.when(F.size(holding) > 0, shifts(holding)).when(F.size(near) == 1, near).otherwise(typed)
    return F.transform(of, pair)


def contaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """doc_id, text_hash, item_id, kind (verbatim or re-parameterised), coverage, first_word of each pair found."""
    found = written(diagonals(docs, items), "candidates")
    slots = (
        items.select(F.col("item_id").cast("long").alias("item_id"), F.posexplode(words(F.col("text"))).alias("at", "value"))
        .where(F.col("value").startswith(MARK))
        .groupBy("item_id")
        .agg(F.array_distinct(F.collect_list(F.struct("at", "value"))).alias("slots"))
    )
    found = found.join(slots, "item_id", "left").withColumn("slots", F.filter("slots", lambda s: (s["at"] >= F.element_at("hits", 1)["at"]) & (s["at"] < F.element_at("hits", -1)["at"] + F.col("size"))))
    found = written(found, "slots")
    open_ones = found.where(F.size(F.coalesce("slots", F.array())) > 0)
    closed = found.where(F.size(F.coalesce("slots", F.array())) == 0).withColumn("kind", F.lit("verbatim"))
    if not open_ones.isEmpty():
        texts = docs.select(F.col("doc_id").cast("long").alias("d_doc_id"), F.xxhash64("text").alias("d_hash"), "text").dropDuplicates(["d_doc_id", "d_hash"])
        keys = open_ones.select("doc_id", "text_hash").distinct()
        texts = texts.join(keys, F.col("d_doc_id").eqNullSafe(F.col("doc_id")) & (F.col("d_hash") == F.col("text_hash")), "left_semi").withColumn("d_words", words(F.col("text"))).drop("text")
        pairs = F.array_distinct(F.flatten(F.transform("slots", _stands_for)))
        aligned = open_ones.join(texts, F.col("d_doc_id").eqNullSafe(F.col("doc_id")) & (F.col("d_hash") == F.col("text_hash"))).withColumn("pairs", pairs)
        consistent = F.size("pairs") == F.size(F.array_distinct(F.transform("pairs", lambda p: p["item"])))
        same = F.forall("pairs", lambda p: p["item"] == p["doc"])
        closed = closed.unionByName(aligned.where(consistent).withColumn("kind", F.when(same, "verbatim").otherwise("re-parameterised")).select(closed.columns))
    best = F.max_by(F.struct("kind", "coverage", "first_word"), F.struct("coverage", F.col("kind") == "verbatim", -F.col("shift"))).alias("b")
    return closed.groupBy("doc_id", "text_hash", "item_id").agg(best).select("doc_id", "text_hash", "item_id", "b.kind", "b.coverage", "b.first_word")


def clean_documents(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of ``docs`` that hold no benchmark item."""
    keys = written(contaminated(docs, items).select(F.col("doc_id").alias("c_doc_id"), F.col("text_hash").alias("c_hash")).distinct(), "contaminated")
    return docs.join(keys, docs["doc_id"].cast("long").eqNullSafe(keys["c_doc_id"]) & (F.xxhash64(docs["text"]) == keys["c_hash"]), "left_anti")
