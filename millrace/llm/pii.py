"""Operator 8: personal data by candidates and gradient boosting, in DataFrame operations only.

Base spans are found by strict patterns and validators. High-recall generators propose further, overlapping spans: spelled-out
addresses, number groups, and long mixed tokens. A candidate has two views. Evidence labels it, or leaves it open: what stands before it (a key
word such as "password =", a contact word, the plus of an international number), a known prefix or top-level domain, or that it is
something else (a card, an internet address, a date, part of a longer word, words joined by hyphens). Its format and its context give
yes/no features. Context is the shape of the line, digits around, the place in the text and base spans of other kinds near by; what
stands before a candidate is read less any evidence, so no context feature is part of a label. Boosted two-level trees learn from the labelled candidates which
formats and contexts are personal, and are applied to all, so a national phone number or a key without any key word before it is found if it looks
like confirmed ones. The labelled candidates are held out in turn, a fold at a time, and scored by trees fitted to the others; isotonic
regression over these scores calibrates them to probabilities. A candidate whose score reaches one of ``PROBABLE`` or more is selected,
if its score is above zero as well, that of formats the trees know nothing about. They are added if they overlap no
selected one of an earlier generator and no base span (a long token may: digits inside a key can look like a card).

The trees are fitted to counts of (generator, feature pattern, label, fold) over the labelled candidates of all documents: at most
``3 * 2**14 * 2 * FOLDS`` rows, whatever the number of documents, and no sample. They are applied as SQL conditions.

Positions are code points from 0, ends exclusive. Matches are marked in the text and cut out by ``split``; starts are running
sums of the lengths before them.

Defined results: one row for each row of documents; null text counts as empty; texts with a character U+0001 are read as if it were
U+0002; further columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import positional, written

KINDS = ("email", "ip", "card", "phone", "secret")
PROBABLE, ROUNDS, RATE, FOLDS = 0.9, 24, 0.3, 4

_MARK, _LOCAL, _LABEL = "\x01", "[A-Za-z0-9._%+-]", "[A-Za-z0-9-]"
#: Pattern of each base kind. Possessive quantifiers and the guards in front only spare attempts that cannot succeed.
BASE = {
    "email": rf"(?:(?<!{_LOCAL})|\G){_LOCAL}++@{_LABEL}++(?:\.{_LABEL}++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?+[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Kind and pattern of each generator, in order of precedence.
GENERATORS = {
    "spelled": ("email", rf"(?i)(?<!{_LOCAL}){_LOCAL}++(?:\x20?[\[(]at[\])]\x20?|\x20at\x20){_LABEL}++(?:(?:\x20?[\[(]dot[\])]\x20?|\x20dot\x20|\.){_LABEL}++)++"),
    "token": ("secret", r"(?<![A-Za-z0-9_+/-])(?:(?=[A-Za-z_+/-]*+[0-9])(?=[0-9_+/-]*+[A-Za-z])|(?=[A-Z0-9]{16}))[A-Za-z0-9_+/-]{16,}+"),
    "number": ("phone", r"(?<![0-9])[(]?[0-9](?:[\x20().-]{0,2}+[0-9]){6,18}+(?![0-9])"),
}
#: What a text must hold for a pattern to be tried at all; each follows from the pattern.
_NEEDS = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": "[0-9]", "phone": r"\+[0-9]", "spelled": r"(?i)[\[( ]at[\]) ]", "token": "[0-9]|[A-Z]{16}", "number": "[0-9]"}
CONTEXT_BEFORE, CONTEXT_AFTER, NEAR = 24, 24, 160

#: Yes/no features of a candidate's format, as patterns.
FEATURES = {
    "digits_only": r"^[0-9\x20().-]+$",
    "separators": r"[\x20().-]",
    "long": "^.{20}",
    "very_long": "^.{32}",
    "hexadecimal": "^[0-9a-f]+$",
    "capitals_digits": "^[0-9A-Z]+$",
    "mixed_case": "^(?=.*[a-z]).*[A-Z]",
    "letter_run": "(?i)[a-z]{5}",
    "area_code": "[(][0-9]{2,5}[)]",
    "ends_in_four": r"[0-9]{3}[\x20.-][0-9]{4}$",
    "short_groups": "^[0-9]{1,3}(?:[.-][0-9]{1,3}){2,}$",
    "bracketed_at": r"(?i)[\[(]at[\])]",
    "bracketed_dot": r"(?i)[\[(]dot[\])]",
    "spoken_dot": r"(?i)\x20dot\x20",
}
#: Features of each generator's formats that can differ; with those of context at most 14.
FORMATS = {
    "spelled": ("separators", "long", "very_long", "mixed_case", "letter_run", "bracketed_at", "bracketed_dot", "spoken_dot"),
    "token": ("digits_only", "separators", "long", "very_long", "hexadecimal", "capitals_digits", "mixed_case", "letter_run"),
    "number": ("separators", "long", "very_long", "area_code", "ends_in_four", "short_groups"),
}
CONTEXT = ("line_start", "line_end", "digits_before", "digits_after", "opening", "near_base")
# Words before personal data, prefixes of keys, and top-level domains.
KEY_WORD = r"(?i)(?:password|passwd|pwd|token|secret|api[_-]?key|access[_-]?key)[\x20\"'=:]{1,4}$"
CONTACT_WORD = r"(?i)(?:tel|phone|call|fax|mobile|mail|contact|reach|write|ring)(?:[\x20.:=]|\x20me|\x20us|\x20to|\x20at|\x20on){0,3}[\x20.:=]{0,3}$"
KEY_PREFIX = "^(?:AKIA|ASIA|ghp_|gho_|sk-|xox[abp]-)"
DOMAIN = "(?i)(?:com|org|net|edu|gov|io|de|fr|es|uk)$"
PLUS = r"\+(?:[0-9]{1,3}[\x20(]*)?$"


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn test."""

    def add(total: Column, i: Column) -> Column:
        d = F.substring(digits, F.length(digits) - i, F.lit(1)).cast("int")
        return total + F.when(i % 2 == 0, d).otherwise(F.when(d > 4, 2 * d - 9).otherwise(2 * d))

    return F.aggregate(F.sequence(F.lit(0), F.length(digits) - 1), F.lit(0), add) % 10 == 0


def valid(kind: str, match: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(match, r"\."), lambda p: p.rlike("^0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])$"))
    n = F.length(_digits(match))
    if kind == "card":
        return F.when(n.between(13, 19), luhn(_digits(match))).otherwise(False)
    if kind == "phone":
        return n.between(9, 15)
    return F.lit(True)


def spans(docs: DataFrame) -> DataFrame:
    """A row for each match of any pattern (and one of nulls for a text without): row, doc_id, found_by, start, match, before, after."""
    text = F.translate(F.coalesce(F.col("text"), F.lit("")), _MARK, "\x02")
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), F.monotonically_increasing_id().alias("row"), text.alias("t"))

    def matches(name: str, pattern: str) -> Column:
        pieces = F.split(F.regexp_replace("t", pattern, f"{_MARK}$0{_MARK}"), _MARK)
        rows = F.transform(
            F.array(pieces),
            lambda p: F.transform(
                F.filter(F.sequence(F.lit(0), F.size(p) - 1), lambda i: i % 2 == 1),
                lambda i: F.struct(
                    F.lit(name).alias("found_by"),
                    i.alias("i"),
                    F.get(p, i).alias("match"),
                    F.length(F.get(p, i - 1)).cast("long").alias("gap"),
                    F.right(F.get(p, i - 1), F.lit(CONTEXT_BEFORE)).alias("before"),
                    F.left(F.get(p, i + 1), F.lit(CONTEXT_AFTER)).alias("after"),
                ),
            ),
        )[0]
        return F.when(F.col("t").rlike(_NEEDS[name]), rows)

    named = BASE | {k: p for k, (_, p) in GENERATORS.items()}
    empty = F.array().cast("array<struct<found_by:string,i:int,match:string,gap:bigint,before:string,after:string>>")
    every = F.concat(*(F.coalesce(matches(k, p), empty) for k, p in named.items()))
    rows = own.select("row", "doc_id", "text_hash", F.explode_outer(every).alias("m")).select("row", "doc_id", "text_hash", "m.*")
    so_far = F.sum(F.col("gap") + F.length("match")).over(Window.partitionBy("row", "found_by").orderBy("i").rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("end", so_far).withColumn("start", F.col("end") - F.length("match"))
    checked = F.lit(False)
    for kind in BASE:
        checked = F.when(F.col("found_by") == kind, valid(kind, F.col("match"))).otherwise(checked)
    return rows.withColumn("base", F.coalesce(checked, F.lit(False))).drop("i", "gap")


def labels() -> dict[str, tuple[Column, Column]]:
    """For each generator, what confirms a candidate and what rules it out; where neither holds it has no label."""
    match, before, after = F.col("match"), F.col("before"), F.col("after")
    n = F.length(_digits(match))
    plus = before.rlike(PLUS)
    contact = before.rlike(CONTACT_WORD)
    address = match.rlike(r"^[0-9]+(?:\.[0-9]+){3}$")
    card = F.when(match.rlike(r"^[0-9]([\x20-]?[0-9])+$"), n.between(13, 19))
    date = match.rlike(r"^(?:[0-9]{4}[.-][0-9]{1,2}[.-][0-9]{1,2}|[0-9]{1,2}[.-][0-9]{1,2}[.-][0-9]{4})$")
    joined = before.rlike(r"[A-Za-z0-9_=/]\z") | after.rlike("^[A-Za-z0-9_]")
    return {
        "spelled": (match.rlike(DOMAIN) & (match.rlike(r"(?i)[\[(](?:at|dot)[\])]|\x20dot\x20") | contact), ~match.rlike(DOMAIN) & ~match.rlike(r"(?i)[\[(](?:at|dot)[\])]|\x20dot\x20")),
        "token": (before.rlike(KEY_WORD) | match.rlike(KEY_PREFIX), match.rlike("^[0-9+/_-]+$") | match.rlike("(?i)[a-z]{3,}[-_/][a-z]{2,}[-_/][a-z]{2,}") | before.rlike(r"(?i)(?:://|www\.)[^\x20]*$")),
        "number": ((plus | contact) & n.between(7, 15) & ~address, address | F.coalesce(card, F.lit(False)) | date | joined | ~n.between(7, 15)),
    }


def context() -> dict[str, Column]:
    """The features of a candidate's context. ``before`` is read less its last words if these are evidence, and ``after`` from its second
    character on, as the first can be evidence. ``base_end`` and ``base_start`` are those of base spans of other kinds on either side."""
    start, end, after = F.col("start"), F.col("end"), F.col("after")
    around = F.col("before")
    for evidence in (PLUS, CONTACT_WORD, KEY_WORD):
        around = F.regexp_replace(around, evidence, "")
    return {
        "line_start": around.rlike(r"(?:^|\n)[^A-Za-z0-9\n]*$"),
        "line_end": after.rlike(r"(?s)^.{0,2}(?:\n|$)"),
        "digits_before": around.rlike("[0-9]"),
        "digits_after": after.rlike("(?s)^.+[0-9]"),
        "opening": start < NEAR,
        "near_base": (F.col("base_end").between(start - NEAR, start)) | (F.col("base_start").between(end, end + NEAR)),
    }


def featured(rows: DataFrame) -> DataFrame:
    """Feature pattern (bits), label (null: none) and fold of the generators' candidates."""
    by_start = Window.partitionBy("row").orderBy("start", "end", "found_by")
    other = F.col("base") & (F.col("found_by") != "phone")  # a number's own international form tells no neighbour
    rows = rows.withColumn("base_end", F.max(F.when(other, F.col("end"))).over(by_start.rowsBetween(Window.unboundedPreceding, -1)))
    rows = rows.withColumn("base_start", F.min(F.when(other, F.col("start"))).over(by_start.rowsBetween(1, Window.unboundedFollowing)))
    around, pattern = context(), F.lit(None).cast("int")
    for g, formats in FORMATS.items():
        bits = [F.col("match").rlike(FEATURES[x]) for x in formats] + [F.coalesce(around[x], F.lit(False)) for x in CONTEXT]
        pattern = F.when(F.col("found_by") == g, sum((x.cast("int") * (1 << j) for j, x in enumerate(bits)), F.lit(0))).otherwise(pattern)
    label = F.lit(None).cast("boolean")
    for g, (yes, no) in labels().items():
        yes, no = F.coalesce(yes, F.lit(False)), F.coalesce(no, F.lit(False))
        label = F.when(F.col("found_by") == g, F.when(yes & ~no, True).when(no & ~yes, False)).otherwise(label)
    fold = F.when(F.col("found_by").isin(*GENERATORS), F.pmod(F.xxhash64("match"), F.lit(FOLDS)).cast("int"))
    return rows.withColumn("pattern", pattern).withColumn("label", label).withColumn("fold", fold).drop("base_end", "base_start")


def boost(counts: dict[tuple[int, bool], int], n_features: int) -> list[tuple[int, int, int, tuple[float, float, float, float]]]:
    """Trees (root, feature if the root is no, feature if yes, four leaf values) for (pattern, label) counts, by Newton boosting.

    Gradients are summed by pairs of set features, from which the sums of every leaf of every tree follow; a round is one pass over the patterns."""
    patterns = sorted({p for p, _ in counts})
    score = dict.fromkeys(patterns, 0.0)
    features, trees = range(n_features), []
    if not patterns:
        return trees
    bits = {p: [j for j in features if p >> j & 1] for p in patterns}
    value = lambda s: s[0] / (s[1] + 1)
    gain = lambda s: s[0] * s[0] / (s[1] + 1)
    less = lambda s, *of: (s[0] - sum(x[0] for x in of), max(s[1] - sum(x[1] for x in of), 0.0))
    for _ in range(ROUNDS):
        every = [0.0, 0.0]
        both = [[[0.0, 0.0] for _ in features] for _ in features]
        for p in patterns:
            pos, neg = counts.get((p, True), 0), counts.get((p, False), 0)
            q = 1 / (1 + math.exp(-score[p]))
            g, h = pos - (pos + neg) * q, (pos + neg) * q * (1 - q)
            every[0] += g
            every[1] += h
            for j in bits[p]:
                row = both[j]
                for k in bits[p]:
                    row[k][0] += g
                    row[k][1] += h

        def sides(j):
            """For each second feature the sums of (neither, it alone) and of (the root alone, both)."""
            one = both[j][j]
            no, yes = [], []
            for k in features:
                yes.append((less(one, both[j][k]), both[j][k]))
                no.append((less(less(every, one), less(both[k][k], both[j][k])), less(both[k][k], both[j][k])))
            return no, yes

        def best(pairs):
            return max(features, key=lambda k: (round(gain(pairs[k][0]) + gain(pairs[k][1]), 9), -k))

        found = []
        for j in features:
            no, yes = sides(j)
            a, b = best(no), best(yes)
            parts = (*no[a], *yes[b])
            found.append((round(sum(map(gain, parts)), 9), -j, a, b, parts))
        _, root, a, b, parts = max(found, key=lambda x: x[:2])
        values = tuple(round(RATE * value(x), 6) for x in parts)
        trees.append((-root, a, b, values))
        for p in patterns:
            score[p] += raw_score(trees[-1:], p)
    return trees


def raw_score(trees, pattern: int) -> float:
    return round(sum(v[(2 + (pattern >> b & 1)) if pattern >> root & 1 else (pattern >> a & 1)] for root, a, b, v in trees), 6)


def calibrated(scored: dict[tuple[float, bool], int]) -> list[tuple[float, float]]:
    """(score, probability) of held-out candidates, given as counts of (score, label), by isotonic regression, scores ascending: neighbouring
    scores whose shares of right ones do not ascend are pooled."""
    by: dict[float, list[int]] = {}
    for (s, label), n in scored.items():
        by.setdefault(s, [0, 0])[label] += n
    pools: list[list] = []  # least score, wrong, right
    for s in sorted(by):
        pools.append([s, *by[s]])
        while len(pools) > 1 and pools[-2][2] * (pools[-1][1] + pools[-1][2]) >= pools[-1][2] * (pools[-2][1] + pools[-2][2]):
            _, wrong, right = pools.pop()
            pools[-1][1] += wrong
            pools[-1][2] += right
    return [(s, right / (wrong + right)) for s, wrong, right in pools]


def threshold(scored: dict[tuple[float, bool], int]) -> float:
    """Lowest score whose calibrated probability is ``PROBABLE``; inf: none."""
    return min((s for s, p in calibrated(scored) if p >= PROBABLE), default=math.inf)


def fitted(counts: dict[tuple[int, bool, int], int], n_features: int):
    """Trees for counts of (pattern, label, fold), and the least score to select. Each fold is scored by trees fitted to the other ones."""

    def of(folds):
        some: dict[tuple[int, bool], int] = {}
        for (p, label, fold), n in sorted(counts.items()):
            if fold in folds:
                some[p, label] = some.get((p, label), 0) + n
        return some

    scored: dict[tuple[float, bool], int] = {}
    for k in range(FOLDS):
        trees = boost(of(set(range(FOLDS)) - {k}), n_features)
        for (p, label), n in of({k}).items():
            at = raw_score(trees, p), label
            scored[at] = scored.get(at, 0) + n
    return boost(of(range(FOLDS)), n_features), threshold(scored)


def score_column(trees) -> Column:
    bit = lambda j: F.col("pattern").bitwiseAND(F.lit(1 << j)) != 0
    total = F.lit(0.0)
    for root, a, b, v in trees:
        total = total + F.when(bit(root), F.when(bit(b), v[3]).otherwise(v[2])).otherwise(F.when(bit(a), v[1]).otherwise(v[0]))
    return F.round(total, 6)


def selected(docs: DataFrame) -> DataFrame:
    """Rows (row, doc_id, text_hash, kind, start, end, base, chosen): all candidates, chosen where base or added; nulls for none."""
    rows = written(featured(spans(docs)), "candidates")
    counts = rows.where("label IS NOT NULL").groupBy("found_by", "pattern", "label", "fold").count().collect()  # bounded by the features
    chosen = F.col("base")
    for g in GENERATORS:
        trees, least = fitted({(r["pattern"], r["label"], r["fold"]): r["count"] for r in counts if r["found_by"] == g}, len(FORMATS[g]) + len(CONTEXT))
        if math.isfinite(least):
            chosen = chosen | ((F.col("found_by") == g) & (score_column(trees) >= least) & (score_column(trees) > 0))
    kept = rows.withColumn("chosen", F.coalesce(chosen, F.lit(False)))
    rank, kind = F.lit(0), F.col("found_by")
    for j, (g, (k, _)) in enumerate(GENERATORS.items(), 1):
        rank, kind = F.when(F.col("found_by") == g, j).otherwise(rank), F.when(F.col("found_by") == g, k).otherwise(kind)
    kept = kept.select("row", "doc_id", "text_hash", kind.alias("kind"), "start", "end", "base", "chosen", F.when(F.col("chosen"), rank).alias("rank"))
    by_start = Window.partitionBy("row").orderBy("start", "rank", "end")
    before, after = by_start.rowsBetween(Window.unboundedPreceding, -1), by_start.rowsBetween(1, Window.unboundedFollowing)
    overlaps = F.lit(False)
    for r, g in enumerate(GENERATORS, 1):
        above = (F.col("rank") < r) & ((F.col("rank") > 0) if g == "token" else F.lit(True))
        hit = (F.coalesce(F.max(F.when(above, F.col("end"))).over(before), F.lit(-1)) > F.col("start")) | (F.coalesce(F.min(F.when(above, F.col("start"))).over(after), F.lit(1 << 62)) < F.col("end"))
        overlaps = F.when(F.col("rank") == r, hit).otherwise(overlaps)
    return kept.withColumn("chosen", F.col("chosen") & ~overlaps).drop("rank")


def find(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans of every row."""
    rows = selected(docs)
    order = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind"))
    item = F.struct(order.alias("o"), "start", F.concat_ws(":", "kind", F.col("start").cast("string"), F.col("end").cast("string")).alias("s"))
    joined = lambda c: F.array_join(F.transform(F.sort_array(F.collect_list(F.when(c, item))), lambda x: x["s"]), ",")
    count = lambda k: F.count(F.when(F.col("base") & (F.col("kind") == k), 1)).alias(f"n_{k}")
    return rows.groupBy("row", "doc_id").agg(*(count(k) for k in KINDS[:4]), F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(F.col("chosen")).alias("spans")).drop("row")


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with every span of ``text`` replaced by its kind in brackets; of overlapping spans the first and longest counts. All rows
    and columns stay, whatever their names; null texts stay null."""
    rows = selected(docs).where("chosen").groupBy("doc_id", "text_hash", "start").agg(F.max(F.struct("end", "kind")).alias("s")).select("doc_id", "text_hash", "start", "s.end", "s.kind")
    before = Window.partitionBy("doc_id", "text_hash").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("covered", F.coalesce(F.max("end").over(before), F.lit(0)))
    # a span inside earlier ones goes, one that reaches beyond them starts where they end
    rows = rows.where(F.col("end") > F.col("covered")).withColumn("start", F.greatest("start", "covered"))
    of = rows.groupBy(F.col("doc_id").alias("r_doc_id"), F.col("text_hash").alias("r_hash")).agg(F.array_sort(F.collect_list(F.struct("start", "end", "kind"))).alias("r_spans"))
    own, c = positional(docs)
    text = F.col(c["text"])
    joined = own.join(of, own[c["doc_id"]].cast("long").eqNullSafe(of["r_doc_id"]) & (F.xxhash64(text) == of["r_hash"]), "left")
    last = lambda i: F.when(i > 0, F.get("r_spans", i - 1)["end"]).otherwise(F.lit(0))
    pieces = F.transform("r_spans", lambda s, i: F.concat(F.substring(text, (last(i) + 1).cast("int"), (s["start"] - last(i)).cast("int")), F.lit("["), s["kind"], F.lit("]")))
    rest = F.substring(text, (F.element_at("r_spans", -1)["end"] + 1).cast("int"), F.length(text))
    new = F.when(F.col("r_spans").isNull(), text).otherwise(F.concat(F.array_join(pieces, ""), rest))
    return joined.select(*((new if name == "text" else F.col(at)).alias(name) for name, at in c.items()))
