"""Operator 3: quality rules by weak supervision, in DataFrame operations only.

Each rule votes good (+1), bad (-1) or abstains (0) on a document. Expectation-maximisation over a two-class latent model learns,
from the votes of all documents and without labels, how often each rule casts each vote on either class; the posterior
probability of quality given a document's votes decides. Documents that fail the base test are rejected whatever the votes.

The votes of all documents are summed up to counts of vote patterns, of which there are 3**8 at most, so fitting takes a table
bounded by the rules and not by the documents, and nothing is sampled. The fit starts from "any bad vote is bad".

All word work stays in array expressions of a document's own row: no shuffle of words. Three-word windows are compared by
XXH64 of their words within a document.

Defined results: null text has no words; texts under ``MIN_WORDS`` words fail; repeated rows each give a row; further columns,
whatever their names, are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import WORD, bind, positional, written

MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
RULES = ("repeats", "symbols", "exclaims", "capitals", "function_words", "word_length", "variety", "sentences")
#: Posterior probability of quality from which a document is kept.
KEEP = 0.5

# Frequent function words of English, French, Spanish and German.
FUNCTION_WORDS = "the of and to in is that for it with be by on this are as was from de la le les et en que el los las un une des du pour dans qui est por con se no der die das und ist von mit den des ein eine zu auf für nicht sich dem".split()


def _repeat_words(words: Column) -> Column:
    """Words that lie in a three-word window found twice or more."""

    def covered(starts: Column) -> Column:
        # starts ascend; each window adds three words less the overlap with the next
        return F.aggregate(F.sequence(F.lit(0), F.size(starts) - 1), F.lit(0), lambda acc, j: acc + F.when(j + 1 < F.size(starts), F.least(F.lit(3), F.get(starts, j + 1) - F.get(starts, j))).otherwise(3))

    def again(by_hash: Column) -> Column:
        same = lambda a, b: F.get(by_hash, a)["h"] == F.get(by_hash, b)["h"]
        flagged = F.filter(by_hash, lambda e, j: F.coalesce(F.when(j > 0, same(j - 1, j)), F.lit(False)) | F.coalesce(same(j + 1, j), F.lit(False)))
        return bind(F.sort_array(F.transform(flagged, lambda e: e["i"])), lambda starts: F.when(F.size(starts) == 0, 0).otherwise(covered(starts)))

    hashes = F.transform(F.sequence(F.lit(0), F.size(words) - 3), lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)))

    def count(h: Column) -> Column:
        indexed = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), 0).otherwise(bind(indexed, again))

    return F.when(F.size(words) < 3, 0).otherwise(bind(hashes, count)).cast("long")


def with_features(docs: DataFrame, keep: list[str]) -> DataFrame:
    """Columns ``keep`` of docs, with n_words, the base counts and the figures that rules look at, prefixed ``q_``."""
    text = F.coalesce(F.col("text"), F.lit(""))
    step = docs.select(*keep, text.alias("q_text"))
    step = step.withColumn("q_words", F.array_remove(F.split("q_text", r"[\x20\x09-\x0D]+"), ""))
    # n_words and the words are both used below, so they are computed once
    step = step.withColumn("q_distinct", F.array_distinct("q_words")).withColumn("q_lines", F.filter(F.split("q_text", "\n"), lambda x: x.rlike(WORD)))
    n = F.size("q_words").cast("long")
    return step.select(
        *keep,
        n.alias("q_n_words"),
        F.length(F.array_join("q_words", "")).cast("long").alias("q_word_chars"),
        F.regexp_count("q_text", F.lit("[#*$%&|<>]")).cast("long").alias("q_n_symbols"),
        (F.size("q_lines") - F.size(F.array_distinct("q_lines"))).cast("long").alias("q_n_dup_lines"),
        _repeat_words(F.col("q_words")).alias("q_n_repeat_words"),
        F.regexp_count("q_text", F.lit("!")).cast("long").alias("q_exclaims"),
        F.regexp_count("q_text", F.lit(r"\p{Lu}")).cast("long").alias("q_capitals"),
        F.size(F.array_intersect("q_distinct", F.array(*map(F.lit, sorted(set(FUNCTION_WORDS)))))).cast("long").alias("q_function_words"),
        F.size("q_distinct").cast("long").alias("q_n_distinct"),
        F.regexp_count("q_text", F.lit(r"[.?!](?=[\x20\x09-\x0D]|\z)")).cast("long").alias("q_sentences"),
    )


def votes() -> dict[str, Column]:
    """The rules: -1 bad, +1 good, 0 abstains."""
    c = F.col
    n = F.greatest(c("q_n_words"), F.lit(1))

    def vote(bad: Column, good: Column) -> Column:
        return F.when(bad, -1).when(good, 1).otherwise(0)

    found = {
        "repeats": vote(c("q_n_repeat_words") > 0.4 * n, c("q_n_repeat_words") <= 0.05 * n),
        "symbols": vote(c("q_n_symbols") > 0.1 * n, c("q_n_symbols") <= 0.01 * n),
        "exclaims": vote(c("q_exclaims") > 0.3 * n, c("q_exclaims") <= 0.02 * n),
        "capitals": vote(c("q_capitals") > 0.3 * c("q_word_chars"), c("q_capitals") <= 0.1 * c("q_word_chars")),
        "function_words": vote(c("q_function_words") == 0, c("q_function_words") >= 4),
        "word_length": vote((c("q_word_chars") < 3 * n) | (c("q_word_chars") > 10 * n), (c("q_word_chars") >= 3.5 * n) & (c("q_word_chars") <= 7 * n)),
        "variety": vote(c("q_n_distinct") < 0.15 * n, c("q_n_distinct") >= 0.4 * n),
        "sentences": vote(c("q_sentences") == 0, (c("q_sentences") >= 0.02 * n) & (c("q_sentences") <= 0.3 * n)),
    }
    assert tuple(found) == RULES
    return found


def base_failed() -> Column:
    return (F.col("q_n_words") < MIN_WORDS) | (100 * F.col("q_n_repeat_words") > MAX_REPEAT_PERCENT * F.col("q_n_words"))


def fit(patterns: dict[tuple[int, ...], int], rounds: int = 100) -> tuple[float, list[dict[int, float]]]:
    """Log-odds of quality before any vote, and for each rule the log-odds that each of its votes adds.

    ``patterns``: documents for each tuple of votes. One pseudo-document of each vote and class keeps rates off 0 and 1.
    """
    total = sum(patterns.values())
    if not total:
        return 0.0, [{-1: -1.0, 0: 0.0, 1: 1.0} for _ in RULES]
    good = {p: 0.02 if min(p) < 0 else 0.98 for p in patterns}
    prior, weights = 0.0, []
    for _ in range(rounds):
        mass = {+1: sum(n * good[p] for p, n in patterns.items())}
        mass[-1] = total - mass[+1]
        prior = math.log((mass[+1] + 1) / (mass[-1] + 1))
        weights = []
        for j in range(len(RULES)):
            w = {}
            for v in (-1, 0, 1):
                of_good = sum(n * good[p] for p, n in patterns.items() if p[j] == v)
                of_bad = sum(n * (1 - good[p]) for p, n in patterns.items() if p[j] == v)
                w[v] = math.log((of_good + 1) / (mass[+1] + 3)) - math.log((of_bad + 1) / (mass[-1] + 3))
            weights.append(w)
        new = {p: 1 / (1 + math.exp(-max(-500.0, min(500.0, prior + sum(w[v] for w, v in zip(weights, p)))))) for p in patterns}
        moved = max(abs(new[p] - good[p]) for p in patterns)
        good = new
        if moved < 1e-9:
            break
    return prior, weights


def posterior(model: tuple[float, list[dict[int, float]]]) -> Column:
    prior, weights = model
    odds = F.lit(prior)
    for name, w in zip(RULES, weights):
        v = F.col(f"q_vote_{name}")
        odds = odds + F.when(v < 0, w[-1]).when(v > 0, w[1]).otherwise(w[0])
    return 1 / (1 + F.exp(-odds))


def rated(docs: DataFrame, keep: list[str]) -> DataFrame:
    """``keep`` columns, features, votes, q_quality and q_kept of every row. Features are written once in the shared folder."""
    featured = with_features(docs, keep)
    rows = written(featured.select("*", *(v.alias(f"q_vote_{k}") for k, v in votes().items())), "quality")
    names = [f"q_vote_{k}" for k in RULES]
    # at most 3**8 rows; rejected documents say nothing about quality beyond the base test
    counts = rows.where(~base_failed()).groupBy(*names).count().collect()
    model = fit({tuple(r[:-1]): r[-1] for r in counts})
    return rows.withColumn("q_quality", posterior(model)).withColumn("q_base_failed", base_failed()).withColumn("q_kept", ~F.col("q_base_failed") & (F.col("q_quality") >= KEEP))


def quality(docs: DataFrame) -> DataFrame:
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    base = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "quality"]
    return rated(own, ["doc_id"]).select("doc_id", *(F.col(f"q_{c}").alias(c) for c in base))


def kept_documents(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are kept, with its own columns only, whatever their names. Null and empty texts fail the base test, so an
    all-null table gives no rows; repeated rows share a verdict."""
    own, c = positional(docs)
    rows = rated(own.withColumn("text", F.col(c["text"])), [*c.values()])
    return rows.where("q_kept").select(*(F.col(at).alias(name) for name, at in c.items()))
