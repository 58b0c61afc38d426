import random
import re
from collections import Counter

import numpy as np
import regex

from millrace.llm import quality as Q

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    t = text or ""
    w = WORD.findall(t)
    c = Counter(zip(w, w[1:], w[2:]))
    covered = {i + k for i, g in enumerate(zip(w, w[1:], w[2:])) if c[g] > 1 for k in range(3)}
    lines = [x for x in t.split("\n") if WORD.search(x)]
    failed = len(w) < 50 or 100 * len(covered) > 50 * len(w)
    return len(w), sum(map(len, w)), sum(x in "#*$%&|<>" for x in t), len(lines) - len(set(lines)), len(covered), failed


def run(spark, texts):
    df = spark.createDataFrame([(i, t, "x", [1]) for i, t in enumerate(texts)], "doc_id long, text string, kept string, q_words array<int>")
    return {r.doc_id: r for r in Q.quality(df).collect()}


def test_base_matches_brute_force(spark):
    rnd = random.Random(2)
    texts = [None, "", "\n \n", "a\n\na\n b\na", "a b c a b c a b", "x" * 100_000, "a " * 30_000, "é\xa0\x85 \x0bü#*$%&|<>\n\n \t", "a b c d a b c\n" * 40]
    texts += ["".join(rnd.choice(["a ", "b ", "c\n", "D# ", "é\t", "\n", "fgh "]) for _ in range(rnd.randrange(200))) for _ in range(60)]
    out = run(spark, texts)
    for i, t in enumerate(texts):
        r = out[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == brute(t), t[:80]
        assert not (r.base_failed and r.kept)


def prose(rnd, n=120):
    w = ["the", "of", "river", "walked", "and", "stone", "small", "house", "near", "with", "bright", "morning", "to", "garden", "for", "old", "he", "was", "letter", "wrote"]
    return " ".join(rnd.choice(w) + ("." if k % 11 == 10 else "") for k in range(n))


def test_votes_tell_junk_from_prose(spark):
    rnd = random.Random(4)
    good = [prose(rnd) for _ in range(150)]
    junk = [prose(rnd).upper().replace(" ", "!! ") for _ in range(8)] + [" ".join(x + rnd.choice(["%%%", "$$$"]) for x in prose(rnd).split()) for _ in range(8)] + [" | ".join(rnd.choice(["alpha", "beta", "gamma", "delta", "omega", "sigma"]) + str(k) for k in range(90)) for _ in range(8)]
    out = run(spark, good + junk)
    assert all(out[i].kept for i in range(150)) and not any(out[150 + i].kept for i in range(24))


def test_fit_keeps_every_pattern_finite():
    prior, weights = Q.fit({(1,) * 8: 5})
    assert prior > 0 and len(weights) == 8
    assert Q.fit({})[0] == 0.0


def test_awkward_rows(spark):
    rows = [(None, "a", "l", "s", 1), (None, None, None, None, None), (1, prose(random.Random(1)), "l", "s", 1), (1, prose(random.Random(1)), "l", "s", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert Q.quality(df).count() == 4
    kept = Q.kept_documents(df)
    assert kept.columns == df.columns and [r.doc_id for r in kept.collect()] == [1, 1]
    assert Q.quality(df.limit(0)).count() == 0 and Q.kept_documents(df.limit(0)).count() == 0


def brute_verdicts(texts):
    """Votes by plain rules and expectation-maximisation over documents, not patterns."""
    votes, failed = [], []
    for t in texts:
        t = t or ""
        n, chars, symbols, _, repeats, bad = brute(t)
        w, m = WORD.findall(t), max(n, 1)
        distinct, capitals = len(set(w)), len(regex.findall(r"\p{Lu}", t))
        exclaims, ends, function = t.count("!"), len(re.findall(r"[.?!](?=[\x20\x09-\x0D]|\Z)", t)), len(set(w) & set(Q.FUNCTION_WORDS))
        rules = [
            (repeats > 0.4 * m, repeats <= 0.05 * m), (symbols > 0.1 * m, symbols <= 0.01 * m), (exclaims > 0.3 * m, exclaims <= 0.02 * m), (capitals > 0.3 * chars, capitals <= 0.1 * chars),
            (function == 0, function >= 4), (chars < 3 * m or chars > 10 * m, 3.5 * m <= chars <= 7 * m), (distinct < 0.15 * m, distinct >= 0.4 * m), (ends == 0, 0.02 * m <= ends <= 0.3 * m),
        ]
        votes.append([-1 if b else 1 if g else 0 for b, g in rules])
        failed.append(bad)
    v, failed = np.array(votes), np.array(failed)
    own = v[~failed]
    good = np.where((own < 0).any(axis=1), 0.02, 0.98)
    for _ in range(100):
        mass = good.sum(), len(own) - good.sum()
        prior = np.log((mass[0] + 1) / (mass[1] + 1))
        rate = {x: (np.log(((own == x) * good[:, None]).sum(axis=0) + 1) - np.log(mass[0] + 3), np.log(((own == x) * (1 - good)[:, None]).sum(axis=0) + 1) - np.log(mass[1] + 3)) for x in (-1, 0, 1)}
        odds = lambda z: prior + sum(((z == x) * (rate[x][0] - rate[x][1])).sum(axis=1) for x in rate)  # noqa: B023, E731
        new = 1 / (1 + np.exp(-odds(own)))
        moved, good = abs(new - good).max(), new
        if moved < 1e-9:
            break
    return ~failed & (odds(v) >= 0)


def test_verdicts_of_given_documents_match_brute_force(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").where("text IS NULL OR length(text) < 50000").orderBy("doc_id").collect()
    want = brute_verdicts([r.text for r in rows])
    out = run(spark, [r.text for r in rows])
    got = np.array([out[i].kept for i in range(len(rows))])
    assert 0 < want.sum() < len(rows) and (got == want).all()


def test_kept_documents_keep_clashing_columns(spark):
    rnd = random.Random(8)
    rows = [(i, prose(rnd), "mine", [i]) for i in range(30)] + [(None, None, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, q_text string, q_words array<int>")
    out = Q.kept_documents(df)
    assert out.columns == df.columns and {(r.doc_id, r.text, r.q_text, tuple(r.q_words)) for r in out.collect()} <= {(a, b, c, tuple(d or ())) for a, b, c, d in rows} and out.count() >= 25
    assert Q.kept_documents(df.limit(0)).count() == 0
