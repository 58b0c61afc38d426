import math
import random
from collections import Counter

from millrace.llm import line_templates as L

WORDS = "amber birch cedar delta ember fjord grove heron inlet jetty knoll larch marsh north otter pines quarry river stone tarn umber vale willow".split()


def prose(rnd, n=12):
    return " ".join(rnd.choice(WORDS) for _ in range(n))


def run(spark, rows, schema="doc_id long, text string"):
    return {r.doc_id: r.text for r in L.drop_recurring_lines(spark.createDataFrame(rows, schema)).collect()}


def test_recurring_lines_and_fields(spark):
    rnd = random.Random(1)
    names = ["Ann", "Bea", "Cyd", "Dot", "Eve", "Fay", "Gus", "Hal"]
    own = {i: [prose(rnd), prose(rnd)] for i in range(8)}
    rows = [(i, f"{own[i][0]}\nPage {i} of 20\nPosted by user {names[i]} on the board today\n{own[i][1]}") for i in range(8)]
    assert run(spark, rows) == {i: "\n".join(own[i]) for i in range(8)}


def test_unrelated_lines_of_one_leaf_stay(spark):
    rnd = random.Random(2)
    rows = [(i, f"the old river {prose(rnd, 9)}\n{prose(rnd)}") for i in range(12)]
    assert run(spark, rows) == dict(rows)


def test_copies_keep_their_lines(spark):
    rnd = random.Random(3)
    base = [prose(rnd, 15) for _ in range(12)]
    rows = [(i, "\n".join(base)) for i in range(30)]
    for i in range(30, 50):  # near copies: one line changed
        lines = list(base)
        lines[rnd.randrange(1, 12)] = prose(rnd, 15)
        rows.append((i, "\n".join(lines)))
    out = run(spark, rows)
    assert sum(out[i] == t for i, t in rows) == len(rows)


def test_few_documents_are_not_enough(spark):
    rnd = random.Random(4)
    for line, least in (("All of this is boilerplate text here", L.DOCUMENTS), ("All of this is a longer boilerplate passage of text here", L.LONG_DOCUMENTS)):
        rows = [(i, f"{prose(rnd)}\n{line}") for i in range(least - 1)]
        assert run(spark, rows) == dict(rows)
        rows.append((9, f"{prose(rnd)}\n{line}\n\n \n{prose(rnd)}"))
        assert all(line not in t for t in run(spark, rows).values())


def test_copies_do_not_hide_a_line_of_other_documents(spark):
    rnd = random.Random(6)
    line = "See the notes of the river office on the last page of this book"
    base = [prose(rnd, 15) for _ in range(12)]
    rows = [(i, f"{prose(rnd)}\n{line}\n{prose(rnd)}") for i in range(6)]
    for i in range(10, 60):  # a group of near copies, each with a word of its own changed
        words = "\n".join(base[:6] + [line] + base[6:]).split(" ")
        words[rnd.randrange(20)] = f"changed{rnd.choice(WORDS)}"
        rows.append((i, " ".join(words)))
    out = run(spark, rows)
    assert not any(line in t for t in out.values())
    assert all(all(x in out[i] for x in base[7:]) for i in range(10, 60))


def test_fields_in_a_mixed_leaf(spark):
    """Unrelated lines begin alike and have as many tokens."""
    rnd = random.Random(7)
    names = ["Ann", "Bea", "Cyd", "Dot", "Eve", "Fay", "Gus", "Hal"]
    rows = [(i, f"{prose(rnd)}\nPosted by user {names[i]} on the board today\n{prose(rnd)}") for i in range(8)]
    rows += [(100 + i, f"{prose(rnd)}\nPosted by user {prose(rnd, 5)}") for i in range(40)]
    out = run(spark, rows)
    assert not any("board" in out[i] for i in range(8)) and all(out[i] == t for i, t in rows if i >= 100)


def brute(texts):
    """Dropped (document, line position), by loops over all lines."""
    lines = {d: L.parse(t) for d, t in texts.items() if t is not None}
    of_leaf, distinct = {}, {}
    for d, own in lines.items():
        for *_, leaf, line, masked in own:
            of_leaf.setdefault(leaf, set()).add(texts[d])
            distinct.setdefault(leaf, {})[line] = masked.split(" ")
    template = {}
    for leaf, own in distinct.items():
        if len(of_leaf[leaf]) >= L.LONG_DOCUMENTS:
            for line, tokens in own.items():
                support = [sum(other[i] == t for other in own.values()) for i, t in enumerate(tokens)]
                least = L.RARE * sorted(support, reverse=True)[math.ceil(L.FIXED * len(tokens)) - 1]
                template[line] = (leaf, tuple(L.FIELD if n < least else t for t, n in zip(tokens, support)))
    having = {}
    for d, own in lines.items():
        for *sketches, _, leaf, line, _ in own:
            if line in template:
                held = having.setdefault(template[line], {})
                held[texts[d]] = tuple(map(min, zip(sketches[:4], held.get(texts[d], sketches[:4]))))
    drop = set()
    for t, held in having.items():
        counts = [Counter(s[k] for s in held.values()) for k in range(4)]
        alone = sum(all(c[x] == 1 for c, x in zip(counts, s)) for s in held.values())
        groups = min(sum(n > 1 for n in c.values()) for c in counts)
        if alone + groups >= max(L.LONG_DOCUMENTS if len(t[1]) >= L.LONG else L.DOCUMENTS, L.APART * len(held)):
            drop.add(t)
    return {d: sorted(at for *_, at, _, line, _ in own if template.get(line) in drop) for d, own in lines.items()}


def test_given_documents_match_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    texts = {r.doc_id: r.text for r in docs.collect()}
    texts = {d: t for d, t in texts.items() if t is None or len(t) < 20_000}
    want = brute(texts)
    out = {r.doc_id: r.text for r in L.drop_recurring_lines(docs.where("text IS NULL OR length(text) < 20000")).collect()}
    assert sum(map(len, want.values())) > 10
    for d, t in texts.items():
        assert out[d] == (t and "\n".join(x for i, x in enumerate(t.split("\n")) if i not in want[d]))


def test_awkward_rows(spark):
    rnd = random.Random(5)
    line = "See our terms of use page"
    rows = [(i, f"{line}\n{prose(rnd)}", "x", 5) for i in range(6)]
    rows += [(None, f"{line}\nown words here now", None, None), (None, None, None, None), (7, "", "x", 0), (8, None, "y", 1), (0, f"{prose(rnd)}\n{line}", "x", 9), (9, "one two " * 100_000, "x", 1), (5, rows[5][1], "x", 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, l_drops string, n_chars long")
    out = L.drop_recurring_lines(df).collect()
    assert L.drop_recurring_lines(df).columns == df.columns and len(out) == len(rows)
    got = {(r.doc_id, r.text, r.l_drops, r.n_chars) for r in out}
    assert {(None, "own words here now", None, 18), (None, None, None, None), (7, "", "x", 0), (8, None, "y", 1), (9, "one two " * 100_000, "x", 1)} <= got
    assert not any(line in (t or "") for _, t, *_ in got)
    assert L.drop_recurring_lines(df.limit(0)).count() == 0
