from millrace.llm import decontaminate as D

ITEM = "A farmer named Tom sells 12 eggs each day for 3 dollars and keeps 12 eggs for his old mother in the valley"
PLAIN = "rivers carry fine sand down to the wide plain where it settles slowly over many long winters"


def found(spark, docs, items):
    d = spark.createDataFrame(docs, "doc_id long, text string")
    i = spark.createDataFrame(items, "item_id long, text string")
    return {(r.doc_id, r.item_id): r.kind for r in D.contaminated(d, i).collect()}


def test_verbatim_and_reparameterised(spark):
    other = ITEM.replace("12", "40").replace("Tom", "Anna").replace("3 dollars", "7 euros")
    mixed = ITEM.replace("12", "40", 1)
    docs = [(1, "Before it all. " + ITEM + ". And after."), (2, "So, " + other + "!"), (3, mixed), (4, PLAIN.upper() + " and more"), (5, "nothing of that kind in here at all, only other words, none of them shared"), (6, None), (7, ""), (None, "x " + PLAIN), (1, "Before it all. " + ITEM + ". And after.")]
    got = found(spark, docs, [(0, ITEM), (1, PLAIN), (2, None), (3, "too short"), (None, PLAIN)])
    assert got == {(1, 0): "verbatim", (2, 0): "re-parameterised", (4, 1): "verbatim", (4, None): "verbatim", (None, 1): "verbatim", (None, None): "verbatim"}


def test_twice_with_other_values(spark):
    again = ITEM.replace("12", "40").replace("Tom", "Anna")
    assert found(spark, [(1, ITEM + ". " + again)], [(0, ITEM)]) == {(1, 0): "verbatim"}


def test_part_of_an_item(spark):
    w = PLAIN.split()
    assert found(spark, [(1, "zz " + " ".join(w[:13]) + " yy"), (2, "zz " + " ".join(w[:9]) + " yy")], [(0, PLAIN)]) == {(1, 0): "verbatim"}


def test_words_mark_slots(spark):
    df = spark.createDataFrame([("He met Tom (12.5km away), 1,200 m from the U.N. It's 30% \x01off",)], "text string")
    assert df.select(D.words(df.text).alias("w")).first().w == ["he", "met", "\x01ptom", "\x01n12.5", "\x01ukm", "away", "\x01n1,200", "\x01um", "from", "the", "u.n", "it's", "\x01n30", "\x01u%", "off"]


def test_long_text_and_empty_tables(spark):
    long = "filler words go on " * 40_000 + PLAIN
    assert found(spark, [(1, long)], [(0, PLAIN)]) == {(1, 0): "verbatim"}
    assert found(spark, [], [(0, PLAIN)]) == {} and found(spark, [(1, PLAIN)], []) == {}


def test_clean_documents_keep_their_columns(spark):
    docs = spark.createDataFrame([(1, PLAIN, "x", 3), (2, "clean", "y", 4), (None, None, None, None), (1, "another text", "z", 5)], "doc_id long, text string, h string, shift int")
    items = spark.createDataFrame([(0, PLAIN)], "item_id long, text string")
    out = D.clean_documents(docs, items)
    assert out.columns == docs.columns and sorted(map(tuple, out.collect()), key=str) == sorted([(2, "clean", "y", 4), (None, None, None, None), (1, "another text", "z", 5)], key=str)


def test_words_put_in_and_longer_names(spark):
    long = "Early each morning the keeper of the old harbour lamp walks along the narrow wall with his friend Tom and writes down how many boats came home during the night before the cold wind from the north turned the water grey again"
    w = long.split()
    at = len(w) // 2
    put_in = " ".join(w[:at] + ["really"] + w[at:])
    short = PLAIN.split()[:15]
    changed = " ".join(short[:7] + ["softly"] + short[8:])
    docs = [(1, put_in), (2, " ".join(w[:at] + w[at + 1 :])), (3, long.replace("Tom", "Mary Ann")), (4, changed), (5, PLAIN.upper())]
    got = found(spark, docs, [(0, long), (1, " ".join(short))])
    assert got == {(1, 0): "verbatim", (2, 0): "verbatim", (3, 0): "re-parameterised", (4, 1): "verbatim", (5, 1): "verbatim"}


def test_short_items_and_items_of_numbers(spark):
    items = [(0, "Name seven moons of Saturn"), (1, "two three four"), (2, "12 + 30 = 42 and 7 x 6 = 42 or 84 / 2"), (3, "What is it called here then")]
    docs = [(1, "quiz: Name seven moons of Saturn, please"), (2, "name seven suns of Saturn"), (3, "so 12 + 30 = 42 and 7 x 6 = 42 or 84 / 2 it is"), (4, "so 13 + 30 = 43 and 8 x 6 = 48 or 84 / 3 it is"), (5, "one two three four five"), (6, "what is it called"), (7, "they asked: what is it called here then?")]
    assert found(spark, docs, items) == {(1, 0): "verbatim", (3, 2): "verbatim", (7, 3): "verbatim"}


def test_short_items_inside_sentences(spark):
    items = [(0, "What is seven plus nine"), (1, "Name seven moons of Saturn"), (2, "Is it"), (3, "Yes"), (4, "Tom 12 Anna 30")]
    docs = [(1, "he asked What is seven plus nine in class"), (2, "he asked what is seven plus nine in class"), (3, "so: name seven moons of Saturn"), (4, "Then Name seven moons of Saturn now"), (5, "yes"), (6, "yes it is"), (7, "Is it?"), (8, "He asked. What is seven plus nine"), (9, "he saw Tom 12 Anna 30 there"), (10, "he asked What is seven plus ten in class")]
    assert found(spark, docs, items) == {(1, 0): "verbatim", (2, 0): "verbatim", (8, 0): "verbatim", (3, 1): "verbatim", (4, 1): "verbatim", (5, 3): "verbatim", (7, 2): "verbatim", (9, 4): "verbatim"}


def brute(docs, items):
    """(doc, item) pairs by loops over all windows, given lists of words."""
    template = lambda w: tuple(t[:2] if t.startswith(D.MARK) else t for t in w)
    out = set()
    for j, item in items.items():
        for size in (D.WINDOW, D.SHORT):
            if size == D.SHORT and not D.SHORT <= len(item) < D.SHORT_ITEM:
                continue
            cut = lambda w: [w[i : i + size] for i in range(len(w) - size + 1)]  # noqa: E731, B023
            usable = [(i, template(w)) for i, w in enumerate(cut(item)) if sum(not t.startswith(D.MARK) for t in w) >= D.LITERALS * size // D.WINDOW]
            values = not usable
            usable = usable or [(i, tuple(w)) for i, w in enumerate(cut(item))]
            needed = len(usable) if len(item) < D.WINDOW else D.COVERAGE * len(usable)
            if usable and usable[0][0] == 0 and not item[0].startswith(D.MARK) and item[0][0].isalpha():
                usable = usable + [(0, (D.MARK + "p" + (item[0] if values else ""), *usable[0][1][1:]))]
            for d, doc in docs.items():
                own = [tuple(w) if values else template(w) for w in cut(doc)]
                hits = [(i, p - i) for i, w in usable for p, x in enumerate(own) if w == x]
                groups = {}
                for i, shift in hits:
                    for band in ((0, shift), (1, shift // D.BAND), (2, (shift + D.BAND // 2) // D.BAND)):
                        groups.setdefault(band, set()).add((i, shift))
                for of in groups.values():
                    if len({i for i, _ in of}) >= needed and consistent(item, doc, sorted(of), size):
                        out.add((d, j))
    return out


def consistent(item, doc, hits, size):
    stands = {}
    get = lambda k: doc[k] if 0 <= k < len(doc) else None
    for at, value in enumerate(item):
        if not value.startswith(D.MARK) or not hits[0][0] <= at < hits[-1][0] + size:
            continue
        holding = {s for i, s in hits if i <= at < i + size}
        if not holding:
            near = {s for _, s in [h for h in hits if h[0] <= at][-1:] + [h for h in hits if h[0] > at][:1]}
            holding = near if len(near) == 1 else {s for s in near if (get(at + s) or "")[:2] == value[:2]}
        for s in holding:
            stands.setdefault(value, set()).add(get(at + s))
    return all(len(v) == 1 for v in stands.values())


def test_given_documents_match_brute_force(spark):
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet").where("length(text) < 30000")
    items = spark.read.parquet(f"{folder}/benchmark.parquet")
    words = lambda df, key: {r[0]: r[1] for r in df.select(key, D.words(df.text)).collect()}
    want = brute(words(docs, "doc_id"), words(items, "item_id"))
    assert want and {(r.doc_id, r.item_id) for r in D.contaminated(docs, items).collect()} == want
