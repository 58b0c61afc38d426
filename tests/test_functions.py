"""Rows that the given tables do not hold: CJK, emoji, other line ends, bad vectors, markup, encodings."""

import datetime
import math
import random
import re

import pytest
import regex
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from millrace.functions import gates, text, vectors
from millrace.operators import chunk, library, rag, search, tags, timeline
from millrace.sources import ingest


def column(spark, values, kind, f):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r.x for r in df.select("i", f(F.col("v")).alias("x")).orderBy("i").collect()]


def test_visible_and_plain_text(spark):
    values = ["a", " \n\t", "​‍", "́", "\x00a", "a\x85", "a\tb\n\f\r", "﷐x", None, "中"]
    assert column(spark, values, "string", gates.has_visible_text) == [True, False, False, False, True, True, True, True, False, True]
    assert column(spark, values, "string", gates.plain_text_ok) == [True, False, False, False, False, False, True, False, False, True]


def test_newlines_and_titles(spark):
    assert column(spark, ["a\r\nb\rc\n\r\n"], "string", text.normalize_newlines) == ["a\nb\nc\n\n"]
    assert column(spark, ["a.txt", "a.b.md", ".hidden", "plain", " ", None], "string", gates.title_of) == ["a", "a.b", ".hidden", "plain", "Untitled", "Untitled"]


def test_vectors(spark):
    good = [0.6, 0.8]
    values = [good, [0.6], [0.0, 0.0], [float("nan"), 1.0], [float("inf"), 0.0], [2.0, 0.0], None, [None, 1.0]]
    assert column(spark, values, "array<double>", lambda v: gates.vector_ok(v, 2)) == [True] + [False] * 7
    assert column(spark, values[:3], "array<double>", lambda v: F.round(vectors.cosine(v, F.array(F.lit(1.0), F.lit(0.0))), 6)) == [0.6, 0.0, 0.0]


def test_lexical_terms(spark):
    got = column(spark, ["Hello, hello WORLD!", "中文 a 字", "", None, " ".join(f"w{i:03d}" for i in range(90))], "string", text.lexical_terms)
    assert got[0] == ["hello", "world"] and got[1] == sorted(["中文", "a", "字", "文字"]) and got[2] == [] and got[3] == [] and len(got[4]) == 64


def test_html(spark):
    pages = {
        "<p>One<br>two &amp;lt; &copy; &#65;&#x42; &nope; &#0;</p><!-- x --><script>var a = '<p>';</script><table><tr><td>a</td><td>b</td></tr></table>": "One\ntwo &lt; © AB &nope; &#0;\na\tb",
        '<a title="x > y">link</a>  and\n\n more': "link and more",
        "<pre> x\n  y &lt;b&gt; <i>z</i></pre><p>after  all": "x\n  y <b> z\nafter all",
        "a<pre>b\n</pre>c": "a\nb\nc",
        "plain & simple, a < b and <3> c": "plain & simple, a < b and c",
        "<style>p > a { }</style>x<script>if (a<b) '</p>'</script\n>y<script>never closed <b": "xy",
        "<head><template>a</template>b<style></head></style></head>c<template>d<template>e</template>f</template>g": "cg",
        '<!DOCTYPE x [<!ENTITY a "b>"> [c] ]><?xml version="1"?>t<!-->u': "tu",
        "&nbsp; a&#10;&nbsp;b&emsp;<br/> c": "a b\nc",
        "<script/>seen<head/>too": "seentoo",
        "": "",
    }
    got = column(spark, list(pages), "string", text.html_to_text)
    assert got == list(pages.values())
    broken = ["<p>open <b", "<p>a</p><!-- never closed", '<a title="x>y', "x</p", "<!DOCTYPE [", "<1 a"]
    assert [tuple(r) for r in column(spark, [*broken, None], "string", text.html_parsed)] == [(None, "unterminated")] * 6 + [(None, None)]


def stack_reader(html):
    """Visible text of markup of text, heads, templates and their ends only."""
    stack, out = [], []
    for piece in re.findall(r"<[^>]*>|[^<]+", html):
        if not piece.startswith("<"):
            out += [piece] if not stack else []
        elif piece.startswith("</"):
            if stack and stack[-1] == piece[2:-1]:
                stack.pop()
        elif not piece.endswith("/>"):
            stack.append(piece[1:-1])
    return "".join(out)


def test_hidden_elements_of_any_depth(spark):
    rng = random.Random(6)
    pieces = ["<head>", "</head>", "<template>", "</template>", "<head/>", "<template/>", "a", "b", "c"]
    pages = ["".join(rng.choice(pieces) for _ in range(rng.randrange(30))) for _ in range(400)]
    pages += ["<template>" * n + "x" + "</template>" * n + "after" for n in (1, 4, 50, 3_000)]
    pages += ["<template>" * n + "x" + "</template>" * (n - 1) + "after" for n in (2, 50)]
    pages += ["<template>x</template>y" * 5_000 + "<head>" * 9 + "z"]
    assert column(spark, pages, "string", text.html_to_text) == [stack_reader(p) for p in pages]
    mixed = "<head><template><script>'</template>'</script><style></head></style>a</template>b</head><p>c<TEMPLATE id='>'>d<Head >e</HEAD\n>f</template >g"
    assert column(spark, [mixed], "string", text.html_to_text) == ["cg"]


def test_preformatted_parts_within_one_another(spark):
    pages = {"<pre>a  b<pre> c  d</pre>  e  f</pre>  g  h": "a  b\n c  d\n  e  f\ng h", "</pre>a  b<pre>c  d": "a b\nc  d", "<pre>" * 40 + "a  b" + "</pre>" * 40 + "c  d": "a  b\nc d"}
    assert column(spark, list(pages), "string", text.html_to_text) == list(pages.values())


def test_html_of_any_length(spark):
    n = 1 << 20
    values = ["<p " + "a" * n + ">x", "<p " + "a" * n, "<p " + "a='b' " * (n // 6) + ">x", "<b>" * (n // 4) + "x", "<pre>" + "a\n" * n, "<template>" * 2_000 + "x", "<head>" + "<b>y</b>" * (n // 8) + "</head>x", "<" * 5_000, "<!" + "[" * 1_000, "<script>" + "<" * n]
    got = column(spark, values, "string", text.html_parsed)
    assert [r.problem for r in got] == [None, "unterminated", None, None, None, None, None, None, "unterminated", None]
    assert [r.text for r in got][:4] == ["x", None, "x", "x"] and [r.text for r in got][5:8] == ["", "x", "<" * 5_000]


def test_loopback(spark):
    good = ["http://localhost", "https://127.0.0.1:8080/", "http://[::1]:1"]
    bad = ["http://localhost:65536", "http://localhost:99999/", "http://localhost/x", "http://localhost?q", "http://localhost#f", "ftp://localhost", "http://u@localhost", "http://example.com", "http://127.0.0.2", "localhost", "", None, "http://localhost.example.com"]
    assert column(spark, good + bad, "string", gates.loopback_url_ok) == [True] * 3 + [False] * 13


def test_decode_text(spark):
    t = "Grüße, 世界 and\r\nmore plain ASCII words"
    ascii_ = "only plain words here, enough of them to tell"
    values = [t.encode(), b"\xef\xbb\xbf" + t.encode(), b"\xff\xfe" + t.encode("utf-16-le"), b"\xfe\xff" + t.encode("utf-16-be"), b"\xff\xfe\x00\x00" + t.encode("utf-32-le"), b"\x00\x00\xfe\xff" + t.encode("utf-32-be")]
    assert column(spark, values, "binary", ingest.decode_text) == [t] * 6
    assert column(spark, [ascii_.encode(e) for e in ("utf-16-le", "utf-16-be", "utf-32-le", "utf-32-be")], "binary", ingest.decode_text) == [ascii_] * 4
    assert column(spark, [b"\xff\xfea", b"\xc3\x28", b""], "binary", ingest.decode_text) == [None, None, ""]


def test_sniffing(spark):
    heads = [b" \n%PDF-1.7", b"PK\x03\x04x", b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1", b"{\\rtf1", b"\x89PNG\r\n\x1a\n", b"  <!DOCTYPE HTML>", b"<html>", b"<x>", b"text", b""]
    assert column(spark, heads, "binary", lambda v: ingest.sniff_format(v, F.lit("a.txt"))) == ["pdf", "zip", "ole", "rtf", "binary", "html", "html", "text", "text", "text"]
    assert column(spark, [b"<x>"], "binary", lambda v: ingest.sniff_format(v, F.lit("a.HTM"))) == ["html"]
    more = [b"SQLite format 3\x00", b"bplist00", b"\xce\xfa\xed\xfe", b"\xfe\xed\xfa\xcf", b"\xfe\xed\xfa\xce", b" \r\n {\\rtf1", b"GIF88a", b"MZ is how it starts", b"BZh is text"]
    assert column(spark, more, "binary", lambda v: ingest.sniff_format(v, F.lit("a.txt"))) == ["binary"] * 5 + ["rtf"] + ["text"] * 3
    media = [b"\xff\xd8\xff\xe0", b"RIFF0000WAVE", b"RIFF0000WEBP", b"0000ftypqt  ", b"0000ftypisom", b"\xff\xfe\x00\x00", b"ID3", b"\xff\xfb\x90", b"abc"]
    assert column(spark, media, "binary", ingest.sniff_media) == ["jpeg", "wav", "webp", "mov", "mp4", None, "mp3", "mp3", None]
    box = lambda name, body=b"": (8 + len(body)).to_bytes(4, "big") + name + body
    more = {b"RIFX0000WAVE": "wav", b"RF64....WAVE": "wav", b"RIFF0000abcd": None, b"BM" + bytes(12): "bmp", b"BM" + bytes(6): None, b"BMxxxxxxxxxxxxxx": None, b"\xff\xf1\x00": "aac", b"\xff\xf9": "aac", b"\xff\xe3": "mp3", b"FLV\x01": "flv", b"\x00\x00\x01\xb3": "mpg", b"\xff\x4f\xff\x51": "jp2"}
    more |= {box(b"free", b"abc") + box(b"wide") + box(b"ftyp", b"avis"): "avif", box(b"skip") + box(b"moov"): "mov", box(b"ftyp", b"M4A "): "m4a", box(b"ftyp", b"msf1"): "heic", box(b"free", b"x") + b"text": None, box(b"mdat"): "mov", b"\x00\x00\x00\x00free": None, b"": None, box(b"free") * 3000 + box(b"ftyp", b"qt  "): "mov", box(b"skip") * 8191 + box(b"moov"): "mov", box(b"wide") * 8192 + box(b"moov"): None}
    assert column(spark, list(more), "binary", ingest.sniff_media) == list(more.values())


def test_scan_files(spark, tmp_path):
    root = tmp_path / ".library"  # only what lies below the folder counts
    for name in ("a.txt", "b/c.txt", ".hidden/d.txt", "b/.e.txt", "Tool.app/x.txt"):
        p = root / name
        p.parent.mkdir(exist_ok=True, parents=True)
        p.write_text(name)
    names = lambda df: [r.path.rsplit("/", 1)[1] for r in df.select("path").collect()]
    assert names(ingest.scan_files(spark, [str(root)])) == ["a.txt", "c.txt"]
    assert names(ingest.scan_files(spark, [str(root), str(root / "b")])) == ["a.txt", "c.txt"]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from([*"ab .;\n。é", "👨‍👩‍👧", "é", "\r\n"]), max_size=400).map("".join), st.integers(-1, 90), st.integers(-5, 200))
def test_chunks_rebuild_their_page(page, size, overlap):
    cuts = chunk.cut(page, size, overlap)
    if size <= 0:
        assert cuts == []
        return
    units = regex.findall(r"\X", page)
    for start, end, piece in cuts:
        assert 0 < end - start <= size and piece == "".join(units[start:end]) and piece.strip()
    seen = set()
    for start, end, _ in cuts:
        seen |= set(range(start, end))
    assert all(not units[i].strip() for i in range(len(units)) if i not in seen)


def test_chunk_pages_and_ordinals(spark):
    pages = spark.createDataFrame([(1, 1, "a" * 1300), (1, 2, "  "), (1, 3, "end."), (2, 1, None)], "doc_id long, page int, text string")
    got = [(r.doc_id, r.page, r.start, r.end, r.ordinal) for r in chunk.with_ordinals(chunk.chunk_pages(pages)).orderBy("doc_id", "ordinal").collect()]
    assert got == [(1, 1, 0, 1200, 0), (1, 1, 1040, 1300, 1), (1, 3, 0, 4, 2)]


def test_segments(spark):
    assets = spark.createDataFrame([(1, "audio", 20.25), (2, "video", 10.01), (3, "audio", 0.01), (4, "video", 10.0), (5, "video", 0.0)], "asset_id long, kind string, duration double")
    got = {}
    for r in timeline.segments(assets).orderBy("asset_id", "ordinal").collect():
        got.setdefault(r.asset_id, []).append((r.start_s, r.end_s))
    assert got == {1: [(0.0, 10.0), (10.0, 20.0), (20.0, 20.25)], 2: [(0.0, 9.99), (9.99, 10.01)], 4: [(0.0, 10.0)]}
    assert all(r.covered for r in timeline.coverage_audit(timeline.segments(assets), assets).collect())


def test_citations(spark):
    values = ["x [1]", "x [4]", "x [0]", "x [01]", "x [99999999999999999999]", "none", "Not enough information in the sources.", "[1] [2] [3]", "[1] [7]"]
    assert column(spark, values, "string", lambda v: rag.citations_ok(v, F.lit(3))) == [True, False, False, False, False, False, True, True, False]


def test_tags(spark):
    assert column(spark, [[" b ", "a", "a", "", "x" * 40]], "array<string>", tags.normalized) == [["a", "b", "x" * 32]]
    assert column(spark, ["b， a、c；a\n,"], "string", tags.parsed_input) == [["a", "b", "c"]]
    df = spark.createDataFrame([("the art of go, ünder 中文字",)], "v string")
    hit = lambda *t: df.select(tags.anchored(list(t), F.col("v")).alias("x")).first().x
    assert hit("art") and hit("中文") and not hit("ar") and not hit("g") and hit("zz", "go") and not hit("a.t")


def test_tag_select_abstains(spark):
    flat = [(1, f"t{i}", 0.5, False) for i in range(5)]
    clear = [(2, "a", 0.9, True), (2, "b", 0.85, False), (2, "c", 0.3, False), (2, "d", 0.3, False), (2, "e", 0.3, False)]
    out = tags.select(spark.createDataFrame(flat + clear, "doc_id long, label string, semantic double, anchored boolean")).collect()
    assert [(r.doc_id, r.position, r.label) for r in out] == [(2, 1, "a")]


def test_search_prefers_text_and_breaks_ties(spark):
    q = spark.createDataFrame([(1, "k", "blue sky", [1.0, 0.0])], "query_id long, kb_id string, text string, embedding array<float>")
    c = spark.createDataFrame([("c1", 1, "k", "blue sky", [1.0, 0.0], 1), ("c2", 1, "k", "blue sky", [1.0, 0.0], 1), ("c3", 2, "k", "blue", [1.0, 0.0], 1), ("c4", 3, "other", "blue sky", [1.0, 0.0], 1), ("c5", 4, "k", "sky", [0.0, 1.0], 1)], "chunk_id string, doc_id long, kb_id string, text string, embedding array<float>, page int")
    d = spark.createDataFrame([(i, "k", "ready" if i != 4 else "failed", "t", datetime.datetime(2024, 1, 1)) for i in range(1, 5)], "doc_id long, kb_id string, status string, title string, created_at timestamp")
    out = [(r.rank, r.chunk_id, r.score) for r in search.search(q, c, d, 3).orderBy("rank").collect()]
    assert out == [(1, "c1", 1.08), (2, "c3", 1.04)]
    twice = q.unionByName(q.withColumn("query_id", F.lit(2).cast("long")))
    assert search.search(twice, c, d, 3).count() == 4 and search.search(q, c.limit(0), d, 3).count() == 0 and search.search(q.limit(0), c, d, 3).count() == 0


def test_filter_ignores_case_and_accents(spark):
    d = spark.createDataFrame([(1, "Café notes", "a.txt", ["x"], True), (2, "other", "b.txt", ["CAFE"], False)], "doc_id long, title string, file_name string, tags array<string>, is_favorite boolean")
    assert {r.doc_id for r in library.filtered(d, text="cafe", sort="title").collect()} == {1, 2}
    assert {r.doc_id for r in library.filtered(d, text="cafe", favorites=True, sort="title").collect()} == {1}


def test_revocation_empties_the_whole_list(spark):
    s = spark.createDataFrame([(1, 1, 0, "a", "x", 1, "k", 0.5), (1, 1, 1, "b", "y", None, "k", 0.5), (2, 1, 0, "b", "y", None, "k", 0.5)], "conv_id long, seq long, position int, chunk_id string, text string, page int, kb_id string, score double")
    c = spark.createDataFrame([("a", 1, "k", "changed", 1), ("b", 1, "k", "y", None)], "chunk_id string, doc_id long, kb_id string, text string, page int")
    d = spark.createDataFrame([(1, "ready")], "doc_id long, status string")
    m = spark.createDataFrame([(1, 1, "see [1]"), (2, 1, "see [1]")], "conv_id long, seq long, content string")
    assert {(r.conv_id, r.n_sources, r.revoked, r.content) for r in library.revoked(s, c, d, m).collect()} == {(1, 0, True, "see [1]" + library.CITATIONS_REVOKED), (2, 1, False, "see [1]")}


def test_citations_are_of_the_same_library_scored_and_readable(spark):
    columns = "conv_id long, seq long, position int, chunk_id string, text string, page int, kb_id string, score double, media string"
    s = spark.createDataFrame([(1, 1, 0, "a", "x", 1, "k", 0.5, None), (2, 1, 0, "a", "x", 1, "other", 0.5, None), (3, 1, 0, "a", "x", 1, "k", float("inf"), None), (4, 1, 0, "b", " ", 1, "k", 0.5, None), (5, 1, 0, "c", "z", 1, "k", 0.5, "m1"), (6, 1, 0, "d", "z", 1, "k", 0.5, None)], columns)
    c = spark.createDataFrame([("a", 1, "k", "x", 1, None), ("b", 1, "k", " ", 1, None), ("c", 1, "k", "z", 1, "m2"), ("d", 2, "k", "z", 1, None)], "chunk_id string, doc_id long, kb_id string, text string, page int, media string")
    d = spark.createDataFrame([(1, "ready"), (2, "failed")], "doc_id long, status string")
    assert {r.conv_id: (r.unchanged, r.valid) for r in library.source_validity(s, c, d).collect()} == {1: (True, True), 2: (True, False), 3: (True, False), 4: (True, False), 5: (False, False), 6: (True, False)}


def test_audit_of_media_chunks(spark):
    rows = [("a", 1, 0, "video", "video", "s", "r", [1.0]), ("b", 1, 1, "video", "video", "s", "r", None), ("c", 2, 0, "audio", "video", "s", "r", None), ("d", 3, 0, "image", "image", "s", "r", None), ("e", 3, 1, "image", "image", "t", None, None)]
    df = spark.createDataFrame(rows, "chunk_id string, doc_id long, ordinal int, media_kind string, doc_kind string, media_signature string, media_recipe string, frame_times array<double>")
    df = df.withColumn("page", F.lit(1)).withColumn("text", F.lit("x")).withColumn("embedding", F.array(F.lit(1.0))).withColumn("dims", F.lit(1)).withColumn("encoder_signature", F.lit("e"))
    assert {(r.doc_id, r.problem) for r in library.chunk_audit(df, F.lit(True)).collect()} == {(1, "frame times"), (2, "media kind"), (3, "media signature"), (3, "media recipe")}


def test_clock(spark):
    assert column(spark, [0.0, 75.5, 3661.0, 59.9999], "double", gates.clock) == ["00:00", "01:15.500", "1:01:01", "01:00"]


def test_encoder_faults_are_caught(spark):
    df = spark.createDataFrame([("a b",), ("",), (None,)], "text string")
    out = vectors.embed(df, "text", vectors.hashing_encoder(16), "s")
    assert all(r.ok for r in out.select(gates.unit_norm_ok(F.col("embedding"), 1e-3).alias("ok")).collect())


@pytest.mark.parametrize("k,want", [(0, 1), (6, 6), (99, 12)])
def test_top_k(k, want):
    assert search.top_k(k) == want and math.isfinite(k) and re.match(r"\d+", str(k))
