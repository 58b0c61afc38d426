import random
import zlib

import numpy as np
import pyarrow.parquet as pq
import pytest

from millrace.llm import arrow_output, bpe_tables, token_counts, transducer

BYTE, WORD = "byte_bpe_50k.json", "word_bpe_49k.json"
ALPHABETS = ["ab", "aе", "ABCdeilnorst", "-=_", "!?.", " \n\t", "the anding", "日本語あ", "٣٤0123", ".. \n", "'sSt re'll d", "ͅ՘\U00011de0 a1", "ΣΑσς İß", "é éa", "\x1c\x1d a\x85b\xa0", "x", "<|endoftext|>"]


def texts(n=260):
    rnd = random.Random(11)
    out = ["", " ", "  a", "a ", "\n", "<|endoftext|>", "a<|endoftext|> b<|startoftext|>", "<|endoftext", "😀" * 50, "á é ́x", "don't DON'T he'll"]
    for k in range(n):
        al = rnd.choice(ALPHABETS)
        s = "".join(rnd.choice(al) for _ in range(rnd.choice([3, 40, 700, 2500])))
        out.append(s + ("<|endoftext|>" + s[:9] if k % 6 == 0 else ""))
    return out


def test_encoding_and_decoding_match_the_library():
    t = bpe_tables.library_tokenizer(BYTE)
    for s in texts():
        want = t.encode(s, add_special_tokens=False).ids
        assert transducer.encode(s, BYTE) == want, s[:80]
        assert transducer.decode(want, BYTE) == t.decode(want, skip_special_tokens=False) == s


def test_decoding_of_any_ids_matches_the_library():
    t, rnd = bpe_tables.library_tokenizer(BYTE), random.Random(5)
    for _ in range(300):
        ids = [rnd.randrange(50_257) for _ in range(40)]
        assert transducer.decode(ids, BYTE) == t.decode(ids, skip_special_tokens=False)


def test_long_pre_tokens_stream():
    s = "x" * 150_000 + " " + "é" * 80_000 + "ab" * 30_000 + "\n" * 5_000 + "=" * 40_000
    assert transducer.encode(s, BYTE) == bpe_tables.library_tokenizer(BYTE).encode(s, add_special_tokens=False).ids


def test_long_pre_tokens_are_folded():
    s = "X" * 5_000 + " " + "É" * 3_000 + "\tAb " * 200
    assert transducer.encode(s, WORD) == bpe_tables.library_tokenizer(WORD).encode(s, add_special_tokens=False).ids


def test_every_pre_token_of_given_texts_goes_through_the_transducer():
    """Without caches: the machine is fed each pre-token, gives each token once, and these are the library's."""
    rows = pq.read_table("/root/testdata/sf0.001/documents.parquet", columns=["text"]).column("text").to_pylist()
    enc, t, seen = transducer.Encoder(bpe_tables.load(BYTE)), bpe_tables.library_tokenizer(BYTE), [0, 0, 0]
    enc.piece, enc.word = transducer.TwoGenerations(enc.piece.make, 1, -1), transducer.TwoGenerations(enc.word.make, 1, -1)
    feed, finish = enc.transducer.feed, enc.transducer.finish

    def counting(f, at):
        def g(*a):
            out = f(*a)
            seen[at] += len(out)
            seen[2] += at
            return out

        return g

    enc.transducer.feed, enc.transducer.finish = counting(feed, 0), counting(finish, 1)
    n_tokens = n_pieces = 0
    for s in [*filter(None, rows), "ab" * 2_000 + " x"]:
        ids = np.frombuffer(b"".join(enc.blocks(s)), "<u4").tolist()
        assert ids == t.encode(s, add_special_tokens=False).ids
        n_tokens, n_pieces = n_tokens + len(ids), n_pieces + len(enc.table.pieces(s))
    assert seen[0] > 1_000 and seen[0] + seen[1] == n_tokens and seen[2] == n_pieces


def test_stretches_cut_nothing_apart():
    rnd = random.Random(2)
    enc, t = transducer.encoder(BYTE), bpe_tables.library_tokenizer(BYTE)
    for _ in range(5):
        s = "".join(rnd.choice(["ab", " ", "  ", "\n", ".", "é", "12"]) for _ in range(120_000))
        assert "".join(enc._stretches(s)) == s and max(map(len, enc._stretches(s))) <= transducer.STRETCH
        assert transducer.encode(s, BYTE) == t.encode(s, add_special_tokens=False).ids


def test_streaming_equals_one_window():
    """Stable tokens of parts of any size are those of the whole, for random merge lists of few symbols."""
    rnd = random.Random(9)
    for _ in range(60):
        names, merges = ["a", "b", "c"], {}
        index = {n: i for i, n in enumerate(names)}
        for _ in range(rnd.randrange(1, 25)):
            a, b = rnd.choice(names), rnd.choice(names)
            if a + b not in index and len(a + b) < 12:
                index[a + b] = len(names)
                names.append(a + b)
                merges[index[a] << 32 | index[b]] = len(merges) << 32 | index[a + b]
        first = [index.get(chr(i), 0) for i in range(256)]
        table = bpe_tables.MergeTable("", None, {}, "", False, False, merges, first, first, [n.encode() for n in names], None)
        enc = transducer.Encoder(table)
        for _ in range(20):
            data = "".join(rnd.choice("abc") for _ in range(rnd.randrange(400))).encode()
            want, step = enc.merge_bytes(data), rnd.randrange(1, 30)
            got = [t for block in enc.stream_piece(data[i : i + step] for i in range(0, len(data), step)) for t in block]
            assert got == want


@pytest.mark.parametrize("path", [WORD, BYTE])
def test_counts_match_the_library(path):
    t, c = bpe_tables.library_tokenizer(path), token_counts.counter(path)
    for s in texts():
        assert c.count(s) == len(t.encode(s, add_special_tokens=False).ids), s[:80]
    assert c.count("q" * 20_000) == len(t.encode("q" * 20_000, add_special_tokens=False).ids)


@pytest.mark.parametrize("path", [WORD, BYTE])
def test_library_encoder_by_words(path):
    t, e = bpe_tables.library_tokenizer(path), arrow_output.library_encoder(path)
    for s in texts():
        assert np.frombuffer(e.encode(s), e.kind).tolist() == t.encode(s, add_special_tokens=False).ids, s[:80]


ROWS = [(5, None, "x", 1), (2, "hello world", "x", 2), (2, "hello world", "x", 2), (None, "abc", None, None), (9, "w " * 9_000, "y", 3), (1, "", "z", 4)]
SCHEMA = "doc_id long, text string, ids string, start long"


def test_queries_on_awkward_rows(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    t = bpe_tables.library_tokenizer(BYTE)
    got = sorted(((r.doc_id, r.n_tokens) for r in transducer.digests(df, BYTE).collect()), key=str)
    assert got == sorted(((d, len(t.encode(s or "", add_special_tokens=False).ids)) for d, s, *_ in ROWS), key=str)
    counts = {(r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in token_counts.count_tokens(df, WORD).collect()}
    assert counts == {(5, 0, 0, False), (2, 11, 2, False), (None, 3, 1, False), (9, 18_000, 9_000, True), (1, 0, 0, False)}
    for f in (lambda d: transducer.digests(d, BYTE), lambda d: token_counts.count_tokens(d, WORD), lambda d: arrow_output.round_trip(spark, d, WORD)):
        assert f(df.limit(0)).count() == 0


def test_encode_documents_round_trip(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    tokens = transducer.encode_documents(df, BYTE)
    back = transducer.decode_documents(tokens.drop("text"), BYTE)
    assert sorted(((r.doc_id, r.text) for r in back.collect()), key=str) == sorted(((d, s or "") for d, s, *_ in ROWS), key=str)


def test_arrow_files(spark, tmp_path):
    df = spark.createDataFrame(ROWS, SCHEMA)
    manifest = arrow_output.write_stream_files(df, WORD, 1, f"file://{tmp_path}/ids", length=16, rows=4)
    t = bpe_tables.library_tokenizer(WORD)
    order = sorted(ROWS, key=lambda r: (r[0] is not None, r[0] or 0))
    stream, want = [], []
    for d, s, *_ in order:
        ids = [*t.encode(s or "", add_special_tokens=False).ids, 1]
        want.append((d, len(stream), len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        stream += ids
    assert sorted(map(tuple, arrow_output.read_stream_files(manifest).collect()), key=str) == sorted(want, key=str)
    at = 0
    for m in manifest.orderBy("file").collect():
        f = arrow_output.StreamFile(m.uri)
        assert f.length == 16 and m.first_token == at
        for i in range(len(f)):
            ids, mask = f.sequence(i)
            assert len(ids) == 16 and not ids.flags.owndata
            n = sum(mask.to_pylist())
            assert ids[:n].tolist() == stream[at : at + n]
            at += n
    assert at == len(stream)
