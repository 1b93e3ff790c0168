import base64
import hashlib
import random

import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from tempora.llm import bpe

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
MARKS = ["'", "s", "t", "re", "ll", "d", " ", "  ", "\n", "\r\n", "\t", "a", "B", "é", "1", "²", "!", "…", "漢", "😀", "　",
         "'s", "'ll", "́", "٣", "\0", "", " ", "word", "слово", "12345"]


@pytest.fixture(scope="module")
def vocabulary():
    return bpe.load(PATH)


@pytest.fixture(scope="module")
def encoder(vocabulary):
    return bpe.Encoder(vocabulary)


@pytest.fixture(scope="module")
def library(vocabulary):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=vocabulary.ranks, special_tokens={})


def texts(rng, n, most=14):
    return ["".join(rng.choice(MARKS) for _ in range(rng.randrange(most))) for _ in range(n)]


def test_equal_to_the_library(encoder, library, rng):
    for t in texts(rng, 4000) + ["", " ", "a" * 3000, " " * 2000 + "x", "'" * 70, "é" * 500, "x'restart", "I'll we've"]:
        assert encoder.encode(t) == library.encode_ordinary(t), t


def test_every_assigned_character(encoder, library):
    points = [c for c in [*range(0xD800), *range(0xE000, 0x32000), *range(0xE0000, 0xE0200), 0x10FFFF]]
    for i in range(0, len(points), 5000):
        t = "".join(f"a{chr(c)} {chr(c)}1{chr(c)}{chr(c)}b" for c in points[i:i + 5000])
        assert encoder.encode(t) == library.encode_ordinary(t)


def test_boundaries_are_the_pattern_s_matches(encoder, rng):
    for t in texts(rng, 1500):
        if all(ord(c) < 0x500 for c in t):
            assert encoder.boundaries(t).tolist() == [m.start() for m in encoder.pattern.finditer(t)]


def test_other_vocabularies(rng):
    """Merge orders in which a token's parts rank after it, and tokens that no merges reach."""
    for seed in range(60):
        g = random.Random(seed)
        words = {bytes([g.choice(b"abc") for _ in range(g.randrange(2, 5))]) for _ in range(12)}
        tokens = [bytes([b]) for b in range(256)] + g.sample(sorted(words), len(words))
        v = bpe.Vocabulary({t: i for i, t in enumerate(tokens)}, public_tokenizers.PATTERN, bpe.character_classes(public_tokenizers.PATTERN) if seed == 0 else known)
        known = v.classes
        library = tiktoken.Encoding("own", pat_str=v.pattern, mergeable_ranks=v.ranks, special_tokens={})
        e = bpe.Encoder(v)
        for n in range(40):
            t = "".join(g.choice("abc") for _ in range(g.randrange(1, 90)))
            assert e.encode(t) == library.encode_ordinary(t), (seed, t)


def test_prefixes_grow_and_shrink(encoder, library):
    data = "unbelievableness".encode()
    state = bpe.Prefixes(encoder)
    for i in range(len(data)):
        state.extend(data[i:i + 1])
        assert state.ids() == library.encode_ordinary(data[:i + 1].decode())
    stored = list(state.last)
    assert state.cut(5).last == stored[:5]
    assert state.extend(b"xyz").ids() == library.encode_ordinary("unbelxyz")


def test_edits_equal_a_fresh_encoding(encoder, library, rng):
    for t in texts(rng, 3000, 20):
        i = rng.randrange(len(t) + 1)
        new = t[:i] + "".join(rng.choice(MARKS) for _ in range(rng.randrange(4))) + t[min(len(t), i + rng.randrange(4)):]
        assert encoder.edited(t, library.encode_ordinary(t), new) == library.encode_ordinary(new), (t, new)
    long = "some words of a text " * 400
    assert encoder.edited(long, library.encode_ordinary(long), long + "'ll go on") == library.encode_ordinary(long + "'ll go on")


def test_tables(spark, vocabulary, library, rng):
    rows = [(1, None, "x", 1), (2, "", None, 2), (2, "", None, 2), (None, "null id", "null  id", 3), (4, "long word " * 60_000, "long wards", 4)]
    rows += [(10 + i, t, t + "!", 5) for i, t in enumerate(texts(rng, 300))]
    d = spark.createDataFrame(rows, "doc_id long, text string, new string, ids int").repartition(3)
    encoded, ids = bpe.encode(d, vocabulary)
    assert ids == "_ids" and encoded.columns == ["doc_id", "text", "new", "ids", "_ids"]
    decoded, raw = bpe.decode(encoded, vocabulary, ids)
    again, new = bpe.re_encode(decoded, vocabulary, "text", ids, "new")
    got = again.collect()
    assert len(got) == len(rows)
    for r in got:
        assert r[ids] == library.encode_ordinary(r.text or "")
        assert bytes(r[raw]) == (r.text or "").encode()
        assert r[new] == library.encode_ordinary(r.new or "")
    assert bpe.encode(d.where("false"), vocabulary)[0].count() == 0
    nothing = spark.createDataFrame([(1, None)], "a int, ids array<int>")
    assert bytes(bpe.decode(nothing, vocabulary)[0].first().bytes) == b""


def test_unknown_id_and_invalid_bytes(spark, vocabulary, library):
    bad = spark.createDataFrame([([999_999],)], "ids array<int>")
    with pytest.raises(Exception, match="no token 999999"):
        bpe.decode(bad, vocabulary)[0].collect()
    raw = spark.createDataFrame([(bytearray(b"ab\xff c"),)], "b binary").select(F.expr("cast(b as string)").alias("text"))
    assert bpe.encode(raw, vocabulary)[0].first().ids == library.encode_ordinary("ab� c")


def test_query_against_the_library(spark, library):
    from tempora.llm.queries import op11_bpe
    sf = "/root/testdata/sf0.001"
    want = {}
    for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect():
        ids = library.encode_ordinary(r.text or "")
        want[r.doc_id] = (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(),
                          hashlib.sha256((r.text or "").encode()).hexdigest())
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in op11_bpe(spark, sf).collect()}
    assert got == want
