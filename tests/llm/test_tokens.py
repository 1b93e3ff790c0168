import os

import pytest

from tempora.llm import tokens as K

PATH = "/opt/tokenizers/piece_bpe_32k.model"


def library(vocabulary):
    from tokenizers import Tokenizer, models
    low = min(s for _, s in vocabulary.pieces)
    extra = [(f"<0x{i:02X}>", low) for i in range(256)] if vocabulary.byte_fallback else []
    return Tokenizer(models.Unigram([("<unk>", 0.0), *vocabulary.pieces, *extra], 0, vocabulary.byte_fallback))


def expected(tok, text):
    return len(tok.encode("▁" + text.replace(" ", "▁"), add_special_tokens=False).ids) if text else 0


def samples(rng, n=600):
    alphabet = "abc the.ing, \n\té☃世\U0001F600▁"
    return ["", "a", " ", "   ", "\n\n", "a" * 300, "▁▁x", "the thing\nthe  thing ☃☃"] + [
        "".join(rng.choice(alphabet) for _ in range(rng.randrange(1, 50))) for _ in range(n)]


def test_counts_equal_a_tokenizer_small_vocabularies(rng):
    for fallback in (True, False):
        for spaced in (True, False):
            pieces = {}
            for _ in range(60):
                p = "".join(rng.choice("abcthe☃") for _ in range(rng.randrange(1, 5)))
                pieces[rng.choice(["▁", ""]) + p] = float(-rng.randrange(1, 6))     # few scores: many ties
            if not spaced:
                pieces["a▁b"] = -2.0                                               # a piece across words
            v = K.Vocabulary(sorted(pieces.items()), fallback)
            tok, counter = library(v), K.Counter(v)
            assert (counter.split is None) == (not spaced or not fallback)
            for text in samples(rng):
                assert counter.count(text)[0] == expected(tok, text), (text, fallback, spaced)


def test_words_side_by_side_equal_the_whole_text(rng):
    v = K.Vocabulary([("a", -1.0), ("b", -2.0), ("ab", -3.0), ("▁a", -1.0), ("▁", -1.0), ("▁▁", -2.0)], True)
    c = K.Counter(v)
    for text in samples(rng):
        if text:
            n, s = c.count(text)
            assert (n, s) == c.best(" " + text.replace("▁", " "))


def test_memory_is_bounded_not_the_result(rng, monkeypatch):
    v = K.Vocabulary([("a", -1.0), ("b", -2.0), ("ab", -3.0), ("▁a", -1.0), ("▁", -1.0)], True)
    want = [K.Counter(v).count(t) for t in samples(rng)]
    monkeypatch.setattr(K, "REMEMBERED", 3)
    c = K.Counter(v)
    assert [c.count(t) for t in samples(__import__("random").Random(7))] is not None
    assert [c.count(t) for t in ("ab ab", "b a b a ab abab")] == [K.Counter(v).count(t) for t in ("ab ab", "b a b a ab abab")]
    assert len(c) <= 3 and len(want) > 0


@pytest.mark.skipif(not os.path.exists(PATH), reason="no tokenizer file")
def test_public_vocabulary(spark, rng):
    v = K.load(PATH)
    tok = library(v)
    texts = samples(rng, 150) + [None]
    d = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, n_tokens int")
    got = {r.doc_id: r.n_tokens for r in K.counts(d, v).collect()}
    assert got == {i: expected(tok, t) for i, t in enumerate(texts)}
    df, n, s = K.with_counts(d, v)
    assert df.columns == ["doc_id", "text", "n_tokens", n, s] and n != "n_tokens"
    assert K.counts(spark.createDataFrame([], "doc_id long, text string"), v).count() == 0
    assert [tuple(r)[1:] for r in K.counts(spark.createDataFrame([(1, "")], "doc_id long, text string"), K.Vocabulary([], True)).collect()] == [(0, 0.0)]
