import re

from tempora.llm import decontaminate as D
from tests.llm.conftest import words

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def split(text):
    return WORD.findall((text or "").encode().translate(LOWER))


def brute(docs, bench, n=10):
    windows = []
    for item, text in bench:
        w = split(text)
        size = min(n, len(w))
        windows += [(str(item), w[i:i + size]) for i in range(len(w) - size + 1) if size]
    out = []
    for doc, text in docs:
        w = split(text)
        hit, items = set(), set()
        for item, x in windows:
            for i in range(len(w) - len(x) + 1):
                if w[i:i + len(x)] == x:
                    hit |= set(range(i, i + len(x)))
                    items.add(item)
        out.append((doc, len(w), len(hit), sorted(items)))
    return out


def fixture(rng):
    bench = [(i, words(rng, rng.choice([3, 9, 10, 14, 30]), 60)) for i in range(12)]
    bench += [(50, None), (51, ""), (52, "..."), (53, bench[0][1]), (54, "Éa ß9"), (55, "solo")]
    docs = []
    for i in range(40):
        parts = [words(rng, rng.randrange(0, 40), 60)]
        if i % 3 == 0:
            parts.append(rng.choice(bench)[1] or "")
        parts.append(words(rng, 5, 60))
        docs.append((i, ", ".join(parts).upper() if i % 4 == 0 else " ".join(parts)))
    docs += [(90, None), (91, ""), (92, " \n--"), (93, "x éa ß9 y Solo"), (94, docs[0][1]), (94, docs[0][1])]
    return docs, bench


def test_matches_brute_force(spark, rng, monkeypatch):
    docs, bench = fixture(rng)
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    b = spark.createDataFrame(bench, "item_id long, text string")
    want = sorted(brute(docs, bench))
    for part in (D.PART, 40):        # the second spreads the windows over several broadcast parts
        monkeypatch.setattr(D, "PART", part)
        got = sorted((r.doc_id, r.n_words, r.n_hit, r.hit_items) for r in D.scan(d, b).collect())
        assert got == want


def test_filters_keep_columns_and_cut_spans(spark, rng):
    docs, bench = fixture(rng)
    d = spark.createDataFrame([(i, t, None, 3, "x") for i, t in docs], "doc_id long, text string, n_words string, hit_words int, hit_items string")
    b = spark.createDataFrame(bench, "item_id long, text string")
    hits = {i: h for i, _, h, _ in brute(docs, bench)}
    kept = D.drop_documents(d, b)
    assert kept.columns == d.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(i for i, _ in docs if not hits[i])
    few = D.drop_documents(d, b, min_hit=11)
    assert sorted(r.doc_id for r in few.collect()) == sorted(i for i, _ in docs if hits[i] < 11)
    cut = {r.doc_id: r.text for r in D.remove_spans(d, b).collect()}
    for i, t in docs:
        if not hits[i]:
            assert cut[i] == t
        else:
            assert len(split(cut[i])) <= len(split(t)) - hits[i] + 1


def test_empty_tables(spark):
    d = spark.createDataFrame([], "doc_id long, text string")
    b = spark.createDataFrame([], "item_id long, text string")
    one = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    assert D.scan(d, b).count() == 0
    assert [tuple(r) for r in D.scan(one, b).select("n_words", "n_hit").collect()] == [(2, 0)]
