import zlib

import numpy as np

from tempora.llm import toxicity as X
from tests.llm.conftest import words


def maximal(scores):
    """All maximal-scoring segments by definition: best segment first, then left and right of it."""
    best = None
    for i in range(len(scores)):
        for j in range(i + 1, len(scores) + 1):
            v = sum(scores[i:j])
            if v > 0 and (best is None or v > best[2] or (v == best[2] and j - i < best[1] - best[0])):
                best = (i, j, v)
    if best is None:
        return []
    i, j, v = best
    return maximal(scores[:i]) + [best] + [(a + j, b + j, s) for a, b, s in maximal(scores[j:])]


def test_segments_are_all_maximal_ones(rng):
    for _ in range(300):
        scores = [rng.choice([-3, -2, -1.5, -1, 0.5, 1, 2, 4.25]) + rng.random() / 1000 for _ in range(rng.randrange(0, 16))]
        got = X.segments(np.array(scores))
        want = maximal(scores)
        assert [(a, b) for a, b, _ in got] == [(a, b) for a, b, _ in want]
        assert np.allclose([s for *_, s in got], [s for *_, s in want])


def corpus(rng, n=700):
    bad = ["grox", "blarg", "snivek"]
    docs, labels = [], []
    for i in range(n):
        toxic = i % 5 == 0
        w = words(rng, rng.randrange(30, 200), 300).split()
        for _ in range(rng.randrange(2, 6) if toxic else 0):
            w.insert(rng.randrange(len(w)), rng.choice(bad) + rng.choice(["", "um", "est", "ial%d" % rng.randrange(99)]))
        docs.append((i, " ".join(w)))
        if i % 3:
            labels.append((i, 1, int(toxic)))
    return docs, labels


def test_held_out_accuracy(spark, rng):
    docs, labels = corpus(rng)
    d = spark.createDataFrame(docs, "doc_id long, text string")
    m = X.fit(d, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    rows = {r.doc_id: r for r in X.score(d, m).collect()}
    held = [i for i, _ in docs if zlib.crc32(str(i).encode()) % 5 == 0]
    right = sum(rows[i].predicted == int(i % 5 == 0) for i in held)
    assert len(held) > 80 and right / len(held) > 0.95
    assert all((r.score >= 0.5) == (r.predicted == 1) and 0 <= r.score <= 1 for r in rows.values())
    found = [r for r in rows.values() if r.predicted]
    assert all(r.passages and r.passages[0]["expected"] < X.EVALUE for r in found)


def test_defined_cases(spark, rng):
    docs, labels = corpus(rng, 300)
    docs += [(900, None), (901, ""), (902, "..."), (None, "grox grox"), (903, "grox " * 30000)]
    labels += [(None, 1, 1), (4, 1, None), (902, 0, 0), (902, 0, 0)]
    d = spark.createDataFrame([(i, t, 1.5, "p") for i, t in docs], "doc_id long, text string, toxicity double, passages string")
    m = X.fit(d, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    kept = X.drop_toxic(d, m)
    assert kept.columns == d.columns
    ids = {r.doc_id for r in kept.collect()}
    assert {900, 901, 902} <= ids and 903 not in ids
    nothing = X.fit(d, spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    assert {r.score for r in X.score(d, nothing).collect()} == {0.0}
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert X.score(empty, m).count() == 0


def test_labels_of_held_out_rows_do_not_teach(spark, rng):
    docs, labels = corpus(rng, 300)
    d = spark.createDataFrame(docs, "doc_id long, text string")
    kind = "doc_id long, quality int, toxic int"
    turned = [(i, q, 1 - t if zlib.crc32(str(i).encode()) % 5 == 0 else t) for i, q, t in labels]
    a, b = (X.fit(d, spark.createDataFrame(x, kind)) for x in (labels, turned))
    assert np.array_equal(a.toxic, b.toxic) and (a.lam, a.log_k, a.slope, a.offset) == (b.lam, b.log_k, b.slope, b.offset)
