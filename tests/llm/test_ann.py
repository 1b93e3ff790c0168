import numpy as np

from tempora.llm import ann as A


def brute(vectors, queries, k=20):
    ids = np.array([i for i, _ in vectors])
    x = np.array([v for _, v in vectors], float)
    out = {}
    for q in queries:
        s = x @ x[np.flatnonzero(ids == q)[0]]
        keep = ids != q
        order = np.lexsort((ids[keep], -s[keep]))[:k]
        out[q] = (ids[keep][order].tolist(), s[keep][order])
    return out


def run(spark, vectors, step=20, **kw):
    d = spark.createDataFrame([(i, None if v is None else [None if c is None else float(c) for c in v], 7) for i, v in vectors],
                              "vec_id long, embedding array<float>, node int").repartition(3)
    got = {}
    for r in A.nearest(d, lambda i: i % step == 0, **kw).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.id, r.score))
    return {q: sorted(v) for q, v in got.items()}


def test_recall_and_exact_scores(spark):
    g = np.random.default_rng(3)
    centres = g.standard_normal((8, 16)) * 2
    x = (centres[g.integers(0, 8, 1500)] + g.standard_normal((1500, 16))).astype(np.float32)   # lengths differ
    vectors = list(zip(range(1500), x.astype(float)))
    got, want = run(spark, vectors), brute(vectors, range(0, 1500, 20))
    hits = sum(len({i for _, i, _ in got[q]} & set(want[q][0])) for q in want)
    assert hits / (20 * len(want)) >= 0.95
    for q, rows in got.items():
        assert [r for r, _, _ in rows] == list(range(1, 21))
        exact = [float(np.dot(x[q].astype(float), x[i].astype(float))) for _, i, _ in rows]
        assert np.allclose([s for *_, s in rows], exact, rtol=0, atol=1e-12)
        assert all(a[2] > b[2] or (a[2] == b[2] and a[1] < b[1]) for a, b in zip(rows, rows[1:]))


def test_copies_ties_and_unusable_vectors(spark):
    g = np.random.default_rng(5)
    vectors = [(i, [1.0, 2.0, 3.0]) for i in range(0, 120)]                 # one vector, many copies
    vectors += [(200 + i, g.standard_normal(3).astype(np.float32).astype(float)) for i in range(60)]
    bad = [(300, None), (301, [0, 0, 0]), (320, [1, None, 2]), (340, [1, float("nan"), 2]), (360, [1, float("inf"), 2]), (380, [1, 2]), (400, [])]
    got = run(spark, vectors + bad + [(None, [1.0, 2.0, 3.0])])
    want = brute(vectors, [i for i, _ in vectors if i % 20 == 0])
    assert set(got) == set(want)
    for q in want:
        assert [i for _, i, _ in got[q]] == want[q][0]


def test_few_candidates_and_empty(spark):
    few = [(0, [1.0, 0.0]), (1, [0.5, 0.5]), (20, [0.0, 1.0])]
    got = run(spark, few)
    assert {q: [i for _, i, _ in v] for q, v in got.items()} == {0: [1, 20], 20: [1, 0]}
    assert run(spark, []) == {}
    assert run(spark, [(0, [1.0, 1.0])]) == {}


def recall(got, want):
    return sum(len({i for _, i, _ in got[q]} & set(want[q][0])) for q in want) / sum(len(w[0]) for w in want.values())


def test_dense_group_of_near_copies(spark):
    g = np.random.default_rng(9)
    centre = g.standard_normal(32)
    x = np.concatenate([centre / np.linalg.norm(centre) + 3e-4 * g.standard_normal((1200, 32)), g.standard_normal((300, 32)) / 6])
    vectors = list(zip(range(1500), x.astype(np.float32).astype(float)))
    assert recall(run(spark, vectors), brute(vectors, range(0, 1500, 20))) >= 0.95


def test_one_very_long_vector(spark):
    g = np.random.default_rng(10)
    x = g.standard_normal((1500, 16))
    x[7] *= 10_000
    vectors = list(zip(range(1500), x.astype(np.float32).astype(float)))
    assert recall(run(spark, vectors), brute(vectors, range(0, 1500, 20))) >= 0.95
