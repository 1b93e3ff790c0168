from collections import Counter

import numpy as np
import pytest

from tempora.llm import whitening as W


def frame(spark, vectors):
    return spark.createDataFrame([(i, None if v is None else [None if c is None else float(c) for c in v], 3, 4) for i, v in vectors],
                                 "vec_id long, embedding array<double>, n int, x int").repartition(3)


def exact(vectors):
    """(x of usable rows, n, sums, numerators) in Python integers."""
    ok = [(i, v) for i, v in vectors if v is not None and all(c is not None and np.isfinite(c) for c in v)]
    length = min(((-k, n) for n, k in Counter(len(v) for _, v in ok).items()), default=(0, 0))[1]
    x = [(i, tuple(int(np.floor(256 * float(c))) for c in v)) for i, v in ok if len(v) == length]
    fit = sorted({v for _, v in x})
    n, d = len(fit), length
    s = [sum(v[k] for v in fit) for k in range(d)]
    m = np.array([[sum((n * v[i] - s[i]) * (n * v[j] - s[j]) for v in fit) for j in range(d)] for i in range(d)], object)
    return x, n, s, m     # m is n**3 times the covariance


def check(spark, vectors, components=4):
    x, n, s, m = exact(vectors)
    got = {}
    for r in W.whiten(frame(spark, vectors), components=components).collect():
        got.setdefault(r.vec_id, []).append(r)
    assert Counter(i for i, _ in x) == Counter({i: sum(r.component == 1 for r in v) for i, v in got.items()})
    v = np.array([[int(c) / n ** 3 for c in row] for row in m], float)
    values, vectors_ = np.linalg.eigh(v)
    values, vectors_ = values[::-1], vectors_[:, ::-1]
    trace = np.trace(v)
    for i, row in x:
        dev = sum((n * c - t) ** 2 for c, t in zip(row, s))
        assert {r.deviation for r in got[i]} >= {dev if dev < 1 << 63 else None}
        for r in got[i]:
            assert r.n == n and (trace == 0 or r.explained == pytest.approx(values[r.component - 1] / trace, rel=1e-6, abs=1e-12))
            if r.whitened is not None and len([k for k, _ in x if k == i]) == 1:
                k = r.component - 1
                want = np.array([c - t / n for c, t in zip(row, s)]) @ vectors_[:, k] / np.sqrt(values[k])
                assert abs(abs(r.whitened) - abs(want)) < 1e-6
    return got, n


def test_against_python_integers(spark):
    g = np.random.default_rng(1)
    x = (g.standard_normal((400, 6)) @ g.standard_normal((6, 6))).astype(np.float32)
    vectors = list(zip(range(400), x.astype(float).tolist()))
    vectors += [(400 + i, vectors[0][1]) for i in range(300)]                       # one vector, many copies
    vectors += [(5, vectors[9][1]), (None, vectors[10][1])]                           # a repeated and a null id
    vectors += [(800, None), (801, [1.0, None, 0, 0, 0, 0]), (802, [float("nan")] * 6), (803, [float("inf")] * 6), (804, [1.0]), (805, [])]
    got, n = check(spark, vectors)
    assert n == 400 and len(got[None]) == 4 and len(got[5]) == 8
    error = {r.identity_error for rows in got.values() for r in rows}
    assert len(error) == 1 and error.pop() < 1e-9
    assert {(r.component, round(abs(r.whitened), 9)) for r in got[0]} == {(r.component, round(abs(r.whitened), 9)) for r in got[400]}


def test_counts_are_exact_over_any_range():
    g = np.random.default_rng(2)
    for low, high in ((-3, 4), (-70_000, 10), (-2 ** 62, 2 ** 62), (-2 ** 63, 2 ** 63 - 1)):
        x = g.integers(low, high, (130, 3), dtype=np.int64, endpoint=True)
        x[:, 2] = x[0, 2]                                                            # no planes at all
        least = x.min(0)
        bits = [(int(a) - int(b)).bit_length() for a, b in zip(x.max(0), least)]
        counts = np.zeros((sum(bits),) * 2, np.int64)
        for part in (x[:100], x[100:]):
            W.add_counts(counts, W.planes(part, least, bits))
        u = (x.astype(object) - least.astype(object))
        assert (W.weighted(counts, bits, len(x)) == u.T @ u).all()


def test_wide_numbers(spark):
    g = np.random.default_rng(4)
    vectors = [(i, (g.standard_normal(3) * [1e-2, 1.0, 1e9]).tolist()) for i in range(60)]
    check(spark, vectors)                                                            # deviations beyond 64 bits are null


def test_without_variance_and_empty(spark):
    got, _ = check(spark, [(1, [0.5, 0.25]), (2, [0.5, 0.25])])
    assert [(r.component, r.whitened, r.explained, r.identity_error, r.deviation) for r in sorted(got[1], key=lambda r: r.component)] == [
        (1, None, None, None, 0), (2, None, None, None, 0)]
    got, _ = check(spark, [(1, [0.5, 0.25, 1.0]), (2, [0.25, 0.75, 1.0])])
    assert [r.whitened is None for r in sorted(got[2], key=lambda r: r.component)] == [False, True, True]
    assert W.whiten(frame(spark, [])).count() == 0
    assert W.whiten(frame(spark, [(1, None)])).columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    assert W.whiten(frame(spark, [(1, [])])).count() == 0


def test_query_over_the_table(spark):
    from tempora.llm.queries import op13_whitening
    sf = "/root/testdata/sf0.001"
    t = spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding").collect()
    x = {r.vec_id: np.floor(256 * np.array(r.embedding, float)) for r in t}
    fit = np.unique(np.array(list(x.values())), axis=0)
    n, s = len(fit), fit.sum(0)
    v = np.cov(fit.T, bias=True)
    values, vectors = np.linalg.eigh(v)
    rows = op13_whitening(spark, sf).collect()
    assert len(rows) == 4 * len(x)
    for r in rows:
        k = len(values) - r.component
        assert r.n == n and r.deviation == int(((n * x[r.vec_id] - s) ** 2).sum()) and r.identity_error < 1e-9
        assert r.explained == pytest.approx(values[k] / np.trace(v), rel=1e-9)
        assert abs(r.whitened) == pytest.approx(abs((x[r.vec_id] - s / n) @ vectors[:, k] / np.sqrt(values[k])), abs=1e-8)
