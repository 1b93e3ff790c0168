import math

import pytest

from tempora.llm import mixing as M
from tests.llm.conftest import words


def fixture(rng):
    sizes = {"big": 150, "b": 40, "c": 25, "d": 12, None: 9}
    rows = [(s, words(rng, rng.randrange(5, 60))) for s, n in sizes.items() for _ in range(n)]
    rows += [("big", None), ("b", ""), ("empty", ""), ("empty", None)]
    return [(i, s, t, 1.0) for i, (s, t) in enumerate(rows)]


def tokens(text):
    return len((text or "").split())


def brute_tau(totals, entropy, repeats):
    n = sum(totals.values())
    p = {s: t / n for s, t in totals.items()}

    def weights(tau):
        z = sum(x ** tau for x in p.values())
        return {s: x ** tau / z for s, x in p.items()}

    def h(tau):
        return -sum(w * math.log(w) for w in weights(tau).values())

    def r(tau):
        q = [w / totals[s] for s, w in weights(tau).items()]
        return max(q) / min(q)
    lo, hi = 0.0, 1.0
    if h(1.0) < entropy * math.log(len(p)):
        for _ in range(60):
            mid = (lo + hi) / 2
            lo, hi = (mid, hi) if h(mid) >= entropy * math.log(len(p)) else (lo, mid)
    else:
        lo = 1.0
    if r(lo) > repeats:
        a, b = lo, 1.0
        for _ in range(60):
            mid = (a + b) / 2
            a, b = (mid, b) if r(mid) > repeats else (a, mid)
        lo = b
    return lo, weights(lo)


@pytest.mark.parametrize("entropy,repeats", [(0.9, 4.0), (0.99, 1.7), (0.5, 4.0), (0.99, 50.0)])
def test_weights_match_bisection(spark, rng, entropy, repeats):
    rows = fixture(rng)
    totals = {}
    for _, s, t, _ in rows:
        totals[s] = totals.get(s, 0) + tokens(t)
    totals = {s: t for s, t in totals.items() if t}
    df, tok = M.with_tokens(spark.createDataFrame(rows, "doc_id long, source string, text string, epoch double"))
    got = {r.source: r for r in M.weights(df, "source", tok, entropy, repeats).collect()}
    tau, weights = brute_tau(totals, entropy, repeats)
    assert set(got) == set(totals)
    for s, r in got.items():
        assert r.tokens == totals[s] and abs(r.tau - tau) < 1e-6 and abs(r.weight - weights[s]) < 1e-6
    assert min(r.quota / r.tokens for r in got.values()) == pytest.approx(1.0)
    assert max(r.quota / r.tokens for r in got.values()) <= max(repeats, 1) + 1e-4


def test_mixture_meets_its_budget(spark, rng, monkeypatch):
    monkeypatch.setattr(M, "BLOCK_TOKENS", 200)
    rows = fixture(rng)
    d = spark.createDataFrame(rows, "doc_id long, source string, text string, epoch double").repartition(3)
    df, tok = M.with_tokens(d)
    plan = {r.source: r for r in M.weights(df, "source", tok).collect()}
    out = M.mix(d).collect()
    assert out[0].__fields__ == ["doc_id", "source", "text", "epoch", "n_tokens", "_epoch", "block", "position"]
    emitted, seen = {}, {}
    for r in out:
        emitted[r.source] = emitted.get(r.source, 0) + r.n_tokens
        seen.setdefault(r.doc_id, []).append(r._epoch)
        assert r.n_tokens == tokens(r.text) and 0 <= r.position < 1
    for s, p in plan.items():
        assert abs(emitted[s] - p.quota) <= 60
    want = {i for i, s, t, _ in rows if s != "empty"}
    assert set(seen) == want
    for epochs in seen.values():                       # no document twice in an epoch, epochs without gaps
        assert sorted(epochs) == list(range(len(epochs)))
    again = sorted((r.doc_id, r._epoch, r.position) for r in M.mix(d.repartition(2)).collect())
    assert again == sorted((r.doc_id, r._epoch, r.position) for r in out)


def test_budget_below_one_pass_and_edges(spark, rng):
    rows = fixture(rng)
    d = spark.createDataFrame(rows, "doc_id long, source string, text string, epoch double")
    total = sum(tokens(t) for _, _, t, _ in rows)
    out = M.mix(d, budget=total / 4).collect()
    assert abs(sum(r.n_tokens for r in out) - total / 4) < 5 * 60
    assert len({r.doc_id for r in out}) == len(out)
    empty = spark.createDataFrame([], "doc_id long, source string, text string")
    assert M.mix(empty).count() == 0
    same = spark.createDataFrame([(1, "a", "x y")] * 3 + [(None, "a", "z")], "doc_id long, source string, text string")
    assert M.mix(same).count() == 4
    assert M.mix(spark.createDataFrame([(1, "a", ""), (2, None, None)], "doc_id long, source string, text string")).count() == 0


def test_repeated_ids_with_other_texts_are_stable(spark, rng, monkeypatch):
    """Rows that share an id are told apart by their text, so a recomputed task emits the same rows."""
    monkeypatch.setattr(M, "BLOCK_TOKENS", 100)
    rows = [(7, "a", words(rng, 3 + i % 20)) for i in range(200)] + [(None, "a", words(rng, 5 + i % 9)) for i in range(60)]
    d = spark.createDataFrame(rows, "doc_id long, source string, text string")
    got = [sorted((r.doc_id or 0, r.text, r.epoch, r.block, r.position) for r in M.mix(d.repartition(n), budget=700).collect()) for n in (1, 4)]
    assert got[0] == got[1] and 0 < len(got[0]) < len(rows)
    assert len({r[3] for r in got[0]}) > 3                    # one id does not fill one block
