"""Boosted trees against a plain NumPy twin, and the batched fits against separate ones."""
import heapq
import os
import tempfile

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from tempora.operators import boosting as bo


def twin(x, y, p):
    """Predictions of best-first boosted trees, one split search at a time."""
    edges = [bo.column_edges(x[:, j], p.max_bins) for j in range(x.shape[1])]
    pred = np.full(len(y), y.mean())
    for _ in range(p.max_iter):
        g = pred - y

        def best(rows):
            out = (0.0, None)
            total = g[rows].sum() ** 2 / (len(rows) + p.l2_regularization)
            for j, e in enumerate(edges):
                for cut in e:
                    left = rows[x[rows, j] <= cut]
                    right = rows[x[rows, j] > cut]
                    if min(len(left), len(right)) < p.min_samples_leaf:
                        continue
                    gain = (g[left].sum() ** 2 / (len(left) + p.l2_regularization)
                            + g[right].sum() ** 2 / (len(right) + p.l2_regularization) - total)
                    if gain > out[0] + 1e-9:
                        out = (gain, (left, right))
            return out
        leaves, heap, done = 1, [], []

        def offer(rows, depth):
            gain, parts = best(rows) if (p.max_depth is None or depth < p.max_depth) and len(rows) >= 2 * p.min_samples_leaf else (0.0, None)
            if parts is None:
                done.append(rows)
            else:
                heapq.heappush(heap, (-gain, len(done) + len(heap), rows, parts, depth))
        offer(np.arange(len(y)), 0)
        while heap and leaves < p.max_leaf_nodes:
            _, _, _, parts, depth = heapq.heappop(heap)
            leaves += 1
            for q in parts:
                offer(q, depth + 1)
        for rows in done + [h[2] for h in heap]:
            pred[rows] -= p.learning_rate * g[rows].sum() / (len(rows) + p.l2_regularization)
    return pred


def frame(spark, x, ys, fit=None):
    rows = [(int(fit[i]) if fit is not None else 0, [float(v) for v in x[i]], *[None if y[i] is None else float(y[i]) for y in ys], i) for i in range(len(x))]
    kind = "fit int, a array<double>, " + ", ".join(f"y{k} double" for k in range(len(ys))) + ", i int"
    return spark.createDataFrame(rows, kind).withColumn("features", array_to_vector("a")).repartition(3)


def data(n=240, seed=1):
    g = np.random.default_rng(seed)
    x = np.column_stack([g.standard_normal(n), g.integers(0, 5, n), g.random(n) * 100, np.full(n, 3.0)])
    return x, 2 * x[:, 0] + (x[:, 1] == 3) * 4 + 0.3 * g.standard_normal(n), np.sin(x[:, 2]) + g.standard_normal(n) * 0.1


def predicted(model, df, names):
    return {r["i"]: [r[n] for n in names] for r in model.with_predictions(df, names).collect()}


@pytest.mark.parametrize("p", [
    bo.Boosting(0.1, 12, 3, 10, 1e-5),
    bo.Boosting(0.3, 6, None, 5, 0.5, max_leaf_nodes=6),
    bo.Boosting(0.2, 4, 2, 20, 0.0, max_bins=16),
])
def test_equals_the_twin(spark, p):
    x, y0, y1 = data()
    df = frame(spark, x, [y0, y1])
    model = bo.fit_boosters(df, ["y0", "y1"], p)[0]
    got = predicted(model, df, ["p0", "p1"])
    for k, y in enumerate((y0, y1)):
        assert np.allclose([got[i][k] for i in range(len(x))], twin(x, y, p), atol=1e-9)
    assert all(len(t) == p.max_iter for t in model.trees)


def test_several_blocks_and_fits_equal_one(spark, monkeypatch):
    x, y0, y1 = data(300)
    p = bo.Boosting(0.2, 5, 3, 10, 1e-3)
    alone = [bo.fit_boosters(frame(spark, x[s], [y0[s], y1[s]]), ["y0", "y1"], p)[0] for s in (slice(0, 120), slice(0, 300))]
    monkeypatch.setattr(bo, "BLOCK_ROWS", 64)
    monkeypatch.setattr(bo, "HIST_CELLS", 600)
    monkeypatch.setattr(bo, "CHECKPOINT_ROUNDS", 2)
    both = np.concatenate((np.arange(120), np.arange(300)))
    df = frame(spark, x[both], [y0[both], y1[both]], np.repeat([7, 3], [120, 300]))
    many = bo.fit_boosters(df, ["y0", "y1"], p, "fit")
    assert set(many) == {3, 7}
    for m, one, n in ((many[7], alone[0], 120), (many[3], alone[1], 300)):
        for k in range(2):
            assert np.allclose(m.predict(x[:n], k), one.predict(x[:n], k), atol=1e-9)


def test_a_fit_of_one_block_takes_no_job_a_round(spark):
    """Four times the rounds, the same number of jobs, and the trees of the shorter run first."""
    x, y0, y1 = data(120)
    df = frame(spark, x, [y0, y1]).cache()
    df.count()

    def jobs(rounds):
        group = f"rounds-{rounds}"
        spark.sparkContext.setJobGroup(group, group)
        try:
            model = bo.fit_boosters(df, ["y0", "y1"], bo.Boosting(0.2, rounds, 3, 10))[0]
        finally:
            spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        return len(spark.sparkContext.statusTracker().getJobIdsForGroup(group)), model
    (few, short), (many, long) = jobs(3), jobs(12)
    assert 0 < few == many
    assert [t[:3] for t in long.trees] == short.trees and all(len(t) == 12 for t in long.trees)


def test_fits_of_one_and_of_several_blocks_together(spark, monkeypatch):
    x, y0, y1 = data(300)
    p = bo.Boosting(0.2, 4, 3, 10, 1e-3)
    one = {f: bo.fit_boosters(frame(spark, x[:n], [y0[:n], y1[:n]]), ["y0", "y1"], p)[0] for f, n in ((7, 60), (3, 300))}
    monkeypatch.setattr(bo, "BLOCK_ROWS", 128)
    both = np.concatenate((np.arange(60), np.arange(300)))
    many = bo.fit_boosters(frame(spark, x[both], [y0[both], y1[both]], np.repeat([7, 3], [60, 300])), ["y0", "y1"], p, "fit")
    for f, n in ((7, 60), (3, 300)):
        for k in range(2):
            assert np.allclose(many[f].predict(x[:n], k), one[f].predict(x[:n], k), atol=1e-9)


def test_null_targets_ties_and_constant_columns(spark):
    x, y0, _ = data(90)
    x[:, :3] = np.repeat(x[:30, :3], 3, axis=0)                    # repeated rows
    some = [None if i % 3 == 0 else v for i, v in enumerate(y0)]
    df = frame(spark, x, [some, [None] * 90])
    p = bo.Boosting(0.5, 3, 2, 5)
    m = bo.fit_boosters(df, ["y0", "y1"], p)[0]
    keep = np.array([i % 3 != 0 for i in range(90)])
    kept = bo.fit_boosters(df.where("y0 is not null"), ["y0"], p)[0]
    # bins come from all rows of the fit, so compare with the twin on the same edges only where they agree
    assert np.isfinite(m.predict(x[keep], 0)).all() and np.allclose(m.predict(x, 0), kept.predict(x, 0))
    assert all(r[1] is None for r in predicted(m, df, ["p0", "p1"]).values())
    flat = frame(spark, np.ones((20, 2)), [y0[:20]])
    assert np.allclose(bo.fit_boosters(flat, ["y0"], p)[0].predict(np.ones((3, 2)), 0), np.mean(y0[:20]))
    assert bo.fit_boosters(df.where("false"), ["y0"], p) == {}


def test_saved_and_loaded(spark):
    x, y0, y1 = data(150)
    df = frame(spark, x, [y0, y1])
    m = bo.fit_boosters(df, ["y0", "y1"], bo.Boosting(0.2, 4, 3, 10))[0]
    path = os.path.join(tempfile.mkdtemp(prefix="tempora-boost-"), "m")
    m.save(path, spark)
    again = bo.BoostedTrees.load(path, spark)
    assert predicted(again, df, ["a", "b"]) == predicted(m, df, ["a", "b"])


def test_edges():
    assert bo.column_edges(np.array([1.0, 1, 2, 5]), 255).tolist() == [1.5, 3.5]
    e = bo.column_edges(np.arange(10_000.0), 255)
    assert len(e) == 254 and (np.bincount(np.searchsorted(e, np.arange(10_000.0))) > 30).all()


def test_folds_in_one_call_equal_separate_fits(spark):
    """M7/M8: metrics of all folds from one call equal those of a fit per fold."""
    from conftest import SF
    from tempora.operators import features as fe, learners as ln, metrics as mt, splits as sp
    from tempora.plans import training as tr
    from tempora.sources import standins as si
    s, train, test = tr.prepare_daily(si.daily(spark, SF))
    roles, hs = tr.model_roles(s), fe.DAILY_HORIZONS[:2]
    targets = [f"target_temp_t+{h}" for h in hs]
    folds = sp.cv_folds(train)
    for est in ("bayes_ridge", bo.Boosting(0.1, 3, 3, 25), ln.huber(max_iter=6)):
        _, _, got = ln.train_model("m", est, train, test, roles, targets, hs, folds)
        cv = {(r["fold"], r["horizon"], r["metric"]): r["value"] for r in got.where("split = 'cv'").collect()}
        assert {f for f, _, _ in cv} == {1, 2, 3, 4, 5}
        for f in (1, 4):
            one = ln.fit_horizons("m", est, folds.where((F.col("fold") == f) & (F.col("role") == "train")).drop("fold", "role"), roles, targets, hs)
            val = folds.where((F.col("fold") == f) & (F.col("role") == "val")).drop("fold", "role").withColumn("split", F.lit("cv"))
            for r in mt.to_long(mt.metrics_by_horizon(one.predict(val)).drop("n")).collect():
                assert cv[f, r["horizon"], r["metric"]] == pytest.approx(r["value"], rel=1e-6)


def test_huber_equals_a_plain_solution(spark):
    """M5: the weighted Gram passes reach the minimum that a plain descent reaches."""
    from tempora.operators import learners as ln
    g = np.random.default_rng(5)
    x = g.standard_normal((200, 3))
    y = x @ [1.0, -2.0, 0.5] + 3 + 0.2 * g.standard_normal(200)
    y[::17] += 25                                                    # outliers
    p = ln.Huber(alpha=0.6, epsilon=1.5, max_iter=200, tol=1e-12)
    m = ln.fit_huber(frame(spark, x, [y]).withColumn("_fit", F.lit(0)), ["y0"], p, "_fit")[0]

    def loss(w, c, s):
        z = np.abs(y - x @ w - c) / s
        return (s + np.where(z < p.epsilon, z ** 2, 2 * p.epsilon * z - p.epsilon ** 2) * s).sum() + p.alpha * (w @ w)
    w, c, s = m.coef[:, 0], m.intercept[0], m.scale[0]
    at = loss(w, c, s)
    for d in range(5):
        for step in (1e-3, -1e-3):
            v = np.concatenate((w, [c, s]))
            v[d] += step
            assert loss(v[:3], v[3], v[4]) > at                       # convex: no better neighbour along any axis
    v = np.concatenate((w, [c, s]))
    for _ in range(200):
        u = v + g.standard_normal(5) * 1e-3
        assert loss(u[:3], u[3], u[4]) > at
