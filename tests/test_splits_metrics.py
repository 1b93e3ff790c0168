import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tempora.operators import drift as dr
from tempora.operators import metrics as mt
from tempora.operators import monitor as mon
from tempora.operators import splits as sp


def _rows(spark, n, series="s"):
    return spark.createDataFrame([(series, i, n) for i in range(n)], "series_id string, row_id long, n_rows long")


def _train(spark, n):
    return sp.with_positions(_rows(spark, n)).withColumn("n_train", F.col("n_rows"))


def test_split_100(spark):
    s = {r["row_id"]: r["split"] for r in sp.chronological_split(_rows(spark, 100), keep_gap=True).collect()}
    assert all(s[i] == "train" for i in range(85))
    assert all(s[i] is None for i in range(85, 99))
    assert s[99] == "test"


def test_folds_over_100_and_85(spark):
    f = sp.cv_folds(_train(spark, 100)).where("role = 'val'").groupBy("fold").count().collect()
    assert sorted((r["fold"], r["count"]) for r in f) == [(i, 2) for i in range(1, 6)]
    f = sp.cv_folds(_train(spark, 100)).where("role = 'train' AND fold = 1").count()
    assert f == 100 - 5 * 16
    assert sp.cv_folds(_train(spark, 85)).count() == 0      # blocks of 14, buffer 14: all skipped


def test_slices(spark):
    r = sp.retrain_slices(_rows(spark, 200)).groupBy("slice").agg(F.min("row_id"), F.max("row_id")).collect()
    got = {x[0]: (x[1], x[2]) for x in r}
    assert got == {"retrain": (110, 199), "validation": (80, 109)}
    both = _rows(spark, 200)
    assert sp.append_bounded(both.where("row_id < 170"), both.where("row_id >= 170")).count() == 180
    got = sorted(r["row_id"] for r in sp.tail_rows(both, 5, 2, end=F.col("n_rows") - 10).collect())
    assert got == [183, 184, 185, 186, 187]
    assert [r["row_id"] for r in sp.head_rows(both, 2).collect()] == [0, 1]


def test_positions_after_the_valid_range(spark):
    d = _rows(spark, 100).where("row_id >= 30 AND row_id < 95")
    r = sp.with_positions(d, 30, 5).agg(F.min("pos"), F.max("pos"), F.min("n_pos")).first()
    assert tuple(r) == (0, 64, 65)


def test_quantiles_with_a_hot_value(spark):
    """90 % equal values are one counted row; the rank still falls where numpy puts it."""
    v = np.concatenate([np.zeros(9000), np.arange(1, 1001) / 7, [1e9]])
    df = spark.createDataFrame([(float(x), None) for x in v] + [(None, None)], "v double, g string").repartition(4)
    q = mt.exact_quantiles(df, ["g"], "v", [0.5, 0.899, 0.95, 1.0]).first()
    for p, nm in [(0.5, "q50"), (0.899, "q90"), (0.95, "q95"), (1.0, "q100")]:
        assert q[nm] == pytest.approx(np.percentile(v, p * 100))
    counts = df.where("v is not null").groupBy("g", "v").count()
    assert counts.count() == 1002          # what is sorted, not 10,001 rows


def _pred(spark, ys, ps, h=1, model="m", split="test"):
    base = dt.date(2024, 1, 1)
    rows = [(model, split, "s", base + dt.timedelta(days=i), i, h, float(y), float(p))
            for i, (y, p) in enumerate(zip(ys, ps))]
    return spark.createDataFrame(rows, "model string, split string, series_id string, ts date, row_id long, "
                                       "horizon int, y_true double, y_pred double")


def test_metric_edges(spark):
    m = mt.metrics_by_horizon(_pred(spark, [0, 0, 2, 4, 0, 6], [1, 1, 2, 2, 0, 3])).first()
    assert m["mape"] == pytest.approx(np.mean([0, 0.5, 0.5]) * 100)      # |y| > 1e-6 rows only
    y = np.array([0, 0, 2, 4, 0, 6.0]); p = np.array([1, 1, 2, 2, 0, 3.0])
    assert m["rmse"] == pytest.approx(np.sqrt(np.mean((y - p) ** 2)))
    assert m["r2"] == pytest.approx(1 - np.sum((y - p) ** 2) / np.sum((y - y.mean()) ** 2))
    const = mt.metrics_by_horizon(_pred(spark, [3, 3, 3], [3, 3, 3])).first()
    assert const["r2"] == 1.0 and const["mape"] == 0.0
    const2 = mt.metrics_by_horizon(_pred(spark, [3, 3, 3], [3, 4, 3])).first()
    assert const2["r2"] == 0.0
    zero = mt.metrics_by_horizon(_pred(spark, [0, 0], [1, 2])).first()
    assert zero["mape"] is None


def test_moments_5(spark):
    vals = [1, 2, 4, 9, 30]
    p = _pred(spark, vals, [0] * 5)
    m = mt.residual_moments(p).first()
    assert m["skewness"] == pytest.approx(1.8991560052, abs=1e-9)
    assert m["kurtosis"] == pytest.approx(3.6484559957, abs=1e-9)
    assert m["std"] == pytest.approx(np.std(vals))
    _, s = mt.high_error(p)
    assert s.first()["threshold"] == pytest.approx(21.6)


def test_exact_quantiles_match_numpy(spark):
    rng = np.random.default_rng(1)
    v = rng.normal(size=1001).round(3)
    df = spark.createDataFrame([(int(i % 3), float(x)) for i, x in enumerate(v)], "g int, v double")
    q = {r["g"]: r for r in mt.exact_quantiles(df, ["g"], "v", [0.0, 0.25, 0.5, 0.9, 1.0]).collect()}
    for g in range(3):
        xs = v[np.arange(len(v)) % 3 == g]
        for p, nm in [(0.0, "q00"), (0.25, "q25"), (0.5, "q50"), (0.9, "q90"), (1.0, "q100")]:
            assert q[g][nm] == pytest.approx(np.percentile(xs, p * 100))


def test_histogram_density_integrates_to_one(spark):
    h = mt.residual_histogram(_pred(spark, list(range(100)), [0] * 100), bins=50).collect()
    width = h[0]["bin_hi"] - h[0]["bin_lo"]
    assert sum(r["density"] for r in h) * width == pytest.approx(1.0)
    assert max(r["bin"] for r in h) == 50 and sum(r["count"] for r in h) == 100


def test_ks_30(spark):
    assert dr.ks_pvalue_exact(30, 30, 10 * 30) == pytest.approx(0.0709, abs=1e-4)
    assert dr.ks_pvalue_exact(30, 30, 11 * 30) == pytest.approx(0.0346, abs=1e-4)
    def flagged(shift):
        rows = [("s", float(i), True, False) for i in range(30)] + [("s", float(i + shift), False, True) for i in range(30)]
        return spark.createDataFrame(rows, "series_id string, x double, in_base boolean, in_recent boolean")
    st, summ = dr.ks_drift(flagged(11), ["series_id"], ["x"], min_drifted=1)
    r = st.first()
    assert r["k_stat"] == 11 * 30 and r["drifted"] and summ.first()["drift"]
    st10, _ = dr.ks_drift(flagged(10), ["series_id"], ["x"])
    assert not st10.first()["drifted"]


def test_ks_limit_is_near_the_exact_count(spark):
    rows = [(300, 300, k * 300) for k in (10, 25, 33, 40, 55)]
    d = spark.createDataFrame(rows, "n_base long, n_recent long, k_stat long")
    near = {r["k_stat"]: r["p_value"] for r in dr.with_pvalue(d, exact_cells=0).collect()}
    for n, m, k in rows:
        assert near[k] == pytest.approx(dr.ks_pvalue_exact(n, m, k), abs=0.03)


def test_drift_by_day_matches_a_day_by_day_test(spark):
    from tempora.plans.monitoring import drift_by_day
    rng = np.random.default_rng(5)
    cols = ["a", "b", "c"]
    x = rng.normal(size=(140, 3)).round(1)
    x[100:] += 1.5
    x[20:30, 1] = np.nan
    rows = [("s", i, (i - 79) if i >= 80 else None, *[None if np.isnan(v) else float(v) for v in r]) for i, r in enumerate(x)]
    df = spark.createDataFrame(rows, "series_id string, row_id long, day_index long, a double, b double, c double")
    got = {r["day_index"]: r for r in drift_by_day(df.where("row_id < 30"), df, cols).collect()}
    assert sorted(got) == list(range(1, 61))
    for day in (1, 20, 25, 40, 60):
        at = 79 + day
        n = 0
        for j in range(3):
            a, b = x[:30, j], x[at - 30:at, j]
            a, b = a[~np.isnan(a)], b[~np.isnan(b)]
            k = max(abs((a <= v).sum() * len(b) - (b <= v).sum() * len(a)) for v in np.union1d(a, b))
            n += dr.ks_pvalue_exact(len(a), len(b), int(k)) < 0.05
        assert got[day]["n_drifted"] == n and got[day]["drift"] == (n >= 3)


def test_ks_statistic_matches_definition(spark):
    rng = np.random.default_rng(3)
    a, b = rng.integers(0, 8, 25).astype(float), rng.integers(2, 10, 19).astype(float)
    pts = np.union1d(a, b)
    d = max(abs((a <= x).mean() - (b <= x).mean()) for x in pts)
    ba = spark.createDataFrame([("k", float(x)) for x in a], "g string, value double")
    bb = spark.createDataFrame([("k", float(x)) for x in b], "g string, value double")
    assert dr.ks_statistic(ba, bb, ["g"]).first()["d_stat"] == pytest.approx(d)


def test_trigger_log(spark):
    def log(degs, alerts):
        rows = [(dt.date(2024, 1, 1) + dt.timedelta(days=i), 1.0, 1.0, 1.0, float(dg), bool(al), i + 1)
                for i, (dg, al) in enumerate(zip(degs, alerts))]
        return spark.createDataFrame(rows, "ts date, rmse double, mae double, base_rmse double, "
                                           "degradation double, alert boolean, day_index long")
    n = 95
    t = {r["day_index"]: r for r in mon.triggers(log([0.2] * n, [False] * n)).collect()}
    assert not t[29]["should_retrain"] and t[30]["reasons"] == "sustained_degradation"
    alerts = [False] * 40 + [True] * 5 + [False] * 50
    t = {r["day_index"]: r for r in mon.triggers(log([0.0] * n, alerts)).collect()}
    assert t[45]["reasons"] == "alert_spike" and not t[44]["should_retrain"]
    t = {r["day_index"]: r for r in mon.triggers(log([0.0] * n, [False] * n)).collect()}
    assert not t[89]["should_retrain"] and t[90]["reasons"] == "scheduled_maintenance"
    ev = spark.createDataFrame([(10, True, 5.0), (10, False, None)], "day_index long, adopted boolean, improvement double")
    t = {r["day_index"]: r for r in mon.triggers(log([0.0] * n, [False] * n), history=ev).collect()}
    assert len(t) == n and not any(r["should_retrain"] for r in t.values())       # 95 - 10 < 90
    assert t[10]["last_retrain"] is None and t[11]["last_retrain"] == 10


def test_monitor_by_series(spark):
    rows = [(s, dt.date(2024, 1, 1) + dt.timedelta(days=i), 1.0, 1.0, 1.0, dg, dg > 0.15, i + 1)
            for s, dg in (("a", 0.2), ("b", 0.0)) for i in range(95)]
    log = spark.createDataFrame(rows, "series_id string, ts date, rmse double, mae double, base_rmse double, "
                                      "degradation double, alert boolean, day_index long")
    ev = spark.createDataFrame([("b", 50, True, 4.0), ("b", 60, False, None)],
                               "series_id string, day_index long, adopted boolean, improvement double")
    flags = spark.createDataFrame([("b", 40, True)], "series_id string, day_index long, drift boolean")
    by = ("series_id",)
    t = {(r["series_id"], r["day_index"]): r["reasons"] for r in mon.triggers(log, flags, ev, by=by).collect()}
    assert len(t) == 190 and t["b", 40] == "distribution_drift" and t["a", 40] == "sustained_degradation,alert_spike"
    assert t["b", 90] == "" and t["a", 90].endswith("scheduled_maintenance")
    r = {x["series_id"]: x for x in mon.report(log, ev, by=by).collect()}
    assert r["b"]["n_retrains"] == 2 and r["b"]["n_adopted"] == 1 and r["b"]["mean_adopted_improvement"] == 4.0
    assert r["a"]["n_retrains"] == 0 and r["a"]["n_predictions"] == 95
    d = mon.dashboard(log, ev, by=by)
    assert d.count() == 190
    assert {(x["day_index"], x["retrain_adopted"]) for x in d.where("retrain_adopted is not null").collect()} == {(50, True), (60, False)}
    none = mon.report(log.limit(0)).first()
    assert none["n_predictions"] == 0 and none["n_retrains"] == 0


def test_null_keys_and_rejects(spark):
    from tempora.operators import features as fe
    from tempora.operators import windows as wn
    rows = [("a", dt.date(2024, 1, 1), 1.0), ("a", None, 2.0), (None, dt.date(2024, 1, 2), 3.0), (None, None, 4.0),
            ("a", dt.date(2024, 2, 1), 5.0), ("a", dt.date(2024, 2, 1), 6.0)]
    df = spark.createDataFrame(rows, "series_id string, ts date, temp double")
    both = [sorted((str(r.series_id), str(r.ts), r.temp, r.row_id, r.n_rows) for r in wn.number_rows(df, mode=m).collect())
            for m in ("plain", "blocked")]
    assert both[0] == both[1] and len(both[0]) == 6
    r = {(x.series_id, x.reason): x.n_rows for x in fe.rejects(df, 30, 5).collect()}
    assert r == {("a", "null_key"): 1, ("a", "short_series"): 4, (None, "null_key"): 2, (None, "short_series"): 2}


def test_exact_quantiles_of_skewed_values(spark, monkeypatch):
    """One huge value, a repeated one and infinities: ranges narrow by counting until few values are left."""
    import numpy as np
    rng = np.random.default_rng(1)
    v = np.concatenate((rng.standard_normal(40_000), [1e12, -1e300, 1.7e308, -1.7e308], np.full(20_000, 0.25), rng.random(3000) * 1e-200))
    df = spark.createDataFrame([("a", float(x)) for x in v] + [("b", float("inf")), ("b", 1.0), ("b", float("-inf")), (None, 2.0), ("c", None)],
                               "g string, v double").repartition(3)
    sorted_at_once = []
    inside = mt._inside

    def spy(counts, ranges, keys, gk, rows):
        out = inside(counts, ranges, keys, gk, rows)
        sorted_at_once.append(out.groupBy(*gk, "_lo").count().agg({"count": "max"}).first()[0])
        return out
    monkeypatch.setattr(mt, "_inside", spy)
    probs = [0.0, 0.001, 0.25, 0.5, 0.9, 0.9999, 1.0]
    got = {r["g"]: r for r in mt.exact_quantiles(df, ["g"], "v", probs, [f"p{i}" for i in range(7)]).collect()}
    want = np.quantile(v, probs)
    assert [got["a"][f"p{i}"] for i in range(7)] == pytest.approx(want.tolist(), rel=1e-12)
    assert sorted_at_once[-1] <= mt.SORTED_VALUES and len(sorted_at_once) > 1       # the last range is what is sorted
    assert got[None]["p3"] == 2.0 and "c" not in got and got["b"]["p3"] == 1.0
    assert mt.exact_quantiles(df.where("false"), ["g"], "v", [0.5]).count() == 0
    assert mt.exact_quantiles(df.where("g = 'a'"), [], "v", [0.5], ["m"]).first()["m"] == pytest.approx(np.median(v))
