import os
import tempfile

import pytest
from pyspark.sql import functions as F

from tempora.operators import features as fe
from tempora.operators import learners as ln
from tempora.operators import metrics as mt
from tempora.operators.models import ensemble_mean
from tempora.plans import training as tr
from tempora.sources import standins as si
from tempora.sources import store
from conftest import SF

HS = fe.DAILY_HORIZONS
TARGETS = [f"target_temp_t+{h}" for h in HS]


@pytest.fixture(scope="module")
def prepared(spark):
    s, train, test = tr.prepare_daily(si.daily(spark, SF))
    return s, train, test, tr.model_roles(s)


def test_bayes_ridge_bundle_roundtrip(spark, prepared):
    s, train, test, roles = prepared
    m = ln.fit_horizons("br", "bayes_ridge", train, roles, TARGETS, HS)
    p1 = m.predict(test).orderBy("ts", "horizon").collect()
    path = tempfile.mkdtemp(prefix="tempora-bundle-")
    store.save_model(spark, m, os.path.join(path, "br"))
    m2 = store.load_model(spark, os.path.join(path, "br"))
    p2 = m2.predict(test).orderBy("ts", "horizon").collect()
    assert len(p1) == len(p2) == test.count() * len(HS)
    assert all(a["y_pred"] == pytest.approx(b["y_pred"]) for a, b in zip(p1, p2))


def test_ml_model_beats_nothing_and_roundtrips(spark, prepared):
    s, train, test, roles = prepared
    m = ln.fit_horizons("huber", ln.huber(max_iter=20), train, roles, TARGETS[:2], HS[:2])
    path = os.path.join(tempfile.mkdtemp(prefix="tempora-bundle-"), "h")
    store.save_model(spark, m, path)
    m2 = store.load_model(spark, path)
    a = m.predict(test).agg(F.sum("y_pred")).first()[0]
    b = m2.predict(test).agg(F.sum("y_pred")).first()[0]
    assert a == pytest.approx(b)


def test_ensemble_of_one_is_itself(spark):
    p = si.naive_forecasts(si.daily(spark, SF), ensemble=False)
    e = ensemble_mean(p, ["persist"], "persist")
    cols = ["model", "split", "series_id", "ts", "row_id", "horizon", "y_true", "y_pred"]
    assert e.select(cols).exceptAll(p.where("model = 'persist'").select(cols)).count() == 0


def test_no_train_test_overlap_within_gap(prepared):
    s, train, test, roles = prepared
    hi = train.agg(F.max("row_id")).first()[0]
    lo = test.agg(F.min("row_id")).first()[0]
    assert lo - hi == 15          # 14 gap rows between


def test_champion_challenger_and_state_tables(spark, prepared):
    from tempora.plans import monitoring as mo
    s, train, test, roles = prepared
    champ = ln.fit_horizons("champion", "bayes_ridge", train, roles, TARGETS, HS)
    end = F.col("n_rows") - max(HS)
    hist = train.unionByName(test)
    ev, state = mo.champion_challenger(champ, "bayes_ridge", hist, roles, TARGETS, HS, 40, end=end)
    e = ev.first()
    assert e["adopted"] == (e["challenger_rmse"] < e["champion_rmse"])
    # Nothing to validate on: adopted, no errors recorded, baseline refreshed
    ev2, state2 = mo.champion_challenger(champ, "bayes_ridge", hist, roles, TARGETS, HS, 41, validation_window=0, end=end)
    e2 = ev2.first()
    assert e2["adopted"] and e2["champion_rmse"] is None and state2["baseline"]["rmse"] > 0
    path = tempfile.mkdtemp(prefix="tempora-state-")
    mo.initialise(spark, champ, train, path)
    mo.record(ev, path)
    mo.record(ev2, path)
    st = mo.state(spark, path)
    assert st["events"].count() == 2 and st["log"].count() == 0
    assert st["baseline"].first()["rmse"] == pytest.approx(mo.pooled_rmse(champ.predict(train)).first()["rmse"])


def test_text_branch_weights(spark):
    """Fitted TF-IDF: unseen terms weigh nothing, NULL is 'missing', rows are L2-normed."""
    import math
    from pyspark.ml.functions import vector_to_array
    from tempora.operators import preprocess as pp
    train = spark.createDataFrame([(1, "warm sun warm", 1.0), (2, "rain", 2.0), (3, None, 3.0)], "i int, description string, x double")
    test = spark.createDataFrame([(4, "rain rain sun hail", 1.0), (5, "hail", 2.0), (6, None, None)], "i int, description string, x double")
    m = pp.Preprocessor(["x"], [], ["description"]).fit(train)
    vocab = dict(m.state["vocab"])
    assert set(vocab) == {"warm", "sun", "rain", "missing", "warm sun", "sun warm"}
    idf = math.log(4 / 2) + 1
    assert all(w == pytest.approx(idf) for w in vocab.values())
    rows = {r["i"]: r for r in m.transform(test).select("i", vector_to_array("features").alias("f")).collect()}
    at = {t: 1 + k for k, (t, _) in enumerate(m.state["vocab"])}       # one numeric column first
    assert rows[4]["f"][at["rain"]] == pytest.approx(2 / math.sqrt(5)) and rows[4]["f"][at["sun"]] == pytest.approx(1 / math.sqrt(5))
    assert all(v == 0 for v in rows[5]["f"][1:]) and rows[6]["f"][at["missing"]] == 1.0
    again = pp.PreprocessorModel(__import__("json").loads(__import__("json").dumps(m.state)))
    assert again.transform(test).count() == 3


def test_training_run_with_text_is_saved_and_served(spark):
    path = os.path.join(tempfile.mkdtemp(prefix="tempora-bundle-"), "run")
    series = si.daily(spark, SF)
    assert "description" in series.columns
    r = tr.run_daily_training(series, {"BayesianRidge": "bayes_ridge", "Huber": ln.huber(max_iter=10)}, cv=False,
                              ensemble_members=["BayesianRidge", "Huber"], save_to=path)
    assert r.roles["text"] == ["description"]
    b = store.load_bundle(spark, path)
    assert b["ensemble"] == {"Ensemble_Final": ["BayesianRidge", "Huber"]} and set(b["models"]) == {"BayesianRidge", "Huber"}
    direct = r.models["BayesianRidge"].predict(r.test).agg(F.sum("y_pred")).first()[0]
    assert b["models"]["BayesianRidge"].predict(r.test).agg(F.sum("y_pred")).first()[0] == pytest.approx(direct)
    out = {(x["model"], x["horizon"]): x for x in tr.serve(series, path).collect()}
    assert len(out) == 15
    for h in HS:
        assert out["Ensemble_Final", h]["y_pred"] == pytest.approx((out["BayesianRidge", h]["y_pred"] + out["Huber", h]["y_pred"]) / 2)
        assert (out["Huber", h]["forecast_date"] - out["Huber", h]["origin_ts"]).days == h
    assert spark.read.json(f"{path}/metadata").first()["train_samples"] == r.train.count()
    r.close()


def test_metadata_record(spark):
    p = si.naive_forecasts(si.daily(spark, SF))
    macros = mt.macro(mt.metrics_by_horizon(p))
    d = tempfile.mkdtemp(prefix="tempora-meta-")
    meta = store.metadata_record(spark, macros, "ens", 3308, 570)
    store.write_metadata(meta, os.path.join(d, "meta"))
    r = spark.read.json(os.path.join(d, "meta")).first()
    want = macros.where("model = 'ens' AND split = 'test'").first()
    assert r["best_model"] == "ens" and r["train_samples"] == 3308 and r["test_samples"] == 570
    assert r["test_rmse"] == pytest.approx(want["rmse_macro"]) and r["test_r2"] == pytest.approx(want["r2_macro"])
    assert len(r["train_date"]) == 19
