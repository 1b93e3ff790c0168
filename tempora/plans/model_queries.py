"""Registered model queries (rows-only check: fitted models have no SQL form).

Each fits on the whole stand-in daily series of ``sf_dir``, free text included, with the
reference's tuned parameters and its cross-validation.
"""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tempora.operators import features as fe
from tempora.operators import learners as ln
from tempora.plans import training as tr
from tempora.plans.queries import BLOCK_ROWS, fin
from tempora.session import checkpoint_dir
from tempora.sources import standins as si
from tempora.sources import store

HISTGB, RIDGE = "HistGB", "BayesianRidge"


def _run(spark, d, estimators, members=None, save_to=None, parallel=5):
    return tr.run_daily_training(si.daily(spark, d), estimators, ensemble_members=members,
                                 block_rows=BLOCK_ROWS, parallel=parallel, save_to=save_to)


def q_bayes_ridge(spark, d):
    """M1 (+M3, M7, M8): Bayesian ridge per horizon with 5-fold CV."""
    r = _run(spark, d, {RIDGE: "bayes_ridge"})
    return fin(r.metrics)


def q_gbt(spark, d):
    """M2 (+M3, M7, M8): boosted trees with the tuned daily parameters, all 493 rounds, 5-fold CV."""
    r = _run(spark, d, {HISTGB: ln.boosting()})
    return fin(r.metrics)


def q_forest(spark, d):
    """M4 (+M7, M8): random forest with the tuned parameters (200 trees), 5-fold CV."""
    r = _run(spark, d, {"RandomForest": ln.forest()}, parallel=8)
    return fin(r.metrics)


def q_huber(spark, d):
    """M5 (+M7, M8): Huber regression with the tuned parameters, 5-fold CV."""
    r = _run(spark, d, {"Huber": ln.huber()})
    return fin(r.metrics)


def _final(spark, d, save_to=None):
    """The training run: Bayesian ridge, boosted trees and the mean of both."""
    return _run(spark, d, {RIDGE: "bayes_ridge", HISTGB: ln.boosting()}, members=[RIDGE, HISTGB], save_to=save_to)


def q_train_multi(spark, d):
    """Bayesian ridge and boosted trees with CV, their mean ensemble, leaderboard."""
    return fin(_final(spark, d).leaderboard)


def q_serve(spark, d):
    """Entry 1 saved (S7, S8), then M11 from the loaded bundle (S9): forecasts of every member
    and the ensemble from the newest row of each series, dated origin + h."""
    path = f"{checkpoint_dir(spark)}/bundle-{uuid.uuid4().hex}"
    _final(spark, d, save_to=path).close()
    return fin(tr.serve(si.daily(spark, d), path, BLOCK_ROWS))


def q_saved_models(spark, d):
    """Predictions of a saved and loaded model against the fitted one's, per horizon."""
    path = f"{checkpoint_dir(spark)}/bundle-{uuid.uuid4().hex}"
    r = _run(spark, d, {RIDGE: "bayes_ridge"}, save_to=path)
    again = store.load_bundle(spark, path)["models"][RIDGE].predict(r.test.withColumn("split", F.lit("test")))
    both = (r.predictions.where("split = 'test'").join(again.select("series_id", "row_id", "horizon", F.col("y_pred").alias("loaded")),
                                                       ["series_id", "row_id", "horizon"]))
    return fin(both.groupBy("model", "horizon").agg(F.count(F.lit(1)).alias("n"),
                                                    F.max(F.abs(F.col("y_pred") - F.col("loaded"))).alias("max_difference")))


def q_champion(spark, d):
    """champion/challenger on the retrain and validation slices."""
    from tempora.plans.monitoring import champion_challenger
    series = si.daily(spark, d)
    s, train, test = tr.prepare_daily(series, BLOCK_ROWS)
    roles = tr.model_roles(s)
    targets = [f"target_temp_t+{h}" for h in fe.DAILY_HORIZONS]
    champ = ln.fit_horizons("champion", "bayes_ridge", train, roles, targets, fe.DAILY_HORIZONS)
    hist = train.unionByName(test)
    # the history ends where the valid range does
    end = F.col("n_rows") - max(fe.DAILY_HORIZONS)
    ev, _ = champion_challenger(champ, "bayes_ridge", hist, roles, targets, fe.DAILY_HORIZONS, day_index=0, end=end)
    return fin(ev)


MODEL_QUERIES = {k: v for k, v in list(globals().items()) if k.startswith("q_") and callable(v)}
