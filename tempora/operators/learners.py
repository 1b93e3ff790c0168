"""Per-horizon regression models and the training job.

* M1 Bayesian ridge: one distributed pass builds ``X'X``, ``X'Y`` and ``Y'Y``
  for every horizon at once (numpy inside each task, summed by Spark's
  vector ``Summarizer``); the evidence iteration then runs on the p x p
  result on the driver (p = feature count, independent of row count).
* M2 boosted trees: ``operators.boosting``.
* M4: ``pyspark.ml`` random forest, one fit per horizon (M3) on one cached feature vector.
* M5 Huber: weighted Gram passes with a joint scale, the reference's penalty.

A cross-validation and the final fit are one call: every training row is copied to the
fits it belongs to (a fold's training window, or the whole table), and the
preprocessors, Gram matrices and boosters of all fits come from the same jobs.

Predictions come back as the long table
``(model, split, series_id, ts, row_id, horizon, y_true, y_pred)``.
"""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import RandomForestRegressor
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tempora.operators import metrics as mt
from tempora.operators.boosting import BoostedTrees, Boosting, fit_boosters
from tempora.operators.preprocess import Preprocessor

# Fixed values that must equal the reference's configuration (tuned params).
HGB_DAILY = dict(learning_rate=0.02014148621347681, max_depth=3, max_iter=493, min_samples_leaf=25,
                 l2_regularization=9.852173472173725e-06)
HGB_HOURLY = dict(learning_rate=0.07172313382240242, max_depth=12, min_samples_leaf=131,
                  l2_regularization=0.0026568368934158193)
RF_PARAMS = dict(n_estimators=200, max_depth=8, min_samples_leaf=10, max_features=0.8)
HUBER_PARAMS = dict(alpha=0.6258952607607242, epsilon=1.5599425526665442)
BAYES_DEFAULTS = dict(max_iter=300, tol=1e-3, alpha_1=1e-6, alpha_2=1e-6, lambda_1=1e-6, lambda_2=1e-6)

KEYS = ["split", "series_id", "ts", "row_id"]


# ------------------------------------------------------------------ M1

FIT = "_fit"


def _weighted_sums(df: DataFrame, features_col: str, label_cols, by: str, weigh=None) -> dict:
    """``{(fit, label): sums}`` of ``[1, x, y]`` products, one distributed pass.

    ``weigh(fit, X, Y)`` gives row weights and further sums per label (NumPy in the
    task); without it all labels share one matrix under the label -1.
    """
    k = len(label_cols)
    arr = df.select(F.col(by).cast("int").alias("fit"), vector_to_array(features_col).alias("x"),
                    F.array(*[F.col(c).cast("double") for c in label_cols]).alias("y"))

    def part(it):
        acc: dict = {}
        for pdf in it:
            for fit, rows in pdf.groupby("fit"):
                X = np.vstack(rows["x"].to_numpy()).astype(float)
                Y = np.vstack(rows["y"].to_numpy()).astype(float)
                if weigh is None:
                    m = np.concatenate([np.ones((len(X), 1)), X, Y], axis=1)
                    parts = {(fit, -1): (m.T @ m).ravel()}
                else:
                    parts = {}
                    for j, (w, more) in enumerate(weigh(fit, X, Y)):
                        m = np.concatenate([np.ones((len(X), 1)), X, Y[:, j:j + 1]], axis=1)
                        parts[fit, j] = np.concatenate([((m * w[:, None]).T @ m).ravel(), more])
                for key, a in parts.items():
                    acc[key] = a if key not in acc else acc[key] + a
        if acc:
            yield pd.DataFrame({"fit": [f for f, _ in acc], "label": [j for _, j in acc], "s": [a.tolist() for a in acc.values()]})

    # two levels, so that many partitions' sums do not all meet in one task
    s = arr.mapInPandas(part, "fit int, label int, s array<double>").withColumn("g", F.spark_partition_id() % 32)
    tot = (s.groupBy("fit", "label", "g").agg(Summarizer.sum(array_to_vector("s")).alias("t"))
            .groupBy("fit", "label").agg(Summarizer.sum(F.col("t")).alias("t")))
    return {(r["fit"], r["label"]): r["t"].toArray() for r in tot.collect()}


def grams(df: DataFrame, features_col: str, label_cols, by: str) -> dict:
    """``{fit: sufficient statistics of least squares}`` of all fits in one pass."""
    k = len(label_cols)
    out = {}
    for (fit, _), tot in _weighted_sums(df, features_col, label_cols, by).items():
        q = int(round(np.sqrt(len(tot))))
        m = tot.reshape(q, q)
        f = q - k
        out[fit] = dict(n=m[0, 0], sx=m[0, 1:f], sy=m[0, f:], XtX=m[1:f, 1:f], XtY=m[1:f, f:], YtY=m[f:, f:])
    return out


def gram(df: DataFrame, features_col: str, label_cols) -> dict:
    """Sufficient statistics of least squares in one distributed pass."""
    return grams(df.withColumn(FIT, F.lit(0)), features_col, label_cols, FIT)[0]


def bayesian_ridge_from_gram(st: dict, max_iter=300, tol=1e-3, alpha_1=1e-6, alpha_2=1e-6,
                             lambda_1=1e-6, lambda_2=1e-6):
    """Evidence maximisation on centred sufficient statistics; returns
    (coef p x k, intercept k, alpha k, lambda k)."""
    n = st["n"]
    xm, ym = st["sx"] / n, st["sy"] / n
    C = st["XtX"] - n * np.outer(xm, xm)
    XtY = st["XtY"] - n * np.outer(xm, ym)
    YtY = np.diag(st["YtY"]) - n * ym * ym
    eig, V = np.linalg.eigh(C)
    eig = np.clip(eig, 0, None)
    eps = np.finfo(np.float64).eps
    coefs, alphas, lambdas = [], [], []
    for j in range(XtY.shape[1]):
        xty, yty = XtY[:, j], YtY[j]
        alpha, lam = 1.0 / (yty / n + eps), 1.0
        proj = V.T @ xty
        old = None

        def update(a, l):
            c = V @ (proj / (eig + l / a))
            rss = max(yty - 2 * c @ xty + c @ C @ c, 0.0)
            return c, rss
        for it in range(max_iter):
            c, rss = update(alpha, lam)
            gamma = np.sum(alpha * eig / (lam + alpha * eig))
            lam = (gamma + 2 * lambda_1) / (np.sum(c ** 2) + 2 * lambda_2)
            alpha = (n - gamma + 2 * alpha_1) / (rss + 2 * alpha_2)
            if old is not None and np.sum(np.abs(old - c)) < tol:
                break
            old = c
        c, _ = update(alpha, lam)
        coefs.append(c)
        alphas.append(alpha)
        lambdas.append(lam)
    coef = np.array(coefs).T
    intercept = ym - xm @ coef
    return coef, intercept, np.array(alphas), np.array(lambdas)


class BayesianRidgeModel:
    """Linear model of every label: a JVM-side dot product (Bayesian ridge, Huber)."""

    def __init__(self, coef, intercept, features_col="features"):
        self.coef, self.intercept, self.features_col = np.asarray(coef), np.asarray(intercept), features_col

    def predict_cols(self, names):
        """One prediction column per label: a JVM-side dot product."""
        x = vector_to_array(self.features_col)
        out = []
        for j, nm in enumerate(names):
            w = F.array(*[F.lit(float(v)) for v in self.coef[:, j]])
            dot = F.aggregate(F.zip_with(x, w, lambda a, b: a * b), F.lit(0.0), lambda acc, v: acc + v)
            out.append((dot + F.lit(float(self.intercept[j]))).alias(nm))
        return out


def fit_bayesian_ridge(df: DataFrame, label_cols, features_col="features", **kw) -> BayesianRidgeModel:
    st = gram(df, features_col, label_cols)
    coef, intercept, _, _ = bayesian_ridge_from_gram(st, **{**BAYES_DEFAULTS, **kw})
    return BayesianRidgeModel(coef, intercept, features_col)


# ------------------------------------------------------------------ M2, M4, M5

def boosting(params: dict = HGB_DAILY) -> Boosting:
    """M2 with tuned parameters (``HGB_DAILY``, ``HGB_HOURLY``)."""
    return Boosting(**params)


def forest(params: dict = RF_PARAMS, n_trees: int | None = None, seed: int = 42):
    return RandomForestRegressor(numTrees=n_trees or params["n_estimators"], maxDepth=params["max_depth"],
                                 minInstancesPerNode=params["min_samples_leaf"],
                                 featureSubsetStrategy=str(params["max_features"]), seed=seed)


@dataclass
class Huber:
    """M5: settings of Huber regression; the penalty is ``alpha * |coef|^2`` beside the scaled loss."""
    alpha: float = 1e-4
    epsilon: float = 1.35
    max_iter: int = 100
    tol: float = 1e-8


def huber(params: dict = HUBER_PARAMS, max_iter: int = 100) -> Huber:
    return Huber(params["alpha"], params["epsilon"], max_iter)


def fit_huber(df: DataFrame, label_cols, p: Huber, by: str, features_col: str = "features") -> dict:
    """``{fit: model}``: minimise ``sum(s + H((y - x w - c) / s) s) + alpha |w|^2`` over w, c and the scale s.

    ``H(z)`` is ``z^2`` inside ``epsilon`` and ``2 epsilon |z| - epsilon^2`` outside.  Each pass
    gathers, for all fits and labels, the Gram matrix with weight 1 inside and ``epsilon s / |r|``
    outside, and what the scale needs; then w, c solve the weighted normal
    equations and ``s^2 = (sum of r^2 inside) / (n - epsilon^2 * number outside)``.  The
    objective is convex in (w, c, s) together, and no step raises it.
    """
    fits = grams(df, features_col, label_cols, by)
    k, eps = len(label_cols), p.epsilon
    state = {}
    for fit, st in fits.items():
        n = st["n"]
        for j in range(k):
            full = np.block([[np.array([[n]]), st["sx"][None, :]], [st["sx"][:, None], st["XtX"]]])
            rhs = np.concatenate([[st["sy"][j]], st["XtY"][:, j]])
            w = _penalised(full, rhs, 1e-8 * max(1.0, np.trace(st["XtX"])))
            rss = max(st["YtY"][j, j] - 2 * w @ rhs + w @ full @ w, 0.0)
            state[fit, j] = (w, np.sqrt(rss / n))
    live = set(state)
    for _ in range(p.max_iter):
        now = dict(state)

        def weigh(fit, X, Y):
            for j in range(k):
                w, s = now[fit, j]
                r = np.abs(Y[:, j] - X @ w[1:] - w[0])
                inside = r <= eps * s
                weight = np.where(inside, 1.0, eps * s / np.maximum(r, 1e-300))
                yield weight, np.array([float((r[inside] ** 2).sum()), float((~inside).sum()), float(len(r))])
        sums = _weighted_sums(df, features_col, label_cols, by, weigh)
        for key in list(live):
            tot, (w, s) = sums[key], state[key]
            q = int(round(np.sqrt(len(tot) - 3)))
            m, (square, outside, n) = tot[:-3].reshape(q, q), tot[-3:]
            room = n - eps * eps * outside
            scale = np.sqrt(max(square, 0.0) / room) if room > 0 else s
            new = _penalised(m[:-1, :-1], m[:-1, -1], p.alpha * scale)
            state[key] = (new, scale)
            if abs(scale - s) <= p.tol * max(s, 1e-300) and np.abs(new - w).max() <= p.tol * max(1.0, np.abs(w).max()):
                live.discard(key)
        if not live:
            break
    out = {}
    for fit in fits:
        ws = np.array([state[fit, j][0] for j in range(k)])
        out[fit] = BayesianRidgeModel(ws[:, 1:].T, ws[:, 0], features_col)
        out[fit].scale = np.array([state[fit, j][1] for j in range(k)])
    return out


def _penalised(m: np.ndarray, rhs: np.ndarray, penalty: float) -> np.ndarray:
    """Solve the normal equations with a penalty on all but the intercept; least norm where singular."""
    a = m + np.diag(np.concatenate([[0.0], np.full(len(m) - 1, penalty)]))
    return np.linalg.lstsq(a, rhs, rcond=1e-13)[0]


# ------------------------------------------------------------------ M3, M7-M9

class HorizonModel:
    """M3: one fitted model per target column (or one Bayesian ridge for all)."""

    def __init__(self, name, prep, fitted, targets, horizons):
        self.name, self.prep, self.fitted, self.targets, self.horizons = name, prep, fitted, targets, horizons

    def predict(self, df: DataFrame) -> DataFrame:
        keys = [k for k in KEYS if k in df.columns]
        x = self.prep.transform(df, keep=keys + self.targets)
        if isinstance(self.fitted, BayesianRidgeModel):
            p = x.select(*keys, *self.targets, *self.fitted.predict_cols([f"_p{h}" for h in self.horizons]))
        elif isinstance(self.fitted, BoostedTrees):
            p = self.fitted.with_predictions(x, [f"_p{h}" for h in self.horizons]).select(*keys, *self.targets, *[f"_p{h}" for h in self.horizons])
        else:
            p = x
            for h, m in zip(self.horizons, self.fitted):
                p = m.setPredictionCol(f"_p{h}").transform(p)
            p = p.select(*keys, *self.targets, *[f"_p{h}" for h in self.horizons])
        e = F.array(*[F.struct(F.lit(h).alias("horizon"), F.col(t).cast("double").alias("y_true"),
                               F.col(f"_p{h}").alias("y_pred")) for h, t in zip(self.horizons, self.targets)])
        return (p.select(*keys, F.explode(e).alias("e"))
                 .select(F.lit(self.name).alias("model"), *keys, "e.*"))


def fit_horizons(name: str, estimator, train: DataFrame, roles: dict, targets, horizons,
                 parallel: int = 1) -> HorizonModel:
    """Fit the preprocessor on ``train`` and one estimator per horizon (see ``fit_many``)."""
    return fit_many(name, estimator, train.withColumn(FIT, F.lit(0)), roles, targets, horizons, parallel)[0]


def fit_many(name: str, estimator, train: DataFrame, roles: dict, targets, horizons, parallel: int = 1,
             preps: dict | None = None) -> dict:
    """``{fit: HorizonModel}`` of every value of the column ``_fit``, all in the same jobs.

    ``estimator`` is ``'bayes_ridge'``, a ``Boosting`` or ``Huber`` setting, or a ``pyspark.ml``
    regressor (copied per fit and horizon).  The assembled vectors are cached once;
    rows with a NULL target are dropped (per horizon where horizons are fitted apart)."""
    preps = preps or preprocessors(train, roles)
    x = None
    for fit, prep in preps.items():
        part = prep.transform(train.where(F.col(FIT) == fit), keep=[FIT, *targets])
        x = part if x is None else x.unionByName(part)
    x = x.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        whole = x.where(F.greatest(*[F.col(t).isNull() for t in targets]) == F.lit(False)) if len(targets) > 1 else x.where(F.col(targets[0]).isNotNull())
        if estimator == "bayes_ridge":
            fitted = {}
            for fit, st in grams(whole, "features", targets, FIT).items():
                coef, intercept, _, _ = bayesian_ridge_from_gram(st, **BAYES_DEFAULTS)
                fitted[fit] = BayesianRidgeModel(coef, intercept)
        elif isinstance(estimator, Huber):
            fitted = fit_huber(whole, targets, estimator, FIT)
        elif isinstance(estimator, Boosting):
            fitted = fit_boosters(x, list(targets), estimator, FIT)
        else:
            def one(key):
                fit, t = key
                est = estimator.copy().setLabelCol(t).setFeaturesCol("features")
                return est.fit(x.where((F.col(FIT) == fit) & F.col(t).isNotNull()))
            jobs = [(fit, t) for fit in preps for t in targets]
            with ThreadPoolExecutor(max_workers=max(1, parallel)) as ex:
                got = dict(zip(jobs, ex.map(one, jobs)))
            fitted = {fit: [got[fit, t] for t in targets] for fit in preps}
    finally:
        x.unpersist()
    return {fit: HorizonModel(name, preps[fit], fitted[fit], list(targets), list(horizons)) for fit in preps}


def preprocessors(train: DataFrame, roles: dict) -> dict:
    """``{fit: PreprocessorModel}``, fitted together."""
    return Preprocessor(roles["numeric"], roles["categorical"], roles["text"]).fit_many(train, FIT)


def training_fits(train: DataFrame, folds: DataFrame | None) -> tuple[DataFrame, DataFrame | None]:
    """(training rows with ``_fit``: 0 the whole table, else the fold; validation rows with ``_fit``)."""
    own = train.withColumn(FIT, F.lit(0))
    if folds is None:
        return own, None
    folds = folds.withColumnRenamed("fold", FIT)
    return (own.unionByName(folds.where(F.col("role") == "train").drop("role")),
            folds.where(F.col("role") == "val").drop("role"))


def train_model(name: str, estimator, train: DataFrame, test: DataFrame, roles: dict, targets, horizons,
                folds: DataFrame | None = None, parallel: int = 1, fits=None):
    """M7: CV on the training rows (M8, when ``folds`` is given: the L5 table of
    ``train`` rows with ``fold``/``role``) and the fit on all training rows in one call of
    ``fit_many``, then predictions of train and test.  Returns (model, predictions, metrics)
    where metrics is the long table ``(model, split, fold, horizon, metric, value)`` with split
    in ``cv``/``train``/``test`` (``fold`` 0 outside CV).  ``fits``: rows and preprocessors
    shared by several estimators."""
    rows, val, preps = fits or shared_fits(train, folds, roles)
    models = fit_many(name, estimator, rows, roles, targets, horizons, parallel, preps)
    model, pv = models[0], None
    for f in sorted(set(models) - {0}):
        p = (models[f].predict(val.where(F.col(FIT) == f).drop(FIT).withColumn("split", F.lit("cv"))).withColumn("fold", F.lit(f)))
        pv = p if pv is None else pv.unionByName(p)
    pred = model.predict(train.withColumn("split", F.lit("train"))).unionByName(
        model.predict(test.withColumn("split", F.lit("test"))))
    out = mt.to_long(mt.metrics_by_horizon(pred).drop("n")).withColumn("fold", F.lit(0))
    if pv is not None:
        cv = mt.to_long(mt.metrics_by_horizon(pv, by=("model", "split", "fold")).drop("n"), by=("model", "split", "fold"))
        out = cv.select(*out.columns).unionByName(out)
    return model, pred, out


def shared_fits(train: DataFrame, folds: DataFrame | None, roles: dict):
    """Rows, validation rows and preprocessors of all fits of a training run."""
    rows, val = training_fits(train, folds)
    return rows, val, preprocessors(rows, roles)


def train_multiple_models(estimators: dict, train, test, roles, targets, horizons, folds=None, parallel=1):
    """M9: M7 over a dict of estimators; predictions and metrics unioned."""
    models, preds, mets = {}, None, None
    fits = shared_fits(train, folds, roles)
    for name, est in estimators.items():
        m, p, k = train_model(name, est, train, test, roles, targets, horizons, folds, parallel, fits)
        models[name] = m
        preds = p if preds is None else preds.unionByName(p)
        mets = k if mets is None else mets.unionByName(k)
    return models, preds, mets
