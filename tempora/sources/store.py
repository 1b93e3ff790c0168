"""Model bundle persistence.

A bundle is a directory: the fitted preprocessor state, one sub-directory per
horizon model (``pyspark.ml`` writers, or the Bayesian-ridge coefficients as
a parquet table), the metrics table and a one-row metadata JSON.  Paths are
on the shared file system the cluster writes to.
"""

from __future__ import annotations

import json

from pyspark.ml.regression import RandomForestRegressionModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tempora.operators.boosting import BoostedTrees
from tempora.operators.learners import BayesianRidgeModel, HorizonModel
from tempora.operators.preprocess import PreprocessorModel

_LOADERS = {"RandomForestRegressionModel": RandomForestRegressionModel}


def save_model(spark: SparkSession, model: HorizonModel, path: str) -> None:
    """Write a per-horizon model bundle."""
    model.prep.save(f"{path}/preprocessor", spark)
    meta = dict(name=model.name, targets=model.targets, horizons=model.horizons)
    if isinstance(model.fitted, BayesianRidgeModel):
        meta["kind"] = "bayes_ridge"
        rows = [(j, float(model.fitted.intercept[j]), [float(v) for v in model.fitted.coef[:, j]])
                for j in range(len(model.targets))]
        spark.createDataFrame(rows, "target int, intercept double, coef array<double>").coalesce(1) \
             .write.mode("overwrite").parquet(f"{path}/bayes_ridge")
    elif isinstance(model.fitted, BoostedTrees):
        meta["kind"] = "boosted_trees"
        model.fitted.save(f"{path}/boosted_trees", spark)
    else:
        meta["kind"] = [type(m).__name__ for m in model.fitted]
        for h, m in zip(model.horizons, model.fitted):
            m.write().overwrite().save(f"{path}/h{h}")
    spark.createDataFrame([(json.dumps(meta),)], "meta string").coalesce(1).write.mode("overwrite").json(f"{path}/meta")


def load_model(spark: SparkSession, path: str) -> HorizonModel:
    """Read a bundle written by :func:`save_model`."""
    meta = json.loads(spark.read.json(f"{path}/meta").first()["meta"])
    prep = PreprocessorModel.load(f"{path}/preprocessor", spark)
    if meta["kind"] == "bayes_ridge":
        import numpy as np
        rows = spark.read.parquet(f"{path}/bayes_ridge").orderBy("target").collect()   # one row per horizon
        fitted = BayesianRidgeModel(np.array([r["coef"] for r in rows]).T, np.array([r["intercept"] for r in rows]))
    elif meta["kind"] == "boosted_trees":
        fitted = BoostedTrees.load(f"{path}/boosted_trees", spark)
    else:
        fitted = [_LOADERS[k].load(f"{path}/h{h}") for k, h in zip(meta["kind"], meta["horizons"])]
    return HorizonModel(meta["name"], prep, fitted, meta["targets"], meta["horizons"])


def save_bundle(spark: SparkSession, path: str, models: dict, ensemble: dict, config: dict, roles: dict,
                metrics: DataFrame, leaderboard: DataFrame, metadata: DataFrame) -> None:
    """Everything a serving job needs under one path: each member model, the ensemble's
    definition (name -> members), the training configuration, the column roles, the long
    metrics table, the leaderboard and the metadata record (written last)."""
    for name, m in models.items():
        save_model(spark, m, f"{path}/models/{name}")
    info = dict(models=sorted(models), ensemble=ensemble, config=config, roles=roles)
    spark.createDataFrame([(json.dumps(info),)], "info string").coalesce(1).write.mode("overwrite").json(f"{path}/info")
    save_metrics(metrics, f"{path}/metrics")
    leaderboard.write.mode("overwrite").parquet(f"{path}/leaderboard")
    write_metadata(metadata, f"{path}/metadata")


def load_bundle(spark: SparkSession, path: str) -> dict:
    """``models``, ``ensemble``, ``config`` and ``roles`` of a saved bundle."""
    info = json.loads(spark.read.json(f"{path}/info").first()["info"])
    return {**info, "models": {name: load_model(spark, f"{path}/models/{name}") for name in info["models"]}}


def save_metrics(metrics: DataFrame, path: str) -> None:
    """The long metrics table as parquet."""
    metrics.write.mode("overwrite").parquet(path)


def metadata_record(spark: SparkSession, macros: DataFrame, best: str, train_rows: int, test_rows: int) -> DataFrame:
    """best_model, test_rmse/mae/r2, train_date, train/test samples."""
    m = macros.where((F.col("model") == best) & (F.col("split") == "test"))
    return m.select(F.lit(best).alias("best_model"), F.col("rmse_macro").alias("test_rmse"),
                    F.col("mae_macro").alias("test_mae"), F.col("r2_macro").alias("test_r2"),
                    F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss").alias("train_date"),
                    F.lit(int(train_rows)).cast("long").alias("train_samples"),
                    F.lit(int(test_rows)).cast("long").alias("test_samples"))


def write_metadata(meta: DataFrame, path: str) -> None:
    meta.coalesce(1).write.mode("overwrite").json(path)
