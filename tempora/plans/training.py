"""Daily training job (the reference's Entry 1), Spark-first.

source -> daily features (one blocked window stage) -> valid range (L1) ->
chronological split (L4) -> CV folds on train rows (L5) -> per-horizon fits
(M1-M5, M7-M9) -> mean ensemble (M6) -> per-horizon and macro metrics
(A1-A5) -> leaderboard (A7) -> best model (M10) -> bundle + metadata (S7, S8).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tempora.functions import calendar as cal
from tempora.operators import features as fe
from tempora.operators import learners as ln
from tempora.operators import metrics as mt
from tempora.operators import splits as sp
from tempora.operators.models import best_model, ensemble_mean
from tempora.operators.profile import column_roles
from tempora.sources import files, store

@dataclass
class TrainingResult:
    models: dict
    predictions: DataFrame
    metrics: DataFrame
    per_horizon: DataFrame
    macros: DataFrame
    leaderboard: DataFrame
    best: DataFrame
    train: DataFrame
    test: DataFrame
    roles: dict
    ensemble: dict

    def close(self) -> None:
        """Release the cached predictions."""
        self.predictions.unpersist()


def model_roles(feats: DataFrame, keep_row_id: bool = False) -> dict:
    """P3 roles over the feature columns only (keys, targets and split
    bookkeeping excluded)."""
    return column_roles(feats.select(*fe.feature_columns(feats, keep_row_id)))


def prepare_daily(series: DataFrame, block_rows: int = 100_000, gap: int = sp.GAP_DAILY):
    feats = fe.daily_features(series, block_rows=block_rows, materialize=True)
    # Cut lineage (reliable checkpoint in spark.checkpoint.dir): every fit and
    # score below re-reads this table instead of re-planning ~100 windows.
    s = sp.chronological_split(feats, gap=gap).checkpoint(eager=True)
    train = s.where(F.col("split") == "train").drop("split")
    test = s.where(F.col("split") == "test").drop("split")
    return s, train, test


def run_daily_training(series: DataFrame, estimators: dict, horizons=fe.DAILY_HORIZONS, cv: bool = True,
                       ensemble_members=None, ensemble_name: str = "Ensemble_Final",
                       block_rows: int = 100_000, parallel: int = 5, save_to: str | None = None) -> TrainingResult:
    """Entry 1.  ``save_to`` names a folder on shared storage for the bundle."""
    s, train, test = prepare_daily(series, block_rows)
    roles = model_roles(s)
    targets = [f"target_temp_t+{h}" for h in horizons]
    folds = sp.cv_folds(train) if cv else None
    models, preds, mets = ln.train_multiple_models(estimators, train, test, roles, targets, horizons,
                                                   folds, parallel)
    ensemble = {}
    if ensemble_members:
        ensemble = {ensemble_name: list(ensemble_members)}
        ens = ensemble_mean(preds, ensemble_members, ensemble_name)
        preds = preds.unionByName(ens)
        mets = mets.unionByName(mt.to_long(mt.metrics_by_horizon(ens).drop("n")).withColumn("fold", F.lit(0)))
    preds = preds.persist(StorageLevel.MEMORY_AND_DISK)
    per_h = mt.metrics_by_horizon(preds)
    macros = mt.macro(per_h)
    board = mt.leaderboard(macros)
    best = best_model(macros)
    if save_to:
        spark = series.sparkSession
        name = best.first()["best_model"]
        meta = store.metadata_record(spark, macros, name, train.count(), test.count())
        config = dict(horizons=list(horizons), gap=sp.GAP_DAILY, train_ratio=sp.TRAIN_RATIO, cv_splits=sp.CV_SPLITS if cv else 0)
        store.save_bundle(spark, save_to, models, ensemble, config, roles, mets, board, meta)
    return TrainingResult(models, preds, mets, per_h, macros, board, best, train, test, roles, ensemble)


def serve(raw: DataFrame, path: str, block_rows: int = 100_000) -> DataFrame:
    """M11 from a saved bundle: raw rows -> S5 lists -> C8 fills -> builder (newest rows kept)
    -> C9 -> every member's forecast from the newest row -> ensembles, dated and banded."""
    spark = raw.sparkSession
    bundle = store.load_bundle(spark, path)
    rows = files.fill_serving_columns(files.normalise_lists(raw, all_first=True))
    feats = fe.daily_features(rows, serving=True, block_rows=block_rows)
    newest = files.stringify_objects(feats.where(F.col("row_id") == F.col("n_rows") - 1), keep=("series_id", "ts"))
    preds = None
    for m in bundle["models"].values():
        p = m.predict(newest)
        preds = p if preds is None else preds.unionByName(p)
    for name, members in bundle["ensemble"].items():
        ens = (preds.where(F.col("model").isin(members)).groupBy("series_id", "ts", "row_id", "horizon")
               .agg(F.avg("y_pred").alias("y_pred"), F.count("y_pred").alias("_k")).where(F.col("_k") == len(members)))
        preds = preds.unionByName(ens.select(F.lit(name).alias("model"), "series_id", "ts", "row_id", "horizon",
                                             F.lit(None).cast("double").alias("y_true"), "y_pred"))
    return (preds.withColumn("forecast_date", cal.forecast_date("ts", "horizon")).withColumn("band", cal.temp_band("y_pred"))
                 .select("model", "series_id", F.col("ts").alias("origin_ts"), "horizon", "forecast_date", "y_pred", "band"))
