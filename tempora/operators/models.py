"""Model-level operators on the long prediction table (M6, M10) and the
per-horizon fitting jobs (M1-M5, M7-M9, M11) in ``tempora.operators.learners``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PRED_KEYS = ["split", "series_id", "ts", "row_id", "horizon"]


def ensemble_mean(pred: DataFrame, members, name: str = "ensemble") -> DataFrame:
    """M6: mean of the members' forecasts per (split, series, ts, horizon).

    A grouped aggregate (map-side partial), one output row per key."""
    keys = [k for k in PRED_KEYS if k in pred.columns]
    return (pred.where(F.col("model").isin(list(members)))
                .groupBy(*keys)
                .agg(F.first("y_true", ignorenulls=True).alias("y_true"),
                     F.avg("y_pred").alias("y_pred"),
                     F.count("y_pred").alias("_k"))
                .where(F.col("_k") == len(list(members)))
                .drop("_k")
                .withColumn("model", F.lit(name))
                .select("model", *keys, "y_true", "y_pred"))


def best_model(macros: DataFrame, split: str = "test", metric: str = "rmse_macro") -> DataFrame:
    """Model with the lowest test RMSE macro (ties: smallest name)."""
    m = macros.where(F.col("split") == split)
    return m.agg(F.min_by(F.col("model"), F.struct(F.col(metric), F.col("model"))).alias("best_model"),
                 F.min(metric).alias(metric))
