"""Adaptive retraining (the reference's Entry 3): state tables and one decision.

The performance log, the retrain events and the drift flags are tables; every
trigger is a query over them (``operators.monitor``).  ``initialise`` writes
the state of a fresh champion (R1), ``champion_challenger`` makes one retrain
decision (R9-R11) and ``record`` appends its event, so a scheduler that runs
once per day calls: score the day, append the log, evaluate the triggers, decide.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tempora.operators import drift as dr
from tempora.operators import learners as ln
from tempora.operators import splits as sp
from tempora.sources import store

DAY = "day_index"
EVENT = "day_index long, adopted boolean, champion_rmse double, challenger_rmse double, improvement double"
LOG = "ts date, rmse double, mae double, base_rmse double, degradation double, alert boolean, day_index long"


def pooled_rmse(pred: DataFrame) -> DataFrame:
    e = F.col("y_true") - F.col("y_pred")
    return pred.agg(F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(F.abs(e)).alias("mae"))


def initialise(spark: SparkSession, champion: ln.HorizonModel, train: DataFrame, path: str) -> None:
    """Write the champion bundle, its baseline (pooled error on its training rows) and
    empty log and event tables under ``path``."""
    store.save_model(spark, champion, f"{path}/champion")
    pooled_rmse(champion.predict(train)).write.mode("overwrite").parquet(f"{path}/baseline")
    spark.createDataFrame([], LOG).write.mode("overwrite").parquet(f"{path}/log")
    spark.createDataFrame([], EVENT).write.mode("overwrite").parquet(f"{path}/events")


def record(event: DataFrame, path: str) -> None:
    """Append a retrain event to the state tables."""
    event.write.mode("append").parquet(f"{path}/events")


def state(spark: SparkSession, path: str) -> dict:
    """The state tables: champion model, baseline, log and events."""
    return {"champion": store.load_model(spark, f"{path}/champion"), **{
        name: spark.read.parquet(f"{path}/{name}") for name in ("baseline", "log", "events")}}


def champion_challenger(champion: ln.HorizonModel, estimator, history: DataFrame, roles, targets, horizons,
                        day_index: int, retrain_window: int = sp.RETRAIN_WINDOW,
                        validation_window: int = sp.VALIDATION_WINDOW, latest: bool = False, end=None):
    """R9-R11 on the rolling training set ``history``.

    Fit a challenger on the retrain slice, compare pooled RMSE of both models
    on the validation slice, adopt when strictly lower; ``end`` is one past the last
    ``row_id`` of each series in ``history`` (the series length if not given).  Without validation
    rows the challenger is adopted and the event has NULL RMSEs (R10).
    After adoption the baseline RMSE/MAE come from the challenger on its own
    retrain slice (R11).  Returns (one-row event DataFrame, state dict with
    ``model`` and ``baseline``)."""
    spark = history.sparkSession
    sl = sp.retrain_slices(history, retrain_window, validation_window, latest, end)
    retrain = sl.where(F.col("slice") == "retrain").drop("slice")
    val = sl.where(F.col("slice") == "validation").drop("slice")
    challenger = ln.fit_horizons("challenger", estimator, retrain, roles, targets, horizons)
    has_val = not val.isEmpty()
    ch_rmse = cl_rmse = None
    if has_val:
        both = (champion.predict(val).withColumn("who", F.lit("champion"))
                .unionByName(challenger.predict(val).withColumn("who", F.lit("challenger"))))
        e = F.col("y_true") - F.col("y_pred")
        got = {r["who"]: r["rmse"] for r in both.groupBy("who").agg(F.sqrt(F.avg(e * e)).alias("rmse")).collect()}
        ch_rmse, cl_rmse = got.get("champion"), got.get("challenger")
        adopted = cl_rmse is not None and ch_rmse is not None and cl_rmse < ch_rmse
    else:
        adopted = True
    improvement = ((ch_rmse - cl_rmse) / ch_rmse * 100) if (has_val and ch_rmse) else None
    baseline = None
    if adopted:
        b = pooled_rmse(challenger.predict(retrain)).first()
        baseline = {"rmse": b["rmse"], "mae": b["mae"]}
    ev = spark.createDataFrame([(int(day_index), bool(adopted), ch_rmse, cl_rmse, improvement)],
                               "day_index long, adopted boolean, champion_rmse double, "
                               "challenger_rmse double, improvement double")
    return ev, {"model": challenger if adopted else champion, "baseline": baseline}


def ks_by_day(baseline: DataFrame, stream: DataFrame, cols, by=("series_id",), recent: int = sp.DRIFT_BASELINE_ROWS,
              order: str = "row_id", day: str = DAY) -> DataFrame:
    """R8 statistics for every scored day at once: ``by..., day_index, column_name, n_base, n_recent, k_stat, rows``.

    ``baseline``: the fixed first rows (keys and ``cols``); ``stream``: the rolling set in
    ``order``, with ``day`` set on scored rows.  The sample of a day is the
    ``recent`` rows before it; ``rows`` counts those that came before.  The largest gap of two step functions lies at (or
    just before) a value of the recent sample, so the baseline's distribution
    is looked up once per stream value (``drift.running_counts``, ranges of values, no series in
    one task); it is not copied per day.  Only a stream row's small (column, value,
    two counts) record is copied to the ``recent`` days that use it, and a day's
    sample is all that one window sees.
    """
    keys = [*by, "column_name"]
    base = dr.unpivot(baseline, list(by), cols).withColumns({"_pos": F.lit(None).cast("long"), "_base": F.lit(True)})
    rows = dr.unpivot(stream.withColumn("_pos", F.col(order).cast("long")), [*by, "_pos"], cols).withColumn("_base", F.lit(False))
    seen = (dr.running_counts(base.unionByName(rows), keys, "value", "_base").withColumnRenamed("n_all", "n_base")
              .where(~F.col("_base") & (F.col("n_base") > 0)))
    days = stream.where(F.col(day).isNotNull()).select(*by, F.col(order).alias("_day_pos"), F.col(day).alias("_day"))
    used = (seen.withColumn("_day_pos", F.explode(F.sequence(F.col("_pos") + 1, F.col("_pos") + recent)))
                .join(days, [*by, "_day_pos"]))
    g = Window.partitionBy(*by, "_day", "column_name")
    upto = g.orderBy("value").rangeBetween(Window.unboundedPreceding, 0)
    q = (used.withColumn("n_recent", F.count(F.lit(1)).over(g)).withColumn("_ge", F.count(F.lit(1)).over(upto))
             .withColumn("_eq", F.count(F.lit(1)).over(Window.partitionBy(*by, "_day", "column_name", "value"))))
    gap = F.greatest(F.abs(F.col("n_le") * F.col("n_recent") - F.col("_ge") * F.col("n_base")),
                     F.abs(F.col("n_lt") * F.col("n_recent") - (F.col("_ge") - F.col("_eq")) * F.col("n_base")))
    return (q.groupBy(*by, F.col("_day").alias(day), "column_name")
             .agg(F.first("n_base").alias("n_base"), F.first("n_recent").alias("n_recent"), F.max(gap).alias("k_stat"), F.max("_day_pos").alias("rows")))


def drift_by_day(baseline: DataFrame, stream: DataFrame, cols, by=("series_id",), recent: int = sp.DRIFT_BASELINE_ROWS,
                 min_rows: int = dr.DRIFT_MIN_TRAIN_ROWS, order: str = "row_id", day: str = DAY) -> DataFrame:
    """R8 for every scored day at once: ``by..., day_index, n_drifted, n_tested, drift``."""
    st = dr.with_pvalue(ks_by_day(baseline, stream, cols, by, recent, order, day))
    return (st.groupBy(*by, day)
              .agg(F.count(F.when(F.col("p_value") < dr.KS_ALPHA, 1)).alias("n_drifted"), F.count(F.lit(1)).alias("n_tested"),
                   F.max("rows").alias("_rows"))
              .withColumn("drift", (F.col("n_drifted") >= dr.MIN_DRIFTED) & (F.col("_rows") >= min_rows)).drop("_rows"))
