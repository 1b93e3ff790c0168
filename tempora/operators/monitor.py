"""Performance monitoring and retraining triggers.

For a fixed champion these are pure window/aggregate queries over the
performance log, which holds one row per scored day (per series with
``by``).  One retrain decision (R9-R11) and the state tables are in
``tempora.plans.monitoring``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tempora.operators.metrics import pooled_by_time

# Fixed values that must equal the reference's configuration.
ALERT_THRESHOLD = 0.15
MIN_LOG_ROWS = 30
SUSTAINED_ROWS = 30
SPIKE_ROWS = 7
SPIKE_RATE = 0.7
MAINTENANCE_ROWS = 90
DASHBOARD_MIN_ROWS = 10
ALERT_RATE_ROWS = 30


def performance_log(pred: DataFrame, base_rmse, threshold: float = ALERT_THRESHOLD,
                    by=(), time_col: str = "ts") -> DataFrame:
    """R2 (+A9): per day RMSE/MAE pooled over horizons (and series),
    ``degradation = (rmse - base)/base``, ``alert = degradation > threshold``,
    ``day_index`` = 1-based log position.  ``base_rmse`` is a number, a Column,
    or a one-row DataFrame with column ``base_rmse``."""
    log = pooled_by_time(pred, by=tuple(by), time_col=time_col).drop("n")
    if isinstance(base_rmse, DataFrame):
        # scalar subquery: evaluated once, no join
        base = base_rmse.select(F.first("base_rmse").alias("base_rmse")).scalar()
    else:
        base = base_rmse if isinstance(base_rmse, Column) else F.lit(float(base_rmse))
    return degraded(log.withColumn("base_rmse", base), threshold, by, time_col)


def degraded(log: DataFrame, threshold: float = ALERT_THRESHOLD, by=(), time_col: str = "ts") -> DataFrame:
    """The rest of R2 for rows with ``rmse`` and ``base_rmse``: degradation, alert, day index."""
    base = F.col("base_rmse")
    log = log.withColumn("degradation", F.when(base != 0, (F.col("rmse") - base) / base))
    log = log.withColumn("alert", F.coalesce(F.col("degradation") > threshold, F.lit(False)))
    w = Window.partitionBy(*by).orderBy(time_col) if by else Window.orderBy(time_col)
    return log.withColumn("day_index", F.row_number().over(w).cast("long"))


def log_window(by=()):
    """Log rows in order: per ``by`` group, else the whole log (one row per day)."""
    return (Window.partitionBy(*by) if by else Window).orderBy("day_index")


def with_last_retrain(log: DataFrame, history: DataFrame | None, by=()) -> DataFrame:
    """Append ``last_retrain``: the day index of the newest retrain event before the row
    (NULL if none).  ``history`` holds one row per event: ``by..., day_index, adopted, improvement``."""
    if history is None:
        return log.withColumn("last_retrain", F.lit(None).cast("long"))
    keys = [*by, "day_index"]
    ev = history.select(*keys).distinct().withColumn("_event", F.col("day_index"))
    w = log_window(by).rowsBetween(Window.unboundedPreceding, -1)
    return (log.join(ev, keys, "left").withColumn("last_retrain", F.last("_event", ignorenulls=True).over(w)).drop("_event"))


def triggers(log: DataFrame, drift: DataFrame | None = None, history: DataFrame | None = None,
             threshold: float = ALERT_THRESHOLD, by=()) -> DataFrame:
    """R3-R7 (W18, W19) evaluated at every log row as if it were the latest.

    t1 mean degradation of the last 30 rows > threshold; t2 alert rate of the
    last 7 rows >= 0.7; t3 drift flag (joined from ``drift`` on ``by`` and ``day_index``
    when given); t4 >= 90 rows since the last retrain event of ``history`` (never
    retrained -> log length >= 90).  Nothing fires before 30 rows.
    """
    w = log_window(by)
    n = F.col("day_index")
    d = (with_last_retrain(log, history, by)
         .withColumn("mean_degradation_30", F.avg("degradation").over(w.rowsBetween(-(SUSTAINED_ROWS - 1), 0)))
         .withColumn("alert_rate_7", F.avg(F.col("alert").cast("double")).over(w.rowsBetween(-(SPIKE_ROWS - 1), 0))))
    if drift is not None:
        keys = [*by, "day_index"]
        d = d.join(drift.select(*keys, F.col("drift").alias("_drift")), keys, "left")
        dr = F.coalesce(F.col("_drift"), F.lit(False))
    else:
        dr = F.lit(False)
    since = n - F.coalesce(F.col("last_retrain"), F.lit(0))
    ok = n >= MIN_LOG_ROWS
    t1 = ok & (F.col("mean_degradation_30") > threshold)
    t2 = ok & (F.col("alert_rate_7") >= SPIKE_RATE)
    t3 = ok & dr
    t4 = ok & (since >= MAINTENANCE_ROWS)
    reasons = F.filter(F.array(F.when(t1, F.lit("sustained_degradation")),
                               F.when(t2, F.lit("alert_spike")),
                               F.when(t3, F.lit("distribution_drift")),
                               F.when(t4, F.lit("scheduled_maintenance"))), lambda x: x.isNotNull())
    d = d.withColumn("reasons", F.array_join(reasons, ",")).withColumn("should_retrain", F.size(reasons) > 0)
    return d.drop("_drift") if drift is not None else d


def alert_rate_rolling(log: DataFrame, rows: int = ALERT_RATE_ROWS, by=()) -> DataFrame:
    """Rolling alert rate x 100 over ``rows`` log rows (full windows only)."""
    w = log_window(by).rowsBetween(-(rows - 1), 0)
    a = F.col("alert").cast("double")
    return log.withColumn("alert_rate_30", F.when(F.count(a).over(w) == rows, F.avg(a).over(w) * 100))


def report(log: DataFrame, history: DataFrame | None = None, by=()) -> DataFrame:
    """Predictions, mean RMSE, mean degradation %, alert rate %, and
    retrain counts (total, adopted, rejected, mean improvement of adopted), over the
    log or per ``by`` group of it.

    Log rows and events are stacked and aggregated once, so a group without events
    needs no outer join."""
    none = F.lit(None)
    parts = log.select(*by, F.lit(1).alias("is_log"), "rmse", "degradation", F.col("alert").cast("double").alias("alert"),
                       none.cast("boolean").alias("adopted"), none.cast("double").alias("improvement"))
    if history is not None:
        parts = parts.unionByName(history.select(*by, F.lit(0).alias("is_log"), none.cast("double").alias("rmse"),
                                                 none.cast("double").alias("degradation"), none.cast("double").alias("alert"),
                                                 "adopted", "improvement"))
    out = parts.groupBy(*by).agg(
        F.sum("is_log").cast("long").alias("n_predictions"), F.avg("rmse").alias("mean_rmse"),
        (F.avg("degradation") * 100).alias("mean_degradation_pct"), (F.avg("alert") * 100).alias("alert_rate_pct"),
        F.count_if(F.col("is_log") == 0).alias("n_retrains"), F.count_if(F.col("adopted")).alias("n_adopted"),
        F.count_if(~F.col("adopted")).alias("n_rejected"),
        F.avg(F.when(F.col("adopted"), F.col("improvement"))).alias("mean_adopted_improvement"))
    return out.where(F.col("n_predictions") > 0) if by else out.withColumn("n_predictions", F.coalesce("n_predictions", F.lit(0)))


def dashboard(log: DataFrame, history: DataFrame | None = None, threshold: float = ALERT_THRESHOLD, by=()) -> DataFrame:
    """Log rows with baseline, retrain markers (``retrain_adopted``: true for an
    adopted event of that day, false for a rejected one), the degradation
    threshold and the rolling alert rate; empty below 10 log rows (per ``by`` group)."""
    d = alert_rate_rolling(log, by=by)
    if history is not None:
        keys = [*by, "day_index"]
        d = d.join(history.groupBy(*keys).agg(F.max("adopted").alias("retrain_adopted")), keys, "left")
    else:
        d = d.withColumn("retrain_adopted", F.lit(None).cast("boolean"))
    # the log's length is the last day index
    n = F.max("day_index").over(Window.partitionBy(*(by or [F.lit(1)])))
    return (d.withColumn("threshold", F.lit(threshold)).withColumn("_n", n).where(F.col("_n") >= DASHBOARD_MIN_ROWS).drop("_n"))
