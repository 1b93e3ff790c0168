"""Serving-side operators: latest rows, forecasts, bands, backtest (W20, W21,
M11, D7-D10, L10).

The reference serves one series from a 5-row-old feature row and dates the
forecast from the newest row; here the forecast is made from the newest row
and dated from it (origin + h), and the backtest joins every origin with the
actual at exactly origin + h.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tempora.functions import calendar as cal
from tempora.operators.splits import tail_rows
from tempora.operators.windows import N_ROWS, ROW_ID, SERIES


def latest_delta(series_numbered: DataFrame, cols=("temp", "humidity"), series: str = SERIES) -> DataFrame:
    """Newest row per series with ``{c}_delta`` = latest - previous row.

    Only the last two rows per series are kept (by position) before they meet
    in one small aggregate, so the input is read once and no window spans a
    series."""
    last2 = tail_rows(series_numbered, 2)
    newest = F.col(ROW_ID) == F.col(N_ROWS) - 1
    row = F.struct(*[F.col(c) for c in series_numbered.columns])
    g = last2.groupBy(F.col(series).alias("_s")).agg(
        F.max(F.when(newest, row)).alias("_last"), *[F.max(F.when(~newest, F.col(c))).alias(f"_p_{c}") for c in cols])
    return g.select("_last.*", *[(F.col(f"_last.{c}") - F.col(f"_p_{c}")).alias(f"{c}_delta") for c in cols])


def last_n(series_numbered: DataFrame, n: int) -> DataFrame:
    """Last ``n`` rows per series."""
    return tail_rows(series_numbered, n)


def forecast_table(latest: DataFrame, pred_cols, series: str = SERIES, ts: str = "ts") -> DataFrame:
    """One newest row per series with prediction columns
    ``pred_cols`` (ordered by horizon) -> long ``(series_id, origin_ts,
    horizon, forecast_date, y_pred, band)``."""
    arr = F.array(*[F.col(c).cast("double") for c in pred_cols])
    p = latest.select(series, F.col(ts).alias("origin_ts"), F.posexplode(arr).alias("_i", "y_pred"))
    p = p.withColumn("horizon", (F.col("_i") + 1).cast("long")).drop("_i")
    return (p.withColumn("forecast_date", cal.forecast_date("origin_ts", "horizon"))
             .withColumn("band", cal.temp_band("y_pred")))


def backtest(forecasts: DataFrame, actuals: DataFrame, period: int, value: str = "temp",
             series: str = SERIES) -> DataFrame:
    """Rolling-origin backtest.  ``forecasts`` holds ``(model, series_id,
    row_id, n_rows, ts, horizon, y_pred)`` made at each origin from earlier rows only
    (causal features); ``actuals`` is the numbered series.  Every origin in the
    last ``period`` rows whose target row exists is joined to the actual at
    ``row_id + horizon`` -- one equi-join, no per-origin loop."""
    a = actuals.select(F.col(series).alias("_s"), F.col(ROW_ID).alias("_tr"), F.col("ts").alias("target_ts"),
                       F.col(value).alias("y_true"))
    f = tail_rows(forecasts, period)
    same = F.col(series).eqNullSafe(F.col("_s")) & (F.col(ROW_ID) + F.col("horizon") == F.col("_tr"))
    return f.join(a, same, "inner").drop("_s", "_tr").withColumnRenamed("ts", "origin_ts")
