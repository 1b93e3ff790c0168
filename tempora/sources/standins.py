"""Stand-in series built from the driver tables.

The driver tables hold no weather.  These adapters turn them into series
with the reference's column names.  The same definitions exist as SQL text in
``tempora.plans.oracle`` for the DuckDB check; keep the two in step.

* ``daily``       -- ``orders`` per order date, one series (``'_'``).
* ``daily_multi`` -- the same per ``o_orderpriority`` (5 series).
* ``daily_customers`` -- the same per ``o_custkey``.
* ``hourly``      -- ``events`` per hour, one series.
* ``hourly_multi``-- the same per ``event_type``.
* ``hourly_users``-- the same per ``user_id``.

All are grouped aggregates (partial aggregation happens map-side) with one row
per (series, period).  The first two daily and hourly ones are bounded by the
calendar; the number of series of the customer and user ones grows with the
tables.

Measures are integer cents scaled by powers of two, so every value is exact
in binary: window sums and means then come out bit-identical whatever the
summation order, and two engines can be compared value by value.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


# Power-of-two scales (exact in binary floating point).
DAILY_SCALE = float(2 ** 22)
PRECIP_SCALE = float(2 ** 30)
SPREAD_SCALE = float(2 ** 20)
HOURLY_SCALE = float(2 ** 13)
HOURLY_PRECIP_SCALE = float(2 ** 10)
HOURLY_POINT_SCALE = float(2 ** 7)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def daily(spark: SparkSession, sf_dir: str, by: str | None = None) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    cents = F.round(F.col("o_totalprice") * 100).cast("long")
    key = F.col(by) if by else F.lit("_")
    return (o.groupBy(key.alias("series_id"), F.col("o_orderdate").cast("date").alias("ts"))
             .agg((F.sum(cents) / DAILY_SCALE).alias("temp"),
                  (F.max(cents) / DAILY_SCALE).alias("tempmax"),
                  (F.min(cents) / DAILY_SCALE).alias("tempmin"),
                  F.count(F.lit(1)).cast("double").alias("humidity"),
                  (F.sum(cents) / PRECIP_SCALE).alias("precip"),
                  F.when(F.count(F.lit(1)) > 1, (F.max(cents) - F.min(cents)) / SPREAD_SCALE).alias("windspeed"),
                  F.sum(F.when(F.col("o_orderstatus") == "F", 12.5).otherwise(0.0)).alias("cloudcover"),
                  F.sum(F.when(F.col("o_orderpriority") == "1-URGENT", 1.0)).alias("severerisk"),
                  F.min(F.when(F.col("o_orderstatus") == "P", "rain")).alias("preciptype"),
                  F.min("o_orderpriority").alias("conditions"),
                  F.max("o_orderstatus").alias("icon"),
                  # free text, missing on some days
                  F.when(F.count(F.lit(1)) % 7 != 0, F.concat_ws(
                      " ", F.min("o_orderpriority"), F.lit("status"), F.max("o_orderstatus"),
                      F.when(F.count(F.lit(1)) % 2 == 0, F.lit("even day of orders")),
                      F.concat(F.lit("month"), F.month(F.min("o_orderdate")).cast("string")))).alias("description")))


def daily_multi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return daily(spark, sf_dir, by="o_orderpriority")


def daily_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return daily(spark, sf_dir, by="o_custkey").withColumn("series_id", F.col("series_id").cast("string"))


def hourly(spark: SparkSession, sf_dir: str, by: str | None = None) -> DataFrame:
    e = table(spark, sf_dir, "events")
    cents = F.round(F.col("value") * 100).cast("long")
    key = F.col(by) if by else F.lit("_")
    return (e.groupBy(key.alias("series_id"), F.date_trunc("hour", F.col("ts")).alias("ts"))
             .agg((F.sum(cents) / HOURLY_SCALE).alias("temp"),
                  (F.min(cents) / HOURLY_POINT_SCALE).alias("feelslike"),
                  F.count(F.lit(1)).cast("double").alias("humidity"),
                  (F.sum(cents) / HOURLY_PRECIP_SCALE).alias("precip"),
                  (F.max(cents) / HOURLY_POINT_SCALE).alias("windspeed"),
                  F.sum(F.when(F.col("event_type") == "error", 12.5).otherwise(0.0)).alias("cloudcover"),
                  F.sum(F.when(F.col("event_type") == "error", 1.0)).alias("severerisk"),
                  F.min(F.when(F.col("event_type") == "purchase", "rain")).alias("preciptype"),
                  F.min("event_type").alias("conditions"),
                  F.max("event_type").alias("icon")))


def hourly_multi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hourly(spark, sf_dir, by="event_type")


def hourly_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hourly(spark, sf_dir, by="user_id").withColumn("series_id", F.col("series_id").cast("string"))


# ------------------------------------------------------------------ forecasts
# Deterministic forecasts that stand in for fitted models, so every metric and
# monitoring operator can be checked against SQL without a fitted model.
NAIVE_SEASON = 7


def naive_forecasts(series: DataFrame, horizons=(1, 2, 3, 4, 5), season: int = NAIVE_SEASON,
                    valid_lo: int = 30, mode: str = "blocked", block_rows: int = 100_000,
                    ensemble: bool = True) -> DataFrame:
    """Long prediction table ``(model, split, series_id, ts, row_id, horizon,
    y_true, y_pred)`` for ``persist`` (value at t) and ``seasonal7`` (value at
    ``t + h - season``), restricted to the daily valid range (L1) and split
    chronologically (L4); with ``ensemble`` the mean of the two (M6) is added as
    ``ens``."""
    from tempora.operators import windows as wn
    from tempora.operators.splits import chronological_split

    hmax = max(horizons)
    sf = wn.prepare(series.select("series_id", "ts", "temp"), season, hmax,
                    mode=mode, block_rows=block_rows)
    w = sf.w
    t = F.col("temp")
    cols = [F.col(c) for c in sf.df.columns]
    for h in horizons:
        k = season - h
        s = F.lag(t, k).over(w) if k > 0 else (t if k == 0 else F.lead(t, -k).over(w))
        cols += [F.lead(t, h).over(w).alias(f"_y{h}"), s.alias(f"_s{h}")]
    wide = sf.finish(sf.df.select(*cols))
    wide = wide.where((F.col("row_id") >= valid_lo) & (F.col("row_id") < F.col("n_rows") - hmax))
    wide = chronological_split(wide, skip_head=valid_lo, skip_tail=hmax)
    entries = []
    for h in horizons:
        if ensemble:       # both members stand in this row: their mean needs no regrouping
            entries.append(F.when(t.isNotNull() & F.col(f"_s{h}").isNotNull(), F.struct(
                F.lit("ens").alias("model"), F.lit(h).alias("horizon"), F.col(f"_y{h}").alias("y_true"),
                ((t + F.col(f"_s{h}")) / 2).alias("y_pred"))))
        entries += [F.struct(F.lit("persist").alias("model"), F.lit(h).alias("horizon"),
                             F.col(f"_y{h}").alias("y_true"), t.alias("y_pred")),
                    F.struct(F.lit("seasonal7").alias("model"), F.lit(h).alias("horizon"),
                             F.col(f"_y{h}").alias("y_true"), F.col(f"_s{h}").alias("y_pred"))]
    kept = F.filter(F.array(*entries), lambda e: e.isNotNull())
    return (wide.select("split", "series_id", "ts", "row_id", "pos", "n_train", F.explode(kept).alias("e"))
                .select(F.col("e.model").alias("model"), "split", "series_id", "ts", "row_id",
                        "pos", "n_train", F.col("e.horizon").alias("horizon"), F.col("e.y_true").alias("y_true"),
                        F.col("e.y_pred").alias("y_pred")))
