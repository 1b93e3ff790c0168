"""Structured Streaming form of the performance monitor (extension).

Arriving actuals ``(series_id, ts, temp)`` are read with ``readStream``;
each micro-batch is joined with the stored forecasts ``(series_id, target_ts,
horizon, y_pred)`` and reduced to per-day RMSE/MAE (A9/R2).  The log is
written per batch id into its own folder with overwrite, so a replayed batch
replaces its own output (idempotent sink).  A batch stores sums (squared error,
absolute error, count) per day, and readers add the batches of a day up: a day
whose rows arrive in several batches gets the same log row as in one.  Triggers (R3-R7) are then the batch query ``operators.monitor.triggers``
over the log table.

``daily_means`` is the event-time aggregate with a watermark for late data.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tempora.operators.monitor import ALERT_THRESHOLD

ACTUALS_SCHEMA = T.StructType([T.StructField("series_id", T.StringType()),
                               T.StructField("ts", T.DateType()),
                               T.StructField("temp", T.DoubleType())])


def batch_sums(actuals: DataFrame, forecasts: DataFrame) -> DataFrame:
    """Per day ``ts, sse, sae, n`` of one batch of actuals."""
    a = actuals.select("series_id", F.col("ts").alias("target_ts"), F.col("temp").alias("y_true"))
    j = forecasts.join(a, ["series_id", "target_ts"])
    e = F.col("y_true") - F.col("y_pred")
    return (j.where(e.isNotNull()).groupBy(F.col("target_ts").alias("ts"))
             .agg(F.sum(e * e).alias("sse"), F.sum(F.abs(e)).alias("sae"), F.count(F.lit(1)).alias("n")))


def log_rows(sums: DataFrame, base_rmse: float, threshold: float = ALERT_THRESHOLD) -> DataFrame:
    """Per-day log rows from the sums of any number of batches."""
    base = F.lit(float(base_rmse))
    return (sums.groupBy("ts").agg(F.sqrt(F.sum("sse") / F.sum("n")).alias("rmse"), (F.sum("sae") / F.sum("n")).alias("mae"))
                .withColumn("base_rmse", base)
                .withColumn("degradation", F.when(base != 0, (F.col("rmse") - base) / base))
                .withColumn("alert", F.coalesce(F.col("degradation") > threshold, F.lit(False))))


def score_batch(actuals: DataFrame, forecasts: DataFrame, base_rmse: float,
                threshold: float = ALERT_THRESHOLD) -> DataFrame:
    """Per-day log rows of one set of actuals."""
    return log_rows(batch_sums(actuals, forecasts), base_rmse, threshold)


def start(spark: SparkSession, actuals_dir: str, forecasts: DataFrame, log_dir: str, checkpoint_location: str,
          available_now: bool = True, max_files: int | None = None):
    """Start the monitor; returns the ``StreamingQuery``."""
    reader = spark.readStream.schema(ACTUALS_SCHEMA)
    stream = (reader.option("maxFilesPerTrigger", max_files) if max_files else reader).parquet(actuals_dir)

    def sink(batch: DataFrame, batch_id: int) -> None:
        rows = batch_sums(batch, forecasts)
        rows.write.mode("overwrite").parquet(f"{log_dir}/batch_id={int(batch_id)}")

    w = stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint_location)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="1 minute")
    return w.start()


def read_log(spark: SparkSession, log_dir: str, base_rmse: float, threshold: float = ALERT_THRESHOLD) -> DataFrame:
    """The performance log: all batches of a day added up, with ``day_index``."""
    log = log_rows(spark.read.parquet(log_dir), base_rmse, threshold)
    return log.withColumn("day_index", F.row_number().over(Window.orderBy("ts")).cast("long"))


def daily_means(stream: DataFrame, watermark: str = "2 days") -> DataFrame:
    """Event-time daily mean per series with a watermark (late rows within
    ``watermark`` are counted, later ones dropped by the engine)."""
    return (stream.withColumn("event_ts", F.col("ts").cast("timestamp"))
                  .withWatermark("event_ts", watermark)
                  .groupBy(F.window("event_ts", "1 day"), "series_id")
                  .agg(F.avg("temp").alias("mean_temp"), F.count(F.lit(1)).alias("n")))
