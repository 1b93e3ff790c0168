"""R2-R7 as keyed streaming state: one monitor per series, whatever the number of series.

Log rows ``(series_id, ts, rmse, base_rmse, retrained)`` arrive in any order.  A row
waits in its series' state until the watermark has passed its day, so rows that are late within
the watermark still take their place; later ones are dropped by the engine.  A series
keeps its waiting rows, its last ``SUSTAINED_ROWS`` scored rows, their number and the day of its last
retraining; no state grows with the stream.  Decisions equal those of
``operators.monitor.triggers`` over the whole log, and survive a restart from the
stream's checkpoint.
"""

from __future__ import annotations

from typing import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import BooleanType, DoubleType, LongType, StructField, StructType

from tempora.operators import monitor as mon

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
LOG_SCHEMA = "series_id string, ts date, rmse double, base_rmse double, retrained boolean"
OUTPUT = ("series_id string, ts timestamp, day_index long, degradation double, alert boolean, mean_degradation_30 double, "
          "alert_rate_7 double, last_retrain long, reasons string, should_retrain boolean")
DAY_MS = 86_400_000


class SeriesMonitor(StatefulProcessor):
    """The monitor of one series."""

    def __init__(self, threshold: float = mon.ALERT_THRESHOLD):
        self.threshold = threshold

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        row = StructType([StructField("ms", LongType()), StructField("rmse", DoubleType()), StructField("base", DoubleType()),
                          StructField("retrained", BooleanType())])
        scored = StructType([StructField("degradation", DoubleType()), StructField("alert", BooleanType())])
        count = StructType([StructField("rows", LongType()), StructField("last_retrain", LongType())])
        self.waiting = handle.getListState("waiting", row)
        self.tail = handle.getListState("tail", scored)
        self.count = handle.getValueState("count", count)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        for part in rows:
            for r in part.itertuples(index=False):
                ms = int(r.event_ts.timestamp() * 1000)
                self.waiting.appendValue((ms, _number(r.rmse), _number(r.base_rmse), bool(r.retrained) if r.retrained is not None else False))
                # the day is over when the watermark reaches its end
                self.handle.registerTimer(ms + DAY_MS)
        yield pd.DataFrame()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        done = expiredTimerInfo.getExpiryTimeInMs() - DAY_MS
        waiting = [tuple(r) for r in self.waiting.get()]
        ready = sorted((r for r in waiting if r[0] <= done), key=lambda r: r[0])
        if not ready:
            yield pd.DataFrame()
            return
        rest = [r for r in waiting if r[0] > done]
        if rest:
            self.waiting.put(rest)
        else:
            self.waiting.clear()
        tail = [tuple(r) for r in self.tail.get()]
        rows, last = self.count.get() if self.count.exists() else (0, None)
        out = []
        for ms, rmse, base, retrained in ready:
            rows += 1
            degradation = (rmse - base) / base if rmse is not None and base else None
            alert = degradation is not None and degradation > self.threshold
            tail = (tail + [(degradation, alert)])[-mon.SUSTAINED_ROWS:]
            known = [d for d, _ in tail if d is not None]
            mean = sum(known) / len(known) if known else None
            spike = [a for _, a in tail[-mon.SPIKE_ROWS:]]
            rate = sum(spike) / len(spike)
            reasons = []
            if rows >= mon.MIN_LOG_ROWS:
                if mean is not None and mean > self.threshold:
                    reasons.append("sustained_degradation")
                if rate >= mon.SPIKE_RATE:
                    reasons.append("alert_spike")
                if rows - (last or 0) >= mon.MAINTENANCE_ROWS:
                    reasons.append("scheduled_maintenance")
            out.append((key[0], pd.Timestamp(ms, unit="ms"), rows, degradation, alert, mean, rate, last, ",".join(reasons), bool(reasons)))
            last = rows if retrained else last
        self.tail.put(tail)
        self.count.update((rows, last))
        names = [c.split()[0] for c in OUTPUT.split(", ")]
        frame = pd.DataFrame(out, columns=names)
        yield frame.astype({"last_retrain": "Int64", "degradation": "float64", "mean_degradation_30": "float64"})

    def close(self) -> None:
        pass


def _number(x):
    return None if x is None or x != x else float(x)


def monitored(log: DataFrame, watermark: str = "2 days", threshold: float = mon.ALERT_THRESHOLD) -> DataFrame:
    """Decisions per series of a streaming log; a row per log row, once its day is past the watermark."""
    events = log.withColumn("event_ts", F.col("ts").cast("timestamp")).withWatermark("event_ts", watermark)
    return events.groupBy("series_id").transformWithStateInPandas(
        SeriesMonitor(threshold), outputStructType=OUTPUT, outputMode="Append", timeMode="EventTime")


def start(spark: SparkSession, log_dir: str, out_dir: str, checkpoint_location: str, watermark: str = "2 days",
          max_files: int | None = None):
    """Read log rows from ``log_dir`` (Parquet), append decisions to ``out_dir``; returns the query."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    reader = spark.readStream.schema(LOG_SCHEMA)
    stream = (reader.option("maxFilesPerTrigger", max_files) if max_files else reader).parquet(log_dir)
    return (monitored(stream, watermark).writeStream.format("parquet").option("path", out_dir)
            .option("checkpointLocation", checkpoint_location).outputMode("append").trigger(availableNow=True).start())
