import os
import tempfile

from pyspark.sql import functions as F

from tempora.operators import monitor as mon
from tempora.operators import windows as wn
from tempora.sources import standins as si
from tempora.streaming import monitor as sm
from conftest import SF


def test_streaming_log_matches_batch(spark):
    d = tempfile.mkdtemp(prefix="tempora-stream-")
    series = si.daily(spark, SF).select("series_id", "ts", "temp")
    n = wn.number_rows(series)
    # persistence forecasts for the next day, issued at every origin
    fc = n.select("series_id", F.date_add("ts", 1).alias("target_ts"), F.lit(1).alias("horizon"),
                  F.col("temp").alias("y_pred"))
    fc = fc.join(n.select("series_id", F.col("ts").alias("target_ts")), ["series_id", "target_ts"])
    # actuals arrive in two files
    series.where("ts < '1998-01-01'").write.parquet(os.path.join(d, "in", "part1"))
    series.where("ts >= '1998-01-01'").write.parquet(os.path.join(d, "in", "part2"))
    q = sm.start(spark, os.path.join(d, "in", "*"), fc, os.path.join(d, "log"), os.path.join(d, "ckpt"))
    q.awaitTermination(300)
    log = sm.read_log(spark, os.path.join(d, "log"), 5.0)
    batch = sm.score_batch(series, fc, 5.0)
    assert log.count() == batch.count() > 0
    cols = ["ts", "rmse", "mae", "degradation", "alert"]
    assert log.select(cols).exceptAll(batch.select(cols)).count() == 0
    t = mon.triggers(log)
    assert t.where("day_index < 30 AND should_retrain").count() == 0


def test_a_day_split_over_batches_is_pooled(spark):
    """Two series of the same days arrive in two files, one file per micro-batch."""
    d = tempfile.mkdtemp(prefix="tempora-stream-")
    series = si.daily_multi(spark, SF).select("series_id", "ts", "temp")
    fc = series.select("series_id", F.col("ts").alias("target_ts"), F.lit(1).alias("horizon"),
                       (F.col("temp") * F.when(F.col("series_id") < "3", 1.0).otherwise(1.5)).alias("y_pred"))
    for k, part in enumerate((series.where("series_id < '3'"), series.where("series_id >= '3'"))):
        part.coalesce(1).write.parquet(os.path.join(d, "in", f"part{k}"))
    q = sm.start(spark, os.path.join(d, "in", "*"), fc, os.path.join(d, "log"), os.path.join(d, "ckpt"), max_files=1)
    q.awaitTermination(300)
    assert len([x for x in os.listdir(os.path.join(d, "log")) if x.startswith("batch_id")]) == 2
    log = {r["ts"]: r["rmse"] for r in sm.read_log(spark, os.path.join(d, "log"), 5.0).collect()}
    batch = {r["ts"]: r["rmse"] for r in sm.score_batch(series, fc, 5.0).collect()}
    assert set(log) == set(batch) and len(log) > 100
    assert all(abs(log[t] - batch[t]) < 1e-9 * max(1, batch[t]) for t in log)


def test_keyed_state_equals_batch_over_a_restart(spark):
    """Late and disordered log rows of several series, a stop and a restart: decisions equal the batch's."""
    import datetime as dt
    import random
    from tempora.streaming import keyed
    g = random.Random(2)
    first = dt.date(2024, 1, 1)
    rows = []
    for s, days in (("a", 240), ("b", 60), ("c", 20)):     # 139 rows follow the retraining of row 101: maintenance is due
        for i in range(days):
            rmse = None if i % 37 == 5 else 1.0 + (0.3 if s == "a" and 40 <= i < 70 else 0.0) + (0.5 if s == "b" and i >= 50 else 0.0) + g.random() * 0.1
            rows.append((s, first + dt.timedelta(days=i), rmse, 1.0, s == "a" and i in (45, 100)))
    d = tempfile.mkdtemp(prefix="tempora-keyed-")
    order = sorted(range(len(rows)), key=lambda k: (rows[k][1] + dt.timedelta(days=g.randrange(2)), g.random()))     # at most a day late
    chunks = [order[k:k + 25] for k in range(0, len(order), 25)]

    def put(n, chunk):
        spark.createDataFrame([rows[k] for k in chunk], keyed.LOG_SCHEMA).coalesce(1).write.parquet(os.path.join(d, "in", f"part{n:03d}"))

    def run():
        q = keyed.start(spark, os.path.join(d, "in", "*"), os.path.join(d, "out"), os.path.join(d, "ckpt"), "3 days", max_files=1)
        q.awaitTermination(600)
        assert q.exception() is None
    half = len(chunks) // 2
    for n, c in enumerate(chunks[:half]):
        put(n, c)
    run()
    for n, c in enumerate(chunks[half:], half):
        put(n, c)
    run()
    put(999, [])
    last = max(r[1] for r in rows)
    got = {(r["series_id"], r["ts"].date()): r for r in spark.read.parquet(os.path.join(d, "out")).collect()}
    log = spark.createDataFrame([r[:4] for r in rows], "series_id string, ts date, rmse double, base_rmse double")
    log = mon.degraded(log, by=("series_id",)).checkpoint()
    events = spark.createDataFrame([(r[0], r[1]) for r in rows if r[4]], "series_id string, ts date").join(log, ["series_id", "ts"])
    want = mon.triggers(log, history=events.select("series_id", "day_index", F.lit(True).alias("adopted"), F.lit(0.0).alias("improvement")), by=("series_id",))
    checked = 0
    for w in want.collect():
        if w["ts"] > last - dt.timedelta(days=5):
            continue
        r = got[w["series_id"], w["ts"]]
        assert (r["day_index"], r["alert"], r["last_retrain"], r["reasons"], r["should_retrain"]) == (
            w["day_index"], w["alert"], w["last_retrain"], w["reasons"], w["should_retrain"]), (w, r)
        for c in ("degradation", "mean_degradation_30", "alert_rate_7"):
            assert (r[c] is None) == (w[c] is None) and (r[c] is None or abs(r[c] - w[c]) < 1e-9)
        checked += 1
    assert checked == 240 - 5 + 60 + 20 and len(got) == checked + len([k for k in got if k[1] > last - dt.timedelta(days=5)])
    assert any("scheduled_maintenance" in r["reasons"] for r in got.values()) and any("alert_spike" in r["reasons"] for r in got.values())
