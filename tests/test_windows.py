import datetime as dt
import math

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from tempora.operators import features as fe
from tempora.operators import windows as wn
from tempora.sources import standins as si
from conftest import SF


def _daily(spark, n, series="a", start=dt.date(2024, 1, 1), temps=None, step=1):
    temps = temps if temps is not None else [float(i) for i in range(n)]
    rows = [(series, start + dt.timedelta(days=i * step), t, 50.0 + i, 0.5 * i, 3.0, 40.0)
            for i, t in enumerate(temps)]
    return spark.createDataFrame(rows, "series_id string, ts date, temp double, humidity double, "
                                       "precip double, windspeed double, cloudcover double")


def test_blocked_equals_plain_daily(spark):
    d = si.daily_multi(spark, SF)
    a = fe.daily_features(d, mode="blocked", block_rows=40, with_sequences=True, valid_only=False)
    b = fe.daily_features(d, mode="plain", with_sequences=True, valid_only=False)
    cols = [c for c in b.columns]
    assert a.count() == b.count()
    assert a.select(cols).exceptAll(b.select(cols)).count() == 0


def test_blocked_equals_plain_hourly(spark):
    h = si.hourly(spark, SF)
    a = fe.hourly_features(h, mode="blocked", block_rows=150, valid_only=False)
    b = fe.hourly_features(h, mode="plain", valid_only=False)
    assert a.exceptAll(b.select(a.columns)).count() == 0


def test_row_numbers_distributed(spark):
    d = si.daily(spark, SF)
    a = wn.number_rows(d, mode="blocked", bucket_unit="month").select("ts", "row_id", "n_rows")
    b = wn.number_rows(d, mode="plain").select("ts", F.col("row_id").cast("long"), "n_rows")
    assert a.exceptAll(b).count() == 0


def test_two_series_isolation_and_valid_range(spark):
    a = _daily(spark, 40, "long")
    b = _daily(spark, 25, "short", temps=[100.0 + i for i in range(25)])
    f = fe.daily_features(a.unionByName(b), block_rows=30)
    got = {r["series_id"]: r["c"] for r in f.groupBy("series_id").agg(F.count("*").alias("c")).collect()}
    assert got == {"long": 40 - 30 - 5}       # 25 rows < 30 + 5: rejected
    allrows = fe.daily_features(a.unionByName(b), valid_only=False, block_rows=30)
    r = allrows.where((F.col("series_id") == "short") & (F.col("row_id") == 0)).first()
    assert r["temp_lag_1"] is None            # no leak from the other series


def test_null_inside_window(spark):
    temps = [1.0, 2.0, None, 4.0, 5.0, 6.0, 7.0, 8.0, 9.0, 10.0]
    f = fe.daily_features(_daily(spark, 10, temps=temps), valid_only=False).orderBy("row_id").collect()
    # full window (daily, current row included): NULL while the NULL is inside
    assert f[3]["temp_rollmean_3"] is None and f[4]["temp_rollmean_3"] is None
    assert f[5]["temp_rollmean_3"] == 5.0
    # pandas reference
    s = pd.Series(temps, dtype="float64")
    exp = s.rolling(3).mean()
    for i in range(10):
        g = f[i]["temp_rollmean_3"]
        assert (g is None and math.isnan(exp[i])) or abs(g - exp[i]) < 1e-12


def test_shifted_rolling_min_periods_and_single_std(spark):
    rows = [("h", dt.datetime(2024, 1, 1) + dt.timedelta(hours=i), float(i), 1.0, 1.0, 1.0, 1.0)
            for i in range(30)]
    df = spark.createDataFrame(rows, "series_id string, ts timestamp_ntz, temp double, humidity double, "
                                     "precip double, windspeed double, cloudcover double")
    f = fe.hourly_features(df, lags=[1, 2], windows=[3, 6], target_days=1, block_len=4,
                           valid_only=False, drop_leakage=False).orderBy("row_id").collect()
    assert f[0]["temp_lag1_rollmean_3"] is None        # empty frame
    assert f[1]["temp_lag1_rollmean_3"] == 0.0         # min_periods=1
    assert f[1]["temp_lag1_rollstd_3"] is None         # one value: no sample std
    s = pd.Series([float(i) for i in range(30)]).shift(1)
    exp = s.rolling(6, min_periods=1).std()
    for i in range(2, 30):
        assert abs(f[i]["temp_lag1_rollstd_6"] - exp[i]) < 1e-9
    # forward block of 4 rows [t+1, t+4]: max = t+4, min = t+1; last rows NULL
    assert f[0]["target_daily_max_day_1"] == 4.0 and f[0]["target_daily_min_day_1"] == 1.0
    assert f[0]["target_avg_day_1"] == 2.5
    assert f[26]["target_daily_max_day_1"] is None


def test_calendar_edges(spark):
    days = [dt.date(2024, 1, 1), dt.date(2024, 2, 29), dt.date(2024, 12, 31), dt.date(2025, 1, 4),
            dt.date(2025, 1, 5)]
    rows = [("c", d, 1.0, 1.0, 1.0, 1.0, 1.0) for d in days]
    df = spark.createDataFrame(rows, "series_id string, ts date, temp double, humidity double, "
                                     "precip double, windspeed double, cloudcover double")
    f = {r["ts"]: r for r in fe.daily_features(df, valid_only=False).collect()}
    assert f[dt.date(2024, 1, 1)]["day_of_week"] == 0 and f[dt.date(2024, 1, 1)]["day_of_year"] == 1
    assert f[dt.date(2024, 2, 29)]["day_of_year"] == 60
    assert f[dt.date(2024, 12, 31)]["day_of_year"] == 366
    assert abs(f[dt.date(2024, 12, 31)]["sin_day_of_year"] - math.sin(2 * math.pi * 366 / 366)) < 1e-12
    assert f[dt.date(2025, 1, 4)]["day_of_week"] == 5 and f[dt.date(2025, 1, 5)]["day_of_week"] == 6


def test_gap_days_count_rows(spark):
    f = fe.daily_features(_daily(spark, 12, step=3), valid_only=False).orderBy("row_id").collect()
    assert f[1]["temp_lag_1"] == 0.0            # previous row, 3 days earlier
    assert f[7]["temp_diff_7"] == 7.0


def test_sequences_keep_nulls(spark):
    temps = [float(i) for i in range(40)]
    temps[20] = None
    f = fe.daily_features(_daily(spark, 40, temps=temps), seq_len=30, with_sequences=True,
                          valid_only=False).where("row_id = 35").first()
    assert len(f["seq_x"]) == 30 and f["seq_x"][-16][0] is None
    assert f["seq_y"][0] == 36.0


def test_leakage_drop():
    cols = ["temp", "feelslike", "tempmax", "temp_lag_1", "temp_lag1_rollmean_3", "target_avg_day_1"]
    assert fe.leakage_columns(cols) == ["temp", "tempmax"]
