"""Daily and hourly supervised-dataset builders.

One window spec per builder, so Spark evaluates every lag, rolling frame and
target after a single Exchange + Sort on the series key (``plain``) or on
``(series, block)`` (``blocked``, see ``operators.windows``).

Row semantics follow the reference exactly:
* lags / leads count rows, missing days are not filled;
* daily rolling frames include the current row and need the full window
  (``rolling(N)``) -> guarded with ``count == N``;
* hourly rolling frames are shifted by one row and use ``min_periods=1``;
* hourly targets are 24-row forward blocks, full windows only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tempora.functions import calendar as cal
from tempora.operators import splits as sp
from tempora.operators import windows as wn
from tempora.operators.windows import N_ROWS, ROW_ID, SERIES, TS

# Fixed values that must equal the reference's configuration.
DAILY_HORIZONS = [1, 2, 3, 4, 5]
DAILY_LAGS = [1, 2, 3, 7, 14]
DAILY_WINDOWS = [3, 7, 14]
DAILY_SEQUENCE_LENGTH = 30
HOURLY_HORIZONS = [1, 2, 3, 6, 12, 18, 24, 48, 72, 96, 120]
HOURLY_LAGS = [1, 2, 3, 6, 12, 18, 24, 48, 96, 120, 144]
HOURLY_WINDOWS = [3, 6, 12, 18, 24, 48, 72, 96, 120, 144]
HOURLY_TARGET_DAYS = 5
HOURS_PER_DAY = 24

DAILY_BASE = ['temp', 'tempmax', 'tempmin', 'feelslikemax', 'feelslikemin', 'feelslike',
              'humidity', 'dew', 'precip', 'precipprob', 'precipcover', 'windgust',
              'windspeed', 'windspeedmax', 'windspeedmean', 'windspeedmin', 'winddir',
              'sealevelpressure', 'cloudcover', 'visibility', 'solarradiation',
              'uvindex', 'severerisk', 'moonphase']
HOURLY_BASE = ['feelslike', 'humidity', 'dew', 'precip', 'precipprob',
               'precipcover', 'windgust', 'windspeed', 'winddir', 'sealevelpressure',
               'cloudcover', 'visibility', 'solarradiation', 'solarenergy',
               'uvindex', 'severerisk']
DAILY_TEXT = ['description', 'conditions', 'icon']
HOURLY_TEXT = ['conditions', 'icon']
CONSTANT_COLS = ['name', 'address', 'resolvedAddress', 'latitude', 'longitude', 'source']


def clean(df: DataFrame, text_cols) -> DataFrame:
    """Text NULL -> '', preciptype NULL -> 'none', severerisk NULL -> 0.0;
    NaN -> NULL for doubles."""
    df = wn.nan_to_null(df)
    fills = {c: F.coalesce(F.col(c).cast("string"), F.lit("")) for c in text_cols if c in df.columns}
    if "preciptype" in df.columns:
        fills["preciptype"] = F.coalesce(F.col("preciptype"), F.lit("none"))
    if "severerisk" in df.columns:
        fills["severerisk"] = F.coalesce(F.col("severerisk").cast("double"), F.lit(0.0))
    return df.withColumns(fills) if fills else df


def _present(df: DataFrame, cols) -> list[str]:
    return [c for c in cols if c in df.columns]


def daily_features(df: DataFrame, horizons=DAILY_HORIZONS, lags=DAILY_LAGS,
                   windows=DAILY_WINDOWS, seq_len: int = DAILY_SEQUENCE_LENGTH, *,
                   mode: str = "blocked", block_rows: int = 100_000,
                   valid_only: bool = True, serving: bool = False,
                   with_sequences: bool = False, materialize: bool = False) -> DataFrame:
    """Daily builder.  Input: ``series_id``, ``ts`` (date or date string) and
    raw weather columns; ``temp``, ``humidity``, ``precip``, ``windspeed`` and
    ``cloudcover`` are required.

    ``valid_only`` applies L1 (``max(max(lags), seq_len) <= row_id < n - max(h)``);
    ``serving`` keeps the newest rows (no target cut) for forecasting.
    Output: keys, ``row_id``, ``n_rows``, cleaned raw columns, calendar,
    ``temp_diff_*``, ``{c}_lag_{k}``, rolling columns, ``target_temp_t+{h}``
    (and ``seq_x``/``seq_y`` with ``with_sequences``).
    """
    df = df.withColumn(TS, F.to_date(F.col(TS)))
    df = clean(df, DAILY_TEXT)
    extra: dict[str, Column] = {}
    if "sunrise" in df.columns and "sunset" in df.columns:
        sr, ss = F.to_timestamp_ntz(F.col("sunrise").cast("string")), F.to_timestamp_ntz(F.col("sunset").cast("string"))
        extra.update(sunrise_minutes=cal.minutes_of_day(sr), sunset_minutes=cal.minutes_of_day(ss),
                     day_length_minutes=cal.minutes_between(sr, ss))
    extra.update(cal.calendar_columns(TS))
    df = df.withColumns(extra).withColumns(cal.cyclical_columns())
    df = df.drop(*CONSTANT_COLS)
    base = _present(df, DAILY_BASE)
    halo_back = max(max(lags), max(windows) - 1, seq_len - 1, 7)
    halo_fwd = max(horizons)
    sf = wn.prepare(df, halo_back, halo_fwd, mode=mode, block_rows=block_rows, materialize=materialize)
    w = sf.w
    temp = F.col("temp")
    cols: list[Column] = [F.col(c) for c in sf.df.columns]
    cols += [(temp - F.lag(temp, 1).over(w)).alias("temp_diff_1"),
             (temp - F.lag(temp, 7).over(w)).alias("temp_diff_7")]
    cols += wn.lag_bank(base, lags, w)
    for n in windows:
        f = sf.rows(-(n - 1), 0)
        roll = {f"temp_rollmean_{n}": wn.full(F.avg(temp), temp, f, n),
                f"temp_rollstd_{n}": wn.full(F.stddev_samp(temp), temp, f, n),
                f"humidity_rollmean_{n}": wn.full(F.avg("humidity"), F.col("humidity"), f, n),
                f"precip_rollsum_{n}": wn.full(F.sum("precip"), F.col("precip"), f, n),
                f"windspeed_rollmean_{n}": wn.full(F.avg("windspeed"), F.col("windspeed"), f, n),
                f"cloudcover_rollmean_{n}": wn.full(F.avg("cloudcover"), F.col("cloudcover"), f, n)}
        cols += [v.alias(k) for k, v in roll.items()]
    cols += [F.lead(temp, int(h)).over(w).alias(f"target_temp_t+{h}") for h in horizons]
    if with_sequences:
        cols += sequence_columns(base, sf, seq_len, horizons)
    out = sf.finish(sf.df.select(*cols)).drop("sunrise", "sunset")
    if with_sequences:
        out = out.where(F.size("seq_x") == seq_len)              # L3
    if valid_only or serving:
        lo = max(max(lags), seq_len)
        cond = F.col(ROW_ID) >= lo
        if not serving:
            cond = cond & (F.col(ROW_ID) < F.col(N_ROWS) - max(horizons))
        out = out.where(cond)
        if not serving:
            out = sp.with_positions(out, lo, max(horizons))
    return out


def sequence_columns(base, sf: wn.SeriesFrame, seq_len: int, horizons) -> list[Column]:
    """Trailing ``seq_len`` x k matrix and the future target vector.

    ``array(base)`` is wrapped so NULL cells stay in place (bare
    ``collect_list`` drops NULLs)."""
    f = sf.rows(-(seq_len - 1), 0)
    x = F.collect_list(F.array(*[F.col(c).cast("double") for c in base])).over(f)
    y = F.array(*[F.lead("temp", int(h)).over(sf.w).cast("double") for h in horizons])
    return [x.alias("seq_x"), y.alias("seq_y")]


def hourly_features(df: DataFrame, lags=HOURLY_LAGS, windows=HOURLY_WINDOWS,
                    target_days: int = HOURLY_TARGET_DAYS, block_len: int = HOURS_PER_DAY, *,
                    mode: str = "blocked", block_rows: int = 100_000,
                    valid_only: bool = True, drop_leakage: bool = True,
                    materialize: bool = False) -> DataFrame:
    """Hourly builder.

    Targets: for d in 1..target_days, max/min of rows
    ``[t + block_len*(d-1) + 1, t + block_len*d]`` (full blocks only) and their
    mid-range ``target_avg_day_{d}``.  Rolling features are shifted by one row
    and use ``min_periods=1``.  With ``drop_leakage`` (C7) ``temp`` and every
    other column whose name contains ``temp`` but neither ``lag`` nor
    ``roll`` is removed (``feelslike`` survives).
    """
    df = df.withColumn(TS, F.to_timestamp_ntz(F.col(TS).cast("string")))
    df = clean(df, HOURLY_TEXT)
    df = df.withColumns(cal.calendar_columns(TS, weekend=True))
    if "hour" not in df.columns:
        df = df.withColumn("hour", F.hour(TS))
    df = df.withColumns(cal.cyclical_columns(hour=True))
    base = _present(df, HOURLY_BASE)
    horizon_rows = block_len * target_days
    halo_back = max(max(lags), max(windows))
    sf = wn.prepare(df, halo_back, horizon_rows, mode=mode, block_rows=block_rows, materialize=materialize)
    w = sf.w
    temp = F.col("temp")
    cols: list[Column] = [F.col(c) for c in sf.df.columns]
    cols += wn.lag_bank(base, lags, w)
    cols += wn.lag_bank(["temp"], lags, w)
    for n in windows:
        f = sf.rows(-n, -1)
        cols += [F.avg(temp).over(f).alias(f"temp_lag1_rollmean_{n}"),
                 F.stddev_samp(temp).over(f).alias(f"temp_lag1_rollstd_{n}"),
                 F.avg("humidity").over(f).alias(f"humidity_rollmean_{n}"),
                 F.sum("precip").over(f).alias(f"precip_rollsum_{n}"),
                 F.avg("windspeed").over(f).alias(f"windspeed_rollmean_{n}")]
    for d in range(1, target_days + 1):
        f = sf.rows(block_len * (d - 1) + 1, block_len * d)
        mx = wn.full(F.max(temp), temp, f, block_len)
        mn = wn.full(F.min(temp), temp, f, block_len)
        cols += [mx.alias(f"target_daily_max_day_{d}"), mn.alias(f"target_daily_min_day_{d}"),
                 ((mx + mn) / 2.0).alias(f"target_avg_day_{d}")]
    out = sf.finish(sf.df.select(*cols))
    out = out.drop(*CONSTANT_COLS, "sunrise", "sunset")
    if valid_only:
        out = out.where((F.col(ROW_ID) >= halo_back) & (F.col(ROW_ID) < F.col(N_ROWS) - horizon_rows))
        out = sp.with_positions(out, halo_back, horizon_rows)
    if drop_leakage:
        out = out.drop(*leakage_columns(out.columns))
    return out


def leakage_columns(columns) -> list[str]:
    """``temp`` and ``*temp*`` columns without ``lag``/``roll`` (targets kept)."""
    return [c for c in columns
            if c == "temp" or ("temp" in c and "lag" not in c and "roll" not in c
                               and not c.startswith("target_"))]


def rejects(df: DataFrame, first: int, last: int, series: str = SERIES, ts: str = TS) -> DataFrame:
    """Rows and series that a builder's valid range cannot hold: ``series_id, reason, n_rows``.

    ``null_key``: rows with a NULL series or time stamp (counted per series);
    ``short_series``: series with at most ``first + last`` rows, of which L1/L2
    leave nothing (the reference raises)."""
    null = F.col(series).isNull() | F.col(ts).isNull()
    n = (df.groupBy(F.col(series).alias(SERIES))
           .agg(F.count(F.lit(1)).alias("_n"), F.count_if(null).alias("_null")))
    found = F.array(F.when(F.col("_null") > 0, F.struct(F.lit("null_key").alias("reason"), F.col("_null").alias("n_rows"))),
                    F.when(F.col("_n") <= first + last, F.struct(F.lit("short_series").alias("reason"), F.col("_n").alias("n_rows"))))
    return (n.select(SERIES, F.explode(F.filter(found, lambda x: x.isNotNull())).alias("r"))
             .select(SERIES, "r.reason", "r.n_rows"))


KEY_COLS = [SERIES, TS, ROW_ID, N_ROWS]
BOOKKEEPING = ["split", sp.POS, sp.N_POS, sp.N_TRAIN]


def target_columns(df: DataFrame) -> list[str]:
    """C11: target columns of a builder output."""
    return [c for c in df.columns if c.startswith("target_")]


def feature_columns(df: DataFrame, keep_row_id: bool = False) -> list[str]:
    """C11: everything that is neither a key nor a target nor a sequence."""
    skip = (set(KEY_COLS) - ({ROW_ID} if keep_row_id else set())) | set(BOOKKEEPING)
    return [c for c in df.columns
            if c not in skip and not c.startswith("target_") and c not in ("seq_x", "seq_y")]
