"""Registered queries: one per operator group of the inventory.

Each takes ``(spark, sf_dir)`` and returns a DataFrame over the whole driver
tables (through the stand-in adapters in ``tempora.sources.standins``).
Output columns are normalised by :func:`fin` (doubles rounded to 4 places,
integers widened to BIGINT) so they compare with the DuckDB oracle in
``tempora.plans.oracle``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tempora.functions import calendar as cal
from tempora.operators import drift, features as fe, metrics as mt, monitor as mon, preprocess as pp
from tempora.operators import profile as pf, serve, splits as sp
from tempora.operators import windows as wn
from tempora.sources import files, standins as si

# Block sizes of the skew-safe window layout used by every registered query: small
# against the stand-in series (thousands of rows), so that each series spans
# several blocks and halo rows take part in every checked window.
BLOCK_ROWS = 500
HOURLY_BLOCK_ROWS = 200
RANGE = ("1996-01-01", "1997-12-31")
BACKTEST_PERIOD = 30
BASE_MODEL, TUNED_MODEL, CHAMPION = "persist", "ens", "ens"


def fin(df: DataFrame) -> DataFrame:
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            # round(x * 1e4) / 1e4: the same formula as the SQL side's round(x, 4)
            out.append((F.round(c.cast("double") * 10000.0, 0) / 10000.0).alias(f.name))
        elif isinstance(f.dataType, (T.IntegerType, T.ShortType, T.ByteType)):
            out.append(c.cast("long").alias(f.name))
        else:
            out.append(c)
    return df.select(*out)


# ------------------------------------------------------------------ shared inputs

def daily_feats(spark, d, multi=False, **kw):
    src = si.daily_multi(spark, d) if multi else si.daily(spark, d)
    return fe.daily_features(src, block_rows=BLOCK_ROWS, **kw)


def hourly_feats(spark, d, **kw):
    return fe.hourly_features(si.hourly(spark, d), block_rows=HOURLY_BLOCK_ROWS, **kw)


def preds(spark, d):
    return si.naive_forecasts(si.daily(spark, d), block_rows=BLOCK_ROWS)


def numbered_daily(spark, d, multi=False):
    src = si.daily_multi(spark, d) if multi else si.daily(spark, d)
    return wn.number_rows(fe.clean(src, fe.DAILY_TEXT))


# ------------------------------------------------------------------ features

def q_calendar(spark, d):
    f = daily_feats(spark, d, valid_only=False)
    return fin(f.select("series_id", "ts", "row_id", "day_of_year", "month", "year", "day_of_week",
                        "sin_day_of_year", "cos_day_of_year", "sin_month", "cos_month"))


def q_cyclical(spark, d):
    f = hourly_feats(spark, d, valid_only=False, drop_leakage=False)
    return fin(f.select("series_id", "ts", "row_id", "hour", "day_of_week", "is_weekend",
                        "sin_hour", "cos_hour", "sin_day_of_year", "cos_month"))


def q_clean(spark, d):
    f = daily_feats(spark, d, multi=True, valid_only=False)
    return fin(f.select("series_id", "ts", "severerisk", "preciptype", "conditions", "icon"))


def q_diff(spark, d):
    f = daily_feats(spark, d, multi=True, valid_only=False)
    return fin(f.select("series_id", "ts", "row_id", "temp_diff_1", "temp_diff_7"))


def q_lag_daily(spark, d):
    f = daily_feats(spark, d, multi=True, valid_only=False)
    return fin(f.select("series_id", "ts", *[c for c in f.columns if "_lag_" in c]))


def q_lag_hourly(spark, d):
    f = hourly_feats(spark, d, valid_only=False)
    return fin(f.select("series_id", "ts", *[c for c in f.columns if "_lag_" in c]))


def q_roll_full(spark, d):
    f = daily_feats(spark, d, multi=True, valid_only=False)
    return fin(f.select("series_id", "ts", *[c for c in f.columns if "_roll" in c]))


def q_roll_shifted(spark, d):
    f = hourly_feats(spark, d, valid_only=False)
    return fin(f.select("series_id", "ts", *[c for c in f.columns if "_roll" in c]))


def q_target_point(spark, d):
    f = daily_feats(spark, d, multi=True, valid_only=False)
    return fin(f.select("series_id", "ts", *fe.target_columns(f)))


def q_target_block(spark, d):
    f = hourly_feats(spark, d, valid_only=False)
    return fin(f.select("series_id", "ts", *fe.target_columns(f)))


def q_sequence(spark, d):
    f = daily_feats(spark, d, with_sequences=True)
    flat = F.flatten("seq_x")
    return fin(f.select("series_id", "ts", "row_id",
                        F.size("seq_x").alias("seq_len"),
                        F.aggregate(flat, F.lit(0.0), lambda a, x: a + F.coalesce(x, F.lit(0.0))).alias("seq_sum"),
                        F.size(F.filter(flat, lambda x: x.isNull())).alias("seq_nulls"),
                        *[F.col("seq_y")[i].alias(f"y{i + 1}") for i in range(5)]))


def q_valid(spark, d):
    f = daily_feats(spark, d, multi=True)
    return fin(f.select("series_id", "ts", "row_id", "n_rows"))


def q_valid_hourly(spark, d):
    f = hourly_feats(spark, d)
    return fin(f.select("series_id", "ts", "row_id", "n_rows"))


def q_hourly_multi(spark, d):
    """W3-W14 on one hourly series per event type: no frame crosses a series."""
    f = fe.hourly_features(si.hourly_multi(spark, d), block_rows=HOURLY_BLOCK_ROWS, valid_only=False)
    return fin(f.select("series_id", "ts", "row_id", "temp_lag_1", "temp_lag_144", "temp_lag1_rollmean_144",
                        "temp_lag1_rollstd_3", "precip_rollsum_24", "target_daily_max_day_1", "target_avg_day_5"))


def q_leakage(spark, d):
    f = hourly_feats(spark, d)
    kept = [c for c in f.columns if "temp" in c and "lag" not in c and "roll" not in c]
    return fin(f.select("series_id", "ts", "feelslike", *kept))


def q_days_json(spark, d):
    """Provider documents (one per series and month, written as JSON text from the daily rows)
    parsed with the fixed schema, exploded to days, list columns normalised."""
    src = si.daily_multi(spark, d)
    day = F.struct(F.col("ts").cast("string").alias("datetime"), "temp", "precip",
                   F.when(F.col("preciptype").isNotNull(), F.array("preciptype", F.lit("snow"))).alias("preciptype"),
                   F.array("conditions", "icon").alias("stations"))
    docs = (src.groupBy(F.col("series_id").alias("resolvedAddress"), F.trunc("ts", "month").alias("m"))
               .agg(F.collect_list(day).alias("days")))          # at most 31 days each
    text = docs.select(F.to_json(F.struct("resolvedAddress", "days")).alias("doc"))
    rows = files.parse_days(text, "doc")
    return fin(rows.select("series_id", "ts", "temp", "precip", "preciptype", "stations"))


def q_serving_rows(spark, d):
    """List columns to their first element, absent columns filled, objects as text."""
    src = si.daily(spark, d).withColumns({"stations": F.array("conditions", "icon"), "tags": F.array().cast("array<string>"),
                                          "extra": F.create_map(F.lit("k"), F.col("icon"))})
    out = files.stringify_objects(files.fill_serving_columns(files.normalise_lists(src, all_first=True)), keep=("series_id", "ts"))
    return fin(out.select("series_id", "ts", "stations", "tags", F.length("extra").alias("extra_length"), "windspeedmax",
                          "windspeedmean", "windspeedmin", "sealevelpressure"))


def q_sun(spark, d):
    """Minutes of day, minutes between, severity band, from each user's first and
    last event of a day."""
    e = si.table(spark, d, "events")
    g = (e.groupBy("user_id", F.to_date("ts").alias("day"))
          .agg(F.min("ts").cast("timestamp_ntz").alias("first_ts"), F.max("ts").cast("timestamp_ntz").alias("last_ts"),
               F.max("value").alias("top")))
    return fin(g.select("user_id", "day", cal.minutes_of_day("first_ts").alias("sunrise_minutes"),
                        cal.minutes_of_day("last_ts").alias("sunset_minutes"),
                        cal.minutes_between("first_ts", "last_ts").alias("day_length_minutes"),
                        cal.severity_band("top").alias("severity")))


# ------------------------------------------------------------------ splits

def q_split(spark, d):
    f = sp.chronological_split(daily_feats(spark, d, multi=True))
    return fin(f.select("series_id", "ts", "row_id", "pos", "n_pos", "split"))


def q_folds(spark, d):
    f = sp.chronological_split(daily_feats(spark, d)).where(F.col("split") == "train")
    return fin(sp.cv_folds(f).select("series_id", "ts", "row_id", "fold", "role"))


def q_slices(spark, d):
    n = numbered_daily(spark, d, multi=True)
    # four slices of one read: the flags are column arithmetic, so one explode gives all of them
    back = F.col("n_rows") - 1 - F.col("row_id")
    flags = F.array(F.when(back < sp.RETRAIN_WINDOW, "retrain").when(back < sp.RETRAIN_WINDOW + sp.VALIDATION_WINDOW, "validation"),
                    F.when(F.col("row_id") < sp.DRIFT_BASELINE_ROWS, "drift_baseline"),
                    F.when(back < sp.PLOT_TAIL, "last_365"), F.when(back < sp.MAX_HISTORY, "history_180"))
    return fin(n.select("series_id", "ts", F.explode(F.filter(flags, lambda x: x.isNotNull())).alias("slice")))


def q_slice_functions(spark, d):
    """L6-L9 through their functions, each on its own."""
    n = numbered_daily(spark, d, multi=True)
    a = sp.retrain_slices(n, latest=True).select("series_id", "ts", "slice")
    b = sp.head_rows(n, sp.DRIFT_BASELINE_ROWS).select("series_id", "ts", F.lit("drift_baseline").alias("slice"))
    c = sp.tail_rows(n, sp.PLOT_TAIL, 5).select("series_id", "ts", F.lit("tail_365").alias("slice"))
    old = F.col("row_id") < F.col("n_rows") - 10
    e = sp.append_bounded(n.where(old), n.where(~old)).select("series_id", "ts", F.lit("history_180").alias("slice"))
    return fin(a.unionByName(b).unionByName(c).unionByName(e))


def q_rejects(spark, d):
    """L1: series too short for the valid range, and rows without a key."""
    src = si.daily_customers(spark, d)
    broken = src.withColumn("series_id", F.when(F.col("series_id") != "7", F.col("series_id")))
    return fin(fe.rejects(broken, max(max(fe.DAILY_LAGS), fe.DAILY_SEQUENCE_LENGTH), max(fe.DAILY_HORIZONS)))


def q_lag_customers(spark, d):
    """W1/W2/W5 on one series per customer: the number of series grows with the table."""
    f = fe.daily_features(si.daily_customers(spark, d), block_rows=BLOCK_ROWS, valid_only=False)
    return fin(f.select("series_id", "ts", "row_id", "n_rows", "temp_diff_1", "temp_lag_1", "precip_lag_3",
                        "temp_rollmean_3", "precip_rollsum_7", "target_temp_t+1"))


def q_roll_users(spark, d):
    """W3/W8-W14 on one hourly series per user."""
    f = fe.hourly_features(si.hourly_users(spark, d), block_rows=HOURLY_BLOCK_ROWS, valid_only=False)
    return fin(f.select("series_id", "ts", "row_id", "n_rows", "temp_lag_24", "temp_lag1_rollmean_24", "temp_lag1_rollstd_3",
                        "precip_rollsum_48", "target_daily_max_day_1"))


def _origin_forecasts(spark, d):
    n = numbered_daily(spark, d)
    sf = wn.prepare(n.select("series_id", "ts", "row_id", "n_rows", "temp"), 7, 0, block_rows=BLOCK_ROWS, numbered=True)
    t = F.col("temp")
    es = []
    for h in range(1, 6):
        es += [F.struct(F.lit("persist").alias("model"), F.lit(h).alias("horizon"), t.alias("y_pred")),
               F.struct(F.lit("seasonal7").alias("model"), F.lit(h).alias("horizon"),
                        F.lag(t, 7 - h).over(sf.w).alias("y_pred"))]
    fc = sf.finish(sf.df.select("*", F.array(*es).alias("_e")))
    fc = fc.select("series_id", "ts", "row_id", "n_rows", F.explode("_e").alias("e")).select("series_id", "ts", "row_id", "n_rows", "e.*")
    return fc, n


def q_backtest(spark, d):
    fc, n = _origin_forecasts(spark, d)
    bt = serve.backtest(fc, n, BACKTEST_PERIOD)
    return fin(bt.select("model", "series_id", "origin_ts", "target_ts", "horizon", "y_true", "y_pred"))


def q_backtest_scores(spark, d):
    fc, n = _origin_forecasts(spark, d)
    bt = serve.backtest(fc, n, BACKTEST_PERIOD)
    return fin(mt.backtest_scores(bt, by=("model", "horizon")))


# ------------------------------------------------------------------ profile

def q_profile(spark, d):
    return fin(pf.profile(si.daily(spark, d), order="ts"))


# ------------------------------------------------------------------ preprocessing

NUM_COLS = ["windspeed", "windspeed_lag_1", "temp_lag_1", "precip_rollsum_7", "temp_rollstd_3"]
CAT_COLS = ["preciptype", "conditions", "icon", "month", "day_of_week", "year"]


def _split_feats(spark, d):
    return sp.chronological_split(daily_feats(spark, d))


def q_impute_scale(spark, d):
    f = _split_feats(spark, d)
    tr = f.where(F.col("split") == "train")
    med = pp.fit_medians(tr, NUM_COLS)
    mean, std = pp.fit_scaling(tr, NUM_COLS, med)
    m = pp.PreprocessorModel(dict(numeric=NUM_COLS, categorical=[], text=[], medians=med, means=mean,
                                  stds=std, modes={}, categories={}, vocab=[], output_col="features"))
    out = m.transform(f, keep=["series_id", "ts", "split"], assemble=False)
    return fin(out.select("series_id", "ts", "split", *[F.col(f"num__{c}").alias(c) for c in NUM_COLS]))


def q_mode(spark, d):
    f = _split_feats(spark, d)
    tr = f.where(F.col("split") == "train")
    entries = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).cast("string").alias("value"))
                        for c in CAT_COLS])
    long = tr.select(F.explode(entries).alias("e")).select("e.*").where(F.col("value").isNotNull())
    cnt = long.groupBy("column_name", "value").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("column_name").orderBy(F.desc("n"), F.asc("value"))
    return fin(cnt.withColumn("_r", F.row_number().over(w)).where(F.col("_r") == 1)
                  .select("column_name", F.col("value").alias("mode"), F.col("n").alias("mode_count")))


def q_onehot(spark, d):
    f = _split_feats(spark, d)
    tr = f.where(F.col("split") == "train")
    modes = pp.fit_modes(tr, CAT_COLS)
    cats = pp.fit_categories(tr, CAT_COLS, modes)
    m = pp.PreprocessorModel(dict(numeric=[], categorical=CAT_COLS, text=[], medians={}, means={}, stds={},
                                  modes=modes, categories=cats, vocab=[], output_col="features"))
    out = m.transform(f, keep=["series_id", "ts", "split"], assemble=False)
    ex = []
    for c in CAT_COLS:
        cs = [F.col(f"cat__{c}__{i}") for i in range(len(cats[c]))]
        hot = F.array_position(F.array(*cs), 1.0) if cs else F.lit(0)
        ex.append(F.struct(F.lit(c).alias("column_name"), (hot - 1).cast("long").alias("hot_index"),
                           F.lit(len(cats[c])).cast("long").alias("n_categories")))
    return fin(out.select("series_id", "ts", "split", F.explode(F.array(*ex)).alias("e")).select("series_id", "ts", "split", "e.*"))


def q_tfidf(spark, d):
    docs = si.table(spark, d, "documents")
    return fin(pp.tfidf_table(docs, "doc_id", "text"))


# ------------------------------------------------------------------ metrics

def _per_h(spark, d):
    return mt.metrics_by_horizon(preds(spark, d))


def q_metrics(spark, d):
    return fin(_per_h(spark, d))


def q_macro(spark, d):
    return fin(mt.macro(_per_h(spark, d)))


def q_leaderboard(spark, d):
    return fin(mt.leaderboard(mt.macro(_per_h(spark, d))))


def q_horizon_pivot(spark, d):
    return fin(mt.horizon_pivot(_per_h(spark, d), [1, 2, 3, 4, 5]))


def q_best_model(spark, d):
    from tempora.operators.models import best_model
    return fin(best_model(mt.macro(_per_h(spark, d))))


def q_compare(spark, d):
    ph = _per_h(spark, d)
    cmp, _, _ = mt.compare_models(mt.macro(ph), ph, BASE_MODEL, TUNED_MODEL)
    return fin(mt.recommended(cmp))


def q_compare_horizon(spark, d):
    ph = _per_h(spark, d)
    _, hcmp, _ = mt.compare_models(mt.macro(ph), ph, BASE_MODEL, TUNED_MODEL)
    return fin(hcmp)


def q_gap(spark, d):
    return fin(mt.train_test_gap(mt.macro(_per_h(spark, d))))


def q_pooled(spark, d):
    return fin(mt.pooled_by_time(preds(spark, d)))


def q_cv(spark, d):
    p = preds(spark, d).where(F.col("split") == "train")
    pv = sp.cv_folds(p).where(F.col("role") == "val")
    per = mt.metrics_by_horizon(pv, by=("model", "fold")).drop("n")
    long = mt.to_long(per, by=("model",), fold_col="fold")
    return fin(mt.fold_mean(long))


def q_monthly(spark, d):
    return fin(mt.monthly_residuals(preds(spark, d).where(F.col("split") == "test")))


def q_box(spark, d):
    return fin(mt.monthly_box(preds(spark, d).where(F.col("split") == "test")))


def q_high_error(spark, d):
    _, s = mt.high_error(preds(spark, d).where(F.col("split") == "test"))
    return fin(s)


def q_high_error_rows(spark, d):
    fl, _ = mt.high_error(preds(spark, d).where(F.col("split") == "test"))
    return fin(fl.select("model", "series_id", "ts", "y_true", "y_pred", "residual", "high_error"))


def q_abs_by_h(spark, d):
    return fin(mt.abs_error_by_horizon(preds(spark, d).where(F.col("split") == "test")))


def q_moments(spark, d):
    return fin(mt.residual_moments(preds(spark, d).where(F.col("split") == "test")))


def q_hist(spark, d):
    return fin(mt.residual_histogram(preds(spark, d).where(F.col("split") == "test")))


def q_biasvar(spark, d):
    t, _ = mt.bias_variance(preds(spark, d).where(F.col("split") == "test"))
    return fin(t)


def q_biasvar_verdict(spark, d):
    _, v = mt.bias_variance(preds(spark, d).where(F.col("split") == "test"))
    return fin(v)


def q_range_stats(spark, d):
    return fin(mt.range_stats(fe.clean(si.daily_multi(spark, d), fe.DAILY_TEXT), *RANGE))


def q_latest(spark, d):
    n = numbered_daily(spark, d, multi=True)
    return fin(serve.latest_delta(n).select("series_id", "ts", "row_id", "temp", "humidity",
                                            "temp_delta", "humidity_delta",
                                            cal.temp_band("temp").alias("band"),
                                            cal.precip_label("precip").alias("precip_label")))


def q_last_n(spark, d):
    n = numbered_daily(spark, d, multi=True)
    return fin(serve.last_n(n, 14).select("series_id", "ts", "row_id", "temp"))


def q_forecast(spark, d):
    """Ensemble forecast of every horizon from the newest row of
    each series, dated origin + h, with its temperature band."""
    fc, n = _origin_forecasts(spark, d)
    f = sp.tail_rows(fc, 1)
    ens = f.groupBy("series_id", "ts", "horizon").agg(F.avg("y_pred").alias("y_pred"))
    out = (ens.withColumn("forecast_date", F.date_add("ts", F.col("horizon").cast("int")))
              .withColumn("band", cal.temp_band("y_pred")))
    return fin(out.withColumnRenamed("ts", "origin_ts"))


# ------------------------------------------------------------------ monitoring

def _log(spark, d):
    p = preds(spark, d)
    ph = mt.metrics_by_horizon(p.where(F.col("model") == CHAMPION))
    base = mt.macro(ph).where(F.col("split") == "train").select(F.col("rmse_macro").alias("base_rmse"))
    return mon.performance_log(p.where((F.col("model") == CHAMPION) & (F.col("split") == "test")), base)


def q_log(spark, d):
    return fin(_log(spark, d))


def q_triggers(spark, d):
    t = mon.triggers(_log(spark, d))
    return fin(t.select("ts", "day_index", "mean_degradation_30", "alert_rate_7", "reasons", "should_retrain"))


def q_alert_rate(spark, d):
    return fin(mon.alert_rate_rolling(_log(spark, d)).select("ts", "day_index", "alert_rate_30"))


def q_report(spark, d):
    return fin(mon.report(_log(spark, d)))


def q_dashboard(spark, d):
    return fin(mon.dashboard(_log(spark, d)))


def _log_by_series(spark, d):
    """One log per series (five order priorities): the base is each series' own train error."""
    p = si.naive_forecasts(si.daily_multi(spark, d), block_rows=BLOCK_ROWS).where(F.col("model") == CHAMPION)
    e = F.col("y_true") - F.col("y_pred")
    base = F.avg(F.when(F.col("split") == "train", F.col("rmse"))).over(Window.partitionBy("series_id"))
    # one aggregate holds both: per horizon on the train side, per day on the test side
    side = F.when(F.col("split") == "train", F.struct(F.lit(None).cast("date").alias("ts"), F.col("horizon").alias("h"))).otherwise(
        F.struct(F.col("ts").alias("ts"), F.lit(None).cast("int").alias("h")))
    g = (p.groupBy("series_id", "split", side.alias("k")).agg(F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(F.abs(e)).alias("mae"))
          .withColumn("base_rmse", base).where(F.col("split") == "test").select("series_id", F.col("k.ts").alias("ts"), "rmse", "mae", "base_rmse"))
    return mon.degraded(g, by=("series_id",))


def _events(log, by=()):
    """Retrain events for the checks: every 40th log day, adopted when the day raised no alert."""
    return (log.where(F.col("day_index") % 40 == 0)
               .select(*by, "day_index", (~F.col("alert")).alias("adopted"),
                       F.when(~F.col("alert"), -F.col("degradation") * 100).alias("improvement")))


def q_triggers_history(spark, d):
    """R6/R7 with retrain events: maintenance counts from the last event."""
    log = _log(spark, d).checkpoint()
    t = mon.triggers(log, history=_events(log))
    return fin(t.select("ts", "day_index", "last_retrain", "reasons", "should_retrain"))


def q_triggers_drift(spark, d):
    """R5 inside the decision: a drift flag per day (here: every 10th)."""
    log = _log(spark, d).checkpoint()
    flags = log.select("day_index", (F.col("day_index") % 10 == 0).alias("drift"))
    return fin(mon.triggers(log, drift=flags).select("ts", "day_index", "reasons", "should_retrain"))


def q_report_history(spark, d):
    log = _log(spark, d).checkpoint()
    return fin(mon.report(log, _events(log)))


def q_dashboard_events(spark, d):
    log = _log(spark, d).checkpoint()
    return fin(mon.dashboard(log, _events(log)))


def q_triggers_by_series(spark, d):
    """R2-R7 with one log per series."""
    by = ("series_id",)
    log = _log_by_series(spark, d).checkpoint()
    return fin(mon.triggers(log, history=_events(log, by), by=by)
                  .select("series_id", "ts", "day_index", "degradation", "last_retrain", "reasons", "should_retrain"))


def q_report_by_series(spark, d):
    by = ("series_id",)
    log = _log_by_series(spark, d).checkpoint()
    return fin(mon.report(log, _events(log, by), by=by))


def q_tfidf_fitted(spark, d):
    """T5 fitted on the train days' descriptions, applied to the test days."""
    f = _split_feats(spark, d).select("series_id", "ts", "split", "description").checkpoint()
    out = pp.tfidf_table(f.where("split = 'test'"), "ts", "description", fit_df=f.where("split = 'train'"))
    return fin(out)


def q_roles(spark, d):
    """Role of every feature column of the daily builder."""
    from tempora.plans.training import model_roles
    f = daily_feats(spark, d)
    rows = [(c, role) for role, cols in model_roles(f).items() for c in cols]
    names = spark.createDataFrame(rows, "column_name string, role string")
    present = f.agg(F.array(*[F.struct(F.lit(c).alias("column_name"), F.count(F.col(f"`{c}`")).alias("n_values")) for c, _ in rows]).alias("a"))
    return fin(present.select(F.explode("a").alias("e")).select("e.*").join(F.broadcast(names), "column_name"))


def _ks_inputs(spark, d):
    f = sp.chronological_split(daily_feats(spark, d, multi=True)).where(F.col("split") == "train")
    cols = [c for c in fe.feature_columns(f) if isinstance(f.schema[c].dataType, (T.DoubleType, T.IntegerType, T.LongType))]
    # train rows are positions [0, n_train): first and last 30 are one filter with two flags
    first = F.col("pos") < sp.DRIFT_BASELINE_ROWS
    last = F.col("pos") >= F.col("n_train") - sp.DRIFT_BASELINE_ROWS
    return f.where(first | last).withColumns({"in_base": first, "in_recent": last}), cols


def q_ks(spark, d):
    f, cols = _ks_inputs(spark, d)
    st = drift.ks_flagged(drift.unpivot(f, ["series_id", "in_base", "in_recent"], cols), ["series_id", "column_name"])
    return fin(st.withColumn("drifted_30", (F.col("n_base") == 30) & (F.col("n_recent") == 30)
                             & (F.col("k_stat") >= 11 * 30)))


def q_drift(spark, d):
    """Columns drifted at 5 % and the flag per series, from the exact p-values."""
    f, cols = _ks_inputs(spark, d)
    st, summ = drift.ks_drift(f, ["series_id"], cols)
    return fin(summ)


def q_csv_rejects(spark, d):
    """S1 with rejects: a CSV written from the daily series, some of its lines broken, read back: rows per
    year and bad lines per reason."""
    import uuid
    from tempora.session import checkpoint_dir
    src = si.daily_multi(spark, d).select("series_id", "ts", "temp", "humidity")
    at = F.dayofmonth("ts")
    text = F.concat_ws(",", F.col("series_id"), F.when(at == 3, F.lit("no date")).otherwise(F.date_format("ts", "yyyy-MM-dd")),
                       F.when(at == 5, F.lit("n/a")).otherwise(F.col("temp").cast("string")), F.col("humidity").cast("string"))
    line = F.when(at == 7, F.col("series_id")).when(at == 9, F.concat(text, F.lit(",1,2"))).otherwise(text)
    path = f"{checkpoint_dir(spark)}/daily-csv-{uuid.uuid4().hex}"
    src.select(line.alias("resolvedAddress,datetime,temp,humidity")).write.option("header", True).option("quote", "").csv(path)
    good, bad = files.read_csv_checked(spark, path, files.daily_schema(), files.daily_ts)
    rows = good.groupBy(F.col("series_id"), F.year("ts").cast("string").alias("part")).agg(F.count(F.lit(1)).alias("n"), F.sum("temp").alias("total"))
    first = F.substring_index("record", ",", 1)
    rejects = bad.groupBy(first.alias("series_id"), F.col("reason").alias("part")).agg(F.count(F.lit(1)).alias("n"), F.lit(None).cast("double").alias("total"))
    return fin(rows.unionByName(rejects))


DRIFT_DAY_COLS = ["temp", "tempmax", "tempmin", "humidity", "precip"]


def q_drift_by_day(spark, d):
    """R8 for every day of the last fifth of each series: the 30 rows before the day against the first 30 rows."""
    from tempora.plans.monitoring import drift_by_day
    n = numbered_daily(spark, d, multi=True).select("series_id", "row_id", "n_rows", *DRIFT_DAY_COLS).checkpoint()
    cut = F.floor(F.col("n_rows") * 0.8)
    stream = n.withColumn("day_index", F.when(F.col("row_id") >= cut, F.col("row_id") - cut).cast("long"))
    return fin(drift_by_day(sp.head_rows(n, sp.DRIFT_BASELINE_ROWS), stream, DRIFT_DAY_COLS))


QUERIES = {name: fn for name, fn in list(globals().items()) if name.startswith("q_") and callable(fn)}
