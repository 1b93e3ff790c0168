"""Independent DuckDB SQL for every SQL-expressible registered query.

Plain SQL over the driver tables: the stand-in adapters, ``row_number``,
``lag``/``lead`` and framed aggregates with ``PARTITION BY series_id ORDER BY
ts`` (one window per series -- the straightforward single-node form the
Spark side's blocked windows must reproduce).  Doubles are rounded to 4
places and integers are BIGINT, like ``queries.fin``.
"""

from __future__ import annotations

from tempora.operators.profile import COLUMN_DESCRIPTIONS

W = "PARTITION BY series_id ORDER BY ts"
# Spelled out here, not imported: a wrong constant in the library must not pass.
DAILY_HORIZONS = [1, 2, 3, 4, 5]
DAILY_LAGS = [1, 2, 3, 7, 14]
DAILY_WINDOWS = [3, 7, 14]
HOURLY_LAGS = [1, 2, 3, 6, 12, 18, 24, 48, 96, 120, 144]
HOURLY_WINDOWS = [3, 6, 12, 18, 24, 48, 72, 96, 120, 144]
HOURLY_TARGET_DAYS = 5
DAILY_PRESENT = ['temp', 'tempmax', 'tempmin', 'humidity', 'precip', 'windspeed', 'cloudcover', 'severerisk']
HOURLY_PRESENT = ['feelslike', 'humidity', 'precip', 'windspeed', 'cloudcover', 'severerisk']


def R(sql: str, dbl) -> str:
    """Round the listed double columns to 4 places."""
    dbl = list(dbl)
    if not dbl:
        return sql
    rep = ", ".join(f'round("{c}", 4) AS "{c}"' for c in dbl)
    return f"SELECT * REPLACE ({rep}) FROM ({sql}) AS _q"


def q(c: str) -> str:
    return f'"{c}"'


def frame(a: str, b: str) -> str:
    return f"OVER ({W} ROWS BETWEEN {a} AND {b})"


def guarded(agg: str, x: str, a: str, b: str, n: int) -> str:
    return f"CASE WHEN count({x}) {frame(a, b)} = {n} THEN {agg}({x}) {frame(a, b)} END"


# ------------------------------------------------------------------ adapters

def daily_src(key: str = "'_'") -> str:
    c = "CAST(round(o_totalprice * 100) AS BIGINT)"
    return f"""SELECT {key} AS series_id, CAST(o_orderdate AS DATE) AS ts,
  sum({c}) / 4194304.0 AS temp, max({c}) / 4194304.0 AS tempmax,
  min({c}) / 4194304.0 AS tempmin, CAST(count(*) AS DOUBLE) AS humidity,
  sum({c}) / 1073741824.0 AS precip,
  CASE WHEN count(*) > 1 THEN (max({c}) - min({c})) / 1048576.0 END AS windspeed,
  sum(CASE WHEN o_orderstatus = 'F' THEN 12.5::DOUBLE ELSE 0.0::DOUBLE END) AS cloudcover,
  sum(CASE WHEN o_orderpriority = '1-URGENT' THEN 1.0::DOUBLE END) AS severerisk,
  min(CASE WHEN o_orderstatus = 'P' THEN 'rain' END) AS preciptype,
  min(o_orderpriority) AS conditions, max(o_orderstatus) AS icon,
  CASE WHEN count(*) % 7 <> 0 THEN concat_ws(' ', min(o_orderpriority), 'status', max(o_orderstatus),
    CASE WHEN count(*) % 2 = 0 THEN 'even day of orders' END, 'month' || month(min(o_orderdate))) END AS description
FROM orders GROUP BY 1, 2"""


def hourly_src(key: str = "'_'") -> str:
    c = "CAST(round(value * 100) AS BIGINT)"
    return f"""SELECT {key} AS series_id, date_trunc('hour', ts) AS ts,
  sum({c}) / 8192.0 AS temp, min({c}) / 128.0 AS feelslike, CAST(count(*) AS DOUBLE) AS humidity,
  sum({c}) / 1024.0 AS precip, max({c}) / 128.0 AS windspeed,
  sum(CASE WHEN event_type = 'error' THEN 12.5::DOUBLE ELSE 0.0::DOUBLE END) AS cloudcover,
  sum(CASE WHEN event_type = 'error' THEN 1.0::DOUBLE END) AS severerisk,
  min(CASE WHEN event_type = 'purchase' THEN 'rain' END) AS preciptype,
  min(event_type) AS conditions, max(event_type) AS icon
FROM events GROUP BY 1, 2"""


def numbered(src_sql: str, num_cols, name: str) -> str:
    cols = ", ".join(c for c in num_cols if c != "severerisk")
    return f"""{name}_src AS ({src_sql}),
{name} AS (SELECT series_id, ts, {cols}, coalesce(severerisk, 0.0::DOUBLE) AS severerisk,
  coalesce(preciptype, 'none') AS preciptype, coalesce(conditions, '') AS conditions, coalesce(icon, '') AS icon,
  row_number() OVER ({W}) - 1 AS row_id, count(*) OVER (PARTITION BY series_id) AS n_rows
FROM {name}_src)"""


def daily_n(multi: bool = False) -> str:
    return numbered(daily_src("o_orderpriority" if multi else "'_'"), DAILY_PRESENT, "dn")


def hourly_n(multi: bool = False) -> str:
    return numbered(hourly_src("event_type" if multi else "'_'"), ['temp'] + HOURLY_PRESENT, "hn")


# ------------------------------------------------------------------ features

def daily_feature_cols() -> list[tuple[str, str]]:
    out = [("day_of_year", "dayofyear(ts)"), ("month", "month(ts)"), ("year", "year(ts)"),
           ("day_of_week", "isodow(ts) - 1"),
           ("sin_day_of_year", "sin(2 * pi() * dayofyear(ts) / 366)"),
           ("cos_day_of_year", "cos(2 * pi() * dayofyear(ts) / 366)"),
           ("sin_month", "sin(2 * pi() * month(ts) / 12)"), ("cos_month", "cos(2 * pi() * month(ts) / 12)"),
           ("temp_diff_1", f"temp - lag(temp, 1) OVER ({W})"), ("temp_diff_7", f"temp - lag(temp, 7) OVER ({W})")]
    for k in DAILY_LAGS:
        out += [(f"{c}_lag_{k}", f"lag({c}, {k}) OVER ({W})") for c in DAILY_PRESENT]
    for n in DAILY_WINDOWS:
        a = f"{n - 1} PRECEDING"
        out += [(f"temp_rollmean_{n}", guarded("avg", "temp", a, "CURRENT ROW", n)),
                (f"temp_rollstd_{n}", guarded("stddev_samp", "temp", a, "CURRENT ROW", n)),
                (f"humidity_rollmean_{n}", guarded("avg", "humidity", a, "CURRENT ROW", n)),
                (f"precip_rollsum_{n}", guarded("sum", "precip", a, "CURRENT ROW", n)),
                (f"windspeed_rollmean_{n}", guarded("avg", "windspeed", a, "CURRENT ROW", n)),
                (f"cloudcover_rollmean_{n}", guarded("avg", "cloudcover", a, "CURRENT ROW", n))]
    out += [(f"target_temp_t+{h}", f"lead(temp, {h}) OVER ({W})") for h in DAILY_HORIZONS]
    return out


def daily_feats(multi: bool = False) -> str:
    cols = ",\n  ".join(f"{e} AS {q(n)}" for n, e in daily_feature_cols())
    return f"""{daily_n(multi)},
df_all AS (SELECT *, {cols} FROM dn)"""


def hourly_feature_cols() -> list[tuple[str, str]]:
    out = [("day_of_year", "dayofyear(ts)"), ("month", "month(ts)"), ("year", "year(ts)"),
           ("day_of_week", "isodow(ts) - 1"), ("is_weekend", "CAST(isodow(ts) - 1 >= 5 AS BIGINT)"),
           ("hour", "hour(ts)"),
           ("sin_day_of_year", "sin(2 * pi() * dayofyear(ts) / 366)"),
           ("cos_day_of_year", "cos(2 * pi() * dayofyear(ts) / 366)"),
           ("sin_month", "sin(2 * pi() * month(ts) / 12)"), ("cos_month", "cos(2 * pi() * month(ts) / 12)"),
           ("sin_hour", "sin(2 * pi() * hour(ts) / 24)"), ("cos_hour", "cos(2 * pi() * hour(ts) / 24)")]
    for k in HOURLY_LAGS:
        out += [(f"{c}_lag_{k}", f"lag({c}, {k}) OVER ({W})") for c in HOURLY_PRESENT]
    out += [(f"temp_lag_{k}", f"lag(temp, {k}) OVER ({W})") for k in HOURLY_LAGS]
    for n in HOURLY_WINDOWS:
        f = frame(f"{n} PRECEDING", "1 PRECEDING")
        out += [(f"temp_lag1_rollmean_{n}", f"avg(temp) {f}"), (f"temp_lag1_rollstd_{n}", f"stddev_samp(temp) {f}"),
                (f"humidity_rollmean_{n}", f"avg(humidity) {f}"), (f"precip_rollsum_{n}", f"sum(precip) {f}"),
                (f"windspeed_rollmean_{n}", f"avg(windspeed) {f}")]
    for d in range(1, HOURLY_TARGET_DAYS + 1):
        a, b = f"{24 * (d - 1) + 1} FOLLOWING", f"{24 * d} FOLLOWING"
        mx, mn = guarded("max", "temp", a, b, 24), guarded("min", "temp", a, b, 24)
        out += [(f"target_daily_max_day_{d}", mx), (f"target_daily_min_day_{d}", mn),
                (f"target_avg_day_{d}", f"({mx} + {mn}) / 2.0")]
    return out


def hourly_feats(multi: bool = False) -> str:
    cols = ",\n  ".join(f"{e} AS {q(n)}" for n, e in hourly_feature_cols())
    return f"""{hourly_n(multi)},
hf_all AS (SELECT *, {cols} FROM hn)"""


DAILY_VALID = "row_id >= 30 AND row_id < n_rows - 5"
HOURLY_VALID = "row_id >= 144 AND row_id < n_rows - 120"


def split_cte(src: str, valid: str, name: str = "spl") -> str:
    return f"""{name}_v AS (SELECT * FROM {src} WHERE {valid}),
{name}_p AS (SELECT *, row_id - min(row_id) OVER (PARTITION BY series_id) AS pos,
  count(*) OVER (PARTITION BY series_id) AS n_pos FROM {name}_v),
{name} AS (SELECT * FROM (SELECT *, CASE WHEN pos < floor(n_pos * 0.85) THEN 'train'
  WHEN pos >= floor(n_pos * 0.85) + 14 THEN 'test' END AS split FROM {name}_p) WHERE split IS NOT NULL)"""


# ------------------------------------------------------------------ forecasts

def preds_cte(multi: bool = False) -> str:
    hs = DAILY_HORIZONS
    leads = ", ".join(f"lead(temp, {h}) OVER ({W}) AS y{h}" for h in hs)
    lags = ", ".join(f"lag(temp, {7 - h}) OVER ({W}) AS s{h}" for h in hs)
    parts = []
    for h in hs:
        parts.append(f"SELECT 'persist' AS model, split, series_id, ts, row_id, CAST({h} AS BIGINT) AS horizon, "
                     f"y{h} AS y_true, temp AS y_pred FROM nf_s")
        parts.append(f"SELECT 'seasonal7' AS model, split, series_id, ts, row_id, CAST({h} AS BIGINT) AS horizon, "
                     f"y{h} AS y_true, s{h} AS y_pred FROM nf_s")
    base = "\n  UNION ALL ".join(parts)
    return f"""{daily_n(multi)},
nf AS (SELECT series_id, ts, row_id, n_rows, temp, {leads}, {lags} FROM dn),
{split_cte('nf', DAILY_VALID, 'nf_s')},
pbase AS ({base}),
pred AS (SELECT * FROM pbase UNION ALL
  SELECT 'ens' AS model, split, series_id, ts, row_id, horizon, max(y_true) AS y_true, avg(y_pred) AS y_pred
  FROM pbase GROUP BY split, series_id, ts, row_id, horizon HAVING count(y_pred) = 2)"""


E2 = "(y_true - y_pred) * (y_true - y_pred)"
R2 = ("CASE WHEN var_pop(y_true) * count(y_true) > 0 THEN 1 - sum({e2}) / (var_pop(y_true) * count(y_true)) "
      "WHEN sum({e2}) = 0 THEN 1.0 ELSE 0.0 END").format(e2=E2)
METRIC_AGGS = (f"count(*) AS n, sqrt(avg({E2})) AS rmse, avg(abs(y_true - y_pred)) AS mae, "
               f"avg(CASE WHEN abs(y_true) > 1e-6 THEN abs((y_true - y_pred) / y_true) END) * 100 AS mape, {R2} AS r2")


def per_h_cte() -> str:
    return f"""{preds_cte()},
per_h AS (SELECT model, split, horizon, {METRIC_AGGS} FROM pred GROUP BY model, split, horizon),
macro AS (SELECT model, split, avg(rmse) AS rmse_macro, avg(mae) AS mae_macro, avg(mape) AS mape_macro,
  avg(r2) AS r2_macro FROM per_h GROUP BY model, split)"""


def origin_cte() -> str:
    parts = []
    for h in DAILY_HORIZONS:
        parts.append(f"SELECT 'persist' AS model, series_id, ts, row_id, n_rows, CAST({h} AS BIGINT) AS horizon, temp AS y_pred FROM fo")
        parts.append(f"SELECT 'seasonal7' AS model, series_id, ts, row_id, n_rows, CAST({h} AS BIGINT) AS horizon, "
                     f"lag7_{h} AS y_pred FROM fo")
    lags = ", ".join(f"lag(temp, {7 - h}) OVER ({W}) AS lag7_{h}" for h in DAILY_HORIZONS)
    u = "\n  UNION ALL ".join(parts)
    return f"""{daily_n()},
fo AS (SELECT series_id, ts, row_id, n_rows, temp, {lags} FROM dn),
fc AS ({u}),
bt AS (SELECT f.model, f.series_id, f.ts AS origin_ts, a.ts AS target_ts, f.horizon, a.temp AS y_true, f.y_pred
  FROM fc f JOIN dn a ON a.series_id = f.series_id AND a.row_id = f.row_id + f.horizon
  WHERE f.row_id >= f.n_rows - 30)"""


def log_cte() -> str:
    return f"""{preds_cte()},
lb AS (SELECT avg(rmse) AS base_rmse FROM (SELECT horizon, sqrt(avg({E2})) AS rmse FROM pred
  WHERE model = 'ens' AND split = 'train' GROUP BY horizon)),
lg0 AS (SELECT ts, sqrt(avg({E2})) AS rmse, avg(abs(y_true - y_pred)) AS mae FROM pred
  WHERE model = 'ens' AND split = 'test' GROUP BY ts),
lg AS (SELECT ts, rmse, mae, base_rmse,
  CASE WHEN base_rmse <> 0 THEN (rmse - base_rmse) / base_rmse END AS degradation,
  coalesce(CASE WHEN base_rmse <> 0 THEN (rmse - base_rmse) / base_rmse END > 0.15, false) AS alert,
  row_number() OVER (ORDER BY ts) AS day_index FROM lg0, lb)"""


LOG_DBL = ["rmse", "mae", "base_rmse", "degradation"]


def test_res() -> str:
    return f"""{preds_cte()},
res AS (SELECT *, y_true - y_pred AS residual FROM pred WHERE split = 'test')"""


# ------------------------------------------------------------------ queries

def _sql() -> dict[str, str]:
    S: dict[str, str] = {}
    dcols = [n for n, _ in daily_feature_cols()]
    hcols = [n for n, _ in hourly_feature_cols()]
    cal = ["sin_day_of_year", "cos_day_of_year", "sin_month", "cos_month"]

    S["q_calendar"] = R(f"""WITH {daily_feats()} SELECT series_id, ts, row_id, day_of_year, month, year, day_of_week,
  {', '.join(cal)} FROM df_all""", cal)
    S["q_cyclical"] = R(f"""WITH {hourly_feats()} SELECT series_id, ts, row_id, hour, day_of_week, is_weekend,
  sin_hour, cos_hour, sin_day_of_year, cos_month FROM hf_all""", ["sin_hour", "cos_hour", "sin_day_of_year", "cos_month"])
    S["q_clean"] = R(f"WITH {daily_n(True)} SELECT series_id, ts, severerisk, preciptype, conditions, icon FROM dn",
                     ["severerisk"])
    S["q_diff"] = R(f"WITH {daily_feats(True)} SELECT series_id, ts, row_id, temp_diff_1, temp_diff_7 FROM df_all",
                    ["temp_diff_1", "temp_diff_7"])
    lagd = [c for c in dcols if "_lag_" in c]
    S["q_lag_daily"] = R(f"WITH {daily_feats(True)} SELECT series_id, ts, {', '.join(map(q, lagd))} FROM df_all", lagd)
    lagh = [c for c in hcols if "_lag_" in c]
    S["q_lag_hourly"] = R(f"WITH {hourly_feats()} SELECT series_id, ts, {', '.join(map(q, lagh))} FROM hf_all", lagh)
    rolld = [c for c in dcols if "_roll" in c]
    S["q_roll_full"] = R(f"WITH {daily_feats(True)} SELECT series_id, ts, {', '.join(map(q, rolld))} FROM df_all", rolld)
    rollh = [c for c in hcols if "_roll" in c]
    S["q_roll_shifted"] = R(f"WITH {hourly_feats()} SELECT series_id, ts, {', '.join(map(q, rollh))} FROM hf_all", rollh)
    td = [c for c in dcols if c.startswith("target_")]
    S["q_target_point"] = R(f"WITH {daily_feats(True)} SELECT series_id, ts, {', '.join(map(q, td))} FROM df_all", td)
    th = [c for c in hcols if c.startswith("target_")]
    S["q_target_block"] = R(f"WITH {hourly_feats()} SELECT series_id, ts, {', '.join(map(q, th))} FROM hf_all", th)
    base = ", ".join(DAILY_PRESENT)
    ys = ", ".join(f"lead(temp, {h}) OVER ({W}) AS y{h}" for h in DAILY_HORIZONS)
    S["q_sequence"] = R(f"""WITH {daily_n()},
sq AS (SELECT series_id, ts, row_id, n_rows,
  list(list_value({base})) OVER ({W} ROWS BETWEEN 29 PRECEDING AND CURRENT ROW) AS sx, {ys} FROM dn)
SELECT series_id, ts, row_id, len(sx) AS seq_len, coalesce(list_sum(flatten(sx)), 0.0) AS seq_sum,
  len(list_filter(flatten(sx), lambda x: x IS NULL)) AS seq_nulls, y1, y2, y3, y4, y5
FROM sq WHERE len(sx) = 30 AND {DAILY_VALID}""", ["seq_sum", "y1", "y2", "y3", "y4", "y5"])
    S["q_valid"] = f"WITH {daily_n(True)} SELECT series_id, ts, row_id, n_rows FROM dn WHERE {DAILY_VALID}"
    S["q_valid_hourly"] = f"WITH {hourly_n()} SELECT series_id, ts, row_id, n_rows FROM hn WHERE {HOURLY_VALID}"

    hm = ["temp_lag_1", "temp_lag_144", "temp_lag1_rollmean_144", "temp_lag1_rollstd_3", "precip_rollsum_24",
          "target_daily_max_day_1", "target_avg_day_5"]
    S["q_hourly_multi"] = R(f"WITH {hourly_feats(True)} SELECT series_id, ts, row_id, {', '.join(map(q, hm))} FROM hf_all",
                            hm)
    S["q_leakage"] = R(f"WITH {hourly_n()} SELECT series_id, ts, feelslike FROM hn WHERE {HOURLY_VALID}",
                       ["feelslike"])
    S["q_split"] = f"""WITH {daily_n(True)}, {split_cte('dn', DAILY_VALID)}
SELECT series_id, ts, row_id, pos, n_pos, split FROM spl"""
    folds = []
    for i in range(1, 6):
        st = f"(n2 - {6 - i} * blk)"
        folds.append(f"SELECT series_id, ts, row_id, CAST({i} AS BIGINT) AS fold, 'train' AS role FROM tp "
                     f"WHERE blk - 14 > 0 AND pos2 < {st}")
        folds.append(f"SELECT series_id, ts, row_id, CAST({i} AS BIGINT) AS fold, 'val' AS role FROM tp "
                     f"WHERE blk - 14 > 0 AND pos2 >= {st} + 14 AND pos2 < {st} + blk")
    S["q_folds"] = f"""WITH {daily_n()}, {split_cte('dn', DAILY_VALID)},
tp AS (SELECT *, row_id - min(row_id) OVER (PARTITION BY series_id) AS pos2,
  count(*) OVER (PARTITION BY series_id) AS n2, floor(count(*) OVER (PARTITION BY series_id) / 6) AS blk
  FROM spl WHERE split = 'train')
{' UNION ALL '.join(folds)}"""
    S["q_slices"] = f"""WITH {daily_n(True)},
b AS (SELECT *, max(row_id) OVER (PARTITION BY series_id) - row_id AS back FROM dn)
SELECT series_id, ts, CASE WHEN back < 90 THEN 'retrain' ELSE 'validation' END AS slice FROM b WHERE back < 120
UNION ALL SELECT series_id, ts, 'drift_baseline' FROM b WHERE row_id < 30
UNION ALL SELECT series_id, ts, 'last_365' FROM b WHERE back < 365
UNION ALL SELECT series_id, ts, 'history_180' FROM b WHERE back < 180"""
    S["q_backtest"] = R(f"WITH {origin_cte()} SELECT * FROM bt", ["y_true", "y_pred"])
    S["q_backtest_scores"] = R(f"""WITH {origin_cte()}
SELECT model, horizon, {R2} AS r2, avg(abs(y_true - y_pred)) AS mae, sqrt(avg({E2})) AS rmse, count(*) AS n,
  CASE WHEN avg(y_true) <> 0 THEN 100 * (1 - avg(abs(y_true - y_pred)) / avg(y_true)) END AS accuracy
FROM bt GROUP BY model, horizon""", ["r2", "mae", "rmse", "accuracy"])

    # profile
    spec = [("series_id", "string"), ("ts", "date")] + [(c, "float") for c in DAILY_PRESENT] + \
           [("preciptype", "string"), ("conditions", "string"), ("icon", "string"), ("description", "string")]
    stats, longs = [], []
    for c, t in spec:
        num = t == "float"
        mm = (f"CAST(min({c}) AS DOUBLE), CAST(max({c}) AS DOUBLE), avg({c})" if num
              else "CAST(NULL AS DOUBLE), CAST(NULL AS DOUBLE), CAST(NULL AS DOUBLE)")
        stats.append(f"SELECT '{c}' AS column_name, '{t}' AS dtype, count_if({c} IS NULL) AS missing, "
                     f"count(DISTINCT {c}) AS n_unique, {mm} FROM src")
        v = f"CAST(round({c}, 4) AS VARCHAR)" if num else f"CAST({c} AS VARCHAR)"
        longs.append(f"SELECT '{c}' AS column_name, CAST({c} AS VARCHAR) AS raw, {v} AS value, ts AS o FROM src WHERE {c} IS NOT NULL")
    desc = ", ".join("('{}', '{}')".format(a, b.replace("'", "''")) for a, b in COLUMN_DESCRIPTIONS)
    S["q_profile"] = R(f"""WITH src AS ({daily_src()}),
st(column_name, dtype, missing, n_unique, min, max, mean) AS ({' UNION ALL '.join(stats)}),
lo AS ({' UNION ALL '.join(longs)}),
fo AS (SELECT column_name, raw, value, min(o) AS o FROM lo GROUP BY column_name, raw, value),
tp AS (SELECT column_name, string_agg(value, '|' ORDER BY o, raw) AS sample_values FROM
  (SELECT *, row_number() OVER (PARTITION BY column_name ORDER BY o, raw) AS r FROM fo) WHERE r <= 5
  GROUP BY column_name),
dd(column_name, description) AS (VALUES {desc})
SELECT st.*, tp.sample_values, coalesce(dd.description, '') AS description
FROM st LEFT JOIN tp USING (column_name) LEFT JOIN dd USING (column_name)""", ["min", "max", "mean"])

    # preprocessing
    num = ["windspeed", "windspeed_lag_1", "temp_lag_1", "precip_rollsum_7", "temp_rollstd_3"]
    meds = ", ".join(f"median({c}) AS m_{c}" for c in num)
    stat2 = ", ".join(f"avg(coalesce({c}, m_{c})) AS mu_{c}, stddev_pop(coalesce({c}, m_{c})) AS sd_{c}" for c in num)
    scaled = ", ".join(f"(coalesce({c}, m_{c}) - coalesce(mu_{c}, 0.0)) / "
                       f"CASE WHEN sd_{c} IS NULL OR sd_{c} = 0 THEN 1.0 ELSE sd_{c} END AS {c}" for c in num)
    S["q_impute_scale"] = R(f"""WITH {daily_feats()}, {split_cte('df_all', DAILY_VALID)},
md AS (SELECT {meds} FROM spl WHERE split = 'train'),
ms AS (SELECT {stat2} FROM spl, md WHERE split = 'train')
SELECT series_id, ts, split, {scaled} FROM spl, md, ms""", num)
    cats = ["preciptype", "conditions", "icon", "month", "day_of_week", "year"]
    longc = " UNION ALL ".join(f"SELECT series_id, ts, split, '{c}' AS column_name, CAST({c} AS VARCHAR) AS value FROM spl"
                               for c in cats)
    catlong = f"""{daily_feats()}, {split_cte('df_all', DAILY_VALID)},
lc AS ({longc}),
cnt AS (SELECT column_name, value, count(*) AS n FROM lc WHERE split = 'train' AND value IS NOT NULL GROUP BY ALL),
mode AS (SELECT column_name, value AS mode, n AS mode_count FROM
  (SELECT *, row_number() OVER (PARTITION BY column_name ORDER BY n DESC, value ASC) AS r FROM cnt) WHERE r = 1)"""
    S["q_mode"] = f"WITH {catlong} SELECT column_name, mode, mode_count FROM mode"
    S["q_onehot"] = f"""WITH {catlong},
imp AS (SELECT lc.series_id, lc.ts, lc.split, lc.column_name, coalesce(lc.value, mode.mode) AS value
  FROM lc JOIN mode USING (column_name)),
cat AS (SELECT column_name, value, row_number() OVER (PARTITION BY column_name ORDER BY value) - 1 AS idx,
  count(*) OVER (PARTITION BY column_name) AS n_categories
  FROM (SELECT DISTINCT column_name, value FROM imp WHERE split = 'train' AND value IS NOT NULL)),
nc AS (SELECT DISTINCT column_name, n_categories FROM cat)
SELECT imp.series_id, imp.ts, imp.split, imp.column_name, coalesce(cat.idx, -1) AS hot_index, nc.n_categories
FROM imp LEFT JOIN cat USING (column_name, value) JOIN nc USING (column_name)"""
    S["q_tfidf"] = R(r"""WITH tok AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, 'missing')), '[\p{L}\p{N}_]{2,}') AS t
  FROM documents),
terms AS (SELECT doc_id, unnest(t) AS term FROM tok
  UNION ALL SELECT doc_id, unnest(list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1])) AS term FROM tok),
tc AS (SELECT doc_id, term, count(*) AS tf FROM terms GROUP BY doc_id, term),
nd AS (SELECT count(*) AS n FROM documents),
vocab AS (SELECT term, sum(tf) AS cf, count(*) AS df FROM tc GROUP BY term ORDER BY cf DESC, term ASC LIMIT 100),
w AS (SELECT tc.doc_id, tc.term, tc.tf * (ln((1.0 + nd.n) / (1.0 + vocab.df)) + 1.0) AS w
  FROM tc JOIN vocab USING (term), nd)
SELECT doc_id, term, w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)) AS tfidf FROM w""", ["tfidf"])

    # metrics
    mets = ["rmse", "mae", "mape", "r2"]
    macros = ["rmse_macro", "mae_macro", "mape_macro", "r2_macro"]
    S["q_metrics"] = R(f"WITH {per_h_cte()} SELECT * FROM per_h", mets)
    S["q_macro"] = R(f"WITH {per_h_cte()} SELECT * FROM macro", macros)
    S["q_leaderboard"] = R(f"""WITH {per_h_cte()} SELECT model, rmse_macro, mae_macro, mape_macro, r2_macro,
  row_number() OVER (ORDER BY rmse_macro ASC NULLS LAST, model) AS rank FROM macro WHERE split = 'test'""", macros)
    hp = ", ".join(f"max(CASE WHEN horizon = {h} THEN rmse END) AS rmse_h{h}" for h in DAILY_HORIZONS)
    S["q_horizon_pivot"] = R(f"""WITH {per_h_cte()},
lb AS (SELECT model, row_number() OVER (ORDER BY rmse_macro ASC NULLS LAST, model) AS rank FROM macro WHERE split = 'test')
SELECT model, {hp}, lb.rank FROM per_h JOIN lb USING (model) WHERE split = 'test' GROUP BY model, lb.rank""",
                                 [f"rmse_h{h}" for h in DAILY_HORIZONS])
    S["q_best_model"] = R(f"""WITH {per_h_cte()}
SELECT (SELECT model FROM macro WHERE split = 'test' ORDER BY rmse_macro, model LIMIT 1) AS best_model,
  (SELECT min(rmse_macro) FROM macro WHERE split = 'test') AS rmse_macro""", ["rmse_macro"])
    ml = " UNION ALL ".join(f"SELECT model, '{m}' AS metric, {m} AS value FROM macro WHERE split = 'test'" for m in macros)
    S["q_compare"] = R(f"""WITH {per_h_cte()}, ml AS ({ml}),
cmp AS (SELECT b.metric, b.value AS base_value, t.value AS tuned_value,
  CASE WHEN b.value <> 0 THEN (b.value - t.value) / b.value * 100 END AS improvement_pct,
  CASE WHEN b.metric = 'r2_macro' THEN t.value > b.value ELSE t.value < b.value END AS better
  FROM ml b JOIN ml t ON b.metric = t.metric AND b.model = 'persist' AND t.model = 'ens'),
rec AS (SELECT avg(improvement_pct) AS mean_improvement_pct FROM cmp)
SELECT cmp.*, rec.mean_improvement_pct, CASE WHEN rec.mean_improvement_pct > 2 THEN 'use_tuned'
  WHEN rec.mean_improvement_pct > 0 THEN 'consider_tuned' ELSE 'base_sufficient' END AS recommendation
FROM cmp, rec""", ["base_value", "tuned_value", "improvement_pct", "mean_improvement_pct"])
    S["q_compare_horizon"] = R(f"""WITH {per_h_cte()}
SELECT b.horizon, b.rmse AS base_rmse, t.rmse AS tuned_rmse,
  CASE WHEN b.rmse <> 0 THEN (b.rmse - t.rmse) / b.rmse * 100 END AS improvement_pct
FROM per_h b JOIN per_h t ON b.horizon = t.horizon AND b.split = 'test' AND t.split = 'test'
  AND b.model = 'persist' AND t.model = 'ens'""", ["base_rmse", "tuned_rmse", "improvement_pct"])
    gl = " UNION ALL ".join(f"SELECT model, split, '{m}' AS metric, {m} AS value FROM macro"
                            for m in ["rmse_macro", "mae_macro", "r2_macro"])
    S["q_gap"] = R(f"""WITH {per_h_cte()}, gl AS ({gl}),
wd AS (SELECT model, metric, max(CASE WHEN split = 'train' THEN value END) AS train,
  max(CASE WHEN split = 'test' THEN value END) AS test FROM gl GROUP BY model, metric),
g AS (SELECT *, test - train AS difference, abs(test - train) > 0.5 AS overfit_flag,
  max(CASE WHEN metric = 'rmse_macro' THEN test - train END) OVER (PARTITION BY model) AS rd FROM wd)
SELECT model, metric, train, test, difference, overfit_flag,
  CASE WHEN rd > 0.5 THEN 'overfitting' WHEN rd < -0.2 THEN 'unusual' ELSE 'good_generalization' END AS verdict
FROM g""", ["train", "test", "difference"])
    S["q_pooled"] = R(f"""WITH {preds_cte()}
SELECT model, ts, sqrt(avg({E2})) AS rmse, avg(abs(y_true - y_pred)) AS mae, count(*) AS n
FROM pred GROUP BY model, ts""", ["rmse", "mae"])
    cvf = []
    for i in range(1, 6):
        st = f"(n2 - {6 - i} * blk)"
        cvf.append(f"SELECT series_id, row_id, CAST({i} AS BIGINT) AS fold FROM tp "
                   f"WHERE blk - 14 > 0 AND pos2 >= {st} + 14 AND pos2 < {st} + blk")
    S["q_cv"] = R(f"""WITH {preds_cte()},
tr AS (SELECT DISTINCT series_id, row_id FROM pred WHERE split = 'train'),
tp AS (SELECT *, row_id - min(row_id) OVER (PARTITION BY series_id) AS pos2,
  count(*) OVER (PARTITION BY series_id) AS n2, floor(count(*) OVER (PARTITION BY series_id) / 6) AS blk FROM tr),
fv AS ({' UNION ALL '.join(cvf)}),
pf AS (SELECT p.*, fv.fold FROM pred p JOIN fv USING (series_id, row_id) WHERE p.split = 'train'),
fm AS (SELECT model, fold, horizon, {METRIC_AGGS} FROM pf GROUP BY model, fold, horizon),
fl AS ({' UNION ALL '.join(f"SELECT model, fold, horizon, '{m}' AS metric, {m} AS value FROM fm" for m in mets)})
SELECT model, horizon, metric, avg(value) AS value, count(DISTINCT fold) AS n_folds
FROM fl GROUP BY model, horizon, metric""", ["value"])
    S["q_monthly"] = R(f"""WITH {test_res()}
SELECT model, month(ts) AS month, avg(residual) AS mean, stddev_samp(residual) AS std, count(*) AS count
FROM res WHERE horizon = 1 GROUP BY model, month(ts)""", ["mean", "std"])
    box = ["min", "q1", "median", "q3", "max"]
    S["q_box"] = R(f"""WITH {test_res()}
SELECT model, month(ts) AS month, quantile_cont(residual, 0.0) AS min, quantile_cont(residual, 0.25) AS q1,
  quantile_cont(residual, 0.5) AS median, quantile_cont(residual, 0.75) AS q3, quantile_cont(residual, 1.0) AS max
FROM res WHERE horizon = 1 GROUP BY model, month(ts)""", box)
    he = f"""{test_res()},
r1 AS (SELECT *, abs(residual) AS abs_residual FROM res WHERE horizon = 1),
th AS (SELECT model, quantile_cont(abs_residual, 0.9) AS threshold FROM r1 GROUP BY model),
fl AS (SELECT r1.*, th.threshold, r1.abs_residual > th.threshold AS high_error FROM r1 JOIN th USING (model))"""
    S["q_high_error"] = R(f"""WITH {he}
SELECT model, max(threshold) AS threshold, count(CASE WHEN high_error THEN 1 END) AS n_high,
  min(CASE WHEN high_error THEN ts END) AS first_ts, max(CASE WHEN high_error THEN ts END) AS last_ts
FROM fl GROUP BY model""", ["threshold"])
    S["q_high_error_rows"] = R(f"""WITH {he}
SELECT model, series_id, ts, y_true, y_pred, residual, high_error FROM fl""", ["y_true", "y_pred", "residual"])
    S["q_abs_by_h"] = R(f"""WITH {test_res()}
SELECT model, horizon, avg(abs(residual)) AS mean_abs_error FROM res GROUP BY model, horizon""", ["mean_abs_error"])
    S["q_moments"] = R(f"""WITH {test_res()},
m AS (SELECT model, horizon, count(residual) AS n, avg(residual) AS mean, stddev_pop(residual) AS std,
  skewness(residual) AS skewness, kurtosis(residual) AS kurtosis FROM res GROUP BY model, horizon)
SELECT *, CASE WHEN skewness > 0 THEN 'right-skewed' ELSE 'left-skewed' END AS skew_label,
  CASE WHEN kurtosis > 0 THEN 'heavy-tailed' ELSE 'light-tailed' END AS tail_label,
  CASE WHEN abs(mean) < 0.1 THEN 'low' WHEN abs(mean) < 0.5 THEN 'moderate' ELSE 'high' END AS bias_label
FROM m""", ["mean", "std", "skewness", "kurtosis"])
    S["q_hist"] = R(f"""WITH {test_res()},
st AS (SELECT model, horizon, min(residual) AS mn, max(residual) AS mx, count(residual) AS n FROM res GROUP BY ALL),
b AS (SELECT res.model, res.horizon, st.mn, st.mx, st.n,
  CAST(CASE WHEN (st.mx - st.mn) / 50 > 0 THEN least(50, floor((res.residual - st.mn) / ((st.mx - st.mn) / 50)) + 1)
    ELSE 1 END AS BIGINT) AS bin
  FROM res JOIN st USING (model, horizon)),
h AS (SELECT model, horizon, bin, count(*) AS count, max(mn) AS mn, max(mx) AS mx, max(n) AS n FROM b GROUP BY ALL)
SELECT model, horizon, bin, count, mn + (bin - 1) * ((mx - mn) / 50) AS bin_lo, mn + bin * ((mx - mn) / 50) AS bin_hi,
  CASE WHEN (mx - mn) / 50 > 0 THEN count / (n * ((mx - mn) / 50)) END AS density FROM h""",
                   ["bin_lo", "bin_hi", "density"])
    bv = f"""{preds_cte()},
t AS (SELECT model, horizon, avg({E2}) AS mse, pow(avg(y_pred) - avg(y_true), 2) AS bias_sq,
  var_pop(y_pred) AS variance, var_pop(y_true) AS irreducible FROM pred WHERE split = 'test' GROUP BY model, horizon),
t2 AS (SELECT *, CASE WHEN mse > 0 THEN bias_sq / mse * 100 ELSE 0.0 END AS bias_pct,
  CASE WHEN mse > 0 THEN variance / mse * 100 ELSE 0.0 END AS variance_pct FROM t)"""
    S["q_biasvar"] = R(f"WITH {bv} SELECT * FROM t2",
                       ["mse", "bias_sq", "variance", "irreducible", "bias_pct", "variance_pct"])
    S["q_biasvar_verdict"] = R(f"""WITH {bv},
v AS (SELECT model, avg(bias_pct) AS mean_bias_pct, avg(variance_pct) AS mean_variance_pct FROM t2 GROUP BY model)
SELECT *, CASE WHEN mean_bias_pct > 60 THEN 'underfitting' WHEN mean_variance_pct > 60 THEN 'overfitting'
  ELSE 'balanced' END AS verdict FROM v""", ["mean_bias_pct", "mean_variance_pct"])
    S["q_range_stats"] = R(f"""WITH {daily_n(True)}
SELECT series_id, avg(temp) AS mean, max(temp) AS max, min(temp) AS min, count(*) AS n FROM dn
WHERE ts BETWEEN DATE '1996-01-01' AND DATE '1997-12-31' GROUP BY series_id""", ["mean", "max", "min"])
    band = ("CASE WHEN {x} IS NULL THEN NULL WHEN {x} < 20 THEN 'Cool' WHEN {x} < 25 THEN 'Pleasant' "
            "WHEN {x} < 30 THEN 'Warm' ELSE 'Hot' END")
    S["q_latest"] = R(f"""WITH {daily_n(True)},
l2 AS (SELECT *, temp - lag(temp) OVER ({W}) AS temp_delta, humidity - lag(humidity) OVER ({W}) AS humidity_delta
  FROM dn)
SELECT series_id, ts, row_id, temp, humidity, temp_delta, humidity_delta, {band.format(x='temp')} AS band,
  CASE WHEN precip > 0 THEN printf('%.1f mm', precip) ELSE 'Clear' END AS precip_label
FROM l2 WHERE row_id = n_rows - 1""", ["temp", "humidity", "temp_delta", "humidity_delta"])
    S["q_last_n"] = R(f"WITH {daily_n(True)} SELECT series_id, ts, row_id, temp FROM dn WHERE row_id >= n_rows - 14",
                      ["temp"])
    S["q_forecast"] = R(f"""WITH {origin_cte()},
e AS (SELECT series_id, ts AS origin_ts, horizon, avg(y_pred) AS y_pred FROM fc WHERE row_id = n_rows - 1
  GROUP BY series_id, ts, horizon)
SELECT *, origin_ts + CAST(horizon AS INTEGER) AS forecast_date, {band.format(x='y_pred')} AS band FROM e""",
                        ["y_pred"])

    # monitoring
    S["q_log"] = R(f"WITH {log_cte()} SELECT * FROM lg", LOG_DBL)
    trig = f"""{log_cte()},
t AS (SELECT ts, day_index,
  avg(degradation) OVER (ORDER BY day_index ROWS BETWEEN 29 PRECEDING AND CURRENT ROW) AS mean_degradation_30,
  avg(CAST(alert AS DOUBLE)) OVER (ORDER BY day_index ROWS BETWEEN 6 PRECEDING AND CURRENT ROW) AS alert_rate_7
  FROM lg),
t2 AS (SELECT *, day_index >= 30 AND mean_degradation_30 > 0.15 AS t1, day_index >= 30 AND alert_rate_7 >= 0.7 AS t2,
  day_index >= 30 AND day_index >= 90 AS t4 FROM t)"""
    S["q_triggers"] = R(f"""WITH {trig}
SELECT ts, day_index, mean_degradation_30, alert_rate_7,
  concat_ws(',', CASE WHEN t1 THEN 'sustained_degradation' END, CASE WHEN t2 THEN 'alert_spike' END,
    CASE WHEN t4 THEN 'scheduled_maintenance' END) AS reasons,
  coalesce(t1, false) OR coalesce(t2, false) OR coalesce(t4, false) AS should_retrain FROM t2""",
                        ["mean_degradation_30", "alert_rate_7"])
    ar = f"""CASE WHEN count(CAST(alert AS DOUBLE)) OVER (ORDER BY day_index ROWS BETWEEN 29 PRECEDING AND CURRENT ROW) = 30
  THEN avg(CAST(alert AS DOUBLE)) OVER (ORDER BY day_index ROWS BETWEEN 29 PRECEDING AND CURRENT ROW) * 100 END"""
    S["q_alert_rate"] = R(f"WITH {log_cte()} SELECT ts, day_index, {ar} AS alert_rate_30 FROM lg", ["alert_rate_30"])
    S["q_report"] = R(f"""WITH {log_cte()}
SELECT count(*) AS n_predictions, avg(rmse) AS mean_rmse, avg(degradation) * 100 AS mean_degradation_pct,
  avg(CAST(alert AS DOUBLE)) * 100 AS alert_rate_pct, CAST(0 AS BIGINT) AS n_retrains, CAST(0 AS BIGINT) AS n_adopted,
  CAST(0 AS BIGINT) AS n_rejected, CAST(NULL AS DOUBLE) AS mean_adopted_improvement FROM lg""",
                      ["mean_rmse", "mean_degradation_pct", "alert_rate_pct", "mean_adopted_improvement"])
    S["q_dashboard"] = R(f"""WITH {log_cte()}
SELECT *, {ar} AS alert_rate_30, CAST(NULL AS BOOLEAN) AS retrain_adopted, 0.15::DOUBLE AS threshold FROM lg WHERE (SELECT count(*) FROM lg) >= 10""",
                         LOG_DBL + ["alert_rate_30", "threshold"])
    ks_cols = [c for c in (["temp", "tempmax", "tempmin", "humidity", "precip", "windspeed", "cloudcover",
                            "severerisk"] + [n for n, _ in daily_feature_cols()]) if not c.startswith("target_")]
    unp = " UNION ALL ".join(f"SELECT series_id, side, '{c}' AS column_name, CAST({q(c)} AS DOUBLE) AS value FROM sides"
                             for c in ks_cols)
    S["q_ks"] = R(f"""WITH {daily_feats(True)}, {split_cte('df_all', DAILY_VALID)},
tr AS (SELECT *, row_id - min(row_id) OVER (PARTITION BY series_id) AS p2,
  max(row_id) OVER (PARTITION BY series_id) - row_id AS b2 FROM spl WHERE split = 'train'),
sides AS (SELECT *, 0 AS side FROM tr WHERE p2 < 30 UNION ALL SELECT *, 1 AS side FROM tr WHERE b2 < 30),
lo AS (SELECT * FROM ({unp}) WHERE value IS NOT NULL AND NOT isnan(value)),
pv AS (SELECT series_id, column_name, value, CAST(sum(CASE WHEN side = 0 THEN 1 ELSE 0 END) AS BIGINT) AS ca,
  CAST(sum(CASE WHEN side = 1 THEN 1 ELSE 0 END) AS BIGINT) AS cb FROM lo GROUP BY ALL),
cu AS (SELECT *, sum(ca) OVER (PARTITION BY series_id, column_name) AS n_base,
  sum(cb) OVER (PARTITION BY series_id, column_name) AS n_recent,
  sum(ca) OVER (PARTITION BY series_id, column_name ORDER BY value ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS fa,
  sum(cb) OVER (PARTITION BY series_id, column_name ORDER BY value ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS fb
  FROM pv),
ks AS (SELECT series_id, column_name, CAST(max(n_base) AS BIGINT) AS n_base, CAST(max(n_recent) AS BIGINT) AS n_recent,
  CAST(max(abs(fa * n_recent - fb * n_base)) AS BIGINT) AS k_stat FROM cu GROUP BY series_id, column_name)
SELECT *, k_stat / (n_base * n_recent) AS d_stat, n_base = 30 AND n_recent = 30 AND k_stat >= 330 AS drifted_30
FROM ks WHERE n_base > 0 AND n_recent > 0""", ["d_stat"])
    # exact two-sided p < 0.05 for n = m = 30 is D >= 11/30
    S["q_drift"] = f"""WITH k AS ({S['q_ks']})
SELECT series_id, count(CASE WHEN p THEN 1 END) AS n_drifted, count(*) AS n_tested, count(CASE WHEN p THEN 1 END) >= 3 AS drift
FROM (SELECT *, {ks_significant()} AS p FROM k) GROUP BY series_id"""

    S["q_csv_rejects"] = R(f"""WITH s AS (SELECT series_id, ts, temp, day(ts) AS at FROM ({daily_src('o_orderpriority')})),
m AS (SELECT *, CASE WHEN at IN (7, 9) THEN 'fields' WHEN at = 3 THEN 'datetime' WHEN at = 5 THEN 'number'
  ELSE CAST(year(ts) AS VARCHAR) END AS part FROM s)
SELECT series_id, part, count(*) AS n, sum(CASE WHEN at NOT IN (3, 5, 7, 9) THEN temp END) AS total FROM m GROUP BY series_id, part""", ["total"])
    day_cols = ["temp", "tempmax", "tempmin", "humidity", "precip"]
    unpivoted = " UNION ALL ".join(f"SELECT series_id, row_id, n_rows, '{c}' AS column_name, {c} AS value FROM dn" for c in day_cols)
    S["q_drift_by_day"] = f"""WITH {daily_n(True)}, u AS ({unpivoted}),
days AS (SELECT series_id, row_id AS pos, CAST(row_id - floor(n_rows * 0.8) AS BIGINT) AS day_index FROM dn WHERE row_id >= floor(n_rows * 0.8)),
pts AS (SELECT d.series_id, day_index, pos, column_name, value, 1 AS a, 0 AS b FROM days d JOIN u ON u.series_id = d.series_id AND u.row_id < 30
  UNION ALL SELECT d.series_id, day_index, pos, column_name, value, 0, 1 FROM days d JOIN u ON u.series_id = d.series_id AND u.row_id BETWEEN d.pos - 30 AND d.pos - 1),
pv AS (SELECT series_id, day_index, pos, column_name, value, sum(a) AS ca, sum(b) AS cb FROM pts GROUP BY ALL),
cu AS (SELECT *, sum(ca) OVER g AS n_base, sum(cb) OVER g AS n_recent, sum(ca) OVER o AS fa, sum(cb) OVER o AS fb FROM pv
  WINDOW g AS (PARTITION BY series_id, day_index, column_name), o AS (PARTITION BY series_id, day_index, column_name ORDER BY value)),
ks AS (SELECT series_id, day_index, pos, column_name, max(n_base) AS n_base, max(n_recent) AS n_recent, max(abs(fa * n_recent - fb * n_base)) AS k_stat
  FROM cu GROUP BY ALL)
SELECT series_id, day_index, count(CASE WHEN p THEN 1 END) AS n_drifted, count(*) AS n_tested, count(CASE WHEN p THEN 1 END) >= 3 AND max(pos) >= 60 AS drift
FROM (SELECT *, {ks_significant()} AS p FROM ks WHERE n_base > 0 AND n_recent > 0) GROUP BY series_id, day_index"""

    # slices, rejects, many series
    S["q_slice_functions"] = f"""WITH {daily_n(True)},
b AS (SELECT *, max(row_id) OVER (PARTITION BY series_id) - row_id AS back FROM dn)
SELECT series_id, ts, CASE WHEN back < 30 THEN 'validation' ELSE 'retrain' END AS slice FROM b WHERE back < 120
UNION ALL SELECT series_id, ts, 'drift_baseline' FROM b WHERE row_id < 30
UNION ALL SELECT series_id, ts, 'tail_365' FROM b WHERE back >= 5 AND back < 370
UNION ALL SELECT series_id, ts, 'history_180' FROM b WHERE back < 180"""
    cust = daily_src("CAST(o_custkey AS VARCHAR)")
    S["q_rejects"] = f"""WITH s AS (SELECT nullif(series_id, '7') AS series_id, ts FROM ({cust})),
g AS (SELECT series_id, count(*) AS n, count(CASE WHEN series_id IS NULL OR ts IS NULL THEN 1 END) AS nulls FROM s GROUP BY series_id)
SELECT series_id, 'null_key' AS reason, nulls AS n_rows FROM g WHERE nulls > 0
UNION ALL SELECT series_id, 'short_series', n FROM g WHERE n <= 35"""
    dc = dict(daily_feature_cols())
    lc = ["temp_diff_1", "temp_lag_1", "precip_lag_3", "temp_rollmean_3", "precip_rollsum_7", "target_temp_t+1"]
    S["q_lag_customers"] = R(f"""WITH {numbered(cust, DAILY_PRESENT, 'dn')}
SELECT series_id, ts, row_id, n_rows, {', '.join(f'{dc[c]} AS {q(c)}' for c in lc)} FROM dn""", lc)
    hc = dict(hourly_feature_cols())
    uc = ["temp_lag_24", "temp_lag1_rollmean_24", "temp_lag1_rollstd_3", "precip_rollsum_48", "target_daily_max_day_1"]
    S["q_roll_users"] = R(f"""WITH {numbered(hourly_src('CAST(user_id AS VARCHAR)'), ['temp'] + HOURLY_PRESENT, 'hn')}
SELECT series_id, ts, row_id, n_rows, {', '.join(f'{hc[c]} AS {q(c)}' for c in uc)} FROM hn""", uc)

    # text fitted on the train days, applied to the test days
    S["q_tfidf_fitted"] = R(r"""WITH src AS (SELECT ts, coalesce(description, '') AS text, row_number() OVER (ORDER BY ts) - 1 AS row_id,
  count(*) OVER () AS n FROM (""" + daily_src() + r""")),
sp AS (SELECT ts, text, row_id - 30 AS pos, floor((n - 35) * 0.85) AS cut FROM src WHERE row_id >= 30 AND row_id < n - 5),
tok AS (SELECT ts, pos < cut AS train, regexp_extract_all(lower(text), '[\p{L}\p{N}_]{2,}') AS t FROM sp WHERE pos < cut OR pos >= cut + 14),
terms AS (SELECT ts, train, unnest(t) AS term FROM tok
  UNION ALL SELECT ts, train, unnest(list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1])) AS term FROM tok),
tc AS (SELECT ts, train, term, count(*) AS tf FROM terms GROUP BY ts, train, term),
nd AS (SELECT count(*) AS n FROM tok WHERE train),
vocab AS (SELECT term, sum(tf) AS cf, count(*) AS df FROM tc WHERE train GROUP BY term ORDER BY cf DESC, term ASC LIMIT 100),
w AS (SELECT tc.ts, tc.term, tc.tf * (ln((1.0 + nd.n) / (1.0 + vocab.df)) + 1.0) AS w
  FROM tc JOIN vocab USING (term), nd WHERE NOT tc.train)
SELECT ts, term, w / sqrt(sum(w * w) OVER (PARTITION BY ts)) AS tfidf FROM w""", ["tfidf"])
    cats = ["month", "day_of_week", "year", "preciptype", "conditions", "icon"]
    roles = ([(c, "numeric") for c in DAILY_PRESENT] + [(n, "numeric") for n, _ in daily_feature_cols()
             if not n.startswith("target_") and n not in cats] + [(c, "categorical") for c in cats] + [("description", "text")])
    # the description is filled, so it is never NULL
    S["q_roles"] = f"WITH {daily_feats()} " + " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, '{r}' AS role, count({'*' if c == 'description' else q(c)}) AS n_values FROM df_all WHERE {DAILY_VALID}"
        for c, r in roles)

    # sources and scalars
    S["q_days_json"] = R(f"""SELECT series_id, ts, temp, precip, coalesce(preciptype, 'none') AS preciptype,
  conditions || ',' || icon AS stations FROM ({daily_src('o_orderpriority')})""", ["temp", "precip"])
    S["q_serving_rows"] = R(f"""SELECT series_id, ts, conditions AS stations, 'none' AS tags, CAST(length('{{k -> ' || icon || '}}') AS BIGINT) AS extra_length,
  windspeed AS windspeedmax, windspeed AS windspeedmean, windspeed AS windspeedmin, 1013.25::DOUBLE AS sealevelpressure
FROM ({daily_src()})""", ["windspeedmax", "windspeedmean", "windspeedmin", "sealevelpressure"])
    S["q_sun"] = R("""WITH g AS (SELECT user_id, CAST(ts AS DATE) AS day, min(ts) AS a, max(ts) AS b, max(value) AS top FROM events GROUP BY ALL)
SELECT user_id, day, hour(a) * 60 + minute(a) AS sunrise_minutes, hour(b) * 60 + minute(b) AS sunset_minutes,
  (epoch_us(b) - epoch_us(a)) / 60e6 AS day_length_minutes,
  CASE WHEN top < 25 THEN 'low' WHEN top < 30 THEN 'mid' ELSE 'high' END AS severity FROM g""", ["day_length_minutes"])

    # monitoring with retrain events
    ev = "ev AS (SELECT day_index, NOT alert AS adopted, CASE WHEN NOT alert THEN -degradation * 100 END AS improvement FROM lg WHERE day_index % 40 = 0)"
    last = "max(ev.day_index) OVER (ORDER BY t.day_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    why = ("concat_ws(',', CASE WHEN t1 THEN 'sustained_degradation' END, CASE WHEN t2 THEN 'alert_spike' END{drift}, "
           "CASE WHEN {t4} THEN 'scheduled_maintenance' END)")
    t4 = "day_index >= 30 AND day_index - coalesce(last_retrain, 0) >= 90"
    S["q_triggers_history"] = f"""WITH {trig}, {ev},
h AS (SELECT t.*, {last} AS last_retrain FROM t2 t LEFT JOIN ev USING (day_index)),
r AS (SELECT *, {why.format(drift='', t4=t4)} AS reasons FROM h)
SELECT ts, day_index, last_retrain, reasons, reasons <> '' AS should_retrain FROM r"""
    S["q_triggers_drift"] = f"""WITH {trig},
r AS (SELECT *, {why.format(drift=", CASE WHEN day_index >= 30 AND day_index % 10 = 0 THEN 'distribution_drift' END", t4='t4')} AS reasons FROM t2)
SELECT ts, day_index, reasons, reasons <> '' AS should_retrain FROM r"""
    rep = """count(*) AS n_predictions, avg(rmse) AS mean_rmse, avg(degradation) * 100 AS mean_degradation_pct,
  avg(CAST(alert AS DOUBLE)) * 100 AS alert_rate_pct"""
    evs = """count(*) AS n_retrains, count(CASE WHEN adopted THEN 1 END) AS n_adopted, count(CASE WHEN NOT adopted THEN 1 END) AS n_rejected,
  avg(CASE WHEN adopted THEN improvement END) AS mean_adopted_improvement"""
    rep_dbl = ["mean_rmse", "mean_degradation_pct", "alert_rate_pct", "mean_adopted_improvement"]
    S["q_report_history"] = R(f"""WITH {log_cte()}, {ev}, a AS (SELECT {rep} FROM lg), b AS (SELECT {evs} FROM ev)
SELECT * FROM a, b""", rep_dbl)
    S["q_dashboard_events"] = R(f"""WITH {log_cte()}, {ev}
SELECT lg.*, {ar} AS alert_rate_30, ev.adopted AS retrain_adopted, 0.15::DOUBLE AS threshold
FROM lg LEFT JOIN ev USING (day_index) WHERE (SELECT count(*) FROM lg) >= 10""", LOG_DBL + ["alert_rate_30", "threshold"])
    by = f"""{preds_cte(True)},
sb AS (SELECT series_id, avg(rmse) AS base_rmse FROM (SELECT series_id, horizon, sqrt(avg({E2})) AS rmse FROM pred
  WHERE model = 'ens' AND split = 'train' GROUP BY series_id, horizon) GROUP BY series_id),
sg AS (SELECT series_id, ts, sqrt(avg({E2})) AS rmse, avg(abs(y_true - y_pred)) AS mae FROM pred
  WHERE model = 'ens' AND split = 'test' GROUP BY series_id, ts),
lg AS (SELECT series_id, ts, rmse, mae, base_rmse, (rmse - base_rmse) / nullif(base_rmse, 0) AS degradation,
  coalesce((rmse - base_rmse) / nullif(base_rmse, 0) > 0.15, false) AS alert,
  row_number() OVER (PARTITION BY series_id ORDER BY ts) AS day_index FROM sg JOIN sb USING (series_id)),
ev AS (SELECT series_id, day_index, NOT alert AS adopted, CASE WHEN NOT alert THEN -degradation * 100 END AS improvement
  FROM lg WHERE day_index % 40 = 0)"""
    sw = "OVER (PARTITION BY lg.series_id ORDER BY lg.day_index ROWS BETWEEN {} PRECEDING AND {})"
    S["q_triggers_by_series"] = R(f"""WITH {by},
h AS (SELECT lg.*, lg.day_index >= 30 AND avg(lg.degradation) {sw.format(29, 'CURRENT ROW')} > 0.15 AS t1,
  lg.day_index >= 30 AND avg(CAST(lg.alert AS DOUBLE)) {sw.format(6, 'CURRENT ROW')} >= 0.7 AS t2,
  max(ev.day_index) {sw.format('UNBOUNDED', '1 PRECEDING')} AS last_retrain FROM lg LEFT JOIN ev USING (series_id, day_index)),
r AS (SELECT *, {why.format(drift='', t4=t4)} AS reasons FROM h)
SELECT series_id, ts, day_index, degradation, last_retrain, reasons, reasons <> '' AS should_retrain FROM r""", ["degradation"])
    S["q_report_by_series"] = R(f"""WITH {by}, a AS (SELECT series_id, {rep} FROM lg GROUP BY series_id),
b AS (SELECT series_id, {evs} FROM ev GROUP BY series_id)
SELECT a.*, coalesce(n_retrains, 0) AS n_retrains, coalesce(n_adopted, 0) AS n_adopted, coalesce(n_rejected, 0) AS n_rejected,
  mean_adopted_improvement FROM a LEFT JOIN b USING (series_id)""", rep_dbl)
    return S


def ks_significant() -> str:
    """Exact two-sided p < 0.05 as a condition on (n_base, n_recent, k_stat).

    Columns with NULLs have fewer than 30 values a side; the least significant k of each pair
    of sizes from 8 to 30 comes from a lattice path count (330 for 30 and 30)."""
    from math import comb

    def p_value(n, m, k):
        paths = [0] * (m + 1)
        for i in range(n + 1):
            for j in range(m + 1):
                new = 1 if i == j == 0 else (paths[j] if i else 0) + (paths[j - 1] if j else 0)
                paths[j] = new if abs(i * m - j * n) < k else 0
        return 1 - paths[m] / comb(n + m, n)
    cases = []
    for n in range(8, 31):
        for m in range(8, n + 1):
            lo, hi = 1, n * m
            while lo < hi:
                mid = (lo + hi) // 2
                lo, hi = (lo, mid) if p_value(n, m, mid) < 0.05 else (mid + 1, hi)
            cases.append(f"WHEN greatest(n_base, n_recent) = {n} AND least(n_base, n_recent) = {m} THEN k_stat >= {lo}")
    return "CASE " + " ".join(cases) + " END"


SQL = _sql()
