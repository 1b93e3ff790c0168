"""Error metrics and residual analysis (A1-A25) over the long prediction table

    predictions(model, split, series_id, ts, horizon, y_true, y_pred)

Every metric is a single-pass grouped aggregate (partial aggregation runs
map-side; the group count is models x splits x horizons), so a group that
holds a third of all rows costs no more than any other.  Quantiles use
:func:`exact_quantiles`, which counts equal values first, narrows the range of
each wanted rank by counting, and sorts only small ranges.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MODEL, SPLIT, HORIZON = "model", "split", "horizon"
Y, P = "y_true", "y_pred"
MAPE_EPS = 1e-6
METRICS = ["rmse", "mae", "mape", "r2"]


def _err() -> Column:
    return F.col(Y) - F.col(P)


def r2_expr(sse: Column, sst: Column) -> Column:
    """R^2 = 1 - SSE/SST; constant truth: 1 if SSE == 0 else 0."""
    return (F.when(sst > 0, 1 - sse / sst)
             .when(sse == 0, F.lit(1.0)).otherwise(F.lit(0.0)))


def metric_aggs() -> list[Column]:
    e = _err()
    y = F.col(Y)
    sse = F.sum(e * e)
    sst = F.var_pop(y) * F.count(y)
    return [F.count(F.lit(1)).alias("n"),
            F.sqrt(F.avg(e * e)).alias("rmse"),
            F.avg(F.abs(e)).alias("mae"),
            (F.avg(F.when(F.abs(y) > MAPE_EPS, F.abs(e / y))) * 100).alias("mape"),
            r2_expr(sse, sst).alias("r2")]


def metrics_by_horizon(pred: DataFrame, by=(MODEL, SPLIT)) -> DataFrame:
    """A1-A4: RMSE, MAE, MAPE (x100, |y|>1e-6 rows; none -> NULL), R^2 per horizon."""
    return pred.groupBy(*by, HORIZON).agg(*metric_aggs())


def macro(per_h: DataFrame, by=(MODEL, SPLIT)) -> DataFrame:
    """A5: mean of per-horizon values (``avg`` skips NULL MAPE)."""
    return per_h.groupBy(*by).agg(*[F.avg(m).alias(f"{m}_macro") for m in METRICS])


def to_long(per_h: DataFrame, by=(MODEL, SPLIT), fold_col: str | None = None) -> DataFrame:
    """Long metrics table ``(model, split, fold, horizon, metric, value)``."""
    keys = list(by) + ([fold_col] if fold_col else []) + [HORIZON]
    stack = "stack(4, 'rmse', rmse, 'mae', mae, 'mape', mape, 'r2', r2) as (metric, value)"
    return per_h.selectExpr(*keys, stack)


def fold_mean(fold_long: DataFrame, by=(MODEL,)) -> DataFrame:
    """Mean over CV folds, NULL ignored; no folds -> no rows."""
    return (fold_long.groupBy(*by, HORIZON, "metric")
                     .agg(F.avg("value").alias("value"), F.countDistinct("fold").alias("n_folds")))


def leaderboard(macros: DataFrame, split: str = "test") -> DataFrame:
    """Test macros, ascending RMSE, with rank."""
    w = Window.orderBy(F.col("rmse_macro").asc_nulls_last(), F.col(MODEL))
    return (macros.where(F.col(SPLIT) == split).drop(SPLIT)
                  .withColumn("rank", F.row_number().over(w)))


def horizon_pivot(per_h: DataFrame, horizons, split: str = "test", metric: str = "rmse") -> DataFrame:
    """Model x horizon table of one metric (columns ``rmse_h{h}``), with the
    leaderboard rank of the model."""
    t = per_h.where(F.col(SPLIT) == split)
    wide = (t.groupBy(MODEL).pivot(HORIZON, list(horizons)).agg(F.first(metric)))
    wide = wide.select(MODEL, *[F.col(str(h)).alias(f"{metric}_h{h}") for h in horizons])
    order = leaderboard(macro(t)).select(MODEL, "rank")
    return wide.join(order, MODEL, "left")


def pooled_by_time(pred: DataFrame, by=(MODEL,), time_col: str = "ts") -> DataFrame:
    """RMSE/MAE of every prediction made on one day, all horizons (and
    series) pooled."""
    e = _err()
    return pred.groupBy(*by, time_col).agg(F.sqrt(F.avg(e * e)).alias("rmse"),
                                           F.avg(F.abs(e)).alias("mae"),
                                           F.count(F.lit(1)).alias("n"))


def improvement(base: Column, new: Column) -> Column:
    return F.when(base != 0, (base - new) / base * 100)


def compare_models(macros: DataFrame, per_h: DataFrame, base: str, tuned: str,
                   split: str = "test") -> tuple[DataFrame, DataFrame, DataFrame]:
    """Improvement % of ``tuned`` over ``base`` for the four macros
    (sign not flipped for R^2, as in the reference) and per-horizon RMSE, plus
    the recommendation from the mean improvement (>2 use, >0 consider, else base)."""
    m = macros.where((F.col(SPLIT) == split) & F.col(MODEL).isin(base, tuned))
    long = m.selectExpr(MODEL, "stack(4, 'rmse_macro', rmse_macro, 'mae_macro', mae_macro, "
                               "'mape_macro', mape_macro, 'r2_macro', r2_macro) as (metric, value)")

    def side(model, name):
        return F.max(F.when(F.col(MODEL) == model, F.col("value"))).alias(name)
    both = F.count_if(F.col(MODEL) == base) * F.count_if(F.col(MODEL) == tuned) > 0
    cmp = (long.groupBy("metric").agg(side(base, "base_value"), side(tuned, "tuned_value"), both.alias("_both")).where("_both").drop("_both")
               .withColumn("improvement_pct", improvement(F.col("base_value"), F.col("tuned_value"))))
    cmp = cmp.withColumn("better", F.when(F.col("metric") == "r2_macro", F.col("tuned_value") > F.col("base_value"))
                                    .otherwise(F.col("tuned_value") < F.col("base_value")))
    rec = recommended(cmp).select("mean_improvement_pct", "recommendation").distinct()
    ph = per_h.where((F.col(SPLIT) == split) & F.col(MODEL).isin(base, tuned)).withColumn("value", F.col("rmse"))
    hcmp = (ph.groupBy(HORIZON).agg(side(base, "base_rmse"), side(tuned, "tuned_rmse"), both.alias("_both")).where("_both").drop("_both")
              .withColumn("improvement_pct", improvement(F.col("base_rmse"), F.col("tuned_rmse"))))
    return cmp, hcmp, rec


def recommended(cmp: DataFrame) -> DataFrame:
    """The comparison's rows (four) with the mean improvement and the recommendation."""
    mean = F.avg("improvement_pct").over(Window.partitionBy(F.lit(0)))
    return cmp.withColumn("mean_improvement_pct", mean).withColumn(
        "recommendation", F.when(F.col("mean_improvement_pct") > 2, "use_tuned")
                           .when(F.col("mean_improvement_pct") > 0, "consider_tuned").otherwise("base_sufficient"))


def train_test_gap(macros: DataFrame) -> DataFrame:
    """Test - train difference of RMSE/MAE/R^2 macros, ``overfit_flag`` when
    |diff| > 0.5, and the RMSE verdict (>0.5 overfit, < -0.2 unusual, else good)."""
    long = macros.selectExpr(MODEL, SPLIT, "stack(3, 'rmse_macro', rmse_macro, 'mae_macro', mae_macro, "
                                           "'r2_macro', r2_macro) as (metric, value)")
    wide = (long.groupBy(MODEL, "metric")
                .agg(F.max(F.when(F.col(SPLIT) == "train", F.col("value"))).alias("train"),
                     F.max(F.when(F.col(SPLIT) == "test", F.col("value"))).alias("test")))
    diff = F.col("test") - F.col("train")
    out = wide.withColumn("difference", diff).withColumn("overfit_flag", F.abs(diff) > 0.5)
    rmse_diff = F.max(F.when(F.col("metric") == "rmse_macro", diff)).over(Window.partitionBy(MODEL))
    return out.withColumn("verdict", F.when(rmse_diff > 0.5, "overfitting")
                                       .when(rmse_diff < -0.2, "unusual")
                                       .otherwise("good_generalization"))


# ------------------------------------------------------------ residual analysis

def residuals(pred: DataFrame) -> DataFrame:
    """``residual = y_true - y_pred``."""
    return pred.withColumn("residual", _err())


def monthly_residuals(pred: DataFrame, horizon: int = 1, by=(MODEL,)) -> DataFrame:
    """Residual mean, sample std, count per calendar month (horizon 1)."""
    r = residuals(pred).where(F.col(HORIZON) == horizon)
    return (r.groupBy(*by, F.month("ts").alias("month"))
             .agg(F.avg("residual").alias("mean"), F.stddev_samp("residual").alias("std"),
                  F.count(F.lit(1)).alias("count")))


QUANTILE_BINS = 1024
# Distinct values that one bin may still hold when it is sorted.
SORTED_VALUES = 2048
# Rows of (group, rank) targets that are broadcast; more are joined by key.
BROADCAST_TARGETS = 50_000


def _same(left: list[str], right: list[str]) -> Column:
    """Null-safe equality of two lists of columns."""
    out = F.lit(True)
    for x, y in zip(left, right):
        out = out & F.col(x).eqNullSafe(F.col(y))
    return out


def exact_quantiles(df: DataFrame, keys, value: str, probs, names=None) -> DataFrame:
    """Exact quantiles with linear interpolation (numpy ``percentile`` /
    DuckDB ``quantile_cont``) per group; NULL values are left out.

    1. Equal values are counted (combined map-side) and the counts written
       once: the only read of the input, and a value that fills a group is one
       row from here on.
    2. Every wanted rank starts with its group's whole range.  While a range holds
       more than ``SORTED_VALUES`` distinct values it is cut into ``QUANTILE_BINS``
       bins between its own least and greatest value, and the running counts
       say which bin holds the rank; that bin, from its least to its greatest
       value, is the next range.  Whatever the distribution, outliers included, each cut
       parts the least value from the greatest, so ranges end up small.
    3. Only those ranges' values are sorted, range by range.
    """
    keys = list(keys)
    names = names or [f"q{int(round(p * 100)):02d}" for p in probs]
    gk = [f"_g_{k}" for k in keys]
    v = F.col(value).cast("double")
    counts = (df.select(*keys, v.alias("_v")).where(F.col("_v").isNotNull())
                .groupBy(*keys, "_v").agg(F.count(F.lit(1)).alias("_c"))).checkpoint()
    group = counts.groupBy(*[F.col(k).alias(g) for k, g in zip(keys, gk)]).agg(
        F.sum("_c").alias("_n"), F.count(F.lit(1)).alias("_d"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
    ranks = []
    for p, nm in zip(probs, names):
        pos = (F.col("_n") - 1) * F.lit(float(p))
        for side, r in (("lo", F.floor(pos)), ("hi", F.ceil(pos))):
            ranks.append(F.struct(F.lit(nm).alias("q"), F.lit(side).alias("side"), r.cast("long").alias("rank"),
                                  (pos - F.floor(pos)).alias("frac")))
    targets = (group.where(F.col("_n") > 0).select(*gk, "_lo", "_hi", F.lit(0).cast("long").alias("_before"), "_d", F.explode(F.array(*ranks)).alias("w"))
                    .checkpoint())
    rows = targets.count()
    while (targets.agg(F.max("_d")).first()[0] or 0) > SORTED_VALUES:
        targets = _refined(counts, targets, keys, gk, rows).checkpoint()
    near = _inside(counts, targets.select(*gk, "_lo", "_hi", "_before").distinct(), keys, gk, rows)
    wv = Window.partitionBy(*gk, "_lo").orderBy("_v").rowsBetween(Window.unboundedPreceding, -1)
    near = near.withColumn("_at", F.col("_before") + F.coalesce(F.sum("_c").over(wv), F.lit(0)))
    spans = near.select(*[F.col(g).alias(f"{g}_") for g in gk], F.col("_lo").alias("_lo_"), "_v", "_at", "_c")
    hits = targets.join(spans, _same([*gk, "_lo"], [*[f"{g}_" for g in gk], "_lo_"])
                        & (F.col("w.rank") >= F.col("_at")) & (F.col("w.rank") < F.col("_at") + F.col("_c")))
    agg = (hits.groupBy(*[F.col(g).alias(k) for k, g in zip(keys, gk)], F.col("w.q").alias("q"))
               .agg(F.max(F.when(F.col("w.side") == "lo", F.col("_v"))).alias("vlo"),
                    F.max(F.when(F.col("w.side") == "hi", F.col("_v"))).alias("vhi"),
                    F.first("w.frac").alias("frac")))
    val = F.when(F.col("vlo") == F.col("vhi"), F.col("vlo")).otherwise(F.col("vlo") + (F.col("vhi") - F.col("vlo")) * F.col("frac"))
    return agg.groupBy(*keys).agg(*[F.max(F.when(F.col("q") == nm, val)).alias(nm) for nm in names])


def _inside(counts: DataFrame, ranges: DataFrame, keys, gk, rows: int) -> DataFrame:
    """The counted values within the ranges of their group; few ranges are broadcast."""
    return counts.join(F.broadcast(ranges) if rows <= BROADCAST_TARGETS else ranges,
                       _same(list(keys), gk) & F.col("_v").between(F.col("_lo"), F.col("_hi")))


def _refined(counts: DataFrame, targets: DataFrame, keys, gk, rows: int) -> DataFrame:
    """Targets whose range is still too full, each with the bin of it that holds the rank."""
    full = F.col("_d") > SORTED_VALUES
    ranges = targets.where(full).select(*gk, "_lo", "_hi", "_before").distinct()
    # halves keep the width of any two finite values finite; an infinite end is a bin of its own
    width = F.col("_hi") / 2 - F.col("_lo") / 2
    place = (F.col("_v") / 2 - F.col("_lo") / 2) / width * QUANTILE_BINS
    inner = F.least(F.greatest(F.floor(place), F.lit(0)), F.lit(QUANTILE_BINS - 1)).cast("long")
    infinite = (F.abs(F.col("_lo")) == float("inf")) | (F.abs(F.col("_hi")) == float("inf"))
    bin_ = (F.when(F.col("_v") == F.col("_lo"), F.lit(-1)).when(F.col("_v") == F.col("_hi"), F.lit(QUANTILE_BINS))
             .when(infinite | (width <= 0), F.lit(0)).otherwise(inner))
    bins = (_inside(counts, ranges, keys, gk, rows).groupBy(*gk, F.col("_lo").alias("_olo"), "_before", bin_.cast("long").alias("_bin"))
            .agg(F.sum("_c").alias("_bc"), F.count(F.lit(1)).alias("_bd"), F.min("_v").alias("_blo"), F.max("_v").alias("_bhi")))
    w = Window.partitionBy(*gk, "_olo").orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    bins = bins.withColumn("_at", F.col("_before") + F.coalesce(F.sum("_bc").over(w), F.lit(0)))
    bins = bins.select(*[F.col(g).alias(f"{g}_") for g in gk], "_olo", "_at", "_bc", "_bd", "_blo", "_bhi")
    hit = (targets.where(full).join(bins, _same([*gk, "_lo"], [*[f"{g}_" for g in gk], "_olo"])
                                    & (F.col("w.rank") >= F.col("_at")) & (F.col("w.rank") < F.col("_at") + F.col("_bc")))
           .select(*gk, F.col("_blo").alias("_lo"), F.col("_bhi").alias("_hi"), F.col("_at").alias("_before"), F.col("_bd").alias("_d"), "w"))
    return targets.where(~full).unionByName(hit)


def monthly_box(pred: DataFrame, horizon: int = 1, by=(MODEL,)) -> DataFrame:
    """Five-number summary of horizon-1 residuals per month."""
    r = residuals(pred).where(F.col(HORIZON) == horizon).withColumn("month", F.month("ts"))
    return exact_quantiles(r, list(by) + ["month"], "residual", [0.0, 0.25, 0.5, 0.75, 1.0],
                           ["min", "q1", "median", "q3", "max"])


def high_error(pred: DataFrame, horizon: int = 1, q: float = 0.9, by=(MODEL,)) -> tuple[DataFrame, DataFrame]:
    """threshold = ``q`` quantile of |residual| at ``horizon``; returns
    (rows flagged ``high_error``, summary: threshold, count above, first/last date)."""
    r = residuals(pred).where(F.col(HORIZON) == horizon).withColumn("abs_residual", F.abs("residual"))
    thr = exact_quantiles(r, list(by), "abs_residual", [q], ["threshold"])
    flagged = r.join(thr, list(by)).withColumn("high_error", F.col("abs_residual") > F.col("threshold"))
    summ = (flagged.groupBy(*by).agg(F.first("threshold").alias("threshold"),
                                     F.count(F.when(F.col("high_error"), 1)).alias("n_high"),
                                     F.min(F.when(F.col("high_error"), F.col("ts"))).alias("first_ts"),
                                     F.max(F.when(F.col("high_error"), F.col("ts"))).alias("last_ts")))
    return flagged, summ


def abs_error_by_horizon(pred: DataFrame, by=(MODEL,)) -> DataFrame:
    """Mean |residual| per horizon."""
    return residuals(pred).groupBy(*by, HORIZON).agg(F.avg(F.abs("residual")).alias("mean_abs_error"))


def corrected_skew(g1: Column, n: Column) -> Column:
    """Adjusted Fisher-Pearson skewness G1 (pandas/DuckDB) from Spark's g1."""
    return F.when(n > 2, g1 * F.sqrt(n * (n - 1)) / (n - 2))


def corrected_kurt(g2: Column, n: Column) -> Column:
    """Bias-corrected excess kurtosis G2 (pandas/DuckDB) from Spark's g2."""
    return F.when(n > 3, (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * g2 + 6))


def residual_moments(pred: DataFrame, by=(MODEL,)) -> DataFrame:
    """Mean, population std, corrected skewness and kurtosis per
    horizon, with skew/tail/bias labels."""
    r = residuals(pred)
    n = F.count("residual").cast("double")
    g = (r.groupBy(*by, HORIZON)
          .agg(n.alias("n"), F.avg("residual").alias("mean"), F.stddev_pop("residual").alias("std"),
               F.skewness("residual").alias("_g1"), F.kurtosis("residual").alias("_g2")))
    g = (g.withColumn("skewness", corrected_skew(F.col("_g1"), F.col("n")))
          .withColumn("kurtosis", corrected_kurt(F.col("_g2"), F.col("n"))).drop("_g1", "_g2"))
    am = F.abs(F.col("mean"))
    return (g.withColumn("skew_label", F.when(F.col("skewness") > 0, "right-skewed").otherwise("left-skewed"))
             .withColumn("tail_label", F.when(F.col("kurtosis") > 0, "heavy-tailed").otherwise("light-tailed"))
             .withColumn("bias_label", F.when(am < 0.1, "low").when(am < 0.5, "moderate").otherwise("high"))
             .withColumn("n", F.col("n").cast("long")))


def residual_histogram(pred: DataFrame, bins: int = 50, by=(MODEL,)) -> DataFrame:
    """``bins`` equal-width bins from min to max per horizon (max in the
    last bin), density = count / (n * width)."""
    r = residuals(pred)
    keys = list(by) + [HORIZON]
    st = r.groupBy(*keys).agg(F.min("residual").alias("_mn"), F.max("residual").alias("_mx"),
                              F.count("residual").alias("_n"))
    width = (F.col("_mx") - F.col("_mn")) / bins
    b = F.when(width > 0, F.least(F.lit(bins), F.floor((F.col("residual") - F.col("_mn")) / width) + 1)).otherwise(F.lit(1))
    h = (r.join(st, keys).withColumn("bin", b.cast("long"))
          .groupBy(*keys, "bin").agg(F.count(F.lit(1)).alias("count"), F.first("_mn").alias("_mn"),
                                     F.first("_mx").alias("_mx"), F.first("_n").alias("_n")))
    w = (F.col("_mx") - F.col("_mn")) / bins
    return (h.withColumn("bin_lo", F.col("_mn") + (F.col("bin") - 1) * w)
             .withColumn("bin_hi", F.col("_mn") + F.col("bin") * w)
             .withColumn("density", F.when(w > 0, F.col("count") / (F.col("_n") * w)))
             .drop("_mn", "_mx", "_n"))


def bias_variance(pred: DataFrame, by=(MODEL,)) -> tuple[DataFrame, DataFrame]:
    """MSE, (mean p - mean y)^2, var_pop(p), var_pop(y), their % of MSE
    (0 when MSE = 0) per horizon; verdict from the mean percentages
    (bias > 60 underfitting, else variance > 60 overfitting, else balanced).
    Not a true decomposition: percentages may exceed 100."""
    e = _err()
    t = (pred.groupBy(*by, HORIZON)
             .agg(F.avg(e * e).alias("mse"),
                  F.pow(F.avg(P) - F.avg(Y), 2).alias("bias_sq"),
                  F.var_pop(P).alias("variance"),
                  F.var_pop(Y).alias("irreducible")))
    t = (t.withColumn("bias_pct", F.when(F.col("mse") > 0, F.col("bias_sq") / F.col("mse") * 100).otherwise(0.0))
          .withColumn("variance_pct", F.when(F.col("mse") > 0, F.col("variance") / F.col("mse") * 100).otherwise(0.0)))
    v = (t.groupBy(*by).agg(F.avg("bias_pct").alias("mean_bias_pct"), F.avg("variance_pct").alias("mean_variance_pct"))
          .withColumn("verdict", F.when(F.col("mean_bias_pct") > 60, "underfitting")
                                  .when(F.col("mean_variance_pct") > 60, "overfitting").otherwise("balanced")))
    return t, v


def range_stats(series: DataFrame, start, end, value: str = "temp", by=("series_id",)) -> DataFrame:
    """Inclusive date-range filter, then mean/max/min."""
    d = series.where(F.col("ts").between(F.lit(start), F.lit(end)))
    return d.groupBy(*by).agg(F.avg(value).alias("mean"), F.max(value).alias("max"),
                              F.min(value).alias("min"), F.count(F.lit(1)).alias("n"))


def backtest_scores(bt: DataFrame, by=(MODEL,)) -> DataFrame:
    """R^2, MAE, RMSE and accuracy = 100 * (1 - MAE / mean(y))."""
    e = _err()
    y = F.col(Y)
    g = bt.groupBy(*by).agg(r2_expr(F.sum(e * e), F.var_pop(y) * F.count(y)).alias("r2"),
                            F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"),
                            F.avg(y).alias("_my"), F.count(F.lit(1)).alias("n"))
    return g.withColumn("accuracy", F.when(F.col("_my") != 0, 100 * (1 - F.col("mae") / F.col("_my")))).drop("_my")
