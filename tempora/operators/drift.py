"""Two-sample Kolmogorov-Smirnov drift test per feature column.

The statistic is computed set-based: both samples are unpivoted to
``(keys..., value, side)``, counted per distinct value (ties are values, not
rows), and the running counts give
``K = max |cum_base * n_recent - cum_recent * n_base|`` and
``D = K / (n_base * n_recent)``.  Groups are one (series, column) pair of two
bounded slices (30 + 30 rows by default), shuffled by that key.

The exact two-sided p-value ``P(D >= d)`` is a lattice-path count; it runs as an
Arrow-batched pandas UDF on the per-column result where the samples are small,
and the limit distribution is a Spark expression beyond.
"""

from __future__ import annotations

from functools import lru_cache
from math import comb

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed values that must equal the reference.
KS_ALPHA = 0.05
MIN_DRIFTED = 3
DRIFT_MIN_TRAIN_ROWS = 60
# Above this many lattice cells the p-value comes from the limit distribution.
EXACT_CELLS = 250_000


def unpivot(df: DataFrame, keys, columns, name: str = "column_name", value: str = "value") -> DataFrame:
    """Wide numeric columns -> ``(keys..., column, value)``, NULLs removed."""
    entries = F.array(*[F.struct(F.lit(c).alias(name), F.col(c).cast("double").alias(value)) for c in columns])
    return (df.select(*keys, F.explode(entries).alias("_e"))
              .select(*keys, F.col(f"_e.{name}").alias(name), F.col(f"_e.{value}").alias(value))
              .where(F.col(value).isNotNull() & ~F.isnan(value)))


def ks_flagged(long: DataFrame, keys) -> DataFrame:
    """``(keys..., n_base, n_recent, k_stat, d_stat)`` from one long table ``(keys...,
    value, in_base, in_recent)``; a row may be in both samples."""
    keys = list(keys)
    per_val = long.groupBy(*keys, "value").agg(F.count_if("in_base").alias("_ca"), F.count_if("in_recent").alias("_cb"))
    wk = Window.partitionBy(*keys)
    wc = wk.orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
    d = (per_val.withColumn("n_base", F.sum("_ca").over(wk)).withColumn("n_recent", F.sum("_cb").over(wk))
                .withColumn("_fa", F.sum("_ca").over(wc)).withColumn("_fb", F.sum("_cb").over(wc)))
    gap = F.abs(F.col("_fa") * F.col("n_recent") - F.col("_fb") * F.col("n_base"))
    out = d.groupBy(*keys).agg(F.first("n_base").alias("n_base"), F.first("n_recent").alias("n_recent"),
                               F.max(gap).alias("k_stat"))
    out = out.where((F.col("n_base") > 0) & (F.col("n_recent") > 0))   # empty side: not tested
    return out.withColumn("d_stat", F.col("k_stat") / (F.col("n_base") * F.col("n_recent")))


def ks_statistic(baseline: DataFrame, recent: DataFrame, keys) -> DataFrame:
    """The same for two long inputs ``(keys..., value)``."""
    def side(df, base):
        return df.select(*keys, "value", F.lit(base).alias("in_base"), F.lit(not base).alias("in_recent"))
    return ks_flagged(side(baseline, True).unionByName(side(recent, False)), keys)


@lru_cache(maxsize=65536)
def ks_pvalue_exact(n: int, m: int, k: int) -> float:
    """Exact two-sided ``P(D >= k/(n*m))`` under H0 (no ties): one minus the
    share of monotone lattice paths from (0,0) to (n,m) that keep
    ``|i*m - j*n| < k`` at every point."""
    if n <= 0 or m <= 0:
        return float("nan")
    if k <= 0:
        return 1.0
    row = [0] * (m + 1)
    for i in range(n + 1):
        new = [0] * (m + 1)
        for j in range(m + 1):
            if abs(i * m - j * n) >= k:
                continue
            if i == 0 and j == 0:
                new[j] = 1
                continue
            new[j] = (row[j] if i > 0 else 0) + (new[j - 1] if j > 0 else 0)
        row = new
    inside = row[m]
    return max(0.0, min(1.0, 1.0 - inside / comb(n + m, n)))


@F.pandas_udf(T.DoubleType())
def ks_pvalue_lattice(n: pd.Series, m: pd.Series, k: pd.Series) -> pd.Series:
    return pd.Series([ks_pvalue_exact(int(a), int(b), int(c)) if pd.notna(a) and pd.notna(b) and pd.notna(c)
                      else float("nan") for a, b, c in zip(n, m, k)], dtype="float64")


def ks_pvalue_asymptotic(n: Column, m: Column, k: Column) -> Column:
    """Kolmogorov's limit ``2 sum (-1)^(j-1) exp(-2 j^2 z^2)`` with ``z = D sqrt(nm/(n+m))``
    as a closed expression (100 terms; 1 where z is too small for the series)."""
    n, m = n.cast("double"), m.cast("double")
    z2 = F.pow(k / (n * m), 2) * n * m / (n + m)
    s = F.aggregate(F.sequence(F.lit(1), F.lit(100)), F.lit(0.0),
                    lambda a, j: a + F.when(j % 2 == 1, 1.0).otherwise(-1.0) * F.exp(-2.0 * j * j * z2))
    return F.when(z2 < 0.04, F.lit(1.0)).otherwise(F.least(F.greatest(2 * s, F.lit(0.0)), F.lit(1.0)))


def with_pvalue(st: DataFrame, exact_cells: int = EXACT_CELLS) -> DataFrame:
    """Add ``p_value``: the exact lattice count where ``n_base * n_recent`` is at most
    ``exact_cells`` (the daily 30 + 30 rows are), the limit distribution beyond.  The
    library the reference calls makes the same distinction by sample size."""
    n, m, k = F.col("n_base"), F.col("n_recent"), F.col("k_stat")
    small = n * m <= exact_cells
    exact = ks_pvalue_lattice(F.when(small, n), F.when(small, m), F.when(small, k))
    return st.withColumn("p_value", F.when(small, exact).otherwise(ks_pvalue_asymptotic(n, m, k)))


def running_counts(df: DataFrame, keys, value: str, flag: str) -> DataFrame:
    """Append, per row, how many flagged rows of its ``keys`` have a value at most (``n_le``) and
    below (``n_lt``) its own, and how many there are (``n_all``).

    Rows are cut into ranges of (keys, value) over the cluster, each counted by itself;
    a range starts from the flagged rows of the ranges before it, which one
    small table of (range, keys) counts gives.  No key has to fit in one task.
    """
    part, keys = "_range", list(keys)
    ranged = (df.repartitionByRange(*keys, value).withColumn(part, F.spark_partition_id())).checkpoint()
    sizes = ranged.groupBy(part, *keys).agg(F.count_if(F.col(flag)).alias("_here"))
    before = Window.partitionBy(*keys).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    first = sizes.select(F.col(part).alias("_p"), *[F.col(k).alias(f"_k_{k}") for k in keys], F.coalesce(F.sum("_here").over(before), F.lit(0)).alias("_first"),
                         F.sum("_here").over(Window.partitionBy(*keys)).alias("n_all"))
    same = F.col(part) == F.col("_p")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    one = F.when(F.col(flag), 1).otherwise(0)
    at = Window.partitionBy(part, *keys).orderBy(value)
    equal = Window.partitionBy(part, *keys, value)
    counted = (ranged.withColumn("n_le", F.sum(one).over(at.rangeBetween(Window.unboundedPreceding, 0)))
                     .withColumn("n_lt", F.col("n_le") - F.sum(one).over(equal)))
    return (counted.join(first, same).withColumns({"n_le": F.col("n_le") + F.col("_first"), "n_lt": F.col("n_lt") + F.col("_first")})
                   .drop(part, "_p", "_first", *[f"_k_{k}" for k in keys]))


def ks_drift(flagged: DataFrame, keys, columns, alpha: float = KS_ALPHA,
             min_drifted: int = MIN_DRIFTED, group=("series_id",)) -> tuple[DataFrame, DataFrame]:
    """Per-column KS tests between the rows ``in_base`` and ``in_recent`` of one wide
    frame with ``keys`` and numeric ``columns``.  Returns
    (per-column table with p-value and ``drifted``, per-group summary with
    ``n_drifted`` and ``drift = n_drifted >= min_drifted``).  A column that is
    empty after NULL removal on either side gets no row (not counted)."""
    long = unpivot(flagged, [*keys, "in_base", "in_recent"], columns)
    st = with_pvalue(ks_flagged(long, [*keys, "column_name"]))
    st = st.withColumn("drifted", F.col("p_value") < alpha)
    summ = (st.groupBy(*group).agg(F.count(F.when(F.col("drifted"), 1)).alias("n_drifted"),
                                   F.count(F.lit(1)).alias("n_tested"))
              .withColumn("drift", F.col("n_drifted") >= min_drifted))
    return st, summ
