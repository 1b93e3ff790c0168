"""Row-based window engine.

All features in the reference count rows, not calendar time.  Two ways to
evaluate them:

* ``plain``   -- ``Window.partitionBy(series_id).orderBy(ts)``.  One task per
  series: right for many short series.
* ``blocked`` -- skew-safe.  Row numbers are assigned without a one-task sort
  (coarse time buckets are counted, offsets come from a running sum over the
  tiny count table, then each bucket numbers its own rows).  Rows are cut into
  blocks of ``block_rows``; the last ``halo_back`` rows of a block are copied
  into the next block and the first ``halo_fwd`` rows into the previous one,
  windows run per ``(series_id, block)`` and halo copies are dropped.  A
  single series holding a third of all rows is spread over
  ``n / block_rows`` tasks.  Exact as long as every frame reaches at most
  ``halo_back`` rows back and ``halo_fwd`` rows forward.

The ``SeriesFrame`` spec returned by :func:`prepare` tells feature builders
which window to use, so the same expressions run in both modes.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SERIES = "series_id"
TS = "ts"
ROW_ID = "row_id"
N_ROWS = "n_rows"
_BLK = "_blk"
_HOME = "_home"
_BKT = "_bkt"


@dataclass
class SeriesFrame:
    df: DataFrame
    partition: tuple
    series: str = SERIES
    blocked: bool = False

    @property
    def w(self):
        """Ordered window over a series (or a series block)."""
        return Window.partitionBy(*self.partition).orderBy(ROW_ID)

    def rows(self, start: int, end: int):
        return self.w.rowsBetween(start, end)

    def finish(self, df: DataFrame) -> DataFrame:
        """Drop halo copies and helper columns."""
        if self.blocked:
            df = df.where(F.col(_HOME)).drop(_BLK, _HOME)
        return df


def number_rows(df: DataFrame, series: str = SERIES, ts: str = TS,
                mode: str = "blocked", bucket_unit: str = "month") -> DataFrame:
    """Add ``row_id`` (0-based position in its series, ordered by ``ts``) and
    ``n_rows`` (series length).

    Rows of one series with equal ``ts`` (repeated local hours) are ordered by a
    hash of the whole row; rows with a NULL ``ts`` come first and a NULL series
    is a series of its own, alike in both modes (``features.rejects`` lists such
    rows).  In ``blocked`` mode the only full-data
    sort is per ``(series, time bucket)``; the running offsets are computed
    on the count table, one row per bucket, whose size AQE checks at run time
    before it broadcasts it (sort-merge join beyond the threshold).
    """
    order = (F.col(ts), F.xxhash64(*[F.col(f"`{c}`") for c in df.columns]))
    if mode == "plain":
        w = Window.partitionBy(series).orderBy(*order)
        return (df.withColumn(ROW_ID, F.row_number().over(w) - 1)
                  .withColumn(N_ROWS, F.count(F.lit(1)).over(Window.partitionBy(series))))
    d = df.withColumn(_BKT, F.date_trunc(bucket_unit, F.col(ts).cast("timestamp_ntz")))
    counts = d.groupBy(series, _BKT).agg(F.count(F.lit(1)).alias("_cnt"))
    ws = Window.partitionBy(series).orderBy(_BKT)
    offsets = counts.select(
        F.col(series).alias("_s"), F.col(_BKT).alias("_b"),
        F.coalesce(F.sum("_cnt").over(ws.rowsBetween(Window.unboundedPreceding, -1)),
                   F.lit(0)).alias("_off"),
        F.sum("_cnt").over(Window.partitionBy(series)).alias(N_ROWS))
    wb = Window.partitionBy(series, _BKT).orderBy(*order)
    same = F.col(series).eqNullSafe(F.col("_s")) & F.col(_BKT).eqNullSafe(F.col("_b"))
    return (d.join(offsets, same, "inner")
             .withColumn(ROW_ID, F.col("_off") + F.row_number().over(wb) - 1)
             .drop(_BKT, "_off", "_s", "_b"))


def prepare(df: DataFrame, halo_back: int, halo_fwd: int, series: str = SERIES,
            ts: str = TS, mode: str = "blocked", block_rows: int = 100_000,
            bucket_unit: str = "month", numbered: bool = False,
            materialize: bool = False) -> SeriesFrame:
    """Number rows (unless ``numbered``) and lay out blocks with halos.

    ``number_rows`` reads its input twice (the count branch only needs the
    keys).  When the input is an expensive derived table -- e.g. a series
    aggregated from a large raw table -- pass ``materialize=True`` to write it
    once to the checkpoint folder first.

    Returns a :class:`SeriesFrame`; build window columns with ``sf.w`` /
    ``sf.rows(a, b)`` on ``sf.df``, then call ``sf.finish(result)``.
    """
    if materialize:
        df = df.checkpoint(eager=True)
    if not numbered:
        df = number_rows(df, series, ts, mode, bucket_unit)
    if mode == "plain":
        return SeriesFrame(df, (series,), series, False)
    b = int(block_rows)
    if b < max(halo_back, halo_fwd, 1):
        raise ValueError(f"block_rows={b} must cover the halo ({halo_back}, {halo_fwd})")
    home = F.floor(F.col(ROW_ID) / b)
    copies = F.array(
        F.struct(home.alias("b"), F.lit(True).alias("h")),
        F.when(F.col(ROW_ID) >= (home + 1) * b - halo_back,
               F.struct((home + 1).alias("b"), F.lit(False).alias("h"))),
        F.when((F.col(ROW_ID) < home * b + halo_fwd) & (home > 0),
               F.struct((home - 1).alias("b"), F.lit(False).alias("h"))),
    )
    out = (df.withColumn("_cp", F.explode(F.filter(copies, lambda c: c.isNotNull())))
             .withColumn(_BLK, F.col("_cp.b")).withColumn(_HOME, F.col("_cp.h"))
             .drop("_cp"))
    return SeriesFrame(out, (series, _BLK), series, True)


# ---------------------------------------------------------------- frame helpers

def full(agg: Column, x: Column, w, n: int) -> Column:
    """``agg`` over a frame, only when all ``n`` values are present
    (pandas ``rolling(n)`` with the default ``min_periods=n``)."""
    return F.when(F.count(x).over(w) == n, agg.over(w))


def lag_bank(cols: list[str], lags, w, fmt: str = "{c}_lag_{k}") -> list[Column]:
    """``{c}_lag_{k}`` for every column and lag, one ``lag(struct)`` per k."""
    out = []
    for k in lags:
        s = F.lag(F.struct(*[F.col(c) for c in cols]), int(k)).over(w)
        out += [s.getField(c).alias(fmt.format(c=c, k=k)) for c in cols]
    return out


def nan_to_null(df: DataFrame, cols=None) -> DataFrame:
    """Spark aggregates do not skip NaN; NULL is the one missing marker."""
    num = [f.name for f in df.schema.fields
           if f.dataType.typeName() in ("double", "float") and (cols is None or f.name in cols)]
    if not num:
        return df
    return df.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in num})
