"""Slicing and splits (L1-L10) as row-position arithmetic.

``row_id`` and ``n_rows`` (see ``operators.windows``) already say where a row
stands in its series, and the valid range of a builder cuts a known number of
rows at either end, so every position below is an expression over columns of
the row itself: no aggregate, no join back, no second evaluation of the input,
and no operator that puts a whole series in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tempora.operators.windows import N_ROWS, ROW_ID

# Fixed values that must equal the reference's configuration.
TRAIN_RATIO = 0.85
GAP_DAILY = 14
GAP_HOURLY = 336
CV_SPLITS = 5
CV_BUFFER = 14
RETRAIN_WINDOW = 90
VALIDATION_WINDOW = 30
MAX_HISTORY = 180
DRIFT_BASELINE_ROWS = 30
PLOT_TAIL = 365


POS, N_POS, N_TRAIN = "pos", "n_pos", "n_train"


def with_positions(df: DataFrame, skip_head: int = 0, skip_tail: int = 0) -> DataFrame:
    """0-based position ``pos`` of each row among the rows kept of its series and
    their count ``n_pos``, when the first ``skip_head`` and last ``skip_tail`` rows
    of every series were cut.  Frames that carry positions (the builders' valid
    range) are returned as they are."""
    if POS in df.columns and N_POS in df.columns:
        return df
    return df.withColumns({POS: (F.col(ROW_ID) - skip_head).cast("long"),
                           N_POS: F.greatest(F.col(N_ROWS) - skip_head - skip_tail, F.lit(0)).cast("long")})


def chronological_split(df: DataFrame, ratio: float = TRAIN_RATIO, gap: int = GAP_DAILY,
                        keep_gap: bool = False, skip_head: int = 0, skip_tail: int = 0) -> DataFrame:
    """L4: first ``floor(n*ratio)`` rows train, test from ``split + gap``; gap rows
    dropped (kept with ``split = NULL`` when ``keep_gap``).  ``n_train`` is the
    number of train rows of the series."""
    d = with_positions(df, skip_head, skip_tail)
    cut = F.floor(F.col(N_POS) * F.lit(ratio)).cast("long")
    split = (F.when(F.col(POS) < cut, F.lit("train"))
              .when(F.col(POS) >= cut + gap, F.lit("test")))
    d = d.withColumns({"split": split, N_TRAIN: cut})
    if not keep_gap:
        d = d.where(F.col("split").isNotNull())
    return d


def cv_folds(train: DataFrame, n_splits: int = CV_SPLITS, buffer: int = CV_BUFFER) -> DataFrame:
    """Expanding-window CV of the train rows (``pos``, ``n_train``) with a leakage buffer.

    Validation block = ``n // (n_splits+1)``; fold ``i`` (1-based) validates
    on ``[s_i + buffer, s_i + block)`` with ``s_i = n - (n_splits-i+1)*block``
    and trains on ``[0, s_i)``.  Folds whose validation is empty after the
    buffer are skipped.  Each row is emitted once per fold it belongs to
    (``fold``, ``role``) -- an ``explode`` of at most ``n_splits`` entries, no join.
    """
    n = F.col(N_TRAIN)
    block = F.floor(n / (n_splits + 1))
    entries = []
    for i in range(1, n_splits + 1):
        start = n - (n_splits - i + 1) * block
        role = (F.when(F.col("pos") < start, F.lit("train"))
                 .when((F.col("pos") >= start + buffer) & (F.col("pos") < start + block), F.lit("val")))
        ok = block - buffer > 0
        entries.append(F.when(ok & role.isNotNull(),
                              F.struct(F.lit(i).alias("fold"), role.alias("role"))))
    return (train.withColumn("_f", F.explode(F.filter(F.array(*entries), lambda e: e.isNotNull())))
             .withColumn("fold", F.col("_f.fold")).withColumn("role", F.col("_f.role")).drop("_f"))


def head_rows(df: DataFrame, n: int) -> DataFrame:
    """First ``n`` rows per series (L8: drift baseline)."""
    return df.where(F.col(ROW_ID) < n)


def _back(end: Column | None) -> Column:
    """Rows between this one and the last row of its series (0 for the last)."""
    return (F.col(N_ROWS) if end is None else end) - 1 - F.col(ROW_ID)


def tail_rows(df: DataFrame, n: int, skip_last: int = 0, end: Column | None = None) -> DataFrame:
    """Rows ``[end-skip_last-n, end-skip_last)`` per series (L6, L7, L9, W21); ``end`` is
    one past the last ``row_id`` present, the series length if not given."""
    back = _back(end)
    return df.where((back >= skip_last) & (back < skip_last + n))


def retrain_slices(df: DataFrame, retrain_window: int = RETRAIN_WINDOW,
                   validation_window: int = VALIDATION_WINDOW, latest: bool = False,
                   end: Column | None = None) -> DataFrame:
    """``slice`` = 'retrain' for the last ``retrain_window`` rows and 'validation'
    for the ``validation_window`` rows before them (reference default).  With
    ``latest`` the validation slice is the newest rows and the retrain slice
    precedes it."""
    back = _back(end)
    if latest:
        s = (F.when(back < validation_window, "validation")
              .when(back < validation_window + retrain_window, "retrain"))
    else:
        s = (F.when(back < retrain_window, "retrain")
              .when(back < retrain_window + validation_window, "validation"))
    return df.withColumn("slice", s).where(F.col("slice").isNotNull())


def append_bounded(history: DataFrame, new: DataFrame, max_history: int = MAX_HISTORY,
                   end: Column | None = None) -> DataFrame:
    """Append rows, keep the newest ``max_history`` per series."""
    return tail_rows(history.unionByName(new), max_history, end=end)
