"""Scalar column functions: calendar, cyclical encodings, bands.

All are built-in Spark expressions, so they stay inside whole-stage codegen.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

TWO_PI = 2.0 * math.pi

# Fixed values that must equal the reference: day-of-year period 366,
# month period 12, hour period 24; weekend = day_of_week >= 5 (Monday = 0).
DOY_PERIOD = 366
MONTH_PERIOD = 12
HOUR_PERIOD = 24


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def minutes_of_day(ts) -> Column:
    """Hour * 60 + minute."""
    return F.hour(_c(ts)) * 60 + F.minute(_c(ts))


def minutes_between(start, end) -> Column:
    """Elapsed seconds / 60 (fractional), on the wall clock: time stamps without a zone
    are subtracted as they are, so no session zone shifts a day."""
    gap = _c(end).cast("timestamp_ntz") - _c(start).cast("timestamp_ntz")

    def part(unit):
        return F.extract(F.lit(unit), gap).cast("double")
    return part("DAY") * 1440 + part("HOUR") * 60 + part("MINUTE") + part("SECOND") / 60


def day_of_week(ts) -> Column:
    """D3: Monday = 0 ... Sunday = 6 (not Spark's ``dayofweek``)."""
    return F.weekday(_c(ts))


def calendar_columns(ts, weekend: bool = False) -> dict[str, Column]:
    """D3 (+ D4 when ``weekend``): day_of_year, month, year, day_of_week[, is_weekend]."""
    t = _c(ts)
    out = {
        "day_of_year": F.dayofyear(t),
        "month": F.month(t),
        "year": F.year(t),
        "day_of_week": day_of_week(t),
    }
    if weekend:
        out["is_weekend"] = (day_of_week(t) >= 5).cast("int")
    return out


def cyclical(x, period: int) -> tuple[Column, Column]:
    """sin/cos of 2*pi*x/period."""
    a = F.lit(TWO_PI) * _c(x) / F.lit(float(period))
    return F.sin(a), F.cos(a)


def cyclical_columns(hour: bool = False) -> dict[str, Column]:
    """D5 (+ D6): cyclical encodings of day_of_year (366), month (12)[, hour (24)]."""
    sd, cd = cyclical("day_of_year", DOY_PERIOD)
    sm, cm = cyclical("month", MONTH_PERIOD)
    out = {"sin_day_of_year": sd, "cos_day_of_year": cd, "sin_month": sm, "cos_month": cm}
    if hour:
        sh, ch = cyclical("hour", HOUR_PERIOD)
        out.update(sin_hour=sh, cos_hour=ch)
    return out


def forecast_date(last_ts, horizon) -> Column:
    """Last date + horizon days."""
    return F.date_add(_c(last_ts).cast("date"), _c(horizon).cast("int"))


# Fixed values that must equal the reference (serving UI bands).
TEMP_BANDS = [(20, "Cool"), (25, "Pleasant"), (30, "Warm")]
TEMP_BAND_ELSE = "Hot"
SEVERITY_BANDS = [(25, "low"), (30, "mid")]
SEVERITY_BAND_ELSE = "high"
CLEAR_LABEL = "Clear"


def temp_band(x) -> Column:
    """<20 Cool, <25 Pleasant, <30 Warm, else Hot."""
    e = None
    for lim, name in TEMP_BANDS:
        e = (F.when(_c(x) < lim, name) if e is None else e.when(_c(x) < lim, name))
    return F.when(_c(x).isNull(), None).otherwise(e.otherwise(TEMP_BAND_ELSE))


def severity_band(x) -> Column:
    """<25, <30, else (the UI's colour bands)."""
    e = None
    for lim, name in SEVERITY_BANDS:
        e = (F.when(_c(x) < lim, name) if e is None else e.when(_c(x) < lim, name))
    return F.when(_c(x).isNull(), None).otherwise(e.otherwise(SEVERITY_BAND_ELSE))


def precip_label(x) -> Column:
    """Amount when precip > 0, else 'Clear'."""
    return F.when(_c(x) > 0, F.format_string("%.1f mm", _c(x))).otherwise(F.lit(CLEAR_LABEL))
