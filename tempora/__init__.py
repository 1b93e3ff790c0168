"""tempora: Spark-native multi-series forecasting features, evaluation and monitoring.

Every operator takes and returns a ``pyspark.sql.DataFrame``; nothing is
collected to the driver except fixed-size results (model coefficients,
a handful of fitted statistics).  Time series are keyed by
``(series_id, ts)``; windows count rows, not calendar time.
"""

from tempora.session import get_spark, checkpoint_dir  # noqa: F401

SERIES = "series_id"
TS = "ts"
ROW_ID = "row_id"
