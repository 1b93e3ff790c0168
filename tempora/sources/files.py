"""File sources (S1-S6) and serving-side column fixes.

Types come from fixed ``StructType``s applied by column name (no inference
pass over the data); optional columns are handled by presence checks on
``df.columns``.  The JSON source
reads provider documents ``{"days": [...]}`` and explodes them to one row per
day; list-valued columns are normalised by type (not by sampling the first
row as the reference does).
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_D = T.DoubleType()
_S = T.StringType()

# Fixed values that must equal the reference: raw daily columns.
DAILY_NUMERIC = ['latitude', 'longitude', 'tempmax', 'tempmin', 'temp', 'feelslikemax', 'feelslikemin',
                 'feelslike', 'dew', 'humidity', 'precip', 'precipprob', 'precipcover', 'windgust',
                 'windspeed', 'windspeedmax', 'windspeedmean', 'windspeedmin', 'winddir', 'sealevelpressure',
                 'cloudcover', 'visibility', 'solarradiation', 'solarenergy', 'uvindex', 'severerisk',
                 'moonphase']
DAILY_STRING = ['name', 'address', 'resolvedAddress', 'preciptype', 'conditions', 'description', 'icon',
                'source', 'sunrise', 'sunset']
SERIES_KEYS = ['resolvedAddress', 'name', 'address']
DEFAULT_SEALEVEL = 1013.25
WIND_FILLS = ['windspeedmax', 'windspeedmean', 'windspeedmin']


def daily_schema() -> T.StructType:
    f = [T.StructField("datetime", _S)]
    f += [T.StructField(c, _D) for c in DAILY_NUMERIC]
    f += [T.StructField(c, _S) for c in DAILY_STRING]
    return T.StructType(f)


def hourly_schema() -> T.StructType:
    f = [T.StructField("datetime", _S), T.StructField("hour", T.IntegerType())]
    f += [T.StructField(c, _D) for c in DAILY_NUMERIC]
    f += [T.StructField(c, _S) for c in DAILY_STRING]
    return T.StructType(f)


def with_series_key(df: DataFrame, single: str = "_") -> DataFrame:
    """Location columns become the series key (they are constants per series
    in the reference and dropped there)."""
    keys = [c for c in SERIES_KEYS if c in df.columns]
    key = F.coalesce(*[F.col(c) for c in keys], F.lit(single)) if keys else F.lit(single)
    return df.withColumn("series_id", key)


def typed_by_name(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Cast the columns named in ``schema`` (present ones only); values that do
    not parse become NULL.  Unknown columns stay strings."""
    types = {f.name: f.dataType for f in schema.fields}
    return df.select(*[F.col(f"`{c}`").try_cast(types[c]).alias(c) if c in types and types[c] != _S
                       else F.col(f"`{c}`") for c in df.columns])


def _read_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    # Header names, not positions, decide which column is which: read every
    # column as a string (no inference pass) and cast the known ones by name.
    raw = spark.read.option("header", True).option("inferSchema", False).option("mode", "PERMISSIVE").csv(path)
    return typed_by_name(raw, schema)


def read_daily_csv(spark: SparkSession, path: str) -> DataFrame:
    """Daily CSV -> ``series_id``, ``ts`` (date) + raw columns."""
    df = _read_csv(spark, path, daily_schema())
    return with_series_key(df).withColumn("ts", F.to_date("datetime"))


def read_hourly_csv(spark: SparkSession, path: str) -> DataFrame:
    """Hourly CSV -> ``series_id``, ``ts`` (timestamp) + raw columns."""
    df = _read_csv(spark, path, hourly_schema())
    return with_series_key(df).withColumn("ts", F.to_timestamp_ntz(F.col("datetime")))


CORRUPT = "_corrupt_record"


def read_csv_checked(spark: SparkSession, path: str, schema: T.StructType, ts, required=("temp",)) -> tuple[DataFrame, DataFrame]:
    """S1/S2 with rejects: (rows as ``read_daily_csv`` gives them, ``file, reason, record`` of each bad line).

    A line is bad, first reason wins, if it has more or fewer fields than the header
    (``fields``), if its ``datetime`` does not parse (``datetime``) or if a ``required`` number is there but does not
    parse (``number``).  ``ts`` turns the text of ``datetime`` into the row's time, NULL where it
    cannot.  Other values that do not parse become NULL.  The files are read once, as strings; nothing is inferred.
    """
    names = spark.read.option("header", True).option("inferSchema", False).csv(path).columns
    raw = T.StructType([T.StructField(c, _S) for c in names] + [T.StructField(CORRUPT, _S)])
    lines = (spark.read.schema(raw).option("header", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", CORRUPT).csv(path)
             .withColumn("_file", F.input_file_name()))
    types = {f.name: f.dataType for f in schema.fields}
    unread = [F.col(f"`{c}`").isNotNull() & F.col(f"`{c}`").try_cast(types[c]).isNull() for c in required if c in names]
    wrong = F.lit(False)
    for u in unread:
        wrong = wrong | u
    reason = (F.when(F.col(CORRUPT).isNotNull(), "fields").when(ts(F.col("datetime")).isNull(), "datetime").when(wrong, "number"))
    marked = lines.withColumn("_reason", reason)
    good = with_series_key(typed_by_name(marked.where(F.col("_reason").isNull()).select(*[F.col(f"`{c}`") for c in names]), schema))
    fields = F.concat_ws(",", *[F.coalesce(F.col(f"`{c}`"), F.lit("")) for c in names])
    bad = marked.where(F.col("_reason").isNotNull()).select(
        F.col("_file").alias("file"), F.col("_reason").alias("reason"), F.coalesce(CORRUPT, fields).alias("record"))
    return good.withColumn("ts", ts(F.col("datetime"))), bad


def daily_ts(c: Column) -> Column:
    return F.to_date(F.try_to_timestamp(c, F.lit("yyyy-MM-dd")))


def hourly_ts(c: Column) -> Column:
    return c.try_cast("timestamp_ntz")


def days_json_schema() -> T.StructType:
    day = [T.StructField("datetime", _S)] + [T.StructField(c, _D) for c in DAILY_NUMERIC]
    day += [T.StructField(c, _S) for c in DAILY_STRING if c != "preciptype"]
    day += [T.StructField("preciptype", T.ArrayType(_S)), T.StructField("stations", T.ArrayType(_S))]
    top = [T.StructField(c, _S) for c in ['resolvedAddress', 'address', 'timezone']]
    top += [T.StructField("latitude", _D), T.StructField("longitude", _D)]
    return T.StructType(top + [T.StructField("days", T.ArrayType(T.StructType(day)))])


def read_days_json(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """Provider JSON documents -> one row per day (a table has no order; sort on output).

    Documents without ``days`` are listed by ``missing_days`` (the reference raises).  ``preciptype`` becomes its first
    element or ``'none'``; other list columns are comma-joined."""
    return explode_days(spark.read.schema(schema or days_json_schema()).option("multiLine", True).json(path))


def parse_days(df: DataFrame, json_col: str, schema: T.StructType | None = None) -> DataFrame:
    """The same for a table with one provider document per row, as text."""
    return explode_days(df.select(F.from_json(json_col, schema or days_json_schema()).alias("d")).select("d.*"))


def read_days_lines(spark: SparkSession, path: str, schema: T.StructType | None = None) -> tuple[DataFrame, DataFrame]:
    """S3/S4 for line-delimited files, one provider document or one day a line: (day rows, ``file, record`` of
    lines that are neither).

    Lines split, so one large file is read by as many tasks as its size asks for;
    ``read_days_json`` needs one task for a file."""
    schema = schema or days_json_schema()
    day = schema["days"].dataType.elementType
    top = [f for f in schema.fields if f.name != "days"]
    both = T.StructType(schema.fields + [f for f in day.fields if f.name not in schema.names] + [T.StructField("_bad", _S)])
    lines = spark.read.text(path).withColumn("file", F.input_file_name()).where(F.length(F.trim("value")) > 0)
    parsed = lines.withColumn("d", F.from_json("value", both, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}))
    good = F.col("d._bad").isNull() & (F.col("d.days").isNotNull() | F.col("d.datetime").isNotNull())
    # a line that is a day is a document of one day
    own = F.struct(*[F.col(f"d.{f.name}").cast(f.dataType).alias(f.name) for f in day.fields])
    docs = parsed.where(good).select(*[F.col(f"d.{f.name}").alias(f.name) for f in top], F.coalesce(F.col("d.days"), F.array(own)).alias("days"))
    return explode_days(docs), parsed.where(F.coalesce(~good, F.lit(True))).select("file", F.col("value").alias("record"))


def explode_days(raw: DataFrame) -> DataFrame:
    """S3/S4 on parsed documents: one row per day."""
    top = [c for c in raw.columns if c != "days"]
    rows = raw.where(F.col("days").isNotNull()).select(*top, F.explode("days").alias("d"))
    day_cols = [f.name for f in raw.schema["days"].dataType.elementType.fields]
    df = rows.select(*[F.col(c).alias(f"_top_{c}") for c in top], "d.*")
    for c in top:   # day-level values win; document-level fill the gaps
        df = (df.withColumn(c, F.coalesce(F.col(c), F.col(f"_top_{c}"))) if c in day_cols
              else df.withColumnRenamed(f"_top_{c}", c))
        df = df.drop(f"_top_{c}")
    df = normalise_lists(df)
    return with_series_key(df).withColumn("ts", F.to_date("datetime"))


def missing_days(spark: SparkSession, path: str) -> DataFrame:
    """Documents that carry no ``days`` array (the reference's error case)."""
    raw = spark.read.schema(days_json_schema()).option("multiLine", True).json(path)
    return raw.where(F.col("days").isNull()).select(F.input_file_name().alias("file"))


def normalise_lists(df: DataFrame, first_only=("preciptype",), all_first: bool = False) -> DataFrame:
    """S4 (load) / S5 (serving, ``all_first``): array columns -> first element
    or ``'none'`` (empty or NULL list), or comma-joined strings."""
    out = {}
    for f in df.schema.fields:
        if isinstance(f.dataType, T.ArrayType):
            first = F.coalesce(F.try_element_at(F.col(f.name), F.lit(1)).cast("string"), F.lit("none"))
            if all_first or f.name in first_only:
                out[f.name] = first
            else:
                out[f.name] = F.array_join(F.transform(F.col(f.name), lambda x: x.cast("string")), ",")
    return df.withColumns(out) if out else df


MISSING_SOURCE = ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA")


def first_available(*readers) -> DataFrame | None:
    """The first source that exists and is non-empty (live feed, then
    archive file).  Each reader is a zero-argument callable; only a missing path
    falls through to the next one, every other error is raised."""
    for r in readers:
        try:
            df = r()
        except AnalysisException as e:
            if e.getCondition() in MISSING_SOURCE:
                continue
            raise
        if df is not None and not df.isEmpty():
            return df
    return None


def unparsed(raw: DataFrame, schema: T.StructType) -> DataFrame:
    """Values that :func:`typed_by_name` would turn into NULL: ``column_name, n_values`` of the
    columns that have any (``raw`` holds strings)."""
    types = {f.name: f.dataType for f in schema.fields if f.dataType != _S and f.name in raw.columns}
    if not types:
        return raw.sparkSession.createDataFrame([], "column_name string, n_values long")
    bad = [F.struct(F.lit(c).alias("column_name"),
                    F.count_if(F.col(f"`{c}`").isNotNull() & F.col(f"`{c}`").try_cast(t).isNull()).alias("n_values"))
           for c, t in types.items()]
    return raw.agg(F.array(*bad).alias("a")).select(F.explode("a").alias("e")).select("e.*").where("n_values > 0")


def fill_serving_columns(df: DataFrame) -> DataFrame:
    """Absent ``windspeedmax/mean/min`` := ``windspeed``; absent
    ``sealevelpressure`` := 1013.25."""
    add = {}
    for c in WIND_FILLS:
        if c not in df.columns and "windspeed" in df.columns:
            add[c] = F.col("windspeed")
    if "sealevelpressure" not in df.columns:
        add["sealevelpressure"] = F.lit(DEFAULT_SEALEVEL)
    return df.withColumns(add) if add else df


def stringify_objects(df: DataFrame, keep=()) -> DataFrame:
    """Any column that is neither numeric nor a key becomes a string."""
    num = (T.NumericType, T.BooleanType, T.DateType, T.TimestampType, T.TimestampNTZType)
    out = {f.name: F.col(f.name).cast("string") for f in df.schema.fields
           if f.name not in keep and not isinstance(f.dataType, num + (T.StringType,))}
    return df.withColumns(out) if out else df
