"""Column profile, descriptions and roles.

P1 runs as one wide aggregate (missing, distinct, min/max/mean for every
column at once) plus a first-occurrence top-5 per column; Spark plans
``row_number() <= 5`` with a partial window-group limit before the shuffle,
so no column's distinct values are gathered in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

SAMPLE_VALUES = 5

# Fixed values that must equal the reference: column dictionary.
COLUMN_DESCRIPTIONS = [
    ('name', 'Human-readable location name returned by the weather provider.'),
    ('address', 'Original query string for the location.'),
    ('resolvedAddress', 'Provider-normalised address string.'),
    ('latitude', 'Latitude of the observed location (decimal degrees).'),
    ('longitude', 'Longitude of the observed location (decimal degrees).'),
    ('datetime', 'Local calendar date of the aggregated daily record (YYYY-MM-DD).'),
    ('tempmax', 'Daily maximum temperature in °C.'),
    ('tempmin', 'Daily minimum temperature in °C.'),
    ('temp', 'Daily average temperature in °C — this is the forecasting target.'),
    ('feelslikemax', 'Maximum “feels like” (apparent) temperature in °C.'),
    ('feelslikemin', 'Minimum “feels like” (apparent) temperature in °C.'),
    ('feelslike', 'Mean “feels like” (apparent) temperature in °C.'),
    ('dew', 'Average dew point temperature in °C.'),
    ('humidity', 'Mean relative humidity (%).'),
    ('precip', 'Total precipitation depth in mm (liquid equivalent).'),
    ('precipprob', 'Probability of precipitation during the day (%).'),
    ('precipcover', 'Portion of the day with measurable precipitation (%).'),
    ('preciptype', 'Dominant precipitation type (rain, snow, etc.).'),
    ('windgust', 'Peak wind gust speed (km/h).'),
    ('windspeed', 'Headline sustained wind speed summary (km/h).'),
    ('windspeedmax', 'Maximum sustained wind speed (km/h).'),
    ('windspeedmean', 'Mean sustained wind speed (km/h).'),
    ('windspeedmin', 'Minimum sustained wind speed (km/h).'),
    ('winddir', 'Prevailing wind direction (degrees from north).'),
    ('sealevelpressure', 'Average sea-level pressure (hPa).'),
    ('cloudcover', 'Average cloud cover (%).'),
    ('visibility', 'Average horizontal visibility (km).'),
    ('solarradiation', 'Mean solar radiation (W/m²).'),
    ('solarenergy', 'Total daily solar energy (MJ/m²).'),
    ('uvindex', 'Maximum UV index (unitless).'),
    ('severerisk', 'Severe weather risk index (0–100, higher means larger risk).'),
    ('sunrise', 'Local sunrise timestamp (ISO 8601).'),
    ('sunset', 'Local sunset timestamp (ISO 8601).'),
    ('moonphase', 'Lunar phase fraction: 0=new moon, 0.5=full moon, 1=next new moon.'),
    ('conditions', 'Short text summary of dominant weather conditions.'),
    ('description', 'Narrative daily weather description.'),
    ('icon', 'Icon category matching the conditions (e.g., rain, partly-cloudy-day).'),
    ('source', 'Data source flag (observations vs forecasts).'),
]

# Fixed values that must equal the reference: default role lists.
DEFAULT_CATEGORICAL = ['preciptype', 'conditions', 'icon', 'month', 'day_of_week', 'hour', 'year']
DEFAULT_TEXT = ['description']

_NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)


def type_name(dt: T.DataType) -> str:
    """Engine-neutral type label."""
    if isinstance(dt, (T.FloatType, T.DoubleType, T.DecimalType)):
        return "float"
    if isinstance(dt, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return "int"
    if isinstance(dt, T.DateType):
        return "date"
    if isinstance(dt, (T.TimestampType, T.TimestampNTZType)):
        return "timestamp"
    if isinstance(dt, T.BooleanType):
        return "bool"
    return "string"


def descriptions(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(COLUMN_DESCRIPTIONS, "column_name string, description string")


def profile(df: DataFrame, order: str, columns=None) -> DataFrame:
    """P1 (+P2): one row per column with ``dtype``, ``missing``, ``n_unique``,
    ``min``/``max``/``mean`` for
    numeric columns, ``sample_values`` (first 5 distinct non-null values by
    ``order``, joined with '|'; floats shown with 4 places) and the dictionary
    ``description``.

    Rows are unpivoted once and aggregated by ``(column, raw value)``, combined
    map-side; distinct counts, missing counts and samples all come from that
    aggregate, the numeric statistics from a plain one-row aggregate."""
    spark = df.sparkSession
    fields = [f for f in df.schema.fields if columns is None or f.name in columns]
    floats = (T.FloatType, T.DoubleType, T.DecimalType)

    def entry(f):
        c = F.col(f.name)
        shown = F.round(c.cast("double"), 4) if isinstance(f.dataType, floats) else c
        return F.struct(F.lit(f.name).alias("column_name"), c.cast("string").alias("raw"), shown.cast("string").alias("shown"))
    aggs = []
    for f in fields:
        c = F.col(f.name)
        num = isinstance(f.dataType, _NUMERIC)
        aggs.append(F.struct(F.lit(f.name).alias("column_name"), F.lit(type_name(f.dataType)).alias("dtype"),
                             *[(g(c).cast("double") if num else F.lit(None).cast("double")).alias(n)
                               for n, g in (("min", F.min), ("max", F.max), ("mean", F.avg))]))
    stats = df.agg(F.array(*aggs).alias("a")).select(F.explode("a").alias("s")).select("s.*")
    seen = (df.select(F.col(order).alias("_o"), F.explode(F.array(*[entry(f) for f in fields])).alias("e"))
              .groupBy("e.column_name", "e.raw", "e.shown").agg(F.min("_o").alias("_o"), F.count(F.lit(1)).alias("_c")))
    counts = seen.groupBy("column_name").agg(
        F.coalesce(F.sum(F.when(F.col("raw").isNull(), F.col("_c"))), F.lit(0)).alias("missing"), F.count("raw").alias("n_unique"))
    w = Window.partitionBy("column_name").orderBy("_o", "raw")
    top = (seen.where(F.col("raw").isNotNull()).withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= SAMPLE_VALUES)
               .groupBy("column_name")
               .agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_r", "shown"))),
                                             lambda s: s["shown"]), "|").alias("sample_values")))
    return (stats.join(counts, "column_name", "left").join(top, "column_name", "left")
                 .join(F.broadcast(descriptions(spark)), "column_name", "left")      # 38 rows
                 .withColumns({"missing": F.coalesce("missing", F.lit(0)), "n_unique": F.coalesce("n_unique", F.lit(0)),
                               "description": F.coalesce("description", F.lit(""))})
                 .select("column_name", "dtype", "missing", "n_unique", "min", "max", "mean", "sample_values", "description"))


def column_roles(df: DataFrame, categorical=None, text=None, exclude=()) -> dict:
    """categorical/text by name list, every other column numeric."""
    categorical = DEFAULT_CATEGORICAL if categorical is None else categorical
    text = DEFAULT_TEXT if text is None else text
    cols = [c for c in df.columns if c not in exclude]
    cat = [c for c in categorical if c in cols]
    txt = [c for c in text if c in cols]
    return {"numeric": [c for c in cols if c not in cat + txt], "categorical": cat, "text": txt}
