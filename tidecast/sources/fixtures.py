"""Domain views over the driver's base tables.

The reference works on bike-rental trips, a station list and daily weather.
These views derive the same shapes from the TPC-H-like tables so that every
operator runs on data whose size grows with the scale factor:

* ``trips``        <- lineitem (one rental per line item)
* ``station_list`` <- supplier
* ``weather``      <- orders aggregated per order date
* ``train_table``  <- orders (one labelled row per order)
* ``predictions``  <- train_table with a fixed formula as prediction
* ``knn_points``   <- embeddings
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidecast.sources.tables import table

TRIPS_SCHEMA = T.StructType(
    [
        T.StructField("started_at", T.StringType()),
        T.StructField("start_station_id", T.StringType()),
        T.StructField("start_station_name", T.StringType()),
        T.StructField("rideable_type", T.StringType()),
        T.StructField("member_casual", T.StringType()),
    ]
)

STATION_SCHEMA = T.StructType(
    [T.StructField("station_id", T.StringType()), T.StructField("station_name", T.StringType())]
)

# The weather file's numeric columns, then its text columns.
WEATHER_NUMERIC = [
    "tempmax", "tempmin", "temp", "feelslikemax", "feelslikemin", "feelslike", "dew",
    "humidity", "precip", "precipprob", "precipcover", "snow", "snowdepth", "windgust",
    "windspeed", "winddir", "sealevelpressure", "cloudcover", "visibility",
    "solarradiation", "solarenergy", "uvindex", "severerisk",
]
WEATHER_TEXT = ["conditions", "icon", "sunrise", "sunset"]

WEATHER_SCHEMA = T.StructType(
    [T.StructField("datetime", T.StringType())]
    + [T.StructField(c, T.DoubleType()) for c in WEATHER_NUMERIC]
    + [T.StructField(c, T.StringType()) for c in WEATHER_TEXT]
)

TRAIN_FEATURES = ["start_station_id", "time_idx", "month", "year", "x1", "x2"]
TARGET = "total_rentals"
TIME_COL = "time_idx"
STATION_COL = "start_station_id"


def trips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rentals with padded ids, missing names and unparsable start times."""
    return trips_from_lineitem(table(spark, sf_dir, "lineitem"))


def trips_from_lineitem(li: DataFrame) -> DataFrame:
    """The trips view over a lineitem frame (batch or streaming)."""
    return li.select(
        F.when(F.col("l_partkey") % 97 == 0, F.lit("bad"))
        .otherwise(F.to_date("l_shipdate").cast("string"))
        .alias("started_at"),
        F.concat(F.lit(" "), F.col("l_suppkey").cast("string"), F.lit(" ")).alias("start_station_id"),
        F.when(F.col("l_suppkey") % 7 == 0, F.lit(None).cast("string"))
        .otherwise(F.concat(F.lit("Station "), F.col("l_suppkey").cast("string")))
        .alias("start_station_name"),
        F.when(F.col("l_returnflag") == "A", "classic bike")
        .when(F.col("l_returnflag") == "N", "electric_bike")
        .otherwise("docked_bike")
        .alias("rideable_type"),
        F.when(F.col("l_linestatus") == "F", "member").otherwise("casual").alias("member_casual"),
    )


def station_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Station dimension; odd ids carry no name so the name fallback is exercised."""
    s = table(spark, sf_dir, "supplier")
    return s.select(
        F.col("s_suppkey").cast("string").alias("station_id"),
        F.when(F.col("s_suppkey") % 2 == 0, F.col("s_name")).alias("station_name"),
        F.col("s_nationkey").alias("station_region"),
    )


def weather(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily weather, one row per order date (days without orders are missing)."""
    o = table(spark, sf_dir, "orders")
    d = F.to_date("o_orderdate")
    cust10 = (F.col("o_custkey") % 10).cast("double")
    return (
        o.groupBy(d.alias("date"))
        .agg(
            (F.max("o_totalprice") / 10000).alias("tempmax"),
            (F.min("o_totalprice") / 10000).alias("tempmin"),
            F.avg(cust10).alias("precip"),
            (F.avg(cust10) * 2 + 1).alias("precipcover"),
            F.count(F.lit(1)).cast("double").alias("windspeed"),
            F.lit(0.0).alias("snow"),
            F.concat(F.lit("2020-01-01 06:"), F.lpad((F.min("o_custkey") % 60).cast("string"), 2, "0"), F.lit(":00")).alias("sunrise"),
            F.concat(F.lit("2020-01-01 18:"), F.lpad((F.count(F.lit(1)) % 60).cast("string"), 2, "0"), F.lit(":00")).alias("sunset"),
        )
        .select(F.col("date").cast("string").alias("datetime"), "tempmax", "tempmin", "precip", "precipcover", "windspeed", "snow", "sunrise", "sunset")
    )


def train_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One labelled row per order with a signal-carrying target and some zero targets."""
    o = table(spark, sf_dir, "orders")
    day = F.to_date("o_orderdate")
    x1 = F.col("o_totalprice") / 100000
    x2 = (F.col("o_custkey") % 50).cast("double") / 10
    month = F.month(day)
    label = F.when(F.col("o_orderkey") % 101 == 0, F.lit(0.0)).otherwise(
        F.floor(20 + 5 * month + 6 * x2 + 10 * x1) + ((F.col("o_orderkey") * 7919) % 13).cast("double")
    )
    return o.select(
        F.col("o_orderkey").alias("id"),
        (F.col("o_custkey") % 20).cast("double").alias("start_station_id"),
        F.datediff(day, F.lit("1995-01-01").cast("date")).cast("double").alias("time_idx"),
        month.alias("month"),
        F.year(day).alias("year"),
        x1.alias("x1"),
        x2.alias("x2"),
        label.cast("double").alias("total_rentals"),
    )


def with_prediction(t: DataFrame) -> DataFrame:
    """train_table rows with a fixed formula as the prediction, and its residual."""
    pred = 30 + 5 * F.col("month") + 5 * F.col("x2")
    return t.withColumn("prediction", pred).withColumn("residual", F.col("total_rentals") - pred)


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """train_table with a fixed formula as the prediction (deterministic metric input)."""
    return with_prediction(train_table(spark, sf_dir)).select("id", "time_idx", "start_station_id", "total_rentals", "prediction", "residual")


KNN_DIMS = 64  # fixed value: the length of the embeddings


def knn_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embedding rows as (vec_id, features array<double>, label, role); every 5th id is a query."""
    e = table(spark, sf_dir, "embeddings")
    feats = F.transform("embedding", lambda v: v.cast("double"))
    return e.select(
        "vec_id",
        feats.alias("features"),
        F.col("label").cast("double").alias("label"),
        F.when(F.col("vec_id") % 5 == 0, "query").otherwise("train").alias("role"),
    )
