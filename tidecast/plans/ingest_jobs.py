"""Registered queries: the whole job from text files, and metric files collected from model folders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidecast.operators import compare as C
from tidecast.operators import daily as D
from tidecast.plans.compare_jobs import KNOWN_FOLDERS, _cv, run_metrics_wide
from tidecast.plans.daily_jobs import FULL_CTES, TOP_N, TYPE_VALUES, USER_VALUES
from tidecast.plans.registry import register
from tidecast.plans.sqlviews import with_views
from tidecast.session import scratch_path
from tidecast.sources import fixtures as X
from tidecast.sources import sinks as K
from tidecast.sources.tables import optional_csv, required_csv

# The event file has more columns than the job reads; the scan parses only those it needs.
TRIPS_FILE = T.StructType([T.StructField(c, T.StringType()) for c in ("ride_id", "rideable_type", "started_at", "start_station_name", "start_station_id", "member_casual")])
WEATHER_COLUMNS = ["datetime", "tempmax", "tempmin", "precip", "precipcover", "windspeed", "snow", "sunrise", "sunset"]
STATION_FILE = T.StructType([*X.STATION_SCHEMA.fields, T.StructField("station_region", T.LongType())])


def write_sources(spark: SparkSession, sf_dir: str) -> dict[str, str]:
    """Trips, stations and weather as header CSV files in the shared folder, with all columns of their declared schemas."""
    root = scratch_path(spark, "sources")
    trips = X.trips(spark, sf_dir).withColumn("ride_id", F.xxhash64("started_at", "start_station_id").cast("string"))
    weather = X.weather(spark, sf_dir)
    every = [F.col(f.name).cast(f.dataType) if f.name in weather.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in X.WEATHER_SCHEMA.fields]
    return {
        "trips": K.write_csv(trips.select(*TRIPS_FILE.names), f"{root}/trips.csv"),
        "stations": K.write_csv(X.station_list(spark, sf_dir).select(*STATION_FILE.names), f"{root}/stations.csv"),
        "weather": K.write_csv(weather.select(*every), f"{root}/weather.csv", gzip=True),
    }


@register("daily_from_csv", with_views(["trips", "station_list", "weather"], "SELECT * FROM full_daily", FULL_CTES))
def q_daily_from_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole first job from CSV files with declared schemas, sorted by station and date at the sink.

    Five of the trip columns and nine of the 28 weather columns are parsed.
    """
    at = write_sources(spark, sf_dir)
    trips = required_csv(spark, at["trips"], TRIPS_FILE).select(*X.TRIPS_SCHEMA.names)
    counts = D.entity_counts(D.clean_events(trips))
    top = counts.orderBy(F.desc("total_rentals"), F.asc(D.ID)).limit(TOP_N).select(D.ID)
    daily = D.daily_entity_table(D.prepare_events(trips, top), *D.pivot_values(trips, TYPE_VALUES, USER_VALUES))
    stations = D.clean_station_list(optional_csv(spark, at["stations"], STATION_FILE))
    weather = D.clean_weather(required_csv(spark, at["weather"], X.WEATHER_SCHEMA).select(*WEATHER_COLUMNS))
    full = D.attach_dimensions(daily, stations, weather)
    path = K.write_sorted_csv(full, scratch_path(spark, "daily_sorted"), [D.ID, "date"])
    return K.read_csv_like(spark, path, full)


@register("collect_metric_csv", _cv("SELECT * FROM wide"))
def q_collect_metric_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`<folder>/results/metrics.csv` of every model folder: differing columns, first row each, absent and empty ones skipped."""
    wide = run_metrics_wide(spark, sf_dir)
    root = scratch_path(spark, "models")
    folders = [r[0] for r in wide.select("folder_name").distinct().collect()]  # a handful of model folders
    for name in folders:
        own = wide.where(F.col("folder_name") == name).drop("folder_name")
        if own.where("strategy IS NOT NULL").isEmpty():
            own = own.drop("strategy")
        K.write_csv(own.coalesce(1), f"{root}/{name}/results/metrics.csv")
    K.write_csv(wide.drop("folder_name").limit(0), f"{root}/empty_model/results/metrics.csv")
    found, skipped = C.collect_metric_csv(spark, root, [*KNOWN_FOLDERS, "empty_model"], wide.drop("folder_name").schema)
    missed = {n for n in folders if n in skipped}
    if missed or "empty_model" not in skipped:
        raise ValueError(f"metric files of {sorted(missed)} were not read")
    return found.select(*wide.columns)
