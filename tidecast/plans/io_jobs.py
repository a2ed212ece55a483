"""Registered queries: scans, sinks and round trips through the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidecast.operators import daily as D
from tidecast.plans.analysis_jobs import _REDUCED, _VIEWS, REDUCED_FEATURES, TARGET, _v
from tidecast.plans.daily_jobs import DAILY_CTES, EVENT_CTES, FULL_CTES, daily_table, full_daily_table
from tidecast.plans.registry import register
from tidecast.plans.sqlviews import with_views
from tidecast.session import scratch_path
from tidecast.sources import fixtures as X
from tidecast.sources import sinks as K
from tidecast.sources.tables import optional_csv, table
from tidecast.operators.features import reduced_dataset

_FULL = with_views(["trips", "station_list", "weather"], "SELECT * FROM full_daily", FULL_CTES)


@register("csv_roundtrip", _FULL)
def q_csv_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wide station-day table written as header CSV and read back with its declared schema."""
    df = full_daily_table(spark, sf_dir)
    path = K.write_csv(df, scratch_path(spark, "daily_csv"))
    return K.read_csv_like(spark, path, df)


@register("csv_gz_roundtrip", with_views(["trips"], "SELECT * FROM daily", DAILY_CTES))
def q_csv_gz_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gzip CSV sink and scan (a .gz file is one split: the scan is repartitioned after it)."""
    df = daily_table(spark, sf_dir)
    path = K.write_csv(df, scratch_path(spark, "daily_csv_gz"), gzip=True)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return K.read_csv_like(spark, path, df).repartition(n)


@register("parquet_roundtrip", _v(_VIEWS, "SELECT * FROM reduced", [("reduced", _REDUCED)]))
def q_parquet_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reduced table written as parquet partitioned by year, read back (partition pruning ready)."""
    df = reduced_dataset(full_daily_table(spark, sf_dir), REDUCED_FEATURES, TARGET)
    path = K.write_parquet(df, scratch_path(spark, "reduced_parquet"), partition_by=["year"])
    return spark.read.parquet(path).select(*df.columns)


@register(
    "json_roundtrip",
    with_views(
        ["trips"],
        "SELECT date, start_station_id, start_station_name, total_rentals, member_count, casual_count FROM daily",
        DAILY_CTES,
    ),
)
def q_json_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested records (struct key, struct counts, array of type counts) as JSON and back."""
    d = daily_table(spark, sf_dir)
    nested = d.select(
        F.struct("date", D.ID, D.NAME).alias("key"),
        F.struct("total_rentals", "member_count", "casual_count").alias("counts"),
        F.array("classic_bike_count", "docked_bike_count", "electric_bike_count").alias("by_type"),
    )
    path = K.write_json(nested, scratch_path(spark, "daily_json"))
    back = K.read_json_like(spark, path, nested)
    return back.select("key.date", "key.start_station_id", "key.start_station_name", "counts.total_rentals", "counts.member_count", "counts.casual_count")


@register(
    "scan_project",
    with_views(["trips"], "SELECT started_at, start_station_id FROM trips"),
)
def q_scan_project(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two columns of the event view: the parquet scan reads only the columns they need."""
    return X.trips(spark, sf_dir).select("started_at", "start_station_id")


@register("scan_full", "SELECT * FROM supplier")
def q_scan_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "supplier")


@register("optional_source", with_views(["station_list"], "SELECT station_id, station_name FROM station_list"))
def q_optional_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A present optional file is read; a missing one gives an empty table with the same schema."""
    stations = X.station_list(spark, sf_dir).select("station_id", "station_name")
    path = K.write_csv(stations, scratch_path(spark, "stations_csv"))
    present = optional_csv(spark, path, X.STATION_SCHEMA)
    missing = optional_csv(spark, scratch_path(spark, "absent") + "/station_list.csv", X.STATION_SCHEMA)
    return present.unionByName(missing)


@register(
    "empty_input",
    with_views(
        ["trips"],
        "SELECT * FROM daily",
        [("clean_ids", EVENT_CTES[0][1]), ("top_ids", EVENT_CTES[1][1]),
         ("events_all", EVENT_CTES[2][1] + " AND started_at = 'bad'"), ("ev", EVENT_CTES[3][1]),
         ("daily", DAILY_CTES[-1][1])],
    ),
)
def q_empty_input(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Only the rows with an unparsable start time: cleaning drops them all, the result is empty with its schema."""
    from tidecast.plans.daily_jobs import COMBOS, TYPE_VALUES, USER_VALUES, top_ids

    bad = X.trips(spark, sf_dir).where(F.col("started_at") == "bad")
    ev = D.prepare_events(bad, top_ids(spark, sf_dir))
    return D.daily_entity_table(ev, TYPE_VALUES, USER_VALUES, COMBOS)


@register(
    "preview_limit",
    with_views(
        ["trips"],
        """SELECT start_station_name AS station_name, CAST(sum(total_rentals) AS BIGINT) AS pickup_counts
           FROM daily_all GROUP BY start_station_name ORDER BY pickup_counts DESC, station_name LIMIT 10""",
        EVENT_CTES[2:3] + [("daily_all", "SELECT date, start_station_name, count(*) AS total_rentals FROM events_all WHERE date IS NOT NULL AND start_station_name IS NOT NULL GROUP BY ALL")],
    ),
)
def q_preview_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Head preview (10 rows) of the ranked usage table: a limit that is the feature."""
    from tidecast.plans.daily_jobs import q_top50_pickups

    return q_top50_pickups(spark, sf_dir).limit(10)

