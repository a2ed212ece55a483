"""Registered queries: event rows -> top-N -> daily entity table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidecast.functions.scalars import count_column_name
from tidecast.operators import daily as D
from tidecast.operators.joins import sized_broadcast
from tidecast.plans.registry import register
from tidecast.plans.sqlviews import canon, strip, to_day, with_views
from tidecast.sources import fixtures as X

# Categories that always have a column, found or not; others found in the data get theirs too.
TYPE_VALUES = ["classic bike", "docked_bike", "electric_bike"]
USER_VALUES = ["casual", "member"]
COMBOS = [(t, u) for t in TYPE_VALUES for u in USER_VALUES]
TOP_N = 20


def top_ids(spark: SparkSession, sf_dir: str, n: int = TOP_N) -> DataFrame:
    clean = D.clean_events(X.trips(spark, sf_dir))
    return D.entity_counts(clean).orderBy(F.desc("total_rentals"), F.asc(D.ID)).limit(n).select(D.ID)


def prepared_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.prepare_events(X.trips(spark, sf_dir), top_ids(spark, sf_dir))


def pivot_values(spark: SparkSession, sf_dir: str) -> tuple[list[str], list[str], list[tuple[str, str]]]:
    return D.pivot_values(X.trips(spark, sf_dir), TYPE_VALUES, USER_VALUES)


def daily_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fused station-day table (before dimension joins)."""
    return D.daily_entity_table(prepared_events(spark, sf_dir), *pivot_values(spark, sf_dir))


def full_daily_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Station-day table with station and weather attributes and calendar columns."""
    return D.attach_dimensions(
        daily_table(spark, sf_dir),
        D.clean_station_list(X.station_list(spark, sf_dir)),
        D.clean_weather(X.weather(spark, sf_dir)),
    )


# ---- oracle SQL pieces -------------------------------------------------------

_CLEAN_IDS = f"SELECT {canon('start_station_id')} AS start_station_id FROM trips WHERE start_station_id IS NOT NULL"
_TOP = f"SELECT start_station_id FROM clean_ids GROUP BY start_station_id ORDER BY count(*) DESC, start_station_id LIMIT {TOP_N}"
_EVENTS = f"""
SELECT {canon('start_station_id')} AS start_station_id, {strip('start_station_name')} AS start_station_name,
       {strip('rideable_type')} AS rideable_type, {strip('member_casual')} AS member_casual,
       {to_day('started_at')} AS date
FROM trips
WHERE started_at IS NOT NULL AND start_station_id IS NOT NULL AND rideable_type IS NOT NULL AND member_casual IS NOT NULL"""
_EV_TOP = """
SELECT * FROM events_all
WHERE start_station_id IN (SELECT start_station_id FROM top_ids) AND date IS NOT NULL AND start_station_name IS NOT NULL"""

EVENT_CTES = [("clean_ids", _CLEAN_IDS), ("top_ids", _TOP), ("events_all", _EVENTS), ("ev", _EV_TOP)]


def _sql_cond(pred: str, weight: str = "1") -> str:
    return f"CAST(coalesce(sum(CASE WHEN {pred} THEN {weight} END), 0) AS BIGINT)"


def sql_pivot_columns(weight: str = "1") -> list[str]:
    combo = sorted((count_column_name(t, u), f"rideable_type = '{t}' AND member_casual = '{u}'") for t, u in COMBOS)
    cols = [f"{_sql_cond(p, weight)} AS {n}" for n, p in combo]
    cols += [f"{_sql_cond(f'rideable_type = {chr(39)}{t}{chr(39)}', weight)} AS {count_column_name(t)}" for t in sorted(TYPE_VALUES)]
    cols += [f"{_sql_cond(f'member_casual = {chr(39)}{u}{chr(39)}', weight)} AS {count_column_name(u)}" for u in sorted(USER_VALUES)]
    return cols


DAILY_SQL_BODY = (
    "SELECT date, start_station_id, start_station_name, CAST(count(*) AS BIGINT) AS total_rentals, "
    + ", ".join(sql_pivot_columns())
    + " FROM ev GROUP BY date, start_station_id, start_station_name"
)
DAILY_CTES = EVENT_CTES + [("daily", DAILY_SQL_BODY)]

_STATIONS = f"""
SELECT station_id, station_name, station_region FROM (
  SELECT {canon('station_id')} AS station_id, {strip('station_name')} AS station_name, station_region,
         row_number() OVER (PARTITION BY {canon('station_id')} ORDER BY {strip('station_name')} ASC NULLS LAST, station_region) AS rn
  FROM station_list) WHERE rn = 1"""
_WEATHER = f"""
SELECT tempmax, tempmin, precip, precipcover, windspeed, snow, sunrise, sunset, date FROM (
  SELECT *, {to_day('datetime')} AS date,
         row_number() OVER (PARTITION BY {to_day('datetime')} ORDER BY tempmax, tempmin, precip, precipcover, windspeed, snow, sunrise, sunset) AS rn
  FROM weather) WHERE rn = 1"""
DIM_CTES = [("stations", _STATIONS), ("weather_days", _WEATHER)]

FULL_SELECT = """
SELECT d.*, s.station_region, coalesce(s.station_name, d.start_station_name) AS station_name_final,
       w.tempmax, w.tempmin, w.precip, w.precipcover, w.windspeed, w.snow, w.sunrise, w.sunset,
       CAST(year(d.date) AS INTEGER) AS year, CAST(month(d.date) AS INTEGER) AS month,
       CAST(day(d.date) AS INTEGER) AS day, CAST(isodow(d.date) - 1 AS INTEGER) AS weekday,
       CAST(CASE WHEN isodow(d.date) - 1 IN (5, 6) THEN 1 ELSE 0 END AS INTEGER) AS is_weekend
FROM daily d LEFT JOIN stations s ON d.start_station_id = s.station_id
LEFT JOIN weather_days w ON d.date = w.date"""
FULL_CTES = DAILY_CTES + DIM_CTES + [("full_daily", FULL_SELECT)]


# ---- registered queries -------------------------------------------------------


@register(
    "daily_station_table",
    with_views(["trips"], "SELECT * FROM daily", DAILY_CTES),
)
def q_daily_station_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return daily_table(spark, sf_dir)


@register(
    "top_n_stations",
    with_views(
        ["trips"],
        """
SELECT CAST(row_number() OVER (ORDER BY c.total_rentals DESC, c.start_station_id) AS INTEGER) AS rank,
       c.start_station_id, c.total_rentals, n.start_station_name
FROM (SELECT start_station_id, CAST(count(*) AS BIGINT) AS total_rentals FROM clean_all GROUP BY start_station_id
      ORDER BY total_rentals DESC, start_station_id LIMIT 20) c
LEFT JOIN names n ON c.start_station_id = n.start_station_id""",
        [
            ("clean_all", f"SELECT {canon('start_station_id')} AS start_station_id, {strip('start_station_name')} AS start_station_name, started_at FROM trips WHERE start_station_id IS NOT NULL"),
            ("names", f"SELECT start_station_id, arg_max(start_station_name, {{'t': try_cast({strip('started_at')} AS TIMESTAMP), 'n': start_station_name}}) AS start_station_name FROM clean_all WHERE start_station_name IS NOT NULL GROUP BY start_station_id"),
        ],
    ),
)
def q_top_n_stations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.top_n_entities(D.clean_events(X.trips(spark, sf_dir)), TOP_N)


@register(
    "name_lookup",
    with_views(
        ["trips"],
        f"SELECT start_station_id, arg_max(start_station_name, {{'t': try_cast({strip('started_at')} AS TIMESTAMP), 'n': start_station_name}}) AS start_station_name FROM clean_all WHERE start_station_name IS NOT NULL GROUP BY start_station_id",
        [("clean_all", f"SELECT {canon('start_station_id')} AS start_station_id, {strip('start_station_name')} AS start_station_name, started_at FROM trips WHERE start_station_id IS NOT NULL")],
    ),
)
def q_name_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.name_lookup(D.clean_events(X.trips(spark, sf_dir)))


@register(
    "semi_top_n",
    with_views(["trips"], "SELECT start_station_id, start_station_name, rideable_type, member_casual, date FROM ev", EVENT_CTES),
)
def q_semi_top_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prepared_events(spark, sf_dir)


@register(
    "long_counts",
    with_views(
        ["trips"],
        "SELECT date, start_station_id, start_station_name, rideable_type, member_casual, CAST(count(*) AS BIGINT) AS rentals_count FROM ev GROUP BY ALL",
        EVENT_CTES,
    ),
)
def q_long_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.long_counts(prepared_events(spark, sf_dir))


@register(
    "daily_total",
    with_views(
        ["trips"],
        "SELECT date, start_station_id, start_station_name, CAST(count(*) AS BIGINT) AS total_rentals FROM ev GROUP BY ALL",
        EVENT_CTES,
    ),
)
def q_daily_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.daily_totals(D.long_counts(prepared_events(spark, sf_dir)))


def _pivot_sql(kind: str) -> str:
    cols = sql_pivot_columns("rentals_count")
    n_combo = len(COMBOS)
    sel = {"combo": cols[:n_combo], "bike": cols[n_combo:n_combo + len(TYPE_VALUES)], "user": cols[n_combo + len(TYPE_VALUES):]}[kind]
    return with_views(
        ["trips"],
        "SELECT date, start_station_id, start_station_name, " + ", ".join(sel) + " FROM long GROUP BY date, start_station_id, start_station_name",
        EVENT_CTES + [("long", "SELECT date, start_station_id, start_station_name, rideable_type, member_casual, count(*) AS rentals_count FROM ev GROUP BY ALL")],
    )


@register("pivot_combo", _pivot_sql("combo"))
def q_pivot_combo(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.pivot_combo_from_long(D.long_counts(prepared_events(spark, sf_dir)), pivot_values(spark, sf_dir)[2])


@register("pivot_bike", _pivot_sql("bike"))
def q_pivot_bike(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.pivot_from_long(D.long_counts(prepared_events(spark, sf_dir)), D.TYPE, pivot_values(spark, sf_dir)[0])


@register("pivot_user", _pivot_sql("user"))
def q_pivot_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.pivot_from_long(D.long_counts(prepared_events(spark, sf_dir)), D.USER, pivot_values(spark, sf_dir)[1])


@register("station_clean", with_views(["station_list"], "SELECT * FROM stations", DIM_CTES[:1]))
def q_station_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.clean_station_list(X.station_list(spark, sf_dir))


@register("weather_clean", with_views(["weather"], "SELECT * FROM weather_days", DIM_CTES[1:]))
def q_weather_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.clean_weather(X.weather(spark, sf_dir))


@register(
    "dim_join_fallback",
    with_views(
        ["trips", "station_list"],
        """SELECT d.date, d.start_station_id, d.start_station_name, d.total_rentals, s.station_region,
                  coalesce(s.station_name, d.start_station_name) AS station_name_final
           FROM daily d LEFT JOIN stations s ON d.start_station_id = s.station_id""",
        DAILY_CTES + DIM_CTES[:1],
    ),
)
def q_dim_join_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = daily_table(spark, sf_dir).select("date", D.ID, D.NAME, "total_rentals")
    out = D.attach_dimensions(d, D.clean_station_list(X.station_list(spark, sf_dir)), None)
    return out.select("date", D.ID, D.NAME, "total_rentals", "station_region", "station_name_final")


@register(
    "weather_join",
    with_views(
        ["trips", "weather"],
        """SELECT d.date, d.start_station_id, d.total_rentals, w.tempmax, w.precip, w.sunset
           FROM daily d LEFT JOIN weather_days w ON d.date = w.date""",
        DAILY_CTES + DIM_CTES[1:],
    ),
)
def q_weather_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = daily_table(spark, sf_dir).select("date", D.ID, "total_rentals")
    wx = sized_broadcast(D.clean_weather(X.weather(spark, sf_dir)))
    return d.join(wx, "date", "left").select("date", D.ID, "total_rentals", "tempmax", "precip", "sunset")


@register("full_daily_table", with_views(["trips", "station_list", "weather"], "SELECT * FROM full_daily", FULL_CTES))
def q_full_daily_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return full_daily_table(spark, sf_dir)


@register(
    "calendar_features",
    with_views(
        ["trips", "station_list", "weather"],
        "SELECT date, start_station_id, year, month, day, weekday, is_weekend FROM full_daily",
        FULL_CTES,
    ),
)
def q_calendar_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return full_daily_table(spark, sf_dir).select("date", D.ID, "year", "month", "day", "weekday", "is_weekend")


@register(
    "dropna_subset",
    with_views(
        ["trips"],
        "SELECT * FROM trips WHERE started_at IS NOT NULL AND start_station_id IS NOT NULL AND start_station_name IS NOT NULL AND rideable_type IS NOT NULL AND member_casual IS NOT NULL",
    ),
)
def q_dropna_subset(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.trips(spark, sf_dir).dropna(subset=["started_at", D.ID, D.NAME, D.TYPE, D.USER])


@register(
    "scan_partial_agg",
    with_views(
        ["trips"],
        "SELECT start_station_id, CAST(count(*) AS BIGINT) AS total_rentals FROM clean_ids GROUP BY start_station_id",
        EVENT_CTES[:1],
    ),
)
def q_scan_partial_agg(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Full-table count per entity: partial aggregate per split, final after the shuffle."""
    return D.entity_counts(D.clean_events(X.trips(spark, sf_dir)))


@register(
    "top50_pickups",
    with_views(
        ["trips"],
        """SELECT start_station_name AS station_name, CAST(sum(total_rentals) AS BIGINT) AS pickup_counts
           FROM daily_all GROUP BY start_station_name ORDER BY pickup_counts DESC, station_name LIMIT 50""",
        EVENT_CTES[2:3] + [("daily_all", "SELECT date, start_station_name, count(*) AS total_rentals FROM events_all WHERE date IS NOT NULL AND start_station_name IS NOT NULL GROUP BY ALL")],
    ),
)
def q_top50_pickups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stations by summed daily pickups, top 50 (a usage-frequency table built from all events)."""
    ev = D.prepare_events(X.trips(spark, sf_dir), None)
    usage = ev.groupBy("date", D.NAME).agg(F.count(F.lit(1)).alias("pickup_counts"))
    return (
        usage.groupBy(F.col(D.NAME).alias("station_name"))
        .agg(F.sum("pickup_counts").cast("long").alias("pickup_counts"))
        .orderBy(F.desc("pickup_counts"), "station_name")
        .limit(50)
    )


@register(
    "dedupe_first",
    with_views(
        ["trips"],
        f"""SELECT start_station_id, start_station_name, started_at, rideable_type, member_casual FROM (
              SELECT {canon('start_station_id')} AS start_station_id, {strip('start_station_name')} AS start_station_name,
                     started_at, rideable_type, member_casual,
                     row_number() OVER (PARTITION BY {canon('start_station_id')}
                                        ORDER BY try_cast({strip('started_at')} AS TIMESTAMP) ASC NULLS LAST, {strip('start_station_name')} ASC NULLS LAST,
                                                 rideable_type, member_casual) AS rn
              FROM trips WHERE start_station_id IS NOT NULL) WHERE rn = 1""",
    ),
)
def q_dedupe_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First event per entity: earliest parsable time, then name, type and user type."""
    from tidecast.functions.scalars import tolerant_timestamp

    ev = D.clean_events(X.trips(spark, sf_dir))
    order = [tolerant_timestamp(D.TS).asc_nulls_last(), F.col(D.NAME).asc_nulls_last(), F.col(D.TYPE), F.col(D.USER)]
    return D.dedupe_first(ev, [D.ID], order).select(D.ID, D.NAME, D.TS, D.TYPE, D.USER)
