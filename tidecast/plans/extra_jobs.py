"""Registered queries: streaming counts and the second tier described in the reference's notes
(lags, rolling mean, cyclical and extra calendar features, hourly demand, residual slices,
RMSLE, descriptive statistics, rare categories, holdout split, learning curve)."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidecast.operators import daily as D
from tidecast.operators import models as M
from tidecast.operators.joins import sized_broadcast
from tidecast.operators.split import holdout_split
from tidecast.plans import daily_jobs as DJ
from tidecast.plans import model_jobs as MJ
from tidecast.plans.registry import register
from tidecast.plans.sqlviews import with_views
from tidecast.session import scratch_path
from tidecast.sources import fixtures as X
from tidecast.sources.tables import table
from tidecast.streaming import incremental as S

R = 6
_DAILY = lambda body, extra=None: with_views(["trips"], body, DJ.DAILY_CTES + (extra or []))

_ALL_EVENTS_DAILY = DJ.EVENT_CTES[2:3] + [
    ("all_daily", "SELECT date, start_station_id, start_station_name, CAST(count(*) AS BIGINT) AS total_rentals, "
     + ", ".join(DJ.sql_pivot_columns()) + " FROM events_all WHERE date IS NOT NULL AND start_station_name IS NOT NULL "
     "GROUP BY date, start_station_id, start_station_name")
]


@register("streaming_daily_counts", with_views(["trips"], "SELECT * FROM all_daily", _ALL_EVENTS_DAILY))
def q_streaming_daily_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Station-day counts of all entities, built incrementally by a file stream (running aggregate)."""
    li_schema = table(spark, sf_dir, "lineitem").schema
    events = X.trips_from_lineitem(S.event_stream(spark, sf_dir, li_schema, "lineitem.parquet"))
    out = scratch_path(spark, "stream_out")
    S.run_to_partials(events, out, scratch_path(spark, "stream_ckpt"), DJ.TYPE_VALUES, DJ.USER_VALUES)
    schema = S.running_daily_counts(events, DJ.TYPE_VALUES, DJ.USER_VALUES).schema
    return S.merged_partials(spark, out, schema, ["date", D.ID, D.NAME])


@register(
    "lag_features",
    _DAILY("""SELECT d.date, d.start_station_id, d.start_station_name, d.total_rentals,
                     p1.total_rentals AS lag_1, p7.total_rentals AS lag_7
              FROM daily d
              LEFT JOIN daily p1 ON p1.start_station_id = d.start_station_id AND p1.start_station_name = d.start_station_name AND p1.date = d.date - INTERVAL 1 DAY
              LEFT JOIN daily p7 ON p7.start_station_id = d.start_station_id AND p7.start_station_name = d.start_station_name AND p7.date = d.date - INTERVAL 7 DAY"""),
)
def q_lag_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Demand of the previous day and of 7 days earlier; a missing day gives null (range frames on the day number)."""
    d = DJ.daily_table(spark, sf_dir).select("date", D.ID, D.NAME, "total_rentals")
    day = F.datediff("date", F.lit("1970-01-01").cast("date"))
    by_day = Window.partitionBy(D.ID, D.NAME).orderBy(day)
    lag = lambda n: F.max("total_rentals").over(by_day.rangeBetween(-n, -n))  # noqa: E731  one row a day
    return d.select("date", D.ID, D.NAME, "total_rentals", lag(1).alias("lag_1"), lag(7).alias("lag_7"))


@register(
    "rolling_mean",
    _DAILY(f"""SELECT date, start_station_id, start_station_name,
                      round(avg(total_rentals) OVER (PARTITION BY start_station_id, start_station_name ORDER BY datediff('day', DATE '1970-01-01', date)
                                                     RANGE BETWEEN 7 PRECEDING AND 1 PRECEDING), {R}) AS rolling_mean_7
               FROM daily"""),
)
def q_rolling_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean demand of the 7 calendar days before each day (range frame on the day number).

    The partition is one entity's days: bounded by the calendar, not by the event count.
    """
    d = DJ.daily_table(spark, sf_dir)
    w = Window.partitionBy(D.ID, D.NAME).orderBy(F.unix_date("date")).rangeBetween(-7, -1)
    return d.select("date", D.ID, D.NAME, F.round(F.avg("total_rentals").over(w), R).alias("rolling_mean_7"))


@register(
    "cyclical_time",
    _DAILY(f"""SELECT date, start_station_id,
                      round(sin(2 * pi() * month(date) / 12), {R}) AS month_sin, round(cos(2 * pi() * month(date) / 12), {R}) AS month_cos,
                      round(sin(2 * pi() * (isodow(date) - 1) / 7), {R}) AS weekday_sin, round(cos(2 * pi() * (isodow(date) - 1) / 7), {R}) AS weekday_cos
               FROM daily"""),
)
def q_cyclical_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = DJ.daily_table(spark, sf_dir)
    m, wd = F.month("date"), F.weekday("date")
    return d.select("date", D.ID,
                    F.round(F.sin(2 * math.pi * m / 12), R).alias("month_sin"), F.round(F.cos(2 * math.pi * m / 12), R).alias("month_cos"),
                    F.round(F.sin(2 * math.pi * wd / 7), R).alias("weekday_sin"), F.round(F.cos(2 * math.pi * wd / 7), R).alias("weekday_cos"))


@register(
    "calendar_extra",
    _DAILY("SELECT date, start_station_id, CAST(dayofyear(date) AS INTEGER) AS day_of_year, CAST(weekofyear(date) AS INTEGER) AS week_of_year FROM daily"),
)
def q_calendar_extra(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = DJ.daily_table(spark, sf_dir)
    return d.select("date", D.ID, F.dayofyear("date").alias("day_of_year"), F.weekofyear("date").alias("week_of_year"))


@register(
    "hourly_demand",
    "SELECT date_trunc('hour', ts) AS hour, event_type, CAST(count(*) AS BIGINT) AS n_events, round(sum(value), 6) AS value FROM events GROUP BY ALL",
)
def q_hourly_demand(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events per hour and type (the panel at hourly grain)."""
    e = table(spark, sf_dir, "events")
    return e.groupBy(F.date_trunc("hour", "ts").alias("hour"), "event_type").agg(
        F.count(F.lit(1)).cast("long").alias("n_events"), F.round(F.sum("value"), 6).alias("value"))


@register(
    "residual_slices",
    MJ._mv(f"""SELECT p.start_station_id, t.month, CAST(count(*) AS BIGINT) AS n, round(avg(abs(p.residual)), {R}) AS mean_abs_residual,
                      round(avg(p.residual), {R}) AS mean_residual
               FROM pred_split p JOIN train_table t USING (id) WHERE p.split = 'test' GROUP BY p.start_station_id, t.month"""),
)
def q_residual_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Test residuals by entity and month: one scan, the month stays beside the prediction."""
    p = MJ.chronological_split(X.with_prediction(X.train_table(spark, sf_dir)), MJ.TIME).where("split = 'test'")
    return p.groupBy("start_station_id", "month").agg(*_slice_errors())


def _slice_errors() -> list:
    return [F.count(F.lit(1)).cast("long").alias("n"), F.round(F.avg(F.abs("residual")), R).alias("mean_abs_residual"), F.round(F.avg("residual"), R).alias("mean_residual")]


# The bounds of the demand levels, and the daily precipitation from which a day is wet.
DEMAND_LEVELS = [("none", 0), ("low", 60), ("medium", 90)]
WET = 4.5

_DEMAND_SQL = "CASE " + " ".join(f"WHEN p.total_rentals <= {top} THEN '{name}'" for name, top in DEMAND_LEVELS) + " ELSE 'high' END"


@register(
    "residual_profile",
    with_views(
        ["train_table", "predictions", "weather"],
        f"""SELECT dimension, slice, CAST(count(*) AS BIGINT) AS n, round(avg(abs(residual)), {R}) AS mean_abs_residual, round(avg(residual), {R}) AS mean_residual
            FROM (SELECT residual, unnest(['season', 'weather', 'demand']) AS dimension, unnest([
                    CASE WHEN t.month IN (12, 1, 2) THEN 'winter' WHEN t.month <= 5 THEN 'spring' WHEN t.month <= 8 THEN 'summer' ELSE 'autumn' END,
                    CASE WHEN w.precip IS NULL THEN 'unknown' WHEN w.precip >= {WET} THEN 'wet' ELSE 'dry' END, {_DEMAND_SQL}]) AS slice
                  FROM pred_split p JOIN train_table t USING (id)
                  LEFT JOIN weather w ON CAST(w.datetime AS DATE) = DATE '1995-01-01' + CAST(t.time_idx AS INTEGER)
                  WHERE p.split = 'test') GROUP BY dimension, slice""",
        MJ._SPLIT_CTES + [MJ._PRED_SPLIT],
    ),
)
def q_residual_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Test residuals by season, weather of the day and level of demand, from one scan of the predictions."""
    p = MJ.chronological_split(X.with_prediction(X.train_table(spark, sf_dir)), MJ.TIME).where("split = 'test'")
    days = sized_broadcast(X.weather(spark, sf_dir).select(F.to_date("datetime").alias("day"), "precip"))
    p = p.join(days, F.date_add(F.lit("1995-01-01").cast("date"), F.col(MJ.TIME).cast("int")) == F.col("day"), "left")
    month, label = F.col("month"), F.col(MJ.LABEL)
    season = F.when(month.isin(12, 1, 2), "winter").when(month <= 5, "spring").when(month <= 8, "summer").otherwise("autumn")
    sky = F.when(F.col("precip").isNull(), "unknown").when(F.col("precip") >= WET, "wet").otherwise("dry")
    demand = F.lit("high")
    for name, top in reversed(DEMAND_LEVELS):
        demand = F.when(label <= top, name).otherwise(demand)
    slices = F.array(*(F.struct(F.lit(d).alias("dimension"), s.alias("slice")) for d, s in (("season", season), ("weather", sky), ("demand", demand))))
    return p.select("residual", F.inline(slices)).groupBy("dimension", "slice").agg(*_slice_errors())


@register(
    "rmsle",
    MJ._mv(f"""SELECT split, round(sqrt(avg(power(ln(1 + greatest(prediction, 0)) - ln(1 + total_rentals), 2))), {R}) AS rmsle
               FROM pred_split WHERE total_rentals >= 0 GROUP BY split"""),
)
def q_rmsle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Root mean squared log error per split (negative predictions clipped at 0)."""
    p = MJ.predictions_split(spark, sf_dir).where(F.col("total_rentals") >= 0)
    d = F.log1p(F.greatest(F.col("prediction"), F.lit(0.0))) - F.log1p("total_rentals")
    return p.groupBy("split").agg(F.round(F.sqrt(F.avg(d * d)), R).alias("rmsle"))


_WX = ["tempmax", "tempmin", "precip", "precipcover", "windspeed", "snow"]


@register(
    "descriptive_stats",
    with_views(["trips", "station_list", "weather"],
               f"""SELECT feature, round(avg(v), {R}) AS mean, round(stddev_samp(v), {R}) AS std,
                          CAST(count(*) - count(v) AS BIGINT) AS missing, round(min(v), {R}) AS min, round(max(v), {R}) AS max
                   FROM full_daily UNPIVOT INCLUDE NULLS (v FOR feature IN ({', '.join(_WX)})) GROUP BY feature""",
               DJ.FULL_CTES),
)
def q_descriptive_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean, std, missing count, min and max of the weather columns of the wide table."""
    t = DJ.full_daily_table(spark, sf_dir)
    arr = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("v")) for c in _WX])
    return t.select(F.inline(arr)).groupBy("feature").agg(
        F.round(F.avg("v"), R).alias("mean"), F.round(F.stddev_samp("v"), R).alias("std"),
        (F.count(F.lit(1)) - F.count("v")).cast("long").alias("missing"), F.round(F.min("v"), R).alias("min"), F.round(F.max("v"), R).alias("max"))


RARE_SHARE = 0.01


@register(
    "rare_category",
    with_views(["trips"], f"""SELECT CASE WHEN c.n < CAST({RARE_SHARE} AS DOUBLE) * t.total THEN 'other' ELSE c.start_station_id END AS station_group,
                                     CAST(sum(c.n) AS BIGINT) AS n_events
                              FROM (SELECT start_station_id, count(*) AS n FROM clean_ids GROUP BY start_station_id) c,
                                   (SELECT count(*) AS total FROM clean_ids) t GROUP BY 1""", DJ.EVENT_CTES[:1]),
)
def q_rare_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entities below a share of all events are regrouped as 'other'."""
    counts = D.entity_counts(D.clean_events(X.trips(spark, sf_dir)))
    total = counts.agg(F.sum("total_rentals").alias("_total"))
    grp = F.when(F.col("total_rentals") < F.lit(RARE_SHARE) * F.col("_total"), F.lit("other")).otherwise(F.col(D.ID))
    return counts.crossJoin(F.broadcast(total)).groupBy(grp.alias("station_group")).agg(F.sum("total_rentals").cast("long").alias("n_events"))


@register(
    "holdout_split",
    with_views(["train_table"], """SELECT id, time_idx, CASE WHEN time_idx < c1 THEN 'train' ELSE 'test' END AS split
        FROM train_table, (SELECT min(time_idx) AS c1 FROM (SELECT time_idx, row_number() OVER (ORDER BY time_idx) - 1 AS r, count(*) OVER () AS n
                                                         FROM (SELECT DISTINCT time_idx FROM train_table)) WHERE r = floor(n * (1.0 - CAST(0.2 AS DOUBLE))))
        WHERE time_idx IS NOT NULL"""),
)
def q_holdout_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two-part time split: the last 20 % of the time points are test."""
    return holdout_split(X.train_table(spark, sf_dir), "time_idx", 0.2).select("id", "time_idx", "split")


# The shares of the train period that the learning curve fits on.
CURVE_FRACTIONS = [0.25, 0.5, 0.75, 1.0]
_PREFIXES = "SELECT fraction, lo + (hi - lo) * fraction AS until FROM (SELECT min(time_idx) AS lo, max(time_idx) AS hi FROM split_table WHERE split = 'train'), (VALUES " + ", ".join(f"(CAST({f} AS DOUBLE))" for f in CURVE_FRACTIONS) + ") AS f(fraction)"


@register(
    "learning_curve",
    MJ._mv(
        "SELECT fraction AS train_fraction, " + ", ".join(f"round(sqrt(avg(power(total_rentals - p, 2)) FILTER (WHERE split = '{sp}')), {R}) AS {sp}_rmse" for sp in ("train", "validation"))
        + f" FROM (SELECT fraction, split, total_rentals, {MJ._SOLVED_PREDICTION} AS p FROM scaled, solved) GROUP BY fraction",
        MJ._solve_ctes([1.0], _PREFIXES),
    ),
)
def q_learning_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ridge (alpha 1) fitted on growing time prefixes of the train split, all from one pass; train and validation RMSE per prefix."""
    t = MJ.split_table(spark, sf_dir).withColumn("when", F.col("time_idx"))  # the time itself, beside the scaled feature
    t = M.scale(t, M.fit_scaler(t.where("split = 'train'"), MJ.FEATURES))
    train = t.where("split = 'train'")
    lo, hi = train.agg(F.min("when"), F.max("when")).first()
    bucket = F.lit(0)
    for f in CURVE_FRACTIONS[:-1]:
        bucket = bucket + (F.col("when") > lo + (hi - lo) * f).cast("int")
    fits = [M.fit_ridge(s, 1.0) for s in M.LinearStats.collect_prefixes(train, MJ.FEATURES, MJ.LABEL, bucket, len(CURVE_FRACTIONS))]
    tv = t.where(F.col("split").isin("train", "validation"))
    scored = tv.select("split", MJ.LABEL, F.posexplode(F.array(*[f.predict_expr() for f in fits])).alias("setting", "prediction"))
    tab = M.search_table(M.search_errors(scored, MJ.LABEL))
    fr = F.array(*[F.lit(x) for x in CURVE_FRACTIONS])
    return tab.select(F.element_at(fr, F.col("setting") + 1).alias("train_fraction"), F.round("train_rmse", R).alias("train_rmse"), F.round("validation_rmse", R).alias("validation_rmse"))


@register(
    "one_hot",
    _DAILY("""SELECT date, start_station_id, total_rentals, CAST(idx AS INTEGER) AS station_index,
                     list_transform(range(n), lambda i: CASE WHEN i = idx THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END) AS station_one_hot
              FROM (SELECT *, dense_rank() OVER (ORDER BY start_station_id) - 1 AS idx,
                           (SELECT count(DISTINCT start_station_id) FROM daily) AS n FROM daily)"""),
)
def q_one_hot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One-hot entity column (StringIndexer in alphabetical order + OneHotEncoder, all levels kept)."""
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import OneHotEncoder, StringIndexer
    from pyspark.ml.functions import vector_to_array

    d = DJ.daily_table(spark, sf_dir).select("date", D.ID, "total_rentals")
    pipe = Pipeline(stages=[
        StringIndexer(inputCol=D.ID, outputCol="station_index", stringOrderType="alphabetAsc"),
        OneHotEncoder(inputCols=["station_index"], outputCols=["station_vec"], dropLast=False),
    ])
    out = pipe.fit(d).transform(d)
    return out.select("date", D.ID, "total_rentals", F.col("station_index").cast("int").alias("station_index"),
                      vector_to_array("station_vec").alias("station_one_hot"))
