"""Registered queries: correlation analysis and feature reduction (second job)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidecast.functions import scalars as S
from tidecast.operators import features as FE
from tidecast.operators import profile as P
from tidecast.plans.daily_jobs import FULL_CTES, full_daily_table
from tidecast.plans.registry import register
from tidecast.plans.sqlviews import canon, strip, with_views
from tidecast.sources import fixtures as X

# The numeric predictors and targets that detection yields on the
# fixture's analysis table (tests assert that detection gives exactly these).
PREDICTORS = [
    "day", "daylight_minutes", "is_weekend", "month", "precip", "precipcover", "snow",
    "station_region", "sunrise_minutes", "sunset_minutes", "tempmax", "tempmin",
    "weekday", "windspeed", "year",
]
TARGETS = [
    "casual_count", "classic_bike_casual_count", "classic_bike_count", "classic_bike_member_count",
    "docked_bike_casual_count", "docked_bike_count", "docked_bike_member_count",
    "electric_bike_casual_count", "electric_bike_count", "electric_bike_member_count",
    "member_count", "total_rentals",
]
# Fixed value: the reduced feature list available in the fixture (the
# reference's list minus weather fields the fixture does not have).
REDUCED_FEATURES = [
    "start_station_id", "tempmax", "precip", "precipcover", "windspeed", "sunset_minutes",
    "month", "weekday", "year", "time_idx", "snow",
]
TARGET = "total_rentals"
R = 6  # digits kept when comparing computed doubles with the oracle


def analysis_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return FE.add_time_features(full_daily_table(spark, sf_dir))


# ---- oracle pieces -----------------------------------------------------------


def _minutes(x: str) -> str:
    ts = f"try_cast({strip(x)} AS TIMESTAMP)"
    return f"CAST(hour({ts}) * 60 + minute({ts}) AS INTEGER)"


_ANALYSIS = f"""
SELECT *, {_minutes('sunrise')} AS sunrise_minutes, {_minutes('sunset')} AS sunset_minutes,
       {_minutes('sunset')} - {_minutes('sunrise')} AS daylight_minutes
FROM full_daily"""
_ALL = PREDICTORS + TARGETS
_POS = "SELECT * FROM (VALUES " + ", ".join(f"('{c}', {i})" for i, c in enumerate(_ALL)) + ") AS t(feature, pos)"
_LONG = (
    "UNPIVOT (SELECT row_number() OVER () AS rid, "
    + ", ".join(f"CAST({c} AS DOUBLE) AS {c}" for c in _ALL)
    + " FROM analysis) ON "
    + ", ".join(_ALL)
    + " INTO NAME feature VALUE v"
)
_CORR = """
SELECT a.feature AS feature_1, b.feature AS feature_2, pa.pos AS i, pb.pos AS j,
       CASE WHEN var_pop(a.v) > 0 AND var_pop(b.v) > 0 THEN covar_pop(a.v, b.v) / sqrt(var_pop(a.v) * var_pop(b.v)) END AS correlation
FROM long a JOIN long b ON a.rid = b.rid
JOIN pos pa ON pa.feature = a.feature JOIN pos pb ON pb.feature = b.feature
GROUP BY 1, 2, 3, 4"""
_PRED_LIST = "[" + ", ".join(f"'{c}'" for c in PREDICTORS) + "]"
_TGT_LIST = "[" + ", ".join(f"'{c}'" for c in TARGETS) + "]"
_TARGET_CORR = f"""
SELECT feature_2 AS target, feature_1 AS feature, correlation, abs(correlation) AS abs_correlation
FROM corr WHERE list_contains({_TGT_LIST}, feature_2) AND list_contains({_PRED_LIST}, feature_1)"""
_SCORES = "SELECT feature, coalesce(max(abs_correlation), 0.0) AS target_score FROM target_corr GROUP BY feature"
_PAIRS = f"""
SELECT feature_1, feature_2, abs(correlation) AS abs_correlation, correlation, i, j FROM corr
WHERE i < j AND j < {len(PREDICTORS)} AND abs(correlation) >= {P.CORR_THRESHOLD}"""
CORR_CTES = [("analysis", _ANALYSIS), ("pos", _POS), ("long", _LONG), ("corr", _CORR),
             ("target_corr", _TARGET_CORR), ("scores", _SCORES), ("pairs", _PAIRS)]
_VIEWS = ["trips", "station_list", "weather"]
_PREF = "[" + ", ".join(f"'{p}'" for p in sorted(P.PREFERRED_FEATURES)) + "]"
_DEC = f"""
SELECT o, feature_1, feature_2, abs_correlation, s1, s2, keep_first,
       CASE WHEN keep_first THEN feature_2 ELSE feature_1 END AS drop_f,
       CASE WHEN keep_first THEN feature_1 ELSE feature_2 END AS keep_f,
       CASE WHEN list_contains({_PREF}, feature_1) <> list_contains({_PREF}, feature_2)
            THEN 'kept preferred feature' ELSE 'kept feature with stronger target correlation' END AS reason
FROM (
  SELECT p.*, coalesce(a.target_score, 0.0) AS s1, coalesce(b.target_score, 0.0) AS s2,
         row_number() OVER (ORDER BY p.abs_correlation DESC, p.j, p.i) AS o,
         CASE WHEN list_contains({_PREF}, p.feature_1) AND NOT list_contains({_PREF}, p.feature_2) THEN true
              WHEN list_contains({_PREF}, p.feature_2) AND NOT list_contains({_PREF}, p.feature_1) THEN false
              ELSE round(coalesce(a.target_score, 0.0), 12) >= round(coalesce(b.target_score, 0.0), 12) END AS keep_first
  FROM pairs p LEFT JOIN scores a ON a.feature = p.feature_1 LEFT JOIN scores b ON b.feature = p.feature_2)"""
_FOLD = """
SELECT 0 AS o, CAST([] AS VARCHAR[]) AS dropped, false AS taken
UNION ALL
SELECT d.o,
       CASE WHEN list_contains(r.dropped, d.feature_1) OR list_contains(r.dropped, d.feature_2) THEN r.dropped
            ELSE list_append(r.dropped, d.drop_f) END,
       NOT (list_contains(r.dropped, d.feature_1) OR list_contains(r.dropped, d.feature_2))
FROM fold r JOIN dec d ON d.o = r.o + 1"""


def _v(names: list[str], body: str, extra: list | None = None, recursive: bool = False) -> str:
    return with_views(_VIEWS, body, FULL_CTES + CORR_CTES + (extra or []), recursive)


# ---- queries ------------------------------------------------------------------


def _counted(table: str) -> str:
    """SQL of the columns of ``table`` with their counts of values."""
    return f'(UNPIVOT (SELECT count(COLUMNS(*)) AS "\\0" FROM {table}) ON COLUMNS(*) INTO NAME column_name VALUE n_values)'


@register(
    "detect_targets",
    _v(_VIEWS, f"SELECT column_name AS target, n_values FROM {_counted('analysis')} WHERE column_name = 'total_rentals' OR suffix(column_name, '_count')"),
)
def q_detect_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target columns of the analysis table, found by name, with the values that its rows hold of each."""
    t = analysis_table(spark, sf_dir)
    return P.column_counts(t).where(F.col("column").isin(P.detect_targets(t.columns))).select(F.col("column").alias("target"), "n_values")


@register(
    "project_numeric",
    _v(_VIEWS, "SELECT " + ", ".join(PREDICTORS) + " FROM analysis"),
)
def q_project_numeric(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numeric predictors by schema type, minus targets and id columns, sorted by name."""
    t = analysis_table(spark, sf_dir)
    return t.select(*P.numeric_predictors(t))


_PROF_SRC = "SELECT " + ", ".join(f"CAST({c} AS DOUBLE) AS {c}" for c in PREDICTORS) + " FROM analysis"


@register(
    "column_profile",
    _v(
        _VIEWS,
        "SELECT feature, CASE WHEN feature IN ('tempmax','tempmin','precip','precipcover','windspeed','snow') OR missing_values > 0 THEN 'float64' ELSE 'int64' END AS dtype, "
        "missing_values, n_unique FROM (SELECT feature, CAST(count(*) FILTER (WHERE v IS NULL) AS BIGINT) AS missing_values, "
        "CAST(count(DISTINCT v) AS BIGINT) AS n_unique FROM prof_src UNPIVOT INCLUDE NULLS (v FOR feature IN (" + ", ".join(PREDICTORS)
        + ")) GROUP BY feature)",
        [("prof_src", _PROF_SRC)],
    ),
)
def q_column_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = analysis_table(spark, sf_dir)
    return P.column_profile(t, P.numeric_predictors(t))


@register(
    "corr_matrix",
    _v(_VIEWS, f"SELECT feature_1, feature_2, round(correlation, {R}) AS correlation FROM corr WHERE i < {len(PREDICTORS)} AND j < {len(PREDICTORS)}"),
)
def q_corr_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pearson matrix of the predictors in long form (pairwise-complete rows, constant -> null)."""
    t = analysis_table(spark, sf_dir)
    c = P.correlation_long(t, P.numeric_predictors(t))
    return c.select("feature_1", "feature_2", F.round("correlation", R).alias("correlation"))


@register(
    "corr_wide",
    _v(
        _VIEWS,
        "SELECT feature_1 AS feature, " + ", ".join(f"max(CASE WHEN feature_2 = '{c}' THEN round(correlation, {R}) END) AS {c}" for c in PREDICTORS)
        + f" FROM corr WHERE i < {len(PREDICTORS)} AND j < {len(PREDICTORS)} GROUP BY feature_1",
    ),
)
def q_corr_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same matrix wide: a row and a column for each predictor, in their order."""
    t = analysis_table(spark, sf_dir)
    cols = P.numeric_predictors(t)
    wide = P.correlation_matrix(t, cols)
    return wide.select("feature", *[F.round(F.col(f"`{c}`"), R).alias(c) for c in cols])


@register(
    "corr_pairs",
    _v(_VIEWS, f"SELECT feature_1, feature_2, round(abs_correlation, {R}) AS abs_correlation, round(correlation, {R}) AS correlation FROM pairs"),
)
def q_corr_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Upper-triangle pairs with |r| >= 0.85."""
    t = analysis_table(spark, sf_dir)
    pairs = P.high_corr_pairs(P.correlation_long(t, P.numeric_predictors(t)))
    return pairs.select("feature_1", "feature_2", F.round("abs_correlation", R).alias("abs_correlation"), F.round("correlation", R).alias("correlation"))


def _target_corr(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = analysis_table(spark, sf_dir)
    return P.target_correlations(t, P.numeric_predictors(t), P.detect_targets(t.columns))


@register(
    "target_corr",
    _v(_VIEWS, f"SELECT target, feature, round(correlation, {R}) AS correlation, round(abs_correlation, {R}) AS abs_correlation FROM target_corr"),
)
def q_target_corr(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predictor-target correlations, by target then strongest first."""
    tc = _target_corr(spark, sf_dir)
    return tc.select("target", "feature", F.round("correlation", R).alias("correlation"), F.round("abs_correlation", R).alias("abs_correlation"))


@register("target_score", _v(_VIEWS, f"SELECT feature, round(target_score, {R}) AS target_score FROM scores"))
def q_target_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = P.target_scores(_target_corr(spark, sf_dir))
    return s.select("feature", F.round("target_score", R).alias("target_score"))


def drop_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = analysis_table(spark, sf_dir)
    preds = P.numeric_predictors(t)
    corr = P.correlation_long(t, preds + [c for c in P.detect_targets(t.columns)])
    pairs = P.high_corr_pairs(corr.filter(F.col("feature_1").isin(preds) & F.col("feature_2").isin(preds)))
    tc = corr.filter(F.col("feature_1").isin(preds) & F.col("feature_2").isin(P.detect_targets(t.columns)))
    scores = tc.groupBy(F.col("feature_1").alias("feature")).agg(F.coalesce(F.max(F.abs("correlation")), F.lit(0.0)).alias("target_score"))
    return P.drop_recommendations(pairs, scores)


@register(
    "drop_recommendations",
    _v(
        _VIEWS,
        f"""SELECT d.drop_f AS drop_feature, d.keep_f AS keep_feature, round(d.abs_correlation, {R}) AS abs_feature_feature_corr,
                  round(CASE WHEN d.keep_first THEN d.s2 ELSE d.s1 END, {R}) AS drop_feature_target_score,
                  round(CASE WHEN d.keep_first THEN d.s1 ELSE d.s2 END, {R}) AS keep_feature_target_score, d.reason
           FROM fold r JOIN dec d ON d.o = r.o WHERE r.taken""",
        [("dec", _DEC), ("fold", _FOLD)],
        recursive=True,
    ),
)
def q_drop_recommendations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Greedy list of predictors to drop, one per strong pair not already resolved."""
    d = drop_list(spark, sf_dir)
    return d.select(
        "drop_feature", "keep_feature",
        *[F.round(c, R).alias(c) for c in ("abs_feature_feature_corr", "drop_feature_target_score", "keep_feature_target_score")],
        "reason",
    )


# ---- reduction ------------------------------------------------------------------

_REDUCED = f"""
SELECT {', '.join(('CAST(' + canon('start_station_id') + ' AS DOUBLE) AS start_station_id') if c == 'start_station_id' else ('CAST(datediff(' + "'day'" + ', (SELECT min(date) FROM analysis), date) AS DOUBLE) AS time_idx' if c == 'time_idx' else c) for c in REDUCED_FEATURES)}, {TARGET}
FROM analysis WHERE try_cast({strip('start_station_id')} AS DOUBLE) IS NOT NULL AND {TARGET} IS NOT NULL"""


def reduced(spark: SparkSession, sf_dir: str) -> DataFrame:
    return FE.reduced_dataset(full_daily_table(spark, sf_dir), REDUCED_FEATURES, TARGET)


@register("reduced_dataset", _v(_VIEWS, "SELECT * FROM reduced", [("reduced", _REDUCED)]))
def q_reduced_dataset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fixed feature list + target, numeric only, rows without id or target dropped."""
    return reduced(spark, sf_dir)


@register(
    "time_index",
    _v(_VIEWS, "SELECT date, start_station_id, CAST(datediff('day', (SELECT min(date) FROM analysis), date) AS DOUBLE) AS time_idx FROM analysis"),
)
def q_time_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days since the first date (global minimum joined back as a one-row broadcast)."""
    return FE.add_time_index(full_daily_table(spark, sf_dir)).select("date", "start_station_id", "time_idx")


@register(
    "minutes_of_day",
    _v(_VIEWS, "SELECT date, start_station_id, sunrise_minutes, sunset_minutes, daylight_minutes FROM analysis"),
)
def q_minutes_of_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analysis_table(spark, sf_dir).select("date", "start_station_id", "sunrise_minutes", "sunset_minutes", "daylight_minutes")


@register(
    "station_map",
    _v(
        _VIEWS,
        f"""SELECT CAST({canon('start_station_id')} AS DOUBLE) AS start_station_id, start_station_name, station_name_final FROM (
              SELECT *, row_number() OVER (PARTITION BY start_station_id ORDER BY date, start_station_name, station_name_final) AS rn
              FROM full_daily) WHERE rn = 1""",
    ),
)
def q_station_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per entity id with its names, id as number."""
    return FE.entity_map(full_daily_table(spark, sf_dir))


@register(
    "removed_columns",
    _v(
        _VIEWS,
        "SELECT position, c.column_name AS removed_column, n_values FROM (SELECT CAST(row_number() OVER () - 1 AS INTEGER) AS position, column_name "
        f"FROM (DESCRIBE SELECT * FROM full_daily)) c JOIN {_counted('full_daily')} n ON c.column_name = n.column_name "
        "WHERE c.column_name NOT IN (SELECT column_name FROM (DESCRIBE SELECT * FROM reduced))",
        [("reduced", _REDUCED)],
    ),
)
def q_removed_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns of the wide table that the reduced table drops (reduction also adds columns), with the values they held."""
    full = full_daily_table(spark, sf_dir)
    red = FE.reduced_dataset(full, REDUCED_FEATURES, TARGET)
    kept = red.columns
    return P.column_counts(full).where(~F.col("column").isin(kept)).select("position", F.col("column").alias("removed_column"), "n_values")


@register(
    "reduced_summary",
    _v(
        _VIEWS,
        f"""SELECT metric, value FROM (
              SELECT 'n_rows' AS metric, CAST((SELECT count(*) FROM reduced) AS BIGINT) AS value
              UNION ALL SELECT 'n_original_columns', CAST((SELECT count(*) FROM (DESCRIBE SELECT * FROM full_daily)) AS BIGINT)
              UNION ALL SELECT 'n_reduced_columns', CAST((SELECT count(*) FROM (DESCRIBE SELECT * FROM reduced)) AS BIGINT)
              UNION ALL SELECT 'n_removed_columns', CAST((SELECT count(*) FROM (DESCRIBE SELECT * FROM full_daily) WHERE column_name NOT IN (SELECT column_name FROM (DESCRIBE SELECT * FROM reduced))) AS BIGINT))""",
        [("reduced", _REDUCED)],
    ),
)
def q_reduced_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    full = full_daily_table(spark, sf_dir)
    red = FE.reduced_dataset(full, REDUCED_FEATURES, TARGET)
    return FE.reduced_summary(red, full.columns, red.columns)


@register(
    "project_fixed",
    _v(_VIEWS, "SELECT " + ", ".join(REDUCED_FEATURES[1:9]) + f", {TARGET} FROM analysis"),
)
def q_project_fixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fixed column list in fixed order."""
    return analysis_table(spark, sf_dir).select(*REDUCED_FEATURES[1:9], TARGET)


# ---- scalar functions on the event view ----------------------------------------------


@register(
    "scalar_string",
    with_views(
        ["trips"],
        f"""SELECT start_station_id AS raw_id, {canon('start_station_id')} AS clean_id, {strip('start_station_name')} AS clean_name,
                  replace({strip('rideable_type')}, ' ', '_') AS type_key,
                  replace({strip('rideable_type')}, ' ', '_') || '_' || replace({strip('member_casual')}, ' ', '_') || '_count' AS combo_key
           FROM trips""",
    ),
)
def q_scalar_string(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = X.trips(spark, sf_dir)
    return t.select(
        F.col("start_station_id").alias("raw_id"),
        S.canonical_id("start_station_id").alias("clean_id"),
        S.clean_string("start_station_name").alias("clean_name"),
        S.underscore(S.clean_string("rideable_type")).alias("type_key"),
        F.concat(S.underscore(S.clean_string("rideable_type")), F.lit("_"), S.underscore(S.clean_string("member_casual")), F.lit("_count")).alias("combo_key"),
    )


@register(
    "scalar_cast",
    with_views(["trips"], f"SELECT start_station_id AS raw_id, try_cast({strip('start_station_id')} AS DOUBLE) AS id_number, try_cast({strip('started_at')} AS DOUBLE) AS bad_number FROM trips"),
)
def q_scalar_cast(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = X.trips(spark, sf_dir)
    return t.select(F.col("start_station_id").alias("raw_id"), S.tolerant_double("start_station_id").alias("id_number"), S.tolerant_double("started_at").alias("bad_number"))


@register(
    "scalar_datetime",
    with_views(["trips"], f"SELECT started_at, try_cast({strip('started_at')} AS TIMESTAMP) AS started_ts, CAST(try_cast({strip('started_at')} AS TIMESTAMP) AS DATE) AS started_day FROM trips"),
)
def q_scalar_datetime(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = X.trips(spark, sf_dir)
    return t.select("started_at", S.tolerant_timestamp("started_at").alias("started_ts"), S.to_day("started_at").alias("started_day"))
