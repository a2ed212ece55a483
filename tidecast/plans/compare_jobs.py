"""Registered queries: comparison of model runs (metrics records -> names, order, ranks, summary).

The compared runs are the models whose predictions SQL can state exactly, all
derived from ``train_table``: the train mean, the per-entity mean, the
per-month mean and a fixed formula. Their metrics go through the same
operators as any fitted model's would.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidecast.operators import compare as C
from tidecast.operators import metrics as MT
from tidecast.operators.joins import sized_broadcast
from tidecast.plans.model_jobs import _PRED_SPLIT, _SPLIT_CTES, split_table
from tidecast.plans.registry import register
from tidecast.plans.sqlviews import with_views
from tidecast.session import scratch_path

LABEL = "total_rentals"
R = 6
# The compared runs (folder, model name) and one known folder without results.
RUNS = [
    ("00_dummy_regressor", "DummyRegressor"),
    ("09_station_mean", "StationMeanRegressor"),
    ("10_month_mean", "MonthMeanRegressor"),
    ("11_formula", "FormulaRegression"),
]
KNOWN_FOLDERS = [f for f, _ in RUNS] + ["08_xgboost"]
N_FEATURES = {"00_dummy_regressor": 6, "09_station_mean": 1, "10_month_mean": 1, "11_formula": 2}
METRIC_COLS = [f"{s}_{m}" for s in ("train", "validation", "test") for m in MT.METRIC_NAMES]


def run_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long table (folder_name, model_name, id, split, label, prediction) of all runs."""
    t = split_table(spark, sf_dir).select("id", "split", "start_station_id", "month", "x2", F.col(LABEL).cast("double").alias(LABEL))
    train = t.where("split = 'train'")
    gm = float(train.agg(F.avg(LABEL)).first()[0])
    by_station = sized_broadcast(train.groupBy("start_station_id").agg(F.avg(LABEL).alias("_m")))
    by_month = train.groupBy("month").agg(F.avg(LABEL).alias("_m"))  # at most 12 rows
    parts = [
        t.select(F.lit(RUNS[0][0]).alias("folder_name"), F.lit(RUNS[0][1]).alias("model_name"), "id", "split", LABEL, F.lit(gm).alias("prediction")),
        t.join(by_station, "start_station_id", "left").select(F.lit(RUNS[1][0]).alias("folder_name"), F.lit(RUNS[1][1]).alias("model_name"), "id", "split", LABEL, F.coalesce("_m", F.lit(gm)).alias("prediction")),
        t.join(F.broadcast(by_month), "month", "left").select(F.lit(RUNS[2][0]).alias("folder_name"), F.lit(RUNS[2][1]).alias("model_name"), "id", "split", LABEL, F.coalesce("_m", F.lit(gm)).alias("prediction")),
        t.select(F.lit(RUNS[3][0]).alias("folder_name"), F.lit(RUNS[3][1]).alias("model_name"), "id", "split", LABEL, (30 + 5 * F.col("month") + 5 * F.col("x2")).alias("prediction")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def run_metrics_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One metric record per run: ids, target, parameters, split sizes and 18 metrics (6 digits)."""
    preds = run_predictions(spark, sf_dir)
    long = MT.regression_metrics(preds, ["folder_name", "model_name", "split"], LABEL)
    long = long.withColumns({m: F.round(m, R) for m in MT.METRIC_NAMES})
    wide = MT.metrics_wide(long, ["folder_name", "model_name"])
    sizes = split_table(spark, sf_dir).groupBy().agg(
        *[F.count(F.when(F.col("split") == s, 1)).cast("int").alias(f"n_{s}") for s in ("train", "validation", "test")]
    )
    nf = C._map(N_FEATURES)
    return wide.crossJoin(F.broadcast(sizes)).select(
        "folder_name", "model_name", F.lit(LABEL).alias("target"),
        F.when(F.col("folder_name") == RUNS[0][0], F.lit("mean")).alias("strategy"),
        nf[F.col("folder_name")].cast("int").alias("n_features"),
        "n_train", "n_validation", "n_test", *METRIC_COLS,
    )


def collected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metric records written per folder to the shared folder and read back as one table."""
    root = scratch_path(spark, "metrics")
    C.write_metric_records(run_metrics_wide(spark, sf_dir), root)
    return C.collect_metric_records(spark, root)


def comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = collected(spark, sf_dir).withColumn("display_name", C.display_name())
    df = df.withColumns({"fit_time_seconds": F.lit(None).cast("double"), "predict_time_seconds": F.lit(None).cast("double")})
    return C.add_ranks(C.order_models(df))


# ---- oracle pieces ------------------------------------------------------------------------


def _sql_metrics() -> str:
    e = f"({LABEL} - prediction)"
    return f"""SELECT folder_name, model_name, split,
       round(avg(abs({e})), {R}) AS mae, round(sqrt(avg({e} * {e})), {R}) AS rmse,
       round(CASE WHEN var_pop({LABEL}) * count(*) = 0 THEN CASE WHEN sum({e} * {e}) = 0 THEN 1.0 ELSE 0.0 END
             ELSE 1 - sum({e} * {e}) / (var_pop({LABEL}) * count(*)) END, {R}) AS r2,
       round(quantile_cont(abs({e}), 0.5), {R}) AS median_ae,
       round(CASE WHEN var_pop({LABEL}) = 0 THEN CASE WHEN var_pop({e}) = 0 THEN 1.0 ELSE 0.0 END
             ELSE 1 - var_pop({e}) / var_pop({LABEL}) END, {R}) AS explained_variance,
       round(avg(CASE WHEN {LABEL} <> 0 THEN abs({e}) / abs({LABEL}) END), {R}) AS mape
FROM runs GROUP BY folder_name, model_name, split"""


_GM = "(SELECT avg(total_rentals) AS m FROM split_table WHERE split = 'train')"
_RUNS = f"""
SELECT '{RUNS[0][0]}' AS folder_name, '{RUNS[0][1]}' AS model_name, s.id, s.split, s.total_rentals, g.m AS prediction FROM split_table s, {_GM} g
UNION ALL
SELECT '{RUNS[1][0]}', '{RUNS[1][1]}', s.id, s.split, s.total_rentals, coalesce(sm.m, g.m) FROM split_table s
  LEFT JOIN (SELECT start_station_id, avg(total_rentals) AS m FROM split_table WHERE split = 'train' GROUP BY start_station_id) sm ON s.start_station_id = sm.start_station_id, {_GM} g
UNION ALL
SELECT '{RUNS[2][0]}', '{RUNS[2][1]}', s.id, s.split, s.total_rentals, coalesce(mm.m, g.m) FROM split_table s
  LEFT JOIN (SELECT month, avg(total_rentals) AS m FROM split_table WHERE split = 'train' GROUP BY month) mm ON s.month = mm.month, {_GM} g
UNION ALL
SELECT '{RUNS[3][0]}', '{RUNS[3][1]}', s.id, s.split, s.total_rentals, 30 + 5 * s.month + 5 * s.x2 FROM split_table s"""


def _pick(s: str, m: str) -> str:
    return f"max(CASE WHEN split = '{s}' THEN {m} END) AS {s}_{m}"


_NF = "CASE folder_name " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in N_FEATURES.items()) + " END"
_WIDE = f"""
SELECT w.folder_name, w.model_name, '{LABEL}' AS target, CASE WHEN w.folder_name = '{RUNS[0][0]}' THEN 'mean' END AS strategy,
       CAST({_NF.replace('folder_name', 'w.folder_name')} AS INTEGER) AS n_features,
       CAST(z.n_train AS INTEGER) AS n_train, CAST(z.n_validation AS INTEGER) AS n_validation, CAST(z.n_test AS INTEGER) AS n_test,
       {', '.join('w.' + c for c in METRIC_COLS)}
FROM (SELECT folder_name, model_name, {', '.join(_pick(s, m) for s in ('train', 'validation', 'test') for m in MT.METRIC_NAMES)}
      FROM run_metrics GROUP BY folder_name, model_name) w,
     (SELECT count(*) FILTER (WHERE split = 'train') AS n_train, count(*) FILTER (WHERE split = 'validation') AS n_validation,
             count(*) FILTER (WHERE split = 'test') AS n_test FROM split_table) z"""
_DISPLAY = (
    "coalesce(CASE folder_name " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in C.FOLDER_DISPLAY.items())
    + " END, CASE WHEN model_name IS NOT NULL AND model_name <> '' THEN trim(replace(replace(model_name, 'Regressor', ''), 'Regression', '')) END, folder_name)"
)
_ORDER = "coalesce(CASE folder_name " + " ".join(f"WHEN '{k}' THEN {i}" for i, k in enumerate(C.PREFERRED_ORDER)) + f" END, {C.UNKNOWN_ORDER})"
_NAMED = f"SELECT *, {_DISPLAY} AS display_name, {_ORDER} AS sort_order FROM wide"
_ORDERED = "SELECT *, CAST(row_number() OVER (ORDER BY sort_order, display_name, folder_name) - 1 AS INTEGER) AS position FROM named"
_RANKED = (
    "SELECT *, "
    + ", ".join(f"CAST(rank() OVER (ORDER BY {m} {'ASC' if asc else 'DESC'}) AS INTEGER) AS {n}" for n, m, asc in C.RANK_SPECS)
    + " FROM ordered"
)
_RANKED2 = "SELECT *, rank_validation_rmse + rank_validation_mae + rank_validation_r2 AS rank_sum_validation, rank_test_rmse + rank_test_mae + rank_test_r2 AS rank_sum_test FROM ranked0"
CMP_CTES = _SPLIT_CTES + [_PRED_SPLIT, ("runs", _RUNS), ("run_metrics", _sql_metrics()), ("wide", _WIDE),
                          ("named", _NAMED), ("ordered", _ORDERED), ("ranked0", _RANKED), ("cmp", _RANKED2)]


def _cv(body: str, extra: list | None = None) -> str:
    return with_views(["train_table", "predictions"], body, CMP_CTES + (extra or []))


# ---- queries --------------------------------------------------------------------------------


@register("metrics_wide", _cv("SELECT * FROM wide"))
def q_metrics_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metric record per run: one grouped aggregate over all runs and splits, pivoted by split."""
    return run_metrics_wide(spark, sf_dir)


@register("collect_metrics", _cv("SELECT * FROM wide"))
def q_collect_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records written per folder as JSON, read back together (differing columns merged)."""
    wide = run_metrics_wide(spark, sf_dir)
    root = scratch_path(spark, "metrics")
    C.write_metric_records(wide, root)
    # JSON numbers come back as bigint/double: restore the record's declared types
    return C.collect_metric_records(spark, root).select(*[F.col(c).cast(t) for c, t in wide.dtypes])


@register(
    "anti_skipped",
    _cv("SELECT folder_name FROM (VALUES " + ", ".join(f"('{f}')" for f in KNOWN_FOLDERS) + ") AS k(folder_name) WHERE folder_name NOT IN (SELECT folder_name FROM wide)"),
)
def q_anti_skipped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Known model folders without a metric record."""
    known = spark.createDataFrame([(f,) for f in KNOWN_FOLDERS], "folder_name string")
    return C.skipped_folders(known, collected(spark, sf_dir))


@register("display_name", _cv("SELECT folder_name, model_name, display_name FROM named"))
def q_display_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_metrics_wide(spark, sf_dir).select("folder_name", "model_name", C.display_name().alias("display_name"))


@register("map_lookup", _cv("SELECT folder_name, CAST(sort_order AS INTEGER) AS sort_order FROM named"))
def q_map_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Folder -> preferred position; unknown folders get 999."""
    return run_metrics_wide(spark, sf_dir).select("folder_name", C.sort_order().cast("int").alias("sort_order"))


@register("model_order", _cv("SELECT folder_name, display_name, position FROM ordered"))
def q_model_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return comparison(spark, sf_dir).select("folder_name", "display_name", "position")


@register(
    "model_ranks",
    _cv("SELECT folder_name, " + ", ".join(n for n, _, _ in C.RANK_SPECS) + ", rank_sum_validation, rank_sum_test FROM cmp"),
)
def q_model_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Min-method ranks per metric and their sums."""
    return comparison(spark, sf_dir).select("folder_name", *[n for n, _, _ in C.RANK_SPECS], "rank_sum_validation", "rank_sum_test")


@register(
    "model_rankings",
    _cv("""SELECT folder_name,
                  CAST(row_number() OVER (ORDER BY validation_rmse, validation_mae, validation_mape, position) AS INTEGER) AS rank_validation,
                  CAST(row_number() OVER (ORDER BY test_rmse, test_mae, test_mape, position) AS INTEGER) AS rank_test
           FROM cmp"""),
)
def q_model_rankings(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = C.ranking(C.ranking(comparison(spark, sf_dir), "validation"), "test")
    return r.select("folder_name", "rank_validation", "rank_test")


@register(
    "best_flags",
    _cv("""SELECT folder_name,
                  CAST(row_number() OVER (ORDER BY validation_rmse, position) = 1 AS INTEGER) AS best_validation_rmse,
                  CAST(row_number() OVER (ORDER BY validation_r2 DESC, position) = 1 AS INTEGER) AS best_validation_r2,
                  CAST(row_number() OVER (ORDER BY test_mae, position) = 1 AS INTEGER) AS best_test_mae
           FROM cmp"""),
)
def q_best_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Highlight flag of the best model per metric (first in model order on ties)."""
    f = C.best_flags(comparison(spark, sf_dir), [("validation_rmse", False), ("validation_r2", True), ("test_mae", False)])
    return f.select("folder_name", "best_validation_rmse", "best_validation_r2", "best_test_mae")


@register(
    "best_setting",
    _cv("""SELECT 'validation_rmse' AS metric, arg_min(display_name, (validation_rmse, position)) AS display_name FROM cmp
           UNION ALL SELECT 'test_r2', arg_min(display_name, (-test_r2, position)) FROM cmp"""),
)
def q_best_setting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Arg-best row per metric (min for errors, max for r2; first on ties)."""
    c = comparison(spark, sf_dir)
    a = C.arg_best(c, "validation_rmse", False).select(F.lit("validation_rmse").alias("metric"), "display_name")
    b = C.arg_best(c, "test_r2", True).select(F.lit("test_r2").alias("metric"), "display_name")
    return a.unionByName(b)


_SUMMARY = """
SELECT 'best_by_validation_rmse' AS criterion, arg_min(display_name, (validation_rmse, validation_mae, validation_mape, position)) AS display_name,
       arg_min(folder_name, (validation_rmse, validation_mae, validation_mape, position)) AS folder_name,
       CAST(arg_min(validation_rmse, (validation_rmse, validation_mae, validation_mape, position)) AS DOUBLE) AS value FROM cmp
UNION ALL
SELECT 'best_by_test_rmse', arg_min(display_name, (test_rmse, test_mae, test_mape, position)), arg_min(folder_name, (test_rmse, test_mae, test_mape, position)),
       CAST(arg_min(test_rmse, (test_rmse, test_mae, test_mape, position)) AS DOUBLE) FROM cmp
UNION ALL
SELECT 'best_by_validation_rank_sum', arg_min(display_name, (rank_sum_validation, position)), arg_min(folder_name, (rank_sum_validation, position)),
       CAST(min(rank_sum_validation) AS DOUBLE) FROM cmp
UNION ALL
SELECT 'best_by_test_rank_sum', arg_min(display_name, (rank_sum_test, position)), arg_min(folder_name, (rank_sum_test, position)),
       CAST(min(rank_sum_test) AS DOUBLE) FROM cmp"""


@register("comparison_summary", _cv(_SUMMARY))
def q_comparison_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.summary(comparison(spark, sf_dir))


@register(
    "comparison_compact",
    _cv("SELECT " + ", ".join(c if "time" not in c else f"CAST(NULL AS DOUBLE) AS {c}" for c in C.COMPACT_COLUMNS) + " FROM cmp"),
)
def q_comparison_compact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Compact comparison table (timings are not hashed: null here, measured by bench.py)."""
    return comparison(spark, sf_dir).select(*C.COMPACT_COLUMNS)


@register(
    "param_label",
    _cv("SELECT folder_name, 'model=' || display_name || ', strategy=' || coalesce(strategy, 'None') || ', n_features=' || CAST(n_features AS VARCHAR) AS label FROM named"),
)
def q_param_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parameter label text; a missing parameter reads 'None'."""
    from tidecast.functions.scalars import param_text

    c = comparison(spark, sf_dir)
    return c.select("folder_name", F.concat(F.lit("model="), "display_name", F.lit(", strategy="), param_text("strategy"),
                                             F.lit(", n_features="), F.col("n_features").cast("string")).alias("label"))
