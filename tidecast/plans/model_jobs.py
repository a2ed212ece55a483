"""Registered queries: split, scaling, baseline, metrics, linear family, KNN and tree models."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidecast.operators import knn as K
from tidecast.operators import metrics as MT
from tidecast.operators import model_store as S
from tidecast.operators import models as M
from tidecast.operators.split import chronological_split
from tidecast.plans.registry import register
from tidecast.plans.sqlviews import with_views
from tidecast.session import scratch_path, written_table
from tidecast.sources import fixtures as X

FEATURES = X.TRAIN_FEATURES
LABEL = X.TARGET
TIME = X.TIME_COL
R = 6

# The hyper-parameter grids searched on the validation split.
RIDGE_ALPHAS = [0.001, 0.01, 0.1, 1.0, 5.0, 10.0, 50.0, 100.0, 500.0, 1000.0]
LASSO_ALPHAS = [0.001, 0.01, 0.1, 0.5, 1.0, 2.0, 5.0, 10.0]
LASSO_MAX_ITER = 10000
LASSO_TOL = 1e-4
TREE_GRID = [
    {"max_depth": 3, "min_samples_leaf": 5, "min_samples_split": 10},
    {"max_depth": 5, "min_samples_leaf": 5, "min_samples_split": 10},
    {"max_depth": 8, "min_samples_leaf": 5, "min_samples_split": 10},
    {"max_depth": 10, "min_samples_leaf": 5, "min_samples_split": 10},
    {"max_depth": 12, "min_samples_leaf": 5, "min_samples_split": 10},
    {"max_depth": None, "min_samples_leaf": 5, "min_samples_split": 10},
    {"max_depth": 5, "min_samples_leaf": 10, "min_samples_split": 20},
    {"max_depth": 8, "min_samples_leaf": 10, "min_samples_split": 20},
    {"max_depth": 10, "min_samples_leaf": 10, "min_samples_split": 20},
    {"max_depth": None, "min_samples_leaf": 10, "min_samples_split": 20},
]
KNN_GRID = [{"n_neighbors": k, "weights": w, "p": 2} for w in ("uniform", "distance") for k in (3, 5, 7, 9, 15, 25)]
FOREST_GRID = [
    {"n_estimators": 100, "max_depth": 8, "min_samples_leaf": 5, "min_samples_split": 10, "max_features": "sqrt"},
    {"n_estimators": 200, "max_depth": 8, "min_samples_leaf": 5, "min_samples_split": 10, "max_features": "sqrt"},
    {"n_estimators": 100, "max_depth": 12, "min_samples_leaf": 5, "min_samples_split": 10, "max_features": "sqrt"},
    {"n_estimators": 200, "max_depth": 12, "min_samples_leaf": 5, "min_samples_split": 10, "max_features": "sqrt"},
    {"n_estimators": 100, "max_depth": None, "min_samples_leaf": 5, "min_samples_split": 10, "max_features": "sqrt"},
    {"n_estimators": 200, "max_depth": None, "min_samples_leaf": 5, "min_samples_split": 10, "max_features": "sqrt"},
    {"n_estimators": 100, "max_depth": 12, "min_samples_leaf": 10, "min_samples_split": 20, "max_features": "sqrt"},
    {"n_estimators": 200, "max_depth": 12, "min_samples_leaf": 10, "min_samples_split": 20, "max_features": "sqrt"},
]
BOOST_GRID = [
    {"n_estimators": 100, "learning_rate": 0.03, "max_depth": 2, "min_samples_leaf": 5, "subsample": 1.0},
    {"n_estimators": 200, "learning_rate": 0.03, "max_depth": 2, "min_samples_leaf": 5, "subsample": 1.0},
    {"n_estimators": 100, "learning_rate": 0.05, "max_depth": 2, "min_samples_leaf": 5, "subsample": 1.0},
    {"n_estimators": 200, "learning_rate": 0.05, "max_depth": 2, "min_samples_leaf": 5, "subsample": 1.0},
    {"n_estimators": 100, "learning_rate": 0.05, "max_depth": 3, "min_samples_leaf": 5, "subsample": 1.0},
    {"n_estimators": 200, "learning_rate": 0.05, "max_depth": 3, "min_samples_leaf": 5, "subsample": 1.0},
    {"n_estimators": 300, "learning_rate": 0.03, "max_depth": 3, "min_samples_leaf": 10, "subsample": 0.8},
    {"n_estimators": 300, "learning_rate": 0.05, "max_depth": 3, "min_samples_leaf": 10, "subsample": 0.8},
]


def split_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chronological_split(X.train_table(spark, sf_dir), TIME)


def scaled_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = split_table(spark, sf_dir)
    stats = M.fit_scaler(t.where("split = 'train'"), FEATURES)
    return M.scale(t, stats)


# ---- oracle pieces --------------------------------------------------------------------

_SPLIT_CTES = [
    ("times", "SELECT DISTINCT time_idx FROM train_table WHERE time_idx IS NOT NULL"),
    ("ranked", "SELECT time_idx, row_number() OVER (ORDER BY time_idx) - 1 AS r, count(*) OVER () AS n FROM times"),
    ("cuts", """SELECT (SELECT min(time_idx) FROM ranked WHERE r = floor(n * CAST(0.7 AS DOUBLE))) AS c1,
                       (SELECT min(time_idx) FROM ranked WHERE r = floor(n * (CAST(0.7 AS DOUBLE) + CAST(0.15 AS DOUBLE)))) AS c2
                FROM (SELECT max(n) AS n FROM ranked)"""),
    ("split_table", """SELECT t.*, CASE WHEN t.time_idx < c.c1 THEN 'train' WHEN t.time_idx < c.c2 OR c.c2 IS NULL THEN 'validation' ELSE 'test' END AS split
                       FROM train_table t, cuts c WHERE t.time_idx IS NOT NULL"""),
]
_PRED_SPLIT = ("pred_split", "SELECT p.*, s.split FROM predictions p JOIN split_table s USING (id)")


def _mv(body: str, extra: list | None = None) -> str:
    return with_views(["train_table", "predictions"], body, _SPLIT_CTES + [_PRED_SPLIT] + (extra or []))


def _metric_sql(label: str = "total_rentals", pred: str = "prediction", src: str = "pred_split", group: str = "split") -> str:
    e = f"({label} - {pred})"
    return f"""SELECT {group}, round(avg(abs({e})), {R}) AS mae, round(sqrt(avg({e} * {e})), {R}) AS rmse,
       round(CASE WHEN var_pop({label}) * count(*) = 0 THEN CASE WHEN sum({e} * {e}) = 0 THEN 1.0 ELSE 0.0 END
             ELSE 1 - sum({e} * {e}) / (var_pop({label}) * count(*)) END, {R}) AS r2,
       round(quantile_cont(abs({e}), 0.5), {R}) AS median_ae,
       round(CASE WHEN var_pop({label}) = 0 THEN CASE WHEN var_pop({e}) = 0 THEN 1.0 ELSE 0.0 END
             ELSE 1 - var_pop({e}) / var_pop({label}) END, {R}) AS explained_variance,
       round(avg(CASE WHEN {label} <> 0 THEN abs({e}) / abs({label}) END), {R}) AS mape
FROM {src} GROUP BY {group}"""


def _round_cols(df: DataFrame, cols: list[str]) -> DataFrame:
    return df.withColumns({c: F.round(c, R) for c in cols})


# ---- split, scale, baseline, metrics -------------------------------------------------------


@register("chronological_split", _mv("SELECT id, time_idx, split FROM split_table"))
def q_chronological_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Train / validation / test by distinct time points (70 / 15 / 15)."""
    return split_table(spark, sf_dir).select("id", TIME, "split")


@register("split_sizes", _mv("SELECT split, CAST(count(*) AS BIGINT) AS n_rows FROM split_table GROUP BY split"))
def q_split_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split_table(spark, sf_dir).groupBy("split").agg(F.count(F.lit(1)).cast("long").alias("n_rows"))


_SCALE_STATS = "SELECT " + ", ".join(f"avg({c}) AS m_{c}, coalesce(nullif(stddev_pop({c}), 0), 1) AS s_{c}" for c in FEATURES) + " FROM split_table WHERE split = 'train'"


@register(
    "standard_scale",
    _mv("SELECT id, split, " + ", ".join(f"round(({c} - m_{c}) / s_{c}, {R}) AS {c}" for c in FEATURES) + " FROM split_table, stats", [("stats", _SCALE_STATS)]),
)
def q_standard_scale(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features standardised with train-split mean and population std (std 0 -> 1)."""
    return _round_cols(scaled_table(spark, sf_dir).select("id", "split", *FEATURES), FEATURES)


@register(
    "baseline_mean",
    _mv(f"SELECT id, split, round(m, {R}) AS prediction, round(total_rentals - m, {R}) AS residual FROM split_table, (SELECT avg(total_rentals) AS m FROM split_table WHERE split = 'train')"),
)
def q_baseline_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean of the train label as the prediction for every row."""
    t = split_table(spark, sf_dir)
    m = M.mean_baseline(t.where("split = 'train'"), LABEL)
    return t.select("id", "split", F.round(F.lit(m), R).alias("prediction"), F.round(F.col(LABEL) - F.lit(m), R).alias("residual"))


def predictions_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fixed-formula predictions tagged with their split: one scan, no join."""
    return chronological_split(X.predictions(spark, sf_dir), TIME)


@register("predictions_union", _mv("SELECT * FROM pred_split"))
def q_predictions_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    return predictions_split(spark, sf_dir)


@register("regression_metrics", _mv(_metric_sql()))
def q_regression_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Six metrics per split in one grouped aggregate (+ exact median by ranks)."""
    m = MT.regression_metrics(predictions_split(spark, sf_dir), ["split"], LABEL)
    return _round_cols(m, MT.METRIC_NAMES)


@register("error_over_time", _mv(f"SELECT time_idx, round(avg(abs(residual)), {R}) AS mean_absolute_error FROM pred_split WHERE split = 'test' GROUP BY time_idx"))
def q_error_over_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round_cols(MT.error_over_time(predictions_split(spark, sf_dir), TIME), ["mean_absolute_error"])


@register("prediction_bounds", _mv("SELECT least(min(total_rentals), min(prediction)) AS min_val, greatest(max(total_rentals), max(prediction)) AS max_val FROM pred_split WHERE split = 'test'"))
def q_prediction_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return MT.prediction_bounds(predictions_split(spark, sf_dir), LABEL)


@register(
    "residual_histogram",
    _mv(
        f"""SELECT b.bin, round(r.lo + b.bin * (r.hi - r.lo) / 30, {R}) AS bin_start, round(r.lo + (b.bin + 1) * (r.hi - r.lo) / 30, {R}) AS bin_end,
                   CAST(count(t.residual) AS BIGINT) AS count
            FROM rng r CROSS JOIN (SELECT CAST(range AS INTEGER) AS bin FROM range(30)) b
            LEFT JOIN (SELECT residual, CAST(least(floor((residual - (SELECT lo FROM rng)) / (((SELECT hi FROM rng) - (SELECT lo FROM rng)) / 30)), 29) AS INTEGER) AS bin
                       FROM pred_split WHERE split = 'test') t ON t.bin = b.bin
            GROUP BY b.bin, r.lo, r.hi""",
        [("rng", "SELECT min(residual) AS lo, max(residual) AS hi FROM pred_split WHERE split = 'test'")],
    ),
)
def q_residual_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """30 equal-width residual bins of the test split, empty bins included."""
    return _round_cols(MT.residual_histogram(predictions_split(spark, sf_dir)), ["bin_start", "bin_end"])


@register("chart_points", _mv("SELECT id, total_rentals AS actual, prediction, residual FROM pred_split WHERE split = 'test'"))
def q_chart_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Actual-vs-predicted and residual-vs-predicted points of the test split."""
    return predictions_split(spark, sf_dir).where("split = 'test'").select("id", F.col(LABEL).alias("actual"), "prediction", "residual")


# ---- linear family ---------------------------------------------------------------------------

def _solve_ctes(alphas: list[float], prefixes: str | None = None) -> list[tuple[str, str]]:
    """SQL that solves the normal equations of the scaled train rows for every alpha, one elimination step a CTE.

    ``solved`` has alpha, my (mean label), m0.. (feature means) and w0.. (coefficients).
    ``prefixes`` is SQL for (fraction, until): then each fraction's rows up to that time are solved.
    """
    k = len(FEATURES)
    idx = range(k)
    key = "fraction, " if prefixes else ""
    scaled = "SELECT id, split, time_idx, total_rentals, " + ", ".join(f"({c} - m_{c}) / s_{c} AS z{i}" for i, c in enumerate(FEATURES)) + " FROM split_table, stats"
    gram = (
        f"SELECT {key}avg(total_rentals) AS my, " + ", ".join(f"avg(z{i}) AS m{i}" for i in idx) + ", "
        + ", ".join(f"covar_pop(z{i}, z{j}) * count(*) AS a{i}_{j}" for i in idx for j in idx) + ", "
        + ", ".join(f"covar_pop(z{i}, total_rentals) * count(*) AS b{i}" for i in idx) + (" FROM scaled, prefixes WHERE split = 'train' AND time_idx <= until GROUP BY fraction" if prefixes else " FROM scaled WHERE split = 'train'")
    )
    keep = f"alpha, {key}my, " + ", ".join(f"m{i}" for i in idx)
    ctes = [("stats", _SCALE_STATS), ("scaled", scaled), *([("prefixes", prefixes)] if prefixes else []), ("gram", gram), ("alphas", "SELECT * FROM (VALUES " + ", ".join(f"(CAST({a} AS DOUBLE))" for a in alphas) + ") AS t(alpha)")]
    ctes.append(("step0", f"SELECT {keep}, " + ", ".join(f"a{i}_{j}" + (" + alpha" if i == j else "") + f" AS a{i}_{j}" for i in idx for j in idx) + ", " + ", ".join(f"b{i}" for i in idx) + " FROM gram, alphas"))
    for p in idx:
        a = [(f"a{p}_{j} / a{p}_{p}" if i == p else f"a{i}_{j} - a{i}_{p} / a{p}_{p} * a{p}_{j}") + f" AS a{i}_{j}" for i in idx for j in range(p + 1, k)]
        b = [(f"b{p} / a{p}_{p}" if i == p else f"b{i} - a{i}_{p} / a{p}_{p} * b{p}") + f" AS b{i}" for i in idx]
        ctes.append((f"step{p + 1}", f"SELECT {keep}, " + ", ".join(a + b) + f" FROM step{p}"))
    ctes.append(("solved", f"SELECT {keep}, " + ", ".join(f"b{i} AS w{i}" for i in idx) + f" FROM step{k}"))
    return ctes


def _coefficients_sql(extra: str = "") -> str:
    return " UNION ALL ".join(f"SELECT alpha, '{c}' AS feature, w{i} AS coefficient FROM solved" for i, c in enumerate(FEATURES)) + extra


_INTERCEPT = " UNION ALL SELECT alpha, 'intercept', my - (" + " + ".join(f"m{i} * w{i}" for i in range(len(FEATURES))) + ") FROM solved"
_SOLVED_PREDICTION = "my + " + " + ".join(f"w{i} * (z{i} - m{i})" for i in range(len(FEATURES)))


def scaled_train_stats(spark: SparkSession, sf_dir: str) -> M.LinearStats:
    """Statistics of all features, scaled, over the train rows."""
    return M.LinearStats.collect(scaled_table(spark, sf_dir).where("split = 'train'"), FEATURES, LABEL)


@register("linear_regression", _mv(f"SELECT feature, round(coefficient, {R}) AS coefficient FROM ({_coefficients_sql(_INTERCEPT)})", _solve_ctes([0.0])))
def q_linear_regression(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Least squares with intercept on all scaled features from one pass of sufficient statistics."""
    fit = M.fit_least_squares(scaled_train_stats(spark, sf_dir))
    rows = [(f, round(w, R)) for f, w, _ in fit.coefficient_rows()] + [("intercept", round(fit.intercept, R))]
    return spark.range(1).select(F.inline(F.array(*[F.struct(F.lit(f).alias("feature"), F.lit(w).alias("coefficient")) for f, w in rows])))


@register("ridge_regression", _mv(f"SELECT alpha, feature, round(coefficient, {R}) AS coefficient FROM ({_coefficients_sql()})", _solve_ctes(RIDGE_ALPHAS)))
def q_ridge_regression(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ridge coefficients of all scaled features for the whole alpha grid from ONE statistics pass."""
    stats = scaled_train_stats(spark, sf_dir)
    rows = []
    for a in RIDGE_ALPHAS:
        fit = M.fit_ridge(stats, a)
        rows += [(float(a), f, round(w, R)) for f, w, _ in fit.coefficient_rows()]
    return spark.range(1).select(F.inline(F.array(*[F.struct(F.lit(a).alias("alpha"), F.lit(f).alias("feature"), F.lit(w).alias("coefficient")) for a, f, w in rows])))


def linear_family_search(spark: SparkSession, sf_dir: str, kind: str) -> tuple[DataFrame, list]:
    """Alpha search (ridge or lasso) on scaled features: train/validation RMSE and MAE per alpha.

    One pass gathers the statistics; all fits are F x F solves; all settings are
    scored in one grouped aggregate over a long table of predictions.
    """
    t = scaled_table(spark, sf_dir)
    stats = M.LinearStats.collect(t.where("split = 'train'"), FEATURES, LABEL)
    alphas = RIDGE_ALPHAS if kind == "ridge" else LASSO_ALPHAS
    fits = [M.fit_ridge(stats, a) if kind == "ridge" else M.fit_lasso(stats, a, LASSO_MAX_ITER, LASSO_TOL) for a in alphas]
    tv = t.where(F.col("split").isin("train", "validation"))
    preds = F.array(*[f.predict_expr() for f in fits])
    scored = tv.select("split", LABEL, F.posexplode(preds).alias("setting", "prediction"))
    table = M.search_table(M.search_errors(scored, LABEL))
    nz = F.array(*[F.lit(int((abs(f.coef) > 0).sum())) for f in fits])
    al = F.array(*[F.lit(float(a)) for a in alphas])
    out = table.select(F.element_at(al, F.col("setting") + 1).alias("alpha"), "train_rmse", "validation_rmse", "train_mae", "validation_mae",
                       *([F.element_at(nz, F.col("setting") + 1).alias("non_zero_coefficients")] if kind == "lasso" else []))
    return out.orderBy("alpha"), fits


@register("lasso_regression")
def q_lasso_regression(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lasso alpha search (coordinate descent on the train Gram matrix)."""
    return linear_family_search(spark, sf_dir, "lasso")[0]


@register(
    "ridge_search",
    _mv(
        "SELECT alpha, " + ", ".join(f"round({f} FILTER (WHERE split = '{sp}'){z}, {R}) AS {sp}_{m}" for m, f, z in (("rmse", "sqrt(avg(power(total_rentals - p, 2))", ")"), ("mae", "avg(abs(total_rentals - p))", "")) for sp in ("train", "validation"))
        + f" FROM (SELECT alpha, split, total_rentals, {_SOLVED_PREDICTION} AS p FROM scaled, solved) GROUP BY alpha",
        _solve_ctes(RIDGE_ALPHAS),
    ),
)
def q_ridge_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round_cols(linear_family_search(spark, sf_dir, "ridge")[0], ["train_rmse", "validation_rmse", "train_mae", "validation_mae"])


@register("coefficient_table", _mv(f"SELECT feature, round(coefficient, {R}) AS coefficient, round(abs(coefficient), {R}) AS abs_coefficient FROM ({_coefficients_sql()})", _solve_ctes([0.0])))
def q_coefficient_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """OLS coefficients on scaled features, largest magnitude first."""
    t = scaled_table(spark, sf_dir)
    fit = M.fit_least_squares(M.LinearStats.collect(t.where("split = 'train'"), FEATURES, LABEL))
    rows = fit.coefficient_rows()
    df = spark.range(1).select(F.inline(F.array(*[F.struct(F.lit(f).alias("feature"), F.lit(w).alias("coefficient"), F.lit(a).alias("abs_coefficient")) for f, w, a in rows])))
    return _round_cols(df, ["coefficient", "abs_coefficient"]).orderBy(F.desc("abs_coefficient"))


def coef_norms_of(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    """L2 norm and non-zero count of the coefficients of every alpha of one family."""
    _, fits = linear_family_search(spark, sf_dir, kind)
    alphas = RIDGE_ALPHAS if kind == "ridge" else LASSO_ALPHAS
    rows = [(kind, float(a), float((f.coef ** 2).sum() ** 0.5), int((abs(f.coef) > 0).sum())) for a, f in zip(alphas, fits)]
    return spark.range(1).select(F.inline(F.array(*[F.struct(F.lit(k).alias("model"), F.lit(a).alias("alpha"), F.lit(n2).alias("coef_l2_norm"), F.lit(nz).alias("non_zero_coefficients")) for k, a, n2, nz in rows])))


@register("coef_norms")
def q_coef_norms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """L2 norm and non-zero count of the coefficients of every ridge and lasso alpha."""
    return coef_norms_of(spark, sf_dir, "ridge").unionByName(coef_norms_of(spark, sf_dir, "lasso"))


@register(
    "ridge_norms",
    _mv(
        f"SELECT alpha, round(sqrt({' + '.join(f'w{i} * w{i}' for i in range(len(FEATURES)))}), {R}) AS coef_l2_norm, "
        f"CAST({' + '.join(f'CASE WHEN w{i} <> 0 THEN 1 ELSE 0 END' for i in range(len(FEATURES)))} AS INTEGER) AS non_zero_coefficients FROM solved",
        _solve_ctes(RIDGE_ALPHAS),
    ),
)
def q_ridge_norms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ridge half of the coefficient norms."""
    own = coef_norms_of(spark, sf_dir, "ridge")
    return own.select("alpha", F.round("coef_l2_norm", R).alias("coef_l2_norm"), "non_zero_coefficients")


# ---- KNN ------------------------------------------------------------------------------------------

KNN_K = 5
_KNN_CTES = [
    ("kq", "SELECT vec_id AS qid, features FROM knn_points WHERE role = 'query'"),
    ("kt", "SELECT vec_id AS tid, features, label FROM knn_points WHERE role = 'train'"),
    ("kd", f"""SELECT qid, tid, label, list_distance(q.features, t.features) AS dist,
                      row_number() OVER (PARTITION BY qid ORDER BY list_distance(q.features, t.features), tid) AS rnk
               FROM kq q, kt t"""),
    ("kn", f"SELECT * FROM kd WHERE rnk <= {KNN_K}"),
]


def knn_fixture(spark: SparkSession, sf_dir: str, k: int = KNN_K) -> DataFrame:
    pts = X.knn_points(spark, sf_dir)
    train = pts.where("role = 'train'").select(F.col("vec_id").alias("tid"), F.col("features").alias("vec"), "label")
    queries = pts.where("role = 'query'").select(F.col("vec_id").alias("qid"), F.col("features").alias("vec"))
    return K.knn_neighbors(train, queries, k, X.KNN_DIMS)


@register("knn_join", with_views(["knn_points"], f"SELECT qid, CAST(rnk AS INTEGER) AS rank, tid, round(dist, {R}) AS distance FROM kn", _KNN_CTES))
def q_knn_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """k nearest train vectors of every query vector (Euclidean, ties by id)."""
    nb = knn_fixture(spark, sf_dir)
    return nb.select("qid", F.posexplode("neighbors").alias("rank", "n")).select(
        "qid", (F.col("rank") + 1).cast("int").alias("rank"), F.col("n.tid").alias("tid"), F.round("n.dist", R).alias("distance")
    )


@register(
    "knn_regressor",
    with_views(
        ["knn_points"],
        f"""SELECT qid, round(avg(label), {R}) AS pred_uniform,
                   round(CASE WHEN count(*) FILTER (WHERE dist = 0) > 0 THEN avg(label) FILTER (WHERE dist = 0)
                              ELSE sum(label / dist) / sum(1 / dist) END, {R}) AS pred_distance
            FROM kn GROUP BY qid""",
        _KNN_CTES,
    ),
)
def q_knn_regressor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """KNN regression: mean label and 1/distance-weighted label of the k neighbours."""
    nb = knn_fixture(spark, sf_dir)
    return nb.select(
        "qid",
        F.round(K.knn_predict(F.col("neighbors"), KNN_K, "uniform"), R).alias("pred_uniform"),
        F.round(K.knn_predict(F.col("neighbors"), KNN_K, "distance"), R).alias("pred_distance"),
    )


def knn_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole KNN grid from ONE neighbour pass (k up to 25) over the scaled train table."""
    t = scaled_table(spark, sf_dir)
    vec = F.array(*[F.col(c) for c in FEATURES])
    train = t.where("split = 'train'").select(F.col("id").alias("tid"), vec.alias("vec"), F.col(LABEL).cast("double").alias("label"))
    queries = t.where(F.col("split").isin("train", "validation")).select(F.col("id").alias("qid"), vec.alias("vec"), "split", LABEL)
    kmax = max(p["n_neighbors"] for p in KNN_GRID)
    joined = K.neighbor_rows(train, queries, kmax, len(FEATURES)).where("qid IS NOT NULL")
    preds = F.array(*[K.knn_predict(F.col("neighbors"), p["n_neighbors"], p["weights"]) for p in KNN_GRID])
    scored = joined.select("split", LABEL, F.posexplode(preds).alias("setting", "prediction"))
    tab = M.search_table(M.search_errors(scored, LABEL))
    ks = F.array(*[F.lit(p["n_neighbors"]) for p in KNN_GRID])
    ws = F.array(*[F.lit(p["weights"]) for p in KNN_GRID])
    return tab.select(
        F.element_at(ks, F.col("setting") + 1).alias("n_neighbors"), F.element_at(ws, F.col("setting") + 1).alias("weights"),
        F.lit(2).alias("p"), "train_rmse", "validation_rmse", "train_mae", "validation_mae",
    ).orderBy("validation_rmse", "train_rmse")


@register("knn_search")
def q_knn_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return knn_search(spark, sf_dir)


# ---- trees ------------------------------------------------------------------------------------------

TREE_GRIDS = {"decision_tree": TREE_GRID, "random_forest": FOREST_GRID, "gradient_boosting": BOOST_GRID}


def tree_search(spark: SparkSession, sf_dir: str, kind: str) -> tuple[DataFrame, list]:
    """Fit every setting of a grid on the train split and score train + validation together."""
    t = split_table(spark, sf_dir).where(F.col("split").isin("train", "validation"))
    t = written_table(t.select("id", "split", F.col(LABEL).cast("double").alias(LABEL), *FEATURES), "tree-search")[0]
    grid = TREE_GRIDS[kind]
    fits = M.fit_grid(kind, grid, t.where("split = 'train'"), LABEL, FEATURES)
    tab = M.search_table(M.search_errors(M.score_grid(t, fits, ["split", LABEL]), LABEL))
    keys = sorted({k for p in grid for k in p})
    params = F.array(*[F.struct(*[F.lit(None if p.get(k) is None else str(p.get(k))).cast("string").alias(k) for k in keys]) for p in grid])
    cols = [F.element_at(params, F.col("setting") + 1)[k].alias(k) for k in keys]
    if kind == "decision_tree":
        shapes = F.array(*[F.struct(F.lit(f.shape()[0]).alias("d"), F.lit(f.shape()[1]).alias("l")) for f in fits])
        cols += [F.element_at(shapes, F.col("setting") + 1)["d"].alias("tree_depth"), F.element_at(shapes, F.col("setting") + 1)["l"].alias("n_leaves")]
    out = tab.select("setting", *cols, "train_rmse", "validation_rmse", "train_mae", "validation_mae").orderBy("validation_rmse", "train_rmse", "setting")
    return out, fits


@register("decision_tree")
def q_decision_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tree_search(spark, sf_dir, "decision_tree")[0]


@register("random_forest")
def q_random_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tree_search(spark, sf_dir, "random_forest")[0]


@register("gradient_boosting")
def q_gradient_boosting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tree_search(spark, sf_dir, "gradient_boosting")[0]


@register("importance_table")
def q_importance_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Feature importances (sum 1) of the best decision tree of the grid."""
    tab, fits = tree_search(spark, sf_dir, "decision_tree")
    best = tab.first()["setting"]
    rows = fits[best].importances()
    return spark.range(1).select(F.inline(F.array(*[F.struct(F.lit(f).alias("feature"), F.lit(v).alias("importance")) for f, v in rows]))).orderBy(F.desc("importance"))


@register("tree_shape")
def q_tree_shape(spark: SparkSession, sf_dir: str) -> DataFrame:
    tab, _ = tree_search(spark, sf_dir, "decision_tree")
    return tab.select("max_depth", "min_samples_leaf", "tree_depth", "n_leaves")


@register("model_persist_predict")
def q_model_persist_predict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every family at its final setting, fitted, saved to the shared folder, loaded, and its prediction of the test split."""
    t = written_table(split_table(spark, sf_dir).withColumn(LABEL, F.col(LABEL).cast("double")), "model-input")[0]
    train, test, out = t.where("split = 'train'"), t.where("split = 'test'"), None
    for kind, params in FINAL_SETTINGS.items():
        path = scratch_path(spark, f"model-{kind}")
        S.save(S.fit_model(kind, params, train, FEATURES, LABEL), spark, path)
        own = S.load(spark, path).predict(test).select(F.lit(kind).alias("model"), "id", LABEL, "prediction")
        out = own if out is None else out.unionByName(own)
    return out


# ---- final fits (the reference's chosen settings), timed like the reference: fit, then predict all splits ----

# The settings the reference's searches selected.
FINAL_SETTINGS = {
    "dummy": {},
    "linear": {},
    "ridge": {"alpha": 1000.0},
    "lasso": {"alpha": 2.0},
    "decision_tree": {"max_depth": None, "min_samples_leaf": 10, "min_samples_split": 20},
    "knn": {"n_neighbors": 25, "weights": "distance", "p": 2},
    "random_forest": {"n_estimators": 200, "max_depth": None, "min_samples_leaf": 5, "min_samples_split": 10, "max_features": "sqrt"},
    "gradient_boosting": {"n_estimators": 200, "learning_rate": 0.05, "max_depth": 3, "min_samples_leaf": 5, "subsample": 1.0},
}


def final_fit(spark: SparkSession, sf_dir: str, kind: str, params: dict | None = None) -> tuple[DataFrame, float, float]:
    """Fit one model on the train split and predict all three splits.

    Returns (predictions, fit seconds, predict seconds); predictions are
    (id, time_idx, start_station_id, total_rentals, split, prediction, residual).
    """
    import time

    params = FINAL_SETTINGS[kind] if params is None else params
    t = written_table(split_table(spark, sf_dir).withColumn(LABEL, F.col(LABEL).cast("double")), "model-input")[0]
    train = t.where("split = 'train'")
    scaler = M.fit_scaler(train, FEATURES) if kind in S.SCALED else None
    keep = ["id", TIME, "start_station_id", LABEL, "split"]
    t0 = time.perf_counter()
    model = S.fit_model(kind, params, train, FEATURES, LABEL, scaler, LASSO_MAX_ITER, LASSO_TOL)
    fit_s = time.perf_counter() - t0
    t1 = time.perf_counter()  # the search for neighbours, index included, is KNN's prediction
    pred = model.predict(t).select(*keep, "prediction").withColumn("residual", F.col(LABEL) - F.col("prediction"))
    pred = written_table(pred, "predictions")[0]
    return pred, fit_s, time.perf_counter() - t1


def final_metrics(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    pred, fit_s, pred_s = final_fit(spark, sf_dir, kind)
    m = MT.metrics_wide(MT.regression_metrics(pred.withColumn("model", F.lit(kind)), ["model", "split"], LABEL), ["model"])
    return m.withColumns({"fit_time_seconds": F.lit(fit_s), "predict_time_seconds": F.lit(pred_s)})


@register("final_model_metrics")
def q_final_model_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metric record (18 metrics + timings) of every model family at its selected setting."""
    out = None
    for kind in FINAL_SETTINGS:
        m = final_metrics(spark, sf_dir, kind)
        out = m if out is None else out.unionByName(m)
    return out


@register("search_curve")
def q_search_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Search-curve data of the KNN grid: parameter label and validation RMSE."""
    from tidecast.functions.scalars import param_text

    s = knn_search(spark, sf_dir)
    label = F.concat(F.lit("k="), param_text("n_neighbors"), F.lit(", "), param_text("weights"))
    return s.select(label.alias("label"), "n_neighbors", "weights", "validation_rmse").orderBy("weights", "n_neighbors")
