"""Regression models on Spark: scaling, mean baseline, least squares / ridge / lasso,
trees, forests and boosting, with grid search on the validation split.

Linear family: ONE distributed pass collects the centred sufficient statistics
(n, means, X'X, X'y) of the train rows - F*F numbers per partition, summed by a
grouped aggregate. Every alpha of a grid is then a small F*F solve (ridge:
closed form; lasso: coordinate descent on the Gram matrix, the same objective
as the reference library). Predictions are plain column expressions
(intercept + sum w_i x_i), so scoring stays inside whole-stage codegen.

Trees, forests and boosting: grown on Spark by ``tree_growth`` and ``boosting``,
scored by ``tree_arrays``; settings of a grid that are beginnings of each other come
from one ensemble.
"""

from __future__ import annotations

import math
import time
from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor

import numpy as np
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidecast.operators.boosting import Chain, boost
from tidecast.operators.moments import pair_moments
from tidecast.operators.stored_forest import StoredForest
from tidecast.operators.tree_arrays import Plan, Trees, with_predictions
from tidecast.operators.tree_growth import binned, exact_tree, stored_forests

SEED = 42
TREES = ("decision_tree", "random_forest", "gradient_boosting")


# ---- scaling -----------------------------------------------------------------------


def fit_scaler(train: DataFrame, features: Sequence[str]) -> dict[str, tuple[float, float]]:
    """Mean and population standard deviation per feature on the train rows (0 -> 1)."""
    row = train.agg(*[F.avg(c).alias(f"m_{c}") for c in features], *[F.stddev_pop(c).alias(f"s_{c}") for c in features]).first()
    out = {}
    for c in features:
        m = row[f"m_{c}"] or 0.0
        s = row[f"s_{c}"]
        out[c] = (float(m), 1.0 if s is None or s == 0 else float(s))
    return out


def scale(df: DataFrame, stats: dict[str, tuple[float, float]]) -> DataFrame:
    """Standardise the features in place: (x - mean) / std."""
    return df.withColumns({c: (F.col(c).cast("double") - F.lit(m)) / F.lit(s) for c, (m, s) in stats.items()})


# ---- sufficient statistics -------------------------------------------------------------


class LinearStats:
    """Centred Gram statistics of one table: enough for any ridge / lasso / OLS fit."""

    def __init__(self, n: float, mean_x: np.ndarray, mean_y: float, xtx: np.ndarray, xty: np.ndarray, yty: float, features: list[str]):
        self.n, self.mean_x, self.mean_y = n, mean_x, mean_y
        self.xtx, self.xty, self.yty, self.features = xtx, xty, yty, features

    @classmethod
    def collect(cls, df: DataFrame, features: Sequence[str], label: str) -> LinearStats:
        """One pass; raises if a feature or the label is null or NaN in any row."""
        (stats,) = cls.collect_prefixes(df, features, label, F.lit(0), 1)
        return stats

    @classmethod
    def collect_prefixes(cls, df: DataFrame, features: Sequence[str], label: str, bucket: Column, n_buckets: int) -> list[LinearStats]:
        """Statistics of the rows of buckets 0 to k, for every k, from one pass.

        The moments of each bucket are centred on its own means and merged along the
        buckets by those means, so no difference of large sums is taken.
        """
        feats = list(features)
        k = len(feats)
        rows = pair_moments(df, [*feats, label], bucket).collect()  # n_buckets * (k+1)^2 rows: bounded by the feature count
        if not rows:
            raise ValueError("no train rows")
        gaps = sorted({[*feats, label][r["i"]] for r in rows if r["i"] == r["j"] and r["n"] < r["rows"]})
        if gaps:
            raise ValueError(f"missing values in {', '.join(gaps)}: fill or drop them before fitting")
        count, mean, cross = np.zeros(n_buckets), np.zeros((n_buckets, k + 1)), np.zeros((n_buckets, k + 1, k + 1))
        for r in rows:
            count[r["bucket"]], mean[r["bucket"], r["i"]], cross[r["bucket"], r["i"], r["j"]] = r["n"], r["mx"], r["c"]
        out, n, at, c = [], 0.0, np.zeros(k + 1), np.zeros((k + 1, k + 1))
        for own_n, own_at, own_c in zip(count, mean, cross):
            if own_n:
                away = own_at - at
                c = c + own_c + np.outer(away, away) * (n * own_n / (n + own_n))
                n, at = n + own_n, at + away * (own_n / (n + own_n))
            if not n:
                raise ValueError("no train rows")
            out.append(cls(n, at[:k].copy(), float(at[k]), c[:k, :k].copy(), c[:k, k].copy(), float(c[k, k]), feats))
        return out


class LinearFit:
    def __init__(self, features: list[str], coef: np.ndarray, intercept: float):
        self.features, self.coef, self.intercept = features, coef, float(intercept)

    def predict_expr(self) -> Column:
        e = F.lit(self.intercept)
        for c, w in zip(self.features, self.coef):
            e = e + F.col(c).cast("double") * F.lit(float(w))
        return e

    def coefficient_rows(self) -> list[tuple[str, float, float]]:
        return [(f, float(w), abs(float(w))) for f, w in zip(self.features, self.coef)]


def fit_least_squares(stats: LinearStats) -> LinearFit:
    """Ordinary least squares with intercept (minimum-norm solution if rank deficient)."""
    w, *_ = np.linalg.lstsq(stats.xtx, stats.xty, rcond=None)
    return LinearFit(stats.features, w, stats.mean_y - stats.mean_x @ w)


def fit_ridge(stats: LinearStats, alpha: float) -> LinearFit:
    """min ||y - Xw - b||^2 + alpha ||w||^2 (intercept not penalised)."""
    k = len(stats.features)
    w = np.linalg.solve(stats.xtx + alpha * np.eye(k), stats.xty)
    return LinearFit(stats.features, w, stats.mean_y - stats.mean_x @ w)


def fit_lasso(stats: LinearStats, alpha: float, max_iter: int = 10000, tol: float = 1e-4) -> LinearFit:
    """min (1/2n)||y - Xw - b||^2 + alpha ||w||_1 by cyclic coordinate descent on the Gram matrix.

    Stops when the largest coefficient change in a sweep is below ``tol`` times
    the largest coefficient (the reference library's rule), then keeps sweeping
    a little longer for a tighter answer.
    """
    n = stats.n
    g = stats.xtx / n
    c = stats.xty / n
    k = len(c)
    w = np.zeros(k)
    diag = np.diag(g).copy()
    for it in range(max_iter):
        w_max = 0.0; d_max = 0.0
        for j in range(k):
            if diag[j] == 0:
                continue
            old = w[j]
            rho = c[j] - g[j] @ w + diag[j] * old
            new = np.sign(rho) * max(abs(rho) - alpha, 0.0) / diag[j]
            w[j] = new
            d_max = max(d_max, abs(new - old)); w_max = max(w_max, abs(new))
        if w_max == 0.0 or d_max / w_max < tol * 1e-6:
            break
    return LinearFit(stats.features, w, stats.mean_y - stats.mean_x @ w)


# ---- mean baseline -----------------------------------------------------------------------------


def mean_baseline(train: DataFrame, label: str) -> float:
    return float(train.agg(F.avg(label)).first()[0])


# ---- trees ---------------------------------------------------------------------------------------


def assemble(df: DataFrame, features: Sequence[str], out: str = "features") -> DataFrame:
    return VectorAssembler(inputCols=list(features), outputCol=out, handleInvalid="error").transform(df)


def sqrt_features(n_features: int) -> str:
    """Feature subset size for 'sqrt', rounded down."""
    return str(max(1, int(math.sqrt(n_features))))


def _with_predictions(df: DataFrame, trees: Trees | StoredForest, plans: Sequence[Plan]) -> DataFrame:
    if isinstance(trees, StoredForest):
        return trees.with_predictions(df, plans, "_predictions")
    return with_predictions(df, trees, trees.features, plans, out="_predictions")


class TreeFit:
    """An ensemble cut off by a plan (number of trees, depth); it scores the feature columns."""

    def __init__(self, trees: Trees | StoredForest, plan: Plan = (None, None)):
        self.trees, self.plan = trees, plan

    def transform(self, df: DataFrame) -> DataFrame:
        out = _with_predictions(df, self.trees, [self.plan])
        return out.withColumn("prediction", F.get("_predictions", 0)).drop("_predictions")

    def importances(self) -> list[tuple[str, float]]:
        return self.trees.importances(*self.plan)

    def shape(self) -> tuple[int, int]:
        """(depth, leaves) of a single tree."""
        return self.trees.shape(self.plan[1])


def _most(values: Sequence[int | None]) -> int | None:
    """The largest; None stands for no limit."""
    return None if None in values else max(values)


def fit_grid(kind: str, grid: Sequence[dict], train: DataFrame, label: str, features: Sequence[str]) -> list[TreeFit]:
    """A fit for every setting, grown as few times as the settings allow.

    Settings that are the beginning of each other (fewer trees, less depth) share one
    ensemble: trees and forests by leaf size, boosting by everything but the number of
    trees, and all boosting chains grow in the same passes.
    """
    names = list(features)
    if kind == "gradient_boosting":
        share = [(p["learning_rate"], p["max_depth"], int(p.get("min_samples_leaf", 1)), float(p.get("subsample", 1.0))) for p in grid]
    else:
        share = [int(p.get("min_samples_leaf", 1)) for p in grid]
    own = {k: [p for p, s in zip(grid, share) if s == k] for k in dict.fromkeys(share)}
    depth = {k: _most([p.get("max_depth") for p in ps]) for k, ps in own.items()}
    if kind == "decision_tree":
        grown = dict(zip(own, parallel_map(lambda k: exact_tree(train, names, label, k, depth[k]), list(own))))
    elif kind in ("random_forest", "gradient_boosting"):
        data = binned(train, names, label)
        count = {k: max(int(p["n_estimators"]) for p in ps) for k, ps in own.items()}
        if kind == "random_forest":
            grown = {}
            for n in dict.fromkeys(count.values()):
                same = [k for k in own if count[k] == n]
                grown |= zip(same, stored_forests(data, n, [(k, depth[k]) for k in same], int(sqrt_features(len(names))), SEED))
        else:
            grown = dict(zip(own, boost(data, [Chain(count[k], k[0], k[1], k[2], k[3]) for k in own])))
    else:
        raise ValueError(kind)
    cut = None if kind == "gradient_boosting" else "max_depth"
    return [TreeFit(grown[s], (p.get("n_estimators"), p.get(cut) if cut else None)) for p, s in zip(grid, share)]


def fit_tree(kind: str, params: dict, train: DataFrame, label: str, features: Sequence[str]) -> TreeFit:
    """Fit one setting on the train rows, spread over all task slots."""
    n = int(train.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return fit_grid(kind, [params], train.repartition(n), label, features)[0]


def score_grid(df: DataFrame, fits: Sequence[TreeFit], keep: Sequence[str]) -> DataFrame:
    """(keep..., setting, prediction) of all fits: fits of one ensemble are scored in one walk."""
    ensembles: dict[int, list[int]] = {}
    for i, f in enumerate(fits):
        ensembles.setdefault(id(f.trees), []).append(i)
    scored = None
    for own in ensembles.values():
        trees = fits[own[0]].trees
        out = _with_predictions(df, trees, [fits[i].plan for i in own])
        numbers = F.array(*(F.lit(i) for i in own))
        out = out.select(*keep, F.posexplode("_predictions").alias("_at", "prediction")).select(*keep, F.get(numbers, F.col("_at")).alias("setting"), "prediction")
        scored = out if scored is None else scored.unionByName(out)
    return scored


def timed(fn, *a, **kw):
    t0 = time.perf_counter()
    out = fn(*a, **kw)
    return out, time.perf_counter() - t0


def parallel_map(fn, items: Sequence, threads: int = 4) -> list:
    """Run independent Spark fits concurrently from driver threads (jobs share the cluster)."""
    if len(items) <= 1 or threads <= 1:
        return [fn(x) for x in items]
    with ThreadPoolExecutor(max_workers=min(threads, len(items))) as pool:
        return list(pool.map(fn, items))


SEARCH_SCHEMA = T.StructType(
    [T.StructField("setting", T.IntegerType()), T.StructField("split", T.StringType()),
     T.StructField("rmse", T.DoubleType()), T.StructField("mae", T.DoubleType())]
)


def search_errors(scored: DataFrame, label: str) -> DataFrame:
    """RMSE and MAE per (setting, split) of a long table of predictions (one grouped aggregate)."""
    e = F.col(label).cast("double") - F.col("prediction")
    return scored.groupBy("setting", "split").agg(F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(F.abs(e)).alias("mae"))


def search_table(errors: DataFrame) -> DataFrame:
    """(setting, train_rmse, validation_rmse, train_mae, validation_mae)."""
    def pick(split: str, m: str) -> Column:
        return F.first(F.when(F.col("split") == split, F.col(m)), ignorenulls=True).alias(f"{split}_{m}")

    return errors.groupBy("setting").agg(pick("train", "rmse"), pick("validation", "rmse"), pick("train", "mae"), pick("validation", "mae"))
