import numpy as np
import pytest
from pyspark.ml.regression import LinearRegression
from pyspark.sql import functions as F

from paths import SF_MID
from tidecast.operators import models as M
from tidecast.plans import model_jobs as MJ


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(11)
    n = 400
    x = rng.normal(size=(n, 3)); y = 3 + x @ np.array([1.5, -2.0, 0.0]) + rng.normal(0, 0.5, n)
    rows = [tuple(map(float, r)) + (float(t),) for r, t in zip(x, y)]
    return spark.createDataFrame(rows, "a double, b double, c double, y double"), x, y


def test_ols_and_ridge_match_closed_form(data):
    df, x, y = data
    stats = M.LinearStats.collect(df, ["a", "b", "c"], "y")
    xc = x - x.mean(0); yc = y - y.mean()
    ols = M.fit_least_squares(stats)
    assert np.allclose(ols.coef, np.linalg.lstsq(xc, yc, rcond=None)[0], atol=1e-9)
    rid = M.fit_ridge(stats, 10.0)
    assert np.allclose(rid.coef, np.linalg.solve(xc.T @ xc + 10 * np.eye(3), xc.T @ yc), atol=1e-9)
    assert rid.intercept == pytest.approx(y.mean() - x.mean(0) @ rid.coef)


def test_ols_matches_spark_ml(spark, data):
    df, _, _ = data
    stats = M.LinearStats.collect(df, ["a", "b", "c"], "y")
    ols = M.fit_least_squares(stats)
    lr = LinearRegression(featuresCol="features", labelCol="y", solver="normal", regParam=0.0).fit(M.assemble(df, ["a", "b", "c"]))
    assert np.allclose(ols.coef, lr.coefficients.toArray(), atol=1e-7)
    assert ols.intercept == pytest.approx(lr.intercept, abs=1e-7)


def test_lasso_matches_spark_l1(spark, data):
    df, _, _ = data
    stats = M.LinearStats.collect(df, ["a", "b", "c"], "y")
    las = M.fit_lasso(stats, 0.3)
    lr = LinearRegression(featuresCol="features", labelCol="y", elasticNetParam=1.0, regParam=0.3, standardization=False,
                          maxIter=1000, tol=1e-12).fit(M.assemble(df, ["a", "b", "c"]))
    assert np.allclose(las.coef, lr.coefficients.toArray(), atol=1e-5)
    assert (las.coef == 0).sum() >= 1  # the null feature is zeroed


def test_predict_expression(data):
    df, x, y = data
    fit = M.fit_ridge(M.LinearStats.collect(df, ["a", "b", "c"], "y"), 1.0)
    got = [r[0] for r in df.select(fit.predict_expr()).collect()]
    assert np.allclose(got, fit.intercept + x @ fit.coef)


def test_scaler_uses_population_std(spark):
    df = spark.createDataFrame([(1.0, 5.0), (3.0, 5.0)], "a double, k double")
    stats = M.fit_scaler(df, ["a", "k"])
    assert stats["a"] == (2.0, 1.0) and stats["k"] == (5.0, 1.0)


def test_sqrt_features_rounds_down():
    assert M.sqrt_features(17) == "4" and M.sqrt_features(6) == "2"


def test_tree_properties(spark):
    t = MJ.split_table(spark, SF_MID)
    a = M.assemble(t, MJ.FEATURES).withColumn("total_rentals", F.col("total_rentals").cast("double"))
    train = a.where("split = 'train'")
    fit = M.fit_tree("decision_tree", MJ.TREE_GRID[2], train, "total_rentals", MJ.FEATURES)
    imp = [v for _, v in fit.importances()]
    assert sum(imp) == pytest.approx(1.0)
    depth, leaves = fit.shape()
    assert depth <= 8 and leaves >= 2
    e = F.col("total_rentals") - F.col("prediction")
    rmse = fit.transform(train).agg(F.sqrt(F.avg(e * e))).first()[0]
    base = train.agg(F.stddev_pop("total_rentals")).first()[0]
    assert rmse < base


def test_boosting_is_seeded(spark):
    t = MJ.split_table(spark, SF_MID)
    a = M.assemble(t.where("split = 'train'"), MJ.FEATURES).withColumn("total_rentals", F.col("total_rentals").cast("double"))
    p = {"n_estimators": 5, "learning_rate": 0.05, "max_depth": 2, "min_samples_leaf": 5, "subsample": 1.0}
    f1 = M.fit_tree("gradient_boosting", p, a, "total_rentals", MJ.FEATURES)
    f2 = M.fit_tree("gradient_boosting", p, a, "total_rentals", MJ.FEATURES)
    s = lambda f: sorted(r[0] for r in f.transform(a).select("prediction").collect())
    assert s(f1) == s(f2)


def _linear_rows(spark, parts, gap=False):
    rng = np.random.default_rng(9)
    x = rng.normal(size=(1000, 2)) + 1e6
    y = 3 * x[:, 0] - 2 * x[:, 1] + 5
    rows = [(float(a), float(b), float(c)) for (a, b), c in zip(x, y)]
    if gap:
        rows[17] = (None, *rows[17][1:])
    return spark.createDataFrame(rows, "a double, b double, y double").repartition(parts)


@pytest.mark.parametrize("parts", [2, 8])
def test_linear_stats_reject_missing_values(spark, parts):
    with pytest.raises(ValueError, match="missing values in a"):
        M.LinearStats.collect(_linear_rows(spark, parts, gap=True), ["a", "b"], "y")
    fit = M.fit_least_squares(M.LinearStats.collect(_linear_rows(spark, parts), ["a", "b"], "y"))
    assert np.allclose(fit.coef, [3, -2], atol=1e-6)


def test_no_cache_is_left(spark):
    from tidecast.plans import model_jobs as MJ

    before = spark.sparkContext._jsc.getPersistentRDDs().size()
    for kind in ("linear", "decision_tree"):
        MJ.final_fit(spark, "/root/testdata/sf0.001", kind)[0].count()
    assert spark.sparkContext._jsc.getPersistentRDDs().size() <= before


def test_prefixes_of_one_pass_are_fits_of_their_rows(spark):
    rng = np.random.default_rng(12)
    x = rng.normal(size=(600, 2)) + 1e6
    y = x @ np.array([2.0, -1.0]) + rng.normal(size=600)
    when = rng.integers(0, 4, 600)
    df = spark.createDataFrame([(float(a), float(b), float(c), int(t)) for (a, b), c, t in zip(x, y, when)], "a double, b double, y double, t int").repartition(5)
    for k, stats in enumerate(M.LinearStats.collect_prefixes(df, ["a", "b"], "y", F.col("t"), 4)):
        own = when <= k
        xc, yc = x[own] - x[own].mean(0), y[own] - y[own].mean()
        assert stats.n == own.sum()
        assert np.allclose(M.fit_ridge(stats, 1.0).coef, np.linalg.solve(xc.T @ xc + np.eye(2), xc.T @ yc), atol=1e-7)
