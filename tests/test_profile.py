import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidecast.operators import profile as P


def test_correlation_matches_pandas_pairwise(spark):
    rng = np.random.default_rng(7)
    n = 300
    a = rng.normal(size=n); b = a * 2 + rng.normal(size=n) * 0.1; c = rng.normal(size=n) + 1995
    a[::7] = np.nan; c[::11] = np.nan
    pdf = pd.DataFrame({"a": a, "b": b, "c": c, "k": np.full(n, 0.3)})
    df = spark.createDataFrame(pdf.astype(object).where(pdf.notna(), None), "a double, b double, c double, k double")
    got = {(r["feature_1"], r["feature_2"]): r["correlation"] for r in P.correlation_long(df, ["a", "b", "c", "k"]).collect()}
    want = pdf.corr()
    for (f1, f2), v in got.items():
        w = want.loc[f1, f2]
        if f1 == "k" or f2 == "k":
            assert v is None  # constant column -> null, no error
        else:
            assert math.isclose(v, w, rel_tol=1e-9, abs_tol=1e-12)


def test_high_corr_pairs_and_drop_list(spark):
    corr = spark.createDataFrame(
        [("a", "b", 0, 1, 0.95), ("a", "month", 0, 2, 0.9), ("b", "month", 1, 2, 0.9), ("a", "c", 0, 3, 0.2)],
        "feature_1 string, feature_2 string, i int, j int, correlation double")
    pairs = P.high_corr_pairs(corr)
    assert [(r["feature_1"], r["feature_2"]) for r in pairs.collect()] == [("a", "b"), ("a", "month"), ("b", "month")]
    scores = spark.createDataFrame([("a", 0.5), ("b", 0.5), ("month", 0.1)], "feature string, target_score double")
    recs = P.drop_recommendations(pairs, scores).collect()
    # tie on (a, b) keeps a; (a, month) keeps the preferred month; (b, month) skipped (b dropped)
    assert [(r["drop_feature"], r["keep_feature"], r["reason"]) for r in recs] == [
        ("b", "a", "kept feature with stronger target correlation"), ("a", "month", "kept preferred feature")]


def test_no_pair_gives_empty_list_with_schema(spark):
    corr = spark.createDataFrame([("a", "b", 0, 1, 0.1)], "feature_1 string, feature_2 string, i int, j int, correlation double")
    scores = spark.createDataFrame([("a", 0.5)], "feature string, target_score double")
    out = P.drop_recommendations(P.high_corr_pairs(corr), scores)
    assert out.count() == 0
    assert out.columns == ["drop_feature", "keep_feature", "abs_feature_feature_corr", "drop_feature_target_score", "keep_feature_target_score", "reason"]


def test_detect_targets_and_predictors(spark):
    from paths import SF_SMALL
    from tidecast.plans import analysis_jobs as AJ

    t = AJ.analysis_table(spark, SF_SMALL)
    assert P.detect_targets(t.columns) == AJ.TARGETS
    assert P.numeric_predictors(t) == AJ.PREDICTORS


def test_column_profile(spark):
    df = spark.createDataFrame([(1, 1.0), (1, None), (2, 3.0)], "i int, x double")
    prof = {r["feature"]: r for r in P.column_profile(df, ["i", "x"]).collect()}
    assert (prof["i"]["dtype"], prof["i"]["missing_values"], prof["i"]["n_unique"]) == ("int64", 0, 2)
    assert (prof["x"]["dtype"], prof["x"]["missing_values"], prof["x"]["n_unique"]) == ("float64", 1, 2)


def test_correlation_keeps_its_digits(spark):
    from tidecast.operators import profile as P

    rng = np.random.default_rng(3)
    x = 1e9 + rng.normal(size=400)
    y = x + rng.normal(size=400) * 0.5
    pdf = pd.DataFrame({"x": x, "y": y, "flat": np.full(400, 0.3)})
    pdf.loc[0, ["x", "y"]] = [0.0, None]  # one wild value on a row where the partner is missing
    pdf.loc[5, "flat"] = 7.0
    pdf.loc[5, "y"] = None  # so `flat` is constant wherever y is present
    want = pdf.corr()
    for parts in (1, 7):
        got = {(r.feature_1, r.feature_2): r.correlation for r in P.correlation_long(spark.createDataFrame(pdf).replace(float("nan"), None).repartition(parts), ["x", "y", "flat"]).collect()}
        assert abs(got["x", "y"] - want.loc["x", "y"]) < 1e-6 and got["x", "y"] == pytest.approx(got["y", "x"], abs=1e-12)
        assert got["flat", "y"] is None and got["y", "flat"] is None


def test_profile_tells_large_whole_numbers_apart(spark):
    from tidecast.operators import profile as P

    df = spark.createDataFrame([(2**53, 0.0), (2**53 + 1, -0.0), (2**53 + 2, float("nan")), (None, 1.5)], "a long, b double")
    got = {r.feature: (r.missing_values, r.n_unique) for r in P.column_profile(df, ["a", "b"]).collect()}
    assert got == {"a": (1, 3), "b": (1, 2)}


def test_wide_matrix_of_500_columns_by_blocks(spark):
    from tidecast.operators.moments import pair_moments

    rng = np.random.default_rng(6)
    x = rng.normal(size=(60, 500)) + 1e5
    x[:, 1] = 2 * x[:, 0]
    cols = [f"f{k}" for k in range(500)]
    df = spark.createDataFrame([tuple(map(float, r)) for r in x], ", ".join(f"{c} double" for c in cols)).repartition(2)
    rows = pair_moments(df, cols, block=200).select("i", "j", "c", "m2x", "m2y").toPandas()
    assert len(rows) == 500 * 500 and not rows.duplicated(["i", "j"]).any()
    got = np.zeros((500, 500))
    got[rows["i"], rows["j"]] = rows["c"] / np.sqrt(rows["m2x"] * rows["m2y"])
    assert np.allclose(got, np.corrcoef(x.T), atol=1e-8)


def test_blocks_and_buckets_give_the_moments_of_one_scan(spark):
    from tidecast.operators.moments import pair_moments

    rng = np.random.default_rng(7)
    rows = [tuple(None if rng.random() < 0.1 else float(v) for v in rng.normal(size=5)) + (int(b),) for b in rng.integers(0, 3, 300)]
    df = spark.createDataFrame(rows, "a double, b double, c double, d double, e double, bucket int").repartition(3)
    key = lambda d: {(r["bucket"], r["i"], r["j"]): np.round([r["rows"], r["n"], r["mx"], r["my"], r["m2x"], r["m2y"], r["c"], r["lo"], r["hi"]], 9).tolist() for r in d.collect()}
    whole = key(pair_moments(df, list("abcde"), F.col("bucket")))
    assert len(whole) == 75 and whole == key(pair_moments(df, list("abcde"), F.col("bucket"), block=2))
    one = key(pair_moments(df.where("bucket = 1"), list("abcde")))
    assert {k[1:]: v for k, v in whole.items() if k[0] == 1} == {k[1:]: v for k, v in one.items()}
