import pytest

from tidecast.operators import compare as C

# The committed 8-model comparison, retyped to 4 digits.
ROWS = [
    ("Dummy", "00_dummy_regressor", 36.9986, 46.0996, -0.5329, 0.5848, 38.1406, 48.5574, -0.5235, 0.6506),
    ("Linear", "01_linear_regression", 26.1398, 32.9366, 0.2175, 0.5592, 29.4041, 36.7227, 0.1286, 0.5984),
    ("Ridge", "02_ridge_regression", 25.5663, 32.3658, 0.2444, 0.5471, 28.6752, 35.9079, 0.1669, 0.5831),
    ("Lasso", "03_lasso_regression", 24.0351, 31.1253, 0.3012, 0.51, 26.2065, 33.4861, 0.2755, 0.5601),
    ("Decision Tree", "04_decision_tree", 21.3321, 28.6399, 0.4083, 0.3625, 24.3241, 32.0322, 0.337, 0.3231),
    ("KNN", "05_knn_regressor", 23.5041, 31.1397, 0.3005, 0.3862, 24.4177, 32.352, 0.3237, 0.366),
    ("Random Forest", "06_random_forest", 20.3996, 27.2815, 0.4631, 0.3465, 22.8705, 30.3089, 0.4064, 0.3599),
    ("Gradient Boosting", "07_gradient_boosting", 20.5255, 27.0031, 0.474, 0.3714, 23.708, 30.5692, 0.3962, 0.3804),
]
SCHEMA = ("model_name string, folder_name string, validation_mae double, validation_rmse double, validation_r2 double, "
          "validation_mape double, test_mae double, test_rmse double, test_r2 double, test_mape double")


@pytest.fixture(scope="module")
def ranked(spark):
    df = spark.createDataFrame(ROWS[::-1], SCHEMA).withColumn("display_name", C.display_name())
    return C.add_ranks(C.order_models(df))


def test_rank_sums(ranked):
    rows = sorted(ranked.collect(), key=lambda r: r["position"])
    assert [r["rank_sum_validation"] for r in rows] == [24, 21, 18, 13, 9, 14, 5, 4]
    assert [r["rank_sum_test"] for r in rows] == [24, 21, 18, 15, 9, 12, 3, 6]
    assert [r["display_name"] for r in rows][:2] == ["Dummy", "Linear"]


def test_summary(ranked):
    s = {r["criterion"]: r["display_name"] for r in C.summary(ranked).collect()}
    assert s == {"best_by_validation_rmse": "Gradient Boosting", "best_by_test_rmse": "Random Forest",
                 "best_by_validation_rank_sum": "Gradient Boosting", "best_by_test_rank_sum": "Random Forest"}


def test_display_name_fallbacks(spark):
    df = spark.createDataFrame([("x_folder", "FooRegressor"), ("y_folder", None), ("08_xgboost", "Anything")], "folder_name string, model_name string")
    assert [r[0] for r in df.select(C.display_name()).collect()] == ["Foo", "y_folder", "XGBoost"]
    assert [r[0] for r in df.select(C.sort_order()).collect()] == [999, 999, 8]


def test_rankings_tie_keeps_model_order(ranked):
    r = C.ranking(ranked, "validation").orderBy("rank_validation").collect()
    assert r[0]["display_name"] == "Gradient Boosting" and r[-1]["display_name"] == "Dummy"


def test_missing_metrics_never_win(spark):
    rows = [(*ROWS[0][:2], *[None] * 8), *ROWS[1:4]]
    df = C.add_ranks(C.order_models(spark.createDataFrame(rows, SCHEMA).withColumn("display_name", C.display_name())))
    by_name = {r["display_name"]: r for r in C.ranking(C.best_flags(df, [("validation_rmse", False), ("test_r2", True)]), "test").collect()}
    dummy = by_name["Dummy"]
    assert dummy["rank_validation_rmse"] is None and dummy["rank_sum_test"] is None and dummy["rank_test"] == 4
    assert dummy["best_validation_rmse"] == dummy["best_test_r2"] == 0 and by_name["Lasso"]["best_validation_rmse"] == 1
    assert by_name["Lasso"]["rank_validation_rmse"] == 1
    assert C.arg_best(df, "test_r2", True).first()["display_name"] == "Lasso"
    assert {r["display_name"] for r in C.summary(df).collect()} == {"Lasso"}
    none = spark.createDataFrame([(*ROWS[0][:2], *[None] * 8)], SCHEMA).withColumn("display_name", C.display_name())
    assert C.arg_best(C.order_models(none), "test_r2", True).first()["display_name"] is None


def test_metric_files_with_other_columns(spark, tmp_path):
    from pyspark.sql import types as T

    for name, text in (("a", "mae,rmse,note\n1.5,2.5,x\n9,9,y\n"), ("b", "rmse\n3.5\n"), ("c", "mae,rmse\n")):
        (tmp_path / name / "results").mkdir(parents=True)
        (tmp_path / name / "results" / "metrics.csv").write_text(text)
    schema = T.StructType([T.StructField(c, T.DoubleType()) for c in ("mae", "rmse", "r2")])
    found, skipped = C.collect_metric_csv(spark, f"file://{tmp_path}", ["a", "b", "c", "d"], schema)
    assert skipped == ["c", "d"]
    assert {r.folder_name: (r.mae, r.rmse, r.r2) for r in found.collect()} == {"a": (1.5, 2.5, None), "b": (None, 3.5, None)}
    assert C.collect_metric_csv(spark, f"file://{tmp_path}", ["d"], schema)[0].count() == 0
