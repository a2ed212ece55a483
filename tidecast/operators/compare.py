"""Cross-model comparison: collect metric records, name and order models, ranks, rankings, summary.

All operators take an optional list of grouping columns so that many
comparisons (per segment, per entity) are ranked in one job; windows are
partitioned by those columns and ordered inside each group only.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from tidecast.sources.tables import path_exists

# Display names of the known model folders, and their preferred order.
FOLDER_DISPLAY = {
    "00_dummy_regressor": "Dummy",
    "01_linear_regression": "Linear",
    "02_ridge_regression": "Ridge",
    "03_lasso_regression": "Lasso",
    "04_decision_tree": "Decision Tree",
    "05_knn_regressor": "KNN",
    "06_random_forest": "Random Forest",
    "07_gradient_boosting": "Gradient Boosting",
    "08_xgboost": "XGBoost",
}
PREFERRED_ORDER = [
    "00_dummy_regressor", "01_linear_regression", "02_ridge_regression", "03_lasso_regression",
    "04_decision_tree", "05_knn_regressor", "06_random_forest", "07_gradient_boosting", "08_xgboost",
]
UNKNOWN_ORDER = 999
COMPACT_COLUMNS = [
    "display_name", "folder_name", "validation_mae", "validation_rmse", "validation_r2", "validation_mape",
    "test_mae", "test_rmse", "test_r2", "test_mape", "fit_time_seconds", "predict_time_seconds",
    "rank_sum_validation", "rank_sum_test",
]
# (rank column, metric, ascending)
RANK_SPECS = [
    ("rank_validation_rmse", "validation_rmse", True), ("rank_validation_mae", "validation_mae", True),
    ("rank_validation_r2", "validation_r2", False), ("rank_test_rmse", "test_rmse", True),
    ("rank_test_mae", "test_mae", True), ("rank_test_r2", "test_r2", False),
]


def _map(d: dict) -> Column:
    return F.create_map(*[x for k, v in d.items() for x in (F.lit(k), F.lit(v))])


def display_name(folder: Column | str = "folder_name", model: Column | str = "model_name") -> Column:
    """Known folder -> its name; else the model name without 'Regressor'/'Regression'; else the folder."""
    f = F.col(folder) if isinstance(folder, str) else folder
    m = F.col(model) if isinstance(model, str) else model
    cleaned = F.btrim(F.replace(F.replace(m, F.lit("Regressor"), F.lit("")), F.lit("Regression"), F.lit("")))
    return F.coalesce(_map(FOLDER_DISPLAY)[f], F.when(m.isNotNull() & (m != ""), cleaned), f)


def sort_order(folder: Column | str = "folder_name") -> Column:
    f = F.col(folder) if isinstance(folder, str) else folder
    return F.coalesce(_map({n: i for i, n in enumerate(PREFERRED_ORDER)})[f], F.lit(UNKNOWN_ORDER))


def order_models(df: DataFrame, groups: Sequence[str] = ()) -> DataFrame:
    """Adds ``position`` (0-based) in the preferred folder order, then by display name."""
    w = Window.partitionBy(*groups).orderBy(sort_order("folder_name"), "display_name", "folder_name")
    return df.withColumn("position", (F.row_number().over(w) - 1).cast("int"))


def add_ranks(df: DataFrame, groups: Sequence[str] = ()) -> DataFrame:
    """Min-method ranks of rmse, mae (ascending) and r2 (descending) per split, and their sums."""
    out = df
    for name, metric, asc in RANK_SPECS:
        w = Window.partitionBy(*groups).orderBy(F.col(metric).asc_nulls_last() if asc else F.col(metric).desc_nulls_last())
        # a run without the metric has no rank
        out = out.withColumn(name, F.when(F.col(metric).isNotNull(), F.rank().over(w).cast("int")))
    out = out.withColumn("rank_sum_validation", F.col("rank_validation_rmse") + F.col("rank_validation_mae") + F.col("rank_validation_r2"))
    return out.withColumn("rank_sum_test", F.col("rank_test_rmse") + F.col("rank_test_mae") + F.col("rank_test_r2"))


def ranking(df: DataFrame, split: str, groups: Sequence[str] = ()) -> DataFrame:
    """Position after sorting by rmse, mae, mape of one split (ties keep the model order)."""
    w = Window.partitionBy(*groups).orderBy(*(F.col(f"{split}_{m}").asc_nulls_last() for m in ("rmse", "mae", "mape")), "position")
    col = "rank_validation" if split == "validation" else f"rank_{split}"
    return df.withColumn(col, F.row_number().over(w).cast("int"))


def best_flags(df: DataFrame, metrics: Sequence[tuple[str, bool]], groups: Sequence[str] = ()) -> DataFrame:
    """``best_<metric>`` = 1 on the single best row per metric (first in model order on ties)."""
    out = df
    for metric, higher in metrics:
        w = Window.partitionBy(*groups).orderBy(F.col(metric).desc_nulls_last() if higher else F.col(metric).asc_nulls_last(), "position")
        out = out.withColumn(f"best_{metric}", ((F.row_number().over(w) == 1) & F.col(metric).isNotNull()).cast("int"))
    return out


def arg_best(df: DataFrame, metric: str, higher: bool, value: str = "display_name", groups: Sequence[str] = ()) -> DataFrame:
    """Row value with the min (or max) metric per group; first in model order on ties; null if no row has the metric."""
    key = F.when(F.col(metric).isNotNull(), F.struct((-F.col(metric) if higher else F.col(metric)).alias("m"), F.col("position").alias("p")))
    return df.groupBy(*groups).agg(F.min_by(F.col(value), key).alias(value), (F.max if higher else F.min)(metric).alias(metric))


def summary(ranked: DataFrame, groups: Sequence[str] = ()) -> DataFrame:
    """Best model by validation RMSE, test RMSE and by each rank sum: one row per criterion."""
    def best(criterion: str, order: list[str], value_col: str) -> DataFrame:
        # nulls last: a missing metric never wins, and a run without the first one is no candidate
        parts = [x for i, c in enumerate(order) for x in (F.col(c).isNull().alias(f"n{i}"), F.col(c).alias(f"k{i}"))]
        key = F.when(F.col(order[0]).isNotNull(), F.struct(*parts, F.col("position").alias("position")))
        return ranked.groupBy(*groups).agg(
            F.lit(criterion).alias("criterion"),
            F.min_by("display_name", key).alias("display_name"),
            F.min_by("folder_name", key).alias("folder_name"),
            F.min_by(F.col(value_col).cast("double"), key).alias("value"),
        )

    parts = [
        best("best_by_validation_rmse", ["validation_rmse", "validation_mae", "validation_mape"], "validation_rmse"),
        best("best_by_test_rmse", ["test_rmse", "test_mae", "test_mape"], "test_rmse"),
        best("best_by_validation_rank_sum", ["rank_sum_validation"], "rank_sum_validation"),
        best("best_by_test_rank_sum", ["rank_sum_test"], "rank_sum_test"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def write_metric_records(metrics: DataFrame, root: str) -> None:
    """One JSON record set per model folder (``folder_name=<name>/part-*.json``)."""
    if "record" not in metrics.columns:
        metrics = metrics.withColumn("record", F.monotonically_increasing_id())
    metrics.write.mode("overwrite").partitionBy("folder_name").json(root)


def collect_metric_records(spark: SparkSession, root: str) -> DataFrame:
    """All folders' records in one frame: the JSON reader merges differing columns (missing -> null).

    The first record of each folder is kept, by its written ``record`` number.
    """
    df = spark.read.json(root)
    w = Window.partitionBy("folder_name").orderBy(F.col("record").asc_nulls_last())
    return df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn", "record")


def collect_metric_csv(spark: SparkSession, root: str, folders: Sequence[str], schema: StructType) -> tuple[DataFrame, list[str]]:
    """The first row of `<root>/<folder>/results/metrics.csv` of every folder, and the folders skipped.

    Files may lack columns of ``schema`` (null then) and have others (left out);
    an absent file or one without a row is skipped. Folders are models: a handful.
    """
    found, skipped = None, []
    for name in folders:
        path = f"{root}/{name}/results/metrics.csv"
        if not path_exists(spark, path):
            skipped.append(name)
            continue
        raw = spark.read.option("header", True).csv(path)
        row = raw.limit(1)
        if row.isEmpty():
            skipped.append(name)
            continue
        own = row.select(F.lit(name).alias("folder_name"), *[F.col(f.name).cast(f.dataType) for f in schema.fields if f.name in raw.columns])
        found = own if found is None else found.unionByName(own, allowMissingColumns=True)
    if found is None:
        found = spark.createDataFrame([], StructType([StructField("folder_name", StringType()), *schema.fields]))
    missing = [F.lit(None).cast(f.dataType).alias(f.name) for f in schema.fields if f.name not in found.columns]
    return found.select("*", *missing), skipped


def skipped_folders(known: DataFrame, collected: DataFrame) -> DataFrame:
    """Known folders without a metric record (anti-join)."""
    return known.join(collected.select("folder_name").distinct(), "folder_name", "left_anti")
