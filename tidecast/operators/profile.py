"""Column profile, Pearson correlation (pairwise-complete), high-correlation pairs and the greedy drop list.

The correlation matrix of F columns is computed in ONE pass over the data:
each partition folds its rows into centred moments of every pair of columns
(``moments.py``) and emits F*F rows, which are merged by their means. The data
is never shuffled nor cached; only F*F numbers per partition are. A column that
is constant on the rows of a pair has no correlation there (null).
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidecast.operators.moments import pair_moments

# Features the drop rule prefers to keep (calendar and daylight features).
PREFERRED_FEATURES = {
    "year", "month", "day", "weekday", "is_weekend",
    "sunrise_minutes", "sunset_minutes", "daylight_minutes",
}
# Fixed value: id columns never used as predictors.
ID_COLS = ["date", "start_station_id", "start_station_name", "station_name_final"]
CORR_THRESHOLD = 0.85


def detect_targets(columns: Iterable[str], total: str = "total_rentals", suffix: str = "_count") -> list[str]:
    """Target columns by name: the total or any ``*_count`` column, sorted."""
    return sorted(c for c in columns if c == total or c.endswith(suffix))


def column_counts(df: DataFrame) -> DataFrame:
    """(position, column, n_values): every column with its rows that are not null, from one aggregate over the rows."""
    counts = df.agg(*[F.count(F.col(f"`{c}`")).alias(f"n{i}") for i, c in enumerate(df.columns)])
    rows = [F.struct(F.lit(i).alias("position"), F.lit(c).alias("column"), F.col(f"n{i}").cast("long").alias("n_values")) for i, c in enumerate(df.columns)]
    return counts.select(F.inline(F.array(*rows)))


def numeric_columns(df: DataFrame, exclude: Iterable[str] = (), sort: bool = True) -> list[str]:
    """Numeric columns by schema type minus an exclusion set; sorted or in schema order."""
    ex = set(exclude)
    cols = [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType) and f.name not in ex]
    return sorted(cols) if sort else cols


def numeric_predictors(df: DataFrame) -> list[str]:
    targets = detect_targets(df.columns)
    return numeric_columns(df, set(targets) | set(ID_COLS))


def _long(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(feature, value) rows; the value as text of its own type, so that large whole numbers stay apart. NaN is missing."""
    types = {f.name: f.dataType for f in df.schema.fields}

    def text(c: str) -> Column:
        if isinstance(types[c], T.IntegralType | T.DecimalType):
            return F.col(c).cast("string")
        d = F.col(c).cast("double")
        return F.when(~F.isnan(d), (d + F.lit(0.0)).cast("string"))

    arr = F.array(*[F.struct(F.lit(c).alias("feature"), text(c).alias("value")) for c in cols])
    return df.select(F.inline(arr))


def column_profile(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Per feature: dtype name, missing count, exact distinct count (nulls not counted).

    Two-level aggregation on (feature, value): the first level removes
    duplicates map-side, so a hot value costs one row per partition.
    """
    types = {f.name: f.dataType for f in df.schema.fields}
    per_value = _long(df, cols).groupBy("feature", "value").agg(F.count(F.lit(1)).alias("n"))
    prof = per_value.groupBy("feature").agg(
        F.coalesce(F.sum(F.when(F.col("value").isNull(), F.col("n"))), F.lit(0)).cast("long").alias("missing_values"),
        F.count("value").cast("long").alias("n_unique"),
    )
    integral = [c for c in cols if isinstance(types[c], T.IntegralType)]
    # dtype as the reference's CSV reader reports it: an integer column with a gap becomes float64.
    dtype = (
        F.when(F.col("feature").isin(integral) & (F.col("missing_values") == 0), F.lit("int64"))
        .when(F.col("feature").isin(integral), F.lit("float64"))
        .otherwise(F.lit("float64"))
    )
    if not integral:
        dtype = F.lit("float64")
    return prof.select("feature", dtype.alias("dtype"), "missing_values", "n_unique")


def correlation_long(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Correlation matrix in long form: (feature_1, feature_2, i, j, correlation); null where undefined.

    A pair is undefined if a column is constant on the rows where both are present.
    """
    cols = list(cols)
    m = pair_moments(df, cols)
    back = m.select(F.col("i").alias("j"), F.col("j").alias("i"), F.col("lo").alias("lo_y"), F.col("hi").alias("hi_y"))
    m = m.join(back, ["i", "j"])
    varies = (F.col("n") > 0) & (F.col("lo") < F.col("hi")) & (F.col("lo_y") < F.col("hi_y")) & (F.col("m2x") > 0) & (F.col("m2y") > 0)
    names = F.array(*[F.lit(c) for c in cols])
    r = F.col("c") / (F.sqrt("m2x") * F.sqrt("m2y"))
    return m.select(
        F.element_at(names, F.col("i") + 1).alias("feature_1"), F.element_at(names, F.col("j") + 1).alias("feature_2"), "i", "j",
        F.when(varies, F.greatest(F.lit(-1.0), F.least(F.lit(1.0), r))).alias("correlation"),
    )


def correlation_matrix(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Wide matrix: one row per feature, one column per feature (F is small: schema width)."""
    long = correlation_long(df, cols)
    wide = long.groupBy("feature_1", "i").pivot("feature_2", list(cols)).agg(F.first("correlation"))
    return wide.orderBy("i").drop("i").withColumnRenamed("feature_1", "feature")


def high_corr_pairs(corr_long: DataFrame, threshold: float = CORR_THRESHOLD) -> DataFrame:
    """Upper-triangle pairs (i < j) with |r| >= threshold, strongest first.

    Ties keep the scan order of the matrix (column j, then row i).
    """
    return (
        corr_long.filter((F.col("i") < F.col("j")) & (F.abs("correlation") >= F.lit(threshold)))
        .select("feature_1", "feature_2", F.abs("correlation").alias("abs_correlation"), "correlation", "i", "j")
        .orderBy(F.desc("abs_correlation"), "j", "i")
    )


def target_correlations(df: DataFrame, predictors: Sequence[str], targets: Sequence[str]) -> DataFrame:
    """Correlation of every predictor with every numeric target (pairwise-complete rows)."""
    cols = list(predictors) + [t for t in targets if t not in predictors]
    g = correlation_long(df, cols)
    out = g.filter(F.col("feature_2").isin(list(targets)) & F.col("feature_1").isin(list(predictors)) & (F.col("i") != F.col("j")))
    return out.select(
        F.col("feature_2").alias("target"),
        F.col("feature_1").alias("feature"),
        "correlation",
        F.abs("correlation").alias("abs_correlation"),
    ).orderBy(F.asc("target"), F.desc_nulls_last("abs_correlation"))


def target_scores(target_corr: DataFrame) -> DataFrame:
    """Best absolute target correlation per feature; no value -> 0."""
    return target_corr.groupBy("feature").agg(F.coalesce(F.max("abs_correlation"), F.lit(0.0)).alias("target_score"))


REC_SCHEMA = "drop_feature string, keep_feature string, abs_feature_feature_corr double, drop_feature_target_score double, keep_feature_target_score double, reason string"


def drop_recommendations(pairs: DataFrame, scores: DataFrame, preferred: Iterable[str] = PREFERRED_FEATURES) -> DataFrame:
    """Greedy drop list over pairs, strongest first.

    A pair is skipped when either feature is already dropped. Otherwise a
    preferred feature is kept over a non-preferred one; else the feature with
    the higher target score is kept (ties keep feature_1).

    The pairs of one table are at most F*(F-1)/2 for F feature columns (a bound
    set by the schema, not the data), so they are folded in order inside one
    SQL ``aggregate`` expression.
    """
    pref = F.array(*[F.lit(p) for p in sorted(preferred)])
    s1 = scores.select(F.col("feature").alias("feature_1"), F.col("target_score").alias("s1"))
    s2 = scores.select(F.col("feature").alias("feature_2"), F.col("target_score").alias("s2"))
    p = (
        pairs.join(F.broadcast(s1), "feature_1", "left")
        .join(F.broadcast(s2), "feature_2", "left")
        .select(
            F.struct(
                (-F.col("abs_correlation")).alias("o1"),
                F.col("j").alias("o2"), F.col("i").alias("o3"),
                "feature_1", "feature_2", "abs_correlation",
                F.coalesce("s1", F.lit(0.0)).alias("s1"), F.coalesce("s2", F.lit(0.0)).alias("s2"),
            ).alias("p")
        )
    )
    folded = p.agg(F.sort_array(F.collect_list("p")).alias("ps")).select(
        F.aggregate(
            "ps",
            F.struct(
                F.array().cast("array<string>").alias("dropped"),
                F.array().cast(f"array<struct<{REC_SCHEMA.replace(' string', ':string').replace(' double', ':double')}>>").alias("recs"),
            ),
            lambda acc, x: _fold_step(acc, x, pref),
        ).alias("state")
    )
    return folded.select(F.inline(F.col("state.recs")))


def _fold_step(acc: Column, x: Column, pref: Column) -> Column:
    f1, f2 = x["feature_1"], x["feature_2"]
    p1, p2 = F.array_contains(pref, f1), F.array_contains(pref, f2)
    skip = F.array_contains(acc["dropped"], f1) | F.array_contains(acc["dropped"], f2)
    # Scores equal to 12 digits count as a tie (keeps feature_1): two columns that
    # are exact linear copies get scores that differ only by rounding noise.
    keep_first = F.when(p1 & ~p2, True).when(p2 & ~p1, False).otherwise(F.round(x["s1"], 12) >= F.round(x["s2"], 12))
    reason = F.when(p1 != p2, F.lit("kept preferred feature")).otherwise(F.lit("kept feature with stronger target correlation"))
    drop_f = F.when(keep_first, f2).otherwise(f1)
    keep_f = F.when(keep_first, f1).otherwise(f2)
    rec = F.struct(
        drop_f.alias("drop_feature"),
        keep_f.alias("keep_feature"),
        x["abs_correlation"].alias("abs_feature_feature_corr"),
        F.when(keep_first, x["s2"]).otherwise(x["s1"]).alias("drop_feature_target_score"),
        F.when(keep_first, x["s1"]).otherwise(x["s2"]).alias("keep_feature_target_score"),
        reason.alias("reason"),
    )
    return F.when(skip, acc).otherwise(
        F.struct(
            F.array_append(acc["dropped"], drop_f).alias("dropped"),
            F.array_append(acc["recs"], rec).alias("recs"),
        )
    )
