"""Regression metrics per group (model, split, ...) and chart data, all as grouped aggregates.

Metrics of many models and splits are computed in ONE grouped aggregate over
a long prediction table, not one job per model. The exact median absolute
error avoids ``percentile`` (which buffers a whole group in one task): a sketch
brackets it, and only the counted values inside the bracket are sorted.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidecast.session import written_table

METRIC_NAMES = ["mae", "rmse", "r2", "median_ae", "explained_variance", "mape"]


def _ratio_or_flag(num: Column, den: Column) -> Column:
    """1 - num/den; when den is 0 the score is 1 for a perfect fit and 0 otherwise."""
    return F.when(den == 0, F.when(num == 0, F.lit(1.0)).otherwise(F.lit(0.0))).otherwise(1 - num / den)


#: the bracket around a quantile, and the sketch that finds it (its rank error, 1 in SKETCH rows, is far inside)
BRACKET, SKETCH, WHOLE = 0.01, 1000, 1000
#: distinct values of a group, about and at most, that are sorted in the end, and the parts a round cuts a bracket into
LAST, PARTS = 10_000, 64


def _group_match(groups: Sequence[str], prefix: str) -> Column:
    same = F.lit(True)
    for i, c in enumerate(groups):
        same = same & F.col(c).eqNullSafe(F.col(f"{prefix}{i}"))
    return same


def _joined(df: DataFrame, one_a_group: DataFrame, groups: Sequence[str], prefix: str) -> DataFrame:
    """``df`` with the columns of a table of one row per group, whose keys are named ``prefix`` and a number."""
    return df.join(one_a_group, _group_match(groups, prefix)) if groups else df.crossJoin(F.broadcast(one_a_group))


def _ranks(q: float) -> tuple[Column, Column, Column]:
    """Places (from 0) of the two values that a quantile of ``_n`` rows lies between, and the share of the second."""
    h = (F.col("_n") - 1) * F.lit(q)
    return F.floor(h), F.ceil(h), h - F.floor(h)


def narrowed(held: DataFrame, groups: Sequence[str], q: float) -> DataFrame:
    """One round: cut each group's distinct values into ``PARTS``, count the parts and keep those that hold the quantile's two ranks.

    ``held`` has (groups, _k, _c, _n): distinct values with counts; the row with a null
    value counts what lies below. Only counts of parts meet in a group.
    """
    g = list(groups)
    keys = lambda prefix: [F.col(c).alias(f"{prefix}{i}") for i, c in enumerate(g)]
    probs = F.array(*(F.lit(i / PARTS) for i in range(1, PARTS)))
    cuts = held.where("_k IS NOT NULL").groupBy(*g).agg(F.percentile_approx("_k", probs, SKETCH).alias("_cuts"))
    placed = _joined(held, cuts.select(*keys("_q"), "_cuts"), g, "_q")
    part = F.when(F.col("_k").isNull(), -1).otherwise(F.size(F.filter("_cuts", lambda c: c < F.col("_k"))))
    placed = placed.select(*g, "_k", "_c", "_n", part.alias("_part"))
    parts = placed.groupBy(*g, "_part").agg(F.sum("_c").alias("_c"), F.first("_n").alias("_n"))
    along = Window.partitionBy(*g).orderBy("_part")  # PARTS + 1 rows a group
    parts = parts.withColumn("_upto", F.sum("_c").over(along))
    lo, hi, _ = _ranks(q)
    before = F.col("_upto") - F.col("_c")
    wanted = (F.col("_part") >= 0) & (before <= hi) & (F.col("_upto") > lo)
    kept = parts.where(wanted).groupBy(*g).agg(F.min("_part").alias("_first"), F.max("_part").alias("_last"))
    placed = _joined(placed, kept.select(*keys("_r"), "_first", "_last"), g, "_r").where(F.col("_part") <= F.col("_last"))
    value = F.when(F.col("_part") >= F.col("_first"), F.col("_k"))
    return placed.groupBy(*g, value.alias("_k")).agg(F.sum("_c").alias("_c"), F.first("_n").alias("_n"))


def exact_quantile(df: DataFrame, groups: Sequence[str], value: Column, q: float, name: str, last: int = LAST) -> DataFrame:
    """Exact linear-interpolated quantile of ``value`` per group (numpy's default rule).

    A mergeable sketch brackets the quantile; rows below the bracket are only
    counted, and equal values inside it are counted together, all map-side. While a
    group's bracket holds more than ``last`` distinct values it is narrowed by a round
    of counts, so that no group is sorted in one task beyond that bound. Groups of
    fewer than ``WHOLE`` rows are their own bracket. Null values don't count; a group
    without any has no row.
    """
    g = list(groups)
    keys = [F.col(c).alias(f"_g{i}") for i, c in enumerate(g)]
    v = df.select(*g, value.cast("double").alias("_v")).where(F.col("_v").isNotNull())
    ends = [F.lit(max(0.0, q - BRACKET)), F.lit(min(1.0, q + BRACKET))]
    around = v.groupBy(*g).agg(F.count(F.lit(1)).alias("_n"), F.min("_v").alias("_min"), F.max("_v").alias("_max"), F.percentile_approx("_v", F.array(*ends), SKETCH).alias("_p"))
    small = F.col("_n") < WHOLE
    around = around.select(*keys, "_n", F.when(small, F.col("_min")).otherwise(F.col("_p")[0]).alias("_from"), F.when(small, F.col("_max")).otherwise(F.col("_p")[1]).alias("_to"))
    # one row per group on the right: the planner broadcasts it when it turns out small
    met = _joined(v, around, g, "_g")
    inside = met.where(F.col("_v") <= F.col("_to")).withColumn("_k", F.when(F.col("_v") >= F.col("_from"), F.col("_v")))
    held = inside.groupBy(*g, "_k").agg(F.count(F.lit(1)).alias("_c"), F.first("_n").alias("_n"))
    held = written_table(held, "quantile-bracket")[0]
    while True:
        most = held.where("_k IS NOT NULL").groupBy(*g).count().agg(F.max("count")).first()[0] or 0
        if most <= last:
            break
        held = written_table(narrowed(held, g, q), "quantile-bracket")[0]
    upto = F.sum("_c").over(Window.partitionBy(*g).orderBy(F.col("_k").asc_nulls_first()))
    lo, hi, frac = _ranks(q)
    picked = held.withColumn("_upto", upto).groupBy(*g).agg(
        F.coalesce(F.max(F.when(F.col("_k").isNull(), F.col("_upto"))), F.lit(0)).alias("_below"),
        F.min(F.when(F.col("_upto") > lo, F.col("_k"))).alias("_lo"),
        F.min(F.when(F.col("_upto") > hi, F.col("_k"))).alias("_hi"),
        F.first(lo).alias("_at"),
        F.first(frac).alias("_frac"),
    )
    right = (F.col("_below") <= F.col("_at")) & F.col("_hi").isNotNull()
    exact = F.col("_lo") + (F.col("_hi") - F.col("_lo")) * F.col("_frac")
    return picked.select(*g, F.when(right, exact).otherwise(F.raise_error(F.lit("the bracket missed the quantile"))).alias(name))


def regression_metrics(pred: DataFrame, groups: Sequence[str], label: str = "total_rentals", prediction: str = "prediction") -> DataFrame:
    """mae, rmse, r2, median_ae, explained_variance, mape per group.

    MAPE is a fraction over rows with a non-zero label (null when there is none).
    """
    g = list(groups)
    y, p = F.col(label).cast("double"), F.col(prediction).cast("double")
    e = y - p
    agg = pred.groupBy(*g).agg(
        F.avg(F.abs(e)).alias("mae"),
        F.sqrt(F.avg(e * e)).alias("rmse"),
        F.sum(e * e).alias("_sse"),
        (F.var_pop(y) * F.count(F.lit(1))).alias("_sst"),
        F.var_pop(e).alias("_vare"),
        F.var_pop(y).alias("_vary"),
        F.avg(F.when(y != 0, F.abs(e) / F.abs(y))).alias("mape"),
    )
    med = exact_quantile(pred, g, F.abs(e), 0.5, "median_ae")
    out = agg.join(med, g, "left")
    return out.select(
        *g, "mae", "rmse",
        _ratio_or_flag(F.col("_sse"), F.col("_sst")).alias("r2"),
        "median_ae",
        _ratio_or_flag(F.col("_vare"), F.col("_vary")).alias("explained_variance"),
        "mape",
    )


def metrics_wide(long_metrics: DataFrame, key: Sequence[str], splits: Sequence[str] = ("train", "validation", "test")) -> DataFrame:
    """One row per key with ``{split}_{metric}`` columns (fixed split list, so a fixed schema)."""
    cols = [
        F.first(F.when(F.col("split") == s, F.col(m)), ignorenulls=True).alias(f"{s}_{m}")
        for s in splits for m in METRIC_NAMES
    ]
    return long_metrics.groupBy(*key).agg(*cols)


def error_over_time(pred: DataFrame, time_col: str, split: str = "test", groups: Sequence[str] = ()) -> DataFrame:
    """Mean absolute residual per time point of one split."""
    return (
        pred.where(F.col("split") == split)
        .groupBy(*groups, time_col)
        .agg(F.avg(F.abs("residual")).alias("mean_absolute_error"))
    )


def prediction_bounds(pred: DataFrame, label: str, split: str = "test", groups: Sequence[str] = ()) -> DataFrame:
    """Common axis bounds of actual and predicted values."""
    return (
        pred.where(F.col("split") == split)
        .groupBy(*groups)
        .agg(
            F.least(F.min(label).cast("double"), F.min("prediction")).alias("min_val"),
            F.greatest(F.max(label).cast("double"), F.max("prediction")).alias("max_val"),
        )
    )


def residual_histogram(pred: DataFrame, bins: int = 30, split: str = "test", groups: Sequence[str] = ()) -> DataFrame:
    """Equal-width histogram of residuals (last bin closed), empty bins kept with count 0."""
    g = list(groups)
    t = pred.where(F.col("split") == split)
    rng = t.groupBy(*g).agg(F.min("residual").alias("lo"), F.max("residual").alias("hi"))
    width = (F.col("hi") - F.col("lo")) / bins
    b = F.when(F.col("hi") == F.col("lo"), F.lit(bins // 2)).otherwise(
        F.least(F.floor((F.col("residual") - F.col("lo")) / width), F.lit(bins - 1))
    ).cast("int")
    counts = t.join(rng, g) if g else t.crossJoin(F.broadcast(rng))
    counts = counts.groupBy(*g, b.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    # All bins of every group (bins rows per group) so empty bins appear with 0.
    all_bins = rng.select(*g, "lo", "hi", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    edges = all_bins.select(
        *g, "bin",
        F.when(F.col("hi") == F.col("lo"), F.col("lo") - 0.5 + F.col("bin") / F.lit(bins))
        .otherwise(F.col("lo") + F.col("bin") * (F.col("hi") - F.col("lo")) / bins).alias("bin_start"),
        F.when(F.col("hi") == F.col("lo"), F.col("lo") - 0.5 + (F.col("bin") + 1) / F.lit(bins))
        .otherwise(F.col("lo") + (F.col("bin") + 1) * (F.col("hi") - F.col("lo")) / bins).alias("bin_end"),
    )
    return edges.join(counts, [*g, "bin"], "left").select(
        *g, "bin", "bin_start", "bin_end", F.coalesce(F.col("n"), F.lit(0)).cast("long").alias("count")
    )
