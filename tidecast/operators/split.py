"""Chronological split by distinct time points (no random split: time drives it)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidecast.operators.ranks import kth_values

# Split ratios and the smallest number of time points.
TRAIN_RATIO = 0.70
VAL_RATIO = 0.15
TEST_RATIO = 0.15
MIN_TIME_POINTS = 10


def split_cuts(df: DataFrame, time_col: str, train_ratio: float = TRAIN_RATIO, val_ratio: float = VAL_RATIO,
               test_ratio: float = TEST_RATIO) -> tuple[object, object, int]:
    """(first validation time, first test time, number of distinct times).

    With n distinct sorted times, train takes the first int(n*train) of them and
    validation runs to int(n*(train+val)), in double arithmetic. A cut at the end
    is None (that part is empty).
    """
    if round(train_ratio + val_ratio + test_ratio, 10) != 1.0:
        raise ValueError("the three shares must add up to 1")
    if time_col not in df.columns:
        raise ValueError(f"no column {time_col} to split by")
    n = df.select(time_col).where(F.col(time_col).isNotNull()).distinct().count()
    if n < MIN_TIME_POINTS:
        raise ValueError(f"{n} time points are too few to split; {MIN_TIME_POINTS} are needed")
    k1 = int(n * train_ratio)
    k2 = int(n * (train_ratio + val_ratio))
    vals = kth_values(df, time_col, [k for k in (k1, k2) if k < n])
    return vals.get(k1), vals.get(k2), n


def split_label(time_col: str, cut1, cut2) -> F.Column:
    t = F.col(time_col)
    c1 = F.lit(True) if cut1 is None else (t < F.lit(cut1))
    c2 = F.lit(True) if cut2 is None else (t < F.lit(cut2))
    return F.when(t.isNull(), F.lit(None).cast("string")).when(c1, "train").when(c2, "validation").otherwise("test")


def chronological_split(df: DataFrame, time_col: str, train_ratio: float = TRAIN_RATIO, val_ratio: float = VAL_RATIO,
                        test_ratio: float = TEST_RATIO, name: str = "split") -> DataFrame:
    """Tag every row with train / validation / test; rows without a time are in no part.

    Only two cut values leave the cluster; the fact table is filtered by a plain
    expression, never joined or shuffled.
    """
    cut1, cut2, _ = split_cuts(df, time_col, train_ratio, val_ratio, test_ratio)
    return df.withColumn(name, split_label(time_col, cut1, cut2)).where(F.col(name).isNotNull())


def holdout_split(df: DataFrame, time_col: str, test_ratio: float = 0.2, name: str = "split") -> DataFrame:
    """Two-part variant: the last ``test_ratio`` of the time points are test."""
    cut, _, _n = split_cuts(df, time_col, 1.0 - test_ratio, test_ratio, 0.0)
    t = F.col(time_col)
    lab = F.when(t.isNull(), F.lit(None).cast("string")).when(F.lit(True) if cut is None else t < F.lit(cut), "train").otherwise("test")
    return df.withColumn(name, lab).where(F.col(name).isNotNull())
