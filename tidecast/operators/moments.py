"""Pairwise-complete centred moments of numeric columns, mergeable and stable.

Each Arrow batch gives, for every ordered pair of columns, the count, means,
centred sums of squares and the centred cross sum over the rows where both are
present. Batches and partitions are merged by the usual update for means and
centred sums, never by differences of large raw sums, so a column far from zero
or one wild value costs no digits. One pass; nothing is cached.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SCHEMA = "i int, j int, rows long, n double, mx double, my double, m2x double, m2y double, c double, lo double, hi double"

#: columns, at most, whose pairs one scan takes together
BLOCK = 128
#: centred sums below this share of the squared offset have lost digits and are taken again, pair by pair
LOST_DIGITS = 1e-4


def _batch(x: np.ndarray) -> dict[str, np.ndarray]:
    """Moments of one batch; arrays [i, j] are over rows where columns i and j are present."""
    present = ~np.isnan(x)
    k = x.shape[1]
    shift = np.array([np.median(x[present[:, i], i]) if present[:, i].any() else 0.0 for i in range(k)])
    z = np.where(present, x - shift, 0.0)
    m = present.astype(np.float64)
    n = m.T @ m
    some = np.maximum(n, 1.0)
    sx = z.T @ m
    mean = sx / some
    raw = (z * z).T @ m
    m2 = raw - sx * mean
    c = z.T @ z - sx * (sx.T / some)
    lo, hi = np.full((k, k), np.inf), np.full((k, k), -np.inf)
    for j in range(k):
        rows = present[:, j]
        if rows.any():
            lo[:, j] = np.where(present[rows], x[rows], np.inf).min(axis=0)
            hi[:, j] = np.where(present[rows], x[rows], -np.inf).max(axis=0)
    bad = (n > 0) & (m2 < LOST_DIGITS * raw)
    for i, j in zip(*np.nonzero(bad | bad.T)):
        rows = present[:, i] & present[:, j]
        a, b = x[rows, i] - x[rows, i][0], x[rows, j] - x[rows, j][0]
        mean[i, j] = x[rows, i][0] - shift[i] + a.mean()
        a, b = a - a.mean(), b - b.mean()
        m2[i, j], c[i, j] = float(a @ a), float(a @ b)
    return {"n": n, "mean": np.where(n > 0, mean + shift[:, None], 0.0), "m2": np.maximum(m2, 0.0), "c": c, "lo": lo, "hi": hi}


def _merge(a: dict, b: dict) -> dict:
    n = a["n"] + b["n"]
    some = np.maximum(n, 1.0)
    delta = np.where((a["n"] > 0) & (b["n"] > 0), b["mean"] - a["mean"], 0.0)
    w = a["n"] * b["n"] / some
    mean = np.where(a["n"] == 0, b["mean"], a["mean"] + delta * b["n"] / some)
    return {
        "n": n, "mean": mean, "m2": a["m2"] + b["m2"] + delta * delta * w, "c": a["c"] + b["c"] + delta * delta.T * w,
        "lo": np.minimum(a["lo"], b["lo"]), "hi": np.maximum(a["hi"], b["hi"]),
    }


def _partition(width: int, left: int | None):
    """Folds a partition's rows by bucket (the first column); with ``left`` only pairs of one of the first ``left`` columns and one of the others."""
    ii, jj = (x.ravel() for x in np.meshgrid(np.arange(width), np.arange(width), indexing="ij"))
    tell = np.ones(width * width, bool) if left is None else (ii < left) != (jj < left)

    def fn(batches):
        totals: dict[int, tuple[dict, int]] = {}
        for pdf in batches:
            x = pdf.iloc[:, 1:].to_numpy(dtype=np.float64, na_value=np.nan)
            buckets = pdf.iloc[:, 0].to_numpy()
            for b in np.unique(buckets):
                own = x[buckets == b]
                one = _batch(own)
                total, rows = totals.get(int(b), (None, 0))
                totals[int(b)] = (one if total is None else _merge(total, one)), rows + len(own)
        for b, (t, rows) in totals.items():
            values = {"n": t["n"], "mx": t["mean"], "my": t["mean"].T, "m2x": t["m2"], "m2y": t["m2"].T, "c": t["c"], "lo": t["lo"], "hi": t["hi"]}
            out = {"bucket": np.full(int(tell.sum()), b, np.int32), "i": ii[tell].astype(np.int32), "j": jj[tell].astype(np.int32), "rows": np.full(int(tell.sum()), rows, np.int64)}
            yield pd.DataFrame(out | {k: v.ravel()[tell] for k, v in values.items()})

    return fn


def _told(df: DataFrame, cols: Sequence[str], bucket, left: int | None = None) -> DataFrame:
    own = df.select(bucket.cast("int").alias("bucket"), *[F.col(f"`{c}`").cast("double").alias(f"x{k}") for k, c in enumerate(cols)])
    return own.where("bucket IS NOT NULL").mapInPandas(_partition(len(cols), left), f"bucket int, {SCHEMA}")


def pair_moments(df: DataFrame, cols: Sequence[str], bucket=None, block: int = BLOCK) -> DataFrame:
    """(bucket, i, j, rows, n, mx, my, m2x, m2y, c, lo, hi) for every ordered pair of ``cols``.

    ``rows`` counts all rows, ``n`` those where both columns are present (neither
    null nor NaN); ``lo`` and ``hi`` are the bounds of column i over the latter.
    With an integer column ``bucket`` the moments are those of each bucket (rows
    without one don't count), else of bucket 0. More than ``block`` columns are taken
    by pairs of column blocks, each a scan of its own columns alone, so that a
    partition holds the square of a block and not of all columns.
    """
    cols, bucket = list(cols), F.lit(0) if bucket is None else bucket
    if len(cols) <= block:
        parts = _told(df, cols, bucket)
    else:
        parts = None
        firsts = range(0, len(cols), block)
        for a in firsts:
            for b in firsts:
                if b < a:
                    continue
                left = cols[a : a + block]
                own = _told(df, left, bucket) if a == b else _told(df, left + cols[b : b + block], bucket, len(left))
                number = lambda c: F.when(F.col(c) < len(left), F.col(c) + a).otherwise(F.col(c) + b - len(left)).cast("int").alias(c)  # noqa: B023,E731
                own = own.select("bucket", number("i"), number("j"), "rows", "n", "mx", "my", "m2x", "m2y", "c", "lo", "hi")
                parts = own if parts is None else parts.unionAll(own)
    pair = Window.partitionBy("bucket", "i", "j")  # one row for each partition of the input
    some = F.greatest(F.sum("n").over(pair), F.lit(1.0))
    held = F.col("n") > 0
    shifted = parts.withColumn("bx", F.coalesce(F.min(F.when(held, F.col("mx"))).over(pair), F.lit(0.0)))
    shifted = shifted.withColumn("by", F.coalesce(F.min(F.when(held, F.col("my"))).over(pair), F.lit(0.0)))
    shifted = shifted.withColumn("dx", F.col("mx") - F.col("bx")).withColumn("dy", F.col("my") - F.col("by"))
    shifted = shifted.withColumn("gx", F.sum(F.col("dx") * F.col("n")).over(pair) / some).withColumn("gy", F.sum(F.col("dy") * F.col("n")).over(pair) / some)
    ex, ey = F.col("dx") - F.col("gx"), F.col("dy") - F.col("gy")
    n = F.col("n")
    return shifted.groupBy("bucket", "i", "j").agg(
        F.sum("rows").alias("rows"), F.sum("n").alias("n"), F.first(F.col("bx") + F.col("gx")).alias("mx"), F.first(F.col("by") + F.col("gy")).alias("my"),
        F.sum(F.col("m2x") + n * ex * ex).alias("m2x"), F.sum(F.col("m2y") + n * ey * ey).alias("m2y"), F.sum(F.col("c") + n * ex * ey).alias("c"),
        F.min("lo").alias("lo"), F.max("hi").alias("hi"),
    )
