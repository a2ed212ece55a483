"""Trees of an ensemble as flat arrays, and one vectorised pass that scores them all.

The nodes of all trees stand in a row; a node has a feature (-1 for a leaf), a
threshold, its left child (the right one follows it), the mean label of its rows,
the squared error its split saves and the number of its rows. Rows of a batch walk
through all trees together: a step moves every pair of row and tree that is not at a
leaf yet. Since every node holds its mean, the same walk also answers for the trees
cut off at a smaller depth, and partial sums along the trees answer for ensembles of
fewer of them.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidecast.session import written_table

PAIRS_AT_ONCE = 1 << 20
#: nodes of a tree that rows are moved through split by split, at most, and how many rows together
FEW_NODES = 128
ROWS_AT_ONCE = 1 << 14
#: bytes of trees that one scoring pass sends to the executors; more trees take more passes
BLOCK_BYTES = 256 << 20


@dataclass(frozen=True)
class Trees:
    """``total`` sums the trees' values (boosting), else they are averaged; ``base`` is added."""

    features: tuple[str, ...]
    start: np.ndarray
    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    value: np.ndarray
    gain: np.ndarray
    rows: np.ndarray
    base: float = 0.0
    total: bool = False

    @property
    def n_trees(self) -> int:
        return len(self.start) - 1

    @property
    def nbytes(self) -> int:
        return sum(a.nbytes for a in (self.feature, self.threshold, self.left, self.value, self.gain, self.rows))

    def some(self, first: int, last: int) -> Trees:
        """The trees ``first`` to ``last`` (not included)."""
        a, z = self.start[first], self.start[last]
        cut = [x[a:z] for x in (self.feature, self.threshold, self.left, self.value, self.gain, self.rows)]
        return Trees(self.features, self.start[first : last + 1] - a, cut[0], cut[1], cut[2] - a.astype(cut[2].dtype), *cut[3:], self.base, self.total)

    def depths(self) -> np.ndarray:
        out, own, d = np.zeros(len(self.feature), np.int32), self.start[:-1], 0
        while len(own):
            out[own] = d
            kids = self.left[own[self.feature[own] >= 0]]
            own, d = np.concatenate([kids, kids + 1]), d + 1
        return out

    def shape(self, depth: int | None = None) -> tuple[int, int]:
        """(depth, leaves) of all trees together, cut off at ``depth``."""
        at = self.depths()
        limit = int(at.max()) if depth is None else min(depth, int(at.max()))
        return limit, int(((self.feature < 0) & (at < limit) | (at == limit)).sum())

    def importances(self, n_trees: int | None = None, depth: int | None = None) -> list[tuple[str, float]]:
        """Share of the saved error by feature: each tree's shares sum to 1, and the ensemble's are their mean."""
        n = self.n_trees if n_trees is None else min(n_trees, self.n_trees)
        tree = np.repeat(np.arange(self.n_trees), np.diff(self.start))
        use = (self.feature >= 0) & (tree < n) & (True if depth is None else self.depths() < depth)
        saved = np.zeros((n, len(self.features)))
        np.add.at(saved, (tree[use], self.feature[use]), self.gain[use])
        sums = saved.sum(axis=1, keepdims=True)
        share = np.divide(saved, sums, out=np.zeros_like(saved), where=sums > 0)
        whole = share.mean(axis=0)
        whole = whole / whole.sum() if whole.sum() else whole
        return [(f, float(v)) for f, v in zip(self.features, whole)]


def walk(trees: Trees, x: np.ndarray, depths: Sequence[int] = ()) -> dict[int | None, np.ndarray]:
    """For every row and tree the node that the row reaches (under None), and the one it has reached after each of ``depths`` steps."""
    n, k = len(x), trees.n_trees
    node = np.tile(trees.start[:-1].astype(np.int32), n)
    active, flat, width = np.arange(n * k, dtype=np.int64), np.ascontiguousarray(x).ravel(), x.shape[1]
    out: dict[int | None, np.ndarray] = {}
    step = 0
    while True:
        if step in depths:
            out[step] = node.reshape(n, k).copy()
        own = trees.feature[node[active]]
        going = own >= 0
        active, own = active[going], own[going]
        if not len(active):
            break
        at = node[active]
        node[active] = trees.left[at] + (flat[active // k * width + own] > trees.threshold[at])
        step += 1
    out[None] = node.reshape(n, k)
    return {d: out.get(d, out[None]) for d in (None, *depths)}


def reached(trees: Trees, t: int, columns: Sequence[np.ndarray]) -> np.ndarray:
    """The node of tree ``t``, counted from its root, that every row reaches; ``columns`` are the features.

    A split moves the rows that stand at it, in a few passes over bytes. Trees of at most ``FEW_NODES`` nodes, children after their parents.
    """
    a, z = trees.start[t], trees.start[t + 1]
    places = zip(trees.feature[a:z].tolist(), trees.threshold[a:z].tolist(), (trees.left[a:z] - a).tolist())
    node = np.zeros(len(columns[0]), np.uint8)
    above, here = np.empty(node.shape, bool), np.empty(node.shape, bool)
    step, stay = above.view(np.uint8), here.view(np.uint8)
    for k, (f, cut, left) in enumerate(places):
        if f >= 0:
            np.greater(columns[f], cut, out=above)
            np.equal(node, k, out=here)
            np.add(step, left - k, out=step)
            np.multiply(step, stay, out=step)
            np.add(node, step, out=node)
    return node


def told(trees: Trees, columns: Sequence[np.ndarray], counts: Sequence[int] = ()) -> np.ndarray:
    """(len(counts), rows): sums of the values of the first trees, or of all of them without ``counts``."""
    counts = list(counts) or [trees.n_trees]
    out, total = np.zeros((len(counts), len(columns[0]))), np.zeros(len(columns[0]))
    for t in range(max(counts)):
        total += trees.value[trees.start[t] : trees.start[t + 1]].take(reached(trees, t, columns))
        for j, n in enumerate(counts):
            if n == t + 1:
                out[j] = total
    return out


Plan = tuple[int | None, int | None]


def partial_sums(trees: Trees, x: np.ndarray, plans: Sequence[Plan], first: int = 0) -> np.ndarray:
    """(rows, plans): sums of the trees' values for plans (number of trees, depth); ``first`` is the place of these trees in the ensemble."""
    out = np.zeros((len(x), len(plans)))
    if trees.n_trees and np.diff(trees.start).max() <= FEW_NODES and all(d is None for _, d in plans) and bool((trees.left < 0).all() or (trees.left[trees.left >= 0] > np.flatnonzero(trees.left >= 0)).all()):
        counts = [trees.n_trees if n is None else min(max(n - first, 0), trees.n_trees) for n, _ in plans]
        for a in range(0, len(x), ROWS_AT_ONCE):
            out[a : a + ROWS_AT_ONCE] = told(trees, np.ascontiguousarray(x[a : a + ROWS_AT_ONCE].T), counts).T
        return out
    limits = sorted({d for _, d in plans if d is not None})
    size = max(1, PAIRS_AT_ONCE // max(1, trees.n_trees))
    for a in range(0, len(x), size):
        reached = walk(trees, x[a : a + size], limits)
        values = {d: trees.value[node] for d, node in reached.items()}
        for j, (n, depth) in enumerate(plans):
            take = trees.n_trees if n is None else min(max(n - first, 0), trees.n_trees)
            out[a : a + size, j] = values[depth][:, :take].sum(axis=1)
    return out


def matrix(columns: Sequence[pd.Series | np.ndarray], names: Sequence[str]) -> np.ndarray:
    """Columns as a matrix of doubles; a missing value is an error."""
    x = np.column_stack([np.asarray(c, np.float64) for c in columns]) if columns else np.zeros((0, 0))
    gaps = np.isnan(x).any(axis=0)
    if gaps.any():
        raise ValueError(f"missing values in {', '.join(n for n, g in zip(names, gaps) if g)}: fill or drop them first")
    return x


def with_predictions(df: DataFrame, trees: Trees, columns: Sequence[str], plans: Sequence[Plan] = ((None, None),), out: str = "predictions", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``df`` with the array ``out``: a prediction for each plan.

    Ensembles of more than ``block_bytes`` are scored block by block; sums are written in between, so a worker holds one block.
    """
    spark, plans = df.sparkSession, list(plans)
    blocks, first = [], 0
    sizes = np.diff(trees.start) * (trees.nbytes / max(1, len(trees.feature)))
    while first < trees.n_trees:
        last = first + max(1, int(np.searchsorted(np.cumsum(sizes[first:]), block_bytes, side="right")))
        blocks.append((first, last))
        first = last
    names = list(columns)
    for i, (a, z) in enumerate(blocks):
        own = _block_sums(spark.sparkContext.broadcast(trees.some(a, z)), a, names, plans, i > 0)
        df = df.withColumn(out, own(*([F.col(out)] if i else []), *(F.col(f"`{c}`").cast("double") for c in names)))
        if len(blocks) > 1 and i + 1 < len(blocks):
            df = written_table(df, "tree-sums")[0]
    n = F.array(*(F.lit(float(trees.n_trees if k is None else min(k, trees.n_trees))) for k, _ in plans))
    whole = F.col(out) if trees.total else F.zip_with(out, n, lambda s, k: s / k)
    return df.withColumn(out, F.transform(whole, lambda v: v + F.lit(trees.base)))


def _block_sums(sent, first: int, names: list[str], plans: list[Plan], more: bool):
    """Sums of one block's trees, added to those of earlier blocks, which come first if there are ``more``."""

    @F.pandas_udf("array<double>")
    def sums(*args: pd.Series) -> pd.Series:
        own = partial_sums(sent.value, matrix(args[more:], names), plans, first) if len(args[0]) else np.zeros((0, len(plans)))
        return pd.Series(list(own + np.vstack(args[0].to_numpy()) if more and len(own) else own), dtype=object)

    return sums
