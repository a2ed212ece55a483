"""Regression trees grown on Spark: one exact tree, and forests of histogram trees.

Both grow from the top by passes over all rows and finish below in tasks. While a
node holds more than ``local_rows`` rows, its split comes from grouped aggregates:

* exact tree: a pass folds the rows into bins by (node, feature, range of values). The
  bins' ends are thresholds; what any threshold inside of a bin can reach is bounded by
  the bin's rows and its least and largest label. Only of the bins whose bound is not
  below the node's best end, a second pass counts the rows by value. All thresholds count.
* forest: features are cut into at most ``bins`` quantile bins once. A pass walks the
  rows down all trees grown so far (Poisson weights by a hash of row and tree) and
  folds histograms by (node, feature, bin) in Arrow batches. Only the smaller of two
  siblings is folded; the other is the parent's histogram less that one.

A node of at most ``local_rows`` rows is finished in one task, level by level over
many of its nodes at once; rows stand in the order of their nodes, weights and weighted
labels in one array. Large nodes count their codes, small ones sort them. Feature subsets hang on a key that goes down from the seed
along the path, and a split does not depend on the depth limit; so where growth moves
into tasks changes no tree, and a tree cut off at depth d is the tree grown with that
limit.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidecast.operators import stored_forest as SF
from tidecast.operators.joins import sized_broadcast
from tidecast.operators.tree_arrays import FEW_NODES, Trees, matrix, reached, walk
from tidecast.session import scratch_path, written_table

LOCAL_ROWS = 1 << 17
BINS = 256
#: ranges of values of a feature that a pass of the exact tree folds, and bins of all open nodes together
BINS_OF_VALUES = 1024
BINS_AT_ONCE = 1 << 21
#: rows of a forest's node that one task finishes, at most: some 150 bytes each
FOREST_ROWS = 1 << 20
#: rows whose levels a task grows together
RUN_ROWS = 1 << 17
#: rows that a task deals to the trees together
DEALT_ROWS = 1 << 16
SEED = 42
_U = np.uint64


# ---------------------------------------------------------------- keys, subsets, weights


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (public splitmix constants)."""
    x = np.atleast_1d(np.asarray(x, np.uint64))  # arrays wrap around without a warning
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def root_keys(seed: int, trees: np.ndarray) -> np.ndarray:
    return mix(np.asarray(trees, np.uint64) * _U(0x9E3779B97F4A7C15) + _U(seed))


def child_keys(keys: np.ndarray) -> np.ndarray:
    """Keys of the left and right children, one pair after the other."""
    two = keys * _U(2)
    return mix(np.column_stack([two + _U(1), two + _U(2)]).ravel())


def feature_order(keys: np.ndarray, n: int) -> np.ndarray:
    """(nodes, n): the features in each node's own random order."""
    drawn = mix(keys[:, None] ^ mix(np.arange(1, n + 1, dtype=np.uint64))[None, :])
    low = _U((1 << max(n - 1, 1).bit_length()) - 1)  # the last bits tell the feature, so that sorted numbers are the order
    return (np.sort((drawn & ~low) | np.arange(n, dtype=np.uint64), axis=1) & low).astype(np.int64)


# Chances of 0, 1, 2, ... draws of a row in a bootstrap sample (Poisson with mean 1), summed, as 64-bit integers.
_POISSON = (np.cumsum([np.exp(-1) / np.prod(np.arange(1.0, k + 1)) for k in range(12)]) * float(1 << 53)).astype(np.uint64) << _U(11)


def poisson(row_key: np.ndarray, tree_key: int) -> np.ndarray:
    """How often each row stands in a tree's bootstrap sample."""
    drawn = mix(row_key ^ mix(np.array([tree_key], np.uint64) + _U(1)))
    out = np.zeros(len(drawn), np.uint8)
    for k in range(4):
        out += (drawn >= _POISSON[k]).view(np.uint8)
    many = np.flatnonzero(out == 4)  # two rows of a hundred
    out[many] = np.searchsorted(_POISSON, drawn[many], side="right")
    return out


# ---------------------------------------------------------------- growth inside a task


_GROWN = {"feature": np.int16, "cut": np.int32, "above": np.int32, "left": np.int32, "value": np.float64, "gain": np.float32, "rows": np.int32}


def _in_order(key: np.ndarray, place: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Stable order of non-negative keys, and the sorted keys; key and ``place`` (0, 1, ... of at most ``bits`` bits) are sorted as one number where 63 bits hold both."""
    need = int(key.max()).bit_length() + bits
    if need > 63:
        order = np.argsort(key, kind="stable")
        return order, key[order]
    both = ((key << bits) | place).astype(np.uint32 if need <= 32 else np.int64, copy=False)
    both.sort()
    return (both & ((1 << bits) - 1)).astype(np.intp, copy=False), both >> bits


@dataclass
class _Rows:
    """Rows that a task grows on, one node's after the other's: codes (rows, stride); labels; weights, with weighted labels as imaginary parts (one sum adds up both); 0, 1, ..."""

    codes: np.ndarray
    labels: np.ndarray
    weighted: np.ndarray
    place: np.ndarray

    def some(self, rows: np.ndarray) -> _Rows:
        whole = self.codes.dtype == np.uint8 and self.codes.shape[1] == 8  # a row of bytes is taken as one number
        codes = self.codes.view(np.uint64)[:, 0].take(rows)[:, None].view(np.uint8) if whole else self.codes.take(rows, axis=0)
        return _Rows(codes, self.labels.take(rows), self.weighted.take(rows), self.place[: len(rows)])

    def of(self, feature: np.ndarray, sizes: np.ndarray, rows: np.ndarray | None = None) -> np.ndarray:
        """Every row's code of its node's feature, for all rows or some."""
        at = (self.place if rows is None else rows) * self.codes.shape[1]
        at += np.repeat(feature, sizes)
        return self.codes.reshape(-1).take(at)


def grow(codes: np.ndarray, y: np.ndarray, w: np.ndarray, leaf: int, depth: int | None = None, subset: int | None = None, key: int = 0) -> dict[str, np.ndarray]:
    """A tree over rows of small integer codes; nodes level by level, the root first.

    A split leaves at least ``leaf`` rows on both sides; a node whose labels are all
    equal is a leaf. Of a node's ``subset`` random features the best is taken; if none
    of them can split, the next features of its order are tried one by one.
    """
    count, width = codes.shape
    base = int(codes.max()) + 1 if codes.size else 1
    if codes.dtype == np.uint8 and width < 8:
        codes = np.column_stack([codes, np.zeros((count, 8 - width), np.uint8)])
    rows = _Rows(np.ascontiguousarray(codes), y, w * (1 + 1j * y), np.arange(count))
    levels = _levels(rows, np.array([count]), np.array([key], np.uint64), depth, (width, base, leaf, width if subset is None else subset))
    out = {k: np.concatenate([x[k] for x in levels]) for k in levels[0]}
    return {k: (SF.lefts(out["feature"]) if k == "left" else out[k]).astype(t) for k, t in _GROWN.items()}


def _levels(data: _Rows, sizes: np.ndarray, keys: np.ndarray, depth: int | None, terms: tuple[int, int, int, int]) -> list[dict[str, np.ndarray]]:
    """The nodes of each level from one level's nodes on; larger levels go on in runs of nodes. ``terms``: features, codes, least rows of a leaf, features a node draws."""
    out, number = [], np.arange(len(sizes))  # the nodes' places in the level; their rows stand in another order
    while True:
        level = _level(data, sizes, keys, terms, depth is None or len(out) < depth)
        told = {k: np.empty_like(x) for k, x in level.items()}
        for k, x in level.items():
            told[k][number] = x
        out.append(told)
        feature = level["feature"]
        split = np.flatnonzero(feature >= 0)
        if not len(split):
            return out
        right = data.of(np.maximum(feature, 0), sizes) > np.repeat(level["cut"], sizes)
        rights = np.add.reduceat(right, np.cumsum(sizes) - sizes, dtype=np.int64)[split]
        left = ~right
        if len(split) < len(sizes):
            going = np.repeat(feature >= 0, sizes)
            left, right = left & going, right & going
        data = data.some(np.concatenate([np.flatnonzero(left), np.flatnonzero(right)]))  # all left children, then all right ones
        sizes = np.concatenate([sizes[split] - rights, rights])
        place = np.cumsum(told["feature"] >= 0)[number[split]] - 1
        number = np.concatenate([2 * place, 2 * place + 1])
        kids = child_keys(keys[split])
        keys = np.concatenate([kids[::2], kids[1::2]])
        if len(data.labels) > 2 * RUN_ROWS and sizes.max() <= RUN_ROWS:
            ends, order = np.cumsum(sizes), np.argsort(number)
            sums = np.cumsum(sizes[order])
            stops = np.unique(np.searchsorted(sums, np.arange(RUN_ROWS, sums[-1], RUN_ROWS)))
            runs = []
            for own in np.split(order, stops[stops > 0]):
                rows = np.concatenate([data.place[ends[i] - sizes[i] : ends[i]] for i in own.tolist()])
                runs.append(_levels(data.some(rows), sizes[own], keys[own], None if depth is None else depth - len(out), terms))
            for i in range(max(map(len, runs))):
                both = [r[i] for r in runs if len(r) > i]
                out.append({k: np.concatenate([x[k] for x in both]) for k in both[0]})
            return out


def _level(data: _Rows, sizes: np.ndarray, keys: np.ndarray, terms: tuple[int, int, int, int], grows: bool) -> dict[str, np.ndarray]:
    """The nodes of one level, split where they can be."""
    m, (width, base, leaf, subset) = len(sizes), terms
    starts = np.cumsum(sizes) - sizes
    sums = np.add.reduceat(data.weighted, starts)
    weight, s = sums.real, sums.imag
    score, chosen = np.full(m, -np.inf), np.full(m, -1)
    cut, above = np.zeros(m, np.int64), np.zeros(m, np.int64)
    able = (sizes >= max(2 * leaf, 2)) & grows
    if able.any():
        able &= np.minimum.reduceat(data.labels, starts) < np.maximum.reduceat(data.labels, starts)
    at, pending = 0, np.flatnonzero(able)
    while at < width and len(pending):
        to, rows = min(subset if at == 0 else at + 1, width), None
        if len(pending) < m:
            wanted = np.zeros(m, bool)
            wanted[pending] = True
            rows = np.flatnonzero(np.repeat(wanted, sizes))
        size = sizes[pending]
        order = feature_order(keys[pending], width)
        best = _dense if len(pending) * base * 2 <= size.sum() else _sparse
        for node, f, top, c, nxt in best(data, rows, size, order[:, at:to], base, leaf):
            k = pending[node]
            better = (top > score[k]) | (top == score[k]) & (f < chosen[k])
            k = k[better]
            score[k], chosen[k], cut[k], above[k] = top[better], f[better], c[better], nxt[better]
        at, pending = to, pending[chosen[pending] < 0]
    gain = np.where(chosen >= 0, np.maximum(np.where(chosen >= 0, score, 0) - s**2 / weight, 0), 0)
    return {"feature": chosen, "cut": cut, "above": above, "left": chosen, "value": s / weight, "gain": gain, "rows": sizes}


def _dense(data: _Rows, rows: np.ndarray | None, size: np.ndarray, order: np.ndarray, base: int, leaf: int):
    """For each column of ``order`` (nodes, features) the nodes that the feature can split: (node, feature, score, cut, next code), from a histogram of codes for each node."""
    m, part = len(size), data.weighted if rows is None else data.weighted.take(rows)
    own, w, wy = np.repeat(np.arange(m) * base, size), np.ascontiguousarray(part.real), np.ascontiguousarray(part.imag)
    for feature in order.T:
        key = own + data.of(feature, size, rows)
        n = np.bincount(key, minlength=m * base).reshape(m, base)
        lw, ls = (np.cumsum(np.bincount(key, x, m * base).reshape(m, base), axis=1) for x in (w, wy))
        ln = np.cumsum(n, axis=1)
        rn, rw, rs = (x[:, -1:] - x for x in (ln, lw, ls))
        with np.errstate(divide="ignore", invalid="ignore"):
            score = np.where((n > 0) & (ln >= leaf) & (rn >= max(leaf, 1)), ls**2 / lw + rs**2 / rw, -np.inf)
        cut = np.argmax(score, axis=1)  # the lowest threshold of equals
        node = np.flatnonzero(score[np.arange(m), cut] > -np.inf)
        cut = cut[node]
        if len(node):
            nxt = np.argmax((n[node] > 0) & (np.arange(base) > cut[:, None]), axis=1)
            yield node, feature[node], score[node, cut], cut, nxt


def _sparse(data: _Rows, rows: np.ndarray | None, size: np.ndarray, order: np.ndarray, base: int, leaf: int):
    """What ``_dense`` tells, from the nodes' rows in the order of their codes."""
    m, part = len(size), data.weighted if rows is None else data.weighted.take(rows)
    ends = np.cumsum(size)
    starts, place = ends - size, data.place[: len(part)]
    own, left = np.repeat(np.arange(m), size), place - np.repeat(starts - 1, size)
    places = np.flatnonzero((left >= leaf) & (np.repeat(size, size) - left >= max(leaf, 1)))  # after which a cut may stand
    own_base, bits = own * base, max(len(part) - 1, 1).bit_length()
    for feature in order.T:
        by, key = _in_order(own_base + data.of(feature, size, rows), place, bits)
        good = places[key.take(places) != key.take(places + 1)]
        if not len(good):
            continue
        upto = np.cumsum(part.take(by))
        node = own.take(good)
        lefts = upto.take(good)
        rights = upto.take(ends - 1).take(node) - lefts
        lefts -= np.where(starts > 0, upto.take(starts - 1, mode="wrap"), 0).take(node)
        score = lefts.imag**2 / lefts.real + rights.imag**2 / rights.real
        first = np.flatnonzero(np.append(True, node[1:] != node[:-1]))
        top = np.maximum.reduceat(score, first)
        hit = np.flatnonzero(score == np.repeat(top, np.diff(np.append(first, len(node)))))
        hit = hit[np.append(True, node[hit][1:] != node[hit][:-1])]  # the lowest threshold of equals
        k, good = node[hit], good[hit]
        yield k, feature[k], score[hit], key[good].astype(np.int64) % base, key[good + 1].astype(np.int64) % base


# ---------------------------------------------------------------- nodes of the upper levels, on the driver


class Upper:
    """Upper nodes of many trees: grown by passes, finished by subtrees. ``cut`` and ``above`` are values around the threshold."""

    def __init__(self, n_trees: int, seed: int):
        self.tree = list(range(n_trees))
        self.key = list(root_keys(seed, np.arange(n_trees)))
        self.level, self.feature, self.cut, self.above = [0] * n_trees, [-1] * n_trees, [0.0] * n_trees, [0.0] * n_trees
        self.left, self.value, self.gain, self.rows = [-1] * n_trees, [0.0] * n_trees, [0.0] * n_trees, [0] * n_trees

    def split(self, node: int, feature: int, cut: float, above: float, gain: float, left: tuple[int, float], right: tuple[int, float]) -> tuple[int, int]:
        """Give a node two children of (rows, mean label)."""
        self.feature[node], self.cut[node], self.above[node], self.gain[node], self.left[node] = feature, cut, above, gain, len(self.tree)
        for key, (n, mean) in zip(child_keys(np.array([self.key[node]], np.uint64)), (left, right)):
            for own, x in ((self.tree, self.tree[node]), (self.key, key), (self.level, self.level[node] + 1), (self.feature, -1), (self.cut, 0.0), (self.above, 0.0), (self.left, -1), (self.value, mean), (self.gain, 0.0), (self.rows, n)):
                own.append(x)
        return self.left[node], self.left[node] + 1

    def walker(self, features: tuple[str, ...]) -> Trees:
        """The nodes so far, for walking rows down in terms of ``cut``."""
        roots = np.arange(int(max(self.tree)) + 1)
        return Trees(features, np.append(roots, len(self.tree)), np.array(self.feature, np.int16), np.array(self.cut), np.array(self.left, np.int32), np.array(self.value), np.array(self.gain), np.array(self.rows))

    def by_tree(self, features: tuple[str, ...]) -> list[tuple[np.ndarray, Trees]]:
        """Each tree's nodes so far, the root first, and the tree of them in terms of ``cut``, a bin."""
        tree, out = np.array(self.tree), []
        feature, cut, left = np.array(self.feature, np.int16), np.array(self.cut).astype(np.int64), np.array(self.left)
        order = np.argsort(tree, kind="stable")
        for own in np.split(order, np.cumsum(np.bincount(tree))[:-1]):
            below, none = np.where(left[own] >= 0, np.searchsorted(own, left[own]), -1), np.zeros(len(own))
            out.append((own, Trees(features, np.array([0, len(own)]), feature[own], cut[own], below, none, none, none)))
        return out

    def finished(self, features: tuple[str, ...], subtrees: dict[int, dict[str, np.ndarray]], threshold, **more) -> Trees:
        """All trees, with ``subtrees`` in place of the nodes they are keyed by; ``threshold(feature, cut, above)`` gives the values to compare with."""
        names = ("feature", "threshold", "left", "value", "gain", "rows")
        parts: dict[str, list] = {k: [] for k in names}
        start = [0]
        by_tree: dict[int, list[int]] = {}
        for i, t in enumerate(self.tree):
            by_tree.setdefault(t, []).append(i)
        for t in sorted(by_tree):
            own = by_tree[t]
            place = {node: start[-1] + k for k, node in enumerate(own)}
            at = start[-1] + len(own)
            first = {k: [] for k in names}
            tails: dict[str, list] = {k: [] for k in names}
            for node in own:
                sub = subtrees.get(node)
                if sub is None:
                    f, c, a = (np.array([x[node]]) for x in (self.feature, self.cut, self.above))
                    row = (self.feature[node], threshold(f, c, a)[0], place.get(self.left[node], -1), self.value[node], self.gain[node], self.rows[node])
                else:
                    moved = dict(sub, threshold=threshold(sub["feature"], sub["cut"], sub["above"]), left=np.where(sub["left"] >= 0, sub["left"] + at - 1, -1))
                    row = tuple(moved[k][0] for k in names)
                    for k in names:
                        tails[k].append(moved[k][1:])
                    at += len(sub["feature"]) - 1
                for k, x in zip(names, row):
                    first[k].append(x)
            for k in names:
                parts[k].append(np.concatenate([np.array(first[k]), *tails[k]]))
            start.append(at)
        types = {"feature": np.int16, "threshold": np.float64, "left": np.int32, "value": np.float64, "gain": np.float64, "rows": np.int64}
        return Trees(features, np.array(start), *(np.concatenate(parts[k]).astype(types[k]) for k in names), **more)


# ---------------------------------------------------------------- exact tree


def _middle(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    mid = low / 2 + high / 2
    return np.where(mid >= high, low, mid)  # neighbours without a double between them


def _value_bins(rows: DataFrame, upper: Upper, names: tuple[str, ...], edges: list[np.ndarray], nodes: Sequence[int]) -> DataFrame:
    """(node, feature, bin, n, s, ylow, yhigh, vlow, vhigh) over the rows of ``nodes``: counts, label sums, and least and largest label and value."""
    width, most, slots = len(names), max(len(e) for e in edges) + 1, np.array(sorted(nodes))
    sent = rows.sparkSession.sparkContext.broadcast((upper.walker(names), edges, slots))

    def run(batches):
        tree, ends, own_slots = sent.value
        place = np.full(len(tree.feature), -1)
        place[own_slots] = np.arange(len(own_slots))
        sums = np.zeros((2, len(own_slots) * width * most))
        lows, highs = np.full(sums.shape, np.inf), np.full(sums.shape, -np.inf)  # of labels, of values
        for b in batches:
            x, slot = _placed(b, tree, place)
            use = np.flatnonzero(slot >= 0)
            y = x[use, width]
            for j in range(width):
                v = x[use, j]
                at = (slot[use] * width + j) * most + np.searchsorted(ends[j], v)
                np.add.at(sums[0], at, 1.0)
                np.add.at(sums[1], at, y)
                for k, c in enumerate((y, v)):
                    np.minimum.at(lows[k], at, c)
                    np.maximum.at(highs[k], at, c)
        full = np.flatnonzero(sums[0])
        for a in range(0, len(full), 1 << 16):
            own = full[a : a + (1 << 16)]
            cols = [own_slots[own // (most * width)], own // most % width, own % most, *sums[:, own], lows[0, own], highs[0, own], lows[1, own], highs[1, own]]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["node", "feature", "bin", "n", "s", "ylow", "yhigh", "vlow", "vhigh"])

    told = rows.mapInArrow(run, "node long, feature long, bin long, n double, s double, ylow double, yhigh double, vlow double, vhigh double")
    return told.groupBy("node", "feature", "bin").agg(
        F.sum("n").cast("long").alias("n"), F.sum("s").alias("s"), F.min("ylow").alias("ylow"), F.max("yhigh").alias("yhigh"), F.min("vlow").alias("vlow"), F.max("vhigh").alias("vhigh")
    )


def _placed(b: pa.RecordBatch, tree: Trees, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A batch's columns as a matrix, and the place of the node that each row has reached."""
    x = np.column_stack([c.to_numpy(zero_copy_only=False) for c in b.columns]) if b.num_rows else np.zeros((0, b.num_columns))
    return x, place[walk(tree, x)[None][:, 0]]


def bin_ends(bins: DataFrame) -> DataFrame:
    """The bins with their ends as thresholds: value, above (null for the largest), ln and ls up to it; tn, ts: the node's rows and sum."""
    own = Window.partitionBy("node", "feature")
    along = own.orderBy("bin")  # BINS_OF_VALUES at most
    upto = along.rowsBetween(Window.unboundedPreceding, 0)
    return bins.select(
        "*", F.col("vhigh").alias("value"), F.lead("vlow").over(along).alias("above"),
        F.sum("n").over(upto).alias("ln"), F.sum("s").over(upto).alias("ls"), F.sum("n").over(own).alias("tn"), F.sum("s").over(own).alias("ts"),
    )


def bins_to_open(ends: DataFrame, leaf: int) -> DataFrame:
    """(node, feature, bin, bn, bs, tn, ts): the bins inside of which a threshold may be as good as the node's best end, and the rows before them.

    With a bin's first rows added to the left side, its count and sum stay in a
    parallelogram spanned by the bin's least and largest label. The score is convex there,
    so no threshold inside is better than the best of the corners.
    """
    rn, rs = F.col("tn") - F.col("ln"), F.col("ts") - F.col("ls")
    able = (F.col("ln") >= leaf) & (rn >= leaf) & F.col("above").isNotNull()
    top = ends.where(able).groupBy("node").agg(F.max(F.col("ls") * F.col("ls") / F.col("ln") + rs * rs / rn).alias("top"))
    bn, bs, spread = F.col("ln") - F.col("n"), F.col("ls") - F.col("s"), F.col("yhigh") - F.col("ylow")

    def score(n, s):
        left, right = F.when(n > 0, s * s / n), F.when(F.col("tn") - n > 0, (F.col("ts") - s) * (F.col("ts") - s) / (F.col("tn") - n))
        return F.coalesce(left, F.lit(0.0)) + F.coalesce(right, F.lit(0.0))

    few = F.when(spread > 0, (F.col("yhigh") * F.col("n") - F.col("s")) / spread).otherwise(F.lit(0.0))
    many = F.when(spread > 0, (F.col("s") - F.col("ylow") * F.col("n")) / spread).otherwise(F.lit(0.0))
    bound = F.greatest(score(bn, bs), score(F.col("ln"), F.col("ls")), score(bn + few, bs + F.col("ylow") * few), score(bn + many, bs + F.col("yhigh") * many))
    inside = (F.col("vlow") < F.col("vhigh")) & (F.col("ln") > leaf) & (F.col("tn") - bn > leaf)
    both = ends.where(inside).withColumn("bound", bound).join(F.broadcast(top.withColumnRenamed("node", "of")), F.col("node") == F.col("of"), "left")  # a row a node
    wanted = F.col("top").isNull() | F.isnan("bound") | (F.col("bound") * (1 + 1e-9) >= F.col("top"))
    return both.where(wanted).select("node", "feature", "bin", bn.alias("bn"), bs.alias("bs"), "tn", "ts")


def _inner_sums(rows: DataFrame, upper: Upper, names: tuple[str, ...], edges: list[np.ndarray], opened: DataFrame) -> DataFrame:
    """(node, feature, value, above, ln, ls, n, s) of the thresholds inside of the bins ``opened``."""
    width, most = len(names), max(len(e) for e in edges) + 1
    told = opened.select("node", "feature", "bin").toArrow()  # nodes x features x bins at most
    slots, slot = np.unique(told["node"].to_numpy(), return_inverse=True)
    wanted = np.zeros(len(slots) * width * most, bool)
    wanted[(slot * width + told["feature"].to_numpy()) * most + told["bin"].to_numpy()] = True
    sent = rows.sparkSession.sparkContext.broadcast((upper.walker(names), edges, slots, wanted))

    def run(batches):
        tree, ends, own_slots, open_bins = sent.value
        place = np.full(len(tree.feature), -1)
        place[own_slots] = np.arange(len(own_slots))
        for b in batches:
            x, at_slot = _placed(b, tree, place)
            use = np.flatnonzero(at_slot >= 0)
            for j in range(width):
                code = np.searchsorted(ends[j], x[use, j])
                hit = open_bins[(at_slot[use] * width + j) * most + code]
                k = use[hit]
                cols = [own_slots[at_slot[k]], np.full(len(k), j), code[hit], x[k, j], x[k, width]]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["node", "feature", "bin", "value", "label"])

    groups = rows.mapInArrow(run, "node long, feature long, bin long, value double, label double")
    groups = groups.groupBy("node", "feature", "bin", "value").agg(F.count("*").alias("n"), F.sum("label").alias("s"))
    along = Window.partitionBy("node", "feature", "bin").orderBy("value")
    upto = along.rowsBetween(Window.unboundedPreceding, 0)
    summed = groups.select("node", "feature", "bin", "value", F.lead("value").over(along).alias("above"), F.sum("n").over(upto).alias("un"), F.sum("s").over(upto).alias("us"))
    known = opened.select(F.col("node").alias("o_node"), F.col("feature").alias("o_feature"), F.col("bin").alias("o_bin"), "bn", "bs", "tn", "ts")
    same = (F.col("node") == F.col("o_node")) & (F.col("feature") == F.col("o_feature")) & (F.col("bin") == F.col("o_bin"))
    return summed.where("above IS NOT NULL").join(known, same).select(
        "node", "feature", "value", "above", (F.col("un") + F.col("bn")).alias("ln"), (F.col("us") + F.col("bs")).alias("ls"), F.col("tn").alias("n"), F.col("ts").alias("s")
    )


def level_splits(rows: DataFrame, upper: Upper, names: tuple[str, ...], edges: list[np.ndarray], nodes: Sequence[int], leaf: int) -> list:
    """The best threshold of every node of ``nodes`` that has one and whose labels differ; ``rows`` are the features, then the label."""
    step = max(1, -(-len(nodes) * len(names) * max(len(e) + 1 for e in edges) // BINS_AT_ONCE))
    edges = [e[step - 1 :: step] for e in edges]
    bins = written_table(_value_bins(rows, upper, names, edges, nodes), "tree-values")[0]
    spread = {r["node"] for r in bins.groupBy("node").agg((F.min("ylow") < F.max("yhigh")).alias("d")).where("d").collect()}  # a row a node
    ends = bin_ends(bins)
    opened = sized_broadcast(bins_to_open(ends, leaf))
    sums = ends.select("node", "feature", "value", "above", "ln", "ls", F.col("tn").alias("n"), F.col("ts").alias("s"))
    if not opened.isEmpty():
        sums = sums.unionByName(_inner_sums(rows, upper, names, edges, opened))
    return [r for r in best_thresholds(sums, leaf).collect() if r["node"] in spread]  # one row for each open node


def best_thresholds(sums: DataFrame, leaf: int) -> DataFrame:
    """(node, feature, value, above, ln, ls, n, s, score): of each node the best threshold; of equals the first feature, then the lowest value."""
    rn, rs = F.col("n") - F.col("ln"), F.col("s") - F.col("ls")
    score = F.col("ls") * F.col("ls") / F.col("ln") + rs * rs / rn
    able = sums.where((F.col("ln") >= leaf) & (rn >= leaf) & F.col("above").isNotNull()).withColumn("score", score)
    fields = F.struct("feature", "value", "above", "ln", "ls", "n", "s", "score")
    best = able.groupBy("node").agg(F.max_by(fields, F.struct("score", -F.col("feature"), -F.col("value"))).alias("b"))
    return best.select("node", "b.*")


def exact_tree(train: DataFrame, features: Sequence[str], label: str, leaf: int = 1, depth: int | None = None, local_rows: int = LOCAL_ROWS) -> Trees:
    """A regression tree with exact thresholds (middle of neighbouring values), all features at every node."""
    names = tuple(features)
    xs = [f"x{i}" for i in range(len(names))]
    rows = train.select(*(F.col(f"`{c}`").cast("double").alias(x) for c, x in zip(names, xs)), F.col(f"`{label}`").cast("double").alias("label"))
    rows = written_table(rows, "tree-rows")[0]
    gap = F.array_contains(F.transform(F.array(*xs, "label"), lambda v: v.isNull() | F.isnan(v)), True)
    n, mean, gaps = rows.agg(F.count("*"), F.avg("label"), F.count(F.when(gap, 1))).first()
    if gaps:
        raise ValueError(f"missing values in {gaps} train rows: fill or drop them before fitting")
    if not n:
        raise ValueError("no train rows")
    upper = Upper(1, SEED)
    upper.rows[0], upper.value[0] = n, mean
    open_nodes, small, level = [0], [], 0
    if n <= local_rows:
        open_nodes, small = [], [0]
    edges = quantile_edges(rows, xs, BINS_OF_VALUES, 4) if open_nodes and depth != 0 else []
    while open_nodes and (depth is None or level < depth):
        found = level_splits(rows, upper, names, edges, open_nodes, leaf)
        open_nodes = []
        for r in sorted(found, key=lambda r: r["node"]):
            rn, rs = r["n"] - r["ln"], r["s"] - r["ls"]
            gain = max(r["score"] - r["s"] ** 2 / r["n"], 0.0)
            for k in upper.split(r["node"], r["feature"], r["value"], r["above"], gain, (r["ln"], r["ls"] / r["ln"]), (rn, rs / rn)):
                (open_nodes if upper.rows[k] > local_rows else small).append(k)
        level += 1
    # a subtree's root stands for the node itself, so nodes above the limit alone need one
    small = [k for k in small if depth is None or upper.level[k] < depth]
    subtrees = _exact_subtrees(rows, upper, names, small, leaf, depth) if small else {}
    return upper.finished(names, subtrees, lambda f, cut, above: np.where(f >= 0, _middle(cut, above), 0.0))


def _exact_subtrees(rows: DataFrame, upper: Upper, names: tuple[str, ...], small: list[int], leaf: int, depth: int | None) -> dict[int, dict[str, np.ndarray]]:
    """Trees below the nodes ``small``, each grown in one task; cuts are values."""
    width, columns = len(names), rows.columns
    sent = rows.sparkSession.sparkContext.broadcast((upper.walker(names), np.array(small), np.array(upper.level)))

    def rows_of(batches):
        tree, chosen, _ = sent.value
        place = np.full(len(tree.feature), -1)
        place[chosen] = chosen
        for b in batches:
            node = _placed(b, tree, place)[1]
            use = pa.array(np.flatnonzero(node >= 0))
            yield pa.RecordBatch.from_arrays([pa.array(node).take(use), *(c.take(use) for c in b.columns)], names=["node", *columns])

    def one(key: tuple, own: pd.DataFrame) -> pd.DataFrame:
        x = own[columns[:-1]].to_numpy()
        found = [np.unique(x[:, j], return_inverse=True) for j in range(width)]
        left = None if depth is None else int(depth - sent.value[2][key[0]])
        made = grow(np.column_stack([c for _, c in found]), own["label"].to_numpy(), np.ones(len(own)), leaf, left)
        for side in ("cut", "above"):
            made[side] = np.array([found[f][0][c] if f >= 0 else 0.0 for f, c in zip(made["feature"], made[side])])
        return pd.DataFrame({"node": [key[0]], **{k: [v.tobytes()] for k, v in made.items()}})

    n = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    schema = "node long, feature binary, cut binary, above binary, left binary, value binary, gain binary, rows binary"
    dealt = rows.mapInArrow(rows_of, ", ".join(["node long", *(f"{c} double" for c in columns)])).repartition(n, "node")
    made = dealt.groupBy("node").applyInPandas(one, schema).collect()
    return {r["node"]: _unpacked(r, {"cut": np.float64, "above": np.float64}) for r in made}


_TYPES = {"feature": np.int16, "cut": np.int32, "above": np.int32, "left": np.int32, "value": np.float64, "gain": np.float32, "rows": np.int32}


def _unpacked(row, other: dict) -> dict[str, np.ndarray]:
    return {k: np.frombuffer(row[k], other.get(k, t)) for k, t in _TYPES.items()}


# ---------------------------------------------------------------- binned rows


@dataclass(frozen=True)
class Binned:
    """Train rows as a written table (row, codes: one byte a feature, label), and each feature's upper bin edges."""

    rows: DataFrame
    names: tuple[str, ...]
    edges: list[np.ndarray]
    n: int
    mean: float

    def threshold(self, f: np.ndarray, cut: np.ndarray, above: np.ndarray) -> np.ndarray:
        """The edge a cut stands for; a value on it goes left."""
        return np.array([self.edges[k][int(c)] if k >= 0 else 0.0 for k, c in zip(f, cut)])


def quantile_edges(train: DataFrame, features: Sequence[str], bins: int = BINS, steps: int = 100) -> list[np.ndarray]:
    """Upper edges of at most ``bins`` bins for each feature: values of the feature at even ranks, from a mergeable sketch right to ``1 / (bins * steps)`` of the rows."""
    probs = F.array(*(F.lit(k / bins) for k in range(1, bins)))
    row = train.agg(*(F.percentile_approx(F.col(f"`{c}`").cast("double"), probs, steps * bins).alias(f"q{i}") for i, c in enumerate(features))).first()
    return [np.unique(np.array(q if q is not None else [], np.float64)) for q in row]


def binned(train: DataFrame, features: Sequence[str], label: str, bins: int = BINS) -> Binned:
    """Cut the features into bins once; a missing feature or label is an error."""
    if not 2 <= bins <= 256:
        raise ValueError("a bin is one byte: 2 to 256 bins")
    names, edges = tuple(features), quantile_edges(train, features, bins)

    def run(batches):
        for b in batches:
            x = matrix([c.to_numpy(zero_copy_only=False) for c in b.columns[1:]], [*names, "the label"])
            codes = np.column_stack([np.searchsorted(e, x[:, j]) for j, e in enumerate(edges)]).astype(np.uint8)
            yield pa.RecordBatch.from_arrays([b.column(0), _byte_rows(codes), pa.array(x[:, -1])], names=["row", "codes", "label"])

    own = train.select(F.monotonically_increasing_id().alias("row"), *(F.col(f"`{c}`").cast("double").alias(f"x{i}") for i, c in enumerate(names)), F.col(f"`{label}`").cast("double").alias("label"))
    rows = written_table(own.mapInArrow(run, "row long, codes binary, label double"), "tree-bins", DEALT_ROWS)[0]  # files for all slots
    n, mean = rows.agg(F.count("*"), F.avg("label")).first()
    if not n:
        raise ValueError("no train rows")
    return Binned(rows, names, edges, n, mean)


def _byte_rows(codes: np.ndarray) -> pa.Array:
    n, width = codes.shape
    at = pa.py_buffer((np.arange(n + 1) * width).astype(np.int32))
    return pa.Array.from_buffers(pa.binary(), n, [None, at, pa.py_buffer(np.ascontiguousarray(codes))])


def code_matrix(column: pa.Array, width: int) -> np.ndarray:
    """(rows, width) bytes of a column made by ``_byte_rows``."""
    if not len(column):
        return np.zeros((0, width), np.uint8)
    first = column.slice(0, 1).buffers()
    start = np.frombuffer(first[1], np.int32)[column.offset]
    return np.frombuffer(first[2], np.uint8)[start : start + len(column) * width].reshape(-1, width)


# ---------------------------------------------------------------- forest


def _in_chunks(batches, width: int):
    """(row, codes feature by feature, labels) of up to ``DEALT_ROWS`` rows and a batch."""
    held, size = [], 0
    for b in batches:
        held.append((b.column(0).to_numpy(), code_matrix(b.column(1), width), b.column(2).to_numpy()))
        size += b.num_rows
        if size >= DEALT_ROWS:
            row, codes, y = (np.concatenate(x) for x in zip(*held))
            yield row, np.ascontiguousarray(codes.T), y
            held, size = [], 0
    if size:
        row, codes, y = (np.concatenate(x) for x in zip(*held))
        yield row, np.ascontiguousarray(codes.T), y


def _down(tree: Trees, codes: np.ndarray) -> np.ndarray:
    """The node that every row of ``codes`` (features, rows) reaches in the only tree of ``tree``."""
    return reached(tree, 0, codes) if len(tree.feature) <= FEW_NODES else walk(tree, codes.T)[None][:, 0]


def _histograms(data: Binned, upper: Upper, fold: Sequence[int]) -> DataFrame:
    """(node, feature, bin, n, w, s) over the rows that the bootstrap samples have in the nodes ``fold``; zero bins have no row."""
    width, fold = len(data.names), np.array(sorted(fold))
    place = np.full(len(upper.tree), -1)
    place[fold] = np.arange(len(fold))
    trees = [(upper.key[t], place[own], tree) for t, (own, tree) in enumerate(upper.by_tree(data.names)) if (place[own] >= 0).any()]
    sent = data.rows.sparkSession.sparkContext.broadcast((trees, fold))

    def run(batches):
        trees, slots = sent.value
        sums = np.zeros((3, len(slots), width, 256))
        for row, codes, y in _in_chunks(batches, width):
            for key, slot, tree in trees:
                wanted = np.flatnonzero(slot >= 0)
                own = np.full(len(slot), -1)
                own[wanted] = np.arange(len(wanted)) * 256
                w, at = poisson(row.view(np.uint64), key), own.take(_down(tree, codes))
                use = np.flatnonzero((at >= 0) & (w > 0))
                at, w, y_own = at.take(use), w.take(use).astype(np.float64), y.take(use)
                wy = w * y_own
                for f in range(width):
                    k = at + codes[f].take(use)
                    for into, weights in zip(sums, (None, w, wy)):
                        into[slot[wanted], f] += np.bincount(k, weights, len(wanted) * 256).reshape(-1, 256)
        sums = sums.reshape(3, -1)
        full = np.flatnonzero(sums[0])
        for a in range(0, len(full), 1 << 16):
            own = full[a : a + (1 << 16)]
            cols = [slots[own // (256 * width)], own // 256 % width, own % 256, *sums[:, own]]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["node", "feature", "bin", "n", "w", "s"])

    told = data.rows.mapInArrow(run, "node long, feature long, bin long, n double, w double, s double")
    return told.groupBy("node", "feature", "bin").agg(F.sum("n").alias("n"), F.sum("w").alias("w"), F.sum("s").alias("s"))


def sibling_histograms(parents: DataFrame, folded: DataFrame, pairs: Sequence[tuple[int, int, int]]) -> DataFrame:
    """Histograms of both children from those of the parents and the smaller children; ``pairs`` are (parent, smaller, larger)."""
    spark = parents.sparkSession
    known = sized_broadcast(spark.createDataFrame(list(pairs), "parent long, small long, large long"))
    from_parent = parents.join(known, F.col("node") == F.col("parent")).select(F.col("large").alias("node"), "feature", "bin", "n", "w", "s")
    less = folded.join(known, F.col("node") == F.col("small")).select(F.col("large").alias("node"), "feature", "bin", *(-F.col(c) for c in ("n", "w", "s")))
    larger = from_parent.unionAll(less).groupBy("node", "feature", "bin").agg(F.sum("n").alias("n"), F.sum("w").alias("w"), F.sum("s").alias("s"))
    return folded.unionAll(larger.where("n > 0"))


def _best_bins(hist: DataFrame, leaf: int) -> DataFrame:
    """(node, feature, score, bin, ln, lw, ls, n, w, s): the best cut of every node and feature; at most 256 rows a window."""
    own = Window.partitionBy("node", "feature")
    upto = own.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    cols = [F.sum(c).over(upto).alias(f"l{c}") for c in ("n", "w", "s")] + [F.sum(c).over(own).alias(f"a{c}") for c in ("n", "w", "s")]
    both = hist.select("node", "feature", "bin", *cols)
    rn, rw, rs = (F.col(f"a{c}") - F.col(f"l{c}") for c in ("n", "w", "s"))
    score = F.col("ls") * F.col("ls") / F.col("lw") + rs * rs / rw
    able = both.where((F.col("ln") >= leaf) & (rn >= leaf) & (rn > 0)).withColumn("score", score)
    fields = F.struct("score", "bin", "ln", "lw", "ls", "an", "aw", "as")
    return able.groupBy("node", "feature").agg(F.max_by(fields, F.struct("score", -F.col("bin"))).alias("b")).select("node", "feature", "b.*")


def forest(data: Binned, n_trees: int, leaf: int = 1, depth: int | None = None, subset: int | None = None, seed: int = SEED, local_rows: int = FOREST_ROWS) -> Trees:
    """The trees of ``stored_forest``, gathered by the driver."""
    upper, small = _grown_forest(data, n_trees, leaf, depth, subset, seed, local_rows)
    subtrees, found = _forest_subtrees(data, upper, small, [(leaf, depth)], subset), {}
    for r in subtrees.collect() if subtrees is not None else []:
        own = {k: np.frombuffer(r[k], t) for k, t in SF.TYPES.items()}
        found[r["node"]] = dict(own, cut=own["cut"].astype(np.int32), above=own["cut"], left=SF.lefts(own["feature"]))
    return upper.finished(data.names, found, data.threshold)


def stored_forest(data: Binned, n_trees: int, leaf: int = 1, depth: int | None = None, subset: int | None = None, seed: int = SEED, local_rows: int = FOREST_ROWS) -> SF.StoredForest:
    """Bootstrap trees over binned rows, all grown together; values are means of the sampled rows. Subtrees go from the tasks to the shared folder."""
    return stored_forests(data, n_trees, [(leaf, depth)], subset, seed, local_rows)[0]


def stored_forests(data: Binned, n_trees: int, terms: Sequence[tuple[int, int | None]], subset: int | None = None, seed: int = SEED, local_rows: int = FOREST_ROWS) -> list[SF.StoredForest]:
    """A forest for each of ``terms`` (leaf, depth), all from the same samples.

    Where the upper nodes of the least leaf keep the rows and depth that another asks for, they
    are its upper nodes too: its thresholds are some of theirs, the best among them. Then
    rows are dealt once, and a task grows the subtrees of both.
    """
    spark, out, left = data.rows.sparkSession, {}, sorted(terms, key=lambda x: x[0])
    while left:
        deepest = None if any(d is None for _, d in left) else max(d for _, d in left)
        upper, small = _grown_forest(data, n_trees, left[0][0], deepest if len(left) > 1 else left[0][1], subset, seed, local_rows)
        splits = [k for k, f in enumerate(upper.feature) if f >= 0]
        rows = min((min(upper.rows[upper.left[k]], upper.rows[upper.left[k] + 1]) for k in splits), default=data.n)
        level = max((upper.level[k] for k in splits), default=-1)
        own = [x for i, x in enumerate(left) if rows >= x[0] and (x[1] is None or level < x[1])]
        if not own:  # not one takes the nodes grown as deep as another's: the first grows by itself
            own = left[:1]
            upper, small = _grown_forest(data, n_trees, *left[0], subset, seed, local_rows)
        path, subtrees = scratch_path(spark, "forest"), _forest_subtrees(data, upper, small, own, subset)
        SF.store(spark.createDataFrame([], f"{SF.SCHEMA}, term int") if subtrees is None else subtrees, path, "term")
        nodes = {k: np.array(getattr(upper, k), t) for k, t in SF.UPPER.items()}
        for i, x in enumerate(own):
            out[x] = SF.StoredForest(spark, data.names, n_trees, nodes, data.edges, f"{path}/term={i}")
        left = [x for x in left if x not in own]
    return [out[x] for x in terms]


def _grown_forest(data: Binned, n_trees: int, leaf: int, depth: int | None, subset: int | None, seed: int, local_rows: int) -> tuple[Upper, list[int]]:
    """The upper nodes, and which of them tasks go on with."""
    width = len(data.names)
    subset = width if subset is None else subset
    upper, level = Upper(n_trees, seed), 0
    upper.rows = [data.n] * n_trees
    # until a pass has counted them, a root is taken to hold all rows
    open_nodes = [t for t in range(n_trees) if data.n > local_rows]
    small = [t for t in range(n_trees) if data.n <= local_rows]
    hist, pairs = None, []
    while open_nodes and (depth is None or level < depth):
        if hist is None:
            hist = written_table(_histograms(data, upper, open_nodes), "tree-histograms")[0]
        else:
            folded = written_table(_histograms(data, upper, [s for _, s, _ in pairs]), "tree-histograms")[0]
            hist = written_table(sibling_histograms(hist, folded, pairs), "tree-histograms")[0]
        wanted = sized_broadcast(hist.sparkSession.createDataFrame([(k,) for k in open_nodes], "open long"))
        found: dict[int, dict[int, object]] = {}
        for r in _best_bins(hist.join(wanted, F.col("node") == F.col("open"), "left_semi"), leaf).collect():  # features x open nodes
            found.setdefault(r["node"], {})[r["feature"]] = r
        pairs, opened = [], []
        for node in open_nodes:
            able = found.get(node, {})
            order = feature_order(np.array([upper.key[node]], np.uint64), width)[0].tolist()
            drawn = [f for f in order[:subset] if f in able] or [f for f in order[subset:] if f in able][:1]
            if able:
                some = next(iter(able.values()))
                upper.value[node], upper.rows[node] = some["as"] / some["aw"], int(some["an"])
            if not drawn:
                continue
            r = max((able[f] for f in drawn), key=lambda r: (r["score"], -r["feature"]))
            gain = r["score"] - r["as"] ** 2 / r["aw"]
            if gain <= 1e-12 * abs(r["score"]):  # all labels equal
                continue
            ln, rn = int(r["ln"]), int(r["an"] - r["ln"])
            rw, rs = r["aw"] - r["lw"], r["as"] - r["ls"]
            left, right = upper.split(node, r["feature"], r["bin"], r["bin"], gain, (ln, r["ls"] / r["lw"]), (rn, rs / rw))
            for k in (left, right):
                (opened if upper.rows[k] > local_rows else small).append(k)
            if max(ln, rn) > local_rows:
                pairs.append((node, left, right) if ln <= rn else (node, right, left))
        open_nodes, level = opened, level + 1
    return upper, small


def _forest_subtrees(data: Binned, upper: Upper, small: list[int], terms: Sequence[tuple[int, int | None]], subset: int | None) -> DataFrame | None:
    """Trees below the nodes ``small`` for each of ``terms``, grown in one task from the node's sampled rows."""
    width, spark, terms = len(data.names), data.rows.sparkSession, list(terms)
    # a subtree's root stands for the node itself, so nodes above the limit alone need one
    small = [k for k in small if any(d is None or upper.level[k] < d for _, d in terms)]
    if not small:
        return None
    keys, wanted = np.array(upper.key, np.uint64), np.zeros(len(upper.tree), bool)
    wanted[small] = True
    trees = [(keys[t], np.where(wanted[own], own, -1), tree) for t, (own, tree) in enumerate(upper.by_tree(data.names)) if wanted[own].any()]
    sent = spark.sparkContext.broadcast((trees, keys, np.array(upper.level), np.array(upper.tree)))

    def rows_of(batches):
        for row, codes, y in _in_chunks(batches, width):
            lines = codes.T.copy()
            for key, chosen, tree in sent.value[0]:
                w = poisson(row.view(np.uint64), key)
                node = chosen.take(_down(tree, codes))
                use = np.flatnonzero((node >= 0) & (w > 0))
                if not len(use):
                    continue
                own = node.take(use)
                if own.min() < own.max():
                    order = np.argsort(own, kind="stable")
                    use, own = use.take(order), own.take(order)
                first = np.flatnonzero(np.append(True, own[1:] != own[:-1])).tolist()
                cut = [(a, use[a:z]) for a, z in zip(first, [*first[1:], len(own)])]
                out = [(int(own[a]), int(row[k[0]]), lines.take(k, axis=0).tobytes(), y.take(k).tobytes(), w.take(k).tobytes()) for a, k in cut]
                types = [pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=["node", "first", "codes", "label", "w"])

    def one(key: tuple, own: pd.DataFrame) -> pd.DataFrame:
        _, all_keys, levels, tree = sent.value
        own = own.sort_values("first")
        codes = np.frombuffer(b"".join(own["codes"]), np.uint8).reshape(-1, width)
        y, w = np.frombuffer(b"".join(own["label"])), np.frombuffer(b"".join(own["w"]), np.uint8)
        node, out = key[0], []
        for i, (leaf, depth) in enumerate(terms):
            below = None if depth is None else int(depth - levels[node])
            if below is None or below > 0:
                made = grow(codes, y, w, leaf, below, subset, all_keys[node])
                out.append({"tree": tree[node], "node": node, **{k: made[k].astype(t).tobytes() for k, t in SF.TYPES.items()}, "term": i})
        return pd.DataFrame(out)

    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(len(small), 16 * spark.sparkContext.defaultParallelism))
    dealt = data.rows.mapInArrow(rows_of, "node long, first long, codes binary, label binary, w binary").repartition(n, "node")
    return dealt.groupBy("node").applyInPandas(one, f"{SF.SCHEMA}, term int")
