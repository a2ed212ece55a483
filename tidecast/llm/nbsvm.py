"""Quality classifier: naive Bayes support vectors over n-gram indicators.

1. Every learning row of every class adds its indicators to class counts (all rows,
   folded in tasks, summed by Spark). A bucket's log-count ratio is
   log((c1 + a n1 / n) / (c0 + a n0 / n)) - log(n1 / n0): pseudo-counts follow the
   sizes of the classes, so a bucket that no row has seen has ratio zero.
2. A document is its indicators scaled by these ratios, at length one. A linear
   hinge-loss model is fitted to a bounded sample of learning rows (``FIT_ROWS`` of
   each class, those with the least hash of their id) by dual coordinate descent; its
   weights are drawn towards their mean size (``BETA``), as the method does.
3. A logistic curve turns margins into probabilities. It is fitted to a bounded
   sample (``CURVE_ROWS`` of each class) of labelled rows that took no part in 1 and 2,
   at the classes' true sizes.

All documents are scored from the model alone: two arrays of ``BUCKETS`` numbers.

Defined cases: null or empty text has no indicators and gets the score of margin
zero; labels other than 0 and 1 and labels without an id are ignored; an id with
several labels counts as the lowest; repeated rows count and score each by itself; a
row without an id is never learnt from; if a class has no learning row, every score
is the smoothed share of class 1; columns other than id and text are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidecast.llm.common import strings, written
from tidecast.llm.ngrams import BUCKETS, indicators
from tidecast.operators.joins import sized_broadcast

#: rows of each class, at most, to which the hinge-loss model is fitted
FIT_ROWS = 4000
#: rows of each class, at most, to which the probability curve is fitted
CURVE_ROWS = 2000
#: one learning row in so many is kept for the curve
CURVE_SHARE = 4
PSEUDO = 30.0
COST = 10.0
BETA = 0.25
SWEEPS = 40
TOLERANCE = 1e-3
SEED = 12


@dataclass(frozen=True)
class Model:
    """Per bucket the squared ratio and the weight of the scaled indicator; then bias and curve."""

    square: np.ndarray
    weight: np.ndarray
    bias: float
    slope: float
    shift: float

    def margin(self, own: np.ndarray) -> float:
        length = float(np.sqrt(self.square[own].sum()))
        return float(self.weight[own].sum()) / length + self.bias if length else self.bias

    def score(self, margin: np.ndarray) -> np.ndarray:
        return _curve(self.slope * np.asarray(margin, float) + self.shift)


def _curve(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


def ratios(counts: np.ndarray, rows: np.ndarray, pseudo: float = PSEUDO) -> np.ndarray:
    """Log-count ratio of each bucket; ``counts`` is (2, buckets), ``rows`` the learning rows of each class."""
    prior = pseudo * rows / rows.sum()
    return np.log((counts[1] + prior[1]) / (counts[0] + prior[0])) - np.log(rows[1] / rows[0])


def descend(own: list[np.ndarray], label: np.ndarray, ratio: np.ndarray, cost: float = COST, sweeps: int = SWEEPS, tolerance: float = TOLERANCE, seed: int = SEED) -> tuple[np.ndarray, float]:
    """Weights and bias of min |w|^2 / 2 + sum cost_i max(0, 1 - y_i (w x_i + b)) by dual coordinate descent.

    x_i are scaled indicators at length one, with a bias of value one beside them;
    the cost of a row is shared out so that both classes weigh alike.
    """
    rng = np.random.default_rng(seed)
    y = np.where(label == 1, 1.0, -1.0)
    size = np.array([max(1, (label == 0).sum()), max(1, (label == 1).sum())])
    limit = cost * len(y) / (2.0 * size[label])
    length = np.array([np.sqrt((ratio[o] ** 2).sum()) for o in own])
    inverse = np.divide(1.0, length, out=np.zeros_like(length), where=length > 0)
    diagonal = 1.0 + (length > 0)
    w, bias, alpha = np.zeros(len(ratio)), 0.0, np.zeros(len(y))
    for _ in range(sweeps):
        worst = 0.0
        for i in rng.permutation(len(y)):
            x = ratio[own[i]] * inverse[i]
            slope = y[i] * (w[own[i]] @ x + bias) - 1.0
            at = alpha[i]
            projected = min(slope, 0.0) if at == 0.0 else max(slope, 0.0) if at == limit[i] else slope
            worst = max(worst, abs(projected))
            if projected:
                alpha[i] = min(max(at - slope / diagonal[i], 0.0), limit[i])
                step = (alpha[i] - at) * y[i]
                w[own[i]] += step * x
                bias += step
        if worst < tolerance:
            break
    return w, float(bias)


def fit_curve(margin: np.ndarray, label: np.ndarray, rows: np.ndarray, steps: int = 50) -> tuple[float, float]:
    """Slope and shift of the logistic curve by Newton's method; rows weigh so that classes have their true sizes, targets are smoothed."""
    n = np.array([(label == 0).sum(), (label == 1).sum()], float)
    if not n.all():
        return 1.0, 0.0
    weight = (rows / n)[label] / rows.sum() * len(label)
    target = np.where(label == 1, (n[1] + 1) / (n[1] + 2), 1 / (n[0] + 2))
    x = np.column_stack([margin, np.ones(len(margin))])
    at = np.array([1.0, np.log(rows[1] / rows[0])])

    def loss(p):
        z = x @ p
        return (weight * (np.logaddexp(0, z) - target * z)).sum() + 1e-6 * (p @ p)

    for _ in range(steps):
        p = _curve(x @ at)
        slope = x.T @ (weight * (p - target)) + 2e-6 * at
        bend = (x * (weight * p * (1 - p))[:, None]).T @ x + 2e-6 * np.eye(2)
        move, part = np.linalg.solve(bend, slope), 1.0
        while loss(at - part * move) > loss(at) and part > 1e-6:
            part /= 2
        at = at - part * move
        if np.abs(part * move).max() < 1e-9:
            break
    return float(max(at[0], 1e-6)), float(at[1])


def fit(fit_own: list[np.ndarray], fit_label: np.ndarray, curve_own: list[np.ndarray], curve_label: np.ndarray, ratio: np.ndarray, rows: np.ndarray, beta: float = BETA, cost: float = COST) -> Model:
    w, bias = descend(fit_own, fit_label, ratio, cost)
    used = w != 0
    mean = np.abs(w[used]).mean() if used.any() else 0.0
    weight = ratio * np.where(used, (1 - beta) * mean + beta * w, 0.0)
    raw = Model(ratio**2, weight, bias, 1.0, 0.0)
    margins = np.array([raw.margin(o) for o in curve_own])
    return Model(raw.square, weight, bias, *fit_curve(margins, curve_label, rows))


# ---------------------------------------------------------------- tables


def labelled(labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality") -> DataFrame:
    """(own_id, label): the lowest label 0 or 1 of every id."""
    known = labels.select(F.col(f"`{id_col}`").cast("long").alias("own_id"), F.col(f"`{label_col}`").cast("int").alias("label"))
    return known.where("own_id IS NOT NULL AND label IN (0, 1)").groupBy("own_id").agg(F.min("label").alias("label"))


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))


def class_counts(learning: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(2, BUCKETS) counts of rows by class and bucket, and rows by class, over all rows of (text, label)."""

    def run(batches):
        counts = np.zeros((2, BUCKETS + 1), np.int64)
        for b in batches:
            for text, label in zip(strings(b.column(0)), b.column(1).to_pylist()):
                counts[label, indicators((text or "").encode())] += 1
                counts[label, BUCKETS] += 1
        used = np.flatnonzero(counts.any(axis=0))
        for at in range(0, len(used), 1 << 16):
            own = used[at : at + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(counts[0, own]), pa.array(counts[1, own])], names=["bucket", "n0", "n1"])

    told = learning.select("text", "label").mapInArrow(run, "bucket long, n0 long, n1 long")
    summed = told.groupBy("bucket").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")).toPandas()  # BUCKETS + 1 rows at most
    counts = np.zeros((2, BUCKETS + 1), np.int64)
    counts[:, summed["bucket"].to_numpy(np.int64)] = summed[["n0", "n1"]].to_numpy(np.int64).T
    return counts[:, :BUCKETS], counts[:, BUCKETS]


def _sample(ids: DataFrame, rows: int) -> DataFrame:
    """Of each class the ``rows`` ids with the least hash."""
    first = [ids.where(F.col("label") == k).orderBy("dice", "own_id").limit(rows) for k in (0, 1)]
    return first[0].unionAll(first[1])


def learn(docs: DataFrame, labels: DataFrame, learn_from: Column | None = None, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", fit_rows: int = FIT_ROWS, curve_rows: int = CURVE_ROWS) -> Model | float:
    """The model of the labelled rows, or a constant score if a class has none.

    ``learn_from`` is a condition on the column ``own_id``: labels of other ids are not read.
    """
    known = labelled(labels, id_col, label_col)
    known = known if learn_from is None else known.where(learn_from)
    dice = F.xxhash64(F.col("own_id"), F.lit(SEED))
    known = known.select("own_id", "label", dice.alias("dice"), (F.pmod(F.shiftrightunsigned(dice, 32), F.lit(CURVE_SHARE)) == 0).alias("curve"))
    known = sized_broadcast(known)
    rows = _rows(docs, id_col, text_col)
    # the ids of labelled documents alone are narrow; texts are read again for counts and for the sample
    present = written(rows.select("doc_id").join(known, F.col("doc_id") == F.col("own_id")).drop("doc_id").distinct(), "labelled-ids")
    learning = rows.join(known.where("NOT curve"), F.col("doc_id") == F.col("own_id"))
    counts, n = class_counts(learning)
    if not n.all():
        return float((n[1] + 1) / (n.sum() + 2))
    sample = _sample(present.where("NOT curve"), fit_rows).unionAll(_sample(present.where("curve"), curve_rows))
    sample = sized_broadcast(sample)  # 2 * (fit_rows + curve_rows) ids at most
    ratio = ratios(counts, n).astype(np.float64)

    def features(batches):
        for b in batches:
            own = [indicators((t or "").encode()).tobytes() for t in strings(b.column(0))]
            yield pa.RecordBatch.from_arrays([*b.columns[1:], pa.array(own, pa.binary())], names=["own_id", "label", "curve", "own"])

    def fitted(told: pd.DataFrame) -> pd.DataFrame:
        told = told.sort_values("own_id")
        own = [np.frombuffer(x, np.int32) for x in told["own"]]
        label, curve = told["label"].to_numpy(np.int64), told["curve"].to_numpy(bool)
        pick = lambda where: [own[i] for i in np.flatnonzero(where)]
        m = fit(pick(~curve), label[~curve], pick(curve), label[curve], ratio, n.astype(float))
        return pd.DataFrame({"square": [m.square.tobytes()], "weight": [m.weight.tobytes()], "bias": [m.bias], "slope": [m.slope], "shift": [m.shift]})

    drawn = rows.join(sample, F.col("doc_id") == F.col("own_id")).select("text", "own_id", "label", "curve")
    told = drawn.mapInArrow(features, "own_id long, label int, curve boolean, own binary")
    told = told.groupBy("own_id", "label", "curve").agg(F.min("own").alias("own"))  # of repeated rows of an id one stands in the sample
    told = written(told, "classifier-sample")
    made = told.withColumn("one", F.lit(True)).groupBy("one").applyInPandas(fitted, "square binary, weight binary, bias double, slope double, shift double").first()
    return Model(np.frombuffer(made["square"]), np.frombuffer(made["weight"]), made["bias"], made["slope"], made["shift"])


def score(docs: DataFrame, model: Model | float, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score) of every row; no shuffle."""

    def run(batches):
        for b in batches:
            if isinstance(model, Model):
                own = model.score([model.margin(indicators((t or "").encode())) for t in strings(b.column(1))])
            else:
                own = np.full(b.num_rows, model)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(own, pa.float64())], names=["doc_id", "score"])

    return _rows(docs, id_col, text_col).mapInArrow(run, "doc_id long, score double")
